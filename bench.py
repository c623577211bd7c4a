"""Times of the headline queries, as one JSON line.

Each query is planned and run in full, ``BENCH_RUNS`` times (twice by default),
into a sink that keeps nothing. The best time counts, so that it is not the
compilation of a fresh session.
"""

from __future__ import annotations

import json
import os
import time

from snapdrift import catalog
from snapdrift.session import local_session

HEADLINE = (
    "history_diff",
    "set_fingerprint",
    "change_counts",
    "topk_per_bucket",
    "version_transition",
    "first_seen",
    "visible_text_lines",
    "quoted_strings",
    "js_noise_filter",
    "js_categorize",
    "line_diff",
    "detect_docs",
    "detect_js_deep",
    "detect_page_change",
    "detect_robots_txt",
    "detect_pypi",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("OFF")
    queries, times = catalog.queries(), {}
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    queries["text_fingerprint"](spark, folder).write.format("noop").mode("overwrite").save()
    for name in wanted:
        best = None
        for _ in range(runs):
            started = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - started
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
