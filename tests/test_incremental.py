"""Runs against stored state, in batches and as streams."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from conftest import make_captures, make_targets
from pyspark.sql import Row
from pyspark.sql import functions as F

from snapdrift.plans.detect import detect
from snapdrift.plans import incremental
from snapdrift.plans.incremental import late_captures, read_sink, read_state, repair, run_epoch_all
from snapdrift.plans.state import live_bytes, names_in, vacuum
from snapdrift.plans.monitors import MONITORS
from snapdrift.schema import CAPTURES
from snapdrift.streaming import jobs

SPEC = MONITORS["robots_txt"]


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def run_epoch(*args, **options):
    incremental.run_epoch(*args, **{"buckets": 2, **options})



def body(*paths):
    return "\n".join(f"Disallow: /{p}" for p in paths)


HISTORY = {
    "a": ["x", "x", "xy", "xy", "y", "", "xyz"],
    "b": ["p", "pq", "q", "q", "q", "qr", "p"],
    "c": ["", "m", "m", "mn", "m", "n", "n"],
}


@pytest.fixture(scope="module")
def captures(spark):
    rows = [
        {"monitor": "robots_txt", "target_id": t, "scan_id": i, "body": body(*s), "status": 500 if (t, i) == ("b", 3) else 200}
        for t, scans in HISTORY.items()
        for i, s in enumerate(scans)
    ]
    return make_captures(spark, rows)


@pytest.fixture(scope="module")
def targets(spark):
    return make_targets(spark, [{"monitor": "robots_txt", "target_id": t} for t in HISTORY])


def rows_of(df):
    return {(r.target_id, r.scan_id, r.alert_title, r.description) for r in df.collect()}


@pytest.mark.parametrize("cuts", [[2, 4, 7], [1, 2, 3, 4, 5, 6, 7]])
def test_epochs_equal_one_history(spark, captures, targets, tmp_path, cuts):
    start = 0
    for epoch, end in enumerate(cuts):
        part = captures.filter(F.col("scan_id").between(start, end - 1))
        run_epoch(part, targets, SPEC, str(tmp_path / "state"), str(tmp_path / "out"), epoch)
        start = end
    assert rows_of(spark.read.parquet(str(tmp_path / "out" / "reports"))) == rows_of(detect(captures, targets, SPEC))


def test_a_replayed_epoch_changes_nothing(spark, captures, targets, tmp_path):
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    for epoch, part in ((0, "scan_id < 3"), (1, "scan_id >= 3"), (1, "scan_id >= 3")):
        run_epoch(captures.filter(part), targets, SPEC, state, out, epoch)
    assert rows_of(spark.read.parquet(f"{out}/reports")) == rows_of(detect(captures, targets, SPEC))


def test_state_points_at_the_items_of_the_last_change(spark, captures, targets, tmp_path):
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    run_epoch(captures.filter("scan_id < 1"), targets, SPEC, state, out, 0)
    run_epoch(captures.filter("scan_id = 1"), targets, SPEC, state, out, 1)
    row = read_state(spark, state, 2, "robots_txt").filter("target_id = 'a'").first()
    assert (row.scan_id, row.items_scan, row.items_epoch) == (1, 0, 0)


def test_bytes_read_do_not_grow_with_runs(spark, targets, tmp_path):
    state, out, read = str(tmp_path / "state"), str(tmp_path / "out"), []
    for epoch in range(9):
        rows = [{"monitor": "robots_txt", "target_id": t, "scan_id": epoch, "body": body(*[f"{t}{epoch}{i}" for i in range(40)])} for t in HISTORY]
        run_epoch(make_captures(spark, rows), targets, SPEC, state, out, epoch, buckets=2)
        read.append(live_bytes(spark, f"{state}/monitor=robots_txt", epoch + 1))
    assert max(read[5:]) <= max(read[:5]) * 1.1
    assert spark.sql("SHOW TABLES").count() == 0
    assert read_state(spark, state, 9, "robots_txt").count() == 3
    folder = f"{state}/monitor=robots_txt"
    assert vacuum(spark, folder, 9) > 5
    assert len(names_in(spark, f"{folder}/items")) <= 5 and names_in(spark, f"{folder}/manifests") == ["epoch=8.json"]
    run_epoch(make_captures(spark, rows).withColumn("scan_id", F.lit(99).cast("bigint")), targets, SPEC, state, out, 9)
    assert read_sink(spark, out, "reports", "robots_txt").filter("scan_id = 99").count() == 0  # the same content


def test_state_is_joined_where_it_lies(spark, targets, tmp_path, monkeypatch):
    from snapdrift.plans import incremental as inc

    state, out, plans = str(tmp_path / "state"), str(tmp_path / "out"), []
    stored_items = inc._stored_items

    def watched(items, touched):
        found = stored_items(items, touched)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(inc, "_stored_items", watched)
    monkeypatch.setattr(inc, "stage", lambda df, name: df)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for epoch in range(2):
            run_epoch(make_captures(spark, [{"monitor": "robots_txt", "target_id": "a", "scan_id": epoch, "body": body("x", str(epoch))}]), targets, SPEC, state, out, epoch)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    lines = plans[-1].splitlines()
    scan = next(i for i, line in enumerate(lines) if "snapdrift_items" in line)
    above, depth = [], len(lines[scan]) - len(lines[scan].lstrip(" :+-"))
    for line in reversed(lines[:scan]):  # from the scan up to the join
        if (own := len(line) - len(line.lstrip(" :+-"))) < depth:
            above, depth = [*above, line], own
    names = [line.lstrip(" :+-").split(" ")[0] for line in above]
    assert "SortMergeJoin" in names and "Exchange" not in names, names


def all_captures(scans):
    """Two or three captures a scan for monitors of several, one for others."""
    rows = []
    for i in scans:
        at = {"scan_id": i, "captured_at": datetime(2024, 1, 1 + i)}
        page = f'<script src="/a{i}.js"></script>'
        script = f'var t = "Upgrade to the premium plan {i}"; /*{"-" * 100}*/'
        answer = lambda x: f'{{"Answer": [{{"data": "{x}"}}]}}'
        resources = {"label": f"Start a new trial number {i}", "other": "Enable the beta feature"}
        rows += [
            {"monitor": "robots_txt", "target_id": "t", "body": body("x", str(i)), **at},
            {"monitor": "pypi", "target_id": "t", "body": f'{{"info": {{"version": "{i // 2}", "summary": "s"}}}}', **at},
            {"monitor": "js_deep", "target_id": "t", "role": "page", "url": "https://t.example.com/", "body": page, **at},
            {"monitor": "js_deep", "target_id": "t", "role": "bundle", "url": f"https://t.example.com/a{i}.js", "body": script, **at},
            {"monitor": "sitemap", "target_id": "t", "url": "https://t.example.com/", "body": "<sitemapindex><sitemap><loc>https://t.example.com/s</loc></sitemap></sitemapindex>", **at},
            {"monitor": "sitemap", "target_id": "t", "url": "https://t.example.com/s", "body": f"<urlset><url><loc>https://t.example.com/{i}</loc></url></urlset>", **at},
            {"monitor": "dns_records", "target_id": "t", "role": "TXT", "body": answer(f"v{i}"), **at},
            {"monitor": "dns_records", "target_id": "t", "role": "MX", "body": answer("mail"), **at},
            {"monitor": "subdomains", "target_id": "t", "url": "www.t.example.com", "body": "1.2.3.4", **at},
            {"monitor": "subdomains", "target_id": "t", "url": ("api" if i % 2 else "beta") + ".t.example.com", "body": "1.2.3.4", **at},
        ]
        rows += [{"monitor": "apk_strings", "target_id": "p", "role": "en", "url": n, "body": v, **at} for n, v in resources.items()]
        rows.append({"monitor": "play_store", "target_id": "p", "body": f'{{"version": "{i}", "recentChanges": "n"}}', **at})
    return rows


EVERY = ("robots_txt", "pypi", "js_deep", "sitemap", "dns_records", "subdomains", "apk_strings", "play_store")


@pytest.mark.parametrize("cuts", [(15, 34)])
def test_monitors_share_a_folder(spark, tmp_path, cuts):
    """Portions that end inside scans, and between a lead and its follower, give what one history gives; so does a repeated epoch."""
    rows = all_captures(range(4))
    targets = make_targets(spark, [{"monitor": m, "target_id": "p" if m in ("apk_strings", "play_store") else "t"} for m in EVERY])
    specs, state, out, start = [MONITORS[m] for m in EVERY], str(tmp_path / "state"), str(tmp_path / "out"), 0
    for epoch, end in enumerate([*cuts, len(rows)]):
        last = end == len(rows)
        for _ in range(2 if epoch == 1 else 1):
            errors = run_epoch_all(make_captures(spark, rows[start:end]), targets, specs, state, out, epoch, close=last, buckets=2)
            assert not any(errors.values()), errors
        start = end
    for m in EVERY:
        want = rows_of(detect(make_captures(spark, rows), targets, MONITORS[m]))
        got = read_sink(spark, out, "reports", m)
        assert rows_of(got) == want and got.count() == len(want), m
        assert want or m == "pypi"


def test_scans_close_by_event_time(spark, tmp_path):
    """A target that ends: its last scan closes when captures of others are late enough."""
    spec, state, out = MONITORS["dns_records"], str(tmp_path / "state"), str(tmp_path / "out")
    targets = make_targets(spark, [{"monitor": "dns_records", "target_id": t} for t in ("a", "b")])

    def capture(target, scan, day, data):
        return {"monitor": "dns_records", "target_id": target, "scan_id": scan, "role": "TXT", "captured_at": datetime(2024, 1, day), "body": f'{{"Answer": [{{"data": "{data}"}}]}}'}

    held = []
    for epoch, rows in enumerate([[capture("a", 1, 1, "x")], [capture("a", 2, 2, "y"), capture("b", 1, 2, "q")], [capture("b", 2, 3, "q")], [capture("b", 3, 9, "q")]]):
        run_epoch(make_captures(spark, rows), targets, spec, state, out, epoch, delay=timedelta(days=2), buckets=2)
        held.append(spark.read.parquet(f"{state}/monitor=dns_records/held/epoch={epoch}").count())
    assert [(r.target_id, r.scan_id) for r in read_sink(spark, out, "reports", "dns_records").collect()] == [("a", 2)]
    assert held == [1, 2, 1, 1]  # each epoch holds what landed in it, not what is open
    row = read_state(spark, state, 4, "dns_records").filter("target_id = 'a'").first()
    assert row.scan_id == 2 and row.open == []


def test_follower_waits_for_its_lead(spark, tmp_path):
    spec, state, out = MONITORS["apk_strings"], str(tmp_path / "state"), str(tmp_path / "out")
    texts = ["Start a new trial", "Enable beta feature", "Upgrade to premium plan"]
    resources = [{"monitor": "apk_strings", "target_id": "p", "scan_id": i, "role": "en", "url": "label", "body": t} for i, t in enumerate(texts)]
    lead = [{"monitor": "play_store", "target_id": "p", "scan_id": i, "body": f'{{"version": "{i}", "recentChanges": "n"}}'} for i in range(3)]
    targets = make_targets(spark, [{"monitor": m, "target_id": "p"} for m in ("play_store", "apk_strings")])
    for epoch, rows in enumerate([resources[:2], resources[2:], lead[:1], lead[1:]]):
        run_epoch(make_captures(spark, rows), targets, spec, state, out, epoch, close=epoch == 3, buckets=2)
    want = rows_of(detect(make_captures(spark, resources + lead), targets, spec))
    assert {r[1] for r in want} == {1, 2} and rows_of(read_sink(spark, out, "reports", "apk_strings")) == want


def test_late_scans_are_kept_and_taken_in(spark, captures, targets, tmp_path):
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    run_epoch(captures.filter("scan_id >= 3 AND scan_id < 6"), targets, SPEC, state, out, 0)
    run_epoch(captures.filter("scan_id < 3 AND target_id <> 'c'"), targets, SPEC, state, out, 1)
    assert rows_of(read_sink(spark, out, "reports", "robots_txt")) == rows_of(detect(captures.filter("scan_id >= 3 AND scan_id < 6"), targets, SPEC))
    late = late_captures(spark, out, "robots_txt")
    assert {(r.target_id, r.scan_id, r.epoch) for r in late.collect()} == {(t, i, 1) for t in "ab" for i in range(3)}
    repair(captures.filter("scan_id < 6"), targets, SPEC, late, state, out, 2)
    run_epoch(captures.filter("scan_id = 6"), targets, SPEC, state, out, 3)
    got = read_sink(spark, out, "reports", "robots_txt")
    want = rows_of(detect(captures.filter("target_id <> 'c'"), targets, SPEC)) | rows_of(detect(captures.filter("scan_id >= 3 AND target_id = 'c'"), targets, SPEC))
    assert rows_of(got) == want and got.count() == len(want)


def test_scans_cut_by_a_batch_equal_one_history(spark, tmp_path):
    spec, answer = MONITORS["dns_records"], lambda x: f'{{"Answer": [{{"data": "{x}"}}]}}'
    rows = [
        {"monitor": "dns_records", "target_id": "d", "scan_id": scan, "role": role, "body": answer(f"{role}.example.com{more}")}
        for scan, more in enumerate(["", "", "x"]) for role in ("TXT", "MX")
    ]
    targets = make_targets(spark, [{"monitor": "dns_records", "target_id": "d"}])
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    for epoch, (start, end) in enumerate([(0, 3), (3, 5), (5, 6)]):
        run_epoch(make_captures(spark, rows[start:end]), targets, spec, state, out, epoch, close=end == 6)
    want = rows_of(detect(make_captures(spark, rows), targets, spec))
    got = spark.read.parquet(f"{out}/reports")
    assert len(want) == 1 and rows_of(got) == want and got.count() == 1


def test_following_monitor_takes_new_versions_only(spark, tmp_path):
    spec = MONITORS["apk_strings"]
    lead = spec.follows.monitor
    rows = []
    for scan, (version, text) in enumerate([("1", "Start a new trial"), ("1", "Enable beta feature"), ("2", "Upgrade to premium plan")]):
        rows.append({"monitor": lead, "target_id": "p", "scan_id": scan, "body": f'{{"version": "{version}", "recentChanges": "n"}}'})
        rows.append({"monitor": "apk_strings", "target_id": "p", "scan_id": scan, "role": "en", "url": "label", "body": text})
    targets = make_targets(spark, [{"monitor": m, "target_id": "p"} for m in (lead, "apk_strings")])
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    for epoch in range(3):
        run_epoch(make_captures(spark, rows[2 * epoch : 2 * epoch + 2]), targets, spec, state, out, epoch, close=epoch == 2)
    want = rows_of(detect(make_captures(spark, rows), targets, spec))
    assert {r[1] for r in want} == {2} and rows_of(spark.read.parquet(f"{out}/reports")) == want


def drain(spark, schema, tmp_path, portions, start):
    for portion in portions:
        portion.write.mode("append").parquet(str(tmp_path / "landed"))
        start(spark.readStream.schema(schema).parquet(str(tmp_path / "landed"))).awaitTermination()


def test_stream_equals_batch(spark, captures, targets, tmp_path):
    state, out, cp = (str(tmp_path / x) for x in ("state", "out", "cp"))
    portions = [captures.filter("scan_id < 2"), captures.filter("scan_id in (2, 3)"), captures.filter("scan_id > 3")]
    drain(spark, CAPTURES, tmp_path, portions, lambda s: jobs.stream_detect(s, targets, SPEC, state, out, cp))
    assert rows_of(spark.read.parquet(f"{out}/reports")) == rows_of(detect(captures, targets, SPEC))


def set_changes():
    want = set()
    for t, scans in HISTORY.items():
        for i in range(1, len(scans)):
            want |= {(t, i, "added", x) for x in set(scans[i]) - set(scans[i - 1])}
            want |= {(t, i, "removed", x) for x in set(scans[i - 1]) - set(scans[i])}
    return want


SETS = "monitor string, target_id string, scan_id bigint, items array<string>"


@pytest.mark.parametrize("shares", [1, 3])
@pytest.mark.parametrize("cuts", [(4,), (1, 2, 5), ()])
def test_stateful_stream_emits_set_changes(spark, tmp_path, shares, cuts):
    sets = [("m", t, i, [*s, *s[:1], None]) for t, scans in HISTORY.items() for i, s in enumerate(scans)]
    frame = spark.createDataFrame(sets, SETS)
    late = spark.createDataFrame([("m", "a", 2, ["late"])], SETS)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def start(stream):
        changes = jobs.stream_set_changes(stream, F.col("items"), shares)
        return changes.writeStream.option("checkpointLocation", cp).trigger(availableNow=True).format("parquet").option("path", out).start()

    edges = [0, *cuts, 99]
    portions = [frame.filter(F.col("scan_id").between(a, b - 1)) for a, b in zip(edges, edges[1:])]
    drain(spark, SETS, tmp_path, [*portions, late], start)
    got, want = spark.read.schema(jobs.CHANGES).parquet(out).collect(), set_changes()
    assert {(r.target_id, r.scan_id, r.op, r.item) for r in got} == want and len(got) == len(want)


def test_stateful_stream_starts_from_a_baseline(spark, tmp_path):
    sets = [("m", t, i, list(s)) for t, scans in HISTORY.items() for i, s in enumerate(scans)]
    frame = spark.createDataFrame(sets, SETS)
    base = frame.filter("scan_id = 2").select("monitor", "target_id", "scan_id", F.explode_outer("items").alias("item"))
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def start(stream):
        changes = jobs.stream_set_changes(stream, F.col("items"), 3, initial=base)
        return changes.writeStream.option("checkpointLocation", cp).trigger(availableNow=True).format("parquet").option("path", out).start()

    drain(spark, SETS, tmp_path, [frame.filter("scan_id < 5"), frame.filter("scan_id >= 5")], start)
    got = spark.read.schema(jobs.CHANGES).parquet(out).collect()
    assert {(r.target_id, r.scan_id, r.op, r.item) for r in got} == {c for c in set_changes() if c[1] > 2}


def test_stale_entries_of_the_state_count_as_absent(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "GONE", 0)  # never cleaned

    class Map(dict):
        getValue = lambda self, k: self.get(k)
        updateValue = lambda self, k, v: self.__setitem__(k, v)
        iterator = lambda self: iter(list(self.items()))

    class Value:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, v: setattr(self, "value", v)

    import pandas as pd

    state = jobs.SetState()
    state.last, state.items, got = Value(), Map(), set()
    scans = [set("ab"), set("b"), set("c"), set("abc"), set(), set("a")]
    for batch in ([0, 1], [2], [3, 4], [5]):
        frame = pd.DataFrame([(i, x) for i in batch for x in [None, *scans[i]]], columns=["scan_id", "item"])
        for out in state.handleInputRows(("m", "t", 0), iter([frame]), None):
            got |= {(r.scan_id, r.op, r.item) for r in out.itertuples()}
    want = {(i, "added", x) for i in range(1, 6) for x in scans[i] - scans[i - 1]} | {(i, "removed", x) for i in range(1, 6) for x in scans[i - 1] - scans[i]}
    assert got == want


def test_registry_keeps_first_and_last(spark, tmp_path):
    schema = "monitor string, target_id string, scan_id bigint, item string"
    rows = [("m", t, i, x) for t, scans in HISTORY.items() for i, s in enumerate(scans) for x in [*s, None]]
    frame = spark.createDataFrame(rows, schema)
    folder, sink, cp = (str(tmp_path / x) for x in ("registry", "new", "cp"))
    portions = [frame.filter("scan_id IN (2, 3)"), frame.filter("scan_id < 2"), frame.filter("scan_id > 3"), frame.filter("scan_id > 8")]
    drain(spark, schema, tmp_path, portions, lambda s: jobs.stream_first_seen(s, folder, sink, cp, buckets=2))
    want = {}
    for _, t, i, x in rows:
        if x is not None:
            want[t, x] = (min(i, want.get((t, x), (i,))[0]), max(i, want.get((t, x), (0, i))[1]))
    got = {(r.target_id, r.item): (r.first_seen, r.last_seen) for r in jobs.read_registry(spark, folder).collect()}
    assert got == want
    new = spark.read.parquet(sink)
    assert sorted((r.target_id, r.item) for r in new.collect()) == sorted(want)


def test_stream_of_every_monitor(spark, tmp_path):
    rows = all_captures(range(3))
    targets = make_targets(spark, [{"monitor": m, "target_id": "p" if m in ("apk_strings", "play_store") else "t"} for m in EVERY])
    state, out, cp = (str(tmp_path / x) for x in ("state", "out", "cp"))
    specs = [MONITORS[m] for m in ("robots_txt", "dns_records", "pypi")]
    portions = [make_captures(spark, rows[:17]), make_captures(spark, rows[17:])]
    drain(spark, CAPTURES, tmp_path, portions, lambda s: jobs.stream_detect_all(s, targets, state, out, cp, specs, buckets=2))
    for spec, until in zip(specs, (3, 2, 3)):  # the last scan of several captures is still open
        want = rows_of(detect(make_captures(spark, [r for r in rows if r["scan_id"] < until]), targets, spec))
        assert rows_of(read_sink(spark, out, "reports", spec.monitor)) == want and (want or spec.monitor == "pypi")


def test_a_share_touches_the_state_for_what_stays_only(monkeypatch):
    class Map(dict):
        calls = 0

        def __getattr__(self, name):
            def call(k=None, v=None):
                self.calls += 1
                return {"getValue": self.get, "removeKey": self.pop}[name](k) if name != "updateValue" else self.__setitem__(k, v)

            return call

        def iterator(self):
            self.calls += 1
            return iter(list(self.items()))

    class Value:
        value = None
        get = lambda self: self.value
        update = lambda self, v: setattr(self, "value", v)

    scans = [{f"x{i}", f"x{i + 1}"} for i in range(40)]
    want = {(i, op, x) for i in range(1, 40) for op, xs in (("added", scans[i] - scans[i - 1]), ("removed", scans[i - 1] - scans[i])) for x in xs}
    for held in (1 << 16, 5):  # gathered, and applied as they come
        monkeypatch.setattr(jobs, "HELD", held)
        state, got = jobs.RowSetState(), []
        state.last, state.items = Value(), Map()
        for batch in (range(20), range(20, 40)):
            rows = [Row(scan_id=i, item=x) for i in batch for x in [None, *sorted(scans[i])]]
            got += list(state.handleInputRows(("m", "t", 0), iter(rows), None))
        assert {(r.scan_id, r.op, r.item) for r in got} == want and len(got) == len(want)
        assert set(state.items) == {("x39",), ("x40",)} and (held == 5 or state.items.calls < 12)
