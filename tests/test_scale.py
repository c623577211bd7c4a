"""Plan shapes that have to hold for a target with most of the rows."""

from __future__ import annotations

import random
import re
from dataclasses import replace

import pytest
from conftest import make_captures, make_targets
from pyspark.sql import functions as F

from snapdrift.catalog import history
from snapdrift.operators import diff, scans, watch
from snapdrift.operators.watch import bundle_urls
from snapdrift.plans.detect import VersionMonitor, bucketed, detect, extract, version_scans
from snapdrift.plans.monitors import MONITORS
from snapdrift.schema import SCAN
from snapdrift.sources import staging
from snapdrift.sources.staging import FINE, fine_tasks, spread


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def hot_items(spark):
    rng = random.Random(4)
    rows = [("m", "hot" if i % 2 else f"t{i % 50}", rng.randrange(400), f"w{rng.randrange(300)}") for i in range(20000)]
    return spark.createDataFrame(rows, "monitor string, target_id string, scan_id bigint, item string")


def test_differences_are_keyed_by_item_and_scanned_once(spark, tmp_path):
    hot_items(spark).write.parquet(str(tmp_path / "items"))
    items = diff.distinct_items(spark.read.parquet(str(tmp_path / "items")))
    plan = final_plan(diff.history_diff(items, scans.change_gate(scans.merged_fingerprint(items))))
    assert len(re.findall("FileScan", plan)) == 1 and "ReusedExchange" in plan
    for keys in re.findall(r"hashpartitioning\(([^)]*)\)", plan):
        names = re.sub(r"#\d+L?", "", keys)
        # apart from the few range ends, a target alone is no key
        assert "item" in names or "scan_id" in names or "_block" in names or "_grouping" in names or names.count(",") == 2


def test_windows_over_scans_are_split_into_ranges(spark):
    frame = hot_items(spark).select(*SCAN).distinct()
    plan = final_plan(scans.with_previous(frame, []))
    windows = re.findall(r"windowspecdefinition\(([^)]*?)specifiedwindowframe", plan)
    assert sum("_block" in w for w in windows) == len(windows) and windows


def test_ranking_drops_rows_before_its_shuffle(spark):
    bodies = ["Disallow: /x", "\n".join(f"Disallow: /{i}" for i in range(50))]
    rows = [{"monitor": "robots_txt", "target_id": "t", "scan_id": i, "body": b} for i, b in enumerate(bodies)]
    targets = make_targets(spark, [{"monitor": "robots_txt", "target_id": "t"}])
    df = detect(make_captures(spark, rows), targets, MONITORS["robots_txt"])
    assert "WindowGroupLimit" in final_plan(df)
    assert df.filter("detection_type is not null").first().details.count("\n") == 14


def test_scans_read_no_bodies(spark, tmp_path):
    rows = [{"monitor": "m", "target_id": "t", "scan_id": i, "body": "x" * 1000} for i in range(20)]
    make_captures(spark, rows).write.parquet(str(tmp_path / "c"))
    captures = spark.read.parquet(str(tmp_path / "c"))
    plan = final_plan(scans.with_previous(captures.filter("monitor = 'm'").select(*SCAN), []))
    assert "PushedFilters: [IsNotNull(monitor), EqualTo(monitor,m)" in plan
    assert all("body" not in s for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan))


def test_only_small_inputs_are_spread(spark):
    wide = spark.range(0, 1000, 1, 64)
    assert spread(wide) is wide
    assert spread(spark.range(0, 1000, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_one_huge_scan_has_a_mergeable_mark(spark):
    big = spark.range(200_000).select(
        F.lit("m").alias("monitor"), F.lit("t").alias("target_id"), F.lit(1).cast("bigint").alias("scan_id"),
        F.col("id").cast("string").alias("item"),
    )
    marks = [scans.merged_fingerprint(d).first() for d in (big, big.orderBy(F.desc("item")), big.filter("item <> '7'"))]
    assert marks[0] == marks[1] != marks[2] and marks[0].n_items == 200_000
    assert "collect" not in final_plan(scans.merged_fingerprint(big))


def test_addresses_of_scripts_unfold_in_many_tasks(spark):
    html = "".join(f'<script src="/b{i}.js"></script>' for i in range(3))
    rows = [{"target_id": "t", "scan_id": i, "role": "page", "body": html} for i in range(64)]
    captures = make_captures(spark, rows).coalesce(1)
    got = bundle_urls(captures, make_targets(spark, [{"target_id": "t"}])).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 192 and {r.url for r in got} == {f"https://t.example.com/b{i}.js" for i in range(3)}
    assert len({r.task for r in got}) > 1


def test_references_are_never_broadcast(spark):
    rows = [{"target_id": t, "scan_id": 1, "role": "page", "body": '<script src="/b.js"></script>'} for t in ("t1", "unlisted")]
    targets = make_targets(spark, [{"target_id": f"t{i}"} for i in range(500)])
    df = bundle_urls(make_captures(spark, rows), targets)
    assert [(r.target_id, r.url) for r in df.collect()] == [("t1", "https://t.example.com/b.js")]
    assert "BuildLeft" not in final_plan(df)


def test_bodies_of_scripts_are_made_once(spark, monkeypatch):
    rows = [{"target_id": "t", "scan_id": i, "role": r, "url": u, "body": b} for i in (1, 2) for r, u, b in PARTS]
    captures = make_captures(spark, rows).withColumn("body", F.reverse("body"))
    plans = []
    write = watch.written
    monkeypatch.setattr(watch, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
    named, _ = watch.bundle_items(captures, make_targets(spark, [{"target_id": "t"}]), F.array("body"))
    assert sorted((r.scan_id, r.entries) for r in named.collect()) == [(1, ["xyz"]), (2, ["xyz"])]
    (made,) = plans
    assert made.count("reverse(") == 1, made


READ_ONCE = {
    "robots_txt": "Disallow: /a", "trademark": "<html></html>", "pypi": '{"info": {"version": "1.0"}}',
    "sitemap": "<urlset><url><loc>https://t.example.com/a</loc></url></urlset>",
}


@pytest.mark.parametrize("name", READ_ONCE)
def test_made_bodies_are_read_before_a_filter(spark, monkeypatch, tmp_path, name):
    bodies = [READ_ONCE[name][::-1], None]
    rows = [{"monitor": name, "target_id": "t", "scan_id": i, "role": "TXT", "url": "https://t.example.com/", "body": b} for i, b in enumerate(bodies)]
    captures = make_captures(spark, rows).repartition(4).withColumn("body", F.reverse("body"))
    targets = make_targets(spark, [{"monitor": name, "target_id": "t"}])
    plans, write = [], staging.written
    keep = lambda df, n: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, n)
    monkeypatch.setattr(staging, "named_folder", lambda session: f"file://{tmp_path}")
    monkeypatch.setattr(staging, "written", keep)
    monkeypatch.setattr(watch, "written", keep)
    if isinstance(MONITORS[name], VersionMonitor):
        assert [r.scan_id for r in version_scans(captures, targets, MONITORS[name]).collect()] == [0]
    else:
        items, scans = extract(captures, targets, MONITORS[name])
        items.count(), scans.count()
    assert sum(p.count("reverse(") for p in plans) == 1, plans


PARTS = [("page", None, '<script src="/a.js"></script><script src="/b.js"></script>'[::-1]), ("bundle", "https://t.example.com/a.js", "zyx"), ("bundle", "https://t.example.com/b.js", None)]


def test_tasks_over_items_are_kept_small(spark):
    own = spark.newSession()
    split, joined = FINE
    for given, kept in (("128MB", str(FINE[split])), ("1g", str(FINE[split])), ("4m", "4m"), (str(64 << 20), str(FINE[split]))):
        own.conf.set(split, given)
        fine_tasks(own)
        assert own.conf.get(split) == kept and own.conf.get(joined) == str(FINE[joined])


def test_history_of_shipments_runs_in_small_tasks(spark):
    own = spark.newSession()
    history.shipment_changes(own, "/root/testdata/sf0.001")
    assert all(own.conf.get(key) == str(most) for key, most in FINE.items())


def test_changes_that_no_alert_reports_are_counted_without_their_words(spark):
    rows = [("docs", "t", 2, op, x) for op in ("added", "removed") for x in ("New API endpoint in beta", "zzz")]
    changes = spark.createDataFrame(rows, "monitor string, target_id string, scan_id bigint, op string, item string")
    got = bucketed(changes, make_targets(spark, [{"monitor": "docs", "target_id": "t"}]), MONITORS["docs"]).collect()
    assert len(got) == 4 and sum(r.op == "removed" for r in got) == 2
    assert all((r.item is None) == (r.bucket is None) for r in got) and {r.item for r in got} == {"New API endpoint in beta", None}


@pytest.mark.parametrize("named", [True, False])
def test_a_run_leaves_its_results_only(spark, monkeypatch, tmp_path, named):
    from snapdrift.plans import runner

    bodies = {
        "robots_txt": ["Disallow: /a", "Disallow: /b"], "pypi": ['{"info": {"version": "1.0"}}', '{"info": {"version": "2.0"}}'],
        "sitemap": [f"<urlset><url><loc>https://t.example.com/{x}</loc></url></urlset>" for x in "ab"],
    }
    rows = [
        {"monitor": m, "target_id": "t", "scan_id": i, "url": "https://t.example.com/", "body": b} for m, bs in bodies.items() for i, b in enumerate(bs)
    ]
    rows += [{"monitor": "js_deep", "target_id": "t", "scan_id": i, "role": "page", "body": '<script src="/a.js"></script>'} for i in (1, 2)]
    rows += [
        {"monitor": "js_deep", "target_id": "t", "scan_id": i, "role": "bundle", "url": "https://t.example.com/a.js", "body": f't("New Feature {i}")'}
        for i in (1, 2)
    ]
    targets = make_targets(spark, [{"monitor": m, "target_id": "t"} for m in (*bodies, "js_deep")])
    if named:
        monkeypatch.setattr(staging, "named_folder", lambda session: f"file://{tmp_path}")
    monkeypatch.setattr(staging, "_own_folder", lambda: f"file://{tmp_path}")
    key, seen, alerts = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], runner.write_alerts
    monkeypatch.setattr(runner, "write_alerts", lambda *a: seen.append((spark.conf.get(key), sorted(p.name for p in (tmp_path / "snapdrift").glob("*")))) or alerts(*a))
    before = spark.conf.get(key)
    broken = {**{m: MONITORS[m] for m in (*bodies, "js_deep")}, "robots_txt": replace(MONITORS["robots_txt"], alerts=())}
    got = runner.run_all(make_captures(spark, rows), targets, f"{tmp_path}/d", f"{tmp_path}/a", monitors=broken, at_once=1).collect()
    assert {r.monitor: r.status for r in got} == {"robots_txt": "failed", "pypi": "done", "sitemap": "done", "js_deep": "done"}
    for found in ("d", "a", "d_changes"):
        assert {r.monitor for r in spark.read.parquet(f"{tmp_path}/{found}").collect()} == {"pypi", "sitemap", "js_deep"}, found
    assert list((tmp_path / "snapdrift").glob("*")) == [] and spark.conf.get(key) == before
    assert {on for on, _ in seen} == {"true"} and (not named or all(len(left) == 1 and left[0].split("-")[-2] == "reports" for _, left in seen)), seen
