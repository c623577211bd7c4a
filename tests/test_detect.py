"""Whole monitors through the life of a target."""

from __future__ import annotations

import json

import pytest
from conftest import make_captures, make_targets

from snapdrift.catalog import history
from snapdrift.operators.report import alert_payload, detection_rows
from snapdrift.plans.detect import detect
from snapdrift.plans.monitors import MONITORS
from snapdrift.plans.runner import run_all
from snapdrift.sources import targets as wl


def reports(spark, monitor, bodies, target=None, **common):
    """Reports for one target whose scans have these bodies; ``None`` is a failed scan."""
    rows = [
        {"monitor": monitor, "target_id": "t", "scan_id": i, "body": b, "status": 500 if b is None else 200, **common}
        for i, b in enumerate(bodies)
    ]
    targets = make_targets(spark, [{"monitor": monitor, "target_id": "t", **(target or {})}])
    return detect(make_captures(spark, rows), targets, MONITORS[monitor]).orderBy("scan_id", "color")


def robots(*paths):
    return "\n".join(f"Disallow: /{p}" for p in paths)


def test_failed_scan_is_skipped(spark):
    got = reports(spark, "robots_txt", [robots("a"), None, robots("a", "b")]).collect()
    assert [(r.scan_id, r.details) for r in got] == [(2, "+ `/b`")]


def test_guarded_monitor_keeps_its_baseline_over_an_empty_scan(spark):
    got = reports(spark, "robots_txt", [robots("a"), "nothing", robots("a", "b")]).collect()
    assert [(r.scan_id, r.details) for r in got] == [(2, "+ `/b`")]


def test_unguarded_monitor_compares_with_an_empty_scan(spark):
    got = reports(spark, "docs", ["<p>a new model</p>", "", "<p>a new model</p>"]).collect()
    assert [(r.scan_id, r.description.split("\n")[0]) for r in got] == [(2, "**1 lines added, 1 removed**")]


def test_alert_and_log_of_added_and_removed(spark):
    got = reports(spark, "robots_txt", [robots("a", "c"), robots("a", "b")], {"name": "Site", "domain": "s.com"})
    added, removed = got.collect()
    assert (added.detection_type, added.log_title, added.alert_title) == ("new_paths", "1 paths", "robots.txt Changed: Site")
    assert added.description == "**1 new path(s)** added\n\n```diff\n+ `/b`\n```" and added.url == "https://s.com/robots.txt"
    assert (removed.detection_type, removed.details, removed.color) == (None, None, 0xFF9800)
    assert detection_rows(got).count() == 1 and alert_payload(got).count() == 2


def test_list_monitor_sees_order_but_reports_new_entries(spark):
    prs = lambda *ids: json.dumps([{"id": i, "title": f"Title {i}", "number": i} for i in ids])
    got = reports(spark, "github_prs", [prs(1, 2), prs(2, 1), prs(3, 2, 1), prs(9, 8, 3)], {"keywords": ["TITLE 3", "title 9"]}).collect()
    assert [(r.scan_id, r.description) for r in got] == [
        (2, "**1 interesting PRs**\n\n• **Title 3** (#3)"),
        (3, "**1 interesting PRs**\n\n• **Title 9** (#9)"),
    ]


@pytest.mark.parametrize("n, oversize", [(49, False), (50, True)])
def test_large_asset_changes_are_marked(spark, n, oversize):
    html = "".join(f'<img src="/i/{i}.png">' for i in range(n))
    assert reports(spark, "cdn_assets", ['<img src="/x.png">', '<img src="/x.png">' + html]).collect()[0].oversize == oversize


@pytest.mark.parametrize("n, oversize", [(199, False), (200, True)])
def test_large_script_removals_are_marked(spark, n, oversize):
    def rows(scan, literals):
        common = {"monitor": "js_deep", "target_id": "t", "scan_id": scan}
        script = "".join(f'f("{x}");' for x in literals) + "/*" + "-" * 100
        return [
            {**common, "role": "page", "url": "https://t.example.com/", "body": '<script src="/m.js"></script>'},
            {**common, "role": "bundle", "url": "https://t.example.com/m.js", "body": script},
            {**common, "role": "bundle", "url": "https://t.example.com/other.js", "body": 'f("Stray Words Here");' + "-" * 100},
        ]

    keep = ["Keep This Text"]
    captures = make_captures(spark, rows(1, keep + [f"Label Number {i}" for i in range(n)]) + rows(2, keep))
    targets = make_targets(spark, [{"monitor": "js_deep", "target_id": "t"}])
    got = detect(captures, targets, MONITORS["js_deep"]).collect()
    assert [(r.alert_title, r.oversize) for r in got] == [("Removed Strings: t", oversize)]


def test_script_report_orders_its_sections(spark):
    def rows(scan, literals):
        script = "".join(f'f("{x}");' for x in literals) + "/*" + "-" * 100
        common = {"monitor": "js_deep", "target_id": "t", "scan_id": scan}
        return [
            {**common, "role": "page", "url": "https://t.example.com/", "body": '<script src="/m.js"></script>'},
            {**common, "role": "bundle", "url": "https://t.example.com/m.js", "body": script},
        ]

    fresh = ["Coming Soon Orbit", "coming soon zed", "Photo Studio", "open the saved file", "tokenization", "Orbit"]
    captures = make_captures(spark, rows(1, ["Keep This Text"]) + rows(2, ["Keep This Text", *fresh]))
    targets = make_targets(spark, [{"monitor": "js_deep", "target_id": "t", "keywords": ["orbit"]}])
    (r,) = detect(captures, targets, MONITORS["js_deep"]).collect()
    assert r.description == (
        "**5 new strings detected** in JS bundles (6 total new)\n\n**Keyword Matches:**\n* `Coming Soon Orbit`\n* `Orbit`\n\n"
        "**High Interest:**\n* `coming soon zed`\n\n**Feature Names:**\n* `Photo Studio`\n\n**New UI Text:**\n* `open the saved file`"
    )


def test_versions(spark):
    info = lambda v, s: json.dumps({"info": {"version": v, "summary": s}})
    got = reports(spark, "pypi", [info("", "s"), info("2", "s"), info("2", "s"), "oops", info("2", "t")], {"name": "Co"}).collect()
    assert [(r.scan_id, r.description) for r in got] == [(1, "**unknown -> 2**\n\ns"), (4, "**2 -> 2**\n\nt")]


def test_unlisted_targets_are_not_reported(spark):
    rows = [{"monitor": "robots_txt", "target_id": t, "scan_id": i, "body": robots(str(i))} for t in "ab" for i in range(2)]
    targets = make_targets(spark, [{"monitor": "robots_txt", "target_id": "a"}])
    got = detect(make_captures(spark, rows), targets, MONITORS["robots_txt"])
    assert {r.target_id for r in got.collect()} == {"a"}


def test_nested_sitemaps_and_cycles(spark):
    loc = lambda tag, u: f"<{tag}><loc>{u}</loc></{tag}>"
    site = "https://s.com"

    def scan(i, leaf):
        docs = {
            f"{site}/sitemap.xml": loc("sitemap", f"{site}/1.xml") + loc("url", f"{site}/home"),
            f"{site}/1.xml": loc("sitemap", f"{site}/2.xml") + loc("sitemap", f"{site}/sitemap.xml"),
            f"{site}/2.xml": loc("url", leaf),
            f"{site}/stray.xml": loc("url", f"{site}/stray{i}"),
        }
        return [{"monitor": "sitemap", "target_id": "t", "scan_id": i, "url": u, "body": b} for u, b in docs.items()]

    captures = make_captures(spark, scan(1, f"{site}/a") + scan(2, f"{site}/b"))
    targets = make_targets(spark, [{"monitor": "sitemap", "target_id": "t", "url": f"{site}/sitemap.xml"}])
    (r,) = detect(captures, targets, MONITORS["sitemap"]).collect()
    assert (r.scan_id, r.details) == (2, f"• {site}/b")


def test_a_failing_monitor_stops_no_other(spark, tmp_path):
    rows = [{"monitor": "robots_txt", "target_id": "a", "scan_id": i, "body": robots(str(i))} for i in range(2)]
    targets = make_targets(spark, [{"monitor": "robots_txt", "target_id": "a"}])
    broken = {"robots_txt": MONITORS["robots_txt"], "bad": None}
    got = run_all(make_captures(spark, rows), targets, str(tmp_path / "d"), str(tmp_path / "a"), monitors=broken).collect()
    assert {(r.monitor, r.status) for r in got} == {("robots_txt", "done"), ("bad", "failed")}
    assert spark.read.parquet(str(tmp_path / "d")).count() == 1 and spark.read.parquet(str(tmp_path / "a")).count() == 2


def test_every_kept_change_is_written(spark, tmp_path):
    from snapdrift.plans.incremental import run_epoch
    from snapdrift.sources.sinks import read_changes

    long = "q" * 300
    bodies = [robots("a", "gone"), robots("a", long, *[f"new{i}" for i in range(400)])]
    rows = [{"monitor": "robots_txt", "target_id": "t", "scan_id": i, "body": b} for i, b in enumerate(bodies)]
    rows += [{"monitor": "pypi", "target_id": "p", "scan_id": i, "body": f'{{"info": {{"version": "{i}", "summary": "{"s" * 900}"}}}}'} for i in range(2)]
    captures = make_captures(spark, rows)
    targets = make_targets(spark, [{"monitor": "robots_txt", "target_id": "t"}, {"monitor": "pypi", "target_id": "p"}])
    run_all(captures, targets, str(tmp_path / "d"), only=["robots_txt", "pypi"]).collect()
    got = read_changes(spark, str(tmp_path / "d_changes")).collect()
    want = {f"/{x}" for x in [long, *[f"new{i}" for i in range(400)]]}
    assert {r.item for r in got if r.monitor == "robots_txt" and r.op == "added"} == want
    assert all(r.bucket for r in got) and (len(want), len([r for r in got if r.op == "added"])) == (401, 401)
    assert [(r.item, r.detail["old_version"], len(r.detail["notes"])) for r in got if r.monitor == "pypi"] == [("1", "0", 900)]
    for epoch in range(2):
        run_epoch(captures.filter(f"scan_id = {epoch}"), targets, MONITORS["robots_txt"], str(tmp_path / "s"), str(tmp_path / "o"), epoch)
    stored = spark.read.parquet(str(tmp_path / "o" / "changes")).filter("op = 'added'").collect()
    assert {r.item for r in stored} == want and len(stored) == 401


def test_built_in_watchlist(spark, tmp_path):
    default = wl.load_targets(spark)
    assert default.groupBy("monitor", "target_id").count().filter("count > 1").count() == 0
    counts = {r.monitor: r["count"] for r in default.groupBy("monitor").count().collect()}
    assert (counts["fcc"], counts["trademark"], counts["sec_8k"], counts["jobs"], counts["docs"]) == (21, 65, 64, 17, 4)
    assert "ct_logs" not in counts and "github_prs" not in counts and counts["apk_strings"] == 4
    assert wl.load_targets(spark, str(tmp_path / "missing.json")).count() == default.count()
    row = default.filter("monitor = 'sec_8k' and target_id = 'AAPL'").first()
    assert (row.ticker, row.attrs) == ("AAPL", {"cik": "0000320193"})


def test_configured_watchlist(spark, tmp_path):
    config = {
        "docs": [{"name": "D", "urls": ["https://d/1", "https://d/2"], "keywords": ["k"]}],
        "pages": [{"name": "P", "url": "https://p", "selector": None}],
        "github": [{"name": "R", "repo": "o/r", "watch": ["prs"]}],
        "npm_packages": {"left-pad": "Pad Co"},
        "ct_logs": [{"name": "C", "domain": "c.com"}],
        "unknown": [{"name": "X"}],
    }
    path = tmp_path / "config.json"
    path.write_text(json.dumps(config, indent=2))
    got = wl.load_targets(spark, str(path))
    counts = {r.monitor: r["count"] for r in got.groupBy("monitor").count().collect()}
    assert (counts["docs"], counts["page_change"], counts["github_prs"], counts["npm"], counts["ct_logs"]) == (2, 1, 1, 1, 1)
    assert "js_deep" not in counts and "github_release" not in counts and counts["pypi"] == 19
    assert got.filter("monitor = 'page_change'").first().attrs == {}


def test_watchlist_of_a_document_a_line(spark, tmp_path):
    configs = [{"docs": [{"name": f"D{i}", "urls": [f"https://d/{i}"], "keywords": ["k\nl"]}], "npm_packages": {f"p{i}": "P"}} for i in range(50)]
    for name, cut in (("a", configs[:30]), ("b", configs[30:])):
        (tmp_path / name).write_text("\n".join(json.dumps(c) for c in cut) + "\n")
    got = wl.load_targets(spark, str(tmp_path), lines=True)
    rows = [r for r in got.collect() if r.monitor in ("docs", "npm")]
    assert len(rows) == 100 and {r.url for r in rows if r.monitor == "docs"} == {f"https://d/{i}" for i in range(50)}
    assert all(r.keywords == ["k\nl"] for r in rows if r.monitor == "docs") and got.filter("monitor = 'pypi'").count() == 19


def test_the_query_writes_no_file_a_document(spark, tmp_path, monkeypatch):
    spark.range(400).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(history, "workspace", lambda df: str(tmp_path / "configs"))
    got = history.load_targets(spark, str(tmp_path))
    assert got.filter("monitor = 'npm'").count() == 400 and got.filter("monitor = 'docs'").count() == 800
    assert len(list((tmp_path / "configs").glob("part-*"))) < 10


def test_shared_filer_numbers_are_flagged(spark):
    assert [r.codes for r in wl.shared_labels(wl.dimension(spark, "sec_8k")).collect()] == [["DUOL", "PINS"]]


def test_enrichment_keeps_unknown_codes(spark):
    rows = spark.createDataFrame([("BCG",), ("???",)], "code string")
    assert {(r.code, r.label) for r in wl.company_enrich(rows, "fcc", "code").collect()} == {("BCG", "Apple (AAPL)"), ("???", None)}


def test_alert_is_cut_to_size(spark):
    rows = [("m", "t", 1, "T", "x" * 5000, 1, "", [("n", "v", True)] * 30)]
    schema = (
        "monitor string, target_id string, scan_id bigint, alert_title string, description string, color int, url string, "
        "fields array<struct<name:string,value:string,inline:boolean>>"
    )
    payload = json.loads(alert_payload(spark.createDataFrame(rows, schema)).first().payload)
    assert (payload["title"], len(payload["description"]), len(payload["fields"])) == ("🔍 T", 4000, 25) and "url" not in payload


def test_apk_scans_follow_new_versions(spark):
    from snapdrift.plans.detect import due_scans

    body = lambda v: json.dumps({"version": v, "recentChanges": "x"})
    rows = [{"monitor": "play_store", "target_id": "p", "scan_id": i, "body": body(v)} for i, v in enumerate(["1", "1", "2", "2", "3"])]
    due = due_scans(make_captures(spark, rows), make_targets(spark, [{"monitor": "play_store", "target_id": "p"}]), MONITORS["play_store"], "apk_strings")
    assert sorted((r.scan_id, r.version) for r in due.collect()) == [(0, "1"), (2, "2"), (4, "3")]


def test_resources_follow_the_package_of_a_new_version(spark):
    play = lambda i, v: {"monitor": "play_store", "target_id": "App", "scan_id": i, "body": json.dumps({"version": v})}
    resource = lambda i, v: {"monitor": "apk_strings", "target_id": "com.app", "scan_id": i, "url": "title_x", "role": "en", "body": v}
    rows = [play(1, "1"), play(2, "1"), play(3, "2")]
    rows += [resource(1, "Smart Canvas"), resource(2, "Ignored Now"), resource(3, "Voice Lab")]
    targets = make_targets(
        spark,
        [
            {"monitor": "play_store", "target_id": "App", "attrs": {"package": "com.app"}},
            {"monitor": "apk_strings", "target_id": "com.app", "name": "App"},
        ],
    )
    got = detect(make_captures(spark, rows), targets, MONITORS["apk_strings"]).orderBy("color").collect()
    assert [(r.scan_id, r.alert_title, r.log_target) for r in got] == [
        (3, "🔍 APK Strings: App v2", "App"),
        (3, "🔍 APK Removed: App v2", "com.app"),
    ]
    assert got[0].details == "**⭐ Feature Names:**\n* Voice Lab"


def test_every_monitor_names_its_log_type():
    silent = {m for m, s in MONITORS.items() if not any(getattr(a, "detection_type", None) for a in getattr(s, "alerts", (s,)))}
    assert len(MONITORS) == 26 and silent == {"github_prs"}
