"""Items of many captures: sitemaps of any depth, scripts and sources whose bodies never move."""

from __future__ import annotations

import re

import pytest
from conftest import make_captures, make_targets

from snapdrift.operators import watch
from snapdrift.plans import detect as plan
from snapdrift.plans.monitors import MONITORS

ROOT = "https://t.example.com/sitemap.xml"


def index(*children):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{c}</loc></sitemap>" for c in children) + "</sitemapindex>"


def urls(*pages):
    return "<urlset>" + "".join(f"<url><loc>{p}</loc></url>" for p in pages) + "</urlset>"


def test_deep_sitemaps_and_cycles(spark, monkeypatch):
    at = lambda i: f"https://t.example.com/s{i}.xml"
    rows = [{"target_id": "t", "scan_id": 1, "url": ROOT, "body": index(at(1), at(99))}]
    rows += [{"target_id": "t", "scan_id": 1, "url": at(i), "body": index(at(i + 1)) + urls(f"p{i}")} for i in range(1, 31)]
    rows += [{"target_id": "t", "scan_id": 1, "url": at(31), "body": index(at(5), ROOT, at(31)) + urls("end", "p1")}]
    rows += [{"target_id": "t", "scan_id": 1, "url": at(50), "body": urls("unnamed")}]
    rows += [{"target_id": "t", "scan_id": 2, "url": at(1), "body": urls("without a root")}]
    rows += [{"target_id": "u", "scan_id": 1, "url": "https://u.example.com/", "body": urls("of u")}]
    captures = make_captures(spark, rows)
    targets = make_targets(spark, [{"target_id": "t", "url": ROOT}, {"target_id": "u", "url": "https://u.example.com/"}])
    read = []
    written = watch.written
    monkeypatch.setattr(watch, "written", lambda df, name: read.append("body" in plan_text(df)) or written(df, name))
    items, scans = watch.sitemap_urls(captures, targets)
    got = sorted((r.target_id, r.scan_id, r.item) for r in items.distinct().collect())
    assert got == sorted([("t", 1, f"p{i}") for i in range(1, 31)] + [("t", 1, "end"), ("u", 1, "of u")])
    assert sorted(tuple(r) for r in scans.collect()) == [("m", "t", 1), ("m", "u", 1)]
    assert sum(read) == 1 and len(read) > 30  # bodies are read once, rounds take addresses


def plan_text(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def moved_columns(df):
    """Columns that go through exchanges of the plan of ``df``."""
    blocks = re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan_text(df))
    return {c.split("#")[0].strip() for b in blocks for c in b.split(",")}


SCRIPT = 'var t = "Upgrade to the premium plan"; /*' + "-" * 100 + "*/"
BODIES = {
    "js_deep": [
        {"role": "page", "url": "https://t.example.com/", "body": '<script src="/a.js"></script>'},
        {"role": "bundle", "url": "https://t.example.com/a.js", "body": SCRIPT},
        {"role": "bundle", "url": "https://t.example.com/unnamed.js", "body": SCRIPT.replace("premium", "hidden")},
    ],
    "jobs": [{"role": "board_a", "body": '{"jobs": [{"title": "Engineer"}]}'}, {"role": "board_b", "body": "[]"}],
    "trademark": [{"role": "primary", "body": "12345678 - ALPHA"}, {"role": "fallback", "body": "87654321 - BETA"}],
    "docs": [{"body": "<p>New feature</p>"}],
    "arxiv": [{"body": "<feed><entry><title>T</title></entry></feed>"}],
}


@pytest.mark.parametrize("monitor", sorted(BODIES))
def test_bodies_stay_where_they_are(spark, monkeypatch, monitor):
    """Only what was extracted goes through an exchange, however large the watchlist."""
    moved = []
    stage = plan.stage
    for module in (plan, watch):
        monkeypatch.setattr(module, "stage", lambda df, name: moved.append(moved_columns(df)) or stage(df, name))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [{"monitor": monitor, "target_id": "t", "scan_id": i, **b} for i in (1, 2) for b in BODIES[monitor]]
        targets = make_targets(spark, [{"monitor": monitor, "target_id": "t", "attrs": {"board_a": "x"}}])
        items, scans = plan.extract(make_captures(spark, rows), targets, MONITORS[monitor])
        moved += [moved_columns(items), moved_columns(scans)]
        found = {r.item for r in plan.item_rows(items, MONITORS[monitor]).select("item").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert found and not any("hidden" in x or "87654321" in x for x in found)
    assert len(moved) > 2 and not any("body" in m for m in moved), moved
