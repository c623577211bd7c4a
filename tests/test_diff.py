"""Previous scans, fingerprints and differences against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from snapdrift.operators import diff, report, scans
from snapdrift.schema import SCAN

ITEM_ROWS = "monitor string, target_id string, scan_id bigint, pos int, item string"


def history(seed: int, targets=4, n=25, words=12, hot=True):
    """Random item lists; the first target holds most scans, with gaps and repeats."""
    rng, out = random.Random(seed), {}
    for t in range(targets):
        count = n * 6 if hot and t == 0 else n
        for s in sorted(rng.sample(range(count * 5), count)):
            out[(f"t{t}", s)] = [f"w{rng.randrange(words)}" for _ in range(rng.randrange(0, 7))]
    return out


def item_frame(spark, hist):
    rows = [("m", t, s, i, x) for (t, s), items in hist.items() for i, x in enumerate(items)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, ITEM_ROWS)


def scan_frame(spark, hist):
    rows = [("m", t, s, "|".join(sorted(set(x)))) for (t, s), x in hist.items()]
    return spark.createDataFrame(rows, "monitor string, target_id string, scan_id bigint, fingerprint string")


def pairs(hist):
    for t in {t for t, _ in hist}:
        order = sorted(s for u, s in hist if u == t)
        yield from ((t, b, a) for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("bits, levels", [(17, 1), (3, 1), (2, 3), (4, 2), (1, 1)])
def test_previous_equals_lag(spark, bits, levels):
    hist = history(3)
    got = scans.with_previous(scan_frame(spark, hist), ["fingerprint"], bits=bits, levels=levels)
    found = {(r.target_id, r.scan_id): r.previous and (r.previous.scan_id, r.previous.fingerprint) for r in got.collect()}
    want = dict.fromkeys(hist)
    for t, s, prev in pairs(hist):
        want[(t, s)] = (prev, "|".join(sorted(set(hist[(t, prev)]))))
    assert found == want


@pytest.mark.parametrize("seed", range(3))
def test_history_diff_is_the_pairwise_difference(spark, seed):
    hist = history(seed)
    items = item_frame(spark, hist)
    got = diff.history_diff(items, scans.change_gate(scan_frame(spark, hist), [])).collect()
    found = {(r.target_id, r.scan_id, r.op, r.item, r.pos) for r in got}
    assert len(found) == len(got)
    want = set()
    for t, s, prev in pairs(hist):
        new, old = hist[(t, s)], set(hist[(t, prev)])
        want |= {(t, s, "added", x, new.index(x)) for x in set(new) - old}
        want |= {(t, s, "removed", x, None) for x in old - set(new)}
    assert found == want


def test_ordered_new_keeps_order_and_repeats(spark):
    hist = history(5)
    got = diff.ordered_new(item_frame(spark, hist), scans.change_gate(scan_frame(spark, hist))).collect()
    found = {}
    for r in sorted(got, key=lambda r: r.pos):
        found.setdefault((r.target_id, r.scan_id), []).append(r.item)
    want = {}
    for t, s, prev in pairs(hist):
        fresh = [x for x in hist[(t, s)] if x not in set(hist[(t, prev)])]
        if fresh:
            want[(t, s)] = fresh
    assert found == want


def test_snapshot_diff_agrees_with_history(spark):
    hist = {("t", 1): ["a", "b"], ("t", 2): ["b", "c"], ("u", 1): ["x"]}
    items = item_frame(spark, hist)
    got = diff.snapshot_diff(items.filter("scan_id = 1"), items.filter("scan_id = 2"))
    assert {(r.target_id, r.op, r.item) for r in got.collect()} == {("t", "added", "c"), ("t", "removed", "a"), ("u", "removed", "x")}


def test_set_marks_ignore_order_and_list_marks_do_not(spark, one):
    lists = [["a", "b", "a"], ["b", "a"], ["a", "b"], ["ab"], []]
    sets = one(scans.set_fingerprint, [(x,) for x in lists])
    assert sets[0] == sets[1] == sets[2] and len(set(sets)) == 3
    assert len(set(one(scans.list_fingerprint, [(x,) for x in lists]))) == 5
    rows = [("m", f"t{i}", 1, p, x) for i, v in enumerate(lists) for p, x in enumerate(v)]
    frame = spark.createDataFrame(rows, ITEM_ROWS)
    merged = {r.target_id: r.fingerprint for r in scans.merged_fingerprint(frame.select(*SCAN, "item").distinct()).collect()}
    assert merged["t0"] == merged["t1"] == merged["t2"] != merged["t3"]
    ordered = {r.target_id: r.fingerprint for r in scans.merged_fingerprint(frame, ordered=True).collect()}
    assert len(set(ordered.values())) == 4


def test_first_scan_and_equal_scans_never_change(spark):
    hist = {("t", 1): ["a"], ("t", 2): ["a"], ("u", 9): ["z"]}
    assert scans.change_gate(scan_frame(spark, hist)).count() == 0


def test_item_that_leaves_and_returns(spark):
    hist = {("t", 1): ["a", "k"], ("t", 2): ["k"], ("t", 5): ["a", "k"]}
    got = diff.history_diff(item_frame(spark, hist), scans.change_gate(scan_frame(spark, hist)))
    assert {(r.scan_id, r.op, r.item) for r in got.collect()} == {(2, "removed", "a"), (5, "added", "a")}
    seen = diff.first_seen(item_frame(spark, hist)).filter("item = 'a'").first()
    assert (seen.first_seen, seen.last_seen) == (1, 5)


def test_first_position_and_last_detail_survive(spark):
    rows = [("m", "t", 1, 0, "a", {"k": "x"}), ("m", "t", 1, 1, "b", None), ("m", "t", 1, 2, "a", {"k": "y"})]
    frame = spark.createDataFrame(rows, ITEM_ROWS + ", detail map<string,string>")
    got = {r.item: (r.pos, r.detail) for r in diff.dedupe_preserve_first(frame).collect()}
    assert got == {"a": (0, {"k": "y"}), "b": (1, None)}


@pytest.mark.parametrize("n, kept", [(99, 99), (100, 0), (101, 0)])
def test_magnitude_guard(spark, n, kept):
    rows = [("m", "t", 1, "removed", f"i{i}") for i in range(n)]
    frame = spark.createDataFrame(rows, "monitor string, target_id string, scan_id bigint, op string, item string")
    assert report.magnitude_guard(frame, "removed", 100).count() == kept


def test_top_rows_per_bucket(spark):
    rows = [("m", "t", 1, op, f"i{i:02}", b) for op in ("added", "removed") for b in ("x", "y") for i in range(9)]
    frame = spark.createDataFrame(rows, "monitor string, target_id string, scan_id bigint, op string, item string, bucket string")
    caps = {("added", "x"): 2, ("added", "y"): None, ("removed", "x"): 3, ("removed", "y"): 1}
    got = report.top_per_bucket(frame, caps).groupBy("op", "bucket").agg(F.count("*").alias("n"), F.max("item").alias("last"))
    assert {(r.op, r.bucket): (r.n, r.last) for r in got.collect()} == {
        ("added", "x"): (2, "i01"), ("added", "y"): (9, "i08"), ("removed", "x"): (3, "i02"), ("removed", "y"): (1, "i00"),
    }


def test_upsert_replaces_and_read_keeps_unknown_keys(spark):
    schema = "monitor string, target_id string, scan_id bigint, fingerprint string, scalar string"
    state = spark.createDataFrame([("m", "a", 1, "f1", "v1"), ("m", "b", 1, "g1", "w1")], schema)
    update = spark.createDataFrame([("m", "a", 2, "f2", "v2"), ("m", "c", 1, "h1", "x1")], schema)
    after = scans.baseline_upsert(state, update)
    assert {(r.target_id, r.scan_id, r.scalar) for r in after.collect()} == {("a", 2, "v2"), ("b", 1, "w1"), ("c", 1, "x1")}
    keys = spark.createDataFrame([("m", "a"), ("m", "z")], "monitor string, target_id string")
    assert {(r.target_id, r.fingerprint) for r in scans.baseline_read(keys, after).collect()} == {("a", "f2"), ("z", None)}


def test_sources_by_success_and_by_configuration(spark):
    from conftest import make_captures, make_targets

    rows = [
        {"target_id": t, "scan_id": 1, "role": r, "status": s, "body": r}
        for t, r, s in (("a", "p", 200), ("a", "f", 200), ("b", "p", 500), ("b", "f", 200), ("c", "p", 404), ("c", "f", 500), ("d", "f", 204))
    ]
    chosen = scans.pick_by_success(make_captures(spark, rows), ("p", "f"))
    assert {(r.target_id, r.role) for r in chosen.collect()} == {("a", "p"), ("b", "f"), ("d", "f")}
    targets = make_targets(spark, [{"target_id": "a", "attrs": {"f": "x", "p": "y"}}, {"target_id": "b", "attrs": {"p": "x"}}, {"target_id": "d", "attrs": {}}])
    chosen = scans.pick_by_configuration(make_captures(spark, rows), targets, ("f", "p"))
    assert {(r.target_id, r.role, r.status) for r in chosen.collect()} == {("a", "f", 200), ("b", "p", 500)}
