"""Repaired conversations against exhaustive search and a program on whole strings."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from snapdrift.llm import conversations as C

FORM = re.compile(r"(s?(ua)+)?")
SYMBOLS = "suaoSUAOx"


def every_edit(symbols):
    """The cheapest and then least audit, found by trying all edits."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    choices = [["D"] if c == "x" else ["K", "Ru", "Ra", "D"] for c in symbols]
    for edits in itertools.product(*choices):
        for inserted in itertools.product(gaps, repeat=len(symbols) + 1):
            cost, audit, form = 5 * len(inserted[0]), "I" * len(inserted[0]), inserted[0]
            for symbol, edit, more in zip(symbols, edits, inserted[1:]):
                cost += {"K": 0, "R": 1, "D": 2}[edit[0]] + (5 if symbol.isupper() and edit != "D" else 0) + 5 * len(more)
                audit += edit[0] + "I" * len(more)
                form += {"K": symbol.lower(), "R": edit[1:], "D": ""}[edit[0]] + more
            if FORM.fullmatch(form) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def on_strings(symbols):
    """The same from left to right with whole strings."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def more(now):
        for _ in range(3):
            for s, (cost, audit) in list(now.items()):
                to = "a" if s == "u" else "u"
                now[to] = min(now.get(to, (10**9, "")), (cost + 5, audit + "I"))
        return now

    now = more({"": (0, "")})
    for c in symbols:
        new = {}
        for s, (cost, audit) in now.items():
            offers = [(s, cost + 2, "D")]
            if c != "x":
                p = 5 if c.isupper() else 0
                offers += [(step[s, c.lower()], cost + p, "K")] if (s, c.lower()) in step else []
                offers.append(("a" if s == "u" else "u", cost + p + 1, "R"))
            for to, total, edit in offers:
                new[to] = min(new.get(to, (10**9, "")), (total, audit + edit))
        now = more(new)
    return min(now[s] for s in ("", "a") if s in now)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_all_short_ones(n):
    for symbols in map("".join, itertools.product(SYMBOLS, repeat=n)):
        assert C.best_of(C.cheapest(symbols)) == every_edit(symbols) == on_strings(symbols), symbols


def test_some_of_three():
    for symbols in random.Random(1).sample(["".join(x) for x in itertools.product(SYMBOLS, repeat=3)], 40):
        assert C.best_of(C.cheapest(symbols)) == every_edit(symbols), symbols


@pytest.mark.parametrize("modulus", [1, 3, (1 << 61) - 1])
def test_long_ones_and_colliding_hashes(modulus):
    rng = random.Random(2)
    for n in [4, 7, 20, 100, 400]:
        for weights in ([5, 20, 20, 1, 1, 1, 1, 1, 1], [1] * 9, [0, 9, 1, 0, 0, 3, 0, 0, 0], [0, 1, 0, 0, 0, 0, 0, 0, 0]):
            symbols = "".join(rng.choices(SYMBOLS, weights, k=n))
            assert C.best_of(C.cheapest(symbols, modulus=modulus)) == on_strings(symbols), symbols


def test_ancestors_and_order():
    rng = random.Random(3)
    audits = C.Audits(modulus=5)
    nodes = [0]
    for _ in range(600):
        nodes.append(audits.add(rng.choice(nodes[-40:]), rng.choice("DIKR")))
    for _ in range(2000):
        a, b, x, y = rng.choice(nodes), rng.choice(nodes), rng.choice("DIKR"), rng.choice("DIKR")
        assert audits.less(a, x, b, y) == (audits.text(a) + x < audits.text(b) + y)
        d = rng.randint(0, audits.depth[a])
        assert audits.text(audits.ancestor(a, d)) == audits.text(a)[:d]


def test_blocks_put_together():
    rng = random.Random(4)
    for _ in range(150):
        symbols = "".join(rng.choices(SYMBOLS, k=rng.randint(1, 40)))
        chain, at = C._Chain(), 0
        while at < len(symbols):
            part = symbols[at : at + rng.randint(1, 9)]
            ends = [{"state": s, "to": t, "cost": c, "audit": a} for s in range(4) for t, (c, a) in C.cheapest(part, s, whole=False).items()]
            chain.add({"part": 0, "seq": at, **dict.fromkeys(C.COUNTS, 0), "min_turn": None, "max_turn": None, "head": "u", "tail": "a", "ends": ends})
            at += len(part)
        *pieces, whole = chain.rows()
        assert (whole["cost"], whole["audit"]) == on_strings(symbols)
        assert "".join(p["piece"] for p in pieces) == whole["audit"]


def repaired_rows(audit, rows):
    out, state = [], ""
    rest = iter(rows)
    for e in audit:
        if e == "I":
            out.append(("assistant" if state == "u" else "user", ""))
        else:
            role, text = next(rest)
            if e != "D":
                out.append((role if e == "K" else "assistant" if state == "u" else "user", text))
        state = out[-1][0][:1] if out else ""
    return out


def plain(rows):
    """Damage and repair in plain Python."""
    out, ids = {}, {r[0] for r in rows}
    for conv in ids:
        left = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            word = lambda v: " " if v is None else str(v)
            kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
            role, text = word(role), word(text)
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, symbols, faults = set(), "", {"b": 0, "d": 0, "t": 0}
        for _, role, text in left:
            end = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            c = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault in ("b", "d") else c.upper() if fault == "t" else c
        turns = {t for t, _, _ in left if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(left))
        cost, audit = on_strings(symbols)
        lines = "\n".join(f"{r}:{t}" for r, t in repaired_rows(audit, [x[1:] for x in left]))
        out[conv] = (gaps, faults["b"], faults["d"], faults["t"], illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    texts = ["Hi.", "Fine!", "no end", "", " \t", None, "wait?", "é. ", "x" * 3000 + ".", "line\none.", "...", "a\x85"]
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "User", "agent", "|"]
    out = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 9)):
            out.append((conv, rng.choice([turn, turn, turn, turn, None]), rng.choice(roles[1:3] if rng.random() < 0.7 else roles), rng.choice(texts)))
    out += [(1000, t, "user" if t % 2 == 0 else "assistant", f"{t % 90}.") for t in range(700)]  # far longer than a block
    out += [(1001, 5, "user", "hot.")] * 120 + [(1002, t, "user", "same.") for t in range(150)]
    out += [(1003, t, rng.choice(roles), rng.choice(texts)) for t in rng.sample(range(-(2**40), 2**40), 90)]
    dropped = next(i for i in range(2000, 3000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*out, (dropped, 0, "user", "gone.")]


@pytest.mark.parametrize("block_rows", [4, 1 << 15])
def test_whole_tables(spark, rows, block_rows, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_CHARS", 20_000)
    schema = "conv_id long, turn long, role string, text string, copies string, part string, first string, c string"
    frame = spark.createDataFrame([(*r, "c", "p", "f", "x") for r in rows], schema).repartition(7)
    monkeypatch.setattr(C.repair, "__defaults__", (block_rows,))
    got = C.audit_damaged(frame).collect()
    want = plain(rows)
    assert len(got) == len(want)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want


def test_undamaged_and_empty(spark):
    schema = "conv_id string, turn int, role string, text string"
    frame = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Yes."), ("b", 1, "assistant", "Lost.")], schema)
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in C.repair(C.undamaged(frame)).collect()}
    assert got == {"a": (0, "KK"), "b": (2, "D")}
    assert C.audit_damaged(frame.where("false")).count() == 0
    assert C.audit_damaged(frame.where("turn > 1")).schema["conv_id"].dataType.simpleString() == "string"
