"""Collocations against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from snapdrift.llm import collocations as C

DOCS = "doc_id long, text string, lang string, gram string, f string, share string, n string, prefix string"


def plain(rows, least, longest=5, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for g, a in f.items():
            if len(g) < 2 or a < least:
                continue
            inside = (q for q in f if len(q) > len(g) and 100 * f[q] >= 100 * a)
            if any(q[i : i + len(g)] == g for q in inside for i in range(len(q) - len(g) + 1)):
                continue
            cuts = [(1000 * a * totals[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["the", "of", "York", "new", "É", "é", "a", "b", "c-d", "straße", "x\x85y", "1", "日本", "a\x0bb"]
    out = []
    for _ in range(150):
        w = [rng.choice(words) if rng.random() < 0.8 else f"w{rng.randrange(200)}" for _ in range(rng.randint(0, 60))]
        out.append((rng.choice([" ", "  ", "\t", " "]).join(w).replace("b", rng.choice(["b", "b.", "b\n", ", b"])), rng.choice(["en", "de", None, "und"])))
    out += [("New York City is big. New York City", "en")] * 30 + [("a a a a a a a", "de")] * 9 + [("San Francisco", "xx")] * 4
    return [*out, (None, "en"), ("", None), (" \t\n.", "yy"), ("one", "zz"), ("tail of a very long piece " * 900, "en"), ("q " * 30_000, "long")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "g", "f", "s", "n", "p") for i, (t, lang) in enumerate(rows)], DOCS)


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_counting(spark, rows, monkeypatch, small):
    if small:  # many slices, flushes and shares
        monkeypatch.setattr(C, "SLICE", 300)
        monkeypatch.setattr(C, "BUFFER", 500)
        monkeypatch.setattr(C, "SHARE", 50)
        monkeypatch.setattr(C, "WORD_SHARES", 3)
        monkeypatch.setattr(C, "BUCKETS", 5)
        monkeypatch.setattr(C, "BUCKET_WORDS", 1 << 12)
    got = C.collocations(frame(spark, rows).repartition(5), least=4).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 4)


def test_first_ones(spark, rows):
    got = C.collocations(frame(spark, rows), least=6, longest=3, top=5).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 6, 3, 5)


def test_nothing_to_count(spark, rows):
    assert C.collocations(frame(spark, [])).count() == 0
    assert C.collocations(frame(spark, rows[:3]), least=10**6).count() == 0


def test_filter_has_no_misses(spark):
    keys = np.random.default_rng(1).integers(0, 1 << 63, (500, 2), dtype=np.uint64)
    grams = spark.createDataFrame([(f"l{i % 3}", bytearray(k.tobytes())) for i, k in enumerate(keys)], "lang string, gram binary")
    bits = C.gram_filter(grams, 2)
    for i, k in enumerate(keys):
        assert C._in_filter(bits, C.window_hashes(k, 2), C._salt(f"l{i % 3}")).all()
    other = C._in_filter(bits, C.window_hashes(np.random.default_rng(2).integers(0, 1 << 63, 4000, dtype=np.uint64), 2), C._salt("l0"))
    assert other.sum() < 4


def test_shared_hashes_are_noticed():
    packed = np.array([7, 8], np.uint64).tobytes()
    counts = np.array([1, 1], np.int64).tobytes()
    checks = [np.array(c, np.uint64).tobytes() for c in ([1, 2], [1, 3])]
    merger = C._Merger(1)
    key = ("en", b"", 0)
    assert merger.add([key], [packed], [counts], checks[:1], [["a", "b"]], last=False) == []
    with pytest.raises(RuntimeError):
        merger.add([key], [packed], [counts], checks[1:], [["a", "c"]], last=True)
