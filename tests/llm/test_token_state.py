"""Kept trees: a second batch of edits encodes what it touches, and counts stay those of whole texts."""

from __future__ import annotations

import os
import random

import pytest

from snapdrift.llm import token_edits as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.RANKS), reason="no vocabulary")
EDITS = "doc_id long, seq long, start long, stop long, text string"


def test_kept_trees(spark, tmp_path):
    with open(T.RANKS, "rb") as file:
        counter = T.Counter(file.read())
    rng = random.Random(7)
    texts = {i: " ".join(rng.choice(["word", "don't", "  ", "42", "été", "\n", "!?"]) + rng.choice("abc") for _ in range(rng.choice([0, 5, 300, 4000]))) for i in range(40)}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(99, None, "x")], "doc_id long, text string, counts string")
    texts[99] = ""
    T.token_state(docs).write.parquet(f"{tmp_path}/state-0")
    for batch in range(3):
        state = spark.read.parquet(f"{tmp_path}/state-{batch}")
        edits, touched = [], set()
        for _ in range(25):
            i = rng.choice(list(texts) + [12345])
            n = len(texts.get(i, ""))
            start = rng.randint(0, n)
            edits.append((i, len(edits), start, min(n, start + rng.choice([0, 1, 9])), rng.choice(["", "x", " new words", "'s", "\n\n"])))
        edits.append((None, 1, 0, 1, "z"))
        for i, _, start, stop, new in edits:
            if i in texts:
                texts[i] = texts[i][:start] + new + texts[i][stop:]
                touched.add(i)
        changed = T.apply_edits(state, spark.createDataFrame(edits, EDITS))
        T.updated(state, changed).write.parquet(f"{tmp_path}/state-{batch + 1}")
        now = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/state-{batch + 1}").collect()}
        assert {i: r["text"] for i, r in now.items()} == texts
        assert all(now[i]["n_tokens"] == len(counter.encoding.encode_ordinary(t)) for i, t in texts.items())
        again = {r["doc_id"]: r["n_reencoded"] for r in changed.collect()}
        assert set(again) == touched
        for i in touched:  # a few pre-tokens an edit, however long the text
            assert again[i] <= 12 * sum(e[0] == i for e in edits)
    assert T.apply_edits(state, spark.createDataFrame([], EDITS)).count() == 0
