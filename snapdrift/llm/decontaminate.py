"""Benchmark decontamination by BM25 over test items with block-max pruning.

The inverted index holds the test items; passages of training texts are the
queries. Items are laid out in blocks, and each term keeps its largest impact
in each block. A passage's sum of those is a bound on its score for any item
of the block, so blocks below threshold are skipped, for all passages of a text
at once; items of the others are scored exactly, and those above threshold are
verified by word overlap of question and answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdrift.llm.common import small_batches, texts_of
from snapdrift.llm.words import U, shingles, word_hashes

K1, B = 1.2, 0.75
SHARE = 0.6  # of an item's score against itself that a passage must reach
OVERLAP = 0.8
SHINGLE = 5
PASSAGE = 64  # words in half a passage, at least; more if an item is longer
ITEM_BLOCK = 4
SHARD_POSTINGS = 500_000  # an index above this is split, and each part broadcast by itself
_MARKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normal_words(text: str | bytes | None) -> np.ndarray:
    """Hashes of the words of a text in lower case, ASCII punctuation as white space."""
    text = text.decode() if isinstance(text, bytes) else text or ""
    return word_hashes(text.lower().encode().translate(_MARKS))


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's answer is its last sentence or line, its question what precedes; an item of one sentence is both."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if re.search(r"\w", p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


@dataclass(frozen=True)
class Index:
    """Items of one shard. ``impacts`` is term x item, in items' blocks; ``bounds`` term x block."""

    item_ids: list[int]
    terms: np.ndarray
    impacts: np.ndarray
    bounds: np.ndarray
    least: np.ndarray
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    words: list[np.ndarray]
    question_words: list[np.ndarray]
    answer_words: list[np.ndarray]
    half: int


def build(items: list[tuple[int, str, str | None, str | None]], frequency: dict[int, int], n: int, mean: float, half: int, share: float) -> Index:
    """The index of a shard from its ``(id, text, question, answer)`` and statistics over all items."""
    items = sorted(items, key=lambda item: len(normal_words(item[1])))  # items of a block so have like thresholds
    words = [normal_words(text) for _, text, _, _ in items]
    terms = np.unique(np.concatenate(words))
    idf = np.array([np.log1p((n - frequency[int(t)] + 0.5) / (frequency[int(t)] + 0.5)) for t in terms.astype(np.int64)])
    blocks = -(-len(items) // ITEM_BLOCK)
    impacts = np.zeros((len(terms), blocks * ITEM_BLOCK), np.float32)
    for i, w in enumerate(words):
        t, tf = np.unique(w, return_counts=True)
        at = np.searchsorted(terms, t)
        impacts[at, i] = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
    least = np.full(blocks * ITEM_BLOCK, np.inf, np.float32)
    least[: len(items)] = share * impacts.sum(axis=0)[: len(items)]
    parts = [(q, a) if q is not None and a is not None else question_and_answer(text) for _, text, q, a in items]
    sides = [[normal_words(x) for x in side] for side in zip(*parts)]
    sets = [[shingles(x, SHINGLE) for x in side] for side in sides]
    bounds = impacts.reshape(len(terms), blocks, ITEM_BLOCK).max(axis=2)
    return Index([i[0] for i in items], terms, impacts, bounds, least, *sets, words, *sides, half)


def search(words: np.ndarray, index: Index) -> list[tuple[int, int, int, float]]:
    """``(item, start, stop, score)`` of each passage of a text and item at or above the item's threshold.

    A passage is two halves of ``index.half`` words, and each half starts one.
    """
    at = np.searchsorted(index.terms, words)
    at[at == len(index.terms)] = 0
    place = np.flatnonzero(index.terms[at] == words)
    if not len(place):
        return []
    halves = -(-len(words) // index.half)
    half, last = place // index.half, max(1, halves - 1)
    key = np.concatenate([half[half < last] * len(index.terms) + at[place[half < last]], (half[half > 0] - 1) * len(index.terms) + at[place[half > 0]]])
    passage, term = np.divmod(np.unique(key), len(index.terms))
    edges = np.flatnonzero(np.diff(passage, prepend=-1))
    bound = np.add.reduceat(index.bounds[term], edges, axis=0)
    least = index.least.reshape(-1, ITEM_BLOCK).min(axis=1)
    rows, blocks = np.nonzero(bound >= least * (1 - 1e-4))
    edges = np.append(edges, len(term))
    found = []
    for row, b in zip(rows.tolist(), blocks.tolist()):
        score = index.impacts[term[edges[row] : edges[row + 1]], b * ITEM_BLOCK : (b + 1) * ITEM_BLOCK].sum(axis=0)
        start = int(passage[edges[row]]) * index.half
        for i in np.flatnonzero(score >= index.least[b * ITEM_BLOCK : (b + 1) * ITEM_BLOCK]):
            found.append((b * ITEM_BLOCK + int(i), start, min(start + 2 * index.half, len(words)), float(score[i])))
    return found


def edits_to(part: np.ndarray, words: np.ndarray) -> np.ndarray:
    """By end position, the fewest word edits (put in, left out or replaced) that turn some run of ``words`` into ``part``."""
    steps = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for i, word in enumerate(part.tolist(), 1):
        near = np.empty_like(row)
        near[0] = i
        near[1:] = np.minimum(row[:-1] + (words != word), row[1:] + 1)
        row = np.minimum.accumulate(near - steps) + steps
    return row


def _edited_copy(near: np.ndarray, item: int, index: Index, overlap: float) -> tuple[float, float, float, float]:
    """Shares of question and answer that the text holds in order: anywhere, and in an edited copy of the whole item.

    A copy has at most ``1 - overlap`` of the item's words edited, and in it
    either part no more than that share of its own or, from two words on, one
    word. Without such a copy the last two shares are zero.
    """
    whole, parts = index.words[item], (index.question_words[item], index.answer_words[item])
    slack = int((1 - overlap) * len(whole) + 1e-9)
    rows = [edits_to(part, near) for part in parts]
    apart = [1 - int(row.min()) / len(part) if len(part) else 1.0 for row, part in zip(rows, parts)]
    allowed = [max(int((1 - overlap) * len(part) + 1e-9), int(len(part) > 1)) for part in parts]
    for end in np.flatnonzero(edits_to(whole, near) <= slack).tolist():
        around = slice(max(0, end - len(whole) - slack), end + slack + 1)
        fewest = [int(row[around].min()) for row in rows]
        if fewest[0] <= allowed[0] and fewest[1] <= allowed[1]:
            return *apart, *(1 - f / len(part) if len(part) else 1.0 for f, part in zip(fewest, parts))
    return *apart, 0.0, 0.0


def verified(words: np.ndarray, found: list[tuple[int, int, int, float]], index: Index, overlap: float) -> dict[int, tuple[float, float, float]]:
    """``item: (score, question overlap, answer overlap)`` of the items whose both parts the text around a hit holds.

    A part is held by its shingles or by its words in order; a copy of the whole
    item with few words edited is held too, though an edit takes up to
    ``SHINGLE`` shingles of a short part.
    """
    out: dict[int, tuple[float, float, float]] = {}
    for item, start, stop, score in found:
        if score <= out.get(item, (-1.0,))[0]:
            continue
        near = words[max(0, start - 2 * index.half) : stop + 2 * index.half]
        shares = []
        for part in (index.questions[item], index.answers[item]):
            held = part
            for k in range(SHINGLE, 0, -1):  # a short part is one shingle of its own length
                own = shingles(near, k) if k == SHINGLE else shingles(near, k) + U(k)
                held = np.setdiff1d(held, own, assume_unique=True)
                if k == SHINGLE and len(part) > 1:
                    break
            shares.append(1 - len(held) / len(part) if len(part) else 1.0)
        good = min(shares) >= overlap
        if not good:
            *apart, question, answer = _edited_copy(near, item, index, overlap)
            shares = [max(pair) for pair in zip(shares, apart)]
            good = min(shares) >= overlap
            if not good and min(question, answer) > 0:
                shares, good = [max(pair) for pair in zip(shares, (question, answer))], True
        if good:
            out[item] = score, *shares
    return out


def shards(items: DataFrame, share: float = SHARE, postings: int = SHARD_POSTINGS) -> Iterator[Index]:
    """Indexes of ``items (item_id, text[, question, answer])``, in parts that are read to the driver one by one.

    Statistics are over all items. Items without words are left out.
    """
    sides = [F.col(c).cast("string") if {"question", "answer"} <= set(items.columns) else F.lit(None).cast("string") for c in ("question", "answer")]
    plain = items.where("text is not null and item_id is not null").select("item_id", F.col("text").cast("string"), sides[0].alias("q"), sides[1].alias("a")).distinct()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [normal_words(t).astype(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64()))], ["item_id", "words"])

    words = plain.select("item_id", "text").mapInArrow(counted, "item_id long, words array<long>").where(F.size("words") > 0)
    stats = words.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"), F.max(F.size("words")).alias("longest"), F.sum(F.size(F.array_distinct("words"))).alias("postings")).first()
    if not stats["n"]:
        return
    parts = -(-stats["postings"] // postings)
    frequency = words.select(F.explode(F.array_distinct("words")).alias("t"), "item_id").groupBy("t").agg(F.count("*").alias("df"))
    half = max(PASSAGE, stats["longest"])
    for part in range(parts):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part
        own = [tuple(r) for r in plain.where(mine).orderBy("item_id", "text").collect() if len(normal_words(r["text"]))]
        if own:
            used = words.where(mine).select(F.explode("words").alias("t")).distinct()
            df = {r["t"]: r["df"] for r in frequency.join(used, "t", "left_semi").collect()}
            yield build(own, df, stats["n"], float(stats["mean"]), half, share)


def contamination(docs: DataFrame, items: DataFrame, share: float = SHARE, overlap: float = OVERLAP) -> DataFrame:
    """``doc_id, n_candidates, items`` for each row of ``docs (doc_id, text)``.

    ``n_candidates`` counts items that some passage scores at or above ``share``
    of their score against themselves; ``items`` lists ``(item_id, score,
    question, answer)`` of those of which the text around the passage also holds
    ``overlap`` of the question and of the answer, by five-word shingles or words
    in order, or a copy of the whole with at most ``1 - overlap`` of its words
    edited (see ``verified``), by id. All passages of whole texts are queries. Null and empty texts have
    none, repeated rows their own result, null ids are kept. No items leave
    every list empty; an index above ``SHARD_POSTINGS`` takes a pass over the
    texts for each of its parts.
    """
    small_batches(docs.sparkSession)
    texts = texts_of(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    hit = "struct<item_id: long, score: double, question: double, answer: double>"
    schema = f"doc_id {kind}, text string, n_candidates long, items array<{hit}>"
    out = texts.select("doc_id", "text", F.lit(0).cast("long").alias("n_candidates"), F.expr(f"cast(array() as array<{hit}>)").alias("items"))
    for index in shards(items, share):
        out = out.mapInArrow(_searcher(index, overlap), schema)
    return out.select("doc_id", "n_candidates", F.array_sort("items").alias("items"))


def _searcher(index: Index, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, lists = [], []
            before = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for data, (count, hits) in zip(batch.column(1).cast(pa.binary()).to_pylist(), before):
                words = normal_words(data)
                found = search(words, index) if len(words) else []
                good = verified(words, found, index, overlap) if found else {}
                counts.append(count + len({f[0] for f in found}))
                lists.append(hits + [{"item_id": index.item_ids[i], "score": s, "question": q, "answer": a} for i, (s, q, a) in good.items()])
            arrays = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(lists, batch.schema.field(3).type)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "n_candidates", "items"])

    return run


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item's question and answer, columns as they were; null ids stay."""
    found = contamination(docs, items).where(F.size("items") > 0).select("doc_id").distinct()
    return docs.join(found, docs["doc_id"] == found["doc_id"], "left_anti")
