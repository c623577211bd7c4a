"""Repeated passages by fixed-block anchors.

A repeat of ``window`` words holds a whole block of ``(window + 1) // 2`` words
that starts at a multiple of that length, in either of its places. So the
blocks of every text that do not overlap are indexed, every rolling window of
block length is probed, and hits are extended: each window around a hit is
looked up again by its full length, and runs of those confirmed are the
maximal repeats.

Texts are dealt into chunks by hash. A chunk sends each bucket of hashes its
distinct values once, packed, and gets back those that occur elsewhere, so a
passage in a third of all texts costs a bucket one value per chunk.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdrift.llm.common import small_batches, texts_of
from snapdrift.llm.words import U, window_hashes, word_hashes

CHUNKS_PER_PARTITION = 2
BUCKETS_PER_PARTITION = 1
_PACKED = "bucket int, chunk int, once binary, often binary, probes binary"
_REPLY = "chunk int, bucket int, found binary"


def _texts(table: pa.Table) -> list[bytes]:
    return table.column("text").cast(pa.binary()).to_pylist()


def _table(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.values())], names=list(schema))


def _packed(chunk: int, once: np.ndarray, often: np.ndarray, probes: np.ndarray, buckets: int, kind: type) -> pa.Table:
    """One row a bucket; values are distinct, and packed in ``kind`` once the bucket is known."""
    parts = []
    for values in (once, often, probes):
        bucket = ((values >> U(32)) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        values = values[order].astype(kind)
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        parts.append([values[edges[i] : edges[i + 1]].tobytes() for i in range(buckets)])
    rows = [(i, chunk, a, b, c) for i, (a, b, c) in enumerate(zip(*parts)) if a or b or c]
    return _table({"bucket": pa.int32(), "chunk": pa.int32(), "once": pa.binary(), "often": pa.binary(), "probes": pa.binary()}, rows)


def _distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values that occur once in a chunk, and those that occur more often."""
    values, count = np.unique(np.concatenate(parts) if parts else np.empty(0, U), return_counts=True)
    return values[count == 1], values[count > 1]


def _answer(kind: type):
    """For each chunk of a bucket, the values that occur in another place as well."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        read = [[np.frombuffer(x, kind) for x in rows[name]] for name in ("once", "often", "probes")]
        index, chunks = np.unique(np.concatenate([*read[0], *read[1]]), return_counts=True)
        again = np.union1d(index[chunks > 1], np.concatenate(read[1]))
        found = []
        for bucket, chunk, once, often, probes in zip(rows["bucket"], rows["chunk"], *read):
            hits = np.concatenate([once[_isin(once, again)], often, probes[_isin(probes, index)]])
            if len(hits):
                found.append((chunk, bucket, np.unique(hits).tobytes()))
        return _table({"chunk": pa.int32(), "bucket": pa.int32(), "found": pa.binary()}, found)

    return run


def _isin(values: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted index."""
    if not len(index):
        return np.zeros(len(values), bool)
    at = np.searchsorted(index, values)
    at[at == len(index)] = 0
    return index[at] == values


def _marked(block: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and packed value of block hashes, as replies tell them."""
    return (((block >> U(32)) % U(buckets)) << U(32)) | (block & U(0xFFFFFFFF))


def repeated_passages(docs: DataFrame, window: int = 35) -> DataFrame:
    """``doc_id, n_words, spans, kept_text`` for each row of ``docs (doc_id, text)``.

    Words are maximal runs of other than white space, unchanged. ``spans`` are
    the ranges of words, end exclusive, covered by windows of ``window`` words
    whose sequence also starts anywhere else, in the same text or another;
    ``kept_text`` joins the other words by one space. Every copy is removed,
    the first too. Sequences are equal if their 64-bit hashes are. A null text
    has no words; texts below ``window`` words are kept whole; repeated rows
    repeat each other's windows; null ids are allowed. No rows give no rows.
    """
    spark, block = docs.sparkSession, (window + 1) // 2
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks, buckets = parts * CHUNKS_PER_PARTITION, parts * BUCKETS_PER_PARTITION
    dealt = texts_of(docs).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    dealt = dealt.select("chunk", "doc_id", "text").repartition(parts, "chunk")
    id_type = docs.schema["doc_id"].dataType

    def probe(table: pa.Table) -> pa.Table:
        fixed, moving = [], []
        for data in _texts(table):
            values = window_hashes(word_hashes(data), block)
            aligned = np.zeros(len(values), bool)
            aligned[::block] = True
            fixed.append(values[aligned])
            moving.append(values[~aligned])
        chunk = table.column("chunk")[0].as_py()
        return _packed(chunk, *_distinct(fixed), np.unique(np.concatenate(moving)), buckets, np.uint32)

    def extend(table: pa.Table, replies: pa.Table) -> pa.Table:
        found = [
            (U(bucket) << U(32)) | np.frombuffer(x, np.uint32).astype(U)
            for bucket, x in zip(replies.column("bucket").to_pylist(), replies.column("found").to_pylist())
        ]
        anchors, wide = np.unique(np.concatenate(found)) if found else np.empty(0, U), []
        for data in _texts(table) if found else []:
            words = word_hashes(data)
            if len(words) < window:
                continue
            hits = np.concatenate([[0], np.cumsum(_isin(_marked(window_hashes(words, block), buckets), anchors))])
            n, reach = len(words) - window + 1, window - block + 1
            near = hits[reach : reach + n] > hits[:n]
            if near.any():
                wide.append(window_hashes(words, window)[near])
        chunk = table.column("chunk")[0].as_py() if len(table) else 0
        return _packed(chunk, *_distinct(wide), np.empty(0, U), buckets, U)

    def keep(table: pa.Table, replies: pa.Table) -> pa.Table:
        found = [np.frombuffer(x, U) for x in replies.column("found").to_pylist()]
        repeats = np.unique(np.concatenate(found)) if found else np.empty(0, U)
        n_words, spans, kept = [], [], []
        for data in _texts(table):
            words, own = data.split(), []
            if found and len(words) >= window:
                starts = np.flatnonzero(_isin(window_hashes(word_hashes(data), window), repeats))
                if len(starts):
                    breaks = np.flatnonzero(np.diff(starts) > window)
                    first = starts[np.concatenate([[0], breaks + 1])]
                    last = starts[np.concatenate([breaks, [len(starts) - 1]])] + window
                    own = list(zip(first.tolist(), last.tolist()))
            n_words.append(len(words))
            spans.append([{"start": a, "end": b} for a, b in own])
            if own:
                stay = np.ones(len(words), bool)
                for a, b in own:
                    stay[a:b] = False
                words = compress(words, stay)
            kept.append(b" ".join(words).decode())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([table.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())], names=["doc_id", "n_words", "spans", "kept_text"])

    def reply(packed: DataFrame, kind: type) -> DataFrame:
        return packed.groupBy("bucket").applyInArrow(_answer(kind), _REPLY)

    anchors = reply(dealt.groupBy("chunk").applyInArrow(probe, _PACKED), np.uint32)
    wide = dealt.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(extend, _PACKED)
    out = f"doc_id {id_type.simpleString()}, n_words long, spans array<struct<start: long, end: long>>, kept_text string"
    return dealt.groupBy("chunk").cogroup(reply(wide, U).groupBy("chunk")).applyInArrow(keep, out)
