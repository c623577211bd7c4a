"""Near duplicates by MinHash with tensored banding.

Two small collections of ``m`` hashes, each of two minima, are computed per
text; a table key is a pair with one hash of each. ``4 m`` minima so serve
``m * m`` tables. Texts that share a key meet in the group of the key's
smallest id, where the similarity of full shingle sets is computed exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdrift.llm.common import components, small_batches, staged, texts_of
from snapdrift.llm.words import LOWER, U, mix, shingles, word_hashes

HASHES = 9  # of each collection; a pair of similarity 0.8 shares no key once in 5,000 times
BLOCK_SHINGLES = 400_000
BLOCK_DOCS = 1_024
_rng = np.random.default_rng(17)
_MUL = (_rng.integers(1, 1 << 63, (4 * 64, 1), dtype=U) * U(2)) + U(1)
_ADD = _rng.integers(0, 1 << 63, (4 * 64, 1), dtype=U)


def shingle_set(data: bytes | None, k: int) -> np.ndarray:
    return shingles(word_hashes((data or b"").translate(LOWER)), k)


def sketch(values: np.ndarray, hashes: int) -> np.ndarray:
    """``2 * hashes`` hashes of two minima each: the first half is one collection, the second the other."""
    n = 4 * hashes
    least = np.full(n, ~U(0), U)
    for at in range(0, len(values), 4096):
        part = values[at : at + 4096]
        np.minimum(least, (part[None, :] * _MUL[:n] + _ADD[:n]).min(axis=1), out=least)
    return mix(least[0::2] * U(0x9E3779B97F4A7C15) + mix(least[1::2]) + np.arange(2 * hashes, dtype=U))


def signatures(docs: DataFrame, k: int = 4, hashes: int = HASHES) -> DataFrame:
    """``doc_id, n_shingles, digest, u, v`` of each row; a digest stands for one shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, u, v = [], [], [], []
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                values = shingle_set(data, k)
                n.append(len(values))
                if not len(values):
                    digest.append(None), u.append(None), v.append(None)
                    continue
                digest.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                s = sketch(values, hashes).astype(np.int64)
                u.append(s[:hashes])
                v.append(s[hashes:])
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(u, many), pa.array(v, many)],
                ["doc_id", "n_shingles", "digest", "u", "v"],
            )

    schema = "doc_id long, n_shingles long, digest binary, u array<long>, v array<long>"
    return texts_of(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id`` and its sorted set, eight bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(data, k).tobytes() for data in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles binary")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as products of 0/1 matrices over shingles that occur twice."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    rank = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], rank[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out, width = np.zeros((n, n), np.float32), 4096
    for at in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(column, [at, at + width])
        block = np.zeros((n, width), np.float32)
        block[owner[i:j], column[i:j] - at] = 1
        out += block @ block.T
    return out.astype(np.int64)


def local_links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links ``100 * intersection >= percent * union`` of a group, as few edges as keep what they connect."""
    common = intersections(sets)
    sizes = np.array([len(s) for s in sets])
    union = sizes[:, None] + sizes[None, :] - common
    linked = (100 * common >= percent * union) & (sizes[:, None] > 0)
    root = np.arange(len(ids))
    edges = []
    for i in range(len(ids)):
        for j in np.flatnonzero(linked[i, :i] & (root[:i] != root[i])):
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                edges.append((int(ids[i]), int(ids[j])))
    return edges


def _verified(members: DataFrame, percent: int) -> DataFrame:
    """Edges of groups ``(pivot, a, b)``; a group arrives as consecutive rows of one partition."""

    def flush(ids: list[int], raw: list[bytes]) -> list[tuple[int, int]]:
        return local_links(np.array(ids), [np.frombuffer(x, U) for x in raw], percent) if len(ids) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, raw = None, [], []

        def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            edges = []
            for pivot, a, b, doc, shingle in zip(*columns):
                if (pivot, a, b) != key:
                    edges += flush(ids, raw)
                    key, ids, raw = (pivot, a, b), [], []
                ids.append(doc)
                raw.append(shingle)
            yield out(edges)
        yield out(flush(ids, raw))

    by = ["pivot", "a", "b"]
    dealt = members.select(*by, "doc_id", "shingles").repartition(*by).sortWithinPartitions(*by)
    return dealt.mapInArrow(run, "a long, b long")


def links(docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges ``(a, b)`` between representatives, enough to connect all that share a key and are similar.

    A pair of hashes is a key only if either hash occurs in another text, so
    most texts have no key at all. All rows of a key lie in the group of its smallest id. A group above
    ``BLOCK_SHINGLES`` or ``BLOCK_DOCS`` is dealt into blocks and each pair of
    blocks compared by itself, so tasks stay bounded and no pair is skipped.
    """
    sides = F.expr("explode(concat(transform(u, x -> struct(0 as side, x as hash)), transform(v, x -> struct(1 as side, x as hash))))")
    hashes = reps.select("doc_id", sides.alias("s")).select("doc_id", "s.*")
    shared = hashes.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
    of_side = lambda n: F.collect_list(F.when(F.col("side") == n, F.col("hash")))
    live = hashes.join(shared.select("hash"), "hash", "left_semi").groupBy("doc_id").agg(of_side(0).alias("u"), of_side(1).alias("v"))
    keys = live.select("doc_id", F.expr("explode(flatten(transform(u, x -> transform(v, y -> xxhash64(x, y)))))").alias("key"))
    first = keys.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot <> last")
    pairs = keys.join(first.select("key", "pivot"), "key").select("pivot", "doc_id").distinct()
    pairs = staged(pairs.join(reps.select("doc_id", "n_shingles"), "doc_id"), "candidates")
    sizes = pairs.groupBy("pivot").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    sizes = sizes.where("n > 1").select("pivot", F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = pairs.join(sizes, "pivot").select(
        "pivot", "doc_id", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("own"),
        F.expr("explode(sequence(0, blocks - 1))").alias("other"),
    )
    dealt = dealt.select("pivot", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "doc_id")
    wanted = pairs.select("doc_id").distinct().hint("merge")  # one plan at every size
    sets = shingle_sets(texts_of(docs).select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id", "left_semi"), k)
    return _verified(dealt.join(sets, "doc_id"), percent)


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, hashes: int = HASHES) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs (doc_id, text)``.

    Words are maximal runs of other than white space, A-Z lower-cased. Sets are
    of distinct ``k``-word shingles (64-bit hashes); a shorter text is one
    shingle, a text without words or a null is empty and linked with nothing.
    Two texts are linked if ``100 * intersection >= percent * union``;
    ``component_id`` is the smallest id reachable by links. Texts of equal sets
    are linked through the smallest id among them and compared once. Repeated
    rows come out as often as they came in; a null ``doc_id`` is linked with
    nothing and its ``component_id`` and ``kept`` are null. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    rows = staged(signatures(docs, k, hashes), "signatures")
    same = rows.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(
        F.min(F.struct("doc_id", "n_shingles", "u", "v")).alias("r"), F.count("*").alias("copies")
    )
    reps = staged(same.select("digest", "copies", "r.*"), "representatives")
    labels = components(links(docs, reps, k, percent))
    home = reps.join(labels, reps["doc_id"] == labels["v"], "left").select("digest", F.coalesce("c", "doc_id").alias("component_id"))
    moved = home.join(reps.select("digest", "copies", "doc_id"), "digest").where("copies > 1 or component_id <> doc_id").select("digest", "component_id")
    out = rows.select("doc_id", "n_shingles", "digest").join(moved, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest id; null ids stay.

    Columns are as they were; rows that repeat an id with its text stay once.
    """
    found = near_duplicates(docs, k, percent)
    gone = found.where("not kept").select("doc_id").distinct()
    again = found.where("kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    left = docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
    once = left.join(again, left["doc_id"] == again["doc_id"], "left_anti")
    twice = left.join(again, left["doc_id"] == again["doc_id"], "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(twice)
