"""Near duplicates among vectors by spherical-cap filters.

A filter is a direction; a vector passes it if their inner product is above a
height. Directions come from random product codes: after a random rotation a
vector is cut into three parts, each part has its own codebook, and a filter is
one code word of each. The filters a vector passes are list-decoded from three
short tables of inner products, never by trying all of them. Vectors are
joined on the filters they pass and pairs verified in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from snapdrift.llm.common import components, small_batches, staged
from snapdrift.llm.minhash import intersections

PARTS, CODES, LISTED = 3, 8, 8  # parts of a code word, independent codes, mean filters passed in each
BLOCK = 1_024
LEAST_DIMENSIONS = 6


def codewords(rows: int) -> int:
    """Words of a codebook: filters of a code, their cube, keep in proportion to the rows."""
    return int(np.clip(np.ceil((4.0 * max(rows, 1)) ** (1 / PARTS)), 32, 512))


@lru_cache(maxsize=2)
def product_codes(dimensions: int, words: int) -> tuple[list[tuple[np.ndarray, list[np.ndarray]]], float]:
    """Rotations with their codebooks, and the height that a vector exceeds ``LISTED`` times on average."""
    codes = []
    for seed in range(CODES):
        rng = np.random.default_rng([seed, dimensions, words])
        turn, _ = np.linalg.qr(rng.standard_normal((dimensions, dimensions)))
        books = []
        for part in np.array_split(np.arange(dimensions), PARTS):
            book = rng.standard_normal((words, len(part)))
            books.append(book / np.linalg.norm(book, axis=1, keepdims=True) / np.sqrt(PARTS))
        codes.append((turn, books))
    grid = (np.arange(400_000) + 0.5) / 200_000 - 1  # inner products of a unit vector with a random one
    density = np.exp((dimensions - 3) / 2 * np.log1p(-grid * grid))
    above = np.cumsum(density[::-1])[::-1] / density.sum()
    return codes, float(grid[np.searchsorted(-above, -LISTED / float(words) ** PARTS)])


def decode(unit: np.ndarray, words: int) -> np.ndarray:
    """All filters that a unit vector passes, and the nearest of each code even if it is not passed; sorted."""
    codes, height = product_codes(len(unit), words)
    found = []
    for n, (turn, books) in enumerate(codes):
        turned = np.array_split(unit @ turn, PARTS)
        s0, s1, s2 = (book @ part for book, part in zip(books, turned))
        m0, m1, m2 = s0.max(), s1.max(), s2.max()
        a, b = np.flatnonzero(s0 >= height - m1 - m2), np.flatnonzero(s1 >= height - m0 - m2)
        two = s0[a][:, None] + s1[b][None, :]
        i, j = np.nonzero(two >= height - m2)
        k, c = np.nonzero(two[i, j][:, None] + s2[None, :] >= height)
        found.append(((n * words + a[i][k]) * words + b[j][k]) * words + c)
        found.append(np.array([((n * words + s0.argmax()) * words + s1.argmax()) * words + s2.argmax()]))
    return np.unique(np.concatenate(found)).astype(np.int32)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max()
    if len(x) < LEAST_DIMENSIONS:
        x = np.concatenate([x, np.zeros(LEAST_DIMENSIONS - len(x))])
    return x / np.linalg.norm(x)


def _rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, digest, vector`` of each row; the digest is null where a vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = np.float32 if pa.types.is_float32(batch.column(2).type.value_type) else np.float64
            digest, raw = [], []
            for label, values in zip(batch.column(1).to_pylist(), batch.column(2)):
                x = None
                if label is not None and values.is_valid and len(values) and not values.values.null_count:
                    x = values.values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)
                    x = x if np.isfinite(x).all() and x.any() else None
                raw.append(None if x is None else x.tobytes())
                digest.append(None if x is None else hashlib.blake2b(label.encode() + b"\0" + raw[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())],
                ["vec_id", "label", "digest", "vector"],
            )

    plain = vectors.select(vectors["vec_id"].cast("long"), vectors["label"].cast("string"), vectors["embedding"])
    return plain.mapInArrow(run, "vec_id long, label string, digest binary, vector binary")


def _filters(reps: DataFrame, words: int, kind: type) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = [decode(_unit(np.frombuffer(x, kind).astype(float)), words) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(passed, pa.list_(pa.int32()))], ["vec_id", "label", "copies", "vector", "filters"]
            )

    schema = "vec_id long, label string, copies long, vector binary, filters array<int>"
    return reps.select("vec_id", "label", "copies", "vector").mapInArrow(run, schema)


def bucket_links(ids, copies, own, raw, passed, filter_id, a, b, kind: type, least: float) -> list[tuple[int, int, int]]:
    """``(id, links, peer)`` of the pairs in a bucket that are linked and share no smaller filter."""
    x = np.stack([np.frombuffer(v, kind) for v in raw]).astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    norm = np.linalg.norm(x, axis=1)
    linked = (x @ x.T) / (norm[:, None] * norm[None, :]) >= least
    np.fill_diagonal(linked, False)
    if a != b:
        linked &= own[:, None] != own[None, :]
    if not linked.any():
        return []
    use = np.flatnonzero(linked.any(axis=1))
    linked = linked[np.ix_(use, use)]
    smaller = [np.asarray(passed[i]) for i in use]
    linked &= intersections([f[f < filter_id] for f in smaller]) == 0
    weight, ids = copies[use], ids[use]
    root = np.arange(len(use))
    for i in range(len(use)):
        for j in np.flatnonzero(linked[i, :i] & (root[:i] != root[i])):
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
    peer = {r: int(ids[root == r].min()) for r in np.unique(root)}
    return [(int(v), int(n), peer[r]) for v, n, r in zip(ids, linked @ weight, root) if n]


def _verified(members: DataFrame, kind: type, least: float) -> DataFrame:
    key = ["label", "width", "filter", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def flush() -> list[tuple[int, int, int]]:
            if len(held) < 2:
                return []
            ids, copies, own, raw, passed = zip(*held)
            return bucket_links(np.array(ids), np.array(copies), np.array(own), raw, passed, *at[2:], kind, least)

        def out(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["vec_id", "links", "peer"])

        for batch in batches:
            rows = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                if values[:5] != at:
                    rows += flush()
                    at, held = values[:5], []
                held.append(values[5:])
            yield out(rows)
        yield out(flush())

    dealt = members.select(*key, "vec_id", "copies", "own", "vector", "filters")
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "vec_id long, links long, peer long")


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors (vec_id, embedding, label)``.

    Vectors are compared only where labels are equal and not null, and only if
    they have as many components. A vector that is null, empty, zero, or holds
    a null or non-finite component links with nothing. Pairs found that have a
    cosine of at least ``least`` in double precision are links; none below is.
    ``n_links`` counts other rows linked directly, ``component_id`` is the
    smallest id reachable. Equal vectors of a label are linked as one vector
    with a count of copies. A bucket above ``BLOCK`` vectors is compared in
    pairs of blocks, each in a task of its own. A null ``vec_id`` gets a null
    ``component_id`` and ``kept``. No rows give no rows. The search may miss a
    link: of pairs at 0.98 itself
    3 in 1,000 share no filter, of closer pairs fewer.
    """
    small_batches(vectors.sparkSession)
    rows = staged(_rows(vectors), "vectors")
    kind = np.float32 if vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull) else np.float64
    good = rows.where("digest is not null and vec_id is not null")
    same = good.groupBy("digest").agg(F.min(F.struct("vec_id", "label", "vector")).alias("r"), F.count("*").alias("copies"))
    reps = same.select("digest", "copies", "r.*")
    passed = staged(_filters(reps, codewords(rows.count()), kind), "filters")
    width = F.length("vector").alias("width")
    keys = passed.select("vec_id", "label", width, F.explode("filters").alias("filter"))
    key = ["label", "width", "filter"]
    sizes = keys.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = keys.join(sizes, key).select(
        *key, "vec_id", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("own"), F.expr("explode(sequence(0, blocks - 1))").alias("other")
    )
    dealt = dealt.select(*key, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "vec_id", "own")
    found = staged(_verified(dealt.join(passed.select("vec_id", "copies", "vector", "filters"), "vec_id"), kind, least), "links")
    labels = components(found.select(F.col("vec_id").alias("a"), F.col("peer").alias("b")))
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    of_rep = reps.select("digest", "vec_id", "copies").join(counts, "vec_id", "left").join(labels.withColumnRenamed("v", "vec_id"), "vec_id", "left")
    of_rep = of_rep.select(
        "digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("c", "vec_id").alias("c")
    )
    out = rows.select("vec_id", "digest").join(of_rep, "digest", "left")
    known = F.col("vec_id").isNotNull()
    component = F.when(known, F.coalesce("c", "vec_id"))
    links = F.when(known, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
