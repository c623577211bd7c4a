"""Toxicity as a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text has the distinct n-grams of its lower-cased characters, hashed into
``2 ** BITS`` numbers. The ratio of an n-gram compares how often texts of
either class hold it; the n-grams that tell most are kept, and logistic
regression is fitted to their presence times their ratio.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from snapdrift.llm.common import small_batches, staged, texts_of

GRAMS = (3, 4, 5, 6)
BITS = 20
MAX_TRAIN_ROWS = 20_000  # labelled rows that a fit uses, at most; scores and counts of texts have no bound
FEATURES = 8_192
LEAST_TEXTS = 3  # that hold an n-gram before it counts
SMOOTH = 0.5
RIDGE = 1e-3
STEPS = 400
PIECE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Model:
    """Numbers of n-grams, their weights (ratio included), and the offset."""

    features: np.ndarray
    weights: np.ndarray
    offset: float


def grams(text: str) -> Iterator[np.ndarray]:
    """Numbers of all n-grams of a text, repeats included, piece by piece."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(codes), PIECE):
        part = codes[at : at + PIECE + max(GRAMS) - 1].astype(np.uint64) + np.uint64(1)
        h = part.copy()
        for n in range(2, max(GRAMS) + 1):
            if n > len(part):
                break
            h = h[: len(part) - n + 1] * _BASE + part[n - 1 :]
            if n in GRAMS:
                yield (((h ^ (h >> np.uint64(29))) * _LAST) >> np.uint64(64 - BITS)).astype(np.int64)


def present(text: str, table: np.ndarray) -> np.ndarray:
    """Distinct features of a text; ``table`` gives 1 + the place of a number among the features, or 0."""
    found = [hits[hits > 0] for hits in (table[g] for g in grams(text))]
    return np.unique(np.concatenate(found)) - 1 if found else np.empty(0, np.int64)


def _table(features: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << BITS, np.int16)
    table[features] = np.arange(1, len(features) + 1)
    return table


def fit_linear(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on ``presence * ratio`` by accelerated gradient steps; weights come with the ratio in them."""
    size = np.array([len(r) for r in rows])
    column = np.concatenate(rows).astype(np.int64) if len(rows) else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    scale = ratio[column]
    w, b = np.zeros(len(ratio)), float(np.log((y.sum() + SMOOTH) / (len(y) - y.sum() + SMOOTH)))
    pace = 1 / (0.25 * (np.bincount(row, scale * scale, len(rows)).max(initial=0) + 1) + RIDGE)
    vw, vb = w.copy(), b
    for step in range(STEPS):
        z = np.bincount(row, scale * vw[column], len(rows)) + vb
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        g = (p - y) / len(y)
        nw = vw - pace * (np.bincount(column, scale * g[row], len(ratio)) + RIDGE * vw / len(y)) * len(y) ** 0.5
        nb = vb - pace * g.sum() * len(y) ** 0.5
        k = step / (step + 3)
        vw, vb, w, b = nw + k * (nw - w), nb + k * (nb - b), nw, nb
    return w * ratio, float(b)


def _counts(train: DataFrame) -> DataFrame:
    """Texts of either class that hold each number; a task sends a number once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(grams(text))
                if found:
                    held[label, np.unique(np.concatenate(found))] += 1
        use = np.flatnonzero(held.any(axis=0))
        for at in range(0, len(use), 65_536):
            part = use[at : at + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, held[1, part], held[0, part])], ["gram", "pos", "neg"])

    sent = train.select("text", "label").mapInArrow(run, "gram long, pos long, neg long")
    return sent.groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on labelled rows, of each class in proportion, at most ``max_rows``, those with the smallest hash of their id.

    The chosen ids are broadcast (bounded by ``max_rows``), so texts stay where
    they are. A label of a row given twice is the larger one; rows without
    label or text do not count. Without rows of both classes every score is
    the share of the class among the rows, smoothed.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    chosen = known.where("label in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    train = texts_of(docs).join(F.broadcast(staged(chosen, "labels")), "doc_id").where("text <> ''")
    train = staged(train.select("text", "label"), "train")
    n = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    prior = float(np.log((pos + SMOOTH) / (neg + SMOOTH)))
    if not pos or not neg:
        return Model(np.empty(0, np.int64), np.empty(0), prior)
    ratio = F.log((F.col("pos") + SMOOTH) / (pos + 2 * SMOOTH)) - F.log((F.col("neg") + SMOOTH) / (neg + 2 * SMOOTH))
    told = _counts(train).where(F.col("pos") + F.col("neg") >= LEAST_TEXTS).withColumn("ratio", ratio)
    worth = F.abs(F.col("pos") / pos - F.col("neg") / neg) * F.abs("ratio")
    best = told.orderBy(worth.desc(), "gram").limit(FEATURES).select("gram", "ratio").toPandas()
    features, ratios = best["gram"].to_numpy(), best["ratio"].to_numpy()
    table = _table(features)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [present(text, table).astype(np.int32) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.int32()))], ["label", "features"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, rows = [], []
        for batch in batches:
            y += batch.column(0).to_pylist()
            rows += [np.array(r, np.int32) for r in batch.column(1).to_pylist()]
        if rows:
            w, b = fit_linear(rows, np.array(y, float), ratios)
            yield pa.RecordBatch.from_arrays([pa.array([[*w, b]], pa.list_(pa.float64()))], ["weights"])

    sparse = staged(train.select("text", "label").mapInArrow(vectors, "label int, features array<int>"), "vectors")
    weights = np.array(sparse.coalesce(1).mapInArrow(solve, "weights array<double>").first()[0])
    return Model(features, weights[:-1], float(weights[-1]))


def with_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with the column ``name`` (0 to 1) from their ``text``; a null text is empty and gets the score of no n-gram."""
    small_batches(docs.sparkSession)
    table, weights, offset = _table(model.features), model.weights, model.offset
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array([offset + weights[present(text or "", table)].sum() for text in batch.column(at).to_pylist()])
            scores = pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of each row of ``docs (doc_id, text)``, repeated rows and null ids included."""
    return with_score(texts_of(docs), model, "score").select("doc_id", "score")


def held_out(doc_id: Column) -> Column:
    """A quarter of the ids, from which no label is learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def clean(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``least`` after a fit on their labelled rows, columns as they were."""
    model = fit(docs, labels.where(~held_out(labels["doc_id"])))
    name = "score"
    while name in docs.columns:
        name += "_"
    return with_score(docs, model, name).where(F.col(name) < least).select(*[f"`{c}`" for c in docs.columns])
