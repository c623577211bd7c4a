"""What several operators share: staged tables, batch bounds, connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 512
MAX_ROUNDS = 64


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="snapdrift-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is named, one of this machine if all tasks run here, else an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or _own_folder()).rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/snapdrift-llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: done once, and safe from lost executors."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small, so that a batch of long texts fits in a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, rows + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def texts_of(docs: DataFrame, *more: Column) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) of ``docs``; other columns do not matter."""
    return docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"), *more)


def components(edges: DataFrame) -> DataFrame:
    """``(v, c)``: the smallest vertex ``c`` reachable from ``v``, for each vertex of ``edges (a, b)``.

    Labels fall along edges and then jump to the label of their label, so that
    long chains halve. Each round is written out; a vertex with very many edges
    is folded before it is shuffled.
    """
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w"))
    both = staged(both.union(edges.select(F.col("b"), F.col("a"))).where("v <> w").distinct(), "edges")
    labels = staged(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("c")), "labels")
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.select(F.col("v").alias("w"), F.col("c").alias("near")), "w").groupBy("v").agg(F.min("near").alias("near"))
        step = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        jump = step.select(F.col("v").alias("c"), F.col("c").alias("further"))
        step = staged(step.join(jump, "c", "left").select("v", "old", F.coalesce("further", "c").alias("c")), "labels")
        labels = step.select("v", "c")
        if not step.where("old <> c").limit(1).count():
            return labels
    raise RuntimeError(f"labels still move after {MAX_ROUNDS} rounds")
