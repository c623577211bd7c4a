"""Tables a job reads more than once, written where every executor can reach them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="snapdrift-")


def named_folder(spark: SparkSession) -> str | None:
    """The checkpoint folder the cluster names, if it names one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else None


def shared_folder(spark: SparkSession) -> str:
    """A folder every executor can reach: the one the cluster names, or one of this machine if all tasks run here."""
    named = named_folder(spark)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or _own_folder()


_NOTED: ContextVar[tuple[list[str], ...]] = ContextVar("noted", default=())


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """Add the folders that :func:`written` makes meanwhile, in this thread, to ``paths``."""
    token = _NOTED.set((*_NOTED.get(), paths))
    try:
        yield
    finally:
        _NOTED.reset(token)


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove staged tables that nothing reads any more; those that are gone are left out."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a finished job go at once, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: made once, and a lost executor costs a re-read.

    The job runs when this is called; the folder is the cluster's to clean up,
    unless a caller that knows its last reader does (:func:`noted`).
    """
    path = f"{shared_folder(df.sparkSession)}/snapdrift/{name}-{uuid.uuid4().hex}"
    for paths in _NOTED.get():
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """:func:`written` where a shared folder is named, so that readers prune columns and lineage is cut.

    Without one all tasks run in this process and exchanges are reused within a
    plan, which is faster than writing there; the plan then stays lazy.
    """
    return df if named_folder(df.sparkSession) is None else written(df, name)


def spread(df: DataFrame) -> DataFrame:
    """Give a table that comes in fewer splits than there are cores a task per core.

    Extraction is CPU-bound, so one small file should not be one task. A table
    of many splits is returned as it is: at scale this never shuffles.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Bytes of input and of shuffled rows that a task gets at most, where many rows lie in few bytes.
FINE = {"spark.sql.files.maxPartitionBytes": 16 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20}
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def fine_tasks(spark: SparkSession) -> None:
    """Keep splits and joined partitions small, so that a task's sorts and hash maps stay so however large the input is.

    Item rows are a few compressed bytes each and a hundred and more in memory.
    A session that has smaller sizes keeps them.
    """
    for key, most in FINE.items():
        number, unit = re.fullmatch(r"(\d+)\s*([bkmgt]?)[ib]*", spark.conf.get(key).strip().lower()).groups()
        if int(number) * _UNITS[unit] > most:
            spark.conf.set(key, str(most))


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` in all the partitions a shuffle of the session has; none are put together for being small before they unfold."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
