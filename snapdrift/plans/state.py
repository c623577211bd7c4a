"""Keyed state in bucketed segments, merged so that it stays as large as what it holds.

A table of state is a set of immutable segments, each bucketed by the hash of
the table's key. Segments are read as the partitions of one bucketed table, so
a join or an aggregation on the key starts from the files: state is not
shuffled. A run adds one segment; when there are more than ``KEEP`` of them the
newest ones are merged, and the older as well while they are not much larger,
so a run reads a bounded multiple of the live rows however many runs there were.

Which segments count after a run is one small manifest. It is written last, so
a run that failed or is repeated starts from the manifest before it and changes
nothing that an earlier one names. :func:`vacuum` removes what no manifest needs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16  # of a new table; it keeps its own number
KEEP = 4
FACTOR = 2
EPOCH = "epoch"


# --- folders ------------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    """The file system of ``path``, and the path, as the cluster's Hadoop client sees them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, path)
    return files.exists(place)


def names_in(spark: SparkSession, path: str) -> list[str]:
    files, place = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes below ``path``."""
    files, place = _files(spark, path)
    return files.getContentSummary(place).getLength() if files.exists(place) else 0


def remove(spark: SparkSession, path: str) -> None:
    files, place = _files(spark, path)
    files.delete(place, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there as a whole or not at all."""
    files, place = _files(spark, path)
    passing = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = files.create(passing, True)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(place):
        files.delete(place, False)
    if not files.rename(passing, place):
        raise OSError(f"could not rename to {path}")


def read_text(spark: SparkSession, path: str) -> str:
    files, place = _files(spark, path)
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


# --- manifests ------------------------------------------------------------------


@dataclass(frozen=True)
class Table:
    """``keys`` bucket the rows; a row of a later ``epoch`` replaces those of the same ``keys`` if ``newest_only``."""

    name: str
    schema: T.StructType
    keys: tuple[str, ...]
    newest_only: bool = True


@dataclass
class Manifest:
    """Segments of each table, newest first, as ``[name, rows]``, and values that a run hands to the next."""

    epoch: int = -1
    buckets: int = BUCKETS
    segments: dict[str, list[list]] = field(default_factory=dict)
    values: dict = field(default_factory=dict)


def _manifest_epochs(spark: SparkSession, folder: str) -> list[int]:
    names = names_in(spark, f"{folder}/manifests")
    return [int(n[len("epoch=") : -len(".json")]) for n in names if n.startswith("epoch=") and n.endswith(".json")]


def read_manifest(spark: SparkSession, folder: str, before: int, buckets: int = BUCKETS) -> Manifest:
    """The last manifest of an epoch ``before`` this one; an empty one for new state."""
    epochs = [e for e in _manifest_epochs(spark, folder) if e < before]
    if not epochs:
        return Manifest(buckets=buckets)
    return Manifest(**json.loads(read_text(spark, f"{folder}/manifests/epoch={max(epochs)}.json")))


def write_manifest(spark: SparkSession, folder: str, manifest: Manifest) -> None:
    write_text(spark, f"{folder}/manifests/epoch={manifest.epoch}.json", json.dumps(manifest.__dict__))


# --- segments -------------------------------------------------------------------


def _name(word: str) -> str:
    return f"snapdrift_{word}_{uuid.uuid4().hex}"


def write_segment(rows: DataFrame, folder: str, table: Table, buckets: int) -> list | None:
    """``[name, rows]`` of a new segment; none if there are no rows."""
    spark, name, passing = rows.sparkSession, uuid.uuid4().hex, _name("segment")
    path = f"{folder}/{table.name}/segment={name}"
    named = rows.select(*[F.col(f.name).cast(f.dataType) for f in table.schema.fields])
    written = Observation()
    dealt = named.repartition(buckets, *table.keys).observe(written, F.count(F.lit(1)).alias("n"))  # one file a bucket
    dealt.write.bucketBy(buckets, *table.keys).sortBy(*table.keys).option("path", path).format("parquet").saveAsTable(passing)
    spark.sql(f"DROP TABLE {passing}")  # the files stay
    n = written.get["n"]
    return [name, n] if n else None


def plain_segments(spark: SparkSession, folder: str, table: Table, manifest: Manifest) -> DataFrame:
    """All rows of the table's segments as a plain table, for readers outside a run."""
    live = [f"{folder}/{table.name}/segment={s}" for s, _ in manifest.segments.get(table.name, [])]
    return spark.read.schema(table.schema).parquet(*live) if live else spark.createDataFrame([], table.schema)


def bucketed_segments(spark: SparkSession, folder: str, table: Table, manifest: Manifest, name: str) -> DataFrame:
    """The same rows as the catalog table ``name``, bucketed by the table's key; the name is needed until they are read."""
    keys = ", ".join(table.keys)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields)
    root = f"{folder}/{table.name}"
    spark.sql(
        f"CREATE TABLE {name} ({columns}, segment STRING) USING parquet PARTITIONED BY (segment) "
        f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {manifest.buckets} BUCKETS LOCATION '{root}'"
    )
    places = " ".join(f"PARTITION (segment = '{s}') LOCATION '{root}/segment={s}'" for s, _ in manifest.segments[table.name])
    spark.sql(f"ALTER TABLE {name} ADD {places}")
    return spark.table(name).drop("segment")


def newest_rows(rows: DataFrame, table: Table) -> DataFrame:
    """The row of the last epoch for each key; no shuffle over bucketed rows."""
    rest = [f.name for f in table.schema.fields if f.name not in table.keys]
    last = rows.groupBy(*table.keys).agg(F.max_by(F.struct(*rest), EPOCH).alias("r"))
    return last.select(*[F.col(f.name if f.name in table.keys else f"r.{f.name}") for f in table.schema.fields])


def merge_count(sizes: Sequence[int], keep: int = KEEP, factor: int = FACTOR) -> int:
    """How many of the newest segments to merge: none up to ``keep``; then so many that ``keep`` are left, and the next while small."""
    if len(sizes) <= keep:
        return 0
    total, n = sizes[0], 1
    while n < len(sizes) and (len(sizes) - n >= keep or sizes[n] <= factor * total):
        total, n = total + sizes[n], n + 1
    return n


class State:
    """Tables of state below ``folder`` as they were before ``epoch``, and as a run leaves them.

    A context: the names under which segments are read are dropped at its end.
    """

    def __init__(self, spark: SparkSession, folder: str, epoch: int, tables: Sequence[Table], buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.epoch = spark, folder.rstrip("/"), epoch
        self.tables, self.names = {t.name: t for t in tables}, []
        self.manifest = read_manifest(spark, self.folder, epoch, buckets)
        self.segments = {name: list(s) for name, s in self.manifest.segments.items()}
        self.values = dict(self.manifest.values)

    def __enter__(self) -> State:
        return self

    def __exit__(self, *error) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # external: the files stay

    def _read(self, name: str, segments: list[list]) -> DataFrame:
        table = self.tables[name]
        if not segments:
            return self.spark.createDataFrame([], table.schema)
        self.names.append(_name(name))
        part = Manifest(self.epoch, self.manifest.buckets, {name: segments})
        rows = bucketed_segments(self.spark, self.folder, table, part, self.names[-1])
        return newest_rows(rows, table) if table.newest_only else rows

    def rows(self, name: str) -> DataFrame:
        """The rows before this run."""
        return self._read(name, self.manifest.segments.get(name, []))

    def now(self, name: str) -> DataFrame:
        """The rows with what this run has added."""
        return self._read(name, self.segments.get(name, []))

    def add(self, name: str, rows: DataFrame) -> None:
        made = write_segment(rows, self.folder, self.tables[name], self.manifest.buckets)
        if made is not None:
            self.segments.setdefault(name, []).insert(0, made)

    def merge(self, name: str, keep_live: Callable[[DataFrame], DataFrame] | None = None, keep: int = KEEP) -> None:
        """Merge the newest segments if there are too many; ``keep_live`` drops rows that nothing points at any more."""
        own = self.segments.get(name, [])
        n = merge_count([rows for _, rows in own], keep)
        if n < 2:
            return
        rows = self._read(name, own[:n])
        made = write_segment(rows if keep_live is None else keep_live(rows), self.folder, self.tables[name], self.manifest.buckets)
        self.segments[name] = ([made] if made else []) + own[n:]

    def commit(self) -> None:
        write_manifest(self.spark, self.folder, Manifest(self.epoch, self.manifest.buckets, self.segments, self.values))


def live_bytes(spark: SparkSession, folder: str, before: int) -> int:
    """Bytes of the segments that a run at ``before`` reads."""
    manifest = read_manifest(spark, folder, before)
    return sum(size_of(spark, f"{folder}/{table}/segment={s}") for table, own in manifest.segments.items() for s, _ in own)


def vacuum(spark: SparkSession, folder: str, before: int) -> int:
    """Remove manifests of epochs below the last one ``before`` and segments that no later one names; how many segments went.

    Runs from ``before`` on can be repeated, earlier ones no longer. No other run may be under way.
    """
    last = read_manifest(spark, folder, before).epoch
    epochs = [e for e in _manifest_epochs(spark, folder)]
    kept = [read_manifest(spark, folder, e + 1) for e in epochs if e >= last]
    named = {(t, s) for m in kept for t, own in m.segments.items() for s, _ in own}
    gone = 0
    for table in {t for t, _ in named}:
        for name in names_in(spark, f"{folder}/{table}"):
            if name.startswith("segment=") and (table, name.removeprefix("segment=")) not in named:
                remove(spark, f"{folder}/{table}/{name}")
                gone += 1
    for e in epochs:
        if e < last:
            remove(spark, f"{folder}/manifests/epoch={e}.json")
    return gone
