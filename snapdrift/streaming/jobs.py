"""The monitors as streams over landed captures."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from snapdrift.plans.detect import ItemMonitor, VersionMonitor
from snapdrift.plans.incremental import run_epoch, run_epoch_all
from snapdrift.plans.monitors import MONITORS
from snapdrift.plans.state import BUCKETS, State, Table, plain_segments, read_manifest
from snapdrift.schema import KEYS, table_of

DRAIN = {"availableNow": True}


def stream_detect(
    captures: DataFrame,
    targets: DataFrame,
    spec: ItemMonitor | VersionMonitor,
    state: str,
    sink: str,
    checkpoint: str,
    trigger: dict | None = None,
    delay: timedelta | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Each micro-batch runs the batch plan against the stored state.

    Reports and state are written per epoch, so a batch that is replayed after
    a failure overwrites its own folders. Several scans of a target in one
    batch are compared with each other like a history. With ``delay`` a scan of
    several captures also closes by event time.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        run_epoch(df, targets, spec, state, sink, epoch, delay=delay, buckets=buckets)

    writer = captures.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or DRAIN)).start()


def stream_detect_all(
    captures: DataFrame,
    targets: DataFrame,
    state: str,
    sink: str,
    checkpoint: str,
    specs: Iterable[ItemMonitor | VersionMonitor] = tuple(MONITORS.values()),
    trigger: dict | None = None,
    delay: timedelta | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """T1 for every monitor: one stream, one state folder, one sink.

    A batch in which a monitor failed fails after the others are done, and is
    repeated by Spark; those that had gone well write the same again.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        landed = df.persist()
        try:
            errors = run_epoch_all(landed, targets, specs, state, sink, epoch, delay=delay, buckets=buckets)
        finally:
            landed.unpersist()
        failed = {m: e for m, e in errors.items() if e}
        if failed:
            raise RuntimeError(f"epoch {epoch}: {failed}")

    writer = captures.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or DRAIN)).start()


CHANGES = table_of("monitor string, target_id string, scan_id bigint, op string, item string")
CHANGE = Row(*CHANGES.names)
CHUNK = 4096
HELD = 1 << 16
GONE = 1 << 16


class SetState(StatefulProcessor):
    """Which items a share of a target's set holds, one entry an item.

    ``items`` maps an item to the scans of the last batch that named it, with
    the scan before that batch in front if it was there then. An item is present
    if it was named by the last scan. Up to ``HELD`` items of a batch are
    gathered before the state is walked once, and only those that are there in
    the end, or were, are written or removed. Of a larger batch nothing but one
    item is held: rows are applied to the state as they come.
    """

    def __init__(self, ttl: timedelta | None = None) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.ttl is None else int(self.ttl.total_seconds() * 1000)
        self.last = handle.getValueState("last", "scan_id long")
        self.items = handle.getMapState("items", "item string", "scans array<long>", ttlDurationMs=ttl)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._begin(zip(initialState["scan_id"].tolist(), initialState["item"].tolist()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        named = (pair for frame in rows for pair in zip(frame["scan_id"].tolist(), frame["item"].tolist()))
        out = []
        for change in self._changes(key, named):
            out.append(change)
            if len(out) >= CHUNK:
                yield pd.DataFrame(out, columns=CHANGES.names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=CHANGES.names)

    def _begin(self, rows: Iterable[tuple[int, str | None]]) -> None:
        """Take rows of a baseline, in one portion or several; what an earlier scan than the last named counts as absent."""
        known = self.last.get()
        before = None if known is None else known[0]
        last = before
        for scan_id, item in rows:
            last = scan_id if last is None else max(last, scan_id)
            if item is not None and scan_id == last:
                self.items.updateValue((item,), ([last],))
        if last != before:
            self.last.update((last,))

    def _changes(self, key, rows: Iterable[tuple[int, str | None]]) -> Iterator[tuple]:
        found = self.last.get()
        last = None if found is None else found[0]
        scans: set[int] = set()
        held: dict[str, set[int]] | None = {}
        for scan_id, item in rows:
            if last is not None and scan_id <= last:
                continue
            scans.add(scan_id)
            if item is None:
                continue
            if held is None:
                self._name(item, [scan_id], last)
                continue
            held.setdefault(item, set()).add(scan_id)
            if len(held) > HELD:
                for one, at in held.items():
                    self._name(one, at, last)
                held = None
        if not scans:
            return
        order = sorted(scans)
        yield from self._walk(key, order, last, held)
        self.last.update((order[-1],))

    def _name(self, item: str, at: Iterable[int], last: int | None) -> None:
        known = self.items.getValue((item,))
        seen = [] if known is None else [int(s) for s in known[0]]
        if seen and last is not None and seen[-1] <= last:  # of an earlier batch
            seen = [last] if seen[-1] == last else []
        if not set(at) <= set(seen):
            self.items.updateValue((item,), (sorted({*seen, *at}),))

    def _walk(self, key, order: list[int], last: int | None, held: dict[str, set[int]] | None) -> Iterator[tuple]:
        """Changes of the items in the state, with their scans of this batch, and then of those ``held`` that it does not know."""
        start, rest, final = (order[0], order[1:], order[-1]) if last is None else (last, order, order[-1])
        gone, stays = [], []

        def moves(item: str, named: set[int]) -> Iterator[tuple]:
            there = start in named
            for scan_id in rest:
                now = scan_id in named
                if now != there:
                    yield (*key[:2], scan_id, "added" if now else "removed", item)
                there = now

        if held is None or last is not None:  # a target that is new to the state has nothing in it
            for (item,), (seen,) in self.items.iterator():
                named = {int(s) for s in seen}
                if held is not None:
                    named = (named & {last}) | held.pop(item, set())
                    if final in named:
                        stays.append(item)
                if final not in named and len(gone) < GONE:
                    gone.append(item)  # beyond GONE it goes after a later batch; until then it counts as absent
                yield from moves(item, named)
        for item, named in (held or {}).items():
            if final in named:
                stays.append(item)
            yield from moves(item, named)
        for item in gone:
            self.items.removeKey((item,))
        for item in stays:
            self.items.updateValue((item,), ([final],))

    def close(self) -> None:
        pass


class RowSetState(SetState):
    """:class:`SetState` over rows; a share of few rows then costs no frame of its own."""

    def handleInitialState(self, key, initialState: Iterable[Row], timerValues) -> None:
        rows = [initialState] if isinstance(initialState, Row) else initialState
        self._begin((r["scan_id"], r["item"]) for r in rows)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for change in self._changes(key, ((r["scan_id"], r["item"]) for r in rows)):
            yield CHANGE(*change)


def stream_set_changes(
    scans: DataFrame, items: Column, shares: int = 16, initial: DataFrame | None = None, ttl: timedelta | None = None
) -> DataFrame:
    """Changes of item sets with the state kept by Spark.

    ``scans`` is a stream of (monitor, target_id, scan_id) rows, each a whole
    scan, and ``items`` the array of a scan's items. Items are opened before the
    shuffle and dealt by hash to ``shares`` states of their target; a row
    without an item tells every share of the scan. ``initial`` is a batch
    baseline ``KEYS, scan_id, item`` to start from (a null item: a scan without
    any). Items of targets that end are dropped after ``ttl``. A scan not after
    the stored one is ignored.
    """
    share = lambda x: F.pmod(F.xxhash64(x), F.lit(shares)).cast("int")
    named = F.transform(items, lambda x: F.struct(share(x).alias("share"), x.alias("item")))
    marks = F.transform(F.sequence(F.lit(0), F.lit(shares - 1)), lambda i: F.struct(i.alias("share"), F.lit(None).cast("string").alias("item")))
    rows = scans.select(*KEYS, "scan_id", F.explode(F.concat(marks, F.coalesce(F.filter(named, lambda x: x["item"].isNotNull()), F.array().cast("array<struct<share:int,item:string>>")))).alias("e"))
    rows = rows.select(*KEYS, "e.share", "scan_id", "e.item")
    start = None
    if initial is not None:
        marked = F.concat(F.array(F.struct(share(F.col("item")).alias("share"), "item")), marks)
        opened = initial.select(*KEYS, "scan_id", F.explode(marked).alias("e")).filter("e.share IS NOT NULL")
        start = opened.select(*KEYS, "e.share", "scan_id", "e.item").distinct().groupBy(*KEYS, "share")
    return rows.groupBy(*KEYS, "share").transformWithState(
        statefulProcessor=RowSetState(ttl), outputStructType=CHANGES, outputMode="Append",
        timeMode="None" if ttl is None else "ProcessingTime", initialState=start,
    )


# --- registry -----------------------------------------------------------------------

REGISTRY = Table(
    "registry",
    table_of("monitor string, target_id string, item string, first_seen bigint, last_seen bigint, epoch int"),
    (*KEYS, "item"),
    newest_only=False,
)


def _spans(rows: DataFrame) -> DataFrame:
    """First and last scan of each item; over bucketed rows nothing is shuffled."""
    found = rows.groupBy(*REGISTRY.keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("epoch").alias("epoch"))
    return found.select(*[f.name for f in REGISTRY.schema.fields])


def registry_epoch(items: DataFrame, folder: str, sink: str, epoch: int, buckets: int = BUCKETS) -> None:
    """Take items ``SCAN, item`` into the registry; those never seen before are written to ``sink``.

    Items that land late only widen their span. A repeated epoch changes nothing.
    """
    spark = items.sparkSession
    keyed = items.filter(F.col("monitor").isNotNull() & F.col("target_id").isNotNull() & F.col("item").isNotNull())
    seen = keyed.groupBy(*REGISTRY.keys).agg(F.min("scan_id").alias("first_seen"), F.max("scan_id").alias("last_seen"))
    with State(spark, folder, epoch, (REGISTRY,), buckets) as state:
        known = state.rows("registry").select(*REGISTRY.keys, F.lit(True).alias("_known"))
        new = seen.join(known.distinct(), list(REGISTRY.keys), "left").filter("_known IS NULL").drop("_known", "last_seen")
        new.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/epoch={epoch}")
        state.add("registry", seen.withColumn("epoch", F.lit(epoch)))
        state.merge("registry", _spans)
        state.commit()


def read_registry(spark: SparkSession, folder: str, before: int = 1 << 31) -> DataFrame:
    """``monitor, target_id, item, first_seen, last_seen`` of every item seen before an epoch."""
    return _spans(plain_segments(spark, folder.rstrip("/"), REGISTRY, read_manifest(spark, folder.rstrip("/"), before))).drop("epoch")


def stream_first_seen(
    items: DataFrame, folder: str, sink: str, checkpoint: str, trigger: dict | None = None, buckets: int = BUCKETS
) -> StreamingQuery:
    """The registry of first and last sights, kept in bucketed state; ``sink`` gets each item once.

    Neither executors nor the state store hold the registry: a batch is joined
    with its buckets where they lie.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        registry_epoch(df, folder, sink, epoch, buckets)

    writer = items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or DRAIN)).start()
