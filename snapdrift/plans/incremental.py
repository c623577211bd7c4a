"""Detection against stored state, for runs that see new captures only.

State (:mod:`snapdrift.plans.state`) is kept apart for each monitor, in the
folder ``monitor=<name>``, and so are reports, changes and late captures, so any
number of monitors may share a state folder and a sink. ``scans`` has one row a
target: its last scan, where that scan's items are, and its open scans.
``items`` has the items of each target as of the run that last saw them move,
split by hash into shares, so that a target of any size is spread over buckets.
A target whose content stands still keeps pointing at the items it has. Each run
is an epoch; one that is repeated replaces what it wrote.

A scan of several captures may land in parts. Such a scan is open until a newer
scan of the target lands, until the newest capture time seen by the monitor is
``delay`` past its own, or until a run with ``close``. Its captures are written
once, to ``held`` in the epoch they came with, and read once, when it closes. A
scan of a monitor that follows another also waits until the other has seen that
scan. Captures of scans that are done go to ``late``; :func:`repair` takes them in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdrift.operators.scans import newest
from snapdrift.plans.detect import (
    ItemMonitor,
    VersionMonitor,
    bucketed,
    compare,
    detect_changes,
    due_of,
    due_scans,
    extract,
    item_rows,
    kept_changes,
    version_changes,
    version_scans,
    version_transition,
    with_target,
    word,
    word_versions,
)
from snapdrift.plans.state import BUCKETS, State, Table, exists, newest_rows, plain_segments, read_manifest
from snapdrift.schema import CAPTURES, KEYS, SCAN, table_of
from snapdrift.sources.staging import stage, written

SHARES = 8
AT_ONCE = 4
SCANS = Table(
    "scans",
    table_of(
        "monitor string, target_id string, scan_id bigint, fingerprint string, version string, items_scan bigint, "
        "items_epoch int, open opens, due dues, epoch int"
    ),
    KEYS,
)
OPEN, DUE = (SCANS.schema[c].dataType for c in ("open", "due"))
ITEMS = Table(
    "items",
    table_of("monitor string, target_id string, share int, scan_id bigint, item string, pos int, detail map, epoch int"),
    (*KEYS, "share"),
    newest_only=False,
)
CAPTURE = [f.name for f in CAPTURES.fields]


def state_folder(folder: str, monitor: str) -> str:
    return f"{folder.rstrip('/')}/monitor={monitor}"


def read_state(spark: SparkSession, folder: str, epoch: int, monitor: str) -> DataFrame:
    """The state row of every target of ``monitor`` before ``epoch``."""
    own = state_folder(folder, monitor)
    return newest_rows(plain_segments(spark, own, SCANS, read_manifest(spark, own, epoch)), SCANS)


def _write(rows: DataFrame, folder: str, name: str, monitor: str, epoch: int) -> None:
    rows.drop("monitor").write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}/monitor={monitor}/epoch={epoch}")


def _share(item: Column) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(SHARES)).cast("int").alias("share")


def _shares() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")


# --- scans that are open ----------------------------------------------------------


def split_late(captures: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures of scans after the stored one, and of those that are done."""
    stored = state.select(*KEYS, F.col("scan_id").alias("stored"))
    marked = captures.join(stored, list(KEYS), "left")
    late = F.col("stored").isNotNull() & (F.col("scan_id") <= F.col("stored"))
    return marked.filter(~late).drop("stored"), marked.filter(late).drop("stored")


def _decided(lead: DataFrame, own: DataFrame, monitor: str) -> DataFrame:
    """How far the followed monitor has seen each target of ``monitor``."""
    package = F.coalesce(F.col("target.attrs")["package"], F.col("target_id"))
    seen = with_target(lead.select(*KEYS, "scan_id"), own).select(F.lit(monitor).alias("monitor"), package.alias("target_id"), "scan_id")
    return seen.groupBy(*KEYS).agg(F.max("scan_id").alias("decided"))


def _open_scans(
    fresh: DataFrame, state: DataFrame, epoch: int, until: datetime | None, close: bool, decided: DataFrame | None
) -> DataFrame:
    """``SCAN, epochs, last_at, done`` of the open scans and those that landed now."""
    landed = fresh.groupBy(*SCAN).agg(F.max("captured_at").alias("last_at")).withColumn("epochs", F.array(F.lit(epoch)))
    kept = state.select(*KEYS, F.explode("open").alias("o")).select(*KEYS, "o.scan_id", "o.last_at", "o.epochs")
    scans = kept.unionByName(landed).groupBy(*SCAN).agg(
        F.max("last_at").alias("last_at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("epochs")))).alias("epochs")
    )
    last = scans.groupBy(*KEYS).agg(F.max("scan_id").alias("_last"))
    old = F.lit(False) if until is None else F.coalesce(F.col("last_at") < F.lit(until), F.lit(False))
    scans = scans.join(last, list(KEYS)).withColumn("done", F.lit(close) | (F.col("scan_id") < F.col("_last")) | old)
    if decided is not None and not close:
        scans = scans.join(decided, list(KEYS), "left")
        scans = scans.withColumn("done", F.col("done") & F.coalesce(F.col("decided") >= F.col("scan_id"), F.lit(False)))
    return scans.select(*SCAN, "epochs", "last_at", "done")


def _closed_captures(fresh: DataFrame, scans: DataFrame, held: str, monitor: str, epoch: int) -> DataFrame:
    """All captures of the scans that are done; those of the others that landed now are written to ``held``."""
    spark, done = fresh.sparkSession, scans.filter("done")
    waiting = fresh.join(scans.filter("NOT done").select(*SCAN), list(SCAN), "left_semi")
    waiting.drop("monitor").write.mode("overwrite").parquet(f"{held}/epoch={epoch}")
    closed = fresh.join(done.select(*SCAN), list(SCAN), "left_semi")
    epochs = done.select(F.explode("epochs").alias("e")).filter(F.col("e") < epoch).distinct().collect()  # runs, not rows
    if not epochs:
        return closed
    schema = T.StructType([f for f in CAPTURES.fields if f.name != "monitor"])
    kept = spark.read.schema(schema).parquet(*[f"{held}/epoch={r['e']}" for r in epochs])
    kept = kept.withColumn("monitor", F.lit(monitor)).select(*CAPTURE)
    return closed.unionByName(kept.join(done.select(*SCAN), list(SCAN), "left_semi"))


# --- one run ----------------------------------------------------------------------


def run_epoch(
    captures: DataFrame,
    targets: DataFrame,
    spec: ItemMonitor | VersionMonitor,
    folder: str,
    sink: str,
    epoch: int,
    close: bool = False,
    delay: timedelta | None = None,
    buckets: int = BUCKETS,
) -> None:
    """Detect in new captures of one monitor; write reports, every kept change and late captures, then the state.

    A monitor that follows another needs the captures and targets of both.
    """
    spark, monitor = captures.sparkSession, spec.monitor
    own_targets, own = targets.filter(F.col("monitor") == monitor), captures.filter(F.col("monitor") == monitor).select(*CAPTURE)
    with State(spark, state_folder(folder, monitor), epoch, (SCANS, ITEMS), buckets) as state:
        stored = written(_concerned(state.rows("scans"), own, spec), f"{monitor}-state")
        fresh, late = split_late(own, stored)
        _write(late, sink, "late", monitor, epoch)
        if isinstance(spec, VersionMonitor):
            updates = _version_epoch(fresh, own_targets, spec, stored, sink, epoch)
        else:
            updates = _item_epoch(fresh, captures, targets, spec, state, stored, sink, epoch, close, delay)
        state.add("scans", updates.withColumn("epoch", F.lit(epoch)))
        state.merge("scans")
        state.merge("items", lambda rows: _pointed_at(rows, state.now("scans")))
        state.commit()


def _concerned(state: DataFrame, captures: DataFrame, spec: ItemMonitor | VersionMonitor) -> DataFrame:
    """State rows of targets that something landed for or that have open scans; all of a monitor that follows another.

    Joined where they lie, on the buckets' key. They are written before they are
    used: a union of bucketed and other rows would be taken for bucketed as a
    whole, although it need not be once partitions are coalesced.
    """
    if isinstance(spec, ItemMonitor) and spec.follows:
        return state
    landed = captures.select(*KEYS).distinct().withColumn("_landed", F.lit(True))
    waiting = F.coalesce(F.size("open") > 0, F.lit(False))
    return state.join(landed, list(KEYS), "left").filter(F.col("_landed").isNotNull() | waiting).drop("_landed")


def _at_once(*jobs: Callable[[], None]) -> None:
    """Run small jobs side by side; the first error is raised when all are done."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()


def _version_epoch(fresh, targets, spec, stored, sink, epoch) -> DataFrame:
    scans, late = split_late(version_scans(fresh, targets, spec), stored)
    old = stored.filter("scan_id IS NOT NULL").select(*SCAN, "fingerprint", "version")
    near = old.join(scans.select(*KEYS).distinct(), list(KEYS), "left_semi")
    changed = version_transition(scans.unionByName(near, allowMissingColumns=True))
    _at_once(
        lambda: _write(version_changes(changed, targets), sink, "changes", spec.monitor, epoch),
        lambda: _write(word_versions(changed, targets, spec), sink, "reports", spec.monitor, epoch),
    )
    return _filled(newest(scans.select(*SCAN, "fingerprint", "version")))


def _filled(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of state they lack, as nulls."""
    kinds = {f.name: f.dataType for f in SCANS.schema.fields}
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])


def _item_epoch(fresh, captures, targets, spec, state, stored, sink, epoch, close, delay) -> DataFrame:
    monitor, own = spec.monitor, targets.filter(F.col("monitor") == spec.monitor)
    mine, lead_rows, info, scans, due = stored.filter(F.col("monitor") == monitor), None, None, None, None
    decided = None
    if spec.follows:
        lead_rows, due, decided = _follow(captures, targets, spec, stored)
    if spec.collect or spec.follows:
        until = _watermark(fresh, state, delay)
        scans = stage(_open_scans(fresh, mine, epoch, until, close, decided), f"{monitor}-open")
        fresh = _closed_captures(fresh, scans, f"{state.folder}/held", monitor, epoch)
    if spec.follows:
        fresh = fresh.join(due.select(*SCAN).distinct(), list(SCAN), "left_semi")
        info = due.dropDuplicates(list(SCAN)).select(*SCAN, F.create_map(F.lit("version"), F.col("version")).alias("info"))
    items, marks = extract(fresh, own, spec)
    rows = item_rows(items, spec)
    marks = marks.select(*SCAN, "fingerprint")
    touched = mine.filter("scan_id IS NOT NULL").join(marks.select(*KEYS).distinct(), list(KEYS), "left_semi")
    before = written(_stored_items(state.rows("items"), touched).select(*rows.columns), f"{monitor}-before")
    chain = marks.unionByName(touched.select(*SCAN, "fingerprint"))
    changes = bucketed(compare(rows.unionByName(before), chain, spec), own, spec)
    moved = _moved(newest(marks), touched, epoch)
    # items first: a state row never points at items that are not there
    new_items = rows.join(moved.filter(F.col("items_epoch") == epoch).select(*SCAN), list(SCAN), "left_semi")
    _at_once(
        lambda: _write(kept_changes(changes), sink, "changes", monitor, epoch),
        lambda: _write(word(changes, own, spec, info), sink, "reports", monitor, epoch),
        lambda: state.add("items", _as_items(new_items, epoch)),
    )
    return _updates(mine, moved, scans, due, lead_rows)


def _watermark(fresh: DataFrame, state: State, delay: timedelta | None) -> datetime | None:
    """What lies before this time is complete; the newest capture time is kept with the state."""
    if delay is None:
        return None
    seen = fresh.agg(F.max("captured_at").cast("double")).first()[0]
    known = state.values.get("newest")
    newest_at = max((x for x in (seen, known) if x is not None), default=None)
    if newest_at is None:
        return None
    state.values["newest"] = newest_at
    return datetime.fromtimestamp(newest_at) - delay


def _follow(captures, targets, spec, stored) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lead's new state rows, scans that are due and not yet made, and how far the lead has seen."""
    lead = spec.follows
    own = targets.filter(F.col("monitor") == lead.monitor)
    known = stored.filter(F.col("monitor") == lead.monitor)
    seen, _ = split_late(version_scans(captures.filter(F.col("monitor") == lead.monitor), own, lead), known)
    seen = stage(seen.select(*SCAN, "fingerprint", "version"), f"{spec.monitor}-lead")
    new = due_of(seen, own, spec.monitor, known.select(*SCAN, "fingerprint", "version"))
    waiting = stored.filter(F.col("monitor") == spec.monitor).select(*KEYS, F.explode("due").alias("d")).select(*KEYS, "d.scan_id", "d.version")
    last = newest(seen.unionByName(known.select(*seen.columns)))
    return _filled(newest(seen)), stage(new.select(*SCAN, "version").unionByName(waiting), f"{spec.monitor}-due"), _decided(last, own, spec.monitor)


def _current() -> Column:
    """The rows that are pointed at; no equality, which would become a key of the join beside those of the buckets."""
    return F.col("epoch").between(F.col("at"), F.col("at"))


def _stored_items(items: DataFrame, touched: DataFrame) -> DataFrame:
    """Items that ``touched`` targets point at, as items of the targets' last scan; joined on the buckets' own key."""
    pointers = touched.select(*KEYS, _shares(), F.col("items_epoch").alias("at"), F.col("scan_id").alias("now"))
    found = items.join(pointers, [*KEYS, "share"]).filter(_current())
    return found.withColumn("scan_id", F.col("now")).drop("at", "now", "share", "epoch")


def _pointed_at(items: DataFrame, scans: DataFrame) -> DataFrame:
    pointers = scans.filter("items_epoch IS NOT NULL").select(*KEYS, _shares(), F.col("items_epoch").alias("at"))
    return items.join(pointers, [*KEYS, "share"]).filter(_current()).drop("at")


def _as_items(rows: DataFrame, epoch: int) -> DataFrame:
    pos = F.col("pos") if "pos" in rows.columns else F.lit(None)
    detail = F.col("detail") if "detail" in rows.columns else F.lit(None)
    return rows.select(
        *KEYS, _share(F.col("item")), "scan_id", "item", pos.cast("int").alias("pos"),
        detail.cast("map<string,string>").alias("detail"), F.lit(epoch).alias("epoch"),
    )


def _moved(latest: DataFrame, touched: DataFrame, epoch: int) -> DataFrame:
    """New state of targets with a new scan: its items are those before if its mark is."""
    before = touched.select(
        *KEYS, F.col("fingerprint").alias("_old"), F.col("items_scan").alias("_items"), F.col("items_epoch").alias("_epoch")
    )
    joined = latest.join(before, list(KEYS), "left")
    same = F.col("_old").isNotNull() & (F.col("_old") == F.col("fingerprint"))
    return joined.select(
        *SCAN, "fingerprint",
        F.when(same, F.col("_items")).otherwise(F.col("scan_id")).alias("items_scan"),
        F.when(same, F.col("_epoch")).otherwise(F.lit(epoch)).alias("items_epoch"),
    )


def _updates(mine, moved, scans, due, lead_rows) -> DataFrame:
    """State rows of targets that have a new scan or other open scans; targets without either keep their row."""
    if scans is None:
        return _filled(moved)
    entry = F.struct("scan_id", "epochs", "last_at")
    left = scans.filter("NOT done").groupBy(*KEYS).agg(F.array_sort(F.collect_list(entry)).cast(OPEN).alias("_open"))
    new = moved.select(*KEYS, F.struct("scan_id", "fingerprint", "items_scan", "items_epoch").alias("_new"))
    rows = mine.join(left, list(KEYS), "full").join(new, list(KEYS), "full")
    if due is not None:
        entry = F.struct("scan_id", "version")
        pending = due.dropDuplicates(list(SCAN)).groupBy(*KEYS).agg(F.array_sort(F.collect_list(entry)).cast(DUE).alias("_due"))
        rows = rows.join(pending, list(KEYS), "full")
    else:
        rows = rows.withColumn("_due", F.lit(None).cast(DUE))
    value = lambda c: F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c)
    none, never = F.array().cast(OPEN), F.array().cast(DUE)
    now_open = F.coalesce("_open", none)
    done = F.coalesce(F.col("_new.scan_id"), F.col("scan_id"))
    now_due = F.filter(F.coalesce("_due", never), lambda d: done.isNull() | (d["scan_id"] > done))
    other = ~(F.coalesce("open", none) == now_open) | ~(F.coalesce("due", never) == now_due)
    rows = rows.filter(F.col("_new").isNotNull() | other)
    rows = rows.select(*KEYS, value("scan_id"), value("fingerprint"), value("items_scan"), value("items_epoch"), now_open.alias("open"), now_due.alias("due"))
    return _filled(rows) if lead_rows is None else _filled(rows).unionByName(lead_rows)


def run_epoch_all(
    captures: DataFrame,
    targets: DataFrame,
    specs: Iterable[ItemMonitor | VersionMonitor],
    folder: str,
    sink: str,
    epoch: int,
    close: bool = False,
    delay: timedelta | None = None,
    at_once: int = AT_ONCE,
    buckets: int = BUCKETS,
) -> dict[str, str | None]:
    """One epoch of every monitor on one folder; ``monitor: error``, null where it went well.

    A monitor that failed has written no manifest, so its epoch can be repeated.
    """

    def one(spec: ItemMonitor | VersionMonitor) -> tuple[str, str | None]:
        try:
            run_epoch(captures, targets, spec, folder, sink, epoch, close, delay, buckets)
        except Exception as e:  # noqa: BLE001 - a failing monitor is a result
            return spec.monitor, f"{type(e).__name__}: {e}"
        return spec.monitor, None

    with ThreadPoolExecutor(at_once) as pool:
        return dict(pool.map(one, specs))


# --- late captures ----------------------------------------------------------------


def late_captures(spark: SparkSession, sink: str, monitor: str) -> DataFrame:
    """Captures that landed when their scan was done, with the ``epoch`` they came with."""
    schema = T.StructType([*[f for f in CAPTURES.fields if f.name != "monitor"], T.StructField("epoch", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{sink.rstrip('/')}/late/monitor={monitor}")
    return rows.select(F.lit(monitor).alias("monitor"), *rows.columns)


def repair(
    history: DataFrame,
    targets: DataFrame,
    spec: ItemMonitor | VersionMonitor,
    keys: DataFrame,
    folder: str,
    sink: str,
    epoch: int,
    buckets: int = BUCKETS,
) -> None:
    """Detect anew in the whole ``history`` of the targets in ``keys``, late captures included.

    Reports, changes and state of these targets are replaced as of ``epoch``, an
    epoch of its own; :func:`read_sink` then leaves out what they had before.
    Open scans of theirs count as done.
    """
    spark, monitor = history.sparkSession, spec.monitor
    wanted = [monitor, spec.follows.monitor] if isinstance(spec, ItemMonitor) and spec.follows else [monitor]
    own = targets.filter(F.col("monitor") == monitor)
    chosen = keys.select(F.col("target_id")).distinct()
    mine = history.filter(F.col("monitor") == monitor).join(chosen, "target_id", "left_semi").select(*CAPTURE)
    both = mine.unionByName(history.filter(F.col("monitor").isin(wanted[1:])).select(*CAPTURE)) if wanted[1:] else mine
    reports, changes = detect_changes(both, targets, spec)
    _write(chosen, sink, "repaired", monitor, epoch)
    _write(changes, sink, "changes", monitor, epoch)
    _write(reports, sink, "reports", monitor, epoch)
    with State(spark, state_folder(folder, monitor), epoch, (SCANS, ITEMS), buckets) as state:
        if isinstance(spec, VersionMonitor):
            updates = _filled(newest(version_scans(mine, own, spec).select(*SCAN, "fingerprint", "version")))
        else:
            if spec.follows:
                mine = mine.join(due_scans(both, targets, spec.follows, monitor).select(*SCAN), list(SCAN), "left_semi")
            items, marks = extract(mine, own, spec)
            latest = newest(marks.select(*SCAN, "fingerprint"))
            state.add("items", _as_items(item_rows(items, spec).join(latest.select(*SCAN), list(SCAN), "left_semi"), epoch))
            pointers = {"items_scan": F.col("scan_id"), "items_epoch": F.lit(epoch), "open": F.array().cast(OPEN)}
            updates = _filled(latest.withColumns(pointers))
        state.add("scans", updates.withColumn("epoch", F.lit(epoch)))
        state.commit()


def read_sink(spark: SparkSession, sink: str, name: str, monitor: str) -> DataFrame:
    """``reports`` or ``changes`` of a monitor; of repaired targets only those since."""
    rows = spark.read.parquet(f"{sink.rstrip('/')}/{name}/monitor={monitor}").withColumn("monitor", F.lit(monitor))
    path = f"{sink.rstrip('/')}/repaired/monitor={monitor}"
    if not exists(spark, path):
        return rows
    since = spark.read.schema("target_id string, epoch int").parquet(path).groupBy("target_id").agg(F.max("epoch").alias("_since"))
    return rows.join(since, "target_id", "left").filter(F.col("_since").isNull() | (F.col("epoch") >= F.col("_since"))).drop("_since")
