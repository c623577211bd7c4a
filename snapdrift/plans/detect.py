"""The shared plan of all monitors: extract, gate, diff, rank, word.

A monitor is data (:mod:`snapdrift.plans.monitors`); this module turns it into
a DataFrame of reports. Planning may run jobs: what several parts of the plan
read is written to the shared folder first (:mod:`snapdrift.sources.staging`).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdrift.functions.text import keyword_regex
from snapdrift.operators.diff import distinct_items, history_diff, ordered_new
from snapdrift.operators.report import Section, change_counts, section_text, top_per_bucket
from snapdrift.operators.scans import (
    change_gate,
    delivered,
    list_fingerprint,
    merged_fingerprint,
    read_bodies,
    set_fingerprint,
    usable_captures,
    with_previous,
)
from snapdrift.schema import KEPT_CHANGES, KEYS, SCAN
from snapdrift.sources.staging import noted, release, stage, written

ENTRY = "array<struct<item:string,detail:map<string,string>>>"
FIELDS = "array<struct<name:string,value:string,inline:boolean>>"


def phrase(template: str, **values: Column) -> Column:
    """A template with ``{name}`` holes as one column; a null reads as empty."""
    parts = []
    for text in re.split(r"(\{\w+\})", template):
        name = text[1:-1]
        if text.startswith("{") and name in values:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        elif text:
            parts.append(F.lit(text))
    return F.concat(*parts)


def fields(*rows: tuple[str, Column, bool]) -> Column:
    return F.array(
        *[F.struct(F.lit(n).alias("name"), v.alias("value"), F.lit(i).alias("inline")) for n, v, i in rows]
    ).cast(FIELDS)


@dataclass(frozen=True)
class Alert:
    """What is said about the added or the removed items of a scan.

    Callables take the columns of a reported scan as a namespace: ``target``
    (struct), ``target_id``, ``info`` and the counts of :func:`change_counts`.
    """

    op: str
    bucket: Callable[[Column, Column, Column], Column]
    sections: tuple[Section, ...]
    title: str
    head: str
    color: int
    url: str = "{url}"
    fence: bool = False
    joiner: str = "\n"
    below: int | None = None  # changes from which a report is marked oversize
    detection_type: str | None = None
    log_title: str = ""
    log_target: str = "{target_id}"
    fields: Callable[[], Column] | None = None
    first_link: str | None = None


@dataclass(frozen=True)
class ItemMonitor:
    """A monitor that compares items.

    ``mode`` is ``set``, ``list`` (order and repeats count) or ``current``
    (any change reports the whole scan). ``collect`` replaces ``entries`` when
    the items of one scan come from several captures; it returns the items and
    the scans that took place. ``choose`` picks one of several sources among
    delivered rows with ``role`` and ``entries``. ``entries`` that read the
    ``target`` are ``targeted``.
    With ``follows`` only scans in which that monitor saw a new version, or the
    target for the first time, take part. A monitor that ``searches`` looks for
    a target's keywords or patterns in its changes.
    """

    monitor: str
    alerts: tuple[Alert, ...]
    entries: Callable[[], Column] | None = None
    collect: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None
    choose: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    mode: str = "set"
    guarded: bool = True
    strict: bool = False
    order: str = "item"
    detailed: bool = False
    follows: VersionMonitor | None = None
    searches: bool = False
    targeted: bool = False


@dataclass(frozen=True)
class VersionMonitor:
    """A monitor that compares one version record per scan."""

    monitor: str
    title: str
    text: str
    color: int
    url: str
    detection_type: str
    log_title: str
    record: Callable[[], Column] | None = None
    collect: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    strict: bool = True
    no_notes: str = ""
    notes_clip: int = 500
    fields: Callable[[], Column] | None = None


def with_target(df: DataFrame, targets: DataFrame, searched: bool = False) -> DataFrame:
    """Attach the watchlist row as ``target``; unlisted targets drop out.

    The join side is left to the optimizer: it broadcasts a watchlist below
    the size limit and splits skewed keys of a larger one. Rows that are to be
    ``searched`` get the target's keywords as one regex and are put in the order
    of their targets, so that it is compiled once for each.
    """
    columns = ["name", "ticker", "url", "domain", "keywords", "patterns", "attrs"]
    if searched:
        columns.append(keyword_regex(F.col("keywords")).alias("keyword_regex"))
        df = df.sortWithinPartitions(*KEYS)
    return df.join(targets.select(*KEYS, F.struct(*columns).alias("target")), list(KEYS))


def _columns(spec: ItemMonitor) -> list[str]:
    extra = [c for c, on in (("pos", spec.order == "pos" or spec.detailed), ("detail", spec.detailed)) if on]
    return [*SCAN, "item", *extra]


def _single(captures: DataFrame, targets: DataFrame, spec: ItemMonitor) -> tuple[DataFrame, DataFrame]:
    """Items and scans when each scan is one capture.

    Bodies are read where they lie; the watchlist, and a choice among several
    sources, meet the entries. Only a monitor whose extraction is ``targeted``
    brings a target's columns to the bodies.
    """
    rows = delivered(captures, spec.strict)
    if spec.targeted:
        rows = with_target(rows, targets)
    entries = F.coalesce(spec.entries().cast(ENTRY), F.array().cast(ENTRY))
    items = F.transform("entries", lambda e: e["item"])
    mark = set_fingerprint(items) if spec.mode == "set" else list_fingerprint(items)
    marked = lambda read, name: stage(read.withColumn("fingerprint", mark), name)
    rows = read_bodies(rows, ["role", entries.alias("entries")], spec.monitor, marked)
    if not spec.targeted:
        rows = rows.join(targets.select(*KEYS), list(KEYS), "left_semi")
    if spec.choose:
        rows = spec.choose(rows, targets)
    if spec.guarded:
        rows = rows.filter(F.size("entries") > 0)
    return rows.select(*SCAN, "entries"), rows.select(*SCAN, "fingerprint")


def _open(rows: DataFrame, spec: ItemMonitor) -> DataFrame:
    """Rows of ``entries`` as item rows."""
    if "entries" not in rows.columns:
        return rows
    opened = rows.select(*[c for c in rows.columns if c != "entries"], F.posexplode("entries").alias("pos", "e"))
    kept = [c for c in rows.columns if c != "entries"]
    return opened.select(*kept, "pos", F.col("e.item").alias("item"), F.col("e.detail").alias("detail"))


def _merged(captures: DataFrame, targets: DataFrame, spec: ItemMonitor) -> tuple[DataFrame, DataFrame]:
    """Items and scans when a scan spans captures.

    Deduplication, fingerprint and diff start from the same shuffle.
    """
    behind, own = [], []
    with noted(behind):
        raw, took_place = spec.collect(captures, targets)
    aggregates = [a for c, a in (("pos", F.min("pos").alias("pos")), ("detail", F.max_by("detail", "pos").alias("detail"))) if c in _columns(spec)]
    items = raw.groupBy(*SCAN, "item").agg(*aggregates) if aggregates else distinct_items(raw)
    with noted(own):
        items = stage(items, spec.monitor)
    marks = merged_fingerprint(items).select(*SCAN, "fingerprint")
    if spec.guarded:
        if own:  # written: what the items were made of is read no more
            release(items.sparkSession, behind)
        return items, marks
    empty = F.coalesce("fingerprint", F.lit("0"))
    return items, took_place.select(*SCAN).distinct().join(marks, list(SCAN), "left").withColumn("fingerprint", empty)


def extract(captures: DataFrame, targets: DataFrame, spec: ItemMonitor) -> tuple[DataFrame, DataFrame]:
    """``(items, scans)`` of a monitor; scans carry ``fingerprint``."""
    return _merged(captures, targets, spec) if spec.collect else _single(captures, targets, spec)


def item_rows(items: DataFrame, spec: ItemMonitor) -> DataFrame:
    """One row per item with the columns ``spec`` compares and words."""
    return _open(items, spec).select(*_columns(spec))


def compare(items: DataFrame, scans: DataFrame, spec: ItemMonitor) -> DataFrame:
    """``SCAN, op, item`` of every changed scan."""
    changed = change_gate(scans)
    rows = item_rows(items, spec)
    if spec.mode == "set":
        return history_diff(rows, changed)
    if spec.mode == "list":
        return ordered_new(rows, changed).withColumn("op", F.lit("added"))
    return rows.join(changed.select(*SCAN), list(SCAN), "left_semi").withColumn("op", F.lit("added"))


def _words(row: dict[str, Column]) -> Callable[[str], Column]:
    return lambda template: phrase(template, **row)


def _target_words() -> dict[str, Column]:
    t = F.col("target")
    return {
        "name": t["name"],
        "ticker": t["ticker"],
        "url": t["url"],
        "domain": t["domain"],
        "org": t["attrs"]["org"],
        "package": F.coalesce(t["attrs"]["package"], F.col("target_id")),
        "target_id": F.col("target_id"),
    }


def bucketed(changes: DataFrame, targets: DataFrame, spec: ItemMonitor) -> DataFrame:
    """``changes`` of listed targets with their ``bucket``; null if an alert does not report them."""
    rows = with_target(changes, targets, spec.searches)
    detail = F.col("detail") if spec.detailed else F.lit(None)
    bucket = F.coalesce(*[F.when(F.col("op") == a.op, a.bucket(F.col("item"), detail, F.col("target"))) for a in spec.alerts])
    # counts, rankings and the table of changes read this: patterns are searched once per change
    keep = written if spec.searches else stage
    rows = rows.select(*changes.columns, bucket.cast("string").alias("bucket"))
    # a change that no alert reports is counted and not shown: its row is kept, its words are not
    unseen = {c: F.when(F.col("bucket").isNotNull(), F.col(c)) for c in ("item", "detail") if c in changes.columns}
    return keep(rows.withColumns(unseen), f"{spec.monitor}-changes")


def kept_changes(rows: DataFrame) -> DataFrame:
    """Every change that has a bucket, whole: what :func:`word` shows the first lines of."""
    detail = F.col("detail") if "detail" in rows.columns else F.lit(None).cast(KEPT_CHANGES["detail"].dataType)
    return rows.filter(F.col("bucket").isNotNull()).select(*SCAN, "op", "bucket", "item", detail.alias("detail"))


def version_changes(changed: DataFrame, targets: DataFrame) -> DataFrame:
    """Version transitions of listed targets in the layout of :func:`kept_changes`, notes whole."""
    kind = KEPT_CHANGES["detail"].dataType
    own = F.map_filter(F.coalesce(F.col("detail"), F.create_map().cast(kind)), lambda k, v: ~k.isin("old_version", "notes"))
    more = F.create_map(F.lit("old_version"), F.col("old_version"), F.lit("notes"), F.col("notes"))
    op = F.lit("version")
    rows = with_target(changed, targets)
    return rows.select(*SCAN, op.alias("op"), op.alias("bucket"), F.col("version").alias("item"), F.map_concat(own, more).alias("detail"))


def word(rows: DataFrame, targets: DataFrame, spec: ItemMonitor, info: DataFrame | None = None) -> DataFrame:
    """Reports of :func:`bucketed` changes: one row per scan and alert that has something to say."""
    item = F.col("item")
    detail = F.col("detail") if spec.detailed else F.lit(None)
    line = F.coalesce(
        *[
            F.when((F.col("op") == a.op) & (F.col("bucket") == s.bucket), s.line(item, detail))
            for a in spec.alerts
            for s in a.sections
        ]
    )
    link = F.lit(None).cast("string")
    for a in spec.alerts:
        if a.first_link:
            link = detail[a.first_link]
    caps = {(a.op, s.bucket): s.cap for a in spec.alerts for s in a.sections}
    top = top_per_bucket(rows.filter(F.col("bucket").isNotNull()), caps, spec.order)
    lines = top.groupBy(*SCAN).agg(
        F.sort_array(
            F.collect_list(F.struct("op", "bucket", "rn", line.alias("line"), link.alias("link")))
        ).alias("lines")
    )
    scans = with_target(lines.join(change_counts(rows), list(SCAN)), targets)
    if info is not None:
        scans = scans.join(info, list(SCAN), "left")
    reports = [_alert(scans, a, info is not None) for a in spec.alerts]
    if len(reports) == 1:
        return reports[0]
    kinds = scans.withColumn("_kind", F.explode(F.array(*[F.lit(a.op) for a in spec.alerts])))
    both = [_alert_columns(a, info is not None) for a in spec.alerts]
    merged = {
        name: F.coalesce(*[F.when(F.col("_kind") == a.op, cols[name]) for a, cols in zip(spec.alerts, both)])
        for name in both[0]
    }
    keep = F.coalesce(*[F.when(F.col("_kind") == a.op, _has(a)) for a in spec.alerts])
    return kinds.filter(keep).select(*SCAN, *[c.alias(n) for n, c in merged.items()])


def _own(a: Alert) -> Column:
    return F.filter("lines", lambda x: x["op"] == a.op)


def _has(a: Alert) -> Column:
    return F.size(_own(a)) > 0


def _alert_columns(a: Alert, with_info: bool) -> dict[str, Column]:
    row = _target_words() | {
        "n": F.col(f"n_kept_{a.op}"),
        "n_added": F.col("n_added"),
        "n_removed": F.col("n_removed"),
    }
    row["version"] = F.coalesce(F.col("info")["version"], F.lit("?")) if with_info else F.lit("?")
    say = _words(row)
    text = section_text(_own(a), a.sections, a.joiner)
    shown = F.concat(F.lit("```diff\n"), text, F.lit("\n```")) if a.fence else text
    if a.first_link:
        url = F.sort_array(_own(a))[0]["link"]
    elif a.url == "{url}":
        url = F.col("target.url")
    else:
        url = say(a.url)
    logged = a.detection_type is not None
    return {
        "detection_type": F.lit(a.detection_type).cast("string"),
        "log_target": say(a.log_target),
        "log_title": say(a.log_title) if logged else F.lit(None).cast("string"),
        "details": text if logged else F.lit(None).cast("string"),
        "alert_title": say(a.title),
        "description": F.concat(say(a.head), F.lit("\n\n"), shown),
        "color": F.lit(a.color),
        "url": url,
        "fields": a.fields() if a.fields else F.array().cast(FIELDS),
        "oversize": F.lit(False) if a.below is None else F.col(f"n_{a.op}") >= a.below,
    }


def _alert(scans: DataFrame, a: Alert, with_info: bool) -> DataFrame:
    columns = _alert_columns(a, with_info)
    return scans.filter(_has(a)).select(*SCAN, *[c.alias(n) for n, c in columns.items()])


def version_scans(captures: DataFrame, targets: DataFrame, spec: VersionMonitor) -> DataFrame:
    """``SCAN, fingerprint, version, notes, detail`` of scans with a record."""
    if spec.collect:
        rows = spec.collect(usable_captures(captures, spec.strict), targets)
        rows = stage(rows, spec.monitor)
    else:
        rows = read_bodies(delivered(captures, spec.strict), [spec.record().alias("record")], spec.monitor, stage)
    rows = rows.filter(F.col("record").isNotNull())
    return rows.select(*SCAN, F.col("record.state").alias("fingerprint"), "record.version", "record.notes", "record.detail")


def version_transition(scans: DataFrame) -> DataFrame:
    """Changed versions with ``old_version``; an empty old one is ``unknown``."""
    changed = change_gate(scans, ["version"])
    old = F.col("previous.version")
    return changed.withColumn("old_version", F.when(old.isNull() | (old == ""), "unknown").otherwise(old))


def due_scans(captures: DataFrame, targets: DataFrame, lead: VersionMonitor, monitor: str) -> DataFrame:
    """Scans ``monitor`` has to make: a first sight or a new version in ``lead``.

    The followed target's package, if it names one, is the target to look at.
    """
    own = targets.filter(F.col("monitor") == lead.monitor)
    return due_of(version_scans(captures.filter(F.col("monitor") == lead.monitor), own, lead), own, monitor)


def due_of(seen: DataFrame, own: DataFrame, monitor: str, stored: DataFrame | None = None) -> DataFrame:
    """:func:`due_scans` of the lead's version scans ``seen``, with those that are ``stored`` only before them."""
    seen = seen.select(*SCAN, "fingerprint", "version")
    chain = seen if stored is None else seen.unionByName(stored.select(*seen.columns))
    linked = with_previous(chain, ["fingerprint"])
    due = linked.filter(F.col("previous").isNull() | (F.col("previous.fingerprint") != F.col("fingerprint")))
    due = due if stored is None else due.join(stored.select(*SCAN), list(SCAN), "left_anti")
    package = F.coalesce(F.col("target.attrs")["package"], F.col("target_id")).alias("target_id")
    return with_target(due, own).select(F.lit(monitor).alias("monitor"), package, "scan_id", "version")


def word_versions(changed: DataFrame, targets: DataFrame, spec: VersionMonitor) -> DataFrame:
    rows = with_target(changed, targets)
    notes = F.when(F.col("notes") == "", F.lit(spec.no_notes)).otherwise(F.substring("notes", 1, spec.notes_clip))
    shown_name = F.when(F.coalesce(F.col("detail")["name"], F.lit("")) == "", "No title").otherwise(F.col("detail")["name"])
    move = F.when(F.col("version") != "", phrase("**{old} → {new}**\n\n", old=F.col("old_version"), new=F.col("version")))
    row = _target_words() | {
        "old": F.col("old_version"),
        "version": F.col("version"),
        "notes": notes,
        "bundle": F.col("detail")["bundle"],
        "store_url": F.col("detail")["url"],
        "page": F.col("detail")["html_url"],
        "release_name": shown_name,
        "move": move,
    }
    say = _words(row)
    return rows.select(
        *SCAN,
        F.lit(spec.detection_type).alias("detection_type"),
        F.col("target_id").alias("log_target"),
        say(spec.log_title).alias("log_title"),
        F.col("notes").alias("details"),
        say(spec.title).alias("alert_title"),
        say(spec.text).alias("description"),
        F.lit(spec.color).alias("color"),
        say(spec.url).alias("url"),
        (spec.fields() if spec.fields else F.array().cast(FIELDS)).alias("fields"),
        F.lit(False).alias("oversize"),
    )


def detect(captures: DataFrame, targets: DataFrame, spec: ItemMonitor | VersionMonitor) -> DataFrame:
    """Reports for a history of captures."""
    return detect_changes(captures, targets, spec)[0]


def detect_changes(captures: DataFrame, targets: DataFrame, spec: ItemMonitor | VersionMonitor) -> tuple[DataFrame, DataFrame]:
    """Reports for a history of captures, and every kept change behind them.

    Once the changes are written, what was staged to find them is removed.
    """
    landed, watchlist = captures, targets
    captures = captures.filter(F.col("monitor") == spec.monitor)
    targets = targets.filter(F.col("monitor") == spec.monitor)
    behind, own = [], []
    if isinstance(spec, VersionMonitor):
        with noted(behind):
            scans = version_scans(captures, targets, spec)
        with noted(own):
            changed = stage(version_transition(scans), f"{spec.monitor}-changes")
        if own:
            release(landed.sparkSession, behind)
        return word_versions(changed, targets, spec), version_changes(changed, targets)
    info = None
    if spec.follows:
        due = due_scans(landed, watchlist, spec.follows, spec.monitor)
        captures = captures.join(due.select(*SCAN), list(SCAN), "left_semi")
        info = due.select(*SCAN, F.create_map(F.lit("version"), F.col("version")).alias("info"))
    with noted(behind):
        items, scans = extract(captures, targets, spec)
    with noted(own):
        rows = bucketed(compare(items, scans, spec), targets, spec)
    if own:
        release(landed.sparkSession, behind)
    return word(rows, targets, spec, info), kept_changes(rows)

