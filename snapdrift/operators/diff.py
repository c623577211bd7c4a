"""Differences between a scan and the scan before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdrift.schema import KEYS, SCAN


def explode_items(captures: DataFrame, entries: Column) -> DataFrame:
    """One row per entry of each capture, numbered in feed order."""
    rows = captures.select(*SCAN, F.posexplode(entries).alias("pos", "e"))
    return rows.select(*SCAN, "pos", "e.item", "e.detail")


def distinct_items(items: DataFrame) -> DataFrame:
    """Each (scan, item) once.

    Rows without a key can match nothing. Dropping them here keeps the plan
    the same for every reader, so fingerprint and diff share one shuffle.
    """
    keyed = F.col(SCAN[0]).isNotNull() & F.col(SCAN[1]).isNotNull() & F.col(SCAN[2]).isNotNull()
    return items.select(*SCAN, "item").filter(keyed).distinct()


def dedupe_preserve_first(items: DataFrame) -> DataFrame:
    """One row per (scan, item) at its first position; the last detail wins."""
    return items.groupBy(*SCAN, "item").agg(
        F.min("pos").alias("pos"), F.max_by("detail", "pos").alias("detail")
    )


def history_diff(items: DataFrame, changed: DataFrame) -> DataFrame:
    """Items added to and removed from every changed scan of a history.

    Each item row is tagged with the scans it is compared in, as present or as
    past, and one aggregation keyed by (target, scan, item) settles both
    directions. The key includes item and scan, so neither a busy target nor
    an item that never leaves gathers in one task, and repeats fold map-side.
    """
    tags = changed.select(
        *KEYS,
        F.col("scan_id").alias("at"),
        F.explode(
            F.array(
                F.struct(F.col("scan_id").alias("scan_id"), F.lit(True).alias("now")),
                F.struct(F.col("previous.scan_id").alias("scan_id"), F.lit(False).alias("now")),
            )
        ).alias("tag"),
    ).select(*KEYS, "at", "tag.scan_id", "tag.now")
    tagged = items.join(tags, list(SCAN)).withColumn("scan_id", F.col("at"))
    aggregates = [F.bool_or("now").alias("_any"), F.bool_and("now").alias("_all")]
    if "pos" in items.columns:
        aggregates.append(F.min(F.when(F.col("now"), F.col("pos"))).alias("pos"))
    if "detail" in items.columns:
        aggregates.append(F.max_by(F.when(F.col("now"), F.col("detail")), F.when(F.col("now"), F.col("pos"))).alias("detail"))
    sides = tagged.groupBy(*SCAN, "item").agg(*aggregates)
    op = F.when(F.col("_all"), "added").otherwise("removed").alias("op")
    rest = [c for c in ("pos", "detail") if c in items.columns]
    return sides.filter(F.col("_any") == F.col("_all")).select(*SCAN, op, "item", *rest)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """S6 for two snapshots: items of one side only, in one shuffle."""
    cols = [*keys, "item"]
    both = old.select(*cols, F.lit(False).alias("now")).unionByName(new.select(*cols, F.lit(True).alias("now")))
    sides = both.groupBy(*cols).agg(F.bool_or("now").alias("_any"), F.bool_and("now").alias("_all"))
    op = F.when(F.col("_all"), "added").otherwise("removed").alias("op")
    return sides.filter(F.col("_any") == F.col("_all")).select(*keys, op, "item")


def ordered_new(items: DataFrame, changed: DataFrame) -> DataFrame:
    """Entries the scan before does not hold, feed order and repeats kept."""
    pairs = changed.select(*SCAN, F.col("previous.scan_id").alias("before"))
    current = items.join(pairs, list(SCAN))
    old = items.select(*KEYS, F.col("scan_id").alias("before"), "item").distinct()
    return current.join(old, [*KEYS, "before", "item"], "left_anti").drop("before")


def first_seen(items: DataFrame) -> DataFrame:
    """First and last scan in which a target showed an item."""
    return items.groupBy(*KEYS, "item").agg(
        F.min("scan_id").alias("first_seen"), F.max("scan_id").alias("last_seen")
    )
