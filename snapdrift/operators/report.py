"""Counting, ranking and wording of changes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapdrift.schema import SCAN


@dataclass(frozen=True)
class Section:
    """A bucket of a report: heading, size and the wording of one line."""

    bucket: str
    cap: int | None
    line: Callable[[Column, Column], Column]
    heading: str = ""
    separator: str = "\n"


def top_per_bucket(changes: DataFrame, caps: dict[tuple[str, str], int | None], order: str = "item") -> DataFrame:
    """The first rows of each (scan, op, bucket), with their rank ``rn``.

    Spark keeps only the leading rows of each group before it shuffles.
    """
    within = Window.partitionBy(*SCAN, "op", "bucket").orderBy(order, "item")
    ranked = changes.withColumn("rn", F.row_number().over(within))
    bounded = [c for c in caps.values() if c is not None]
    if len(bounded) == len(caps):
        ranked = ranked.filter(F.col("rn") <= max(bounded))
    if len(set(caps.values())) > 1:
        limit = F.coalesce(
            *[F.when((F.col("op") == o) & (F.col("bucket") == b), c) for (o, b), c in caps.items() if c is not None]
        )
        ranked = ranked.filter(limit.isNull() | (F.col("rn") <= limit))
    return ranked


def change_counts(changes: DataFrame) -> DataFrame:
    """Rows per scan and direction, and how many of them have a bucket."""
    added, removed, kept = F.col("op") == "added", F.col("op") == "removed", F.col("bucket").isNotNull()
    return changes.groupBy(*SCAN).agg(
        F.count_if(added).alias("n_added"),
        F.count_if(removed).alias("n_removed"),
        F.count_if(added & kept).alias("n_kept_added"),
        F.count_if(removed & kept).alias("n_kept_removed"),
    )


def magnitude_guard(changes: DataFrame, op: str, below: int) -> DataFrame:
    """Changes of scans with fewer than ``below`` rows of ``op``."""
    small = changes.filter(F.col("op") == op).groupBy(*SCAN).count().filter(F.col("count") < below)
    return changes.filter(F.col("op") == op).join(small.select(*SCAN), list(SCAN), "left_semi")


def section_text(lines: Column, sections: Sequence[Section], joiner: str) -> Column:
    """Sections in order, each a heading and its lines; empty ones vanish."""
    parts = []
    for s in sections:
        own = F.transform(F.filter(lines, lambda x: x["bucket"] == s.bucket), lambda x: x["line"])  # noqa: B023
        text = F.concat(F.lit(s.heading), F.array_join(own, s.separator))
        parts.append(F.when(F.size(own) > 0, text))
    return F.concat_ws(joiner, *parts)


FOOTER = "snapdrift"


def alert_payload(reports: DataFrame, at: Column | None = None, footer: str = FOOTER) -> DataFrame:
    """The message of an alert made ``at`` a time (now), cut to what a receiver accepts."""
    made = F.to_utc_timestamp(F.current_timestamp() if at is None else at, F.current_timezone())
    stamp = F.concat(F.date_format(made, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    fields = F.slice("fields", 1, 25)
    payload = F.struct(
        F.concat(F.lit("🔍 "), "alert_title").alias("title"),
        F.substring("description", 1, 4000).alias("description"),
        F.col("color"),
        stamp.alias("timestamp"),
        F.struct(F.lit(footer).alias("text")).alias("footer"),
        F.when(F.col("url") != "", F.col("url")).alias("url"),
        F.when(F.size("fields") > 0, fields).alias("fields"),
    )
    return reports.select(*SCAN, F.to_json(payload, {"ignoreNullFields": "true"}).alias("payload"))


def detection_rows(reports: DataFrame, at: Column | None = None) -> DataFrame:
    """Rows of the detections log, detected ``at`` a time (now); alerts without a type are not logged."""
    logged = reports.filter(F.col("detection_type").isNotNull())
    return logged.select(
        "monitor", F.col("log_target").alias("target_id"), "scan_id", "detection_type",
        F.col("log_title").alias("title"), "details", (F.current_timestamp() if at is None else at).alias("detected_at"),
    )
