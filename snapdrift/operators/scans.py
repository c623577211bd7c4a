"""Which captures count, what each scan looks like, and which scan came before.

A scan is one round of captures of one target. Nothing here groups a whole
target into one task: a target may hold a third of all scans.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapdrift.schema import KEYS, SCAN


def delivered(captures: DataFrame, strict: bool = False) -> DataFrame:
    """Replies whose status says that they were delivered, with or without a body."""
    return captures.filter(F.col("status") == 200 if strict else F.col("status").between(200, 299))


def usable_captures(captures: DataFrame, strict: bool = False, min_length: int = 0) -> DataFrame:
    """A2: replies that were delivered; ``strict`` takes status 200 only."""
    usable = delivered(captures, strict).filter(F.col("body").isNotNull())
    return usable.filter(F.length("body") >= min_length) if min_length else usable


def read_bodies(captures: DataFrame, columns: Sequence[Column | str], name: str, keep: Callable) -> DataFrame:
    """``SCAN`` and ``columns`` of those ``captures`` that have a body; ``keep`` stages them.

    A body may be made by an expression. A filter on it, or on what is read from
    it, would be put where the table is scanned: bodies were then made twice,
    and once in the few tasks of a small table. So those without one are left
    out as written.
    """
    rows = captures.select(*SCAN, *columns, F.col("body").isNotNull().alias("_held"))
    return keep(rows, name).filter("_held").drop("_held")


def pick_by_success(captures: DataFrame, roles: Sequence[str], strict: bool = False) -> DataFrame:
    """Per scan the first role that delivered."""
    return first_role(usable_captures(captures, strict), roles)


def first_role(usable: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Of delivered rows those of the first role a scan has; rows of the first role meet no join."""
    taken = usable.filter(F.col("role") == roles[0])
    for role in roles[1:]:
        spare = usable.filter(F.col("role") == role)
        taken = taken.unionByName(spare.join(taken.select(*SCAN), list(SCAN), "left_anti"))
    return taken


def pick_by_configuration(captures: DataFrame, targets: DataFrame, roles: Sequence[str]) -> DataFrame:
    """The first role a target is configured for, delivered or not."""
    first = F.coalesce(*[F.when(F.map_contains_key("attrs", r), F.lit(r)) for r in roles])
    chosen = targets.select(*KEYS, first.alias("role")).filter("role is not null")
    return captures.join(chosen, [*KEYS, "role"], "left_semi")


def _netstring(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat(F.length(s).cast("string"), F.lit(":"), s)), "")


def list_fingerprint(items: Column) -> Column:
    """S2 for one capture: order and repetition count."""
    return F.sha2(_netstring(items), 256)


def set_fingerprint(items: Column) -> Column:
    """S1 for one capture: neither order nor repetition counts."""
    return list_fingerprint(F.sort_array(F.array_distinct(items)))


def text_fingerprint(text: Column) -> Column:
    """S3."""
    return F.sha2(text, 256)


def version_fingerprint(*parts: Column, digits: int = 64) -> Column:
    """Digest of colon-joined fields, optionally shortened."""
    digest = F.sha2(F.concat_ws(":", *parts), 256)
    return digest if digits == 64 else F.substring(digest, 1, digits)


def merged_fingerprint(items: DataFrame, ordered: bool = False) -> DataFrame:
    """S1 and S2 for scans made of many captures: ``SCAN, n_items, fingerprint``.

    Count and xor of digests merge map-side, so a scan of any size needs no
    array. ``items`` holds each (scan, item) once, or each (scan, pos) once.
    """
    element = F.concat_ws(":", "pos", "item") if ordered else F.col("item")
    digest = F.md5(element)
    half = lambda start: F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint")
    merged = items.groupBy(*SCAN).agg(
        F.count("*").alias("n_items"), F.bit_xor(half(1)).alias("_a"), F.bit_xor(half(16)).alias("_b")
    )
    mark = F.concat_ws("-", "n_items", F.lower(F.hex("_a")), F.lower(F.hex("_b")))
    return merged.select(*SCAN, "n_items", mark.alias("fingerprint"))


def with_previous(
    rows: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = KEYS,
    order: str = "scan_id",
    bits: int = 17,
    levels: int = 2,
) -> DataFrame:
    """Add ``previous``, a struct of ``order`` and ``columns`` of the row before.

    Equals ``lag`` over (keys, order) for distinct non-negative integer orders,
    but no window holds more than ``2**bits`` rows: ranges of the order are
    handled apart, and the first row of a range takes the last row of the range
    before. ``levels`` of ranges cover orders below ``2**(bits * (levels + 1))``,
    by default every count of microseconds since 1970.
    """
    value = F.struct(order, *columns)
    if levels == 0:
        return rows.withColumn("previous", F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))
    name = f"_block{levels}"
    block = F.shiftright(order, bits).alias(name)
    within = Window.partitionBy(*keys, name).orderBy(order)
    local = rows.select("*", block).withColumn("_near", F.lag(value).over(within))
    ends = rows.groupBy(*keys, block).agg(F.max_by(value, order).alias("_last"))
    ends = with_previous(ends, ["_last"], keys, name, bits, levels - 1)
    before = ends.select(*keys, name, F.col("previous._last").alias("_before"))
    linked = local.join(before, [*keys, name], "left")
    return linked.withColumn("previous", F.coalesce("_near", "_before")).drop(name, "_near", "_before")


def change_gate(scans: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Scans whose fingerprint differs from that of the scan before.

    The first scan of a target has nothing before it and never passes. Rows
    are the *usable* scans (S12), so a failed one is skipped, not compared.
    """
    linked = with_previous(scans, ["fingerprint", *columns])
    return linked.filter(F.col("previous").isNotNull() & (F.col("previous.fingerprint") != F.col("fingerprint")))


def newest(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per key, the one with the highest ``scan_id``."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), "scan_id").alias("r")).select("r.*")


def baseline_upsert(state: DataFrame, update: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A5: the state after an update replaces the rows of its keys."""
    return newest(state.unionByName(update), keys)


def baseline_read(keys: DataFrame, baseline: DataFrame) -> DataFrame:
    """A4: stored state of each key, nulls when there is none."""
    return keys.join(baseline.withColumnRenamed("scan_id", "baseline_scan"), list(KEYS), "left")
