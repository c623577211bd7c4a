"""Capture histories derived from ordinary tables.

The engine reads captures; these functions view other tables as captures, so
that every job can run on whatever tables are at hand. All are projections
without a shuffle. Scan ids are the tables' own ids, which only have to grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdrift.schema import CAPTURES, TARGETS
from snapdrift.sources.staging import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose texts are to be taken apart."""
    return spread(table(spark, folder, name))


def as_captures(
    df: DataFrame,
    monitor: str,
    target_id: Column,
    scan_id: Column,
    body: Column,
    status: Column | None = None,
    url: Column | None = None,
    role: Column | None = None,
    captured_at: Column | None = None,
) -> DataFrame:
    """``df`` in the captures layout."""
    values = {
        "monitor": F.lit(monitor),
        "target_id": target_id,
        "scan_id": scan_id,
        "captured_at": F.lit(None) if captured_at is None else captured_at,
        "status": F.lit(200) if status is None else status,
        "content_type": F.lit(None),
        "url": F.lit(None) if url is None else url,
        "role": F.lit(None) if role is None else role,
        "body": body,
    }
    return df.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in CAPTURES.fields])


def as_targets(df: DataFrame, monitor: str, target_id: Column, **columns: Column) -> DataFrame:
    """Distinct ``target_id`` of ``df`` in the watchlist layout."""
    keys = df.select(target_id.cast("string").alias("target_id")).distinct()
    empty = {"keywords": F.array(), "patterns": F.array(), "attrs": F.create_map(), "name": F.col("target_id")}
    values = {"monitor": F.lit(monitor), "target_id": F.col("target_id")} | empty | columns
    return keys.select(
        *[values.get(f.name, F.lit("")).cast(f.dataType).alias(f.name) for f in TARGETS.fields]
    )


LATER = 1_000_000_000  # scan ids of failed feed captures, beyond the real ones


def document_captures(spark: SparkSession, folder: str, monitor: str = "docs") -> DataFrame:
    """Documents as the page history of their source, with failed and empty scans between them."""
    d = text_table(spark, folder, "documents")
    real = as_captures(d, monitor, F.col("source"), F.col("doc_id") * 2, F.col("text"))
    fails = F.col("doc_id") % 7 == 0
    odd = table(spark, folder, "documents").filter(fails | (F.col("doc_id") % 11 == 0))
    status, body = F.when(fails, 500).otherwise(200), F.when(fails, "gone").otherwise("")
    return real.unionByName(as_captures(odd, monitor, F.col("source"), F.col("doc_id") * 2 + 1, body, status))


def document_targets(spark: SparkSession, folder: str, monitor: str = "docs") -> DataFrame:
    number = F.regexp_extract("target_id", "([0-9]+)$", 1).cast("int")
    keywords = F.when(number % 3 == 1, F.array(F.lit("Lorem"), F.lit("with"))).otherwise(F.array())
    return as_targets(
        table(spark, folder, "documents"), monitor, F.col("source"),
        keywords=keywords, url=F.concat(F.lit("https://"), F.col("target_id"), F.lit(".example.com/")),
    )


HOST = r"^https?://([^/?#]+)"


def host(url: Column) -> Column:
    return F.regexp_extract(url, HOST, 1)


def page_captures(spark: SparkSession, folder: str, monitor: str, body: Column | None = None, role: Column | None = None) -> DataFrame:
    """Web pages as the history of their host."""
    pages = text_table(spark, folder, "pages")
    html = F.col("html") if body is None else body
    return as_captures(pages, monitor, host(F.col("url")), F.col("page_id"), html, url=F.col("url"), role=role)


def page_targets(spark: SparkSession, folder: str, monitor: str, **columns: Column) -> DataFrame:
    domain = F.regexp_replace("target_id", r"^(?:www|blog|m)\.", "")
    values = {"domain": domain, "url": F.concat(F.lit("https://"), F.col("target_id"), F.lit("/a/b"))} | columns
    return as_targets(table(spark, folder, "pages"), monitor, host(F.col("url")), **values)


def event_items(spark: SparkSession, folder: str) -> DataFrame:
    """Daily sets of event kinds per user, as items."""
    e = table(spark, folder, "events")
    day = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).cast("bigint")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.lit("events").alias("monitor"),
        F.col("user_id").cast("string").alias("target_id"),
        day.alias("scan_id"),
        F.concat_ws(":", "event_type", k).alias("item"),
    )


def shipment_items(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly sets of parts shipped per supplier, as items."""
    d = F.col("l_shipdate")
    month = ((F.year(d) - 1995) * 12 + F.month(d) - 1).cast("bigint")
    return table(spark, folder, "lineitem").select(
        F.lit("shipments").alias("monitor"),
        F.col("l_suppkey").cast("string").alias("target_id"),
        month.alias("scan_id"),
        F.col("l_partkey").cast("string").alias("item"),
    )


def order_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as the version history of their customer."""
    return table(spark, folder, "orders").select(
        F.lit("orders").alias("monitor"),
        F.col("o_custkey").cast("string").alias("target_id"),
        F.col("o_orderkey").alias("scan_id"),
        F.col("o_orderstatus").alias("version"),
        F.col("o_orderpriority").alias("notes"),
    )


def feed_captures(spark: SparkSession, folder: str, monitor: str, body, role: Column | None = None, url: Column | None = None) -> DataFrame:
    """Parts as the feed history of their brand.

    ``body(entries, part)`` renders a window of consecutive entry numbers that
    slides with the part key, so neighbouring scans overlap.
    """
    part = text_table(spark, folder, "part")
    first = F.expr("p_partkey div 30")
    last = first + F.col("p_size") % 6
    entries = F.sequence(first, last)
    real = as_captures(part, monitor, F.col("p_brand"), F.col("p_partkey"), body(entries), role=role, url=url)
    odd = table(spark, folder, "part").filter(F.col("p_partkey") % 7 == 0)
    failed = as_captures(
        odd, monitor, F.col("p_brand"), F.col("p_partkey") + LATER, body(entries), F.lit(500), role=role, url=url
    )
    return real.unionByName(failed)


def brand_number() -> Column:
    return F.split_part(F.col("target_id"), F.lit("#"), F.lit(2)).cast("int")


def feed_targets(spark: SparkSession, folder: str, monitor: str, **columns: Column) -> DataFrame:
    n = brand_number()
    keywords = (
        F.when(n % 3 == 1, F.array(F.lit("Beta"), F.lit("7"))).when(n % 3 == 2, F.array(F.lit("alpha"))).otherwise(F.array())
    )
    values = {
        "name": F.concat(F.lit("Name "), F.col("target_id")),
        "ticker": F.concat(F.lit("T"), n.cast("string")),
        "url": F.concat(F.lit("https://feed.example.com/"), n.cast("string")),
        "domain": F.concat(F.lit("b"), n.cast("string"), F.lit(".example.com")),
        "keywords": keywords,
        "attrs": F.create_map(F.lit("org"), F.concat(F.lit("org"), n.cast("string"))),
    } | columns
    return as_targets(table(spark, folder, "part"), monitor, F.col("p_brand"), **values)
