"""Items whose scan spans several captures or another table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdrift.functions import filters as flt
from snapdrift.functions import fixed_values as fv
from snapdrift.functions import patterns as p
from snapdrift.functions import text as t
from snapdrift.operators import page_extractors as page
from snapdrift.operators.diff import distinct_items
from snapdrift.operators.scans import delivered, read_bodies, usable_captures
from snapdrift.schema import KEYS, SCAN
from snapdrift.sources.staging import dealt, stage, written

FOLDED = 4


def bundle_urls(captures: DataFrame, targets: DataFrame) -> DataFrame:
    """The script addresses of each page; its target's address meets what was read, not the page.

    References unfold into far more rows than their size in a file tells: scans
    are dealt anew before they unfold, and by an outer join only the watchlist
    may be broadcast, never they. Of unlisted targets nothing unfolds.
    """
    pages = delivered(captures).filter("role = 'page'")
    refs = read_bodies(pages, [page.script_refs(F.col("body")).alias("refs")], "script-refs", stage)
    listed = targets.select(*KEYS, F.col("url").alias("base"), F.lit(True).alias("listed"))
    based = dealt(refs.join(listed, list(KEYS), "left"), *SCAN)
    addresses = F.when(F.col("listed"), page.script_addresses(F.col("refs"), F.col("base")))
    return based.select(*SCAN, F.explode(addresses).alias("url"))


def bundle_items(captures: DataFrame, targets: DataFrame, entries: Column) -> tuple[DataFrame, DataFrame]:
    """``SCAN, url, entries`` of delivered scripts that their page names, and the scans that have one.

    Scripts are read where they lie, without those of trackers, which no page
    counts as naming; what meets the pages' addresses is the entries, no body.
    A body may be made by an expression: no filter looks at it, which would make
    it once more, and those that are missing are left out as written.
    """
    bundles = delivered(captures).filter(F.col("role") == "bundle").filter(~F.lower("url").rlike(p.TRACKER_WORDS))
    read = written(bundles.select(*SCAN, "url", F.when(F.col("body").isNotNull(), entries).alias("entries")), "bundles")
    read = read.filter(F.col("entries").isNotNull())
    named = read.join(bundle_urls(captures, targets), [*SCAN, "url"], "left_semi")
    return named, named.select(*SCAN)


def sitemap_urls(captures: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Page addresses of a sitemap and of every sitemap below it. Returns the items and the root captures.

    Each body is read once, into rows of addresses; what is reached from the
    roots is then found among the narrow edges from sitemap to sitemap.
    """
    found = ["url", page.page_locations(F.col("body")).alias("pages"), page.child_sitemaps(F.col("body")).alias("children")]
    listed = read_bodies(delivered(captures), found, "sitemaps", written)
    roots = listed.select(*SCAN, "url").join(targets.select(*KEYS, "url"), [*KEYS, "url"], "left_semi")
    edges = listed.select(*SCAN, "url", F.explode("children").alias("child"))
    found = reached(roots.distinct(), edges)
    items = listed.filter(F.size("pages") > 0).join(found, [*SCAN, "url"], "left_semi")
    return items.select(*SCAN, F.explode("pages").alias("item")), roots.select(*SCAN)


def reached(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``SCAN, url`` of the roots and of all that ``edges (SCAN, url, child)`` lead to; cycles end.

    Every round follows the edges of what the last one found, until it finds
    nothing new; rows are addresses, and each round's are written.
    """
    key = [*SCAN, "url"]
    levels = [written(roots, "sitemap-level")]
    edges = written(edges.distinct(), "sitemap-edges")
    while True:
        below = edges.join(levels[-1], key).select(*SCAN, F.col("child").alias("url")).distinct()
        for level in levels:
            below = below.join(level, key, "left_anti")
        below = written(below, "sitemap-level")
        if below.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(below)
        if len(levels) > FOLDED:  # so that a round compares with few tables however deep the index is
            levels[:-1] = [written(reduce(DataFrame.unionByName, levels[:-1]), "sitemap-levels")]


def subdomain_candidates(targets: DataFrame) -> DataFrame:
    """Names worth probing, the word list and each target's own words."""
    extras = F.coalesce(F.split(F.col("attrs")["extra_subdomains"], ","), F.array().cast("array<string>"))
    words = F.concat(F.array(*[F.lit(w) for w in fv.SUBDOMAIN_WORDS]), extras)
    return targets.select(*KEYS, F.explode(F.array_distinct(words)).alias("word"), "domain").select(
        *KEYS, F.concat_ws(".", "word", "domain").alias("item")
    )


def resolved_subdomains(observations: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates that answered; ``url`` is the probed name, status 200 an answer.

    A semi-join against the candidates, so no name is paired with every word.
    """
    answered = usable_captures(observations).select(*SCAN, F.col("url").alias("item"))
    hits = answered.join(subdomain_candidates(targets), [*KEYS, "item"], "left_semi")
    return hits.select(*SCAN, "item"), observations


def dns_questions(targets: DataFrame) -> DataFrame:
    """What to ask a resolver for each domain: ``name``, ``type`` and the ``role`` of the answer."""
    plain = F.array(*[F.struct(F.col("domain").alias("name"), F.lit(k).alias("type"), F.lit(k).alias("role")) for k in ("TXT", "CNAME", "MX", "NS")])
    services = F.transform(
        F.array(*[F.concat_ws(".", F.lit(s), "domain") for s in fv.DNS_SERVICE_PREFIXES]),
        lambda host: F.struct(host.alias("name"), F.lit("TXT").alias("type"), F.concat(F.lit("TXT:"), host).alias("role")),
    )
    return targets.select(*KEYS, F.explode(F.concat(plain, services)).alias("q")).select(*KEYS, "q.*")


ENGLISH = ("en", "en-US", "en-GB", "")


def landed_resources(captures: DataFrame) -> DataFrame:
    """String resources landed as captures: locale in ``role``, name in ``url``, value in ``body``."""
    return usable_captures(captures).select(
        *SCAN, F.col("role").alias("locale"), F.col("url").alias("name"), F.col("body").alias("value"),
        F.coalesce("captured_at", F.timestamp_seconds(F.lit(0))).alias("seq"),
    )


def string_resources(resources: DataFrame) -> DataFrame:
    """One value per (scan, name), of the best locale; there a later source overwrites an earlier one.

    ``resources`` is ``SCAN, locale, name, value, seq``; English and default
    locales count, in the order of ``ENGLISH``, values under three characters
    do not. Of equal places in the order the larger value is taken.
    """
    kept = resources.filter(
        F.coalesce("locale", F.lit("")).isin(*ENGLISH) & (F.coalesce("name", F.lit("")) != "") & (F.length("value") >= 3)
    )
    rank = F.array_position(F.array(*[F.lit(x) for x in ENGLISH]), F.coalesce("locale", F.lit("")))
    best = F.max(F.struct((-rank).alias("rank"), "seq", "value"))
    return kept.groupBy(*SCAN, "name").agg(best.alias("best")).select(*SCAN, "name", F.col("best.value").alias("value"))


def resource_items(resources: DataFrame) -> DataFrame:
    """U8 and U9 over resources: each kept value once per scan."""
    rows = string_resources(resources).withColumn("value", t.strip(F.col("value")))
    kept = rows.filter(flt.resource_noise_ok(F.col("name"), F.col("value")))
    items = kept.select(*SCAN, F.col("value").alias("item"), flt.resource_category(F.col("value")).alias("category"))
    return distinct_items(items.filter("category is not null"))
