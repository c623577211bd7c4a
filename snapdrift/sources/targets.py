"""The watchlist: configuration documents turned into rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdrift.functions.text import target_key
from snapdrift.schema import TARGETS
from snapdrift.sources import watchlist_defaults as wd

# sections that map a code to a label instead of listing targets
CODE_SECTIONS = ("fcc_grantees", "trademark_owners", "sec_ciks", "npm_packages", "pypi_packages")

# monitors fed by a section
SECTION_MONITORS = {
    "js_bundles": ("js_deep",),
    "docs": ("docs",),
    "sitemaps": ("sitemap",),
    "github": ("github_release", "github_prs"),
    "app_store": ("app_store",),
    "play_store": ("play_store", "apk_strings"),
    "subdomains": ("subdomains",),
    "pages": ("page_change",),
    "fcc_grantees": ("fcc",),
    "trademark_owners": ("trademark",),
    "ct_logs": ("ct_logs",),
    "robots_txt": ("robots_txt",),
    "sec_ciks": ("sec_8k",),
    "npm_packages": ("npm",),
    "pypi_packages": ("pypi",),
    "job_postings": ("jobs",),
    "dns_records": ("dns_records",),
    "arxiv": ("arxiv",),
    "graphql": ("graphql",),
    "cdn_assets": ("cdn_assets",),
    "chrome_flags": ("chrome_flags",),
    "github_orgs": ("github_org",),
    "hf_orgs": ("huggingface",),
    "model_registries": ("model_registry",),
}

# sections that run with built-in lists when a configuration is silent
BUILT_IN = (
    "fcc_grantees", "trademark_owners", "sec_ciks", "npm_packages", "pypi_packages", "job_postings", "arxiv",
    "chrome_flags", "github_orgs", "hf_orgs", "model_registries",
)

def _json_list(text: str) -> str:
    return "[" + ",".join(f'"{x}"' for x in text.split(",") if x) + "]"


def _default_rows() -> list[tuple[str, dict[str, str]]]:
    rows: list[tuple[str, dict[str, str]]] = []
    rows += [("js_bundles", {"name": n, "url": u, "keywords": _json_list(k)}) for n, u, k in wd.SCRIPT_TARGETS]
    rows += [("docs", {"name": n, "urls": _json_list(u), "keywords": _json_list(k)}) for n, u, k in wd.DOC_TARGETS]
    rows += [
        ("sitemaps", {"name": n, "sitemap_url": u, "interesting_patterns": _json_list(p)})
        for n, u, p in wd.SITEMAP_TARGETS
    ]
    rows += [
        ("github", {"name": n, "repo": r, "watch": _json_list(w), "keywords": _json_list(k)})
        for n, r, w, k in wd.REPO_TARGETS
    ]
    rows += [("app_store", {"name": n, "app_id": i}) for n, i in wd.IOS_APPS]
    rows += [("play_store", {"name": n, "package": p}) for n, p in wd.ANDROID_APPS]
    rows += [("subdomains", {"name": n, "domain": d, "extra_subdomains": _json_list(w)}) for n, d, w in wd.DOMAIN_TARGETS]
    rows += [("pages", {"name": n, "url": u}) for n, u in wd.PAGE_TARGETS]
    for section, block in zip(
        CODE_SECTIONS, (wd.GRANTEES, wd.TRADEMARK_OWNERS, wd.FILERS, wd.NPM_PACKAGES, wd.PYPI_PACKAGES)
    ):
        rows += [(section, {"code": c, "label": v}) for c, v in block]
    rows += [
        ("job_postings", {"name": n, "ticker": t, kind: ref, "keywords": _json_list(k)})
        for n, t, kind, ref, k in (
            (n, t, {"greenhouse": "greenhouse_id", "lever": "lever_id", "careers": "careers_url"}[b], r, k)
            for n, t, b, r, k in wd.JOB_BOARDS
        )
    ]
    rows += [("arxiv", {"name": n, "ticker": t, "query": s}) for n, t, s in wd.PAPER_QUERIES]
    rows += [("github_orgs", {"name": n, "org": o}) for n, o in wd.REPO_ORGS]
    rows += [("hf_orgs", {"name": n, "org": o}) for n, o in wd.MODEL_ORGS]
    rows += [("model_registries", {"name": n, "ticker": t, "url": u}) for n, t, u in wd.REGISTRIES]
    rows.append(("chrome_flags", {"name": "main"}))
    return rows


def _strings(value: Column) -> Column:
    return F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))


def section_entries(configs: DataFrame) -> DataFrame:
    """``section, t`` rows of JSON configuration texts in column ``value``."""
    sections = configs.select(F.explode(F.from_json("value", "map<string,string>")).alias("section", "json"))
    coded = F.transform(
        F.map_entries(F.from_json("json", "map<string,string>")),
        lambda e: F.create_map(F.lit("code"), e["key"], F.lit("label"), e["value"]),
    )
    listed = F.from_json("json", "array<map<string,string>>")
    entries = F.when(F.col("section").isin(*CODE_SECTIONS), coded).otherwise(listed)
    return sections.select("section", F.explode(entries).alias("t"))


def as_watchlist(entries: DataFrame) -> DataFrame:
    """Configuration entries in the targets layout, one row per monitor and target."""
    monitors = F.create_map(
        *[x for s, ms in SECTION_MONITORS.items() for x in (F.lit(s), F.array(*[F.lit(m) for m in ms]))]
    )
    t = F.col("t")
    rows = entries.select("section", "t", F.explode(F.try_element_at(monitors, F.col("section"))).alias("monitor"))
    # pages that show what a code stands for
    fill = lambda address, hole, value: F.replace(F.lit(address), F.lit(hole), value)
    lookup = F.when(F.col("section") == "fcc_grantees", fill(wd.GRANTEE_URL, "{code}", t["code"])).when(
        F.col("section") == "sec_ciks", fill(wd.FILER_URL, "{cik}", t["label"])
    )
    urls = F.when(F.col("section") == "docs", _strings(t["urls"])).otherwise(
        F.array(F.coalesce(t["url"], t["sitemap_url"], t["careers_url"], lookup, F.lit("")))
    )
    rows = rows.select("section", "t", "monitor", F.explode(urls).alias("url"))
    watch = F.when(t["watch"].isNull(), F.array(F.lit("releases"))).otherwise(_strings(t["watch"]))
    wanted = (
        F.when(F.col("monitor") == "github_release", F.array_contains(watch, "releases"))
        .when(F.col("monitor") == "github_prs", F.array_contains(watch, "prs"))
        .otherwise(True)
    )
    coded = F.col("section").isin(*CODE_SECTIONS)
    monitor = F.col("monitor")
    target_id = (
        F.when(coded, t["code"])
        .when(monitor == "docs", target_key(t["name"], F.col("url")))
        .when(F.col("section") == "github", t["repo"])
        .when(monitor == "apk_strings", t["package"])
        .otherwise(t["name"])
    )
    name = F.when(monitor.isin("trademark", "sec_8k"), t["code"]).when(coded, t["label"]).otherwise(t["name"])
    ticker = (
        F.when(monitor == "trademark", t["label"]).when(monitor == "sec_8k", t["code"]).otherwise(t["ticker"])
    )
    # lists travel as comma-joined text, the rest as it stands
    extra = {
        "app_id": t["app_id"],
        "batch": F.when(monitor == "app_store", F.coalesce(t["batch"], F.lit("apps"))),
        "package": t["package"],
        "selector": t["selector"],
        "extra_subdomains": F.array_join(F.from_json(t["extra_subdomains"], "array<string>"), ","),
        "cdn_domains": F.array_join(F.from_json(t["cdn_domains"], "array<string>"), ","),
        "cik": F.when(monitor == "sec_8k", t["label"]),
        "board_a": t["greenhouse_id"],
        "board_b": t["lever_id"],
        "careers_page": t["careers_url"],
        "query": t["query"],
        "org": t["org"],
    }
    attrs = F.map_from_entries(
        F.filter(
            F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in extra.items()]),
            lambda e: F.coalesce(e["value"], F.lit("")) != "",
        )
    )
    values = {
        "monitor": monitor,
        "target_id": target_id,
        "name": name,
        "ticker": F.coalesce(ticker, F.lit("")),
        "url": F.col("url"),
        "domain": F.coalesce(t["domain"], F.lit("")),
        "keywords": _strings(t["keywords"]),
        "patterns": _strings(t["interesting_patterns"]),
        "attrs": attrs,
    }
    return rows.filter(wanted).select(*[values[f.name].cast(f.dataType).alias(f.name) for f in TARGETS.fields])


def load_targets(spark: SparkSession, path: str | None = None, lines: bool = False) -> DataFrame:
    """A1: the watchlist of a JSON configuration, or the built-in one.

    A section absent from the file switches its monitors off, except those
    with built-in lists. Each file below ``path`` is a document, or, with
    ``lines``, each line of one: very many documents then need no file each.
    """
    defaults = spark.createDataFrame(_default_rows(), "section string, t map<string,string>")
    if path is None:
        return as_watchlist(defaults)
    try:
        configs = spark.read.text(path, wholetext=not lines)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return as_watchlist(defaults)
    entries = section_entries(configs)
    named = configs.select(F.explode(F.map_keys(F.from_json("value", "map<string,string>"))).alias("section"))
    silent = defaults.filter(F.col("section").isin(*BUILT_IN)).join(named.distinct(), "section", "left_anti")
    return as_watchlist(entries.unionByName(silent))


DIMENSIONS = {
    "fcc": wd.GRANTEES,
    "trademark": wd.TRADEMARK_OWNERS,
    "sec_8k": wd.FILERS,
    "npm": wd.NPM_PACKAGES,
    "pypi": wd.PYPI_PACKAGES,
}


def dimension(spark: SparkSession, name: str) -> DataFrame:
    """``code, label`` of a built-in dimension, at most a hundred rows."""
    return spark.createDataFrame(DIMENSIONS[name], "code string, label string")


def company_enrich(rows: DataFrame, name: str, code: str) -> DataFrame:
    """Attach ``label`` for a code; the dimension's size is fixed, so it is broadcast."""
    dim = F.broadcast(dimension(rows.sparkSession, name)).withColumnRenamed("code", code)
    return rows.join(dim, code, "left")


def shared_labels(dim: DataFrame) -> DataFrame:
    """Labels that several codes share, such as two tickers with one filer number."""
    groups = dim.groupBy("label").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    return groups.filter(F.size("codes") > 1)
