"""Extractor queries: items found in every capture of a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdrift.catalog import inputs as cte
from snapdrift.catalog import monitors as m
from snapdrift.catalog import sqltext as q
from snapdrift.catalog.monitors import pick_sql, text, title_sql
from snapdrift.catalog.registry import query
from snapdrift.functions import patterns as p
from snapdrift.operators import feed_extractors as feed
from snapdrift.operators import page_extractors as page
from snapdrift.operators.diff import explode_items
from snapdrift.operators.scans import pick_by_configuration, pick_by_success, usable_captures
from snapdrift.operators.watch import (
    bundle_urls,
    dns_questions,
    landed_resources,
    resolved_subdomains,
    sitemap_urls,
    string_resources,
    subdomain_candidates,
)
from snapdrift.plans.detect import version_scans, with_target
from snapdrift.plans.monitors import JOB_SOURCES, MONITORS
from snapdrift.sources import histories as h


def _items(rows: DataFrame, entries: Column, details: Sequence[str] = ()) -> DataFrame:
    items = explode_items(rows, entries)
    return items.select("target_id", "scan_id", "item", *[F.col("detail")[d].alias(d) for d in details])


def feed_items(
    name: str,
    body: Callable[[Column], Column],
    entries: Callable[[], Column],
    sql: str,
    details: Sequence[str] = (),
    targets=h.feed_targets,
) -> None:
    """Register an extractor over the usable feed scans of ``part``."""
    watchlist = targets

    def run(spark: SparkSession, folder: str) -> DataFrame:
        captures = usable_captures(h.feed_captures(spark, folder, name, body))
        rows = with_target(captures, watchlist(spark, folder, name))
        return _items(rows, entries(), details)

    query(name, f"WITH feed AS ({cte.FEED}) {sql}")(run)


def _strings(of: Callable[[Column], Column]) -> Callable[[], Column]:
    return lambda: feed.plain(of(F.col("body")))


# --- pages ---------------------------------------------------------------------


def seeded_html() -> Column:
    """A page with script and link tags in front of its own markup."""
    i = F.col("page_id")
    return text(
        '<script src="/static/app-', i, ".js\"></script><script defer src='//cdn.example.net/lib/", i, ".js?x=1'></script>",
        '<!-- <script src="/commented.js"></script> --><link rel="modulepreload" href="../m/chunk-', i, '.mjs">',
        '<link rel="stylesheet" href="/style.js"><script src="https://www.googletagmanager.com/gtm.js"></script>',
        '<script>load("static/js/main.', i, '.js");n("_next/static/x', i, ".js\");p('/v/", i,
        '.mjs\');w("https://x.example.org/vendor.js")</script>', F.col("html"),
    )


_dir = "regexp_extract(url, '^(https?://[^?#]*/)', 1)"
_root = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
SEEDED_URLS = (
    f"concat({_root}, '/static/app-', page_id, '.js'), "
    "concat(regexp_extract(url, '^(https?:)', 1), '//cdn.example.net/lib/', page_id, '.js?x=1'), "
    f"concat(regexp_replace({_dir}, '[^/]+/$', ''), 'm/chunk-', page_id, '.mjs'), "
    f"concat({_dir}, 'static/js/main.', page_id, '.js'), concat({_root}, '/_next/static/x', page_id, '.js'), "
    f"concat({_root}, '/v/', page_id, '.mjs'), 'https://x.example.org/vendor.js'"
)


@query(
    "js_bundle_urls",
    "SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS target_id, page_id AS scan_id, "
    f"unnest(list_filter([{SEEDED_URLS}], lambda u: NOT {q.has('lower(u)', p.TRACKER_WORDS)})) AS item FROM pages",
)
def js_bundle_urls(spark, folder):
    rows = h.page_captures(spark, folder, "js_deep", body=seeded_html())
    return _items(rows, feed.plain(page.js_bundle_urls(F.col("body"), F.col("url"))))


@query(
    "head_cap_bundles",
    f"WITH docs AS ({cte.DOCS}) SELECT target_id, scan_id, "
    "unnest(list_transform(range(300), lambda i: concat('https://', target_id, '.example.com/b', lpad(i::VARCHAR, 3, '0'), '.js'))) AS url "
    "FROM docs WHERE status = 200",
)
def head_cap_bundles(spark, folder):
    """All of three hundred scripts on a page take part; the page holds its document's text as well."""
    tags = m.joined(F.sequence(F.lit(0), F.lit(299)), lambda i: text('<script src="/b', F.lpad(i.cast("string"), 3, "0"), '.js"></script>'))
    escaped = F.replace(F.replace(F.col("body"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    pages = h.document_captures(spark, folder, "js_deep").withColumns({"role": F.lit("page"), "body": F.concat(escaped, tags)})
    return bundle_urls(pages, h.document_targets(spark, folder, "js_deep")).select("target_id", "scan_id", "url")


def _literal(quote: str) -> str:
    return f"{quote}((?:[^{quote}\\\\]|\\\\.){{3,}}){quote}"


@query(
    "quoted_strings",
    f"WITH pgs AS ({cte.PAGES}) SELECT DISTINCT target_id, scan_id, unnest(list_concat("
    f"regexp_extract_all(body, {q.lit(_literal(chr(34)))}, 1), regexp_extract_all(body, {q.lit(_literal(chr(39)))}, 1))) AS item FROM pgs",
)
def quoted_strings(spark, folder):
    return _items(h.page_captures(spark, folder, "js_deep"), feed.plain(page.quoted_strings(F.col("body"))))


@query(
    "visible_text_lines",
    f"WITH pgs AS ({cte.PAGES}), l AS (SELECT target_id, scan_id, {q.visible_lines('body')} AS l FROM pgs "
    "UNION ALL SELECT 'hostile', page_id, [concat('first ', page_id), 'a < b', concat('after > ', page_id)] FROM pages) "
    "SELECT target_id, scan_id, unnest(range(len(l)))::INTEGER AS pos, unnest(l) AS item FROM l",
)
def visible_text_lines(spark, folder):
    """Pages, and as many of hostile markup whose lines are known by how it is made."""
    i = F.col("page_id")
    hostile = text(
        '<p title="1 > ', i, '">first ', i, "</p>a < b<nav>no<nav>no</nav>no</nav><div><header>no<footer>no</div>after &gt; ", i,
        "<!-- <p>no</p> > --><br data-x='>'/><script>if (a < b) '</p>no'",
    )
    made = h.as_captures(h.text_table(spark, folder, "pages"), "docs", F.lit("hostile"), i, hostile)
    captures = h.page_captures(spark, folder, "docs").unionByName(made)
    rows = explode_items(captures, feed.plain(page.visible_text_lines(F.col("body"))))
    return rows.select("target_id", "scan_id", "pos", "item")


def _first_text(pattern: str) -> str:
    return f"list_transform(regexp_extract_all(body, {q.lit(pattern)}, 1), lambda t: {q.strip(q.entities('t'))})"


@query(
    "selected_text",
    f"WITH pgs AS ({cte.PAGES}) SELECT target_id, scan_id, unnest(CASE WHEN length(target_id) % 2 = 0 "
    f"THEN {_first_text('(?s)<h1>(.*?)</h1>')} ELSE {_first_text('(?s)<div class=.ad.>(.*?)</div>')} END) AS item FROM pgs",
)
def selected_text(spark, folder):
    selector = F.when(F.length("target_id") % 2 == 0, "h1").otherwise(".ad")
    return _items(h.page_captures(spark, folder, "page_change"), feed.plain(page.selected_text(F.col("body"), selector)))


@query("sitemap_urls", f"WITH feed AS ({cte.FEED}), items AS ({m.SITEMAP_ITEMS}) SELECT DISTINCT target_id, scan_id, item FROM items")
def sitemap_pages(spark, folder):
    items, _ = sitemap_urls(m.sitemap_captures(spark, folder), m.sitemap_targets(spark, folder))
    return items.select("target_id", "scan_id", "item").distinct()


feed_items(
    "filing_rows", m.filings_body, lambda: feed.plain(page.filing_rows(F.col("body"), F.col("target_id"))),
    f"SELECT target_id, scan_id, item FROM ({m.FILING_ITEMS})",
)
feed_items(
    "trademark_marks", m.marks_body, lambda: page.trademark_marks(F.col("body")),
    f"SELECT target_id, scan_id, item, serial, mark FROM ({m.MARK_ITEMS})", ("serial", "mark"),
)
feed_items(
    "robots_directives", m.robots_body, _strings(page.robots_directives),
    f"SELECT target_id, scan_id, item FROM ({m.ROBOTS_ITEMS})",
)
feed_items(
    "page_assets", m.assets_body,
    lambda: feed.plain(
        page.page_assets(F.col("body"), F.col("target.url"), F.split(F.col("target.attrs")["cdn_domains"], ","))
    ),
    f"SELECT DISTINCT target_id, scan_id, item FROM ({m.ASSET_ITEMS})", targets=m.asset_targets,
)


@query(
    "job_titles_page",
    "SELECT c_mktsegment AS target_id, c_custkey AS scan_id, unnest(["
    "concat(c_name, 'Lead'), concat(c_name, ' Lead Engineer'), concat('Research Scientist for ', c_mktsegment)]) AS item FROM customer",
)
def job_titles_page(spark, folder):
    body = text(
        "<html><h2> ", F.col("c_name"), " <i>Lead</i></h2><h2>", F.col("c_name"), " Lead Engineer</h2><a href='/j/1'>Research Scientist for ",
        F.col("c_mktsegment"), "</a><span>engineer</span><p>Senior Manager of Everything</p><script>var x='Manager of scripts, senior';</script></html>",
    )
    captures = h.as_captures(h.table(spark, folder, "customer"), "jobs", F.col("c_mktsegment"), F.col("c_custkey"), body)
    return _items(captures, feed.plain(page.job_titles_page(F.col("body"))))


# --- JSON and Atom ---------------------------------------------------------------


def version_query(name: str, monitor: str, body, sql: str, details: Sequence[str] = (), targets=h.feed_targets) -> None:
    watchlist = targets

    def run(spark: SparkSession, folder: str) -> DataFrame:
        captures = h.feed_captures(spark, folder, monitor, body)
        rows = version_scans(captures, watchlist(spark, folder, monitor), MONITORS[monitor])
        return rows.select(
            "target_id", "scan_id", "version", "notes", *[F.col("detail")[d].alias(d) for d in details]
        )

    query(name, f"WITH feed AS ({cte.FEED}) {sql}")(run)


def release_state(spark: SparkSession, folder: str) -> DataFrame:
    captures = h.feed_captures(spark, folder, "github_release", m.release_body)
    rows = version_scans(captures, h.feed_targets(spark, folder, "github_release"), MONITORS["github_release"])
    return rows.select(
        "target_id", "scan_id", F.col("fingerprint").alias("release_id"), "version", "notes",
        F.col("detail")["name"].alias("name"), F.col("detail")["html_url"].alias("html_url"),
    )


query(
    "latest_release",
    f"WITH feed AS ({cte.FEED}) SELECT target_id, scan_id, k::VARCHAR AS release_id, concat('v', k) AS version, "
    f"{m._note} AS notes, CASE WHEN k % 3 <> 0 THEN concat('Name ', k) END AS name, concat('https://r.example.com/', k) AS html_url "
    "FROM (SELECT *, eid // 2 AS k FROM feed WHERE pos = 0)",
)(release_state)

feed_items(
    "pull_requests", m.prs_body, lambda: feed.pull_requests(F.col("body")),
    f"SELECT target_id, scan_id, eid::VARCHAR AS item, {title_sql()} AS title, (eid % 1000)::VARCHAR AS number FROM feed",
    ("title", "number"),
)
version_query(
    "ios_app_versions", "app_store", m.lookup_body,
    "SELECT concat(target_id, '-', eid % 3 + 1000) AS target_id, scan_id, concat('1.', eid // 2) AS version, "
    "CASE WHEN eid % 5 = 0 THEN '' ELSE concat('Notes ', eid // 3) END AS notes, concat('com.b.', eid % 3) AS bundle, "
    "printf('%.1f', eid * 12345678 / 1e6) AS size FROM feed "
    "QUALIFY row_number() OVER (PARTITION BY target_id, scan_id, eid % 3 ORDER BY pos DESC) = 1",
    ("bundle", "size"), targets=lambda spark, folder, monitor: m.app_targets(spark, folder),
)
version_query(
    "android_app_versions", "play_store", m.app_record_body,
    "SELECT target_id, scan_id, CASE WHEN eid % 7 = 0 THEN '' ELSE concat('2.', eid // 2) END AS version, "
    "CASE WHEN eid % 4 = 0 THEN '' ELSE concat('what ', eid // 3) END AS notes, "
    "concat('2024-03-0', eid % 9 + 1, ' 10:00') AS updated, '10+' AS installs, '4.5' AS score FROM feed WHERE pos = 0",
    ("updated", "installs", "score"),
)


@query(
    "string_resources",
    f"SELECT target_id, scan_id, name, value FROM (SELECT target_id, scan_id, eid AS e, "
    "CASE WHEN eid % 9 = 0 THEN concat('abc_', eid) ELSE concat('title_', eid // 2) END AS name, "
    f"{pick_sql(m.LOCALES, 'eid')} AS locale, CASE eid % 4 WHEN 0 THEN {pick_sql(m.LABELS, 'eid')} "
    "WHEN 1 THEN concat('Try the new mode ', eid) WHEN 2 THEN concat(' Open the saved file ', eid, ' ') "
    f"ELSE concat('https://x.example.com/', eid) END AS value FROM ({m.PROBED})) WHERE locale <> 'fr' "
    "QUALIFY row_number() OVER (PARTITION BY target_id, scan_id, name ORDER BY list_position(['en', 'en-US', 'en-GB', ''], locale), e DESC, value DESC) = 1",
)
def resources(spark, folder):
    return string_resources(landed_resources(m.resource_captures(spark, folder))).select("target_id", "scan_id", "name", "value")


feed_items(
    "flag_names", m.flags_body, _strings(feed.flag_names),
    "SELECT DISTINCT target_id, scan_id, "
    f"unnest([lower(translate({title_sql()}, ' ', '-')), 'name', 'expiry']) AS item FROM feed",
)


@query(
    "subdomain_candidates",
    f"SELECT target_id, concat(unnest({q.words(m.fv.SUBDOMAIN_WORDS).replace('(', '[').replace(')', ']')} || ['codex', 'sora']), "
    f"'.', domain) AS item FROM ({cte.FEED_TARGETS})",
)
def candidates(spark, folder):
    return subdomain_candidates(m.probe_targets(spark, folder)).select("target_id", "item")


@query(
    "resolved_subdomains",
    f"WITH probed AS ({m.PROBED}) SELECT target_id, scan_id, item FROM ({m.SUBDOMAIN_ITEMS})",
)
def resolved(spark, folder):
    hits, _ = resolved_subdomains(m.probe_captures(spark, folder), m.probe_targets(spark, folder))
    return hits.select("target_id", "scan_id", "item")


feed_items(
    "certificate_names", m.certs_body,
    lambda: feed.plain(feed.certificate_names(F.col("body"), F.col("target.domain"))),
    f"SELECT DISTINCT target_id, scan_id, item FROM ({m.CERT_ITEMS})",
)
feed_items(
    "atom_filings", m.filings_feed, lambda: feed.atom_filings(F.col("body")),
    "SELECT target_id, scan_id, concat_ws(chr(9), title, updated, link, summary) AS item, title, updated AS date, link, summary "
    f"FROM (SELECT *, concat('Sum ', item) AS summary FROM ({m.FILING_FEED_ITEMS}))",
    ("title", "date", "link", "summary"),
)
version_query(
    "npm_versions", "npm", m.npm_body,
    f"SELECT target_id, scan_id, concat('3.', e // 2) AS version, {title_sql('(e // 3)')} AS notes, "
    "CASE WHEN e % 6 = 0 THEN 'None' ELSE deps END AS deps FROM (SELECT target_id, scan_id, min(eid) AS e, "
    "string_agg(concat('dep-', eid // 4, '-', eid % 4), ', ' ORDER BY pos) AS deps FROM feed GROUP BY ALL)",
    ("deps",),
)
version_query(
    "pypi_versions", "pypi", m.pypi_body,
    "SELECT target_id, scan_id, concat('4.', eid // 2) AS version, "
    f"CASE WHEN eid % 3 = 0 THEN '' ELSE {title_sql()} END AS notes FROM feed WHERE pos = 0",
)
feed_items(
    "job_titles_board_a", m.board_a_body, _strings(feed.job_titles_board_a),
    f"SELECT target_id, scan_id, concat({m._role}, ' ', eid, ' | ', CASE WHEN eid % 2 = 0 THEN concat('Dept ', eid % 3) END, "
    "' | City ', eid % 5) AS item FROM feed",
)
feed_items(
    "job_titles_board_b", m.board_b_body, _strings(feed.job_titles_board_b),
    f"SELECT target_id, scan_id, concat({m._role}, ' ', eid, ' | ', CASE WHEN eid % 2 = 0 THEN concat('Team ', eid % 3) END, "
    "' | City ', eid % 5) AS item FROM feed",
)


_kinds = ", ".join(f"('{k}', domain, '{k}')" for k in ("TXT", "CNAME", "MX", "NS"))
_services = ", ".join(f"('TXT:' || '{s}.' || domain, '{s}.' || domain, 'TXT')" for s in m.fv.DNS_SERVICE_PREFIXES)


@query(
    "dns_questions",
    f"SELECT target_id, q.name AS name, q.type AS type, q.role AS role FROM ({cte.FEED_TARGETS}) g, "
    f"LATERAL (VALUES {_kinds}, {_services}) q(role, name, type)",
)
def questions(spark, folder):
    return dns_questions(h.feed_targets(spark, folder, "dns_records")).drop("monitor")


@query("dns_records", f"WITH feed AS ({cte.FEED}) {m.DNS_ITEMS}")
def dns_records(spark, folder):
    rows = usable_captures(m.dns_captures(spark, folder), strict=True)
    return _items(rows, feed.plain(feed.dns_records(F.col("body"), F.col("role"))))


feed_items(
    "arxiv_papers", m.papers_feed, lambda: feed.arxiv_papers(F.col("body")),
    f"SELECT target_id, scan_id, item, authors, link, published AS date FROM ({m.PAPER_ITEMS})",
    ("authors", "link", "date"),
)
feed_items(
    "graphql_schema_items", m.schema_body, _strings(feed.graphql_schema_items),
    f"SELECT DISTINCT target_id, scan_id, item FROM ({m.SCHEMA_ITEMS})",
)
feed_items(
    "org_repos", m.repos_body, lambda: feed.org_repos(F.col("body")),
    "SELECT target_id, scan_id, concat('o/r', eid) AS item, CASE WHEN eid % 3 <> 0 THEN "
    f"repeat(concat({title_sql()}, ' '), 20) ELSE '' END AS \"desc\", eid::VARCHAR AS stars, '2024-05-06' AS created FROM feed",
    ("desc", "stars", "created"),
)
feed_items(
    "hub_models", m.models_body, lambda: feed.hub_models(F.col("body")),
    "SELECT target_id, scan_id, concat('org/m', eid) AS item, eid::VARCHAR AS downloads, (eid % 9)::VARCHAR AS likes, "
    "CASE WHEN eid % 2 = 0 THEN 'text-generation' ELSE '' END AS pipeline FROM feed",
    ("downloads", "likes", "pipeline"),
)
feed_items(
    "registry_models", m.registry_body, _strings(feed.registry_models),
    "SELECT target_id, scan_id, CASE WHEN split_part(target_id, '#', 2)::INT % 2 = 0 THEN concat('model-', eid) "
    "ELSE concat('models/m', eid) END AS item FROM feed",
)


# --- which capture counts ----------------------------------------------------------


@query(
    "usable_captures",
    f"WITH docs AS ({cte.DOCS}) SELECT target_id, scan_id, length(body) AS n FROM docs WHERE status BETWEEN 200 AND 299 AND length(body) >= 100",
)
def usable(spark, folder):
    rows = usable_captures(h.document_captures(spark, folder), min_length=100)
    return rows.select("target_id", "scan_id", F.length("body").cast("bigint").alias("n"))


@query(
    "pick_primary_capture",
    "SELECT p_brand AS target_id, p_partkey AS scan_id, CASE WHEN p_partkey % 3 = 0 THEN 'fallback' ELSE 'primary' END AS role "
    "FROM part",
)
def pick_primary(spark, folder):
    chosen = pick_by_success(m.trademark_captures(spark, folder), ("primary", "fallback"))
    return chosen.select("target_id", "scan_id", "role")


@query(
    "pick_configured_capture",
    "SELECT p_brand AS target_id, p_partkey AS scan_id, CASE split_part(p_brand, '#', 2)::INT % 3 WHEN 0 THEN 'board_a' "
    "WHEN 1 THEN 'board_b' ELSE 'careers_page' END AS role FROM "
    "(SELECT p_brand, p_partkey FROM part UNION ALL SELECT p_brand, p_partkey + 1000000000 FROM part WHERE p_partkey % 7 = 0)",
)
def pick_configured(spark, folder):
    chosen = pick_by_configuration(m.job_captures(spark, folder), m.job_targets(spark, folder), JOB_SOURCES)
    return chosen.select("target_id", "scan_id", "role")
