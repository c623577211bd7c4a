"""One query per monitor: reports over a whole table seen as captures."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdrift.catalog import inputs as cte
from snapdrift.catalog import sqltext as q
from snapdrift.catalog.registry import query
from snapdrift.functions import fixed_values as fv
from snapdrift.plans.detect import detect
from snapdrift.plans.monitors import MONITORS
from snapdrift.sources import histories as h

NL = "chr(10)"


def report_rows(reports: DataFrame) -> DataFrame:
    """Reports without the monitor name and the mark of size, fields as text."""
    text = F.array_join(F.transform("fields", lambda f: F.concat_ws("=", f["name"], f["value"])), "; ")
    return reports.drop("monitor", "oversize").withColumn("fields", text)


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def pick(options: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (n % len(options) + 1).cast("int"))


def pick_sql(options: list[str], n: str) -> str:
    return f"list_extract([{', '.join(q.lit(o) for o in options)}], ({n} % {len(options)} + 1)::INT)"


def joined(entries: Column, render, separator: str = "") -> Column:
    return F.array_join(F.transform(entries, render), separator)


HEADS = ["New Beta", "Stable", "Alpha build", "Plain"]


def title(e: Column) -> Column:
    return text(pick(HEADS, e), " item ", e)


def title_sql(e: str = "eid") -> str:
    return f"concat({pick_sql(HEADS, e)}, ' item ', {e})"


#: Captures and targets of each monitor, as functions of a session and a folder.
INPUTS: dict[str, tuple[Callable, Callable]] = {}


def _feed_query(monitor: str, body, targets=h.feed_targets):
    captures = lambda spark, folder: h.feed_captures(spark, folder, monitor, body)
    INPUTS[monitor] = captures, lambda spark, folder: targets(spark, folder, monitor)

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return report_rows(detect(captures(spark, folder), targets(spark, folder, monitor), MONITORS[monitor]))

    return run


def all_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Captures and targets of every monitor in one table each."""
    made = [(c(spark, folder), t(spark, folder)) for c, t in INPUTS.values()]
    captures, targets = (reduce(DataFrame.unionByName, part) for part in zip(*made))
    return captures, targets


def _feed_ctes(items: str, targets: str = cte.FEED_TARGETS) -> str:
    return f"feed AS ({cte.FEED}), targets AS ({targets}), items AS ({items})"


FEED_SCANS = "SELECT DISTINCT target_id, scan_id FROM feed"


def _all(cap: int | None, line: str) -> list:
    return [("all", cap, line, "", "\n")]


# --- js_deep -------------------------------------------------------------------

JS_TAILS = ["Coming soon to", "Photo Studio", "open the saved file of", "x"]


def _bundle_body() -> Column:
    """A script of the document's lines as literals, padded to a real size."""
    bare = reduce(lambda s, c: F.replace(s, F.lit(c), F.lit("")), "\"'`\\", F.col("body"))
    literals = F.transform(F.filter(F.split(bare, "\n"), lambda s: F.length(s) >= 3), lambda s: text('t("', s, '");'))
    tail = text("u('", pick(JS_TAILS, F.col("scan_id")), " ", F.col("target_id"), "');", F.lit("/*" + "-" * 100 + "*/"))
    return F.concat(F.array_join(literals, "\n"), F.lit("\n"), tail)


def js_captures(spark: SparkSession, folder: str) -> DataFrame:
    docs = h.document_captures(spark, folder, "js_deep")
    site = text("https://", F.col("target_id"), ".example.com")
    src = text("/static/main-", F.col("scan_id"), ".js")
    html = text('<html><script src="', src, '"></script><script src="/js/analytics.js"></script></html>')
    page = docs.withColumns({"role": F.lit("page"), "url": text(site, "/"), "body": html})
    bundle = docs.withColumns({"role": F.lit("bundle"), "url": text(site, src), "body": _bundle_body()})
    tracker = docs.withColumns({"role": F.lit("bundle"), "url": text(site, "/js/analytics.js"), "body": _bundle_body()})
    return page.unionByName(bundle).unionByName(tracker)


JS_ITEMS = (
    "raw AS (SELECT target_id, scan_id, body FROM docs WHERE status = 200), "
    "found AS (SELECT target_id, scan_id, translate(unnest(string_split(body, chr(10))), '\"''`\\', '') AS s FROM raw "
    f"UNION ALL SELECT target_id, scan_id, concat({pick_sql(JS_TAILS, 'scan_id')}, ' ', target_id) FROM raw), "
    f"tidy AS (SELECT target_id, scan_id, {q.strip('s')} AS item FROM found WHERE length(s) >= 3), "
    f"items AS (SELECT target_id, scan_id, item FROM tidy WHERE {q.script_ok('item')} AND ({q.script_category('item')}) IS NOT NULL)"
)
_js_line = "concat('* `', substring(item, 1, 120), '`')"
_kw = q.keyword_hit("ch.item", "g.keywords", False)
JS_ADDED = dict(
    op="added",
    bucket=f"CASE WHEN {_kw} THEN 'keyword' WHEN ({q.script_category('ch.item')}) IN "
    f"('high_interest', 'feature_name', 'ui_text') THEN {q.script_category('ch.item')} END",
    sections=[
        ("keyword", 10, _js_line, "**Keyword Matches:**\n", "\n"),
        ("high_interest", 10, _js_line, "**High Interest:**\n", "\n"),
        ("feature_name", 15, _js_line, "**Feature Names:**\n", "\n"),
        ("ui_text", 15, _js_line, "**New UI Text:**\n", "\n"),
    ],
    joiner="\n\n",
    title="concat('Unreleased Features: ', g.name)",
    head="concat('**', n, ' new strings detected** in JS bundles (', n_added, ' total new)')",
    color=0x00FF88,
    url="g.url",
    type="new_strings",
    log_title="concat(n, ' interesting strings')",
)
JS_REMOVED = dict(
    op="removed",
    bucket=f"CASE WHEN {q.word_count('ch.item')} >= 2 AND {q.upper_first('ch.item')} THEN 'all' END",
    sections=_all(10, "concat('* ~~`', substring(item, 1, 100), '`~~')"),
    title="concat('Removed Strings: ', g.name)",
    head="concat('**', n, ' notable strings removed** (feature launched, killed, or renamed?)')",
    color=0xFFA500,
    url="g.url",
)


@query(
    "detect_js_deep",
    q.reports(f"docs AS ({cte.DOCS}), targets AS ({cte.DOC_TARGETS}), {JS_ITEMS}", [JS_ADDED, JS_REMOVED]),
)
def detect_js_deep(spark, folder):
    return report_rows(detect(js_captures(spark, folder), h.document_targets(spark, folder, "js_deep"), MONITORS["js_deep"]))


# --- docs, page_change -----------------------------------------------------------

DOC_ITEMS = (
    f"items AS (SELECT target_id, scan_id, unnest(CASE WHEN len(l) = 0 THEN [''] ELSE l END) AS item FROM "
    f"(SELECT target_id, scan_id, {q.visible_lines('body')} AS l FROM docs WHERE status = 200))"
)


@query(
    "detect_docs",
    q.reports(
        f"docs AS ({cte.DOCS}), targets AS ({cte.DOC_TARGETS}), {DOC_ITEMS}",
        [
            dict(
                op="added",
                bucket=f"CASE WHEN {q.doc_signal('ch.item', 'g.keywords')} THEN 'all' END",
                sections=_all(10, "concat('+ ', substring(item, 1, 150))"),
                title="concat('Doc Change: ', g.name)",
                head="concat('**', n_added, ' lines added, ', n_removed, ' removed**')",
                fence=True,
                color=0x3498DB,
                url="g.url",
                type="doc_change",
                log_title="concat('Changes in ', g.name)",
            )
        ],
    ),
)
def detect_docs(spark, folder):
    return report_rows(
        detect(h.document_captures(spark, folder), h.document_targets(spark, folder), MONITORS["docs"])
    )


SELECTORS = ["h1", "", ".ad"]


def selector() -> Column:
    return pick(SELECTORS, F.length("target_id"))


def _page_lines(x: str) -> str:
    def by(pattern: str) -> str:
        found = f"list_transform(regexp_extract_all({x}, {q.lit(pattern)}, 1), lambda t: {q.strip(q.entities('t'))})"
        return f"string_split(array_to_string({found}, chr(10)), chr(10))"

    visible = q.visible_lines(x)
    return (
        f"CASE length(target_id) % 3 WHEN 0 THEN {by('(?s)<h1>(.*?)</h1>')} "
        f"WHEN 2 THEN {by('(?s)<div class=.ad.>(.*?)</div>')} "
        f"ELSE CASE WHEN len({visible}) = 0 THEN [''] ELSE {visible} END END"
    )


@query(
    "detect_page_change",
    q.reports(
        f"pgs AS ({cte.PAGES}), targets AS ({cte.PAGE_TARGETS}), "
        f"items AS (SELECT target_id, scan_id, unnest({_page_lines('body')}) AS item FROM pgs)",
        [
            dict(
                op="added",
                bucket="'all'",
                sections=_all(8, "concat('+ ', substring(item, 1, 120))"),
                title="concat('Page Updated: ', g.name)",
                head="concat('**', n_added, ' new lines detected**')",
                fence=True,
                color=0x607D8B,
                url="g.url",
                type="page_update",
                log_title="concat('Updated: ', g.name)",
            )
        ],
        scans_from="SELECT target_id, scan_id FROM pgs",
    ),
)
def detect_page_change(spark, folder):
    captures = h.page_captures(spark, folder, "page_change")
    return report_rows(detect(captures, selecting_targets(spark, folder), MONITORS["page_change"]))


def selecting_targets(spark: SparkSession, folder: str) -> DataFrame:
    attrs = F.when(selector() != "", F.create_map(F.lit("selector"), selector())).otherwise(F.create_map())
    return h.page_targets(spark, folder, "page_change", attrs=attrs.cast("map<string,string>"))


# --- sitemap -------------------------------------------------------------------


def _site(n: Column) -> Column:
    return text("https://feed.example.com/", n)


def _loc(n: Column, e: Column) -> Column:
    page = F.when(e % 3 == 0, text("/p/", e, "?a=1&amp;b=2")).otherwise(text("/blog/", e))
    return text("<url>\n <loc> ", _site(n), page, " </loc></url>")


def sitemap_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Root index with one page, a child with the rest, and a stray sitemap."""
    n = F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2))
    child = text(_site(n), "/child-", F.col("p_partkey"), ".xml")

    def root(entries: Column) -> Column:
        first = joined(F.slice(entries, 1, 1), lambda e: _loc(n, e))
        return text('<?xml version="1.0"?><sitemapindex><sitemap><loc>', child, "</loc></sitemap>", first, "</sitemapindex>")

    def rest(entries: Column) -> Column:
        return text("<urlset>", joined(F.slice(entries, 2, 100), lambda e: _loc(n, e)), "</urlset>")

    def stray(entries: Column) -> Column:
        return text("<urlset><url><loc>https://stray.example.com/", F.col("p_partkey"), "</loc></url></urlset>")

    make = lambda body, url: h.feed_captures(spark, folder, "sitemap", body, url=url)
    return (
        make(root, text(_site(n), "/sitemap.xml"))
        .unionByName(make(rest, child))
        .unionByName(make(stray, text(_site(n), "/stray.xml")))
    )


def sitemap_targets(spark: SparkSession, folder: str) -> DataFrame:
    n = h.brand_number()
    patterns = F.when(n % 2 == 0, F.array(F.lit("/p/[0-9]*3"), F.lit("/BLOG/1"))).otherwise(F.array())
    return h.feed_targets(spark, folder, "sitemap", url=text(_site(n), "/sitemap.xml"), patterns=patterns)


SITEMAP_ITEMS = (
    "SELECT target_id, scan_id, pos, concat('https://feed.example.com/', split_part(target_id, '#', 2), "
    "CASE WHEN eid % 3 = 0 THEN concat('/p/', eid, '?a=1&b=2') ELSE concat('/blog/', eid) END) AS item FROM feed"
)


@query(
    "detect_sitemap",
    q.reports(
        _feed_ctes(SITEMAP_ITEMS),
        [
            dict(
                op="added",
                bucket="CASE WHEN g.n % 2 = 1 OR regexp_matches(ch.item, '(?i)/p/[0-9]*3') "
                "OR regexp_matches(ch.item, '(?i)/BLOG/1') THEN 'all' END",
                sections=_all(15, "concat('• ', item)"),
                title="concat('New Pages: ', g.name)",
                head="concat('**', r.n, ' new pages** found in sitemap')",
                color=0x9B59B6,
                url="concat(g.url, '/sitemap.xml')",
                type="new_pages",
                log_title="concat(r.n, ' new pages')",
            )
        ],
        scans_from=FEED_SCANS,
    ),
)
def detect_sitemap(spark, folder):
    return report_rows(detect(sitemap_captures(spark, folder), sitemap_targets(spark, folder), MONITORS["sitemap"]))


# --- robots_txt, cdn_assets ------------------------------------------------------


def robots_body(entries: Column) -> Column:
    return text(
        "User-agent: *\r\nDisallow: /\r\ndisallow: /never\r\nAllow:\r\n",
        joined(
            entries,
            lambda e: F.when(e % 3 == 0, text("  Disallow: /p/", e, " \r\n"))
            .when(e % 3 == 1, text("Allow: /q/", e, "\r\n"))
            .otherwise(text("sitemap: https://s.example.com/", e, ".xml\r\n")),
        ),
    )


ROBOTS_ITEMS = (
    "SELECT target_id, scan_id, pos, CASE eid % 3 WHEN 0 THEN concat('/p/', eid) WHEN 1 THEN concat('/q/', eid) "
    "ELSE concat('SITEMAP: https://s.example.com/', eid, '.xml') END AS item FROM feed"
)

query(
    "detect_robots_txt",
    q.reports(
        _feed_ctes(ROBOTS_ITEMS),
        [
            dict(
                op="added", bucket="'all'", sections=_all(15, "concat('+ `', item, '`')"), fence=True,
                title="concat('robots.txt Changed: ', g.name)", head="concat('**', r.n, ' new path(s)** added')",
                color=0x795548, url="concat('https://', g.domain, '/robots.txt')",
                type="new_paths", log_title="concat(r.n, ' paths')",
            ),
            dict(
                op="removed", bucket="'all'", sections=_all(15, "concat('- `', item, '`')"), fence=True,
                title="concat('robots.txt Removed: ', g.name)",
                head="concat('**', r.n, ' path(s) removed** (may be going live)')",
                color=0xFF9800, url="concat('https://', g.domain, '/robots.txt')",
            ),
        ],
    ),
)(_feed_query("robots_txt", robots_body))


ASSET_NAMES = ["hero", "1x1", "pixel-10", "0123456789abcdef", "logo"]


def assets_body(entries: Column) -> Column:
    """Media and links with brackets in quotes, beside a comment that looks like an image."""
    return joined(
        entries,
        lambda e: F.when(e % 4 == 0, text('<!-- <img src="/no.png"> --><img alt="1 > 0" src="../img/', pick(ASSET_NAMES, e), "-", e, '.png?v=1">'))
        .when(e % 4 == 1, text("<video title='a>b' data-src='//cdn.example.net/", pick(ASSET_NAMES, e), "/", e, ".mp4#t'></video>"))
        .when(e % 4 == 2, text('<link rel="preload" as="image" href="/pre/', e, '.webp">'))
        .otherwise(text('<link rel="stylesheet" href="/css/', e, '.css"><source src=c/', pick(ASSET_NAMES, e), "/", e, ".svg>")),
    )


def asset_targets(spark: SparkSession, folder: str, monitor: str = "cdn_assets") -> DataFrame:
    """Every second brand lists its CDN domains."""
    domains = F.create_map(F.lit("cdn_domains"), F.lit("cdn.example.net,cdn2.example.net"))
    attrs = F.when(h.brand_number() % 2 == 1, domains).otherwise(F.create_map().cast("map<string,string>"))
    return h.feed_targets(spark, folder, monitor, url=F.lit("https://feed.example.com/x/page"), attrs=attrs)


ASSET_ITEMS = (
    "SELECT * FROM (SELECT target_id, scan_id, pos, split_part(target_id, '#', 2)::INT AS n, CASE eid % 4 "
    f"WHEN 0 THEN concat('feed.example.com/img/', {pick_sql(ASSET_NAMES, 'eid')}, '-', eid, '.png') "
    f"WHEN 1 THEN concat('cdn.example.net/', {pick_sql(ASSET_NAMES, 'eid')}, '/', eid, '.mp4') "
    "WHEN 2 THEN concat('feed.example.com/pre/', eid, '.webp') "
    f"ELSE concat('feed.example.com/x/c/', {pick_sql(ASSET_NAMES, 'eid')}, '/', eid, '.svg') END AS item, eid FROM feed) "
    "WHERE n % 2 = 0 OR eid % 4 = 2 OR contains(item, 'cdn.example.net')"
)

query(
    "detect_cdn_assets",
    q.reports(
        _feed_ctes(ASSET_ITEMS),
        [
            dict(
                op="added", bucket=f"CASE WHEN {q.asset_ok('ch.item')} THEN 'all' END",
                sections=_all(12, "concat('* `', substring(item, 1, 120), '`')"),
                title="concat('New CDN Assets: ', g.name, ' (', g.ticker, ')')",
                head="concat('**', r.n, ' new assets** detected')", color=0x009688, url="'https://feed.example.com/x/page'",
                type="new_assets", log_title="concat(r.n, ' assets')",
            )
        ],
    ),
)(_feed_query("cdn_assets", assets_body, asset_targets))


# --- fcc, trademark, ct_logs -----------------------------------------------------


def filings_body(entries: Column) -> Column:
    code = F.col("p_brand")
    row = lambda e: (
        F.when(e % 3 == 0, text("<tr><td> F", e, "</td><td>a&amp;b</td><td><b>x </b> y</td><td>q</td><td>five</td></tr>"))
        .when(e % 3 == 1, text('<tr class="r"><td>', F.upper(code), "</td><td>G", e, "</td><td>c</td><td>d</td></tr>"))
        .otherwise(text("<tr><td>other</td><td>", e, "</td><td>c</td><td>d</td></tr>"))
    )
    return text("<table><tr><th>h</th></tr>", joined(entries, row), "</table>")


FILING_ITEMS = (
    "SELECT target_id, scan_id, pos, CASE eid % 3 WHEN 0 THEN concat('F', eid, ' | a&b | xy | q | five') "
    "ELSE concat(upper(target_id), ' | G', eid, ' | c | d') END AS item FROM feed WHERE eid % 3 <> 2"
)

query(
    "detect_fcc",
    q.reports(
        _feed_ctes(FILING_ITEMS),
        [
            dict(
                op="added", bucket="'all'", sections=_all(8, "concat('* ', substring(item, 1, 150))"),
                title="concat('FCC Filing: ', g.name)", head="concat('**', r.n, ' new device filing(s)** detected')",
                color=0xFF5722, url="g.url", fields="concat('Grantee Code=', r.target_id, '; Company=', g.name)",
                type="new_filing", log_title="concat('FCC: ', g.name)",
            )
        ],
        order="pos", repeats=True,
    ),
)(_feed_query("fcc", filings_body))


def marks_body(entries: Column) -> Column:
    serials = joined(entries, lambda e: text("<li>", F.lpad(e.cast("string"), 8, "1"), " - MARK ", e, ".X;</li>"))
    labels = joined(entries, lambda e: text("<p>Word Mark: LABEL ", e, ";</p>"))
    return F.when(F.col("p_partkey") % 5 == 0, labels).otherwise(serials)


def trademark_captures(spark: SparkSession, folder: str) -> DataFrame:
    """The first search fails on every third scan, the second answers."""
    make = lambda role: h.feed_captures(spark, folder, "trademark", marks_body, role=F.lit(role))
    primary = make("primary").withColumn("status", F.when(F.col("scan_id") % 3 == 0, 503).otherwise(F.col("status")))
    return primary.unionByName(make("fallback"))


MARK_ITEMS = (
    "SELECT *, concat(serial, chr(9), mark) AS item FROM (SELECT target_id, scan_id, pos, "
    "CASE WHEN scan_id % 5 = 0 THEN pos::VARCHAR ELSE lpad(eid::VARCHAR, 8, '1') END AS serial, "
    "CASE WHEN scan_id % 5 = 0 THEN concat('LABEL ', eid) ELSE concat('MARK ', eid, '.X') END AS mark FROM feed)"
)


@query(
    "detect_trademark",
    q.reports(
        _feed_ctes(MARK_ITEMS),
        [
            dict(
                op="added", bucket="'all'", sections=_all(10, "concat('* **', mark, '** (SN: ', serial, ')')"),
                title="concat('New Trademark: ', r.target_id, ' (', g.ticker, ')')",
                head="concat('**', r.n, ' new trademark filing(s)**')", color=0x9C27B0,
                url="'https://tmsearch.uspto.gov/'", type="new_trademark", log_title="concat(r.n, ' marks')",
            )
        ],
        order="pos", repeats=True, extra=", serial, mark",
    ),
)
def detect_trademark(spark, folder):
    captures, targets = trademark_captures(spark, folder), h.feed_targets(spark, folder, "trademark")
    return report_rows(detect(captures, targets, MONITORS["trademark"]))


CERT_WORDS = ["alpha", "cdn", "zgqup7", "studio", "ec2-x", "notes.team", "api-v", "a.b.c.d"]


def certs_body(entries: Column) -> Column:
    domain = text("b", F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)), ".example.com")
    name = lambda e: text(F.upper(pick(CERT_WORDS, e)), F.char(e % 26 + 97), ".", domain)
    certs = F.transform(
        entries,
        lambda e: F.struct(
            F.when(e % 2 == 0, name(e)).alias("common_name"),
            F.concat(name(e), F.lit("\n*."), domain, F.lit("\nother.org\n"), F.lit("x"), domain).alias("name_value"),
        ),
    )
    return F.to_json(certs)


CERT_ITEMS = (
    "SELECT target_id, scan_id, unnest([concat(" + pick_sql(CERT_WORDS, "eid") + ", chr((eid % 26 + 97)::INT), '.b', n, "
    "'.example.com'), concat('xb', n, '.example.com')]) AS item FROM (SELECT *, split_part(target_id, '#', 2) AS n FROM feed)"
)

query(
    "detect_ct_logs",
    q.reports(
        _feed_ctes(CERT_ITEMS),
        [
            dict(
                op="added", bucket=f"CASE WHEN {q.cert_ok('ch.item', 'g.domain')} THEN 'all' END",
                sections=_all(15, "concat('* `', item, '`')"), title="concat('New SSL Certs: ', g.name)",
                head="concat('**', r.n, ' new certificate(s)** found in CT logs')", color=0x00BCD4,
                url="concat('https://crt.sh/?q=%25.', g.domain)", type="new_cert",
                log_title="concat(r.n, ' certs')",
            )
        ],
    ),
)(_feed_query("ct_logs", certs_body))


# --- subdomains, dns_records -----------------------------------------------------

PROBES = [*fv.SUBDOMAIN_WORDS, "codex", "sora", "unlisted", "hidden"]


def probe_captures(spark: SparkSession, folder: str) -> DataFrame:
    """One observation per probed name; names with an even number answer."""
    part = h.table(spark, folder, "part").select(
        F.col("p_brand").alias("target_id"), F.col("p_partkey").alias("scan_id"),
        F.explode(F.expr("sequence(p_partkey div 30, p_partkey div 30 + p_size % 6)")).alias("e"),
    )
    n = F.split_part(F.col("target_id"), F.lit("#"), F.lit(2))
    return h.as_captures(
        part, "subdomains", F.col("target_id"), F.col("scan_id"), F.lit(""),
        status=F.when(F.col("e") % 4 == 0, 404).otherwise(200),
        url=text(pick(PROBES, F.col("e")), ".b", n, ".example.com"),
    )


def probe_targets(spark: SparkSession, folder: str) -> DataFrame:
    return h.feed_targets(
        spark, folder, "subdomains", attrs=F.create_map(F.lit("extra_subdomains"), F.lit("codex,sora"))
    )


PROBED = (
    "SELECT p_brand AS target_id, p_partkey AS scan_id, p_partkey // 30 + unnest(range(p_size % 6 + 1)) AS eid FROM part"
)
SUBDOMAIN_ITEMS = (
    f"SELECT target_id, scan_id, concat(w, '.b', split_part(target_id, '#', 2), '.example.com') AS item FROM "
    f"(SELECT *, {pick_sql(PROBES, 'eid')} AS w FROM probed WHERE eid % 4 <> 0) WHERE w NOT IN ('unlisted', 'hidden')"
)


@query(
    "detect_subdomains",
    q.reports(
        f"probed AS ({PROBED}), targets AS ({cte.FEED_TARGETS}), items AS ({SUBDOMAIN_ITEMS})",
        [
            dict(
                op="added", bucket="'all'", sections=_all(None, "concat('• `', item, '`')"),
                title="concat('New Subdomains: ', g.name)", head="concat('**', r.n, ' new subdomains** discovered')",
                color=0xE91E63, url="concat('https://', g.domain)", type="new_subdomain",
                log_title="concat(r.n, ' new')",
            )
        ],
        scans_from="SELECT DISTINCT target_id, scan_id FROM probed",
    ),
)
def detect_subdomains(spark, folder):
    return report_rows(detect(probe_captures(spark, folder), probe_targets(spark, folder), MONITORS["subdomains"]))


DNS_KINDS = ["TXT", "MX", "TXT:_dmarc.example.com"]


def dns_captures(spark: SparkSession, folder: str) -> DataFrame:
    """One answer per record kind; each kind holds the entries of its turn."""

    def body(kind: int):
        return lambda entries: F.to_json(
            F.struct(
                F.transform(
                    F.filter(entries, lambda e: e % 3 == kind),
                    lambda e: F.struct(text("v=", F.repeat(text("r", e), 80)).alias("data")),
                ).alias("Answer")
            )
        )

    kinds = [h.feed_captures(spark, folder, "dns_records", body(i), role=F.lit(k)) for i, k in enumerate(DNS_KINDS)]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


DNS_ITEMS = (
    f"SELECT target_id, scan_id, concat({pick_sql(DNS_KINDS, 'eid')}, ':', "
    "concat('v=', repeat(concat('r', eid), 80))) AS item FROM feed"
)


@query(
    "detect_dns_records",
    q.reports(
        _feed_ctes(DNS_ITEMS),
        [
            dict(
                op="added", bucket="'all'", sections=_all(10, "concat('* `', substring(item, 1, 120), '`')"),
                title="concat('DNS Record Change: ', g.name, ' (', g.ticker, ')')",
                head="concat('**', r.n, ' new DNS record(s)**')", color=0x795548,
                url="concat('https://dns.google/query?name=', g.domain)", type="new_record",
                log_title="concat(r.n, ' records')",
            )
        ],
    ),
)
def detect_dns_records(spark, folder):
    captures, targets = dns_captures(spark, folder), h.feed_targets(spark, folder, "dns_records")
    return report_rows(detect(captures, targets, MONITORS["dns_records"]))


# --- sec_8k, arxiv ---------------------------------------------------------------


def hostile_feed(feed: Column, entries: Column) -> Column:
    """Every second feed with prefixed elements, and with a comment that looks like an entry."""
    prefixed = F.regexp_replace(feed, "<(/?)([a-z]+)", "<$1a:$2")
    prefixed = F.regexp_replace(prefixed, "^<a:feed", '<a:feed xmlns:a="http://feed.example.com/a"')
    comment = "$1<!-- <a:entry><a:title>no</a:title></a:entry> -->"
    return F.when(entries[0] % 2 == 0, feed).otherwise(F.regexp_replace(prefixed, "^(<a:feed[^>]*>)", comment))


def filings_feed(entries: Column) -> Column:
    entry = lambda e: text(
        "<entry>\n<title> 8-K &amp; ", title(e), " </title><updated>2024-01-", F.lpad((e % 28 + 1).cast("string"), 2, "0"),
        'T10:00:00</updated><link rel="alternate" href="https://f.example.com/?a=1&amp;e=', e,
        '"/><summary type="html"><![CDATA[ Sum ', e, " ]]></summary></entry>",
    )
    return hostile_feed(text('<feed xmlns="http://www.w3.org/2005/Atom">', joined(entries, entry), "</feed>"), entries)


FILING_FEED_ITEMS = (
    f"SELECT target_id, scan_id, pos, concat('8-K & ', {title_sql()}) AS title, "
    "concat('2024-01-', lpad((eid % 28 + 1)::VARCHAR, 2, '0'), 'T10:00:00') AS updated, "
    "concat('https://f.example.com/?a=1&e=', eid) AS link, eid::VARCHAR AS item FROM feed"
)
CURRENT_CHANGES = (
    "marks AS (SELECT target_id, scan_id, string_agg(item, ',' ORDER BY pos) AS fp FROM items GROUP BY ALL), "
    "moved AS (SELECT target_id, scan_id, fp, lag(fp) OVER (PARTITION BY target_id ORDER BY scan_id) AS old FROM marks), "
    "ch AS (SELECT 'added' AS op, i.* FROM items i JOIN moved m ON i.target_id = m.target_id AND i.scan_id = m.scan_id "
    "WHERE m.old IS NOT NULL AND m.old <> m.fp)"
)

query(
    "detect_sec_8k",
    q.reports(
        _feed_ctes(FILING_FEED_ITEMS),
        [
            dict(
                op="added", bucket="'all'",
                sections=_all(
                    5,
                    "concat('* **', substring(title, 1, 100), '**', chr(10), '  ', substring(updated, 1, 10), "
                    "' | [Link](', link, ')')",
                ),
                title="concat('SEC 8-K Filing: ', r.target_id)", head="'**New material event filing**'",
                color=0xF44336, url="g.url", type="8k_filing", log_title="concat('8-K: ', r.target_id)",
            )
        ],
        order="pos", changes=CURRENT_CHANGES,
    ),
)(_feed_query("sec_8k", filings_feed))


def papers_feed(entries: Column) -> Column:
    author = lambda e, i: text("<author><name> A", i, " B", e, " </name></author>")
    entry = lambda e: text(
        "<entry><id>http://p.example.org/", e, "</id><title>On ", title(e), "</title><published>2024-02-0", e % 9 + 1,
        "T00:00:00Z</published><summary>S</summary>",
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: author(e, i)), ""), "</entry>",
    )
    return hostile_feed(text("<feed>", joined(entries, entry), "</feed>"), entries)


PAPER_ITEMS = (
    f"SELECT target_id, scan_id, pos, concat('On ', {title_sql()}) AS item, concat('http://p.example.org/', eid) AS link, "
    "array_to_string(list_transform(range(7), lambda i: concat('A', i, ' B', eid)), ', ') AS authors, "
    "concat('2024-02-0', eid % 9 + 1) AS published FROM feed"
)

query(
    "detect_arxiv",
    q.reports(
        _feed_ctes(PAPER_ITEMS),
        [
            dict(
                op="added", bucket="'all'",
                sections=_all(
                    8,
                    "concat('* **', substring(item, 1, 100), '**', chr(10), '  ', substring(authors, 1, 80), ' | ', published)",
                ),
                title="concat('New Papers: ', g.name, ' (', g.ticker, ')')",
                head="concat('**', r.n, ' new paper(s)** on arXiv')", color=0xB71C1C, first_url="link",
                type="new_paper", log_title="concat(r.n, ' papers')",
            )
        ],
        order="pos", repeats=True, extra=", link, authors, published",
    ),
)(_feed_query("arxiv", papers_feed))


# --- github_prs, chrome_flags, jobs ------------------------------------------------


def prs_body(entries: Column) -> Column:
    return F.to_json(
        F.transform(
            entries,
            lambda e: F.struct(e.alias("id"), title(e).alias("title"), (e % 1000).cast("int").alias("number")),
        )
    )


query(
    "detect_github_prs",
    q.reports(
        _feed_ctes(
            f"SELECT target_id, scan_id, pos, eid::VARCHAR AS item, {title_sql()} AS title, eid % 1000 AS number FROM feed"
        ),
        [
            dict(
                op="added", bucket=f"CASE WHEN {q.keyword_hit('ch.title', 'g.keywords', True)} THEN 'all' END",
                sections=_all(10, "concat('• **', substring(title, 1, 80), '** (#', number, ')')"),
                title="concat('New PRs: ', g.name)", head="concat('**', r.n, ' interesting PRs**')", color=0xE67E22,
                url="concat('https://github.com/', r.target_id, '/pulls')",
            )
        ],
        order="pos", repeats=True, extra=", title, number",
    ),
)(_feed_query("github_prs", prs_body))


def flags_body(entries: Column) -> Column:
    plain = joined(entries, lambda e: text('{"name": "', F.lower(F.translate(title(e), " ", "-")), '", "expiry": 9}\n'))
    # padded to a length that is no base64 text
    letters = F.length(F.regexp_replace(plain, "[^A-Za-z0-9+/]", ""))
    raw = F.concat(plain, F.repeat(F.lit("a"), (F.lit(5) - letters % 4) % 4))
    return F.when(F.col("p_partkey") % 4 == 1, raw).otherwise(F.base64(F.encode(plain, "UTF-8")))


def flag_captures(spark: SparkSession, folder: str) -> DataFrame:
    """The first source fails on every third scan; the second holds other flags."""
    primary = h.feed_captures(spark, folder, "chrome_flags", flags_body, role=F.lit("primary"))
    primary = primary.withColumn("status", F.when(F.col("scan_id") % 3 == 0, 503).otherwise(F.col("status")))
    spare = lambda entries: F.base64(F.encode(joined(entries, lambda e: text('"spare-', e, '"')), "UTF-8"))
    return primary.unionByName(h.feed_captures(spark, folder, "chrome_flags", spare, role=F.lit("fallback")))


FLAG_ITEMS = (
    "SELECT target_id, scan_id, unnest(CASE WHEN scan_id % 3 = 0 THEN [concat('spare-', eid)] "
    f"ELSE [lower(translate({title_sql()}, ' ', '-')), 'name', 'expiry'] END) AS item FROM feed"
)


@query(
    "detect_chrome_flags",
    q.reports(
        _feed_ctes(FLAG_ITEMS),
        [
            dict(
                op="added", bucket="'all'", sections=_all(20, "concat('• `', item, '`')"), title="'New Chrome Flags'",
                head="concat('**', r.n, ' new experimental flags** detected')", color=0xFFC107,
                url="'https://chromestatus.com/features'", type="new_flags", log_title="concat(r.n, ' flags')",
            )
        ],
    ),
)
def detect_chrome_flags(spark, folder):
    captures, targets = flag_captures(spark, folder), h.feed_targets(spark, folder, "chrome_flags")
    return report_rows(detect(captures, targets, MONITORS["chrome_flags"]))


ROLES = ["Senior Engineer", "Head of Beta Search", "Office Cook", "Alpha Data Scientist"]


def board_a_body(entries: Column) -> Column:
    job = lambda e: F.struct(
        text(pick(ROLES, e), " ", e).alias("title"),
        F.struct(text("City ", e % 5).alias("name")).alias("location"),
        F.when(e % 2 == 0, F.array(F.struct(text("Dept ", e % 3).alias("name")))).alias("departments"),
    )
    return F.to_json(F.struct(F.transform(entries, job).alias("jobs")))


def board_b_body(entries: Column) -> Column:
    job = lambda e: F.struct(
        text(pick(ROLES, e), " ", e).alias("text"),
        F.struct(F.when(e % 2 == 0, text("Team ", e % 3)).alias("team"), text("City ", e % 5).alias("location")).alias("categories"),
    )
    return F.to_json(F.transform(entries, job))


def careers_body(entries: Column) -> Column:
    item = lambda e: text("<li><a href='/j'> ", pick(ROLES, e), " <b>for the group</b> ", e, "</a><h2>short</h2></li>")
    return text("<html><ul>", joined(entries, item), "</ul><script>var a='Engineer of many things';</script></html>")


JOB_BODIES = {"board_a": board_a_body, "board_b": board_b_body, "careers_page": careers_body}


def job_captures(spark: SparkSession, folder: str) -> DataFrame:
    boards = [h.feed_captures(spark, folder, "jobs", b, role=F.lit(r)) for r, b in JOB_BODIES.items()]
    return boards[0].unionByName(boards[1]).unionByName(boards[2])


def job_targets(spark: SparkSession, folder: str) -> DataFrame:
    n = h.brand_number() % 3
    page = F.create_map(F.lit("careers_page"), F.lit("y"))
    attrs = (
        F.when(n == 0, F.map_concat(page, F.create_map(F.lit("board_a"), F.lit("x"))))
        .when(n == 1, F.map_concat(page, F.create_map(F.lit("board_b"), F.lit("x"))))
        .otherwise(page)
    )
    return h.feed_targets(spark, folder, "jobs", attrs=attrs)


_role = pick_sql(ROLES, "eid")
JOB_ITEMS = (
    "SELECT * FROM (SELECT target_id, scan_id, pos, CASE split_part(target_id, '#', 2)::INT % 3 "
    f"WHEN 0 THEN concat({_role}, ' ', eid, ' | ', CASE WHEN eid % 2 = 0 THEN concat('Dept ', eid % 3) END, ' | City ', eid % 5) "
    f"WHEN 1 THEN concat({_role}, ' ', eid, ' | ', CASE WHEN eid % 2 = 0 THEN concat('Team ', eid % 3) END, ' | City ', eid % 5) "
    f"WHEN 2 THEN CASE WHEN eid % 4 <> 2 THEN concat({_role}, 'for the group', eid) END END AS item FROM feed) "
    "WHERE item IS NOT NULL"
)


@query(
    "detect_jobs",
    q.reports(
        _feed_ctes(JOB_ITEMS),
        [
            dict(
                op="added", bucket=f"CASE WHEN {q.keyword_hit('ch.item', 'g.keywords', True)} THEN 'all' END",
                sections=_all(15, "concat('* ', substring(item, 1, 120))"),
                title="concat('New Job Postings: ', g.name, ' (', g.ticker, ')')",
                head="concat('**', r.n, ' interesting new roles**')", color=0x00BCD4, url="g.url",
                type="new_postings", log_title="concat(r.n, ' new roles')",
            )
        ],
        order="pos",
    ),
)
def detect_jobs(spark, folder):
    return report_rows(detect(job_captures(spark, folder), job_targets(spark, folder), MONITORS["jobs"]))


# --- graphql, github_org, huggingface, model_registry ------------------------------


def schema_body(entries: Column) -> Column:
    types = F.transform(
        entries,
        lambda e: F.struct(
            F.when(e % 7 == 0, text("__T", e)).otherwise(text("T", e)).alias("name"),
            F.when(e % 3 != 0, F.array(F.struct(F.lit("id").alias("name")), F.struct(text("f", e % 4).alias("name")))).alias("fields"),
        ),
    )
    mutations = F.transform(F.filter(entries, lambda e: e % 2 == 0), lambda e: F.struct(text("m", e).alias("name")))
    schema = F.struct(
        types.alias("types"),
        F.when(F.size(mutations) > 0, F.struct(mutations.alias("fields"))).alias("mutationType"),
    )
    return F.to_json(F.struct(F.struct(schema.alias("__schema")).alias("data")))


SCHEMA_ITEMS = (
    "SELECT target_id, scan_id, unnest(list_concat(CASE WHEN eid % 7 = 0 THEN []::VARCHAR[] ELSE "
    "list_concat([concat('type:T', eid)], CASE WHEN eid % 3 <> 0 THEN [concat('field:T', eid, '.id'), "
    "concat('field:T', eid, '.f', eid % 4)] ELSE []::VARCHAR[] END) END, "
    "CASE WHEN eid % 2 = 0 THEN [concat('mutation:m', eid)] ELSE []::VARCHAR[] END)) AS item FROM feed"
)
_short = "regexp_replace(item, '^[^:]*:', '')"

query(
    "detect_graphql",
    q.reports(
        _feed_ctes(SCHEMA_ITEMS),
        [
            dict(
                op="added", bucket="split_part(ch.item, ':', 1)",
                sections=[
                    ("type", 10, _short, "**New Types:** ", ", "),
                    ("mutation", 10, _short, "**New Mutations:** ", ", "),
                    ("field", 15, _short, "**New Fields:** ", ", "),
                ],
                title="concat('GraphQL Schema Change: ', g.name, ' (', g.ticker, ')')",
                head="concat('**', n_added, ' new schema items**')", color=0xE535AB, url="g.url",
                type="schema_change", log_title="concat(n_added, ' items')",
            )
        ],
    ),
)(_feed_query("graphql", schema_body))


def repos_body(entries: Column) -> Column:
    return F.to_json(
        F.transform(
            entries,
            lambda e: F.struct(
                text("o/r", e).alias("full_name"),
                F.when(e % 3 != 0, F.repeat(text(title(e), " "), 20)).alias("description"),
                text("https://h.example.com/o/r", e).alias("html_url"),
                e.cast("int").alias("stargazers_count"),
                F.lit("2024-05-06T00:00:00Z").alias("created_at"),
            ),
        )
    )


query(
    "detect_github_org",
    q.reports(
        _feed_ctes(
            "SELECT target_id, scan_id, concat('o/r', eid) AS item, CASE WHEN eid % 3 <> 0 THEN "
            f"repeat(concat({title_sql()}, ' '), 20) ELSE '' END AS descr FROM feed"
        ),
        [
            dict(
                op="added", bucket="'all'",
                sections=_all(
                    10,
                    "concat('* **[', item, '](https://h.example.com/', item, ')**', "
                    "CASE WHEN descr <> '' THEN concat(' — ', descr) END)",
                ),
                title="concat('New GitHub Repos: ', g.name)", head="concat('**', r.n, ' new public repo(s)** created')",
                color=0x6E5494, url="concat('https://github.com/', g.org, '?tab=repositories&sort=created')",
                type="new_repo", log_title="concat(r.n, ' repos')",
            )
        ],
        extra=", descr",
    ),
)(_feed_query("github_org", repos_body))


def models_body(entries: Column) -> Column:
    return F.to_json(
        F.transform(
            entries,
            lambda e: F.struct(
                text("org/m", e).alias("modelId"), e.alias("downloads"), (e % 9).alias("likes"),
                F.when(e % 2 == 0, F.lit("text-generation")).alias("pipeline_tag"), F.lit("2024-05-06").alias("createdAt"),
            ),
        )
    )


query(
    "detect_huggingface",
    q.reports(
        _feed_ctes("SELECT target_id, scan_id, concat('org/m', eid) AS item, eid % 2 = 0 AS tagged FROM feed"),
        [
            dict(
                op="added", bucket="'all'",
                sections=_all(
                    10,
                    "concat('* **[', item, '](https://huggingface.co/', item, ')**', "
                    "CASE WHEN tagged THEN ' (text-generation)' END)",
                ),
                title="concat('New HF Models: ', g.name)", head="concat('**', r.n, ' new model(s)** published')",
                color=0xFFD21E, url="concat('https://huggingface.co/', g.org)", type="new_model",
                log_title="concat(r.n, ' models')",
            )
        ],
        extra=", tagged",
    ),
)(_feed_query("huggingface", models_body))


def registry_body(entries: Column) -> Column:
    ids = joined(entries, lambda e: text('{"id": "model-', e, '", "owned": {"by": "x"}}'), ", ")
    names = joined(entries, lambda e: text('{"name": "models/m', e, '"}'), ", ")
    even = F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).cast("int") % 2 == 0
    return F.when(even, text('{"data": [', ids, ', "loose"]}')).otherwise(text('{"models": [', names, "]}"))


query(
    "detect_model_registry",
    q.reports(
        _feed_ctes(
            "SELECT target_id, scan_id, CASE WHEN split_part(target_id, '#', 2)::INT % 2 = 0 "
            "THEN concat('model-', eid) ELSE concat('models/m', eid) END AS item FROM feed"
        ),
        [
            dict(
                op="added", bucket="'all'", sections=_all(20, "concat('* `', item, '`')"),
                title="concat('🆕 New Models: ', g.name, ' (', g.ticker, ')')",
                head="concat('**', r.n, ' new model(s)** appeared in API')", color=0x9C27B0, url="g.url",
                type="new_model", log_title="concat(r.n, ' models')",
            ),
            dict(
                op="removed", bucket="'all'", sections=_all(10, "concat('* ~~`', item, '`~~')"),
                title="concat('❌ Models Removed: ', g.name, ' (', g.ticker, ')')",
                head="concat('**', r.n, ' model(s) delisted**')", color=0xFF5722, url="g.url",
            ),
        ],
    ),
)(_feed_query("model_registry", registry_body))


# --- versions ------------------------------------------------------------------


def version_sql(ctes: str, columns: dict[str, str]) -> str:
    """Reports over CTEs ``recs`` (target_id, scan_id, state, version, notes, ...) and ``targets``."""
    out = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    return (
        f"WITH {ctes}, moved AS (SELECT *, lag(state) OVER w AS old_state, lag(version) OVER w AS old_raw FROM recs "
        "WINDOW w AS (PARTITION BY target_id ORDER BY scan_id)), "
        "c AS (SELECT *, CASE WHEN coalesce(old_raw, '') = '' THEN 'unknown' ELSE old_raw END AS old_version "
        "FROM moved WHERE old_state IS NOT NULL AND old_state <> state) "
        f"SELECT c.target_id, c.scan_id, {out} FROM c JOIN targets g ON g.target_id = c.target_id"
    )


def release_body(entries: Column) -> Column:
    release = lambda e: F.struct(
        F.expr("p_partkey div 60").alias("id") if e is None else F.floor(e / 2).cast("bigint").alias("id"),
        text("v", F.floor(e / 2)).alias("tag_name"),
        F.when(F.floor(e / 2) % 3 != 0, text("Name ", F.floor(e / 2))).alias("name"),
        F.when(F.floor(e / 2) % 5 != 0, F.repeat(text("note ", F.floor(e / 2), " "), 150)).alias("body"),
        text("https://r.example.com/", F.floor(e / 2)).alias("html_url"),
    )
    return F.to_json(F.transform(entries, release))


_note = "CASE WHEN k % 5 = 0 THEN '' ELSE repeat(concat('note ', k, ' '), 150) END"

query(
    "detect_github_release",
    version_sql(
        f"feed AS ({cte.FEED}), targets AS ({cte.FEED_TARGETS}), recs AS (SELECT target_id, scan_id, k::VARCHAR AS state, "
        f"concat('v', k) AS version, {_note} AS notes, CASE WHEN k % 3 = 0 THEN 'No title' ELSE concat('Name ', k) END AS nm, k "
        "FROM (SELECT *, eid // 2 AS k FROM feed WHERE pos = 0))",
        {
            "detection_type": "'release'", "log_target": "c.target_id", "log_title": "version",
            "details": "notes", "alert_title": "concat('New Release: ', g.name)",
            "description": f"concat('**', version, '** — ', nm, {NL}, {NL}, substring(notes, 1, 500))",
            "color": str(0x2ECC71), "url": "concat('https://r.example.com/', k)", "fields": "''",
        },
    ),
)(_feed_query("github_release", release_body))


def lookup_body(entries: Column) -> Column:
    half, third = (lambda e: F.floor(e / 2)), (lambda e: F.floor(e / 3))
    app = lambda e: F.struct(
        (e % 3 + 1000).alias("trackId"), text("1.", half(e)).alias("version"),
        F.when(e % 5 != 0, text("Notes ", third(e))).alias("releaseNotes"), text("com.b.", e % 3).alias("bundleId"),
        (e * 12345678).cast("string").alias("fileSizeBytes"), text("https://s.example.com/", e % 3 + 1000).alias("trackViewUrl"),
    )
    return F.to_json(F.struct(F.transform(entries, app).alias("results")))


def app_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Three apps per brand, all served by one batch reply."""
    brands = h.feed_targets(spark, folder, "app_store")
    apps = brands.withColumn("k", F.explode(F.sequence(F.lit(1000), F.lit(1002))))
    attrs = F.create_map(F.lit("batch"), F.col("target_id"), F.lit("app_id"), F.col("k").cast("string"))
    return apps.withColumn("attrs", attrs).withColumn("target_id", text(F.col("target_id"), "-", F.col("k"))).drop("k")


@query(
    "detect_app_store",
    version_sql(
        f"feed AS ({cte.FEED}), targets AS (SELECT concat(target_id, '-', k) AS target_id, name FROM "
        f"(SELECT *, unnest(range(1000, 1003)) AS k FROM ({cte.FEED_TARGETS}))), "
        "recs AS (SELECT concat(b, '-', k) AS target_id, scan_id, concat(version, ':', notes) AS state, version, notes, k, eid FROM "
        "(SELECT target_id AS b, scan_id, eid, eid % 3 + 1000 AS k, concat('1.', eid // 2) AS version, "
        "CASE WHEN eid % 5 = 0 THEN '' ELSE concat('Notes ', eid // 3) END AS notes FROM feed "
        "QUALIFY row_number() OVER (PARTITION BY target_id, scan_id, eid % 3 ORDER BY pos DESC) = 1))",
        {
            "detection_type": "'version_update'", "log_target": "c.target_id", "log_title": "concat('v', version)",
            "details": "notes", "alert_title": "concat('iOS Update: ', g.name, ' v', version)",
            "description": f"concat('**`com.b.', k - 1000, '`** updated to **v', version, '**', {NL}, {NL}, '**What''s New:**', "
            f"{NL}, CASE WHEN notes = '' THEN 'No release notes provided' ELSE substring(notes, 1, 1500) END)",
            "color": str(0x1ABC9C), "url": "concat('https://s.example.com/', k)",
            "fields": "concat('Size=', printf('%.1f', eid * 12345678 / 1e6), ' MB; Store=[App Store](https://s.example.com/', k, ')')",
        },
    ),
)
def detect_app_store(spark, folder):
    captures = h.feed_captures(spark, folder, "app_store", lookup_body)
    return report_rows(detect(captures, app_targets(spark, folder), MONITORS["app_store"]))


def app_record_body(entries: Column) -> Column:
    e = F.element_at(entries, 1)
    return F.to_json(
        F.struct(
            F.when(e % 7 != 0, text("2.", F.floor(e / 2))).alias("version"),
            F.when(e % 4 != 0, text("  what ", F.floor(e / 3), " \n")).alias("recentChanges"),
            text("2024-03-0", e % 9 + 1, " 10:00").alias("updated"), F.lit("10+").alias("installs"), F.lit(4.5).alias("score"),
        )
    )


PLAY_RECORDS = (
    "recs AS (SELECT *, concat(version, ':', coalesce(notes, 'None')) AS state FROM (SELECT target_id, scan_id, eid, "
    "CASE WHEN eid % 7 = 0 THEN '' ELSE concat('2.', eid // 2) END AS version, "
    "CASE WHEN eid % 4 = 0 THEN NULL ELSE concat('what ', eid // 3) END AS notes FROM feed WHERE pos = 0))"
)

query(
    "detect_play_store",
    version_sql(
        f"feed AS ({cte.FEED}), targets AS ({cte.FEED_TARGETS}), {PLAY_RECORDS}",
        {
            "detection_type": "'play_update'", "log_target": "c.target_id", "log_title": "concat('v', version)",
            "details": "coalesce(notes, '')", "alert_title": "concat('Play Store Update: ', g.name)",
            "description": f"concat('**`', c.target_id, '`** has been updated', {NL}, {NL}, CASE WHEN version <> '' THEN "
            f"concat('**', old_version, ' → ', version, '**', {NL}, {NL}) END, '**What''s New:**', {NL}, "
            "coalesce(notes, 'No changelog provided by developer'))",
            "color": str(0x4CAF50), "url": "concat('https://play.google.com/store/apps/details?id=', c.target_id)",
            "fields": "concat('Version=', version, '; Updated=2024-03-0', eid % 9 + 1, "
            "'; Store=[Google Play](https://play.google.com/store/apps/details?id=', c.target_id, ')')",
        },
    ),
)(_feed_query("play_store", app_record_body))


def npm_body(entries: Column) -> Column:
    e = F.element_at(entries, 1)
    deps = F.map_from_entries(F.transform(entries, lambda x: F.struct(text("dep-", F.floor(x / 4), "-", x % 4), F.lit("^1"))))
    return F.to_json(
        F.struct(
            text("3.", F.floor(e / 2)).alias("version"), title(F.floor(e / 3)).alias("description"),
            F.when(e % 6 != 0, deps).alias("dependencies"),
        )
    )


query(
    "detect_npm",
    version_sql(
        f"feed AS ({cte.FEED}), targets AS ({cte.FEED_TARGETS}), deps AS (SELECT target_id, scan_id, "
        "string_agg(concat('dep-', eid // 4, '-', eid % 4), ', ' ORDER BY pos) AS deps, min(eid) AS e FROM feed GROUP BY ALL), "
        f"recs AS (SELECT *, concat(version, ':', notes, ':', deps) AS state FROM (SELECT target_id, scan_id, e, concat('3.', e // 2) AS version, "
        f"{title_sql('(e // 3)')} AS notes, CASE WHEN e % 6 = 0 THEN 'None' ELSE deps END AS deps FROM deps))",
        {
            "detection_type": "'version_update'", "log_target": "c.target_id", "log_title": "concat(c.target_id, ' ', version)",
            "details": "notes", "alert_title": "concat('npm Update: ', c.target_id, ' (', g.name, ')')",
            "description": f"concat('**', old_version, ' -> ', version, '**', {NL}, {NL}, substring(notes, 1, 500))",
            "color": str(0xCB3837), "url": "concat('https://www.npmjs.com/package/', c.target_id)",
            "fields": "concat('Package=[', c.target_id, '](https://www.npmjs.com/package/', c.target_id, '); New Deps=', deps)",
        },
    ),
)(_feed_query("npm", npm_body))


def pypi_body(entries: Column) -> Column:
    e = F.element_at(entries, 1)
    info = F.struct(text("4.", F.floor(e / 2)).alias("version"), F.when(e % 3 != 0, title(e)).alias("summary"))
    return F.to_json(F.struct(info.alias("info")))


query(
    "detect_pypi",
    version_sql(
        f"feed AS ({cte.FEED}), targets AS ({cte.FEED_TARGETS}), recs AS (SELECT *, concat(version, ':', notes) AS state FROM "
        "(SELECT target_id, scan_id, concat('4.', eid // 2) AS version, "
        f"CASE WHEN eid % 3 = 0 THEN '' ELSE {title_sql()} END AS notes FROM feed WHERE pos = 0))",
        {
            "detection_type": "'version_update'", "log_target": "c.target_id", "log_title": "concat(c.target_id, ' ', version)",
            "details": "notes", "alert_title": "concat('PyPI Update: ', c.target_id, ' (', g.name, ')')",
            "description": f"concat('**', old_version, ' -> ', version, '**', {NL}, {NL}, substring(notes, 1, 500))",
            "color": str(0x3775A9), "url": "concat('https://pypi.org/project/', c.target_id, '/')", "fields": "''",
        },
    ),
)(_feed_query("pypi", pypi_body))


# --- apk_strings: resources of packages whose version moved -------------------------

LABELS = ["Photo Booth", "Agent Desk", "Sign In", "Smart Canvas", "Learn More", "Voice Lab", "Quick Notes"]
LOCALES = ["en", "fr", "en-US", "", "en-GB"]


def _value(e: Column) -> Column:
    return (
        F.when(e % 4 == 0, pick(LABELS, e))
        .when(e % 4 == 1, text("Try the new mode ", e))
        .when(e % 4 == 2, text(" Open the saved file ", e, " "))
        .otherwise(text("https://x.example.com/", e))
    )


def resource_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Package strings: one landed resource per entry."""
    part = h.table(spark, folder, "part").select(
        "p_brand", "p_partkey", F.posexplode(F.expr("sequence(p_partkey div 30, p_partkey div 30 + p_size % 6)")).alias("seq", "e")
    )
    e = F.col("e")
    name = F.when(e % 9 == 0, text("abc_", e)).otherwise(text("title_", F.floor(e / 2)))
    return h.as_captures(
        part, "apk_strings", F.col("p_brand"), F.col("p_partkey"), _value(e), url=name, role=pick(LOCALES, e),
        captured_at=F.timestamp_seconds(F.col("seq")),
    )


APK_CTES = (
    f"feed AS ({cte.FEED}), targets AS ({cte.FEED_TARGETS}), {PLAY_RECORDS}, "
    "due AS (SELECT target_id, scan_id, version FROM (SELECT *, lag(state) OVER (PARTITION BY target_id ORDER BY scan_id) AS o "
    "FROM recs) WHERE o IS NULL OR o <> state), "
    "res AS (SELECT p.target_id, p.scan_id, pos, CASE WHEN eid % 9 = 0 THEN concat('abc_', eid) ELSE concat('title_', eid // 2) END AS name, "
    f"{pick_sql(LOCALES, 'eid')} AS locale, CASE eid % 4 WHEN 0 THEN {pick_sql(LABELS, 'eid')} WHEN 1 THEN concat('Try the new mode ', eid) "
    "WHEN 2 THEN concat(' Open the saved file ', eid, ' ') ELSE concat('https://x.example.com/', eid) END AS value "
    "FROM feed p JOIN due d ON d.target_id = p.target_id AND d.scan_id = p.scan_id), "
    f"last AS (SELECT target_id, scan_id, name, {q.strip('value')} AS v FROM res WHERE locale <> 'fr' "
    "QUALIFY row_number() OVER (PARTITION BY target_id, scan_id, name ORDER BY list_position(['en', 'en-US', 'en-GB', ''], locale), pos DESC) = 1), "
    f"items AS (SELECT target_id, scan_id, v AS item FROM last WHERE {q.resource_ok('name', 'v')} AND ({q.resource_category('v')}) IS NOT NULL)"
)


@query(
    "detect_apk_strings",
    q.reports(
        APK_CTES,
        [
            dict(
                op="added", bucket=q.resource_category("ch.item"),
                sections=[
                    ("high_interest", 15, "concat('* ', item)", "**🔥 High Interest:**\n", "\n"),
                    ("feature_name", 15, "concat('* ', item)", "**⭐ Feature Names:**\n", "\n"),
                    ("ui_text", 20, "concat('* ', item)", "**📝 New UI Text:**\n", "\n"),
                ],
                title="concat('🔍 APK Strings: ', g.name, ' v', (SELECT version FROM due d WHERE d.target_id = r.target_id AND d.scan_id = r.scan_id))",
                head="concat('**', n_added, ' new UI strings** found in APK decompilation')", color=0xE91E63,
                url="concat('https://play.google.com/store/apps/details?id=', r.target_id)", type="new_strings",
                log_title="concat(n_added, ' strings')", log_target="g.name",
            ),
            dict(
                op="removed", bucket="'all'", sections=_all(15, "concat('* ~~', item, '~~')"),
                title="concat('🔍 APK Removed: ', g.name, ' v', (SELECT version FROM due d WHERE d.target_id = r.target_id AND d.scan_id = r.scan_id))",
                head="concat('**', n_removed, ' strings removed** (feature launched or killed?)')", color=0xFF9800,
                url="concat('https://play.google.com/store/apps/details?id=', r.target_id)",
            ),
        ],
    ),
)
def detect_apk_strings(spark, folder):
    play = h.feed_captures(spark, folder, "play_store", app_record_body)
    targets = h.feed_targets(spark, folder, "play_store").unionByName(h.feed_targets(spark, folder, "apk_strings"))
    captures = resource_captures(spark, folder).unionByName(play)
    return report_rows(detect(captures, targets, MONITORS["apk_strings"]))


def _watch(monitor: str) -> Callable:
    return lambda spark, folder: h.feed_targets(spark, folder, monitor)


INPUTS |= {
    "js_deep": (js_captures, lambda spark, folder: h.document_targets(spark, folder, "js_deep")),
    "docs": (h.document_captures, h.document_targets),
    "page_change": (lambda spark, folder: h.page_captures(spark, folder, "page_change"), selecting_targets),
    "sitemap": (sitemap_captures, sitemap_targets),
    "trademark": (trademark_captures, _watch("trademark")),
    "subdomains": (probe_captures, probe_targets),
    "dns_records": (dns_captures, _watch("dns_records")),
    "chrome_flags": (flag_captures, _watch("chrome_flags")),
    "jobs": (job_captures, job_targets),
    "app_store": (lambda spark, folder: h.feed_captures(spark, folder, "app_store", lookup_body), app_targets),
    "apk_strings": (resource_captures, _watch("apk_strings")),
}
