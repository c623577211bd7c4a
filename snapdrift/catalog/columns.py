"""Column function queries: filters and helpers over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdrift.catalog import inputs as cte
from snapdrift.catalog import sqltext as q
from snapdrift.catalog.monitors import pick, pick_sql, text
from snapdrift.catalog.registry import query
from snapdrift.functions import cadence, filters as flt
from snapdrift.functions import patterns as p
from snapdrift.functions import text as t
from snapdrift.functions import urls as u
from snapdrift.sources import histories as h

# strings that reach every branch of the script and resource filters
SEEDS = """
deadbeef01
#a1b2c3
12.5px
2rem
1.5em
50%
rgba(0,0,0)
hsl(1,2,3)
data:image/png
https://x.example.com
/api/v1
.btn-primary
QWxhZGRpbjpvcGVuIHNlc2FtZQQWxhZGRpbjpvcGVu
1.2.3
_private
$scope
@@iterator
a.b.c.d.e
fooBarBazQux
{{name}}
<div class
svg path
M10 20,30
abc==
ns:key:value
1234567890
,a:b
word;
!important now
undefined
aria-label
Content-Type
Coming Soon to you
not yet available
feature_flag on
roll-out of rollout
% of users see
A/B test cohort
Try the new editor
beta
alphabeta
Beta!
Preview mode
Photo Studio
photo studio
Workspaces
Work
workspaces now
tokenization
token
Save {a} {b} {c} {d} now
%s %s %s of
Got It
Smart Canvas
See what is new today
see what is new today
ok
Cancel
com.example.app.name
@string/title
res/drawable
android.permission
updated on 3
Last modified yesterday
Copyright 2024 Example
© 2024 Example all
2024-01-02
January 5 release
docs
A new GA release of the API
Generally Available in Région
l'AI générative arrive
newly pricing renewed
""".strip().split("\n")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct lines and words of the documents, with the seeds among them."""
    d = h.text_table(spark, folder, "documents")
    strings = F.concat(t.lines(F.col("text")), t.words(F.col("text")), F.array(pick(SEEDS, F.col("doc_id"))))
    return d.select(F.explode(strings).alias("s")).distinct()


_words = f"list_filter(regexp_split_to_array(text, {q.lit(p.BLANKS)}), lambda w: w <> '')"
CORPUS = (
    f"SELECT DISTINCT unnest(list_concat(list_concat({q.lines('text')}, {_words}), [{pick_sql(SEEDS, 'doc_id')}])) AS s FROM documents"
)
NAMES = ["title", "abc_action", "Content_Desc_x", "errors", "error_x"]


@query("js_noise_filter", f"WITH corpus AS ({CORPUS}) SELECT s FROM corpus WHERE {q.script_ok('s')}")
def js_noise_filter(spark, folder):
    return corpus(spark, folder).filter(flt.script_noise_ok(F.col("s")))


@query("js_categorize", f"WITH corpus AS ({CORPUS}) SELECT s, {q.script_category('s')} AS category FROM corpus")
def js_categorize(spark, folder):
    return corpus(spark, folder).select("s", flt.script_category(F.col("s")).alias("category"))


@query(
    "resource_noise_filter",
    f"WITH corpus AS ({CORPUS}), named AS (SELECT s, {pick_sql(NAMES, 'length(s)')} AS name FROM corpus) "
    f"SELECT s, name FROM named WHERE {q.resource_ok('name', 's')}",
)
def resource_noise_filter(spark, folder):
    named = corpus(spark, folder).withColumn("name", pick(NAMES, F.length("s")))
    return named.filter(flt.resource_noise_ok(F.col("name"), F.col("s")))


@query("resource_categorize", f"WITH corpus AS ({CORPUS}) SELECT s, {q.resource_category('s')} AS category FROM corpus")
def resource_categorize(spark, folder):
    return corpus(spark, folder).select("s", flt.resource_category(F.col("s")).alias("category"))


KEYED_LINES = (
    f"keyed AS (SELECT DISTINCT d.target_id, unnest(list_concat({q.lines('body')}, [{pick_sql(SEEDS, 'scan_id')}])) AS item, g.keywords "
    f"FROM ({cte.DOCS}) d JOIN ({cte.DOC_TARGETS}) g ON g.target_id = d.target_id)"
)


def keyed_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = h.document_captures(spark, folder)
    strings = F.concat(t.lines(F.col("body")), F.array(pick(SEEDS, F.col("scan_id"))))
    lines = rows.select("target_id", F.explode(strings).alias("item")).distinct()
    targets = h.document_targets(spark, folder).select("target_id", t.keyword_regex(F.col("keywords")).alias("regex"))
    return lines.sortWithinPartitions("target_id").join(targets, "target_id")


@query("doc_signal_filter", f"WITH {KEYED_LINES} SELECT target_id, item FROM keyed WHERE {q.doc_signal('item', 'keywords')}")
def doc_signal_filter(spark, folder):
    rows = keyed_lines(spark, folder)
    keyword = t.keyword_hit(F.col("item"), F.col("regex"), if_none=False)
    return rows.filter(flt.doc_signal(F.col("item"), keyword)).select("target_id", "item")


@query(
    "keyword_match",
    f"WITH {KEYED_LINES} SELECT target_id, item, {q.keyword_hit('item', 'keywords', True)} AS or_all, "
    f"{q.keyword_hit('item', 'keywords', False)} AS or_none FROM keyed",
)
def keyword_match(spark, folder):
    item, regex = F.col("item"), F.col("regex")
    return keyed_lines(spark, folder).select(
        "target_id", "item", t.keyword_hit(item, regex, True).alias("or_all"), t.keyword_hit(item, regex, False).alias("or_none")
    )


@query(
    "pattern_match",
    "SELECT page_id, CASE WHEN length(url) % 3 = 0 THEN true ELSE regexp_matches(url, '(?i)/EN/') "
    "OR regexp_matches(url, '(?i)[0-9]\\.html$') END AS kept FROM pages",
)
def pattern_match(spark, folder):
    none = F.array().cast("array<string>")
    patterns = F.when(F.length("url") % 3 == 0, none).otherwise(F.array(F.lit("/EN/"), F.lit(r"[0-9]\.html$")))
    return h.table(spark, folder, "pages").select("page_id", t.matches_any(F.col("url"), patterns).alias("kept"))


@query(
    "notable_removed",
    f"WITH corpus AS ({CORPUS}) SELECT s FROM corpus WHERE {q.word_count('s')} >= 2 AND {q.upper_first('s')}",
)
def notable_removed(spark, folder):
    return corpus(spark, folder).filter(flt.notable_removed(F.col("s")))


@query(
    "text_clip",
    f"SELECT doc_id, item, substring(item, 1, 80) AS c80, substring(item, 1, 150) AS c150 FROM (SELECT doc_id, unnest({q.lines('text')}) AS item FROM documents)",
)
def text_clip(spark, folder):
    lines = h.text_table(spark, folder, "documents").select("doc_id", F.explode(t.lines(F.col("text"))).alias("item"))
    return lines.select("doc_id", "item", t.clip(F.col("item"), 80).alias("c80"), t.clip(F.col("item"), 150).alias("c150"))


# --- urls, names -----------------------------------------------------------------

DIR = "regexp_extract(url, '^(https?://[^?#]*/)', 1)"
ROOT = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
REFERENCES = {
    "a/b.js": f"concat({DIR}, 'a/b.js')",
    "../c?x=1": f"concat(regexp_replace({DIR}, '[^/]+/$', ''), 'c?x=1')",
    "/abs/d": f"concat({ROOT}, '/abs/d')",
    "//host.example.com/e": "concat(regexp_extract(url, '^(https?:)', 1), '//host.example.com/e')",
    "https://o.example.com/f#z": "'https://o.example.com/f#z'",
    "?q=1": "concat(regexp_extract(url, '^([^?#]*)', 1), '?q=1')",
    "#frag": "concat(regexp_extract(url, '^([^#]*)', 1), '#frag')",
    "./g": f"concat({DIR}, 'g')",
    "../../../h": f"concat({ROOT}, '/h')",
    "i/../j/": f"concat({DIR}, 'j/')",
    "k//l": f"concat({DIR}, 'k/l')",
    "": "url",
}


@query(
    "resolve_url",
    " UNION ALL ".join(f"SELECT page_id, {q.lit(r)} AS ref, {sql} AS resolved FROM pages" for r, sql in REFERENCES.items()),
)
def resolve_url(spark, folder):
    refs = F.array(*[F.lit(r) for r in REFERENCES])
    rows = h.table(spark, folder, "pages").select("page_id", "url", F.explode(refs).alias("ref"))
    return rows.select("page_id", "ref", u.resolve_url(F.col("url"), F.col("ref")).alias("resolved"))


@query("strip_query", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS address FROM pages")
def strip_query(spark, folder):
    return h.table(spark, folder, "pages").select("page_id", u.strip_query(F.col("url")).alias("address"))


@query(
    "target_key",
    "SELECT page_id, concat(regexp_extract(url, '^https?://([^/?#]+)', 1), ':', substring(md5(url), 1, 8)) AS target_id FROM pages",
)
def target_key(spark, folder):
    url = F.col("url")
    return h.table(spark, folder, "pages").select("page_id", t.target_key(h.host(url), url).alias("target_id"))


CERT_SEEDS = """
cdn static-x wl-7 smtp2 grafana ci-run dev5 ns1 sso vpn-eu pixel redis www api-x careers dasher autopush prism 7kx9f ip-10
i-0a1b ec2-x build-12345678 site-deadbeef a-b3x9f stg42 abc123 zgqup7 bxkrf3 ab a.b.c.d studio lab.notes canvas agents gemini
""".split()


@query(
    "cert_name_filter",
    f"WITH names AS (SELECT DISTINCT concat({pick_sql(CERT_SEEDS, 'page_id')}, '.', h) AS name, h AS domain FROM "
    "(SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM pages) UNION SELECT DISTINCT h, regexp_replace(h, '^(?:www|blog|m)\\.', '') "
    f"FROM (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM pages)) SELECT name, domain FROM names WHERE {q.cert_ok('name', 'domain')}",
)
def cert_name_filter(spark, folder):
    pages = h.table(spark, folder, "pages").select("page_id", h.host(F.col("url")).alias("h"))
    seeded = pages.select(text(pick(CERT_SEEDS, F.col("page_id")), ".", F.col("h")).alias("name"), F.col("h").alias("domain"))
    plain = pages.select(F.col("h").alias("name"), F.regexp_replace("h", r"^(?:www|blog|m)\.", "").alias("domain"))
    names = seeded.unionByName(plain).distinct()
    return names.filter(flt.cert_name_ok(F.col("name"), F.col("domain")))


ASSET_SEEDS = """
img/hero.png
x/0123456789012345678901234567890123456789/a.png
img/abcdefghijklmnopqrstuvwx
img/deadbeef01.PNG
deadbeef01.png
img/pixel-10.png
t/pixel/x.gif
js/analytics.js
a/collect
img/1x1.gif
img/spacer.gif
blob:abc
img/logo-2024.svg
""".strip().split("\n")


@query(
    "asset_noise_filter",
    f"WITH assets AS (SELECT DISTINCT unnest([regexp_extract(url, '^[a-z]+://([^?#]*)', 1), concat(regexp_extract(url, '^https?://([^/?#]+)', 1), '/', "
    f"{pick_sql(ASSET_SEEDS, 'page_id')})]) AS asset FROM pages) SELECT asset FROM assets WHERE {q.asset_ok('asset')}",
)
def asset_noise_filter(spark, folder):
    url = F.col("url")
    both = F.array(u.strip_query(url), text(h.host(url), "/", pick(ASSET_SEEDS, F.col("page_id"))))
    assets = h.table(spark, folder, "pages").select(F.explode(both).alias("asset")).distinct()
    return assets.filter(flt.asset_ok(F.col("asset")))


@query(
    "schema_kind",
    "SELECT p_partkey, split_part(item, ':', 1) AS kind, regexp_replace(item, '^[^:]*:', '') AS name FROM "
    "(SELECT p_partkey, concat(CASE p_size % 3 WHEN 0 THEN 'type:' WHEN 1 THEN 'field:' ELSE 'mutation:' END, p_type, ':', p_name) AS item FROM part)",
)
def schema_kind(spark, folder):
    kind = F.when(F.col("p_size") % 3 == 0, "type:").when(F.col("p_size") % 3 == 1, "field:").otherwise("mutation:")
    items = h.table(spark, folder, "part").select("p_partkey", text(kind, F.col("p_type"), ":", F.col("p_name")).alias("item"))
    return items.select("p_partkey", flt.schema_kind(F.col("item")).alias("kind"), flt.schema_name(F.col("item")).alias("name"))


@query(
    "scan_cadence",
    "WITH e AS (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS l FROM events), "
    "c AS (SELECT *, hour(l) * 60 + minute(l) AS mod, dayofweek(l) IN (0, 6) AS weekend, "
    "CASE WHEN hour(l) < 6 THEN date_trunc('day', l) + INTERVAL 6 HOUR ELSE date_trunc('day', l) + INTERVAL 30 HOUR END AS six FROM e), "
    "w AS (SELECT *, greatest(60, (epoch_us(six) - epoch_us(l)) // 1000000)::INTEGER AS wait FROM c) "
    "SELECT event_id, mod >= 360 AND mod < 1200 AS active, CASE WHEN mod >= 1200 OR mod < 360 THEN 'overnight' WHEN weekend THEN 'weekend' "
    "WHEN mod >= 570 AND mod < 960 THEN 'market' ELSE 'off_hours' END AS cadence, "
    "CASE WHEN mod >= 1200 OR mod < 360 OR weekend THEN wait WHEN mod >= 570 AND mod < 960 THEN 900 ELSE 3600 END AS next_scan_seconds FROM w",
)
def scan_cadence(spark, folder):
    ts = F.col("ts")
    events = h.table(spark, folder, "events")
    rows = events.select("event_id", cadence.is_active(ts).alias("active"), cadence.scan_cadence(ts).alias("c"))
    return rows.select("event_id", "active", "c.cadence", "c.next_scan_seconds")
