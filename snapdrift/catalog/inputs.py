"""SQL counterparts of :mod:`snapdrift.sources.histories`, as CTE bodies."""

from __future__ import annotations

DOCS = (
    "SELECT source AS target_id, doc_id * 2 AS scan_id, 200 AS status, text AS body FROM documents UNION ALL "
    "SELECT source, doc_id * 2 + 1, CASE WHEN doc_id % 7 = 0 THEN 500 ELSE 200 END, "
    "CASE WHEN doc_id % 7 = 0 THEN 'gone' ELSE '' END FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0"
)
DOC_TARGETS = (
    "SELECT DISTINCT source AS target_id, source AS name, concat('https://', source, '.example.com/') AS url, "
    "CASE WHEN regexp_extract(source, '([0-9]+)$', 1)::INT % 3 = 1 THEN ['Lorem', 'with'] ELSE [] END AS keywords "
    "FROM documents"
)
PAGES = (
    "SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS target_id, page_id AS scan_id, url, html AS body FROM pages"
)
PAGE_TARGETS = (
    "SELECT DISTINCT h AS target_id, h AS name, '' AS ticker, concat('https://', h, '/a/b') AS url, "
    "regexp_replace(h, '^(?:www|blog|m)\\.', '') AS domain "
    "FROM (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM pages)"
)
EVENTS = (
    "SELECT DISTINCT user_id::VARCHAR AS target_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS scan_id, "
    "concat(event_type, ':', json_extract_string(props, '$.k')) AS item FROM events"
)
SHIPMENTS = (
    "SELECT DISTINCT l_suppkey::VARCHAR AS target_id, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS scan_id, "
    "l_partkey::VARCHAR AS item FROM lineitem"
)
ORDERS = (
    "SELECT o_custkey::VARCHAR AS target_id, o_orderkey AS scan_id, o_orderstatus AS version, o_orderpriority AS notes "
    "FROM orders"
)
# one row per entry of each usable feed scan: pos, eid (window), p_* columns
FEED = (
    "SELECT p_brand AS target_id, p_partkey AS scan_id, i AS pos, p_partkey // 30 + i AS eid, p_size, p_type, p_name "
    "FROM (SELECT *, unnest(range(p_size % 6 + 1)) AS i FROM part)"
)
FEED_TARGETS = (
    "SELECT target_id, n, concat('Name ', target_id) AS name, concat('T', n) AS ticker, "
    "concat('https://feed.example.com/', n) AS url, concat('b', n, '.example.com') AS domain, concat('org', n) AS org, "
    "CASE n % 3 WHEN 1 THEN ['Beta', '7'] WHEN 2 THEN ['alpha'] ELSE [] END AS keywords "
    "FROM (SELECT DISTINCT p_brand AS target_id, split_part(p_brand, '#', 2)::INT AS n FROM part)"
)
