"""Plain SQL for checking the Spark jobs in another engine.

The statements say what a result is, not how Spark computes it: previous scans
by ``lag``, differences by ``NOT EXISTS``, reports by ``string_agg``.
"""

from __future__ import annotations

import re

from snapdrift.functions import fixed_values as fv
from snapdrift.functions import patterns as p


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items) -> str:
    return "(" + ", ".join(lit(x) for x in items) + ")"


def phrase(template: str, **values: str) -> str:
    parts = []
    for text in re.split(r"(\{\w+\})", template):
        if text.startswith("{") and text[1:-1] in values:
            parts.append(values[text[1:-1]])
        elif text:
            parts.append(lit(text))
    return f"concat({', '.join(parts)})"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(p.STRIP)}, '', 'g')"


def word_count(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, {lit(p.BLANKS)}), lambda w: w <> ''))"


def upper_first(x: str) -> str:
    return has(x, p.UPPER_FIRST)


def letters(x: str) -> str:
    return f"length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g'))"


def chars(x: str, which: str) -> str:
    return f"(length({x}) - length(translate({x}, {lit(which)}, '')))"


def lines(x: str) -> str:
    stripped = f"list_transform(string_split({x}, chr(10)), lambda l: {strip('l')})"
    return f"list_filter({stripped}, lambda l: l <> '')"


def entities(x: str) -> str:
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = f"replace({x}, {lit(name)}, {lit(char)})"
    return x


def visible_lines(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', chr(10), 'g')"
    for tag in ("script", "style", "nav", "footer", "header"):
        x = f"regexp_replace({x}, '(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?s)<[a-zA-Z/!][^>]*>', chr(10), 'g')"
    return lines(entities(x))


def script_ok(s: str) -> str:
    tokens = words(fv.SCRIPT_NOISE_TOKENS)
    return (
        f"(length({s}) BETWEEN 4 AND 500 AND {s} NOT IN {tokens} AND lower({s}) NOT IN {tokens} "
        f"AND {chars(s, fv.CODE_CHARS)} <= 3 AND {letters(s)} * 2 >= length({s}) AND NOT {has(s, p.SCRIPT_NOISE)})"
    )


def script_category(s: str) -> str:
    n = word_count(s)
    return (
        f"CASE WHEN {has(s, p.SCRIPT_INTEREST)} THEN 'high_interest' WHEN {n} >= 3 THEN 'ui_text' "
        f"WHEN {n} >= 2 AND {upper_first(s)} THEN 'feature_name' "
        f"WHEN {n} = 1 AND {upper_first(s)} AND length({s}) >= 5 THEN 'proper_noun' "
        f"WHEN {n} = 1 AND length({s}) < 8 THEN NULL ELSE 'string' END"
    )


def resource_ok(name: str, v: str) -> str:
    return (
        f"(length({v}) BETWEEN 4 AND 500 AND {chars(v, '%')} <= 2 AND {chars(v, '{')} <= 3 "
        f"AND {letters(v)} * 5 >= length({v}) * 2 AND NOT {has(name, p.RESOURCE_NAME_NOISE)} "
        f"AND NOT {has(v, p.RESOURCE_NOISE)})"
    )


def resource_category(v: str) -> str:
    title = has(v, fv.TITLE_CASE_PATTERN)
    return (
        f"CASE WHEN {has(v, p.RESOURCE_INTEREST)} THEN 'high_interest' "
        f"WHEN {title} THEN CASE WHEN {v} IN {words(fv.STOCK_LABELS)} THEN NULL ELSE 'feature_name' END "
        f"WHEN {word_count(v)} >= 4 AND {upper_first(v)} THEN 'ui_text' END"
    )


def keyword_hit(x: str, keywords: str, if_none: bool) -> str:
    return (
        f"CASE WHEN len({keywords}) = 0 THEN {str(if_none).lower()} "
        f"ELSE len(list_filter({keywords}, lambda k: contains(lower({x}), lower(k)))) > 0 END"
    )


def doc_signal(x: str, keywords: str | None = None) -> str:
    signal = has(x, p.DOC_SIGNAL)
    if keywords:
        signal = f"({signal} OR {keyword_hit(x, keywords, False)})"
    return f"(length({x}) >= 10 AND NOT {has(x, p.DOC_NOISE)} AND {signal})"


def cert_ok(name: str, domain: str) -> str:
    sub = f"replace({name}, concat('.', lower({domain})), '')"
    return (
        f"(length({sub}) >= 3 AND {chars(sub, '.')} <= 2 "
        f"AND NOT ({has(sub, '^[a-z0-9]{4,8}$')} AND {chars(sub, 'aeiou')} * 4 < length({sub})) "
        f"AND NOT {has(sub, p.CERT_NOISE)} AND NOT {has(sub, p.CERT_NOISE_WORDS)})"
    )


def asset_ok(a: str) -> str:
    path = f"regexp_replace({a}, '^[^/]*/', '')"
    last = f"regexp_extract({path}, '([^/]+)/*$', 1)"
    return (
        f"(NOT {has(a, p.ASSET_NOISE_WORDS + '|data:|blob:')} AND NOT {has(path, fv.ASSET_LONG_HASH)} "
        f"AND NOT {has(last, fv.ASSET_HASH_SEGMENT)} AND NOT {has(path, '(?i)' + fv.ASSET_HASH_FILE)})"
    )


def differences(order: str = "item", repeats: bool = False, extra: str = "") -> str:
    """CTEs ``chain, it, ch`` over CTEs ``items`` and ``scans``.

    ``repeats`` keeps every occurrence and reports additions only.
    """
    cols = "target_id, scan_id, item" + (", pos" if order == "pos" or repeats else "") + extra
    if repeats:
        it = f"SELECT {cols} FROM items"
    elif order == "pos":
        it = "SELECT target_id, scan_id, item, min(pos) AS pos" + extra + " FROM items GROUP BY ALL"
    else:
        it = f"SELECT DISTINCT {cols} FROM items"
    more = (", i.pos" if order == "pos" or repeats else "") + "".join(f", i.{c.strip()}" for c in extra.split(",") if c.strip())
    gone = "" if repeats else (
        " UNION ALL SELECT 'removed' AS op, c.target_id, c.scan_id, i.item" + more.replace(", i.pos", ", NULL AS pos")
        + " FROM it i JOIN chain c ON i.target_id = c.target_id AND i.scan_id = c.prev"
        " WHERE NOT EXISTS (SELECT 1 FROM it o WHERE o.target_id = c.target_id AND o.scan_id = c.scan_id AND o.item = i.item)"
    )
    return (
        "chain AS (SELECT target_id, scan_id, lag(scan_id) OVER (PARTITION BY target_id ORDER BY scan_id) AS prev FROM scans), "
        f"it AS ({it}), "
        "ch AS (SELECT 'added' AS op, c.target_id, c.scan_id, i.item" + more
        + " FROM it i JOIN chain c ON i.target_id = c.target_id AND i.scan_id = c.scan_id"
        " WHERE c.prev IS NOT NULL AND NOT EXISTS"
        " (SELECT 1 FROM it o WHERE o.target_id = c.target_id AND o.scan_id = c.prev AND o.item = i.item)" + gone + ")"
    )


def reports(
    ctes: str,
    alerts: list[dict],
    order: str = "item",
    changes: str | None = None,
    repeats: bool = False,
    extra: str = "",
    scans_from: str | None = None,
) -> str:
    """Full statement for the reports of an item monitor.

    ``ctes`` defines ``items`` and ``targets``; ``scans_from`` says where the
    scans come from if not from the items. Each alert is a dict with ``op``,
    ``bucket`` (SQL), ``sections`` [(bucket, cap, line, heading, separator)],
    ``joiner``, ``title``, ``head``, ``color``, ``url`` and, optionally,
    ``fence``, ``type``, ``log_title``, ``log_target``,
    ``fields``, ``first_url``.
    """
    scans = scans_from or "SELECT DISTINCT target_id, scan_id FROM items"
    body = changes or f"scans AS ({scans}), " + differences(order, repeats, extra)
    bucket = "CASE " + " ".join(f"WHEN ch.op = '{a['op']}' THEN {a['bucket']}" for a in alerts) + " END"
    parts = []
    for a in alerts:
        pieces = []
        for name, cap, line, heading, sep in a["sections"]:
            limit = f" AND rn <= {cap}" if cap else ""
            agg = f"string_agg({line}, {lit(sep)} ORDER BY rn) FILTER (WHERE bucket = '{name}'{limit})"
            pieces.append(f"{lit(heading)} || {agg}")
        text = f"concat_ws({lit(a.get('joiner', chr(10)))}, {', '.join(pieces)})"
        first = f", first({a['first_url']} ORDER BY rn) FILTER (WHERE bucket IS NOT NULL) AS first_url" if "first_url" in a else ""
        shown = "concat('```diff' || chr(10), text, chr(10) || '```')" if a.get("fence") else "text"
        logged = "type" in a
        parts.append(
            f"SELECT r.target_id, r.scan_id, {lit(a['type']) if logged else 'NULL::VARCHAR'} AS detection_type, "
            f"{a.get('log_target', 'r.target_id')} AS log_target, "
            f"{a['log_title'] if logged else 'NULL::VARCHAR'} AS log_title, "
            f"{'text' if logged else 'NULL::VARCHAR'} AS details, {a['title']} AS alert_title, "
            f"concat({a['head']}, chr(10) || chr(10), {shown}) AS description, {a['color']}::INTEGER AS color, "
            f"{'first_url' if first else a['url']} AS url, {a.get('fields', lit(''))} AS fields "
            f"FROM (SELECT target_id, scan_id, count(*) FILTER (WHERE bucket IS NOT NULL) AS n, {text} AS text{first} "
            f"FROM ranked WHERE op = '{a['op']}' GROUP BY ALL HAVING count(*) FILTER (WHERE bucket IS NOT NULL) > 0) r "
            f"JOIN totals t ON t.target_id = r.target_id AND t.scan_id = r.scan_id "
            f"JOIN targets g ON g.target_id = r.target_id "
        )
    return (
        f"WITH {ctes}, {body}, "
        f"marked AS (SELECT ch.*, {bucket} AS bucket FROM ch JOIN targets g ON g.target_id = ch.target_id), "
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY target_id, scan_id, op, bucket ORDER BY {order}) AS rn FROM marked), "
        "totals AS (SELECT target_id, scan_id, count(*) FILTER (WHERE op = 'added') AS n_added, "
        "count(*) FILTER (WHERE op = 'removed') AS n_removed FROM marked GROUP BY ALL) "
        + " UNION ALL ".join(parts)
    )
