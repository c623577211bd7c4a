"""The operators as queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdrift.llm import (
    caps,
    collocations,
    conversations,
    credentials,
    decontaminate,
    licences,
    minhash,
    substrings,
    token_edits,
    token_files,
    toxicity,
    unigram,
    warczip,
)
from snapdrift.llm.registry import ORACLE, QUERIES, query, table

__all__ = ["ORACLE", "QUERIES"]


OP1 = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) END) AS g
  FROM texts WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT s.a, s.b FROM shared s JOIN sizes p ON p.doc_id = s.a JOIN sizes q ON q.doc_id = s.b WHERE 100 * s.both >= 80 * (p.n + q.n - s.both)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), smallest AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, s.component_id, s.doc_id = s.component_id AS kept
FROM smallest s LEFT JOIN sizes z ON z.doc_id = s.doc_id
"""


@query("op1_minhash_near_dedup", OP1)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


OP7 = r"""
WITH texts AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), words AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts
), starts AS (
  SELECT doc_id, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN md5(array_to_string(list_slice(w, i, i + 34), ' ')) END AS h
  FROM words
), repeats AS (
  SELECT h FROM starts WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1
), covered AS (
  SELECT s.doc_id, s.i, s.word, max(CASE WHEN r.h IS NULL THEN 0 ELSE 1 END)
    OVER (PARTITION BY s.doc_id ORDER BY s.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM starts s LEFT JOIN repeats r ON s.h = r.h
), kept AS (
  SELECT doc_id, sum(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept_text
  FROM covered GROUP BY doc_id
)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(k.kept_text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""


@query("op7_substring_dedup", OP7)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.repeated_passages(table(spark, folder, "documents"), window=35)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


OP3 = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), smallest AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT s.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, s.component_id, s.vec_id = s.component_id AS kept
FROM smallest s LEFT JOIN counts c ON s.vec_id = c.vec_id
"""


@query("op3_embedding_near_dedup", OP3)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return caps.near_duplicate_vectors(table(spark, folder, "embeddings"))


def _op2_sql() -> str:
    """Spans as in the operator: gaps and matches of each pattern as running sums, then interval conditions."""
    parts = []
    for kind, (pattern, group, least) in credentials.KINDS.items():
        p = pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {credentials.RANK[kind]} AS kind, "
            f"list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS gaps, "
            f"list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x)) AS lens, "
            f"list_transform(regexp_extract_all(t, '{p}', {group}), lambda x: length(x)) AS sizes, {least} AS least "
            f"FROM texts WHERE regexp_matches(t, '{p}')"
        )
    near = lambda left, right, gap: (  # noqa: E731
        f"{left}.doc_id = {right}.doc_id AND {left}.scope = {right}.scope AND "
        f"greatest({left}.start, {right}.start) - least({left}.stop, {right}.stop) {gap}"
    )
    beside = lambda left, kinds: (  # noqa: E731
        f"EXISTS (SELECT 1 FROM strong r WHERE {near(left, 'r', f'<= {credentials.WITHIN}')} AND r.kind IN ({kinds}))"
    )
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for k, i in credentials.RANK.items()) + " END"
    item = f"concat({name}, ':', start, ':', stop)"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(parts)}),
each AS (
  SELECT doc_id, kind, least, gaps[i] AS gap, lens[i] AS len, sizes[i] AS size, i
  FROM (SELECT *, unnest(range(1, len(lens) + 1)) AS i FROM found)
), spans AS (
  SELECT doc_id, kind, stop - len AS start, stop FROM (
    SELECT *, sum(gap + len) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM each
  ) WHERE size >= least
), parts AS (
  SELECT *, count(*) FILTER (kind = {credentials.RANK['break']}) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS scope
  FROM spans
), strong AS (
  SELECT * FROM parts p WHERE kind IN (0, 1, 2, 3, 5) OR kind = 4 AND NOT EXISTS (
    SELECT 1 FROM parts r WHERE {near('p', 'r', '< 0')} AND r.kind < 3)
), kept AS (
  SELECT * FROM strong s WHERE kind < 3 OR kind = 3 AND {beside('s', '0, 2, 4')} OR kind = 4 AND {beside('s', '1, 3')}
    OR kind = 5 AND {beside('s', '0, 2, 4')} AND {beside('s', '1, 3')}
), listed AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg({item}, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg({item}, ',' ORDER BY start, kind) AS spans
  FROM kept GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id
"""


@query("op2_secret_scan", _op2_sql())
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.digest(credentials.find_secrets(table(spark, folder, "documents")))


OP4 = """
WITH rows AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h,
    min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS first
  FROM pages
)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((concat('0x', substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM rows
"""


@query("op4_warc_zip", OP4)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    read = warczip.round_trip(table(spark, folder, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = toxicity.held_out(F.col("doc_id"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels.where(~held_out)))
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


@query("op6_benchmark_decontamination")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    ids = F.transform("items", lambda x: x["item_id"])
    return found.select("doc_id", "n_candidates", ids.alias("item_ids"), (F.size("items") > 0).alias("contaminated"))


@query("op8_sentencepiece")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    both = unigram.round_trip(table(spark, folder, "documents"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "exact")


@query("op9_token_edits")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Each text with three edits made of itself: its source inserted, some words deleted, some replaced by its start."""
    n = F.char_length("text").cast("long")
    edit = lambda start, stop, text: F.struct(start.alias("start"), stop.alias("stop"), text.alias("text"))  # noqa: E731
    quarter = F.floor(n / 4)
    edits = F.array(
        edit(quarter, quarter, F.concat(F.lit(" "), "source")),
        edit(quarter * 2, quarter * 2 + 12, F.lit("")),
        edit(quarter * 3, quarter * 3 + 5, F.substring("text", 1, 24)),
    )
    found = token_edits.count_edited(table(spark, folder, "documents").select("doc_id", "text", edits.alias("edits")))
    return found.select("doc_id", "n_pretokens", "n_tokens", "n_tokens_edited", "n_reencoded")


def _op10_sql() -> str:
    grams = [
        f"('{name}', ['{chr(39).join(licences.template_bigrams(text)).replace(chr(39), chr(39) + ', ' + chr(39))}'])"
        for name, text in sorted(licences.TEMPLATES.items())
    ]
    return rf"""
WITH templates(licence, grams) AS (VALUES {', '.join(grams)}),
texts AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\pL\pN\n]+', ' ', 'g') AS t FROM documents),
units AS (
  SELECT doc_id, i, 0 AS kind, u FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS u, unnest(range(len(string_split(t, chr(10))))) AS i FROM texts)
  UNION ALL
  SELECT doc_id, i, 1, u FROM (
    SELECT doc_id, unnest(string_split_regex(t, '\n *\n')) AS u, unnest(range(len(string_split_regex(t, '\n *\n')))) AS i FROM texts)
  WHERE contains(trim(u, concat(' ', chr(10))), chr(10))
), words AS (
  SELECT doc_id, i, kind, list_filter(string_split_regex(u, '[ \n]'), lambda x: x <> '') AS w FROM units
), grams AS (
  SELECT doc_id, i, kind, list_distinct(list_transform(range(1, len(w)), lambda k: concat(w[k], ' ', w[k + 1]))) AS g FROM words WHERE len(w) > 1
), scored AS (
  SELECT g.doc_id, g.i, g.kind, t.licence, 2.0 * len(list_intersect(g.g, t.grams)) / (len(g.g) + len(t.grams)) AS dice
  FROM grams g JOIN templates t ON 2 * least(len(g.g), len(t.grams)) >= {licences.LEAST} * (len(g.g) + len(t.grams))
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, i, kind ORDER BY dice DESC, licence) AS n FROM scored WHERE dice >= {licences.LEAST}
), listed AS (
  SELECT doc_id, count(*) AS n_notices, max(dice) AS best_dice, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences
  FROM best WHERE n = 1 GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_notices, 0)::BIGINT AS n_notices, coalesce(licences, '') AS licences, best_dice::DOUBLE AS best_dice
FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id
"""


@query("op10_licence_scan", _op10_sql())
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.licence_notices(table(spark, folder, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["licence"])))
    best = F.array_max(F.transform("notices", lambda x: x["dice"]))
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), F.array_join(names, ",").alias("licences"), best.alias("best_dice"))


@query("op12_token_files")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _op11_sql() -> str:
    """A fold over the rows of a conversation: per state the cost in twelve digits and then the audit, so that the least is the one sought."""
    add = lambda v, cost, edit: f"concat(lpad((substr({v}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0'), substr({v}, 13), '{edit}')"  # noqa: E731
    offers = lambda i, more: f"list_min([{', '.join([add(f'v[{i}]', 2, 'D'), *more])}])"  # noqa: E731
    pen = "(CASE WHEN c = upper(c) THEN 5 ELSE 0 END)"
    keep = lambda j, kind: f"CASE WHEN lower(c) = '{kind}' THEN {add(f'v[{j}]', pen, 'K')} END"  # noqa: E731
    role = lambda j: f"CASE WHEN c <> 'x' THEN {add(f'v[{j}]', f'{pen} + 1', 'R')} END"  # noqa: E731
    to_user = [f(j) for j in (1, 2, 4) for f in (lambda j: keep(j, "u"), role)]
    rows = f"[{add('v[1]', 2, 'D')}, {offers(2, [keep(1, 's')])}, {offers(3, to_user)}, {offers(4, [keep(3, 'a'), role(3)])}]"
    user = "list_min([n[3], " + ", ".join(add(f"n[{j}]", 5, "I") for j in (1, 2, 4)) + "])"
    closed = f"list_transform([{rows}], lambda n: [n[1], n[2], {user}, n[4]])"
    step = f"list_transform({closed}, lambda n: [n[1], n[2], n[3], least(n[4], {add('n[3]', 5, 'I')})])[1]"
    begin = "['000000000000', '900000000000', '000000000005I', '000000000010II']"
    return rf"""
WITH marked AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS k FROM conversations
), kinds AS (
  SELECT *, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i::INT, 1))::BIGINT),
    lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM marked
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0
), ordered AS (
  SELECT *, row_number() OVER here AS i, lag(substr(role, 1, 1)) OVER here AS before
  FROM damaged WINDOW here AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), faults AS (
  SELECT *,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 't' ELSE '' END AS fault,
    CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'o' END AS initial
  FROM ordered
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (i > 1 AND concat(before, substr(role, 1, 1)) NOT IN ('su', 'ua', 'au')) AS illegal,
    list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts, list(initial ORDER BY i) AS initials,
    list(CASE WHEN fault IN ('b', 'd') THEN 'x' WHEN fault = 't' THEN upper(initial) ELSE initial END ORDER BY i) AS symbols
  FROM faults GROUP BY conv_id
), folded AS (
  SELECT *, list_reduce(symbols, lambda v, c: {step}, {begin}) AS v FROM counted
), chosen AS (
  SELECT *, substr(least(v[1], v[4]), 1, 12)::BIGINT AS cost, substr(least(v[1], v[4]), 13) AS audit FROM folded
), edits AS (
  SELECT conv_id, roles, texts, initials, unnest(string_split(audit, '')) AS e, unnest(range(1, length(audit) + 1)) AS i FROM chosen WHERE audit <> ''
), placed AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER here AS row, count(*) FILTER (e <> 'D') OVER here AS n FROM edits
  WINDOW here AS (PARTITION BY conv_id ORDER BY i)
), made AS (
  SELECT *, max(CASE WHEN n = 1 AND e = 'K' AND initials[row] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM placed WHERE e <> 'D'
), lines AS (
  SELECT conv_id, string_agg(concat(CASE WHEN e = 'K' THEN roles[row] WHEN (n - system) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':',
    CASE WHEN e <> 'I' THEN texts[row] END), chr(10) ORDER BY i) AS t FROM made GROUP BY conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM ids d LEFT JOIN chosen c ON d.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN lines l ON d.conv_id IS NOT DISTINCT FROM l.conv_id
"""


@query("op11_conversation_repair", _op11_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.audit_damaged(table(spark, folder, "conversations"))


OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?
-]')) AS p FROM documents
), split AS (
  SELECT lang, list_filter(string_split_regex(p, '[ 	]+'), lambda x: x <> '') AS w FROM pieces
), sizes AS (
  SELECT lang, unnest([1, 2, 3, 4, 5]) AS k, w FROM split
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))) AS g FROM sizes WHERE len(w) >= k
), counts AS (
  SELECT lang, k, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang
), longer AS (
  SELECT lang, g, max(f) AS f FROM (
    SELECT lang, f, unnest([list_slice(g, 1, k - 1), list_slice(g, 2, k)]) AS g FROM counts WHERE k > 2) GROUP BY ALL
), kept AS (
  SELECT c.* FROM counts c LEFT JOIN longer x ON c.lang = x.lang AND c.g = x.g WHERE c.k > 1 AND (x.f IS NULL OR 100 * x.f < 100 * c.f)
), cuts AS (
  SELECT lang, k, g, f AS a, unnest(range(1, k)) AS cut FROM kept
), scored AS (
  SELECT c.lang, c.g, c.a, c.cut, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.a * n // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, c.cut) JOIN counts y ON y.lang = c.lang AND y.g = list_slice(c.g, c.cut + 1, c.k)
    JOIN totals t ON t.lang = c.lang
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
), ranked AS (
  SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM worst
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


@query("op13_phrase_collocations", OP13)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))
