"""Secrets in texts, with credential parts that are linked where they stand together.

Only DataFrame functions: the gaps that a pattern splits a text into and the
lengths of its matches give code-point offsets as running sums, so spans are
found without leaving the JVM and the text is read once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapdrift.llm.common import staged, texts_of

NAMES = "password|passwd|secret|token|api_?key"
IDENTIFIERS = "client_?id|key_?id|user_?name|account_?id"


def either_case(words: str) -> str:
    """A pattern for ASCII words in either case, read alike by every regex engine."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_SET = r"""["']?\x20*[:=]\x20*["']?"""
#: kind: (pattern, group whose length counts, least length); base kinds first, in the order of their listing
BASE = {
    "assign": (f"({either_case(NAMES)}){_SET}([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]{24,}", 0, 24),
}
#: parts that are no secret alone
WEAK = {
    "weak_id": (f"({either_case(IDENTIFIERS)}){_SET}([A-Za-z0-9_.@-]+)", 2, 4),
    "weak_secret": ("[A-Za-z0-9+/_]{32,}={0,2}", 0, 32),
    "endpoint": (r"""[a-z]+://[A-Za-z0-9.-]+[A-Za-z0-9:/_.?&=%-]*""", 0, 8),
}
BREAK = (r"\n[\x20\t\r]*\n", 0, 1)  # scopes are paragraphs
KINDS = {**BASE, **WEAK, "break": BREAK}
RANK = {kind: i for i, kind in enumerate(KINDS)}
WITHIN = 200  # code points between parts of one credential
ID = ("access", "weak_id")
SECRET = ("assign", "hex", "weak_secret")
KEY = ["doc_id", "h"]


def _found(kind: str) -> Column:
    """Gaps and matches of one kind as arrays of lengths; null where there is none."""
    pattern, group, _ = KINDS[kind]
    lengths = lambda column: F.transform(column, F.char_length)
    zipped = F.arrays_zip(
        lengths(F.split("text", pattern, -1)).alias("gap"),
        lengths(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("len"),
        lengths(F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).alias("size"),
    )
    return F.when(F.col("text").rlike(pattern), zipped)


def _spans(rows: DataFrame) -> DataFrame:
    """``doc_id, h, kind, start, stop`` of all parts of rows with arrays by kind."""
    kinds = [F.struct(F.lit(RANK[k]).alias("kind"), F.lit(KINDS[k][2]).alias("least"), F.col(k).alias("found")) for k in KINDS]
    each = rows.select(*KEY, F.explode(F.array(*kinds)).alias("p")).where("p.found is not null")
    each = each.select(*KEY, "p.kind", "p.least", F.posexplode("p.found").alias("pos", "m"))
    upto = W.partitionBy(*KEY, "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    stop = F.sum(F.col("m.gap").cast("long") + F.coalesce("m.len", F.lit(0))).over(upto)
    each = each.select(*KEY, "kind", "least", "m", stop.alias("stop")).where("m.len is not null and m.size >= least")
    return each.select(*KEY, "kind", (F.col("stop") - F.col("m.len")).alias("start"), "stop")


def _beside(left: DataFrame, right: DataFrame, within: int, how: str) -> DataFrame:
    """Rows of ``left`` with (or, ``left_anti``, without) one of ``right`` at most ``within`` apart in the same scope.

    An interval join: the right side is dealt to every cell it can reach and
    the left side to every cell it touches, its end included (a gap of exactly
    ``within`` counts), so that near parts of any length meet.
    """
    width = max(within, 64)
    cells = right.select(
        *KEY, "scope", F.col("start").alias("r_start"), F.col("stop").alias("r_stop"),
        F.explode(F.sequence(F.floor((F.col("start") - within) / width), F.floor((F.col("stop") + within) / width))).alias("cell"),
    )
    spot = left.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))
    same = [spot[k].eqNullSafe(cells[k]) for k in (*KEY, "scope", "cell")]
    apart = F.greatest(spot["start"], cells["r_start"]) - F.least(spot["stop"], cells["r_stop"])
    close = reduce(lambda a, b: a & b, same) & ((apart <= within) if within else (apart < 0))
    hit = spot.join(cells, close, "left_semi").select(left.columns).distinct()
    if how == "left_anti":
        return left.join(hit, reduce(lambda a, b: a & b, [left[c].eqNullSafe(hit[c]) for c in left.columns]), "left_anti")
    return hit


def _of(parts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return parts.where(F.col("kind").isin([RANK[k] for k in kinds]))


def _joined(column: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))
    return F.coalesce(F.array_join(F.transform(column, one), ","), F.lit(""))


def _listed(rows: DataFrame, within: int) -> DataFrame:
    """``doc_id, h, spans`` of the texts with spans, once for equal rows."""
    some = reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in (*BASE, *WEAK)])
    every = _spans(rows.where(some).dropDuplicates(KEY))
    order = W.partitionBy(*KEY).orderBy("start", "stop").rowsBetween(W.unboundedPreceding, W.currentRow)
    scope = F.count(F.when(F.col("kind") == RANK["break"], 1)).over(order)
    parts = staged(every.withColumn("scope", scope).where(F.col("kind") != RANK["break"]), "parts")
    base = _of(parts, tuple(BASE))
    lone = _beside(_of(parts, ("weak_secret",)), base, 0, "left_anti")
    secrets = _of(parts, ("assign", "hex")).union(lone)
    ids = _of(parts, ID)
    weak_ids = _beside(_of(parts, ("weak_id",)), secrets, within, "left_semi")
    weak_secrets = _beside(lone, ids, within, "left_semi")
    ends = _beside(_beside(_of(parts, ("endpoint",)), secrets, within, "left_semi"), ids, within, "left_semi")
    kept = reduce(DataFrame.union, [base, weak_ids, weak_secrets, ends])
    return kept.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("spans"))


def _scanned(docs: DataFrame) -> DataFrame:
    rows = texts_of(docs).select("doc_id", "text", F.xxhash64("text").alias("h"))
    return staged(rows.select(*KEY, *[_found(k).alias(k) for k in KINDS]), "secrets")


def redacted(docs: DataFrame, within: int = WITHIN, by: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span of a secret in ``text`` replaced by ``by`` and ``n_chars``, if there, counted anew.

    Spans that overlap are replaced as one; other texts and columns are as they
    were.
    """
    listed = _listed(_scanned(docs), within)
    same = docs["doc_id"].eqNullSafe(listed["doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == listed["h"])
    both = docs.join(listed, same, "left")
    piece = lambda acc, s: F.concat(F.substr(docs["text"], acc["at"] + 1, s["start"] - acc["at"]), F.lit(by))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["stop"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.array_append(acc["out"], piece(acc, s))).otherwise(acc["out"]).alias("out"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(docs["text"], acc["at"] + 1))
    text = F.when(listed["spans"].isNotNull(), F.aggregate(listed["spans"], start, step, rest)).otherwise(docs["text"])
    out = both.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def find_secrets(docs: DataFrame, within: int = WITHIN) -> DataFrame:
    """Spans of secrets in each row of ``docs (doc_id, text)``, null texts being empty.

    Columns: ``doc_id, spans, n_linked``; ``spans`` is an array of ``(start,
    kind, stop)`` by start and then kind, in code points, end exclusive, with
    ``kind`` an index of ``KINDS``. Base kinds (``assign``, ``access``, ``hex``)
    are leftmost non-overlapping matches, those that are too short dropped.
    Weak parts are reported only beside their complements, at most ``within``
    code points apart in one paragraph: a ``weak_id`` beside a secret, a
    ``weak_secret`` that overlaps no base span beside an identifier, an
    ``endpoint`` beside an identifier and beside a secret. ``n_linked`` counts
    reported weak parts. Each row gets its own result, repeated rows and null
    ids included; no rows give no rows.
    """
    rows = _scanned(docs)
    listed = _listed(rows, within)
    own = rows.select(*KEY)
    out = own.join(listed, own["doc_id"].eqNullSafe(listed["doc_id"]) & (own["h"] == listed["h"]), "left")
    weak = F.coalesce(F.size(F.filter("spans", lambda x: x["kind"] >= len(BASE))), F.lit(0))
    return out.select(own["doc_id"], F.coalesce("spans", F.array().cast(listed.schema["spans"].dataType)).alias("spans"), F.greatest(weak, F.lit(0)).alias("n_linked"))


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, a hash of base spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == RANK[kind])).cast("long")
    listed = found.withColumn("base", F.filter("spans", lambda x: x["kind"] < len(BASE)))
    return listed.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans")
    )
