"""Phrases whose parts occur together more often than apart, counted as stripes.

A stripe belongs to a prefix of words and maps each word that follows it to a
count. Tasks fill stripes and send them packed; rows of one prefix are merged
elementwise. Phrases of ``k`` words are counted after those of ``k - 1``: a
window of words counts only if its first and its last ``k - 1`` words may be
frequent, which a filter of fixed size says, so that few stripes are sent. It
may say so of others too; they are counted and fall out afterwards. The stripe
of no prefix holds the words themselves. Merged stripes give the extensions of a
phrase, its total, and the most frequent phrase it is part of.

A word is its 64-bit hash, checked by a second one wherever words meet; a phrase
is the row of its words' hashes. Long stripes are split into shares by next word:
the stripe of no prefix, and those of prefixes that occur more than ``SHARE``
times and more than once in ``HEAVY`` words, in shares of that size. There are at
most ``HEAVY`` such prefixes in a language, whatever the input. Stripes travel in
buckets of prefixes, of which there is one for each ``BUCKET_WORDS`` words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapdrift.llm.common import small_batches, staged
from snapdrift.llm.words import LOWER, mix, powers, window_hashes

U = np.uint64
SLICE = 1 << 20
BUFFER = 1 << 21
FILTER_BITS = 27  # 16 MB, sent to every task
HEAVY = 1 << 16
SHARE = 1 << 22
WORD_SHARES = 2048
BUCKETS = 256
BUCKET_WORDS = 1 << 22
BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 2
STRIPES = "lang string, bucket int, prefixes binary, sizes binary, nexts binary, counts binary"
WORDS = "lang string, prefix binary, share int, nexts binary, counts binary, checks binary, words array<string>"
GRAMS = "lang string, gram binary, f long, word string"


def tables(seed: int) -> np.ndarray:
    """Two rows of odd values of bytes, for the hash of a word and its check."""
    return np.random.default_rng(seed).integers(1, 1 << 63, (2, 256), dtype=U) * U(2) + U(1)


def slices(data: bytes) -> Iterator[bytes]:
    """``data`` cut at breaks, about ``SLICE`` bytes each; a piece is never cut."""
    at = 0
    while at < len(data):
        found = BREAK.search(data, at + SLICE)
        end = found.end() if found else len(data)
        yield data[at:end]
        at = end


def words_of(data: bytes, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets ``(start, end)`` of words, the number of the piece of each, and their hashes by each row of ``byte``."""
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    apart = np.ones(len(data) + 2, bool)
    apart[1:-1] = kind > 0
    edge = np.flatnonzero(apart[1:] != apart[:-1])
    starts, ends = edge[0::2], edge[1::2]
    pieces = np.cumsum(kind == 2, dtype=np.int64)[starts] if len(starts) else starts
    if not len(starts):
        return np.stack((starts, ends)), pieces, np.empty((len(byte), 0), U)
    up, down = powers(len(data) + 1)
    hashes = np.empty((len(byte), len(starts)), U)
    total = np.zeros(len(data) + 1, U)
    for i, values in enumerate(byte):
        np.cumsum(values[raw] * up[: len(data)], out=total[1:])
        hashes[i] = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))
    return np.stack((starts, ends)), pieces, hashes


def _salt(lang: str) -> np.uint64:
    return mix(np.array([int.from_bytes(lang.encode()[:8].ljust(8, b"\0"), "little")], U) + U(len(lang.encode())))[0]


def _places(grams: np.ndarray, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each hash of a phrase."""
    x = mix(grams ^ salt)
    return x >> U(64 - FILTER_BITS), (x & U((1 << FILTER_BITS) - 1))


def _in_filter(bits: np.ndarray, grams: np.ndarray, salt: np.uint64) -> np.ndarray:
    a, b = _places(grams, salt)
    hit = lambda p: (bits[(p >> U(6)).astype(np.int64)] >> (p & U(63))) & U(1)
    return (hit(a) & hit(b)).astype(bool)


def gram_filter(grams: DataFrame, k: int) -> np.ndarray:
    """A bit set of ``FILTER_BITS``: on at two places of each of ``grams (lang, gram)`` of ``k`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for lang, rows in _by_lang(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = np.frombuffer(b"".join(rows), U).reshape(-1, k)
                # a window hash of one phrase alone needs the words side by side
                joined = window_hashes(keys.ravel(), k)[::k]
                places += _places(joined, _salt(lang))
            places = np.concatenate(places) if places else np.empty(0, U)
            at, bit = (places >> U(6)).astype(np.int64), U(1) << (places & U(63))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bit.view(np.int64))], ["at", "bits"])

    set_bits = grams.select("lang", "gram").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    found = set_bits.toPandas()  # at most 2^21 rows
    out = np.zeros(1 << (FILTER_BITS - 6), U)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(U)
    return out


def _by_lang(langs: list[str], values: list) -> Iterator[tuple[str, list]]:
    found: dict[str, list] = {}
    for lang, value in zip(langs, values):
        found.setdefault(lang, []).append(value)
    return iter(found.items())


def _folded(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``rows`` in the order of their columns, counts added up."""
    if not len(rows):
        return rows, counts
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    first = np.concatenate(([True], (rows[1:] != rows[:-1]).any(1)))
    return rows[first], np.add.reduceat(counts, np.flatnonzero(first))


def _binary(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Rows of ``data`` from cut to cut as one binary value each."""
    width = data.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    offsets = (np.append(cuts, len(data)) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


class _Stripes:
    """Counts of windows of one language, until they are sent."""

    def __init__(self, lang: str, k: int) -> None:
        self.lang, self.k, self.rows, self.counts, self.size = lang, k, [], [], 0

    def add(self, rows: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.rows.append(rows)
        self.counts.append(np.ones(len(rows), np.int64) if counts is None else counts)
        self.size += len(rows)

    def fold(self) -> None:
        if not self.size:
            return
        rows, counts = _folded(np.concatenate(self.rows), np.concatenate(self.counts))
        self.rows, self.counts, self.size = [rows], [counts], len(rows)

    def packed(self, heavy: dict[bytes, int], buckets: int) -> pa.RecordBatch:
        """Stripes in one row a bucket of prefixes; ``heavy`` says over how many shares a prefix is spread."""
        self.fold()
        rows, counts, k = self.rows[0], self.counts[0], self.k
        prefix = window_hashes(np.ascontiguousarray(rows[:, : k - 1]).ravel(), k - 1)[:: k - 1]
        new = np.concatenate(([True], (rows[1:, : k - 1] != rows[:-1, : k - 1]).any(1)))
        if heavy:
            first = np.flatnonzero(new)
            shares = np.array([heavy.get(p.tobytes(), 1) for p in np.ascontiguousarray(rows[first, : k - 1])], U)
            prefix = mix(prefix + rows[:, k - 1] % np.repeat(shares, np.diff(np.append(first, len(rows)))))
        bucket = (prefix % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows, counts, bucket = rows[order], counts[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        new = np.concatenate(([True], (rows[1:, : k - 1] != rows[:-1, : k - 1]).any(1)))
        new[cuts] = True
        stripes = np.flatnonzero(new)
        own = np.searchsorted(stripes, cuts)
        sizes = np.diff(np.append(stripes, len(rows)))
        columns = [
            pa.array([self.lang] * len(cuts)), pa.array(bucket[cuts], pa.int32()), _binary(np.ascontiguousarray(rows[stripes, : k - 1]), own),
            _binary(sizes, own), _binary(rows[:, k - 1], cuts), _binary(counts, cuts),
        ]
        return pa.RecordBatch.from_arrays(columns, _STRIPE_NAMES)


_STRIPE_NAMES = [c.split()[0] for c in STRIPES.split(", ")]
_NAMES = [c.split()[0] for c in WORDS.split(", ")]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def _word_stripes(docs: DataFrame, seed: int) -> DataFrame:
    """The stripe of no prefix, in shares by word."""
    byte = tables(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, dict[int, list]] = {}

        def packed() -> Iterator[pa.RecordBatch]:
            for lang, words in found.items():
                if not words:
                    continue
                shares: dict[int, list] = {}
                for h, entry in words.items():
                    shares.setdefault(h % WORD_SHARES, []).append((h, *entry))
                rows = []
                for share, entries in shares.items():
                    nexts, counts, checks, texts = zip(*entries)
                    packs = [np.array(v, d).tobytes() for v, d in ((nexts, U), (counts, np.int64), (checks, U))]
                    rows.append((lang, b"", share, *packs, [t.decode() for t in texts]))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.int32(), *[pa.binary()] * 3, pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays(columns, _NAMES)

        for batch in batches:
            for lang, texts in _by_lang(*(c.to_pylist() for c in batch.columns)):
                known = found.setdefault(lang, {})
                for data in slices(b"\n".join(t.encode().translate(LOWER) for t in texts)):
                    place, _, (hashes, checks) = words_of(data, byte)
                    uniq, first, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                    if (checks != checks[first][inverse]).any():
                        raise RuntimeError("two words share a hash: choose another seed")
                    for h, c, check, s, e in zip(*(x.tolist() for x in (uniq, counts, checks[first], *place[:, first]))):
                        entry = known.get(h)
                        if entry is None:
                            known[h] = [c, check, data[s:e]]
                        elif entry[1] != check:
                            raise RuntimeError("two words share a hash: choose another seed")
                        else:
                            entry[0] += c
            if sum(map(len, found.values())) > BUFFER // 4:
                yield from packed()
                found.clear()
        yield from packed()

    return _texts(docs).mapInArrow(run, WORDS)


def _stripes(docs: DataFrame, k: int, bits, heavy, buckets: int, seed: int) -> DataFrame:
    """Stripes of prefixes of ``k - 1`` words, of windows whose shorter phrases pass the filter."""
    byte = tables(seed)[:1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Stripes] = {}
        for batch in batches:
            for lang, texts in _by_lang(*(c.to_pylist() for c in batch.columns)):
                own, salt = held.setdefault(lang, _Stripes(lang, k)), _salt(lang)
                for data in slices(b"\n".join(t.encode().translate(LOWER) for t in texts)):
                    _, pieces, (hashes,) = words_of(data, byte)
                    if len(hashes) < k:
                        continue
                    passed = _in_filter(bits.value, window_hashes(hashes, k - 1), salt)
                    at = np.flatnonzero(passed[:-1] & passed[1:] & (pieces[: len(pieces) - k + 1] == pieces[k - 1 :]))
                    own.add(hashes[at[:, None] + np.arange(k)])
            if sum(s.size for s in held.values()) > BUFFER:
                for s in held.values():
                    s.fold()
                if sum(s.size for s in held.values()) > BUFFER // 2:
                    yield from (s.packed(heavy.value.get(s.lang, {}), buckets) for s in held.values() if s.size)
                    held.clear()
        yield from (s.packed(heavy.value.get(s.lang, {}), buckets) for s in held.values() if s.size)

    return _texts(docs).mapInArrow(run, STRIPES)


class _Merger:
    """Rows of the stripe of no prefix, added up elementwise; the last share stays open for the next rows."""

    def __init__(self, least: int) -> None:
        self.least, self.open = least, None

    def add(self, keys: list[tuple], nexts: list[bytes], counts: list[bytes], checks: list[bytes | None], words: list[list | None], last: bool) -> list[tuple]:
        """``lang, gram, f, word`` of the prefixes that are complete now, all of them if these rows are the ``last``."""
        if self.open is not None:
            keys, nexts, counts, checks, words = ([o, *c] for o, c in zip(self.open, (keys, nexts, counts, checks, words)))
        self.open = None
        if not keys:
            return []
        group = np.cumsum([0, *(a != b for a, b in zip(keys, keys[1:]))])
        kept = [keys[i] for i in np.flatnonzero(np.diff(group, prepend=-1)).tolist()]
        group = np.repeat(group, [len(n) // 8 for n in nexts])
        nexts, counts = np.frombuffer(b"".join(nexts), U), np.frombuffer(b"".join(counts), np.int64)
        order = np.lexsort((nexts, group))
        group, nexts = group[order], nexts[order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (nexts[1:] != nexts[:-1])))
        at = np.flatnonzero(new)
        total, group, nexts = np.add.reduceat(counts[order], at), group[at], nexts[at]
        place, first = [], None
        if any(checks):
            check = np.frombuffer(b"".join(checks), U)[order]
            first = check[at]
            if (check != np.repeat(first, np.diff(np.append(at, len(check))))).any():
                raise RuntimeError("two words share a hash: choose another seed")
            texts = [t for w in words for t in w]
            place = order[at]
        out, until = [], len(kept) if last else len(kept) - 1
        if not last:
            mine = group == until
            own = [texts[i] for i in place[mine].tolist()] if first is not None else None
            self.open = kept[-1], nexts[mine].tobytes(), total[mine].tobytes(), first[mine].tobytes() if first is not None else None, own
        for i in np.flatnonzero((total >= self.least) & (group < until)).tolist():
            lang, prefix, _ = kept[group[i]]
            out.append((lang, prefix + nexts[i].tobytes(), int(total[i]), texts[place[i]] if first is not None else None))
        if first is not None:  # the words: how many there are in all
            sums = np.bincount(group, total.astype(np.float64), len(kept)) if total.sum() < 1 << 53 else [int(total[group == g].sum()) for g in range(len(kept))]
            out += [(key[0], None, int(n), None) for key, n in zip(kept[:until], sums)]
        return out


def _merged_words(stripes: DataFrame, least: int) -> DataFrame:
    """``lang, gram, f, word`` of words of ``least`` and more, and numbers of all words without a gram."""
    keys = ["lang", "prefix", "share"]
    dealt = stripes.repartition(*keys).sortWithinPartitions(*keys)
    kinds = pa.string(), pa.binary(), pa.int64(), pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _Merger(least)
        for batch in chain(batches, [None]):
            columns = [c.to_pylist() for c in batch.columns] if batch is not None else [[]] * len(_NAMES)
            rows = merger.add(list(zip(*columns[:3])), *columns[3:], last=batch is None)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["lang", "gram", "f", "word"])

    return dealt.mapInArrow(run, GRAMS)


def _merged(stripes: DataFrame, k: int, least: int) -> DataFrame:
    """Stripes of ``k - 1`` words merged: ``lang, gram, f, word`` of entries of ``least`` and more."""
    keys = ["lang", "bucket"]
    dealt = stripes.repartition(*keys).sortWithinPartitions(*keys)
    kinds = pa.string(), pa.binary(), pa.int64(), pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def often() -> pa.RecordBatch:
            held.fold()
            at = np.flatnonzero(held.counts[0] >= least)
            grams = [g.tobytes() for g in np.ascontiguousarray(held.rows[0][at])]
            rows = [[held.lang] * len(at), grams, held.counts[0][at], [None] * len(at)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], ["lang", "gram", "f", "word"])

        for batch in batches:
            for lang, bucket, prefixes, sizes, nexts, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, bucket) != key:
                    if held is not None:
                        yield often()
                    key, held = (lang, bucket), _Stripes(lang, k)
                prefix = np.repeat(np.frombuffer(prefixes, U).reshape(-1, k - 1), np.frombuffer(sizes, np.int64), axis=0)
                held.add(np.column_stack((prefix, np.frombuffer(nexts, U))), np.frombuffer(counts, np.int64))
                if held.size > BUFFER and len(held.rows) > 1 and held.size > 2 * len(held.rows[0]):
                    held.fold()
        if held is not None:
            yield often()

    return dealt.mapInArrow(run, GRAMS)


def counted(docs: DataFrame, least: int, longest: int, seed: int) -> list[DataFrame]:
    """Merged stripes of no word, one word, ... , ``longest - 1`` words, as :func:`_merged` has them."""
    spark = docs.sparkSession
    small_batches(spark)
    levels = [staged(_merged_words(_word_stripes(docs, seed), least), "stripes-0")]
    sums = levels[0].where("gram IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    buckets = max(BUCKETS, 1 << (total // BUCKET_WORDS).bit_length())
    for k in range(2, longest + 1):
        before = levels[-1].where("gram IS NOT NULL")
        if before.isEmpty():
            break
        heavy: dict[str, dict[bytes, int]] = {}
        size = F.greatest(F.lit(SHARE), F.ceil(F.col("n") / HEAVY))
        often = before.join(sums, "lang").withColumn("shares", F.ceil(F.col("f") / size)).where("shares > 1")
        for r in often.select("lang", "gram", "shares").collect():  # HEAVY a language at most: their counts add up to n
            heavy.setdefault(r["lang"], {})[bytes(r["gram"])] = r["shares"]
        shared = spark.sparkContext.broadcast(gram_filter(before, k - 1)), spark.sparkContext.broadcast(heavy)
        levels.append(staged(_merged(_stripes(docs, k, *shared, buckets, seed), k, least), f"stripes-{k - 1}"))
    return levels


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, seed: int = 13) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language of ``docs (text, lang)``.

    Phrases of two to ``longest`` words that occur ``least`` times and more
    within pieces of text are scored by the cut that explains them best:
    ``floor(1000 * a * n / (l * r))`` of their count, that of all words, and
    those of the two parts. A phrase that is part of a longer one as frequent is
    left out. A null text is empty, a null language is ``und``; repeated rows
    count each time, no words give no rows. Ties of score and count are in the
    byte order of phrases.
    """
    levels = counted(docs, least, longest, seed)
    totals = levels[0].where("gram IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    words = levels[0].where("gram IS NOT NULL").select("lang", F.col("gram").alias("h"), "word")
    grams = reduce(DataFrame.unionByName, [x.where("gram IS NOT NULL").select("lang", "gram", "f") for x in levels])
    size = (F.octet_length("gram") / 8).cast("int")
    phrases = grams.where(size > 1)
    # one word more on either side is enough: a longer phrase as frequent has one between that is, too
    longer = phrases.where(size > 2).select(
        "lang", "f", F.explode(F.array(F.expr("substring(gram, 1, octet_length(gram) - 8)"), F.expr("substring(gram, 9)"))).alias("gram")
    )
    most = longer.groupBy("lang", "gram").agg(F.max("f").alias("most"))
    whole = phrases.join(most, ["lang", "gram"], "left").where("most IS NULL OR most < f").select("lang", "gram", F.col("f").alias("a"))
    cuts = whole.withColumn("cut", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"left": F.expr("substring(gram, 1, cut * 8)"), "right": F.expr("substring(gram, cut * 8 + 1)")})
    part = lambda name, f: grams.select("lang", F.col("gram").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    # 37 digits hold 1000 * a * n up to counts of 10^17; div keeps decimals whole
    cuts = cuts.withColumns({"up": F.lit(1000).cast("decimal(4,0)") * (exact("a") * exact("n")).cast("decimal(34,0)"), "down": exact("l") * exact("r")})
    cuts = cuts.withColumn("score", F.expr("up div down"))
    worst = cuts.groupBy("lang", "gram", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    scored = worst.select("lang", "gram", "a", "n", "m.l", "m.r", "m.score")
    order = [F.col("score").desc(), F.col("a").desc()]
    first = scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top)
    first = staged(first.drop("place"), "collocations")
    split = first.select("lang", "gram", F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.expr("gram").substr(i * 8 + 1, F.lit(8)))).alias("i", "h"))
    texts = split.join(words, ["lang", "h"]).groupBy("lang", "gram").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
    named = first.join(texts.select("lang", "gram", F.array_join("w.word", " ").alias("phrase")), ["lang", "gram"])
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
