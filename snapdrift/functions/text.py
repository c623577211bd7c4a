"""String columns: trimming, words, HTML entities, clipping, target keys."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdrift.functions import patterns as p


_ENTITIES = json.dumps({name.removesuffix(";"): text for name, text in html5.items()})
#: references that count without a semicolon, as HTML has them
_BARE = tuple(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_WINDOWS = [ord(bytes([c]).decode("cp1252", "ignore") or chr(c)) for c in range(128, 160)]  # what 128 to 159 stand for


def strip(text: Column) -> Column:
    """Trim every Unicode blank, not only spaces."""
    return F.trim(text, F.lit(p.BLANK_CHARS))


def words(text: Column) -> Column:
    """Non-empty runs between blanks."""
    return F.filter(F.split(text, p.BLANKS), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{p.BLANK}]+"))


def has_words(text: Column, n: int) -> Column:
    """Whether there are ``n`` words; a matcher stops at the last of them."""
    word, gap = f"[^{p.BLANK}]", f"[{p.BLANK}]+"
    return text.rlike(word + f"{gap}{word}+" * (n - 2) + (f"{gap}{word}" if n > 1 else ""))


def starts_upper(text: Column) -> Column:
    return text.rlike(p.UPPER_FIRST)


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def clip(text: Column, n: int) -> Column:
    """The first ``n`` code points."""
    return F.substring(text, 1, n)


def target_key(name: Column, url: Column) -> Column:
    """``name:`` and eight hex digits of the url's md5."""
    return F.concat(name, F.lit(":"), F.substring(F.md5(url), 1, 8))


def lines(text: Column) -> Column:
    """Trimmed, non-empty lines in order."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def _code_point(number: Column) -> Column:
    """The character of a reference: U+FFFD for zero, surrogates and what is beyond Unicode."""
    known = F.when(number.between(128, 159), F.element_at(F.array(*[F.lit(w) for w in _WINDOWS]), (number - 127).cast("int")))
    wrong = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    point = F.when(wrong, F.lit(0xFFFD)).otherwise(F.coalesce(known, number))
    utf32 = F.unhex(F.lpad(F.hex(point.cast("bigint")), 8, "0"))
    return F.decode(utf32, "UTF-32")


def decode_entities(text: Column) -> Column:
    """Named and numeric character references, decoded in one pass.

    A numeric reference, and the old names that HTML lets stand so, count
    without a semicolon as well; unknown names stay as they are.
    """
    # one literal, folded to a constant map before execution
    named = F.from_json(F.lit(_ENTITIES), "map<string,string>")

    def number(token: Column, pattern: str, base: int, digits: int) -> Column:
        found = F.ltrim(F.regexp_extract(token, pattern, 1), F.lit("0"))
        wide = F.length(found) > digits  # beyond Unicode however it goes on
        return F.when(wide, F.lit(0x110000)).otherwise(F.conv(F.when(found == "", "0").otherwise(found), base, 10).cast("bigint"))

    def piece(token: Column) -> Column:
        name = F.regexp_extract(token, r"^&([A-Za-z][A-Za-z0-9]*);", 1)
        bare = F.regexp_extract(token, rf"^&({'|'.join(_BARE)})", 1)
        rest = lambda pattern: F.regexp_replace(token, pattern, "")
        whole = F.when(name != "", F.try_element_at(named, name))
        return (
            F.when(token.rlike("^&#[0-9]"), F.concat(_code_point(number(token, "^&#([0-9]+)", 10, 7)), rest("^&#[0-9]+;?")))
            .when(token.rlike("^&#[xX][0-9a-fA-F]"), F.concat(_code_point(number(token, "^&#[xX]([0-9a-fA-F]+)", 16, 6)), rest("^&#[xX][0-9a-fA-F]+;?")))
            .when(whole.isNotNull(), F.concat(whole, rest(r"^&[A-Za-z0-9]+;")))
            .when(bare != "", F.concat(F.try_element_at(named, bare), F.substr(token, F.length(bare) + 2)))
            .otherwise(token)
        )

    tokens = F.split(text, r"(?=&[#A-Za-z])")
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(tokens, piece), "")).otherwise(text)


def contains_any(text: Column, needles: Column, if_none: bool) -> Column:
    """U4: some lower-cased keyword occurs in the lower-cased text."""
    lowered = F.lower(text)
    hit = F.exists(needles, lambda k: F.contains(lowered, F.lower(k)))
    empty = needles.isNull() | (F.size(needles) == 0)
    return F.when(empty, F.lit(if_none)).otherwise(hit)


def without_words(texts: Column, words: list[str], source: Column) -> Column:
    """Those of ``texts`` whose lower-cased form has none of the ``words``; nulls are left out.

    ``source`` is a text that has every word that is in one of them: it is searched for each word once, they
    are only searched for what was found there.
    """
    whole = F.array(F.lower(source))  # lower-cased once for all words
    some = F.array(*[F.lit(w) for w in words if not any(o != w and o in w for o in words)])
    found = F.transform(whole, lambda s: F.filter(some, lambda w: F.contains(s, w)))[0]

    def clear(text: Column, found: Column) -> Column:
        return ~F.exists(F.array(F.lower(text)), lambda s: F.exists(found, lambda w: F.contains(s, w)))

    def kept(texts: Column, found: Column) -> Column:
        held = F.filter(texts, lambda x: x.isNotNull())
        return F.when(F.size(found) == 0, held).otherwise(F.filter(held, lambda x: clear(x, found)))

    both = F.array(F.struct(texts.alias("texts"), found.alias("found")))
    return F.transform(both, lambda x: kept(x["texts"], x["found"]))[0]


def found_by_words(text: Column, pattern: str, words: list[str]) -> Column:
    """Whether ``pattern`` is found; a text without any of the lower-case ``words``, one of which it needs, is not searched."""
    if not words:
        return text.rlike(pattern)
    # the text is lower-cased once for all words
    held = F.exists(F.array(F.lower(text)), lambda x: reduce(Column.__or__, [F.contains(x, F.lit(w)) for w in words]))
    return held & text.rlike(pattern)


def _literal(c: str) -> str:
    return c if c.isalnum() and c.isascii() else f"\\x{{{ord(c):x}}}"


def any_of_words(words: Iterable[str]) -> str:
    """A regex that finds any of ``words``, shared beginnings tried once: how many words there are hardly matters to a search."""
    trie: dict = {}
    for word in words:
        node = trie
        for c in word:
            if "" in node:  # a shorter word is found first
                break
            node = node.setdefault(c, {})
        else:
            node.clear()
            node[""] = None

    def regex(node: dict) -> str:
        run = ""
        while len(node) == 1 and "" not in node:  # no choice: no group
            c, node = next(iter(node.items()))
            run += _literal(c)
        if "" in node:
            return run
        branches = "|".join(_literal(c) + regex(below) for c, below in sorted(node.items()))
        return f"{run}(?=[{''.join(_literal(c) for c in sorted(node))}])(?:{branches})"

    return regex(trie) if trie else ""


@F.pandas_udf(T.StringType())
def _word_regex(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for lists in batches:
        yield pd.Series([None if ws is None or not len(ws) else any_of_words(w for w in ws if w is not None) for ws in lists], dtype=object)


def keyword_regex(needles: Column) -> Column:
    """One regex for a target's keywords, made once with its watchlist row; null without keywords."""
    return _word_regex(F.transform(needles, lambda k: F.lower(k)))


def keyword_hit(text: Column, regex: Column, if_none: bool) -> Column:
    """U4 by :func:`keyword_regex`: a text is searched once, not once per keyword.

    ``regexp_instr`` keeps the last pattern it compiled, so rows of a target
    should come together.
    """
    return F.when(regex.isNull(), F.lit(if_none)).otherwise(F.regexp_instr(F.lower(text), regex) > 0)


def matches_any(text: Column, regexes: Column) -> Column:
    """Some per-target pattern is found; no pattern keeps everything.

    Patterns are searched as one, which is compiled once for rows of a target
    that come together; those that refer to their own groups one by one.
    """
    own = F.exists(regexes, lambda r: r.rlike(r"\\[1-9k]"))
    single = F.exists(regexes, lambda r: F.regexp_like(text, F.concat(F.lit("(?i)"), r)))
    joined = F.concat(F.lit("(?i)(?:"), F.array_join(regexes, ")|(?:"), F.lit(")"))
    empty = regexes.isNull() | (F.size(regexes) == 0)
    return F.when(empty, F.lit(True)).when(own, single).otherwise(F.regexp_instr(text, joined) > 0)
