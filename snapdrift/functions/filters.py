"""Noise filters and interest categories. Cheap tests come first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapdrift.functions import fixed_values as fv
from snapdrift.functions import patterns as p
from snapdrift.functions import text as t


#: Longest literal and longest resource that may be product text; what is longer is code or a document.
MAX_LITERAL = MAX_RESOURCE = 500


def script_noise_ok(s: Column, longest: int = MAX_LITERAL) -> Column:
    """A stripped literal of four to ``longest`` characters that may be interface text."""
    return (
        F.length(s).between(4, longest)
        & ~s.isin(fv.SCRIPT_NOISE_TOKENS)
        & ~F.lower(s).isin(fv.SCRIPT_NOISE_TOKENS)
        & (t.count_chars(s, fv.CODE_CHARS) <= 3)
        & (t.letter_count(s) * 2 >= F.length(s))
        & ~s.rlike(p.SCRIPT_NOISE)
    )


def script_category(s: Column) -> Column:
    """Category of a kept literal, null when it is dropped."""
    upper, one = t.starts_upper(s), t.has_words(s, 1)
    return (
        F.when(t.found_by_words(s, p.JVM_SCRIPT_INTEREST, p.SCRIPT_INTEREST_NEEDS), "high_interest")
        .when(t.has_words(s, 2), F.when(t.has_words(s, 3), "ui_text").when(upper, "feature_name").otherwise("string"))
        .when(one & upper & (F.length(s) >= 5), "proper_noun")
        .when(one & (F.length(s) < 8), None)
        .otherwise("string")
    )


def script_kept(s: Column) -> Column:
    """Literals with a category; the pattern search is left to short single words."""
    upper = t.starts_upper(s) & (F.length(s) >= 5)
    return (F.length(s) >= 8) | upper | t.has_words(s, 2) | s.rlike(p.JVM_SCRIPT_INTEREST)


def resource_noise_ok(name: Column, value: Column, longest: int = MAX_RESOURCE) -> Column:
    """U8: a resource whose stripped value, of four to ``longest`` characters, may be product copy."""
    return (
        F.length(value).between(4, longest)
        & (t.count_chars(value, "%") <= 2)
        & (t.count_chars(value, "{") <= 3)
        & (t.letter_count(value) * 5 >= F.length(value) * 2)
        & ~name.rlike(p.RESOURCE_NAME_NOISE)
        & ~value.rlike(p.RESOURCE_NOISE)
    )


def resource_category(value: Column) -> Column:
    """Category of a kept resource value, null when it is dropped."""
    title = value.rlike(fv.TITLE_CASE_PATTERN)
    return (
        F.when(value.rlike(p.JVM_RESOURCE_INTEREST), "high_interest")
        .when(title & ~value.isin(fv.STOCK_LABELS), "feature_name")
        .when(title, None)
        .when(t.starts_upper(value) & t.has_words(value, 4), "ui_text")
    )


def doc_signal(line: Column, keyword: Column) -> Column:
    """A documentation line with a product signal, or with a ``keyword`` of its target."""
    return (F.length(line) >= 10) & ~line.rlike(p.DOC_NOISE) & (line.rlike(p.JVM_DOC_SIGNAL) | keyword)


def notable_removed(s: Column) -> Column:
    """A vanished literal that reads like a name."""
    return t.starts_upper(s) & t.has_words(s, 2)


def cert_subdomain(name: Column, domain: Column) -> Column:
    return F.replace(name, F.concat(F.lit("."), F.lower(domain)), F.lit(""))


def cert_name_ok(name: Column, domain: Column) -> Column:
    """A certificate name that is not infrastructure."""
    sub = cert_subdomain(name, domain)
    short_code = sub.rlike(r"^[a-z0-9]{4,8}$")
    few_vowels = t.count_chars(sub, "aeiou") * 4 < F.length(sub)
    return (
        (F.length(sub) >= 3)
        & (t.count_chars(sub, ".") <= 2)
        & ~(short_code & few_vowels)
        & ~sub.rlike(p.CERT_NOISE)
        & ~sub.rlike(p.CERT_NOISE_WORDS)
    )


def asset_ok(asset: Column) -> Column:
    """An asset address that is neither a hash nor a tracker."""
    path = F.regexp_replace(asset, r"^[^/]*/", "")
    last_segment = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return (
        ~asset.rlike(p.ASSET_NOISE_WORDS + "|data:|blob:")
        & ~path.rlike(fv.ASSET_LONG_HASH)
        & ~last_segment.rlike(fv.ASSET_HASH_SEGMENT)
        & ~path.rlike("(?i)" + fv.ASSET_HASH_FILE)
    )


def schema_kind(item: Column) -> Column:
    """What stands before the first colon."""
    return F.split_part(item, F.lit(":"), F.lit(1))


def schema_name(item: Column) -> Column:
    """What stands after the first colon."""
    return F.regexp_replace(item, "^[^:]*:", "")
