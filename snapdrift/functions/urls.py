"""Url columns: reference resolution and query stripping, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"


def _part(url: Column, group: int) -> Column:
    """1 scheme, 2 host, 3 path, 4 query with ``?``, 5 fragment with ``#``."""
    return F.regexp_extract(url, r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$", group)


def _fold_dots(path: Column) -> Column:
    """Drop ``.`` and let ``..`` remove the segment before it."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    closed = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    joined = F.array_join(closed, "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def _base(base: Column) -> Column:
    """What references need of the address of their page."""
    origin = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    parts = {"whole": base, "scheme": _part(base, 1), "origin": origin, "path": _part(base, 3), "query": _part(base, 4)}
    return F.struct(*[part.alias(name) for name, part in parts.items()])


def resolve_url(base: Column, ref: Column) -> Column:
    """A reference made absolute against the page it stands on."""
    return _resolved(_base(base), ref)


def resolve_urls(base: Column, refs: Column) -> Column:
    """:func:`resolve_url` of each of ``refs``; the page's address is taken apart once for all of them."""
    both = F.array(F.struct(_base(base).alias("base"), refs.alias("refs")))
    return F.transform(both, lambda x: F.transform(x["refs"], lambda r: _resolved(x["base"], r)))[0]


def _resolved(base: Column, ref: Column) -> Column:
    scheme, origin, base_path = base["scheme"], base["origin"], base["path"]
    ref_path, query, fragment = _part(ref, 3), _part(ref, 4), _part(ref, 5)
    query = F.when(query == "?", "").otherwise(query)
    fragment = F.when(fragment == "#", "").otherwise(fragment)
    folder = F.regexp_replace(F.when(base_path == "", "/").otherwise(base_path), r"[^/]*$", "")
    # inner empty segments vanish from relative joins only
    relative = F.regexp_replace(F.concat(folder, ref_path), r"(?<=.)/{2,}", "/")
    path = F.when(ref_path.startswith("/"), ref_path).otherwise(relative)
    tail = F.concat(query, fragment)
    # most references are a plain path from the root; of those nothing has to be taken apart
    marks = [ref.contains(x) for x in ("/.", "?", "#")]
    plain = ref.startswith("/") & ~ref.startswith("//") & ~(marks[0] | marks[1] | marks[2])
    return (
        F.when(plain, F.concat(origin, ref))
        .when(ref == "", base["whole"])
        .when(ref.rlike(_SCHEME) & (_part(ref, 1) != scheme), ref)
        .when(ref.rlike(_SCHEME), F.regexp_replace(ref, r"[?#]$", ""))
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), F.regexp_replace(ref, r"[?#]$", "")))
        .when((ref_path == "") & (query == ""), F.concat(origin, base_path, base["query"], fragment))
        .when(ref_path == "", F.concat(origin, base_path, tail))
        .otherwise(F.concat(origin, _fold_dots(path), tail))
    )


def strip_query(url: Column) -> Column:
    """Host and path only, without parameters of the last segment."""
    return F.concat(_part(url, 2), F.regexp_replace(_part(url, 3), ";[^/]*$", ""))
