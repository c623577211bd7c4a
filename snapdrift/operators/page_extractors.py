"""Items out of web pages, scripts, sitemaps and robots files.

Each extractor maps the body of one capture to an array column, so extraction
is a narrow projection: no shuffle, and nothing spans two captures. What depends
on a page's elements is read from its tokens (:mod:`snapdrift.functions.html`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdrift.functions import fixed_values as fv
from snapdrift.functions import html as dom
from snapdrift.functions import patterns as p
from snapdrift.functions import text as t
from snapdrift.functions import urls as u


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


_STRINGS = T.ArrayType(T.StringType())


def _record(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def _of_page(kind: T.DataType, read: Callable, parse: Callable[[str], object] = dom.Page) -> Callable[[Column], Column]:
    """A column function of a page's elements and texts, or what ``parse`` makes of it; each page is read once, in Arrow batches."""
    record = isinstance(kind, T.StructType)
    none = dict.fromkeys(kind.names) if record else None

    def run(bodies: pd.Series) -> pd.Series:
        found = [none if b is None else read(parse(b)) for b in bodies]
        return pd.DataFrame(found, columns=kind.names) if record else pd.Series(found, dtype=object)

    run.__annotations__ = {"bodies": pd.Series, "return": pd.DataFrame if record else pd.Series}
    return F.pandas_udf(run, kind)


def _script_refs(html: str) -> dict:
    """Addresses of scripts, of preloaded files, and the text of scripts without an address."""
    scripts, links = dom.scripts_and_links(html)
    pairs = [(attrs.get("rel", ""), attrs.get("href", "")) for attrs in links]
    return {
        "sources": [attrs["src"] for attrs, _ in scripts if "src" in attrs],
        "links": [href for rel, href in pairs if ("preload" in rel or "prefetch" in rel) and (".js" in href or "chunk" in href.lower())],
        "inline": "\n".join(raw for attrs, raw in scripts if "src" not in attrs),
    }


_refs = _of_page(_record(sources=_STRINGS, links=_STRINGS, inline=T.StringType()), _script_refs, str)


def script_refs(html: Column) -> Column:
    """Script addresses as a page writes them."""
    found = _refs(html)
    inline = found["inline"]
    chunks = _all(
        inline,
        r"""(?i)["']([^"']*?(?:chunk|bundle|vendor|main|app|index)[^"']*?\.js[^"']*?)["']""",
    )
    built = F.transform(_all(inline, r"""["'](_next/static/[^"']+\.js)["']"""), lambda s: F.concat(F.lit("/"), s))
    rooted = _all(inline, r"""["'](/[^"']*?\.(?:js|mjs))["']""")
    return F.array_distinct(F.concat(found["sources"], found["links"], chunks, built, rooted))


def script_addresses(refs: Column, base: Column) -> Column:
    """References resolved against the page's address, without trackers.

    Resolving joins parts of both at one of ``/ ? # :``, which no tracker's word has, so a word is in one of them.
    """
    written = F.array_join(F.concat(F.array(base), refs), "\n")
    return F.sort_array(F.array_distinct(t.without_words(u.resolve_urls(base, refs), fv.TRACKER_WORDS, written)))


def js_bundle_urls(html: Column, base: Column) -> Column:
    """Script addresses named by a page, in order of their text."""
    return script_addresses(script_refs(html), base)


def quoted_strings(script: Column) -> Column:
    """Quoted literals of three units or more.

    Possessive repeats keep the matcher iterative: a literal of any length or
    number of escapes cannot exhaust the stack. Phase errors after a shorter
    literal are part of the definition. Characters without escapes are run over
    at once where literals are many.
    """
    double = _all(script, r'"((?=(?:[^"\\]|\\[^\n]){3})[^"\\]*+(?:\\[^\n][^"\\]*+)*+)"')
    single = _all(script, r"'((?:[^'\\]|\\[^\n]){3,}+)'")
    template = F.transform(
        _all(script, r"`((?:[^`\\]|\\[^\n]){3,}+)`"), lambda s: t.strip(F.regexp_replace(s, r"\$\{[^}]*\}", "..."))
    )
    return F.array_distinct(F.concat(double, single, F.filter(template, lambda s: F.length(s) >= 3)))


_HIDDEN = frozenset(("script", "style", "nav", "footer", "header"))
_visible = _of_page(_STRINGS, lambda found: dom.lines(found.outside(_HIDDEN)))


def visible_text_lines(html: Column) -> Column:
    """Visible text; every tag boundary ends a line. A text without tags is not parsed."""
    tagged = F.contains(html, F.lit("<"))
    return F.when(tagged, _visible(F.when(tagged, html))).otherwise(t.lines(t.decode_entities(html)))


def visible_text(html: Column) -> Column:
    return F.array_join(visible_text_lines(html), "\n")


@F.pandas_udf(_STRINGS)
def selected_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Text of the elements a selector finds; one that is none finds nothing."""
    for html, selector in batches:
        pages = (dom.Page(h) for h in html)
        yield pd.Series([[p.text_of(e) for e in dom.select(p, s)] for p, s in zip(pages, selector)], dtype=object)


_TITLE_TAGS = ("a", "h2", "h3", "h4", "span", "div")
TITLE_LENGTHS = range(21, 120)


def _titles(found: dom.Page) -> list[str]:
    """Texts of links, headings and boxes that are as long as a title; others are not put together."""
    lengths = [0 if apart else len(text.strip()) for text, apart in zip(found.texts, found.apart)]
    until = [0, *accumulate(lengths)]
    return [found.text_of(e) for e in found.named(*_TITLE_TAGS) if until[e.last] - until[e.first] in TITLE_LENGTHS]


element_texts = _of_page(_STRINGS, _titles)


def job_titles_page(html: Column) -> Column:
    """Element texts that look like a job title, first occurrences."""
    return F.array_distinct(F.filter(element_texts(html), lambda s: F.lower(s).rlike(p.ROLE_WORDS)))


def _table_rows(found: dom.Page) -> list[list[str]]:
    """Cells of every row with four and more, those of tables inside it included."""
    rows: dict[dom.Element, list[dom.Element]] = {e: [] for e in found.named("tr")}
    for cell in found.named("td"):
        above = cell.parent
        while above is not None:
            if above.name == "tr":
                rows[above].append(cell)
            above = above.parent
    return [[found.text_of(c) for c in cells] for cells in rows.values() if len(cells) >= 4]


_rows = _of_page(T.ArrayType(_STRINGS), _table_rows)


def filing_rows(html: Column, code: Column) -> Column:
    """Table rows about ``code``, with all their cells."""
    texts = F.transform(_rows(html), lambda c: F.struct(F.array_join(c, " | ").alias("text"), F.size(c).alias("n")))
    kept = F.filter(texts, lambda r: (r["n"] >= 5) | F.contains(F.upper(r["text"]), F.upper(code)))
    return F.transform(kept, lambda r: r["text"])


_text = _of_page(T.StringType(), lambda found: "".join(found.pieces()))


def trademark_marks(html: Column) -> Column:
    """``struct(item, detail)`` per mark.

    A page without serial numbers falls back to its mark labels, numbered by
    their place in the list.
    """
    text = _text(html)
    main, alternate = p.portable(fv.TRADEMARK_SERIAL_MARK), p.portable(fv.TRADEMARK_WORD_MARK)
    serials = F.arrays_zip(_all(text, main, 1).alias("serial"), _all(text, main, 2).alias("mark"))
    serials = F.transform(serials, lambda m: F.struct(m["serial"].alias("serial"), t.strip(m["mark"]).alias("mark")))
    serials = F.filter(serials, lambda m: F.length(m["mark"]) > 1)
    labels = F.transform(
        _all(text, alternate), lambda m, i: F.struct(i.cast("string").alias("serial"), t.strip(m).alias("mark"))
    )
    labels = F.filter(labels, lambda m: F.length(m["mark"]) > 2)
    marks = F.when(F.size(serials) > 0, serials).otherwise(labels)
    return F.transform(
        marks,
        lambda m: F.struct(
            F.concat_ws("\t", m["serial"], m["mark"]).alias("item"),
            F.create_map(F.lit("serial"), m["serial"], F.lit("mark"), m["mark"]).alias("detail"),
        ),
    )


def robots_directives(body: Column) -> Column:
    """Paths of allow and disallow lines, and sitemap addresses."""

    def directive(line: Column) -> Column:
        path = t.strip(F.regexp_extract(line, rf"^(?:Dis)?[Aa]llow:[{p.BLANK}]*(.+)", 1))
        sitemap = F.regexp_extract(line, rf"^[Ss]itemap:[{p.BLANK}]*(.+)", 1)
        return F.when(sitemap != "", F.concat(F.lit("SITEMAP: "), t.strip(sitemap))).when(
            ~path.isin("", "/", "*"), path
        )

    found = F.transform(t.lines(body), directive)
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def _asset_refs(found: dom.Page) -> dict:
    media = (e.attrs.get("src") or e.attrs.get("data-src") or "" for e in found.named("img", "video", "source"))
    links = (e.attrs for e in found.named("link"))
    wanted = {"preload", "prefetch"}
    return {
        "media": [m for m in media if m],
        "preloaded": [a["href"] for a in links if a.get("href") and wanted & set(a.get("rel", "").lower().split())],
    }


_assets = _of_page(_record(media=_STRINGS, preloaded=_STRINGS), _asset_refs)


def page_assets(html: Column, base: Column, cdn_domains: Column) -> Column:
    """Media on the page and preloaded files, without query strings."""
    found = _assets(html)
    media = u.resolve_urls(base, found["media"])
    any_domain = cdn_domains.isNull() | (F.size(cdn_domains) == 0)
    media = F.filter(media, lambda s: any_domain | F.exists(cdn_domains, lambda d: F.contains(s, d)))
    preloaded = u.resolve_urls(base, found["preloaded"])
    return F.array_distinct(F.transform(F.concat(media, preloaded), u.strip_query))


def _locations(xml: Column, element: str) -> Column:
    xml = F.regexp_replace(xml, r"(?s)<!--.*?-->", "")
    prefix = r"(?:[A-Za-z_][\w.-]*:)?"
    blocks = _all(xml, rf"(?s)<{prefix}{element}(?:\s[^>]*)?>(.*?)</{prefix}{element}\s*>")
    locs = F.transform(blocks, lambda b: F.regexp_extract(b, rf"(?s)<{prefix}loc(?:\s[^>]*)?>(.*?)</{prefix}loc\s*>", 1))
    clean = F.transform(locs, lambda s: t.strip(t.decode_entities(F.regexp_replace(s, r"<!\[CDATA\[|\]\]>", ""))))
    return F.array_distinct(F.filter(clean, lambda s: s != ""))


def page_locations(xml: Column) -> Column:
    """Page addresses of a sitemap."""
    return _locations(xml, "url")


def child_sitemaps(xml: Column) -> Column:
    """Addresses of the sitemaps an index names."""
    return _locations(xml, "sitemap")
