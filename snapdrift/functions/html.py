"""HTML as a stream of tokens, and the elements and texts it makes.

One expression reads a page from left to right: comments, declarations, tags
with their quoted attributes, text. Open elements are kept on a stack, as a
browser's simplest tree builder has them: an end tag closes the last open
element of its name and all in it, or nothing; void elements never stay open;
what is not closed ends with the page. An element is its place in the stream,
so its text is a range of the page's texts, and whether a text lies in some
element is a running depth.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape

VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
#: elements whose text is no part of a page's text
APART = frozenset(("script", "style", "template"))
RAW = frozenset(("script", "style"))

_INSIDE = r"""(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+|=)*+"""  # of a start tag, after its name
_TOKEN = re.compile(
    r"<!--(?:-?>|(.*?)(?:--!?>|\Z))"  # 1: comment
    r"|<!\[CDATA\[(.*?)(?:\]\]>|\Z)"  # 2: character data
    r"|<[!?/](?![a-zA-Z]|!--)[^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)"  # declarations, bogus end tags
    r"|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"  # 3: end tag
    rf"|<([a-zA-Z][^\s/>]*+)({_INSIDE})(?:>|\Z)"  # 4, 5: start tag
    r"|([^<]++|<)",  # 6: text
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""", re.S)
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]*$")  # a slash that belongs to a value
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW}
_SCRIPT, _STYLE = "[sS][cC][rR][iI][pP][tT]", "[sS][tT][yY][lL][eE]"
#: Start tags, other tokens run over; a script or style that does not end at once takes its raw text along.
_START = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?/](?![a-zA-Z]|!--)[^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|</[a-zA-Z][^>]*+(?:>|\Z)"
    rf"|<({_SCRIPT})(?=[\s/>]|\Z)({_INSIDE})(?<!/)(?:>|\Z)((?:[^<]++|<(?!/{_SCRIPT}[\s/>]))*+)(?:<[^>]*+(?:>|\Z))?+"  # 1, 2, 3: script, with its end tag
    rf"|<{_STYLE}(?=[\s/>]|\Z){_INSIDE}(?<!/)(?:>|\Z)(?:[^<]++|<(?!/{_STYLE}[\s/>]))*+"
    rf"|<([a-zA-Z][^\s/>]*+)({_INSIDE})(?:>|\Z)",  # 4, 5: any other
    re.S,
)
_RAW_ENDS = re.compile(r"</(?:script|style)(?=[\s/>])", re.I)  # with letters beyond ASCII, as case is ignored
_ONE_QUOTED = re.compile(r"""\s([^\s/>="']++)="([^"&]*+)"\Z""")


def attributes(text: str) -> dict[str, str]:
    """Attributes of a start tag by lower-case name, the last of a name; without a value they are empty."""
    one = _ONE_QUOTED.match(text)
    if one:  # as most tags have it
        return {one[1].lower(): one[2]}
    out = {}
    for name, value in _ATTRIBUTE.findall(text):
        if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1:
            value = value[1:-1]
        out[name.lower()] = unescape(value)
    return out


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name, text)``: ``start`` with its attributes' text, ``empty`` if it ends at once, ``end``, ``text``, ``raw``.

    A text goes on to the next tag or comment; a bare ``<`` is part of it.
    """
    at, end, held = 0, len(html), []
    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        if m[6] is not None:
            held.append(m[6])
            continue
        if held:
            yield "text", "", unescape("".join(held))
            held = []
        if m[4] is not None:
            name, inside = m[4].lower(), m[5]
            empty = inside.endswith("/") and not _UNQUOTED.search(inside)
            yield ("empty" if empty else "start"), name, inside
            if name in RAW and not empty:
                close = _RAW_END[name].search(html, at)
                stop = close.start() if close else end
                if stop > at:
                    yield "raw", "", html[at:stop]
                at = stop
        elif m[3] is not None:
            yield "end", m[3].lower(), ""
        elif m[2] is not None:
            yield "text", "", m[2]
    if held:
        yield "text", "", unescape("".join(held))


class Element:
    """A place in the stream: texts ``first`` to ``last`` are in it."""

    __slots__ = ("name", "inside", "parent", "first", "last", "index", "_attrs")

    def __init__(self, name: str, inside: str, parent: Element | None, first: int, index: int) -> None:
        self.name, self.inside, self.parent, self.first, self.last, self.index, self._attrs = name, inside, parent, first, first, index, None

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            self._attrs = attributes(self.inside)
        return self._attrs


class Page:
    """Elements in the order of their start tags, and texts with the name of the element that sets them apart."""

    def __init__(self, html: str | None) -> None:
        self.elements: list[Element] = []
        self.texts: list[str] = []
        self.apart: list[str | None] = []
        stack: list[Element] = []
        aside: list[str] = []
        children: dict[Element | None, int] = {}
        for kind, name, text in tokens(html or ""):
            if kind in ("text", "raw"):
                self.texts.append(text)
                self.apart.append(aside[-1] if aside else None)
            elif kind == "end":
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
                if at is not None:
                    for e in stack[at:]:
                        e.last = len(self.texts)
                        if e.name in APART:
                            aside.pop()
                    del stack[at:]
            else:
                parent = stack[-1] if stack else None
                children[parent] = children.get(parent, 0) + 1
                element = Element(name, text, parent, len(self.texts), children[parent])
                self.elements.append(element)
                if kind == "start" and name not in VOID:
                    stack.append(element)
                    if name in APART:
                        aside.append(name)
        for e in stack:
            e.last = len(self.texts)

    def pieces(self, element: Element | None = None) -> list[str]:
        """Texts of an element, or of the page, without those set apart by a script inside it."""
        if element is None:
            return [t for t, a in zip(self.texts, self.apart) if a is None]
        own = element.name if element.name in APART else None
        places = range(element.first, element.last)
        return [self.texts[i] for i in places if self.apart[i] == own]

    def text_of(self, element: Element) -> str:
        """Stripped pieces without anything between them."""
        return "".join(p.strip() for p in self.pieces(element))

    def outside(self, names: frozenset[str]) -> list[str]:
        """Texts at depth zero of all elements called one of ``names``."""
        depth = [0] * (len(self.texts) + 1)
        for e in self.elements:
            if e.name in names:
                depth[e.first] += 1
                depth[e.last] -= 1
        out, now = [], 0
        for text, apart, change in zip(self.texts, self.apart, depth):
            now += change
            if not now and apart is None:
                out.append(text)
        return out

    def named(self, *names: str) -> list[Element]:
        return [e for e in self.elements if e.name in names]


def scripts_and_links(html: str) -> tuple[list[tuple[dict[str, str], str]], list[dict[str, str]]]:
    """Attributes and raw text of each script, and attributes of each link, in the order of a page.

    They are what :class:`Page` finds, without its tree and texts: a script's
    text is raw, so no element or text around it matters. A page where that
    hangs on how a tag ends is read as a tree.
    """
    odd = not html.isascii() and any(not m[0].isascii() for m in _RAW_ENDS.finditer(html))
    scripts, links = [], []
    for script, inside, raw, name, other in () if odd else _START.findall(html):
        if script:
            scripts.append((attributes(inside), raw))
        elif name:
            name = name.lower()
            if name == "link":
                links.append(attributes(other))
            elif name in RAW:
                odd = True
                break
    if odd:
        page = Page(html)
        scripts = [(e.attrs, "".join(page.pieces(e))) for e in page.named("script")]
        links = [e.attrs for e in page.named("link")]
    return scripts, links


def lines(texts: list[str]) -> list[str]:
    """Every text ends a line; lines are stripped and not empty."""
    return [s for text in texts for line in text.split("\n") if (s := line.strip())]


# --- selectors ----------------------------------------------------------------

Test = Callable[["Element", "Family"], bool]
_SIMPLE = re.compile(
    r"""(?P<tag>\*|[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)"""
    r"""|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<how>[~|^$*]?=)\s*(?P<value>"[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]"""
    r"""|:(?P<place>first-child|last-child|only-child)|:nth-child\(\s*(?P<nth>[^)]*?)\s*\)|:not\((?P<no>[^()]*)\)"""
)
_HOW: dict[str, Callable[[str, str], bool]] = {
    "=": lambda have, want: have == want,
    "~=": lambda have, want: want in have.split(),
    "|=": lambda have, want: have == want or have.startswith(f"{want}-"),
    "^=": lambda have, want: want != "" and have.startswith(want),
    "$=": lambda have, want: want != "" and have.endswith(want),
    "*=": lambda have, want: want != "" and want in have,
}


class Family:
    """Who is beside whom, found once a page."""

    def __init__(self, page: Page) -> None:
        self.children: dict[Element | None, list[Element]] = {}
        for e in page.elements:
            self.children.setdefault(e.parent, []).append(e)

    def before(self, element: Element) -> list[Element]:
        return self.children[element.parent][: element.index - 1]


def _nth(text: str) -> Callable[[int], bool]:
    text = {"odd": "2n+1", "even": "2n"}.get(text, text)
    m = re.fullmatch(r"([+-]?\d*)n\s*(?:([+-])\s*(\d+))?", text)
    if not m:
        n = int(text)
        return lambda i: i == n
    step = int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
    start = int(f"{m[2]}{m[3]}") if m[3] else 0
    return lambda i: (i == start if step == 0 else (i - start) % step == 0 and (i - start) // step >= 0)


def _compound(text: str) -> Test:
    tests: list[Test] = []
    at = 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m or (m["tag"] and at):
            raise ValueError(f"no selector: {text}")
        at = m.end()
        if m["tag"]:
            tests.append(lambda e, f, n=m["tag"].lower(): n == "*" or e.name == n)
        elif m["id"]:
            tests.append(lambda e, f, n=m["id"]: e.attrs.get("id") == n)
        elif m["class"]:
            tests.append(lambda e, f, n=m["class"]: n in e.attrs.get("class", "").split())
        elif m["attr"]:
            name, how, value = m["attr"].lower(), m["how"], m["value"]
            if how is None:
                tests.append(lambda e, f, n=name: n in e.attrs)
            else:
                value = value[1:-1] if value[:1] in ("'", '"') else value
                tests.append(lambda e, f, n=name, h=_HOW[how], v=value: n in e.attrs and h(e.attrs[n], v))
        elif m["place"]:
            first, last = m["place"] != "last-child", m["place"] != "first-child"
            tests.append(lambda e, f, a=first, b=last: (not a or e.index == 1) and (not b or e.index == len(f.children[e.parent])))
        elif m["nth"] is not None:
            tests.append(lambda e, f, fits=_nth(m["nth"]): fits(e.index))
        else:
            tests.append(lambda e, f, no=_compound(m["no"].strip()): not no(e, f))
    if not tests:
        raise ValueError("an empty selector")
    return lambda e, f: all(t(e, f) for t in tests)


_PART = re.compile(r"\s*([>+~])\s*|(\s+)|((?:\[[^\]]*\]|\([^)]*\)|[^\s>+~\[(])+)")


@lru_cache(maxsize=10_000)
def selector(text: str) -> list[list[tuple[str, Test]]]:
    """The alternatives of a selector, each as steps from the element outwards: how a step is related to the one before, and its test."""
    found = []
    for alternative in re.split(r",(?![^\[(]*[\])])", text):
        alternative, steps, relation = alternative.strip(), [], ""
        if _PART.sub("", alternative):
            raise ValueError(f"no selector: {text}")
        parts = _PART.findall(alternative)
        for sign, blank, compound in parts:
            if compound:
                steps.append((relation, _compound(compound)))
                relation = ""
            elif sign and relation in ("", " ") and steps:
                relation = sign
            elif blank and not relation:
                relation = " "
            elif not blank:
                raise ValueError(f"no selector: {text}")
        if not steps or relation.strip():
            raise ValueError(f"no selector: {text}")
        found.append(list(reversed(steps)))
    return found


def _matches(element: Element, steps: list[tuple[str, Test]], family: Family) -> bool:
    relation, test = steps[0]
    if not test(element, family):
        return False
    rest = steps[1:]
    if not rest:
        return True
    if relation == ">":
        return element.parent is not None and _matches(element.parent, rest, family)
    if relation in ("+", "~"):
        before = family.before(element)
        return any(_matches(e, rest, family) for e in (before[-1:] if relation == "+" else before))
    above = element.parent
    while above is not None:
        if _matches(above, rest, family):
            return True
        above = above.parent
    return False


def select(page: Page, text: str) -> list[Element]:
    """Elements in the order of the page; a text that is no selector finds none."""
    try:
        alternatives = selector(text)
    except ValueError:
        return []
    family = Family(page)
    return [e for e in page.elements if any(_matches(e, steps, family) for steps in alternatives)]
