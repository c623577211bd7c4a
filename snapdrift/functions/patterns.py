"""Portable regexes and literal lists.

Java, RE2 and Python disagree on ``\\w \\d \\s \\b`` and on what counts as
blank, so shared patterns spell the Unicode classes out. The result runs
unchanged in Spark and in DuckDB.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from snapdrift.functions import fixed_values as fv

WORD = r"\p{L}\p{N}_"
BLANK = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
BLANK_CHARS = "".join(chr(c) for c in range(0x3001) if re.match(r"\s", chr(c)))
BOUNDARY_BEFORE = f"(?:^|[^{WORD}])"
STRIP = f"^[{BLANK}]+|[{BLANK}]+$"
BLANKS = f"[{BLANK}]+"
_CLASSES = {"w": WORD, "d": r"\p{Nd}", "s": BLANK}


def portable(pattern: str) -> str:
    """Expand ``\\w \\d \\s`` everywhere and ``\\b`` at either end."""
    if pattern.startswith(r"\b"):
        pattern = BOUNDARY_BEFORE + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + f"(?:$|[^{WORD}])"
    out, in_class, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair[0] == "\\" and len(pair) == 2:
            content = _CLASSES.get(pair[1])
            out.append(pair if content is None else content if in_class else f"[{content}]")
            i += 2
            continue
        if pair[0] == "[":
            in_class = True
        elif pair[0] == "]":
            in_class = False
        out.append(pair[0])
        i += 1
    return "".join(out)


def _by_first(patterns: Sequence[str], ahead: bool) -> str:
    """An alternation that looks at the first letter once: patterns that begin with the same one share it.

    ``ahead`` also looks for any first letter before it tries the patterns, as
    far as they begin with one; matchers without look-ahead can't read that.
    """
    groups: dict[str, list[str]] = {}
    for pattern in patterns:
        literal = re.match(r"[A-Za-z0-9% ](?![?*+{|])", pattern) and "|" not in re.sub(r"\([^()]*\)", "", pattern)
        groups.setdefault(pattern[0].lower() if literal else "", []).append(pattern)
    parts = []
    for first, own in groups.items():
        if first and len(own) > 1:
            parts.append(f"{first}(?:{'|'.join(x[1:] for x in own)})")
        else:
            parts += own
    body = "|".join(parts)
    return f"(?=[{''.join(groups)}])(?:{body})" if ahead and "" not in groups else body


def any_of(patterns: Sequence[str], ignore_case: bool = False, ahead: bool = False) -> str:
    """One alternation, compiled once per task.

    Patterns with a common start share it: a matcher then looks at the head of
    the text only (``^``) or at word starts only (``\\b``).
    """
    starts: dict[str, list[str]] = {}
    for pattern in map(portable, patterns):
        start = next((s for s in ("^", BOUNDARY_BEFORE) if pattern.startswith(s)), "")
        starts.setdefault(start, []).append(pattern[len(start) :])
    alike = (lambda rest: _by_first(rest, True)) if ahead and ignore_case else "|".join
    body = "|".join(f"{start}(?:{alike(rest)})" for start, rest in starts.items())
    return f"(?i){body}" if ignore_case else body


def needed_words(patterns: Sequence[str]) -> list[str]:
    """Lower-case words one of which is in every text that ``patterns`` match, whatever its case.

    Of each pattern the longest run of characters that it cannot do without;
    none if a pattern has no such run of three, as nothing then tells.
    """
    found = set()
    for pattern in patterns:
        plain = re.sub(r"\[(?:\\.|[^\]\\])*\]|\\[^\w]|\\\w", "\0", pattern)  # classes and escapes
        while "(" in plain and (less := re.sub(r"\([^()]*\)", "\0", plain)) != plain:
            plain = less
        plain = re.sub(r".(?:[?*]|\{[^}]*\})|[+^$.]", "\0", plain)
        word = max(plain.split("\0"), key=len)
        if "|" in plain or len(word) < 3 or not word.isascii():
            return []
        found.add(word.lower())
    return sorted(w for w in found if not any(o in w for o in found - {w}))


def any_word(words: Sequence[str]) -> str:
    """Alternation of literal words."""
    return "|".join(re.escape(w).replace("\\-", "-").replace("\\ ", " ").replace("\\/", "/") for w in words)


SCRIPT_NOISE = any_of(fv.SCRIPT_NOISE_PATTERNS)
SCRIPT_INTEREST = any_of(fv.SCRIPT_INTEREST_PATTERNS, ignore_case=True)
DOC_SIGNAL = any_of(fv.DOC_SIGNAL_PATTERNS, ignore_case=True)
DOC_NOISE = any_of(fv.DOC_NOISE_PATTERNS, ignore_case=True)
RESOURCE_NAME_NOISE = f"(?i)^(?:{any_word(fv.RESOURCE_NAME_PREFIXES)})"
RESOURCE_NOISE = any_of(fv.RESOURCE_NOISE_PATTERNS, ignore_case=True)
# the same for the JVM's matcher
JVM_SCRIPT_INTEREST = any_of(fv.SCRIPT_INTEREST_PATTERNS, ignore_case=True, ahead=True)
JVM_DOC_SIGNAL = any_of(fv.DOC_SIGNAL_PATTERNS, ignore_case=True, ahead=True)
SCRIPT_INTEREST_NEEDS = needed_words(fv.SCRIPT_INTEREST_PATTERNS)
JVM_RESOURCE_INTEREST = any_of(fv.RESOURCE_INTEREST_PATTERNS, ignore_case=True, ahead=True)
RESOURCE_INTEREST = any_of(fv.RESOURCE_INTEREST_PATTERNS, ignore_case=True)
CERT_NOISE_WORDS = any_word(fv.CERT_NOISE_WORDS)
CERT_NOISE = any_of(fv.CERT_NOISE_PATTERNS)
ASSET_NOISE_WORDS = any_word(fv.ASSET_NOISE_WORDS)
TRACKER_WORDS = any_word(fv.TRACKER_WORDS)
ROLE_WORDS = any_word(fv.ROLE_WORDS)
UPPER_FIRST = r"^\p{Lu}"
