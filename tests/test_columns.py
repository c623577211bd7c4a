"""Column functions against literal cases and the standard library."""

from __future__ import annotations

import datetime
import html
import re
from urllib.parse import urljoin, urlparse
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from snapdrift.catalog.columns import SEEDS
from snapdrift.functions import cadence, filters, patterns, text, urls
from snapdrift.functions import fixed_values as fv
from snapdrift.operators import page_extractors as page


def test_strip_takes_every_blank(one):
    cases = ["  a b \r\n", "\x1f\t　x ", "", " \n "]
    assert one(text.strip, cases) == [c.strip() for c in cases]


def test_needed_words_are_in_every_match(one):
    texts = ["% of users", "an A/B  test", "A/B TEST", "Rollout", "roll_OUT", "a role", "BETA", "alphabeta", "x-beta.", "EXPERIMENTid", "experimental", "feature flag", "features", "İnternal only", "ıntroducing", "INTRODUCING", ""]
    assert one(lambda c: text.found_by_words(c, patterns.JVM_SCRIPT_INTEREST, patterns.SCRIPT_INTEREST_NEEDS), texts) == one(lambda c: c.rlike(patterns.JVM_SCRIPT_INTEREST), texts)
    assert one(lambda c: text.found_by_words(c, patterns.JVM_SCRIPT_INTEREST, patterns.SCRIPT_INTEREST_NEEDS), [None]) == [None]
    for pattern in fv.SCRIPT_INTEREST_PATTERNS:
        (word,) = patterns.needed_words([pattern])
        assert any(w in word for w in patterns.SCRIPT_INTEREST_NEEDS)
    assert patterns.needed_words([r"a(?:b|c)defg?", r"x[ab]yz1", r"q\s+who"]) == ["def", "who", "yz1"]
    assert patterns.needed_words(["foo|bar"]) == patterns.needed_words(["ab?c", "long word"]) == patterns.needed_words([r"(?:one|two)"]) == []


def test_word_count_is_split(one):
    cases = ["", " a ", "a b", "a b c\nd", "  "]
    assert one(text.word_count, cases) == [len(c.split()) for c in cases]


def test_entities(one):
    cases = [
        "a &amp; b", "&amp;lt;", "&#65;&#x42;&#8364;", "&eacute;t&eacute;", "&apos;&quot;", "AT&T; &unknown; x", "no", "&copy;&middot;",
        "&#128512;", "& &; &#;",
    ]
    assert one(text.decode_entities, cases) == [html.unescape(c) for c in cases]


def test_clip_counts_code_points(one):
    assert one(lambda c: text.clip(c, 2), ["😀é漢", "a"]) == ["😀é", "a"]


def test_target_key(one):
    key = one(text.target_key, [("Docs", "https://x.example.com")])[0]
    assert re.fullmatch(r"Docs:[0-9a-f]{8}", key)


def test_keyword_rules(one):
    cases = [("New Model", ["model"]), ("New Model", ["MODEL"]), ("x", ["model"]), ("x", [])]
    assert one(lambda s, k: text.contains_any(s, k, True), cases) == [True, True, False, True]
    assert one(lambda s, k: text.contains_any(s, k, False), cases) == [True, True, False, False]
    assert one(lambda s, k: text.keyword_hit(s, text.keyword_regex(k), True), cases) == [True, True, False, True]
    assert one(lambda s, k: text.keyword_hit(s, text.keyword_regex(k), False), cases) == [True, True, False, False]


def test_many_keywords_at_once(spark):
    """Equal to one search a keyword, in a time that the number of keywords hardly changes."""
    import random
    import time

    rng = random.Random(1)
    letters = "abcde .-(É[$\\"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    lists = [[word(rng.randint(1, 6)) for _ in range(rng.randint(0, 12))] for _ in range(60)] + [None, [""], ["a", None], ["abc", "ab", "abcd"]]
    texts = [word(rng.randint(0, 25)) for _ in range(300)]
    rows = [(x, ws) for x in texts for ws in rng.sample(lists, 6)]
    frame = spark.createDataFrame(rows, "x string, ws array<string>").repartition(2)
    both = frame.select("x", "ws", text.keyword_hit(F.col("x"), text.keyword_regex(F.col("ws")), False).alias("hit"))
    for r in both.collect():
        assert r.hit == any(w.lower() in r.x.lower() for w in r.ws or [] if w is not None), r

    many = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 512).alias("x")).cache()
    many.count()

    def spent(n):
        needles = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("q"), F.substring(F.md5(i.cast("string")), 1, 8)))
        target = spark.range(1).select(text.keyword_regex(needles).alias("regex")).cache()
        found = many.join(F.broadcast(target)).filter(text.keyword_hit(F.col("x"), F.col("regex"), False))
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            assert found.count() == 0
            best = min(best, time.perf_counter() - start)
        return best

    assert spent(10_000) < 8 * spent(10) + 1


def test_patterns_ignore_case(one):
    cases = [("/Blog/x", ["/blog/", "q"]), ("/news", ["^/blog"]), ("/news", []), ("/abab", ["x", r"(ab)\1"]), ("b|c", ["a|d", "^c"]), ("q", ["a|q"])]
    assert one(text.matches_any, cases) == [True, False, True, True, False, True]


BASES = ["https://h.com", "https://h.com/", "https://h.com/a", "https://h.com/a/", "https://h.com/a/b?x=1#f", "http://h.com/a/b/c.html"]
REFS = [
    "", "x", "./x", "../x", "../../x", "../../../x", "/x", "/x/../y", "//o.com/z", "https://o.com", "https://o.com/a#", "?q", "#f",
    "x?y#z", "x/", "x/.", "x/..", ".", "..", "a//b", "/a//b", "data:image/png;base64,AA", "mailto:x@y", "//o.com", "x;p", "?", "#",
]


def test_resolve_url_equals_urljoin(one):
    cases = [(b, r) for b in BASES for r in REFS]
    got = one(urls.resolve_url, cases)
    assert [(c, g) for c, g in zip(cases, got) if g != urljoin(*c)] == []


def test_references_of_a_page_are_resolved_together(one):
    got = one(lambda base, refs: urls.resolve_urls(base, refs), [(b, [*REFS, None]) for b in BASES])
    assert got == [[urljoin(b, r) for r in REFS] + [None] for b in BASES]


def test_the_address_of_a_page_is_taken_apart_once_for_all_references(spark):
    df = spark.createDataFrame([("https://h.com/a/", ["/x", "y"])], "base string, refs array<string>").repartition(1)
    plan = df.select(page.script_addresses(F.col("refs"), F.col("base")).alias("urls"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(base") == 5, plan  # scheme twice, host, path, query


def test_addresses_of_trackers_are_left_out(one):
    base, half = "https://h.com/anal", ["ytics.js", "?ytics", "lytics"]
    cases = [
        (base, half + ["/a/Analytics.js", "/b.js", "/GTM.js", None]),
        ("https://segment.com/", ["/x.js", "https://o.com/y.js"]), (base, half), (None, ["/a", "https://o.com/a", "https://o.com/gtm"]), (base, []),
    ]
    kept = [[urljoin(base, r) for r in half], [], [urljoin(base, r) for r in half], ["https://o.com/a"], []]
    kept[0].append("https://h.com/b.js")
    kept[1] = ["https://o.com/y.js"]
    assert one(lambda b, refs: page.script_addresses(refs, b), cases) == [sorted(k) for k in kept]


def test_strip_query_equals_urlparse(one):
    cases = ["https://h.com/a?b#c", "http://h.com", "https://h.com:8/p;x", "//h.com/z"]
    assert one(urls.strip_query, cases) == [urlparse(c).netloc + urlparse(c).path for c in cases]


SENTENCES = SEEDS + [
    "élan nouveau préview", "é_beta_x", "naïve-beta test", "ÉCOLE de Paris", "Workspace 2", "日本語 テキスト です", "a b c now", "GA", "GAé", "x" * 501,
    "AI é", "Fréé tier plan", "1 2 3 4 5 6 7 8", "İstanbul city", "save; (a) [b] {c} now ok",
]


def _noise(s: str) -> bool:
    """The script filter, said with the patterns as they are written."""
    if not 4 <= len(s) <= 500 or s in fv.SCRIPT_NOISE_TOKENS or s.lower() in fv.SCRIPT_NOISE_TOKENS:
        return True
    if any(re.search(p, s) for p in fv.SCRIPT_NOISE_PATTERNS):
        return True
    return sum(c.isalpha() for c in s) * 2 < len(s) or sum(c in fv.CODE_CHARS for c in s) > 3


def test_script_filter_equals_python(one):
    assert one(filters.script_noise_ok, SENTENCES) == [not _noise(s) for s in SENTENCES]


@pytest.mark.parametrize(
    "s, category",
    [
        ("Coming Soon", "high_interest"), ("Try the BETA", "high_interest"), ("alphabeta", "string"), ("one two three", "ui_text"),
        ("Photo Studio", "feature_name"), ("photo studio", "string"), ("Hello", "proper_noun"), ("Work", None), ("word", None),
        ("tokenization", "string"), ("Éclair", "proper_noun"), ("rollout", "high_interest"), ("roll_out", "high_interest"),
    ],
)
def test_script_category(one, s, category):
    assert one(filters.script_category, [s]) == [category]


def test_kept_scripts_have_a_category(one):
    kept, category = one(filters.script_kept, SENTENCES), one(filters.script_category, SENTENCES)
    assert kept == [c is not None for c in category]


def test_doc_signal_equals_python(one):
    signal = re.compile("|".join(fv.DOC_SIGNAL_PATTERNS), re.I)
    noise = re.compile("|".join(fv.DOC_NOISE_PATTERNS), re.I)
    want = [len(s) >= 10 and not noise.search(s) and bool(signal.search(s)) for s in SENTENCES]
    assert one(lambda s: filters.doc_signal(s, F.lit(False)), SENTENCES) == want


def test_doc_signal_takes_keywords(one):
    cases = [("a plain sentence", ["PLAIN"]), ("a plain sentence", ["other"]), ("plain", ["plain"])]
    assert one(lambda s, k: filters.doc_signal(s, text.contains_any(s, k, False)), cases) == [True, False, False]


def test_resource_filter(one):
    cases = [
        ("title", "Smart Canvas"), ("ABC_title", "Smart Canvas"), ("title", "ok"), ("title", "Cancel"), ("title", "com.a.b"), ("title", "%a %b %c of"),
        ("title", "12345 a"), ("title", "{a}{b}{c}{d} text here"), ("errors", "Network gone"), ("error_1", "Network gone"),
    ]
    assert one(filters.resource_noise_ok, cases) == [True, False, False, False, False, False, False, False, True, False]


def test_resource_category(one):
    cases = ["Smart Canvas", "Got It", "Use the Agent", "See what is here", "see what is here", "Two words", "Alphabeta"]
    assert one(filters.resource_category, cases) == [
        "feature_name", None, "high_interest", "ui_text", None, None, "high_interest",
    ]


def test_notable_removed(one):
    assert one(filters.notable_removed, ["Photo Studio", "photo studio", "Photo"]) == [True, False, False]


def test_cert_filter(one):
    d = "foo.com"
    cases = {
        "studio.foo.com": True, "cdn.foo.com": False, "7abc.foo.com": False, "ip-10.foo.com": False, "x-a1b2c.foo.com": False,
        "stg42.foo.com": False, "zgqup.foo.com": False, "ab.foo.com": False, "a1b.c2d.e3f.g4h.foo.com": False, "notfoo.com": True,
        "canvas.foo.com": True, "site-deadbeef.foo.com": False, "api.foo.com": True, "v-20240101.foo.com": False,
    }
    assert dict(zip(cases, one(filters.cert_name_ok, [(c, d) for c in cases]))) == cases


def test_asset_filter(one):
    cases = {
        "c.com/img/hero.png": True, "c.com/" + "a" * 40 + ".png": False, "c.com/x/" + "b" * 20: False, "c.com/x/deadbeef.PNG": False,
        "c.com/deadbeef.png": True, "c.com/img/pixel-10.png": True, "c.com/pixel/a.png": False, "c.com/analytics.js": False, "c.com": True,
        "c.com/data:x": False,
    }
    assert dict(zip(cases, one(filters.asset_ok, list(cases)))) == cases


def _cadence(ts: datetime.datetime):
    et = ts.replace(tzinfo=datetime.UTC).astimezone(ZoneInfo("America/New_York"))
    six = et.replace(hour=6, minute=0, second=0, microsecond=0)
    if et.hour >= 20 or et.hour < 6:
        nxt = six + datetime.timedelta(days=1) if et.hour >= 20 else six
        return "overnight", max(60, int((nxt - et).total_seconds()))
    if et.weekday() >= 5:
        return "weekend", max(60, int((six + datetime.timedelta(days=1) - et).total_seconds()))
    return ("market", 900) if 570 <= et.hour * 60 + et.minute < 960 else ("off_hours", 3600)


def test_cadence_over_a_clock_change(spark):
    start = datetime.datetime(2024, 3, 8, 0, 0, 0, 500000)
    times = [start + datetime.timedelta(minutes=13 * i, seconds=i % 60) for i in range(600)]
    times += [datetime.datetime(2024, 11, 2, 20) + datetime.timedelta(minutes=17 * i) for i in range(150)]
    times += [datetime.datetime(2024, 6, 4, 9, 59, 59, 900000), datetime.datetime(2024, 6, 4, 10, 0)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t timestamp_ntz")
    got = {r.i: (r.c.cadence, r.c.next_scan_seconds) for r in df.select("i", cadence.scan_cadence(F.col("t")).alias("c")).collect()}
    assert [(times[i], got[i], _cadence(t)) for i, t in enumerate(times) if got[i] != _cadence(t)] == []
