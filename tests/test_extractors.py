"""Extractors on literal bodies."""

from __future__ import annotations

import base64
import json
import random
import re

from pyspark.sql import functions as F

from snapdrift.functions import html as dom
from snapdrift.functions import text
from snapdrift.operators import feed_extractors as feed
from snapdrift.operators import page_extractors as page

BASE = "https://h.example.com/a/page"


def items(entries):
    return [e["item"] for e in entries]


def test_script_urls(one):
    html = """<!-- <script src="/no.js"></script> --><SCRIPT defer src=/one.js></SCRIPT><script src="https://x.com/gtag/a.js"></script>
    <link href="/c-CHUNK.css" rel="prefetch"><link rel="stylesheet" href="/s.js"><link rel="preload" href="/img.png">
    <script type="module">f("static/Main-1.js?v=2"); g('_next/static/q.js'); h("/deep/x.mjs"); i("plain.js")</script>"""
    got = one(lambda b: page.js_bundle_urls(b, F.lit(BASE)), [html])[0]
    root = "https://h.example.com"
    assert got == sorted(
        [f"{root}/one.js", f"{root}/c-CHUNK.css", f"{root}/a/static/Main-1.js?v=2", f"{root}/_next/static/q.js", f"{root}/deep/x.mjs"]
    )


def _literals(js: str) -> set[str]:
    out = set(re.findall(r'"((?:[^"\\]|\\.){3,})"', js)) | set(re.findall(r"'((?:[^'\\]|\\.){3,})'", js))
    for s in re.findall(r"`((?:[^`\\]|\\.){3,})`", js):
        s = re.sub(r"\$\{[^}]*\}", "...", s).strip()
        if len(s) >= 3:
            out.add(s)
    return out


def test_quoted_strings_equal_python(one):
    scripts = [
        'a("one two");b(\'three "four" five\');c(`six ${x} seven`);d("e\\"f g")',
        'x("");y("ab");z("long enough")',
        'var s="line\\\nbroken";t="ok then"',
        "`${a}`;`  x  `;`abc`",
        'unclosed "quote here',
        'tab\\ "a\\\\" "b\\\\c d"',
    ]
    got = one(page.quoted_strings, scripts)
    assert [set(g) for g in got] == [_literals(s) for s in scripts]


def test_quoted_strings_of_any_length(one):
    plain, escaped = "x" * 300_000, '\\"' * 100_000
    assert one(page.quoted_strings, [f'f("{plain}");', f'g("{escaped}");']) == [[plain], [escaped]]


def test_visible_lines(one):
    html = """<html><head><title> T </title><style>p{}</style></head><body><header><p>gone</p></header><nav>gone</nav>
    <p>a <b>b</b>\n c</p><!-- gone <p>x</p> --><script>var t="</p>gone";</script><footer>gone</footer>1 &lt; 2 &#169;</body>"""
    assert one(page.visible_text_lines, [html, "", "<p></p>"]) == [["T", "a", "b", "c", "1 < 2 ©"], [], []]


def test_selected_text(one):
    html = '<div class="x ad"> one <i>two</i></div><p id="k">three<script>no</script><br>four</p><DIV>five<div>six</div></DIV>'
    cases = [(html, ".ad"), (html, "#k"), (html, "div"), (html, "h1"), (None, "p")]
    assert one(page.selected_text, cases) == [["onetwo"], ["threefour"], ["onetwo", "fivesix", "six"], [], []]


def test_job_titles_on_a_page(one):
    html = "<div><a>Senior Engineer, Maps and Routes</a><a>Engineer</a><h2>Principal Chef of the whole kitchen</h2></div>" + "<span>x</span>" * 9
    got = one(page.job_titles_page, [html])[0]
    assert "Senior Engineer, Maps and Routes" in got and "Engineer" not in got and all("engineer" in g.lower() for g in got)


def test_filing_rows(one):
    html = (
        "<table><tr><th>a</th></tr><tr><td>abc1</td><td>2</td><td>3</td></tr><tr><td> ABC1 </td><td><b>b</b> c</td><td>3</td><td>4</td></tr>"
        "<tr><td>x</td><td>2</td><td>3</td><td>4</td></tr><tr class=z><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td><td>6</td><td>7</td></tr></table>"
    )
    assert one(lambda b: page.filing_rows(b, F.lit("abc")), [html])[0] == ["ABC1 | bc | 3 | 4", "1 | 2 | 3 | 4 | 5 | 6 | 7"]
    many = "".join(f"<tr>{'<td>' + 'y' * 90 + '</td>'}{f'<td>{i}</td>' * 5}</tr>" for i in range(30))
    got = one(lambda b: page.filing_rows(b, F.lit("abc")), [many])[0]
    assert len(got) == 30 and got[0].endswith("| 0")


def test_trademarks(one):
    serials = "<p>12345678 - ALPHA ONE;</p><p>x 87654321-B.2;</p><p>11111111 - Q;</p>"
    labels = "<p>Word Mark: FIRST MARK;</p><p>Mark  AB;</p><p>Mark: SECOND;</p>"
    got = one(page.trademark_marks, [serials, labels, "none"])
    pairs = [[(e["detail"]["serial"], e["detail"]["mark"]) for e in g] for g in got]
    assert pairs == [
        [("12345678", "ALPHA ONE"), ("87654321", "B.2")],
        [("0", "FIRST MARK"), ("2", "SECOND")],
        [],
    ]


def test_robots(one):
    body = "User-agent: *\r\nDisallow: /a \r\ndisallow: /no\nAllow:/b\nDisallow:\nDisallow: /\nAllow: *\n Sitemap: https://s/x.xml\nDisallow: /a"
    assert one(page.robots_directives, [body])[0] == ["/a", "/b", "SITEMAP: https://s/x.xml"]


def test_assets(one):
    html = (
        '<img src="/i.png?v=1"><img data-src="//cdn.x.com/l.png"><video src=v.mp4#t></video><source srcset="no"><script>"<img src=/no.png>"</script>'
        '<link rel="preload" href="/p.css"><link rel="dns-prefetch" href="/no"><link rel="PREFETCH stylesheet" href="q.js"><img src="">'
    )
    cases = [(html, []), (html, ["cdn.x.com"])]
    want = ["h.example.com/i.png", "cdn.x.com/l.png", "h.example.com/a/v.mp4", "h.example.com/p.css", "h.example.com/a/q.js"]
    got = one(lambda b, d: page.page_assets(b, F.lit(BASE), d), cases)
    assert got == [want, [w for w in want if w not in ("h.example.com/i.png", "h.example.com/a/v.mp4")]]


def test_sitemap_parts(one):
    xml = """<?xml version="1.0"?><urlset xmlns="http://x"><url>\n<loc> https://a/1?x=1&amp;y=2 </loc><image:loc>no</image:loc></url>
    <url><lastmod>x</lastmod></url><!-- <url><loc>no</loc></url> --><url><loc><![CDATA[https://a/2]]></loc></url><url><loc>https://a/2</loc></url></urlset>"""
    index = "<sitemapindex><sitemap><loc>https://a/s1.xml</loc></sitemap></sitemapindex>"
    assert one(page.page_locations, [xml, index, "broken <url><loc>"]) == [["https://a/1?x=1&y=2", "https://a/2"], [], []]
    assert one(page.child_sitemaps, [xml, index]) == [[], ["https://a/s1.xml"]]


def test_releases_and_pulls(one):
    body = json.dumps([{"id": 7, "tag_name": "v7", "name": None, "body": None, "html_url": "u"}, {"id": 6}])
    got = one(feed.latest_release, [body, "[]", "not json", "{}"])
    assert (got[0]["state"], got[0]["version"], got[0]["notes"]) == ("7", "v7", "") and got[1:] == [None, None, None]
    prs = json.dumps([{"id": i, "title": f"t{i}", "number": i} for i in range(300)])
    assert items(one(feed.pull_requests, [prs])[0]) == [str(i) for i in range(300)]
    assert one(feed.pull_requests, ['{"message": "rate limit"}', "[1, null]"]) == [[], None]


def test_apps(one):
    body = json.dumps({"results": [{"trackId": 5, "version": "1", "fileSizeBytes": "123456789"}, {"trackId": 6}]})
    got = one(feed.ios_app_records, [body])[0]
    assert [g["app_id"] for g in got] == ["5", "6"] and [g["record"]["detail"]["size"] for g in got] == ["123.5", "0.0"]
    record = one(feed.android_app_version, [json.dumps({"version": "2", "recentChanges": " fix \n"})])[0]
    assert (record["version"], record["notes"], len(record["state"])) == ("2", "fix", 16)


def test_flags(one):
    text = '{"flag-a": 1, "Flag-B": 2, "x": 3, "é-x": 4, "ok-2": "flag-a"}'
    encoded = base64.b64encode(text.encode()).decode()
    wrapped = "\n".join(encoded[i : i + 20] for i in range(0, len(encoded), 20))
    assert one(feed.flag_names, [encoded, wrapped, '"plain-text!!"'])[:2] == [["flag-a", "ok-2"]] * 2
    assert one(feed.flag_names, ['["raw-flag"] #'])[0] in (["raw-flag"], [])


def test_bad_bytes_are_replaced(one):
    encoded = base64.b64encode(b'\xff\xfe "flag-z" \xff').decode()
    assert one(feed.flag_names, [encoded])[0] == ["flag-z"]


def test_certificates(one):
    certs = [{"common_name": "A.Foo.com", "name_value": "b.foo.com\n*.foo.com\n\n notfoo.com \nx.org"}, {"common_name": None, "name_value": None}]
    assert one(lambda b: feed.certificate_names(b, F.lit("FOO.com")), [json.dumps(certs)])[0] == ["a.foo.com", "b.foo.com", "notfoo.com"]
    many = json.dumps([{"common_name": f"n{i}.foo.com", "name_value": ""} for i in range(250)])
    assert len(one(lambda b: feed.certificate_names(b, F.lit("foo.com")), [many])[0]) == 250


def test_atom_filings(one):
    e = '<entry><title type="x"> 8-K &amp; A </title><updated>2024-01-02T0</updated><link rel="a" href="u?a=1&amp;b=2"/><summary>s</summary></entry>'
    bare, untitled = "<entry><title>only</title></entry>", "<entry><updated>x</updated></entry>"
    got = one(feed.atom_filings, [f"<feed>{e}{untitled}{bare}{e * 5}</feed>"])[0]
    assert [g["detail"]["title"] for g in got] == ["8-K & A", "only"] + ["8-K & A"] * 5
    assert got[0]["detail"]["link"] == "u?a=1&b=2" and got[1]["detail"]["summary"] == ""


def test_packages(one):
    npm = one(feed.npm_version, [json.dumps({"version": "1", "description": "d", "dependencies": {"b": "1", "a": "2"}}), '{"version":"2"}'])
    assert [n["detail"]["deps"] for n in npm] == ["b, a", "None"] and npm[0]["notes"] == "d" and npm[1]["notes"] == ""
    assert one(feed.pypi_version, ['{"info": {"version": "3", "summary": null}}'])[0]["version"] == "3"


def test_job_boards(one):
    a = json.dumps({"jobs": [{"title": "T", "location": {"name": "L"}, "departments": [{"name": "D"}, {"name": "E"}]}, {"title": "U", "location": None}]})
    b = json.dumps([{"text": "T", "categories": {"team": "X", "location": None}}, {"text": "U"}])
    assert one(feed.job_titles_board_a, [a])[0] == ["T | D | L", "U |  | "]
    assert one(feed.job_titles_board_b, [b])[0] == ["T | X | ", "U |  | "]


def test_dns(one):
    body = json.dumps({"Answer": [{"data": "v" * 300}, {"data": "x"}]})
    assert one(lambda b: feed.dns_records(b, F.lit("MX")), [body, '{"Status": 3}']) == [["MX:" + "v" * 300, "MX:x"], None]


def test_papers(one):
    authors = "".join(f"<author><name>N{i}</name></author>" for i in range(7))
    xml = f"<feed><title>no</title><entry><id>i</id><title>A\n B</title>{authors}<published>2024-01-02T00</published><summary> s </summary></entry></feed>"
    got = one(feed.arxiv_papers, [xml])[0]
    assert got[0]["item"] == "A\n B" and got[0]["detail"]["authors"] == "N0, N1, N2, N3, N4, N5, N6" and got[0]["detail"]["date"] == "2024-01-02"


def test_graphql(one):
    schema = {"types": [{"name": "T", "fields": [{"name": "f"}]}, {"name": "__X", "fields": [{"name": "g"}]}, {"name": "U", "fields": None}]}
    bodies = [json.dumps({"data": {"__schema": {**schema, "mutationType": mt}}}) for mt in ({"fields": [{"name": "m"}]}, None)]
    assert one(feed.graphql_schema_items, [*bodies, "x"]) == [["type:T", "field:T.f", "type:U", "mutation:m"], ["type:T", "field:T.f", "type:U"], []]


def test_model_lists(one):
    assert one(feed.registry_models, ['{"data":[{"id":"a","x":{"id":"no"}},"loose",{"id":"b"}]}', '{"models":[{"name":"m"}]}', "[]"]) == [["a", "b"], ["m"], []]
    repos = json.dumps([{"full_name": f"o/{i}", "description": None, "stargazers_count": 1} for i in range(40)] + [{"full_name": ""}])
    assert len(one(feed.org_repos, [repos])[0]) == 40
    models = one(feed.hub_models, [json.dumps([{"modelId": "a", "pipeline_tag": None}, {"modelId": ""}])])[0]
    assert items(models) == ["a"] and models[0]["detail"]["pipeline"] == ""


def test_references_of_any_kind(one):
    """Hostile and old references never end a job."""
    texts = ["&#9999999;", "&#0;", "&#xD800;", "&#99999999999999999999;x", "&#128; &#x93;", "&check; &caf", "caf&eacute x", "&nosuch; &amp", "a&&#38;&#38b", "&#;&#x;&;"]
    assert one(text.decode_entities, texts) == [
        "\ufffd", "\ufffd", "\ufffd", "\ufffdx", "\u20ac \u201c", "\u2713 &caf", "caf\u00e9 x", "&nosuch; &", "a&&&b", "&#;&#x;&;"
    ]


def test_bad_size_and_missing_key(one):
    body = json.dumps({"results": [{"trackId": 1, "version": "1", "fileSizeBytes": "n/a"}, {"version": "2"}]})
    got = one(feed.ios_app_records, [body])[0]
    assert [(r["app_id"], r["record"]["detail"]["size"]) for r in got] == [("1", "0.0")]


def test_prefixed_sitemap(one):
    xml = '<s:urlset xmlns:s="x"><s:url><s:loc>https://a/1</s:loc></s:url></s:urlset>'
    assert one(page.page_locations, [xml])[0] == ["https://a/1"]


HOSTILE = [
    '<p title="a > b">text</p>', "<script>var a=1;", "x<nav>a<nav>b</nav>c</nav>d", "<div><nav>a</div>b", "<br/>x<p/>y<nav/>z",
    "a < b <3 c", "<a href='x>y' b=1>t</a>", "<!-- a > b -->z<!doctype html>q", "<style>p{}</STYLE >w", "1 &lt; 2 &#169; &nbsp;",
    "<ul><li>a<li>b</ul>c</nav>d", "<header><p>no</header>yes</p>", "<NAV>no</NAV>yes", "<script>'</p>'</script>k<p", "</p>x</ p>y",
    "<p a=1 b='2' c>v</p><footer class=\"x>y\">no</footer>w", "<div><header>n<footer>m</header>o</footer>p</div>", "",
]


class Plain:
    """Visible lines by the standard library's parser: a text counts if no open element hides it."""

    def __init__(self):
        from html.parser import HTMLParser

        outer = self

        class Walk(HTMLParser):
            def handle_starttag(self, tag, attrs):
                if tag not in ("br", "img", "link", "hr", "input", "meta"):
                    outer.open.append(tag)

            def handle_startendtag(self, tag, attrs):
                outer.texts.append("\n")

            def handle_endtag(self, tag):
                if tag in outer.open:
                    while outer.open.pop() != tag:
                        pass

            def handle_data(self, data):
                if not set(outer.open) & {"script", "style", "nav", "footer", "header"}:
                    outer.texts.append(data)

            def unknown(self, *_):
                outer.texts.append("\n")

        self.open, self.texts, self.walk = [], [], Walk(convert_charrefs=True)

    def lines(self, html):
        from html.parser import HTMLParser

        outer, walk = self, self.walk
        for name in ("handle_starttag", "handle_endtag"):
            inner = getattr(type(walk), name)

            def run(*args, inner=inner):
                outer.texts.append("\n")
                return inner(walk, *args)

            setattr(walk, name, run)
        walk.handle_comment = walk.handle_decl = lambda *_: outer.texts.append("\n")
        assert isinstance(walk, HTMLParser)
        walk.feed(html)
        walk.close()
        return [s for line in "".join(self.texts).split("\n") if (s := line.strip())]


def test_visible_lines_of_hostile_pages(one):
    got = one(page.visible_text_lines, HOSTILE)
    assert got == [Plain().lines(h) if not h.endswith("k<p") else ["k"] for h in HOSTILE]
    assert got[0] == ["text"] and got[1] == [] and got[2] == ["x", "d"] and got[5] == ["a < b <3 c"]


def test_pages_of_random_markup(one):
    import random

    rng, parts = random.Random(4), [
        "<div>", "</div>", "<nav>", "</nav>", "<p class='a>b'>", "</p>", "<header id=x>", "</header>", "<br>", "one", " two ", "&amp;", "\n",
        "<!-- c -->", "<footer>", "</footer>", "<b>", "</b>", "<script>if (a < b) '<nav>'</script>", "<style>x</style>", "<img src='>'>", " < ",
    ]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    assert one(page.visible_text_lines, pages) == [Plain().lines(h) for h in pages]


def test_selectors(one):
    html = (
        '<div class="x ad" id=k><p>one <i>two</i></p><p data-x="q 1">three</p></div><ul><li>a</li><li>b</li><li>c</li></ul>'
        "<div><p>four</p></div><script>no</script>"
    )
    want = {
        "div p": ["onetwo", "three", "four"], "div > p": ["onetwo", "three", "four"], ".ad.x > p": ["onetwo", "three"], "p + p": ["three"],
        "p ~ p": ["three"], "#k i": ["two"], "div#k.ad p[data-x]": ["three"], "[data-x^=q]": ["three"], "[data-x~='1']": ["three"],
        "[data-x$='2']": [], "li:nth-child(odd)": ["a", "c"], "li:first-child, li:last-child": ["a", "c"], "p:not([data-x])": ["onetwo", "four"],
        "ul>li:nth-child(2)": ["b"], "DIV P": ["onetwo", "three", "four"], "div[": [], "> p": [], "p >": [], "": [], "script": ["no"], "ul li + li": ["b", "c"],
    }
    assert one(page.selected_text, [(html, s) for s in want]) == list(want.values())


def test_hostile_pages_elsewhere(one):
    html = '<img alt="a > b" src="/i.png"><script data-x="1 > 0" src="/one.js"></script><!-- <img src="/no.png"> --><link title=">" rel=preload href="/p.js">'
    assert one(lambda b: page.page_assets(b, F.lit(BASE), F.array().cast("array<string>")), [html]) == [["h.example.com/i.png", "h.example.com/p.js"]]
    assert one(lambda b: page.js_bundle_urls(b, F.lit(BASE)), [html]) == [["https://h.example.com/one.js", "https://h.example.com/p.js"]]
    rows = '<table><tr title="x > y"><td a=">">ABC1<td>2</td><td>3</td><td>4<table><tr><td>5</td></tr></table></td></tr></table>'
    assert one(lambda b: page.filing_rows(b, F.lit("abc")), [rows])[0][0].startswith("ABC1")
    assert one(page.trademark_marks, ['<p title=">">12345678 - ALPHA ONE;</p><script>87654321 - NO;'])[0][0]["item"] == "12345678\tALPHA ONE"


def test_feeds_are_read_as_xml(one):
    prefixed = '<a:feed xmlns:a="x"><a:entry><a:title>p</a:title><a:link href="l"/><a:author><a:name>N</a:name></a:author></a:entry></a:feed>'
    comment = "<feed><!-- <entry><title>no</title></entry> --><entry><title><![CDATA[c & d]]></title><summary/></entry></feed>"
    broken = ["<feed><entry><title>broken</entry></feed>", "not xml", "", "<feed/>"]
    stray = "<feed><entry><title>x & y &nbsp;</title></entry></feed>"
    got = one(feed.atom_filings, [prefixed, comment, stray, *broken])
    assert [[e["detail"]["title"] for e in g or []] for g in got] == [["p"], ["c & d"], ["x & y &nbsp;"], [], [], [], []]
    assert got[0][0]["detail"]["link"] == "l"
    papers = one(feed.arxiv_papers, [prefixed, comment])
    assert papers[0][0]["detail"]["authors"] == "N" and papers[1][0]["item"] == "c & d" and papers[1][0]["detail"]["authors"] == ""


def test_all_dependencies_are_kept(one):
    names = {f"d{i}": "1" for i in range(25)}
    got = one(feed.npm_version, [json.dumps({"version": "1", "dependencies": names})])[0]["detail"]
    assert got["deps"] == ", ".join(names) and got["shown_deps"] == ", ".join(list(names)[:10])


FRAGMENTS = [
    "<script", "</script", "<SCRIPT", "</ScRiPt", "<style", "</style", "<link", "<lin\u212a", "</\u017fcript", "</scr\u0131pt", "<!--", "-->", "--!>", "<![CDATA[", "]]>",
    "<!doctype", "</ ", ">", "/>", "/", " ", "\n", "=", '"', "'", 'src="/a.js"', "src=c.js", " src", "SRC=x/", ' rel="preload"', ' href="/x&amp;y.js"', "text", "<", "<a",
    "<template>", "</template>", "<script>", "</script>", '<script src="/b.js"></script>', "<script/>", "<script src='a'/>", "x<b>",
]


def test_scripts_and_links_are_those_of_the_tree(monkeypatch):
    rng = random.Random(11)
    pages = ["".join(rng.choices(FRAGMENTS, k=rng.randrange(1, 25))) for _ in range(20_000)]
    trees = [dom.Page(h) for h in pages]
    want = [([(e.attrs, "".join(p.pieces(e))) for e in p.named("script")], [e.attrs for e in p.named("link")]) for p in trees]
    assert [h for h, w in zip(pages, want) if dom.scripts_and_links(h) != w] == []
    monkeypatch.setattr(dom, "Page", None)  # a common page needs no tree
    assert dom.scripts_and_links("<p>x</p><!-- <script> --><script async src='a.js'></script><script>1<2</script><link rel=preload href=b.js>") == (
        [({"async": "", "src": "a.js"}, ""), ({}, "1<2")], [{"rel": "preload", "href": "b.js"}],
    )
