"""The monitors, one declarative spec each.

Titles, headings, caps and colours are fixed values of the reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdrift.functions import filters as flt
from snapdrift.functions import text as t
from snapdrift.operators import feed_extractors as feed
from snapdrift.operators import page_extractors as page
from snapdrift.operators.diff import explode_items
from snapdrift.operators.report import Section
from snapdrift.operators.scans import first_role, pick_by_configuration, usable_captures
from snapdrift.operators.watch import (
    bundle_items,
    landed_resources,
    resolved_subdomains,
    resource_items,
    sitemap_urls,
)
from snapdrift.plans.detect import Alert, ItemMonitor, VersionMonitor, fields, phrase
from snapdrift.schema import SCAN



def _everything(item: Column, detail: Column, target: Column) -> Column:
    return F.lit("all")


def _line(template: str, clip: int | None = None):
    """A line wording with the item as ``{x}``."""
    return lambda item, detail: phrase(template, x=item if clip is None else t.clip(item, clip))


def _one(cap: int | None, line) -> tuple[Section, ...]:
    return (Section("all", cap, line),)


# --- scripts -----------------------------------------------------------------


def script_strings(body: Column) -> Column:
    """Quoted literals that pass the noise filter and have a category."""
    found = F.array_distinct(F.transform(page.quoted_strings(body), t.strip))
    return F.filter(found, lambda s: flt.script_noise_ok(s) & flt.script_kept(s))


def _script_items(captures: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    bundles, scans = bundle_items(captures, targets, script_strings(F.col("body")))
    return bundles.select(*SCAN, F.explode("entries").alias("item")), scans


def script_bucket(item: Column, detail: Column, target: Column) -> Column:
    """R2: a keyword beats the category; uncategorised text is only counted."""
    reported = F.create_map(*[F.lit(c) for c in ("high_interest", "feature_name", "ui_text") for _ in range(2)])
    keyword = t.keyword_hit(item, target["keyword_regex"], if_none=False)
    return F.when(keyword, "keyword").otherwise(F.try_element_at(reported, flt.script_category(item)))


JS_DEEP = ItemMonitor(
    monitor="js_deep",
    searches=True,
    collect=_script_items,
    alerts=(
        Alert(
            op="added",
            bucket=script_bucket,
            sections=(
                Section("keyword", 10, _line("* `{x}`", 120), "**Keyword Matches:**\n"),
                Section("high_interest", 10, _line("* `{x}`", 120), "**High Interest:**\n"),
                Section("feature_name", 15, _line("* `{x}`", 120), "**Feature Names:**\n"),
                Section("ui_text", 15, _line("* `{x}`", 120), "**New UI Text:**\n"),
            ),
            joiner="\n\n",
            title="Unreleased Features: {name}",
            head="**{n} new strings detected** in JS bundles ({n_added} total new)",
            color=0x00FF88,
            detection_type="new_strings",
            log_title="{n} interesting strings",
        ),
        Alert(
            op="removed",
            bucket=lambda item, detail, target: F.when(flt.notable_removed(item), "all"),
            sections=_one(10, _line("* ~~`{x}`~~", 100)),
            title="Removed Strings: {name}",
            head="**{n} notable strings removed** (feature launched, killed, or renamed?)",
            color=0xFFA500,
            below=200,
        ),
    ),
)

# --- pages -------------------------------------------------------------------


def _text_lines() -> Column:
    """Lines of the selected elements, or of the visible text."""
    selector = F.col("target.attrs")["selector"]
    chosen = F.array_join(page.selected_text(F.col("body"), F.coalesce(selector, F.lit("body"))), "\n")
    return _distinct_lines(F.when(selector.isNotNull(), chosen).otherwise(page.visible_text(F.col("body"))))


def _distinct_lines(text: Column) -> Column:
    # an empty text is one empty line, as in a line diff of two texts
    return feed.plain(F.array_distinct(F.split(text, "\n")))


DOCS = ItemMonitor(
    monitor="docs",
    searches=True,
    entries=lambda: _distinct_lines(page.visible_text(F.col("body"))),
    guarded=False,
    alerts=(
        Alert(
            op="added",
            bucket=lambda item, detail, target: F.when(
                flt.doc_signal(item, t.keyword_hit(item, target["keyword_regex"], if_none=False)), "all"
            ),
            sections=_one(10, _line("+ {x}", 150)),
            title="Doc Change: {name}",
            head="**{n_added} lines added, {n_removed} removed**",
            fence=True,
            color=0x3498DB,
            detection_type="doc_change",
            log_title="Changes in {name}",
        ),
    ),
)

PAGE_CHANGE = ItemMonitor(
    monitor="page_change",
    targeted=True,
    entries=_text_lines,
    guarded=False,
    alerts=(
        Alert(
            op="added",
            bucket=_everything,
            sections=_one(8, _line("+ {x}", 120)),
            title="Page Updated: {name}",
            head="**{n_added} new lines detected**",
            fence=True,
            color=0x607D8B,
            detection_type="page_update",
            log_title="Updated: {name}",
        ),
    ),
)

SITEMAP = ItemMonitor(
    monitor="sitemap",
    searches=True,
    collect=sitemap_urls,
    guarded=False,
    alerts=(
        Alert(
            op="added",
            bucket=lambda item, detail, target: F.when(t.matches_any(item, target["patterns"]), "all"),
            sections=_one(15, _line("• {x}")),
            title="New Pages: {name}",
            head="**{n} new pages** found in sitemap",
            color=0x9B59B6,
            detection_type="new_pages",
            log_title="{n} new pages",
        ),
    ),
)

ROBOTS_TXT = ItemMonitor(
    monitor="robots_txt",
    entries=lambda: feed.plain(page.robots_directives(F.col("body"))),
    alerts=(
        Alert(
            op="added",
            bucket=_everything,
            sections=_one(15, _line("+ `{x}`")),
            title="robots.txt Changed: {name}",
            head="**{n} new path(s)** added",
            fence=True,
            color=0x795548,
            url="https://{domain}/robots.txt",
            detection_type="new_paths",
            log_title="{n} paths",
        ),
        Alert(
            op="removed",
            bucket=_everything,
            sections=_one(15, _line("- `{x}`")),
            title="robots.txt Removed: {name}",
            head="**{n} path(s) removed** (may be going live)",
            fence=True,
            color=0xFF9800,
            url="https://{domain}/robots.txt",
        ),
    ),
)

CDN_ASSETS = ItemMonitor(
    monitor="cdn_assets",
    targeted=True,
    entries=lambda: feed.plain(
        page.page_assets(
            F.col("body"), F.col("target.url"), F.split(F.col("target.attrs")["cdn_domains"], ",")
        )
    ),
    alerts=(
        Alert(
            op="added",
            bucket=lambda item, detail, target: F.when(flt.asset_ok(item), "all"),
            sections=_one(12, _line("* `{x}`", 120)),
            title="New CDN Assets: {name} ({ticker})",
            head="**{n} new assets** detected",
            color=0x009688,
            below=50,
            detection_type="new_assets",
            log_title="{n} assets",
        ),
    ),
)

# --- filings, marks, certificates, names ---------------------------------------

FCC = ItemMonitor(
    monitor="fcc",
    entries=lambda: feed.plain(page.filing_rows(F.col("body"), F.col("target_id"))),
    mode="list",
    order="pos",
    alerts=(
        Alert(
            op="added",
            bucket=_everything,
            sections=_one(8, _line("* {x}", 150)),
            title="FCC Filing: {name}",
            head="**{n} new device filing(s)** detected",
            color=0xFF5722,
            fields=lambda: fields(("Grantee Code", F.col("target_id"), True), ("Company", F.col("target.name"), True)),
            detection_type="new_filing",
            log_title="FCC: {name}",
        ),
    ),
)

TRADEMARK = ItemMonitor(
    monitor="trademark",
    entries=lambda: page.trademark_marks(F.col("body")),
    choose=lambda rows, targets: first_role(rows, ("primary", "fallback")),
    mode="list",
    order="pos",
    detailed=True,
    alerts=(
        Alert(
            op="added",
            bucket=_everything,
            sections=_one(10, lambda i, d: phrase("* **{m}** (SN: {s})", m=d["mark"], s=d["serial"])),
            title="New Trademark: {target_id} ({ticker})",
            head="**{n} new trademark filing(s)**",
            color=0x9C27B0,
            url="https://tmsearch.uspto.gov/",
            detection_type="new_trademark",
            log_title="{n} marks",
        ),
    ),
)

CT_LOGS = ItemMonitor(
    monitor="ct_logs",
    targeted=True,
    entries=lambda: feed.plain(feed.certificate_names(F.col("body"), F.col("target.domain"))),
    strict=True,
    alerts=(
        Alert(
            op="added",
            bucket=lambda item, detail, target: F.when(flt.cert_name_ok(item, target["domain"]), "all"),
            sections=_one(15, _line("* `{x}`")),
            title="New SSL Certs: {name}",
            head="**{n} new certificate(s)** found in CT logs",
            color=0x00BCD4,
            url="https://crt.sh/?q=%25.{domain}",
            detection_type="new_cert",
            log_title="{n} certs",
        ),
    ),
)

SUBDOMAINS = ItemMonitor(
    monitor="subdomains",
    collect=resolved_subdomains,
    guarded=False,
    alerts=(
        Alert(
            op="added",
            bucket=_everything,
            sections=_one(None, _line("• `{x}`")),
            title="New Subdomains: {name}",
            head="**{n} new subdomains** discovered",
            color=0xE91E63,
            url="https://{domain}",
            detection_type="new_subdomain",
            log_title="{n} new",
        ),
    ),
)

DNS_RECORDS = ItemMonitor(
    monitor="dns_records",
    collect=lambda captures, targets: (
        explode_items(
            usable_captures(captures, strict=True), feed.plain(feed.dns_records(F.col("body"), F.col("role")))
        ),
        captures,
    ),
    alerts=(
        Alert(
            op="added",
            bucket=_everything,
            sections=_one(10, _line("* `{x}`", 120)),
            title="DNS Record Change: {name} ({ticker})",
            head="**{n} new DNS record(s)**",
            color=0x795548,
            url="https://dns.google/query?name={domain}",
            detection_type="new_record",
            log_title="{n} records",
        ),
    ),
)

SEC_8K = ItemMonitor(
    monitor="sec_8k",
    entries=lambda: feed.atom_filings(F.col("body")),
    mode="current",
    order="pos",
    detailed=True,
    strict=True,
    alerts=(
        Alert(
            op="added",
            bucket=_everything,
            sections=_one(
                5,
                lambda i, d: phrase(
                    "* **{title}**\n  {date} | [Link]({link})",
                    title=t.clip(d["title"], 100),
                    date=t.clip(d["date"], 10),
                    link=d["link"],
                ),
            ),
            title="SEC 8-K Filing: {target_id}",
            head="**New material event filing**",
            color=0xF44336,
            detection_type="8k_filing",
            log_title="8-K: {target_id}",
        ),
    ),
)

# --- feeds -------------------------------------------------------------------

GITHUB_PRS = ItemMonitor(
    monitor="github_prs",
    searches=True,
    entries=lambda: feed.pull_requests(F.col("body")),
    mode="list",
    order="pos",
    detailed=True,
    strict=True,
    alerts=(
        Alert(
            op="added",
            bucket=lambda item, detail, target: F.when(
                t.keyword_hit(detail["title"], target["keyword_regex"], if_none=True), "all"
            ),
            sections=_one(
                10, lambda i, d: phrase("• **{title}** (#{number})", title=t.clip(d["title"], 80), number=d["number"])
            ),
            title="New PRs: {name}",
            head="**{n} interesting PRs**",
            color=0xE67E22,
            url="https://github.com/{target_id}/pulls",
        ),
    ),
)

CHROME_FLAGS = ItemMonitor(
    monitor="chrome_flags",
    entries=lambda: feed.plain(feed.flag_names(F.col("body"))),
    choose=lambda rows, targets: first_role(rows, ("primary", "fallback")),
    guarded=False,
    alerts=(
        Alert(
            op="added",
            bucket=_everything,
            sections=_one(20, _line("• `{x}`")),
            title="New Chrome Flags",
            head="**{n} new experimental flags** detected",
            color=0xFFC107,
            url="https://chromestatus.com/features",
            detection_type="new_flags",
            log_title="{n} flags",
        ),
    ),
)


# a target is read from the first source it is configured for
JOB_SOURCES = ("board_a", "board_b", "careers_page")


def _job_titles() -> Column:
    body, role = F.col("body"), F.col("role")
    titles = (
        F.when(role == "board_a", feed.job_titles_board_a(body))
        .when(role == "board_b", feed.job_titles_board_b(body))
        .otherwise(page.job_titles_page(F.when(role == "careers_page", body)))
    )
    return feed.plain(F.array_distinct(titles))


JOBS = ItemMonitor(
    monitor="jobs",
    searches=True,
    entries=_job_titles,
    choose=lambda rows, targets: pick_by_configuration(rows, targets, JOB_SOURCES),
    order="pos",
    alerts=(
        Alert(
            op="added",
            bucket=lambda item, detail, target: F.when(
                t.keyword_hit(item, target["keyword_regex"], if_none=True), "all"
            ),
            sections=_one(15, _line("* {x}", 120)),
            title="New Job Postings: {name} ({ticker})",
            head="**{n} interesting new roles**",
            color=0x00BCD4,
            detection_type="new_postings",
            log_title="{n} new roles",
        ),
    ),
)

ARXIV = ItemMonitor(
    monitor="arxiv",
    entries=lambda: feed.arxiv_papers(F.col("body")),
    mode="list",
    order="pos",
    detailed=True,
    strict=True,
    alerts=(
        Alert(
            op="added",
            bucket=_everything,
            sections=_one(
                8,
                lambda i, d: phrase(
                    "* **{title}**\n  {authors} | {date}",
                    title=t.clip(i, 100),
                    authors=t.clip(d["authors"], 80),
                    date=d["date"],
                ),
            ),
            title="New Papers: {name} ({ticker})",
            head="**{n} new paper(s)** on arXiv",
            color=0xB71C1C,
            first_link="link",
            detection_type="new_paper",
            log_title="{n} papers",
        ),
    ),
)


def _schema_section(kind: str, cap: int, label: str) -> Section:
    return Section(kind, cap, lambda i, d: flt.schema_name(i), f"**{label}:** ", ", ")


GRAPHQL = ItemMonitor(
    monitor="graphql",
    entries=lambda: feed.plain(feed.graphql_schema_items(F.col("body"))),
    strict=True,
    alerts=(
        Alert(
            op="added",
            bucket=lambda item, detail, target: flt.schema_kind(item),
            sections=(
                _schema_section("type", 10, "New Types"),
                _schema_section("mutation", 10, "New Mutations"),
                _schema_section("field", 15, "New Fields"),
            ),
            title="GraphQL Schema Change: {name} ({ticker})",
            head="**{n_added} new schema items**",
            color=0xE535AB,
            detection_type="schema_change",
            log_title="{n_added} items",
        ),
    ),
)

GITHUB_ORG = ItemMonitor(
    monitor="github_org",
    entries=lambda: feed.org_repos(F.col("body")),
    detailed=True,
    order="item",
    strict=True,
    alerts=(
        Alert(
            op="added",
            bucket=_everything,
            sections=_one(
                10,
                lambda i, d: phrase(
                    "* **[{x}]({url})**{desc}",
                    x=i,
                    url=d["url"],
                    desc=F.when(d["desc"] != "", F.concat(F.lit(" — "), d["desc"])),
                ),
            ),
            title="New GitHub Repos: {name}",
            head="**{n} new public repo(s)** created",
            color=0x6E5494,
            url="https://github.com/{org}?tab=repositories&sort=created",
            detection_type="new_repo",
            log_title="{n} repos",
        ),
    ),
)

HUGGINGFACE = ItemMonitor(
    monitor="huggingface",
    entries=lambda: feed.hub_models(F.col("body")),
    detailed=True,
    strict=True,
    alerts=(
        Alert(
            op="added",
            bucket=_everything,
            sections=_one(
                10,
                lambda i, d: phrase(
                    "* **[{x}](https://huggingface.co/{x})**{tag}",
                    x=i,
                    tag=F.when(d["pipeline"] != "", F.concat(F.lit(" ("), d["pipeline"], F.lit(")"))),
                ),
            ),
            title="New HF Models: {name}",
            head="**{n} new model(s)** published",
            color=0xFFD21E,
            url="https://huggingface.co/{org}",
            detection_type="new_model",
            log_title="{n} models",
        ),
    ),
)

MODEL_REGISTRY = ItemMonitor(
    monitor="model_registry",
    entries=lambda: feed.plain(feed.registry_models(F.col("body"))),
    strict=True,
    alerts=(
        Alert(
            op="added",
            bucket=_everything,
            sections=_one(20, _line("* `{x}`")),
            title="🆕 New Models: {name} ({ticker})",
            head="**{n} new model(s)** appeared in API",
            color=0x9C27B0,
            detection_type="new_model",
            log_title="{n} models",
        ),
        Alert(
            op="removed",
            bucket=_everything,
            sections=_one(10, _line("* ~~`{x}`~~")),
            title="❌ Models Removed: {name} ({ticker})",
            head="**{n} model(s) delisted**",
            color=0xFF5722,
        ),
    ),
)

# --- versions ----------------------------------------------------------------

GITHUB_RELEASE = VersionMonitor(
    monitor="github_release",
    record=lambda: feed.latest_release(F.col("body")),
    title="New Release: {name}",
    text="**{version}** — {release_name}\n\n{notes}",
    color=0x2ECC71,
    url="{page}",
    detection_type="release",
    log_title="{version}",
)


def _app_store_records(captures: DataFrame, targets: DataFrame) -> DataFrame:
    """One batch reply serves every target; the last record of an app wins.

    A reply belongs to the ``batch`` it was asked for, which its targets name.
    """
    rows = captures.select("monitor", "target_id", "scan_id", F.posexplode(feed.ios_app_records(F.col("body"))))
    apps = rows.select("monitor", F.col("target_id").alias("batch"), "scan_id", "pos", "col.app_id", "col.record")
    wanted = targets.select(
        "monitor", "target_id", F.col("attrs")["batch"].alias("batch"), F.col("attrs")["app_id"].alias("app_id")
    )
    found = apps.join(wanted, ["monitor", "batch", "app_id"])
    return found.groupBy(*SCAN).agg(F.max_by("record", "pos").alias("record"))


APP_STORE = VersionMonitor(
    monitor="app_store",
    collect=_app_store_records,
    strict=False,
    title="iOS Update: {name} v{version}",
    text="**`{bundle}`** updated to **v{version}**\n\n**What's New:**\n{notes}",
    no_notes="No release notes provided",
    notes_clip=1500,
    color=0x1ABC9C,
    url="{store_url}",
    fields=lambda: fields(
        ("Size", phrase("{s} MB", s=F.col("detail")["size"]), True),
        ("Store", phrase("[App Store]({u})", u=F.col("detail")["url"]), True),
    ),
    detection_type="version_update",
    log_title="v{version}",
)

PLAY_STORE = VersionMonitor(
    monitor="play_store",
    record=lambda: feed.android_app_version(F.col("body")),
    strict=False,
    title="Play Store Update: {name}",
    text="**`{package}`** has been updated\n\n{move}**What's New:**\n{notes}",
    no_notes="No changelog provided by developer",
    notes_clip=1500,
    color=0x4CAF50,
    url="https://play.google.com/store/apps/details?id={package}",
    fields=lambda: fields(
        ("Version", F.col("version"), True),
        ("Updated", F.substring(F.col("detail")["updated"], 1, 10), True),
        (
            "Store",
            phrase(
                "[Google Play](https://play.google.com/store/apps/details?id={p})",
                p=F.coalesce(F.col("target.attrs")["package"], F.col("target_id")),
            ),
            True,
        ),
    ),
    detection_type="play_update",
    log_title="v{version}",
)

NPM = VersionMonitor(
    monitor="npm",
    record=lambda: feed.npm_version(F.col("body")),
    title="npm Update: {target_id} ({name})",
    text="**{old} -> {version}**\n\n{notes}",
    color=0xCB3837,
    url="https://www.npmjs.com/package/{target_id}",
    fields=lambda: fields(
        ("Package", phrase("[{p}](https://www.npmjs.com/package/{p})", p=F.col("target_id")), True),
        ("New Deps", F.col("detail")["shown_deps"], False),
    ),
    detection_type="version_update",
    log_title="{target_id} {version}",
)

PYPI = VersionMonitor(
    monitor="pypi",
    record=lambda: feed.pypi_version(F.col("body")),
    title="PyPI Update: {target_id} ({name})",
    text="**{old} -> {version}**\n\n{notes}",
    color=0x3775A9,
    url="https://pypi.org/project/{target_id}/",
    detection_type="version_update",
    log_title="{target_id} {version}",
)

# --- string resources of app packages -------------------------------------------


APK_STRINGS = ItemMonitor(
    monitor="apk_strings",
    collect=lambda captures, targets: (resource_items(landed_resources(captures)), captures),
    follows=PLAY_STORE,
    alerts=(
        Alert(
            op="added",
            bucket=lambda item, detail, target: flt.resource_category(item),
            sections=(
                Section("high_interest", 15, _line("* {x}"), "**🔥 High Interest:**\n"),
                Section("feature_name", 15, _line("* {x}"), "**⭐ Feature Names:**\n"),
                Section("ui_text", 20, _line("* {x}"), "**📝 New UI Text:**\n"),
            ),
            title="🔍 APK Strings: {name} v{version}",
            head="**{n_added} new UI strings** found in APK decompilation",
            color=0xE91E63,
            url="https://play.google.com/store/apps/details?id={target_id}",
            detection_type="new_strings",
            log_title="{n_added} strings",
            log_target="{name}",
        ),
        Alert(
            op="removed",
            bucket=_everything,
            sections=_one(15, _line("* ~~{x}~~")),
            title="🔍 APK Removed: {name} v{version}",
            head="**{n_removed} strings removed** (feature launched or killed?)",
            color=0xFF9800,
            url="https://play.google.com/store/apps/details?id={target_id}",
            below=100,
        ),
    ),
)

MONITORS: dict[str, ItemMonitor | VersionMonitor] = {
    m.monitor: m
    for m in (
        JS_DEEP, DOCS, SITEMAP, GITHUB_RELEASE, GITHUB_PRS, APP_STORE, PLAY_STORE, APK_STRINGS, CHROME_FLAGS,
        SUBDOMAINS, PAGE_CHANGE, FCC, TRADEMARK, CT_LOGS, ROBOTS_TXT, SEC_8K, NPM, PYPI, JOBS, DNS_RECORDS, ARXIV,
        GRAPHQL, CDN_ASSETS, GITHUB_ORG, HUGGINGFACE, MODEL_REGISTRY,
    )
}
