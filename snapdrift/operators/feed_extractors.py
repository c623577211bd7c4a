"""Items, versions and records out of JSON and Atom replies.

Set and list feeds give ``array<struct<item, detail>>``. Version feeds give
``struct<state, version, notes, detail>`` where ``state`` decides a change.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapdrift import schema as sc
from snapdrift.functions import text as t


SHOWN_DEPS = 10  # dependency names in the field of an alert; the record and the table of changes hold all


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _detail(**fields: Column) -> Column:
    pairs = [x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]
    return F.create_map(*pairs).cast("map<string,string>")


def entry(item: Column, **fields: Column) -> Column:
    detail = _detail(**fields) if fields else F.lit(None).cast("map<string,string>")
    return F.struct(item.alias("item"), detail.alias("detail"))


def plain(items: Column) -> Column:
    """Entries for an array of strings."""
    return F.transform(items, lambda s: entry(s))


def _version(state: Column, version: Column, notes: Column, **fields: Column) -> Column:
    detail = _detail(**fields) if fields else F.lit(None).cast("map<string,string>")
    return F.struct(state.alias("state"), version.alias("version"), notes.alias("notes"), detail.alias("detail"))


def latest_release(body: Column) -> Column:
    """The first release; its id is the state."""
    r = F.get(F.from_json(body, sc.RELEASES), 0)
    return F.when(
        r["id"].isNotNull(),
        _version(r["id"].cast("string"), r["tag_name"], _or_empty(r["body"]), name=r["name"], html_url=r["html_url"]),
    )


def pull_requests(body: Column) -> Column:
    """All with an id, in feed order."""
    prs = F.filter(F.from_json(body, sc.PULL_REQUESTS), lambda r: r["id"].isNotNull())
    return F.transform(prs, lambda r: entry(r["id"].cast("string"), title=r["title"], number=r["number"]))


def ios_app_records(body: Column) -> Column:
    """``struct(app_id, version, size, ...)`` of every app in a batch reply."""
    size = lambda r: F.coalesce(r["fileSizeBytes"].try_cast("double"), F.lit(0.0)) / 1e6
    return F.transform(
        F.filter(F.from_json(body, sc.APP_LOOKUP)["results"], lambda r: r["trackId"].isNotNull()),
        lambda r: F.struct(
            r["trackId"].cast("string").alias("app_id"),
            _version(
                F.sha2(F.concat(_or_empty(r["version"]), F.lit(":"), _or_empty(r["releaseNotes"])), 256),
                _or_empty(r["version"]),
                _or_empty(r["releaseNotes"]),
                bundle=_or_empty(r["bundleId"]),
                size=F.format_string("%.1f", size(r)),
                url=_or_empty(r["trackViewUrl"]),
            ).alias("record"),
        ),
    )


def android_app_version(body: Column) -> Column:
    """Version and stripped notes; sixteen hex digits of state."""
    r = F.from_json(body, sc.APP_RECORD)
    state = F.concat(_or_empty(r["version"]), F.lit(":"), F.coalesce(r["recentChanges"], F.lit("None")))
    return F.when(
        r.isNotNull(),
        _version(
            t.clip(F.sha2(state, 256), 16),
            _or_empty(r["version"]),
            t.strip(_or_empty(r["recentChanges"])),
            updated=_or_empty(r["updated"]),
            installs=_or_empty(r["installs"]),
            score=F.coalesce(r["score"], F.lit(0.0)),
        ),
    )


def decoded_flags_text(body: Column) -> Column:
    """Base64 text decoded, or the body itself when it is not base64."""
    decoded = F.try_to_binary(F.regexp_replace(body, r"[^A-Za-z0-9+/=]", ""), F.lit("base64"))
    return F.coalesce(F.try_validate_utf8(decoded.cast("string")), F.make_valid_utf8(decoded.cast("string")), body)


def flag_names(body: Column) -> Column:
    """X11: quoted lower-case names in the decoded text."""
    names = F.regexp_extract_all(decoded_flags_text(body), F.lit('"([a-z][a-z0-9-]+)"'), 1)
    return F.array_distinct(names)


def certificate_names(body: Column, domain: Column) -> Column:
    """Names below a domain in all certificates.

    A plain suffix test: ``notfoo.com`` counts for ``foo.com``.
    """
    certs = F.from_json(body, sc.CERTIFICATES)
    names = F.flatten(
        F.transform(
            certs, lambda c: F.concat(F.array(_or_empty(c["common_name"])), F.split(_or_empty(c["name_value"]), "\n"))
        )
    )
    clean = F.transform(names, lambda n: F.lower(t.strip(n)))
    return F.array_distinct(
        F.filter(clean, lambda n: (n != "") & F.endswith(n, F.lower(domain)) & ~F.contains(n, F.lit("*")))
    )


def _feed_entries(xml: Column) -> Column:
    """The entries of an Atom feed; comments are none, prefixes do not matter, a broken document has none.

    Only a document without entries is read again with its bare ampersands
    escaped, which many feeds have.
    """
    read = lambda x: F.from_xml(x, F.lit(sc.ATOM_FEED), {"ignoreNamespace": "true"})["entry"]
    stray = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);)"
    return F.coalesce(read(xml), read(F.regexp_replace(xml, stray, "&amp;")))


def _first(values: Column) -> Column:
    """The first value of an element, stripped; null when there is none."""
    return t.strip(F.get(values, 0))


def atom_filings(body: Column) -> Column:
    """The entries of a filings feed that have a title."""
    filings = F.transform(
        _feed_entries(body),
        lambda e: F.struct(
            _first(e["title"]).alias("title"),
            _or_empty(_first(e["updated"])).alias("date"),
            _or_empty(F.get(e["link"], 0)["_href"]).alias("link"),
            _or_empty(_first(e["summary"])).alias("summary"),
        ),
    )
    return F.transform(
        F.filter(filings, lambda f: f["title"].isNotNull()),
        lambda f: entry(
            F.concat_ws("\t", f["title"], f["date"], f["link"], f["summary"]),
            title=f["title"],
            date=f["date"],
            link=f["link"],
            summary=f["summary"],
        ),
    )


def npm_version(body: Column) -> Column:
    """Version, description and dependency names in key order."""
    r = F.from_json(body, sc.NPM_PACKAGE)
    names = F.coalesce(F.map_keys(r["dependencies"]), F.array().cast("array<string>"))
    state = F.concat_ws(":", _or_empty(r["version"]), _or_empty(r["description"]), F.array_join(names, ","))
    listed = F.array_join(names, ", ")
    return F.when(
        r.isNotNull(),
        _version(
            F.sha2(state, 256),
            _or_empty(r["version"]),
            _or_empty(r["description"]),
            deps=F.when(listed == "", "None").otherwise(listed),
            shown_deps=F.when(listed == "", "None").otherwise(F.array_join(F.slice(names, 1, SHOWN_DEPS), ", ")),
        ),
    )


def pypi_version(body: Column) -> Column:
    """Version and summary."""
    r = F.from_json(body, sc.PYPI_PACKAGE)["info"]
    state = F.concat_ws(":", _or_empty(r["version"]), _or_empty(r["summary"]))
    return F.when(r.isNotNull(), _version(F.sha2(state, 256), _or_empty(r["version"]), _or_empty(r["summary"])))


def job_titles_board_a(body: Column) -> Column:
    """``title | department | location``."""
    return F.transform(
        F.from_json(body, sc.JOBS_BOARD_A)["jobs"],
        lambda j: F.concat_ws(
            " | ",
            _or_empty(j["title"]),
            _or_empty(F.get(j["departments"], 0)["name"]),
            _or_empty(j["location"]["name"]),
        ),
    )


def job_titles_board_b(body: Column) -> Column:
    """``title | team | location``."""
    return F.transform(
        F.from_json(body, sc.JOBS_BOARD_B),
        lambda j: F.concat_ws(
            " | ", _or_empty(j["text"]), _or_empty(j["categories"]["team"]), _or_empty(j["categories"]["location"])
        ),
    )


def dns_records(body: Column, record: Column) -> Column:
    """``record:data``; ``record`` is ``MX`` or ``TXT:host``."""
    return F.transform(
        F.from_json(body, sc.DNS_ANSWER)["Answer"], lambda a: F.concat(record, F.lit(":"), _or_empty(a["data"]))
    )


def arxiv_papers(body: Column) -> Column:
    """Papers of an Atom reply in feed order; the title is the item."""
    authors = lambda e: F.filter(F.transform(e["author"], lambda a: _first(a["name"])), lambda n: n.isNotNull())
    papers = F.transform(
        _feed_entries(body),
        lambda e: F.struct(
            _first(e["title"]).alias("title"),
            F.array_join(F.coalesce(authors(e), F.array().cast("array<string>")), ", ").alias("authors"),
            _or_empty(_first(e["id"])).alias("link"),
            t.clip(_or_empty(_first(e["published"])), 10).alias("date"),
            _or_empty(_first(e["summary"])).alias("summary"),
        ),
    )
    return F.transform(
        F.filter(papers, lambda x: x["title"].isNotNull()),
        lambda x: entry(x["title"], authors=x["authors"], link=x["link"], date=x["date"], summary=x["summary"]),
    )


def graphql_schema_items(body: Column) -> Column:
    """``type:T``, ``field:T.f`` and ``mutation:m``."""
    schema = F.from_json(body, sc.GRAPHQL_SCHEMA)["data"]["__schema"]
    none = F.array().cast("array<string>")
    types = F.filter(schema["types"], lambda x: ~F.startswith(_or_empty(x["name"]), F.lit("__")))
    of_type = F.transform(
        types,
        lambda x: F.concat(
            F.array(F.concat(F.lit("type:"), _or_empty(x["name"]))),
            F.transform(
                F.coalesce(x["fields"], F.array().cast("array<struct<name:string>>")),
                lambda f: F.concat(F.lit("field:"), _or_empty(x["name"]), F.lit("."), f["name"]),
            ),
        ),
    )
    mutations = F.transform(schema["mutationType"]["fields"], lambda f: F.concat(F.lit("mutation:"), f["name"]))
    return F.array_distinct(F.concat(F.coalesce(F.flatten(of_type), none), F.coalesce(mutations, none)))


def org_repos(body: Column) -> Column:
    """All repositories with their description."""
    repos = F.filter(F.from_json(body, sc.ORG_REPOS), lambda r: _or_empty(r["full_name"]) != "")
    return F.transform(
        repos,
        lambda r: entry(
            r["full_name"],
            desc=_or_empty(r["description"]),
            url=_or_empty(r["html_url"]),
            stars=F.coalesce(r["stargazers_count"], F.lit(0)),
            created=t.clip(_or_empty(r["created_at"]), 10),
        ),
    )


def hub_models(body: Column) -> Column:
    """All models with their pipeline tag."""
    models = F.filter(F.from_json(body, sc.HUB_MODELS), lambda m: _or_empty(m["modelId"]) != "")
    return F.transform(
        models,
        lambda m: entry(
            m["modelId"],
            downloads=F.coalesce(m["downloads"], F.lit(0)),
            likes=F.coalesce(m["likes"], F.lit(0)),
            pipeline=_or_empty(m["pipeline_tag"]),
            created=t.clip(_or_empty(m["createdAt"]), 10),
        ),
    )


def registry_models(body: Column) -> Column:
    """``data[].id`` or ``models[].name``; members that are no object are skipped."""
    none = F.array().cast("array<string>")
    reply = F.from_json(body, sc.MODEL_REGISTRY)
    ids = F.transform(F.coalesce(reply["data"], none), lambda m: F.get_json_object(m, "$.id"))
    names = F.transform(F.coalesce(reply["models"], none), lambda m: F.get_json_object(m, "$.name"))
    return F.array_distinct(F.filter(F.concat(ids, names), lambda m: m.isNotNull()))
