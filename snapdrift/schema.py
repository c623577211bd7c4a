"""Table layouts shared by every job."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "timestamp": T.TimestampType(),
    "strings": T.ArrayType(T.StringType()),
    "map": T.MapType(T.StringType(), T.StringType()),
    # open scans with the epochs their captures came in, and scans that are due with the version that made them so
    "opens": T.ArrayType(
        T.StructType(
            [
                T.StructField("scan_id", T.LongType()),
                T.StructField("epochs", T.ArrayType(T.IntegerType())),
                T.StructField("last_at", T.TimestampType()),
            ]
        )
    ),
    "dues": T.ArrayType(T.StructType([T.StructField("scan_id", T.LongType()), T.StructField("version", T.StringType())])),
}


def table_of(columns: str) -> T.StructType:
    """A layout from ``name type`` pairs; needs no running session."""
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


KEYS = ("monitor", "target_id")
SCAN = (*KEYS, "scan_id")

# One landed reply. ``role`` tells apart the documents of one scan, such as a
# page and its bundles; most monitors leave it null.
CAPTURES = table_of(
    "monitor string, target_id string, scan_id bigint, captured_at timestamp, status int, "
    "content_type string, url string, role string, body string"
)

TARGETS = table_of(
    "monitor string, target_id string, name string, ticker string, url string, domain string, "
    "keywords strings, patterns strings, attrs map"
)

DETECTIONS = table_of(
    "monitor string, target_id string, scan_id bigint, detection_type string, title string, details string, "
    "detected_at timestamp"
)

# Every kept change of a run. Of a version monitor ``op`` and ``bucket`` are
# "version", ``item`` is the new version, and ``detail`` also holds
# ``old_version`` and the whole ``notes``.
KEPT_CHANGES = table_of(
    "monitor string, target_id string, scan_id bigint, op string, bucket string, item string, detail map"
)

# Feed layouts, read with ``from_xml`` and ``from_json``; a field that is absent becomes null.
ATOM_FEED = (
    "struct<entry:array<struct<title:array<string>,updated:array<string>,summary:array<string>,id:array<string>,"
    "published:array<string>,link:array<struct<_href:string>>,author:array<struct<name:array<string>>>>>>"
)
RELEASES = "array<struct<id:bigint,tag_name:string,name:string,body:string,html_url:string>>"
PULL_REQUESTS = "array<struct<id:bigint,title:string,number:int>>"
APP_LOOKUP = (
    "struct<results:array<struct<trackId:bigint,version:string,releaseNotes:string,bundleId:string,"
    "fileSizeBytes:string,trackViewUrl:string>>>"
)
APP_RECORD = "struct<version:string,recentChanges:string,updated:string,installs:string,score:double>"
CERTIFICATES = "array<struct<common_name:string,name_value:string>>"
NPM_PACKAGE = "struct<version:string,description:string,dependencies:map<string,string>>"
PYPI_PACKAGE = "struct<info:struct<version:string,summary:string>>"
JOBS_BOARD_A = (
    "struct<jobs:array<struct<title:string,location:struct<name:string>,departments:array<struct<name:string>>>>>"
)
JOBS_BOARD_B = "array<struct<text:string,categories:struct<team:string,location:string>>>"
DNS_ANSWER = "struct<Answer:array<struct<data:string>>>"
GRAPHQL_SCHEMA = (
    "struct<data:struct<__schema:struct<types:array<struct<name:string,fields:array<struct<name:string>>>>,"
    "mutationType:struct<fields:array<struct<name:string>>>>>>"
)
ORG_REPOS = (
    "array<struct<full_name:string,description:string,html_url:string,stargazers_count:int,created_at:string>>"
)
HUB_MODELS = "array<struct<modelId:string,downloads:bigint,likes:bigint,pipeline_tag:string,createdAt:string>>"
MODEL_REGISTRY = "struct<data:array<string>,models:array<string>>"
