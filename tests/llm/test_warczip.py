"""Archives of other writers, and broken ones."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zipfile

import pytest

from snapdrift.llm import warczip as W


def record(kind, uri, block, more=(), content="application/http; msgtype=response", rid=None):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid or f'<urn:uuid:{kind}-{uri}>'}"]
    head += [f"WARC-Target-URI: {uri}"] if uri else []
    head += [f"Content-Type: {content}", f"Content-Length: {len(block)}", *more]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def sha1(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http(payload, length=True):
    return b"HTTP/1.1 200 OK\r\n" + (b"Content-Length: %d\r\n" % len(payload) if length else b"X: y\r\n") + b"\r\n" + payload


RECORDS = [
    record("warcinfo", None, b"software: other\r\n", content="application/warc-fields"),
    record("response", "http://a/1", http(b"one"), [f"WARC-Payload-Digest: sha1:{sha1(b'one')}"]),
    record("response", "http://a/2", http(b"no digest, no length", length=False)),
    record("request", "http://a/1", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", content="application/http; msgtype=request"),
    record("metadata", "http://a/1", b"via: x", content="application/warc-fields"),
    record("revisit", "http://a/1", http(b"")[:-2] + b"\r\n", [f"WARC-Payload-Digest: sha1:{sha1(b'one')}", "WARC-Refers-To: <urn:uuid:other>"]),
    record("response", "http://a/3", http(b"\x00" * 5000), ["WARC-Payload-Digest: sha256:abc"]),
]


def warc(records):
    places, data = [], b""
    for r in records:
        places.append((len(data), len(r)))
        data += r
    return data, places


def lines(name, places):
    return b"".join(b"com,a)/ 20240101000000 " + json.dumps({"filename": name, "offset": str(o), "length": str(n)}).encode() + b"\n" for o, n in places)


def archive(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, data, method in files:
            z.writestr(name, data, method)
    return f"file://{path}"


STORED, PACKED = zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    folder = tmp_path_factory.mktemp("archives")
    one, at_one = warc(RECORDS[:4])
    two, at_two = warc(RECORDS[4:])
    plain = gzip.decompress(RECORDS[1])
    both = lines("a.warc.gz", at_one) + b"!meta 1\n" + lines("b.warc.gz", at_two)
    bad_lines = lines("a.warc.gz", at_one) + b"no json\n" + lines("missing.warc.gz", [(0, 5)]) + lines("a.warc.gz", [(len(one) - 3, 100), (5, 20)])
    wrong = record("response", "http://w", http(b"x"), [f"WARC-Payload-Digest: sha1:{sha1(b'y')}"])
    tail = [("datapackage.json", "{}", PACKED)]
    made = {
        "several": [("archive/a.warc.gz", one, STORED), ("archive/b.warc.gz", two, STORED), ("indexes/index.cdx.gz", gzip.compress(both[:300]) + gzip.compress(both[300:]), STORED), *tail],
        "packed_index": [("archive/a.warc.gz", one, STORED), ("indexes/index.cdxj", lines("a.warc.gz", at_one), PACKED)],
        "no_index": [("archive/a.warc.gz", one, STORED), ("archive/b.warc.gz", two, STORED)],
        "uncompressed": [("archive/p.warc", plain, STORED), ("indexes/i.cdxj", lines("p.warc", [(0, len(plain))]), STORED)],
        "bad_lines": [("archive/a.warc.gz", one, STORED), ("indexes/index.cdxj", bad_lines, STORED)],
        "packed_data": [("archive/a.warc.gz", one, PACKED), ("indexes/index.cdxj", lines("a.warc.gz", at_one[:1]), STORED)],
        "wrong_digest": [("archive/w.warc.gz", wrong, STORED)],
        "cut": [("archive/a.warc.gz", one[:-9], STORED)],
        "nothing": tail,
    }
    found = {name: archive(folder / f"{name}.wacz", files) for name, files in made.items()}
    (folder / "text.wacz").write_text("no archive")
    whole = (folder / "several.wacz").read_bytes()
    (folder / "broken.wacz").write_bytes(b"\0" * 100 + whole[100:])
    return found | {"text": f"file://{folder}/text.wacz", "broken": f"file://{folder}/broken.wacz", "absent": f"file://{folder}/absent.wacz"}


def read(spark, *names):
    archives = spark.createDataFrame([(n,) for n in names], "path string")
    return W.read_records(W.read_index(archives), payloads=True).collect()


def shape(rows):
    return sorted((r["record_type"], r["url"] or "", bytes(r["payload"])) for r in rows if r["error"] is None)


WANT = sorted(
    [
        ("warcinfo", "", b"software: other\r\n"), ("response", "http://a/1", b"one"), ("response", "http://a/2", b"no digest, no length"),
        ("request", "http://a/1", b""), ("metadata", "http://a/1", b"via: x"), ("revisit", "http://a/1", b""), ("response", "http://a/3", b"\x00" * 5000),
    ]
)


@pytest.mark.parametrize("name", ["several", "no_index"])
def test_archives_of_several_files(spark, paths, name):
    rows = read(spark, paths[name])
    assert all(r["error"] is None for r in rows) and shape(rows) == WANT
    by = {(r["record_type"], r["url"]): r for r in rows}
    assert by["response", "http://a/2"]["payload_digest"] == sha1(b"no digest, no length")
    assert by["response", "http://a/3"]["payload_bytes"] == 5000 and by["response", "http://a/3"]["page_id"] is None
    assert (by["revisit", "http://a/1"]["payload_digest"], by["revisit", "http://a/1"]["refers_to"]) == (sha1(b"one"), None)
    assert by["response", "http://a/1"]["record_id"] == "<urn:uuid:response-http://a/1>"


def test_packed_indexes_and_plain_records(spark, paths):
    assert [r["error"] for r in read(spark, paths["packed_index"])] == [None] * 4
    rows = read(spark, paths["uncompressed"])
    assert shape(rows) == [("response", "http://a/1", b"one")]


def test_what_cannot_be_read_is_a_row(spark, paths):
    rows = read(spark, *paths.values())
    by = {}
    for r in rows:
        by.setdefault(r["path"].rpartition("/")[2].removesuffix(".wacz"), []).append(r)
    good = {n: sum(r["error"] is None for r in rs) for n, rs in by.items()}
    bad = {n: sum(r["error"] is not None for r in rs) for n, rs in by.items()}
    assert good["several"] == 7 and good["no_index"] == 7 and "nothing" not in by
    assert (good["bad_lines"], bad["bad_lines"]) == (4, 4)
    assert (good["packed_data"], bad["packed_data"]) == (0, 1)
    assert (good["wrong_digest"], bad["wrong_digest"]) == (0, 1) and "differ" in by["wrong_digest"][0]["error"]
    assert (good["cut"], bad["cut"]) == (3, 1)
    assert bad["text"] == bad["absent"] == 1 and bad["broken"] >= 1


def test_tasks_by_bytes(spark, paths, monkeypatch):
    monkeypatch.setattr(W, "READ_BLOCK", 200)
    found = W.read_records(W.read_index(spark.createDataFrame([(paths["several"],)], "path string")))
    assert found.rdd.getNumPartitions() > 5 and found.count() == 7


def test_large_members_by_zip64(tmp_path):
    """Values of more than 32 bits stand in the extra field; the directory alone tells them."""
    import struct

    import pyarrow as pa

    name, big = b"archive/big.warc.gz", 5 << 32
    extra = struct.pack("<HHQQQ", 1, 24, big, big + 1, big + 2)
    central = struct.pack("<4s4B4HIIIHHHHHII", b"PK\x01\x02", 45, 3, 45, 0, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), 0)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(central), 1)
    end = struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    file = pa.BufferReader(central + end64 + locator + end)
    assert W.directory(file) == {name.decode(): W.Member(0, big + 2, big + 1, big)}


def test_small_pages_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "x" * (3 if i < 4 else 30)) for i in range(8)], "page_id long, url string, html string")
    archives = W.write_archives(pages, f"file://{tmp_path}/a", least_revisit=10)
    got = {r["page_id"]: r["record_type"] for r in W.read_records(W.read_index(archives)).collect()}
    assert got == {i: "revisit" if i > 4 else "response" for i in range(8)}
