"""WARC files packaged in ZIP archives: written by tasks, read by ranges.

An archive holds stored (uncompressed) members: ``archive/data.warc.gz``, whose
records are gzip members of their own, and ``indexes/index.cdxj``, one line a
record. The reader finds members in the central directory, plain or ZIP64, and
then reads single records at their offsets; nothing is extracted. It takes
archives of other writers, with several WARCs, any records and packed indexes or
none; what it can't read is a row with an error. Files are
reached by URI through pyarrow, so folders may be local, HDFS or object stores.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdrift.llm.common import fresh_folder, small_batches, staged

ARCHIVE_BYTES = 128 << 20
READ_BLOCK = 4 << 20
INDEX_BATCH = 10_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # pages carry no time of capture


# --- ZIP ----------------------------------------------------------------------------------------------------------


def _tail(file: pa.NativeFile, size: int) -> tuple[int, int, int]:
    """Entries, offset and length of the central directory, from the end records."""
    start = max(0, size - (22 + 65_535))
    file.seek(start)
    data = file.read(size - start)
    at = data.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(data) or at + 22 + struct.unpack_from("<H", data, at + 20)[0] != len(data)):
        at = data.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    entries, length, offset = struct.unpack_from("<HII", data, at + 10)
    if entries == 0xFFFF or 0xFFFFFFFF in (length, offset):
        file.seek(start + at - 20)
        mark, _, end64, _ = struct.unpack("<4sIQI", file.read(20))
        if mark != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        file.seek(end64)
        record = file.read(56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        entries, length, offset = struct.unpack_from("<QQQ", record, 32)
    return entries, offset, length


class Member(NamedTuple):
    """A directory entry: method, offset of the local header, stored and full length."""

    method: int
    header: int
    packed: int
    full: int


def directory(file: pa.NativeFile) -> dict[str, Member]:
    """Members by name, from the central directory alone."""
    entries, offset, length = _tail(file, file.size())
    file.seek(offset)
    data, at, out = file.read(length), 0, {}
    for _ in range(entries):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, full, n_name, n_extra, n_note, local = (
            *struct.unpack_from("<H", data, at + 10), *struct.unpack_from("<IIHHH", data, at + 20), *struct.unpack_from("<I", data, at + 42)
        )
        name = data[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra, i = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while i + 4 <= len(extra):
            tag, size = struct.unpack_from("<HH", extra, i)
            if tag == 1:  # 64-bit values, only of fields that are full, in this order
                values = iter(struct.unpack_from(f"<{size // 8}Q", extra, i + 4))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                local = next(values) if local == 0xFFFFFFFF else local
            i += 4 + size
        out[name] = Member(method, local, packed, full)
        at += 46 + n_name + n_extra + n_note
    return out


def data_offset(file: pa.NativeFile, member: Member) -> int:
    """Where a member's bytes begin; its local header is read for that alone."""
    file.seek(member.header)
    header = file.read(30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", header, 26))


def members(file: pa.NativeFile) -> dict[str, tuple[int, int, int]]:
    """``name: (method, data offset, stored length)`` of each member."""
    return {name: (m.method, data_offset(file, m), m.packed) for name, m in directory(file).items()}


def _stored(found: dict[str, tuple[int, int, int]], name: str) -> tuple[int, int]:
    method, offset, length = found[name]
    if method != 0:
        raise ValueError(f"{name} is compressed and can't be read by ranges")
    return offset, length


def _blocks(file: pa.NativeFile, member: Member) -> Iterator[bytes]:
    """A member's bytes, unpacked if the archive or the member itself is packed."""
    at, left = data_offset(file, member), member.packed
    if member.method not in (0, 8):
        raise ValueError(f"packed by method {member.method}")
    unpack = zlib.decompressobj(-15) if member.method == 8 else None
    gzip, first = None, True
    while left:
        file.seek(at)
        data = file.read(min(left, READ_BLOCK))
        if not data:
            raise ValueError("the archive ends too early")
        at, left = at + len(data), left - len(data)
        data = unpack.decompress(data) if unpack else data
        if first and data:
            gzip, first = (zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None), False
        while gzip and data:
            yield gzip.decompress(data)
            data = gzip.unused_data
            gzip = zlib.decompressobj(31) if gzip.eof else gzip
        if data and not gzip:
            yield data


def _lines(blocks: Iterator[bytes]) -> Iterator[bytes]:
    rest = b""
    for data in blocks:
        *lines, rest = (rest + data).split(b"\n")
        yield from lines
    yield rest


# --- WARC ---------------------------------------------------------------------------------------------------------


def _clean(text: str) -> str:
    return "".join(c if " " <= c != "\x7f" else "%%%02X" % ord(c) for c in text)


def warc_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit with the HTTP header of the full payload only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page}>"]
    head += [] if url is None else [f"WARC-Target-URI: {_clean(url)}"]
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode().split(":", 1) for line in lines if b":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def _page(urn: str | None) -> int | None:
    """The page a record of this module stands for; none for records of other writers."""
    found = re.fullmatch(r"<urn:x-page:(-?[0-9]+)>", urn or "")
    return int(found[1]) if found else None


def parse_record(data: bytes) -> dict:
    """Type, ids, URL, and length, digest and payload of one WARC record.

    The payload is what follows the HTTP header of a response, request or
    revisit, the whole block of any other record. A record that names no SHA-1
    digest gets that of its payload; one that names another than its payload's
    is an error. A revisit's length and digest are those of the full payload, as
    far as it tells them.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not version.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _fields(lines)
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("the record ends too early")
    block, http, payload = rest[:size], {}, rest[:size]
    if fields.get("content-type", "").startswith("application/http"):
        first, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(first.split(b"\r\n")[1:])
    named = fields.get("warc-payload-digest", "")
    named = named.partition(":")[2].upper() if named.lower().startswith("sha1:") else None
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = fields["warc-type"] == "revisit"
    if not revisit and named is not None and named != own:
        raise ValueError("payload and digest differ")
    length = http.get("content-length", "") if revisit else str(len(payload))
    return {
        "page_id": _page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
        "refers_to": _page(fields.get("warc-refers-to")), "payload_bytes": int(length) if length.isdigit() else None,
        "payload_digest": named or (None if revisit else own), "record_id": fields.get("warc-record-id"), "payload": payload,
    }


class _Archive:
    """One archive being written: records first, then the index."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, path = pafs.FileSystem.from_uri(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.file = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data, self.at, self.lines = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True), 0, []

    def add(self, url: str | None, record: bytes, digest: str) -> None:
        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        packed = packer.compress(record) + packer.flush()
        line = {"url": url, "digest": f"sha1:{digest}", "filename": "data.warc.gz", "offset": self.at, "length": len(packed)}
        self.lines.append(f"{_clean(url or '-').replace(' ', '%20')} {DATE.translate({45: None, 58: None, 84: None, 90: None})} {json.dumps(line)}\n")
        self.data.write(packed)
        self.at += len(packed)

    def close(self) -> tuple[str, int]:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            for line in sorted(self.lines):
                index.write(line.encode())
        self.zip.close()
        self.file.close()
        return self.path, len(self.lines)


def write_archives(pages: DataFrame, folder: str, least_revisit: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages (page_id, url, html)``; returns ``path, records`` of the archives that count.

    Of rows with equal payloads of at least ``least_revisit`` bytes those of the
    smallest id are responses, the others revisit it. A null ``html`` is empty;
    a null id never is the smallest unless all are. An attempt of a task that is
    run again writes files of other names, which the returned table leaves out.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(pages["html"], F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long"), pages["url"].cast("string"), html.alias("payload")).withColumn("sha1", F.sha1("payload"))
    size = F.octet_length("payload")
    first = rows.where(size >= least_revisit).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(first.select("sha1", "first"), "sha1", "left")
    rows = rows.select("page_id", "url", "payload", "sha1", F.expr("CASE WHEN NOT first <=> page_id THEN first END").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for page, url, payload, sha1, to in zip(*(c.to_pylist() for c in batch.columns)):
                archive = archive or _Archive(folder)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                archive.add(url, warc_record(page, url, payload, digest, to), digest)
                if archive.at >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        done += [archive.close()] if archive else []
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    return staged(rows.mapInArrow(run, "path string, records long"), "archives")


INDEX_NAME = re.compile(r"indexes/.*\.cdxj?(\.gz)?")
DATA_NAME = re.compile(r"archive/.*\.warc(\.gz)?")
BAD = (ValueError, KeyError, IndexError, OSError, StopIteration, struct.error, zlib.error)


def _scan(file: pa.NativeFile, start: int, length: int) -> Iterator[tuple[int, int]]:
    """``(start, length)`` of each gzip record of a stored member that no index lists."""
    at, end, begin, unpack = start, start + length, start, zlib.decompressobj(31)
    while at < end:
        file.seek(at)
        data = file.read(min(end - at, READ_BLOCK))
        at += len(data)
        while data:
            unpack.decompress(data)
            data = unpack.unused_data
            if unpack.eof:
                yield begin, at - len(data) - begin
                begin, unpack = at - len(data), zlib.decompressobj(31)
    if begin != end:
        raise ValueError("the last record ends too early")


def _listed(file: pa.NativeFile) -> Iterator[tuple[str | None, int | None, int | None, str | None]]:
    """``member, start, length, error`` of the records of an archive, by its indexes or, without any, by its data."""
    found = directory(file)
    places: dict[str, tuple[int, int]] = {}

    def place(name: str) -> tuple[int, int]:
        if name not in places:
            if found[name].method != 0:
                raise ValueError("compressed, so not to be read by ranges")
            places[name] = data_offset(file, found[name]), found[name].packed
        return places[name]

    data = [n for n in found if DATA_NAME.fullmatch(n)]
    indexes = [n for n in found if INDEX_NAME.fullmatch(n)]
    for index in indexes:
        for line in _lines(_blocks(file, found[index])):
            if not line.strip() or line.startswith(b"!"):
                continue
            member = None
            try:
                entry = json.loads(line[line.index(b"{") :])
                member = next(n for n in data if n.removeprefix("archive/") == entry["filename"].removeprefix("archive/"))
                base, size = place(member)
                start, length = int(entry["offset"]), int(entry["length"])
                if not 0 <= start < start + length <= size:
                    raise ValueError("outside of its member")
                yield member, base + start, length, None
            except BAD as e:
                yield member, None, None, f"{index}: {type(e).__name__}: {e}"
    for member in data if not indexes else []:
        try:
            for start, length in _scan(file, *place(member)):
                yield member, start, length, None
        except BAD as e:
            yield member, None, None, f"{type(e).__name__}: {e}"


INDEX_ROWS = "path string, member string, start long, length long, error string"


def read_index(archives: DataFrame) -> DataFrame:
    """``path, member, start, length, error`` of each record of ``archives (path)``, as places in the archive file.

    An archive may hold any number of WARCs and of indexes, packed or not. What
    can't be read gives a row with an error, and the rest is read.
    """
    kinds = pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()

    def packed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "member", "start", "length", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                try:
                    system, name = pafs.FileSystem.from_uri(path)
                    with system.open_input_file(name) as file:
                        for row in _listed(file):
                            rows.append((path, *row))
                            if len(rows) >= INDEX_BATCH:
                                yield packed(rows)
                                rows = []
                except BAD as e:
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield packed(rows)

    paths = archives.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(run, INDEX_ROWS)


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records at ``index (path, member, start, length, error)``, an ``error`` where one can't be read.

    Ranges that lie together go to one task, a task for each ``READ_BLOCK`` of them.
    """
    fields = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}
    fields |= {"record_id": pa.string(), "path": pa.string(), "error": pa.string()}
    fields |= {"payload": pa.binary()} if payloads else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file = None, None
        for batch in batches:
            rows = []
            for path, start, length, error in zip(*(c.to_pylist() for c in batch.columns)):
                row = {"path": path, "error": error}
                try:
                    if error is None:
                        if path != opened:
                            if file is not None:
                                file.close()
                            opened, file = None, None
                            system, name = pafs.FileSystem.from_uri(path)
                            opened, file = path, system.open_input_file(name)
                        file.seek(start)
                        data = file.read(length)
                        row |= parse_record(zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data)
                except BAD as e:
                    row["error"] = f"at {start}: {type(e).__name__}: {e}"
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in fields.items()], list(fields))
        if file is not None:
            file.close()

    n = 1 + (index.agg(F.sum("length")).first()[0] or 0) // READ_BLOCK
    near = index.withColumn("block", F.floor(F.col("start") / READ_BLOCK)).repartition(n, "path", "block")
    near = near.sortWithinPartitions("path", "start").select("path", "start", "length", "error")
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return near.mapInArrow(run, ", ".join(f"{k} {kinds[t]}" for k, t in fields.items()))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives and read all records back, one row a page.

    Repeated rows are records of their own; no rows give no rows.
    """
    archives = write_archives(pages, folder or fresh_folder(pages.sparkSession, "wacz"))
    return read_records(staged(read_index(archives), "archive-index"))
