"""Token ids in binary files: frequency ranks, variable length, control bytes apart.

A file holds the ids of consecutive documents. Its ids are numbered anew by
their frequency in that file, so that the common ones take one byte, and come in
blocks: two bits of control an id (bytes less one, four to a control byte), and
after all control bytes of the block its data bytes. A reader looks up each
control byte in a table of lengths and gathers the values at their running sums;
a block needs no other block, and a file no other file::

    magic | block ... | footer | footer length (8 bytes) | magic
    block   control bytes | data bytes
    footer  JSON line of counts | ids by rank | block lengths | document ids, a flag where null | ids a document

Documents are dealt to files by ranges of ``doc_id``, so files in order hold
documents in order. A task that is run again writes files of other names; only
those in the returned table count. Files are reached by URI through pyarrow.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapdrift.llm.common import fresh_folder, small_batches, staged, texts_of

MAGIC = b"IDSVB\x01\r\n"
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 24
CACHED = 800_000
WIDE = 1 << 24  # ids from here on are not counted in a table
FILES = "part int, seq int, path string, n_docs long, n_ids long"
_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


# --- coding -------------------------------------------------------------------------------------------------------


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = extra
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    used = np.arange(4, dtype=np.uint8) <= extra[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of :func:`pack`; raises if the bytes do not fit."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    if len(lengths) != n or (ends[-1] if n else 0) != len(data):
        raise ValueError("control and data bytes differ")
    whole = np.ndarray((len(data) + 1,), "<u4", data + b"\0\0\0\0", strides=(1,))  # the four bytes from each place on
    return whole[ends - lengths] & _MASKS[lengths]


def by_frequency(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, most frequent first (ties: smallest), and the rank of each of ``ids`` among them."""
    if len(ids) and ids.max() >= WIDE:
        kinds, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    else:
        counts, inverse = np.bincount(ids), ids
        kinds = np.arange(len(counts), dtype=np.uint32)
    order = np.lexsort((kinds, -counts))[: np.count_nonzero(counts)]
    rank = np.empty(len(counts), np.uint32)
    rank[order] = np.arange(len(order))
    return kinds[order], rank[inverse.reshape(-1)]


class Writer:
    """One file: ids are kept until it is closed, at most ``FILE_IDS`` and one document more."""

    def __init__(self) -> None:
        self.docs, self.parts, self.n_ids = [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.parts.append(ids)
        self.n_ids += len(ids)

    def write(self, path: str) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.empty(0, np.uint32)
        kinds, ranks = by_frequency(ids)
        sizes = []
        system, name = pafs.FileSystem.from_uri(path)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        with system.open_output_stream(name) as file:
            file.write(MAGIC)
            for at in range(0, len(ranks), BLOCK_IDS):
                control, data = pack(ranks[at : at + BLOCK_IDS])
                file.write(control + data)
                sizes.append(len(control) + len(data))
            counts = {"ids": len(ids), "kinds": len(kinds), "block_ids": BLOCK_IDS, "blocks": len(sizes), "docs": len(self.docs)}
            footer = json.dumps(counts).encode() + b"\n" + kinds.astype("<u4").tobytes() + np.array(sizes, "<u4").tobytes()
            footer += np.array([d or 0 for d, _ in self.docs], "<i8").tobytes() + bytes(d is None for d, _ in self.docs)
            footer += np.array([n for _, n in self.docs], "<i8").tobytes()
            file.write(footer + len(footer).to_bytes(8, "little") + MAGIC)


class Reader:
    """One file by ranges: the footer, then the blocks one after the other."""

    def __init__(self, path: str) -> None:
        system, name = pafs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        end = self.file.size() - len(MAGIC) - 8
        size, magic = self._at(end, 8), self._at(end + 8, len(MAGIC))
        if magic != MAGIC or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{path}: not a file of ids")
        n = int.from_bytes(size, "little")
        head, _, rest = self._at(end - n, n).partition(b"\n")
        self.counts = c = json.loads(head)
        self.kinds, rest = np.frombuffer(rest, "<u4", c["kinds"]), rest[4 * c["kinds"] :]
        self.sizes, rest = np.frombuffer(rest, "<u4", c["blocks"]), rest[4 * c["blocks"] :]
        doc_ids, rest = np.frombuffer(rest, "<i8", c["docs"]).tolist(), rest[8 * c["docs"] :]
        self.doc_ids = [None if null else d for d, null in zip(doc_ids, rest[: c["docs"]])]
        self.lengths = np.frombuffer(rest[c["docs"] :], "<i8").tolist()

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def blocks(self) -> Iterator[np.ndarray]:
        at, left = len(MAGIC), self.counts["ids"]
        for size in self.sizes.tolist():
            n = min(left, self.counts["block_ids"])
            data, controls = self._at(at, size), -(-n // 4)
            yield self.kinds[unpack(data[:controls], data[controls:], n)]
            at, left = at + size, left - n

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """``(doc_id, its ids in parts)``; a part is a slice of a block."""
        blocks, block = self.blocks(), np.empty(0, np.uint32)
        for doc_id, n in zip(self.doc_ids, self.lengths):
            parts = []
            while n:
                block = next(blocks) if not len(block) else block
                parts.append(block[:n])
                n, block = n - len(parts[-1]), block[n:]
            yield doc_id, parts

    def close(self) -> None:
        self.file.close()


# --- encoding -----------------------------------------------------------------------------------------------------


class Encoder:
    """Ids of texts by a tokenizer file whose vocabulary marks word ends and which drops white space.

    No piece of such a tokenizer spans white space. Printable ASCII and Latin-1
    letters, which its normalisation only lower-cases, are split into the words,
    digits and signs that it splits them into, by the classes of their bytes; of
    other runs of characters each is one word here. A word is looked up once a
    batch and encoded once a worker. When there are too many, those met in
    several batches stay.
    """

    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ\x20\x09-\x0D]*")
    #: Fixed value: the split of the tokenizer file, for lower-case text of those characters, which :meth:`_cut` makes.
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\x20\x09-\x0D]+")
    RUNS = re.compile(r"[^\x20\x09-\x0D]+")
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    END = "</w>"
    BLANK, LETTER, DIGIT, SIGN, OTHER = range(5)
    CLASS = np.full(256, SIGN, np.uint8)  # of the bytes of plain text in lower case
    CLASS[[32, *range(9, 14)]] = BLANK
    CLASS[[*range(97, 123), *range(128, 256)]] = LETTER
    CLASS[48:58] = DIGIT

    def __init__(self, file: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            made = json.load(f)
        steps = made["pre_tokenizer"]["pretokenizers"]
        plain = [n["type"] for n in made["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        if not plain or steps[0]["pattern"] != {"Regex": self.SPLIT} or made["model"].get("end_of_word_suffix") != self.END:
            raise ValueError(f"{file}: words can't be encoded one by one")
        self.special = tuple(t["content"] for t in made["added_tokens"])
        self.tokenizer = Tokenizer.from_file(file)
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith(self.END)]] = True
        self.forget()

    def forget(self) -> None:
        self.known = defaultdict()  # a word that is looked up first takes the next number
        self.known.default_factory = self.known.__len__
        self.flat, self.starts, self.ends, self.met = array("I"), array("q"), array("q"), array("I")

    def _shrink(self) -> None:
        """Forget the words that one batch only had, and the rarest of the others beyond half of what is kept."""
        met, words = np.array(self.met), list(self.known)
        often = np.argsort(met, kind="stable")[::-1][: CACHED // 2]
        kept = np.sort(often[met[often] > 1])
        ids, ends = self._at(kept)
        self.forget()
        self._numbers([words[i] for i in kept])
        self.flat.frombytes(ids.tobytes())
        self.starts.frombytes(ends[:-1].tobytes())
        self.ends.frombytes(ends[1:].tobytes())
        self.met.frombytes((met[kept] >> 1).tobytes())

    def _plain(self, text: str) -> bool:
        return self.PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _marked(self, text: str) -> str:
        """``text`` in lower case; a run between blanks that is not plain stays and has a zero byte before it."""
        if self._plain(text):
            return text.lower()
        return " ".join([r.lower() if self._plain(r) else "\0" + r for r in self.RUNS.findall(text)])

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of all marked ``texts`` one after the other, and the number of them before each text and at the end."""
        parts = [t.encode() for t in texts]
        data = np.frombuffer(b" ".join(parts) + b"    ", np.uint8)  # no look ahead passes the end
        kind = self.CLASS[data]
        if not data.all():  # a run with a zero byte before it is one word
            edges = np.flatnonzero(np.diff(kind == self.BLANK, prepend=True))
            runs = np.flatnonzero(data[edges[0::2]] == 0) * 2
            inside = np.zeros(len(data) + 1, np.int8)
            inside[edges[runs]], inside[edges[runs + 1]] = 1, -1
            kind[np.cumsum(inside[:-1], dtype=np.int8).view(bool)] = self.OTHER
        word = kind != self.BLANK
        first = word & ((np.diff(kind, prepend=np.uint8(self.BLANK)) != 0) | (kind == self.DIGIT))
        at = np.flatnonzero((data == ord("'")) & first & (kind == self.SIGN))
        one, two = data[at + 1], data[at + 2]
        short, long = np.isin(one, list(b"stmd")), (one == ord("l")) & (two == ord("l")) | (two == ord("e")) & ((one == ord("r")) | (one == ord("v")))
        for taken, size in ((at[short], 2), (at[long], 3)):
            first[taken + 1] = False
            first[taken + size] |= kind[taken + size] == self.LETTER
        starts = np.flatnonzero(first)
        before = np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in parts)]))
        offsets = np.append(np.flatnonzero(first[word]), np.count_nonzero(word))
        return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])]), before

    def _numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _at(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words one after the other, and where each of them ends there, from 0 on."""
        starts, sizes = np.frombuffer(self.starts, np.int64)[numbers], np.frombuffer(self.ends, np.int64)[numbers]
        sizes -= starts
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return np.frombuffer(self.flat, np.uint32)[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])], ends

    def _ids(self, words: list[str]) -> list[np.ndarray]:
        """Encode plain words many at a time: each ends with the only id that is marked as a word's end."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) == len(words) and ends[-1] == len(ids):
            return [ids, np.diff(ends, prepend=0)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return [np.array([i for f in found for i in f], np.uint32), np.array([len(f) for f in found])]

    def _learn(self) -> None:
        """Ids of the words that were numbered last."""
        words = list(islice(reversed(self.known), len(self.known) - len(self.starts)))[::-1]
        places = np.array([w[0] == "\0" for w in words])
        plain, other = [w for w in words if w[0] != "\0"], [w[1:] for w in words if w[0] == "\0"]
        parts = [self._ids(plain[at : at + 1000]) for at in range(0, len(plain), 1000)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)] if other else []
        parts.append([np.array([i for f in found for i in f], np.uint32), np.array([len(f) for f in found], np.int64)])
        ids, sizes = (np.concatenate(p) for p in zip(*parts))
        starts, ends = np.empty((2, len(words)), np.int64)
        places = np.argsort(places, kind="stable")  # plain words come first in ``ids``
        ends[places] = np.cumsum(sizes) + len(self.flat)
        starts[places] = ends[places] - sizes
        self.flat.frombytes(ids.tobytes())
        self.starts.frombytes(starts.tobytes())
        self.ends.frombytes(ends.tobytes())
        self.met.frombytes(bytes(4 * len(words)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHED:
            self._shrink()
        words, before = self._cut([self._marked(t) for t in texts])
        kinds = words.dictionary_encode()
        numbers = self._numbers(kinds.dictionary.to_numpy(zero_copy_only=False).tolist())
        if len(self.known) > len(self.starts):
            try:
                self._learn()
            except BaseException:
                self.forget()  # no word stays numbered without its ids
                raise
        np.frombuffer(self.met, np.uint32)[numbers] += 1
        ids, ends = self._at(numbers[kinds.indices.to_numpy()])
        cuts = ends[before]
        return [ids[i:j] for i, j in zip(cuts[:-1], cuts[1:])]


_encoders: dict[str, Encoder] = {}  # a worker that is used again keeps the words it has seen


def encoder(file: str) -> Encoder:
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


# --- jobs ---------------------------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs (doc_id, text)`` and write the ids; returns the files that count, in order by ``part, seq``.

    ``end_id`` follows the ids of each document. A null text is empty; null ids
    come first, rows of one id in the order of their texts, repeated rows each
    count. No rows give no files. A file is closed at ``file_ids`` ids.
    """
    small_batches(docs.sparkSession)
    rows = texts_of(docs).select(F.col("doc_id").cast("long"), "text")
    mark = F.xxhash64("text")  # rows of one id may be very many; equal texts may go anywhere among them
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), mark).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), mark, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        writer, done, end = Writer(), [], np.array([end_id], np.uint32)

        def close() -> None:
            path = f"{folder}/{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.ids"
            writer.write(path)
            done.append((part, len(done), path, len(writer.docs), writer.n_ids))

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                writer.add(doc_id, np.concatenate((ids, end)))
                if writer.n_ids >= file_ids:
                    close()
                    writer = Writer()
        if writer.docs:
            close()
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        columns = list(zip(*done)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "seq", "path", "n_docs", "n_ids"])

    return staged(rows.mapInArrow(run, FILES), "token-files")


def read_token_files(files: DataFrame, ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` of the documents in ``files``, a task a file.

    ``start`` counts the ids before the document over all files; that sum is
    made over the table of files, one row for each.
    """
    before = F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.select("path", F.coalesce(before, F.lit(0)).alias("start"))
    placed = placed.repartition(max(1, files.count()))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + (["ids"] if ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list) -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:4]]
            if ids:
                offsets = np.concatenate(([0], np.cumsum([len(r[4]) for r in rows])))
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([r[4] for r in rows]).astype(np.int32))))
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader, rows, held = Reader(path), [], 0
                for doc_id, parts in reader.documents():
                    crc, n = 0, sum(map(len, parts))
                    for p in parts:
                        crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                    rows.append((doc_id, start, n, crc) + ((np.concatenate(parts or [np.empty(0, np.uint32)]),) if ids else ()))
                    start, held = start + n, held + (n if ids else 1)
                    if held >= 1 << 18:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)
                reader.close()

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return placed.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, ids: bool = False) -> DataFrame:
    """Write the ids of ``docs`` and read them back, one row a document."""
    files = write_token_files(docs, folder or fresh_folder(docs.sparkSession, "ids"), tokenizer)
    return read_token_files(files, ids)
