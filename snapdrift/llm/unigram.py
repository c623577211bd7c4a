"""Unigram encoding and decoding: Viterbi over a double-array trie of pieces with log scores.

White space becomes a marker, a marker is put in front, and the best sum of
scores wins; of equal sums the one whose last piece starts first. A character
that is no piece becomes its bytes. As no piece has a marker after another
character, the best path of a text is that of its words, so distinct words are
encoded once, all words of a batch in step.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdrift.llm.common import small_batches, texts_of

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
LONG = 64  # bytes of a word above which it is walked by itself
CACHED = 300_000  # words


@dataclass(frozen=True)
class Pieces:
    """Bytes, log scores and kinds (normal, byte, other) of pieces, by id."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    kinds: np.ndarray


@dataclass(frozen=True)
class Trie:
    """A double array over bytes: the child of ``s`` by ``c`` is ``base[s] + c + 1`` if its ``check`` is ``s``."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def zipf_scores(ranks: np.ndarray) -> np.ndarray:
    """Log probabilities that fall with the rank, for vocabularies that tell only an order."""
    p = 1.0 / (ranks + 2.7)
    return np.log(p / p.sum())


@lru_cache(maxsize=2)
def load(path: str = MODEL) -> Pieces:
    """Pieces of a SentencePiece file. Scores that are merge ranks (whole numbers) become log probabilities by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    kinds = np.array([1 if model.is_byte(i) else 2 if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else 0 for i in range(n)])
    pieces = [model.id_to_piece(i) for i in range(n)]
    scores = np.array([model.get_score(i) for i in range(n)])
    normal = np.flatnonzero(kinds == 0)
    if np.array_equal(scores[normal], np.round(scores[normal])):
        rank = np.empty(len(normal))
        rank[np.argsort(-scores[normal], kind="stable")] = np.arange(len(normal))
        scores[normal] = zipf_scores(rank)
    byte_ids = np.full(256, -1)
    for i in np.flatnonzero(kinds == 1):
        byte_ids[int(pieces[i][3:5], 16)] = i
    return Pieces([p.encode() for p in pieces], scores, byte_ids, kinds)


def build_trie(pieces: Pieces) -> Trie:
    """First fit, level by level; nodes of many children skip what is nearly full."""
    root: dict = {}
    for i in np.flatnonzero(pieces.kinds == 0).tolist():
        node = root
        for c in pieces.pieces[i]:
            node = node.setdefault(c, {})
        node[-1] = i
    size = 1 << 16
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0], free, wide, todo = 0, 257, 257, deque([(root, 0)])
    while todo:
        node, s = todo.popleft()
        value[s] = node.get(-1, -1)
        keys = sorted(c for c in node if c >= 0)
        if not keys:
            continue
        while check[free] >= 0:
            free += 1
        spot = first = free if len(keys) == 1 else max(wide, free)
        while True:
            if spot + 512 > len(check):
                base += [0] * size
                check += [-1] * size
                value += [-1] * size
            b = spot - keys[0] - 1
            if check[spot] < 0 and all(check[b + c + 1] < 0 for c in keys):
                break
            spot += 1
        if len(keys) > 1 and spot - first > 64:  # what lies before is nearly full
            wide = spot - 64
        base[s] = b
        for c in keys:
            check[b + c + 1] = s
        todo.extend((node[c], b + c + 1) for c in keys)
    return Trie(np.array(base + [0] * 257), np.array(check + [-1] * 257), np.array(value + [-1] * 257))


def _width(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Encoder:
    """Encodes words (bytes with markers) and texts; keeps words it has met."""

    def __init__(self, pieces: Pieces, trie: Trie) -> None:
        self.pieces, self.trie = pieces, trie
        normal = pieces.scores[pieces.kinds == 0]
        self.unknown = float(normal.min() if len(normal) else 0.0) - UNKNOWN_PENALTY
        self.cache: dict[str, bytes] = {}
        crosses = any(re.search(f"[^{MARK}]{MARK}", pieces.pieces[i].decode()) for i in np.flatnonzero(pieces.kinds == 0))
        self.words = re.compile(r"(?s).+" if crosses else f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def _ids(self, word: bytes, back: list[int], piece: list[int]) -> bytes:
        out, end = [], len(word)
        while end:
            start = back[end]
            if piece[end] >= 0:
                out.append(piece[end])
            else:
                out += [int(self.pieces.byte_ids[c]) for c in reversed(word[start:end])]
            end = start
        return np.array(out[::-1], np.int32).tobytes()

    def walk(self, word: bytes) -> bytes:
        """Viterbi over one word, however long."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n = len(word)
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            if word[i] & 0xC0 == 0x80:
                continue
            single, s, j = i + _width(word[i]), 0, i
            known = False
            while j < n:
                t = int(base[s]) + word[j] + 1
                if check[t] != s:
                    break
                s, j = t, j + 1
                v = int(value[s])
                if v >= 0:
                    known |= j == single
                    score = best[i] + float(self.pieces.scores[v])
                    if score > best[j]:
                        best[j], back[j], piece[j] = score, i, v
            if not known and best[i] + self.unknown > best[single]:
                best[single], back[single], piece[single] = best[i] + self.unknown, i, -1
        return self._ids(word, back, piece)

    def together(self, words: list[bytes]) -> list[bytes]:
        """Viterbi over words of one length, in step."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.pieces.scores
        codes = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1).astype(np.int64)
        m, n = codes.shape
        best, back, piece = np.full((n + 1, m), -np.inf), np.zeros((n + 1, m), np.int64), np.full((n + 1, m), -1)
        best[0] = 0
        for i in range(n):
            lead = codes[:, i]
            live = np.flatnonzero((lead & 0xC0) != 0x80)
            single = i + 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
            state, known, at = np.zeros(len(live), np.int64), np.zeros(m, bool), live
            for j in range(i, n):
                step = base[state] + codes[at, j] + 1
                go = check[step] == state
                at, state = at[go], step[go]
                if not len(at):
                    break
                v = value[state]
                end = v >= 0
                rows, v = at[end], v[end]
                known[rows[single[rows] == j + 1]] = True
                score = best[i, rows] + scores[v]
                more = score > best[j + 1, rows]
                rows = rows[more]
                best[j + 1, rows], back[j + 1, rows], piece[j + 1, rows] = score[more], i, v[more]
            lone = live[~known[live]]
            if len(lone):
                score = best[i, lone] + self.unknown
                more = score > best[single[lone], lone]
                rows = lone[more]
                best[single[rows], rows], back[single[rows], rows], piece[single[rows], rows] = score[more], i, -1
        return [self._ids(w, b, p) for w, b, p in zip(words, back.T.tolist(), piece.T.tolist())]

    def learn(self, words: set[str]) -> None:
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for pair in ((w, w.encode()) for w in words):
            by_length.setdefault(len(pair[1]), []).append(pair)
        for length, pairs in by_length.items():
            if length > LONG or len(pairs) < 4:
                self.cache.update((w, self.walk(b)) for w, b in pairs)
            else:
                self.cache.update(zip([w for w, _ in pairs], self.together([b for _, b in pairs])))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        split = [self.words(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        self.learn({w for w in set().union(*split) if w not in self.cache})
        cache = self.cache
        return [np.frombuffer(b"".join([cache[w] for w in words]), np.int32) for words in split]


def decode_ids(ids: list[int], parts: list[bytes]) -> str:
    text = b"".join([parts[i] for i in ids]).decode(errors="replace")
    return text[1:] if text.startswith(" ") else text


def plain_parts(pieces: Pieces) -> list[bytes]:
    """What each id stands for in decoded text; markers are spaces, control pieces nothing."""
    mark = MARK.encode()
    return [p.replace(mark, b" ") if k == 0 else bytes([int(p[3:5], 16)]) if k == 1 else b"" for p, k in zip(pieces.pieces, pieces.kinds)]


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, text, ids`` for each row of ``docs (doc_id, text)``; a null or empty text has no ids.

    The vocabulary (a file of fixed size) is read by the driver and sent with
    the tasks. Repeated rows and null ids come out as they came in.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = load(path)
    sent = spark.sparkContext.broadcast((pieces, build_trie(pieces)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*sent.value)
        for batch in batches:
            ids = encoder.encode(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "text", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts_of(docs).mapInArrow(run, f"doc_id {kind}, text string, ids array<int>")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``encoded`` (any columns, with ``ids array<int>``) with ``decoded``; null ids give a null text.

    Bytes that are no UTF-8 become U+FFFD. A text comes back as it was, but a
    marker in it, which the vocabulary can't tell from a space, comes as a space.
    """
    spark = encoded.sparkSession
    parts = spark.sparkContext.broadcast(plain_parts(load(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [None if ids is None else decode_ids(ids, parts.value) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.string())], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, decoded string")


def round_trip(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, ids, decoded, exact``: whether decoding gives the text back, markers as spaces."""
    both = decode(encode(docs, path), path)
    return both.select("doc_id", "ids", "decoded", (F.col("decoded") == F.replace(F.col("text"), F.lit(MARK), F.lit(" "))).alias("exact"))
