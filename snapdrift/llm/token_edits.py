"""Token counts of texts under edits.

A text is a row of pre-tokens, each counted by itself. Its pre-tokens are the
leaves' contents of a segment tree whose nodes hold sums of characters and of
tokens. An edit finds its place by descending the tree, splits anew only from
the pre-token it can reach to where old boundaries are met again, and updates
the sums above the leaves it touched.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdrift.llm.common import small_batches

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REACH = 1  # characters after its end that a match of the pattern may have looked at beyond the next one
LEAF = 64
CACHED = 200_000
EDITS = "array<struct<start: long, stop: long, text: string>>"


class Counter:
    """Tokens of pre-tokens, each kind counted once."""

    def __init__(self, ranks: bytes) -> None:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        merges = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        self.split, self.cache = regex.compile(PATTERN), {}

    def count(self, pre_tokens: list[str]) -> list[int]:
        cache = self.cache
        if len(cache) > CACHED:
            cache.clear()
        encode = self.encoding.encode_ordinary
        for new in [t for t in set(pre_tokens) if t not in cache]:
            cache[new] = len(encode(new))
        return [cache[t] for t in pre_tokens]


class TokenTree:
    """The pre-tokens of one text with sums; ``chars`` and ``tokens`` are heaps whose node 1 is the root."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.text, self.counter, self.reencoded = text, counter, 0
        pre = counter.split.findall(text)
        self._build(list(map(len, pre)), counter.count(pre))

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, max(len(lengths), 1), LEAF)]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        sums = np.zeros((2, 2 * self.width), np.int64)
        sums[:, self.width : self.width + len(self.leaves)] = [[sum(leaf[k]) for leaf in self.leaves] for k in (0, 1)]
        w = self.width
        while w > 1:
            sums[:, w // 2 : w] = sums[:, w : 2 * w].reshape(2, -1, 2).sum(axis=2)
            w //= 2
        self.chars, self.tokens = sums.tolist()

    @classmethod
    def kept(cls, text: str, lengths: list[int], counts: list[int], counter: Counter) -> TokenTree:
        """The tree of a text whose pre-tokens' characters and tokens are known: nothing is encoded."""
        tree = cls.__new__(cls)
        tree.text, tree.counter, tree.reencoded = text, counter, 0
        tree._build(lengths, counts)
        return tree

    def columns(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of each pre-token, in order."""
        return [x for leaf in self.leaves for x in leaf[0]], [x for leaf in self.leaves for x in leaf[1]]

    def apply(self, edits: list[dict | None] | None) -> None:
        for e in edits or []:
            if e is not None and e["start"] is not None and e["stop"] is not None:
                self.edit(e["start"], e["stop"], e["text"] or "")

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def size(self) -> int:
        return sum(len(leaf[0]) for leaf in self.leaves)

    def _leaf_at(self, offset: int) -> tuple[int, int]:
        """The leaf of the character at ``offset`` (the last leaf at the end), and where it starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if offset >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return min(node - self.width, len(self.leaves) - 1), start

    def _update(self, leaf: int) -> None:
        node = self.width + leaf
        self.chars[node], self.tokens[node] = sum(self.leaves[leaf][0]), sum(self.leaves[leaf][1])
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, stop: int, insert: str) -> None:
        """Replace characters ``start`` to ``stop`` by ``insert``; places outside the text are drawn to its ends."""
        n = len(self.text)
        start = min(max(start, 0), n)
        stop = min(max(stop, start), n)
        shift = len(insert) - (stop - start)
        self.text = self.text[:start] + insert + self.text[stop:]
        # the first pre-token whose match may have seen the edit ends at start - REACH or later
        first, at = self._leaf_at(max(start - REACH - 1, 0))
        skip = 0
        for length in self.leaves[first][0]:
            if at + length >= start - REACH:
                break
            at += length
            skip += 1
        # old boundaries from the end of the edit on, walked along with the new ones
        leaf, place, old, settled = first, skip, at, stop
        pre, here = [], at
        met = False
        for match in self.counter.split.finditer(self.text, at):
            here = match.start()
            while here >= start + len(insert) and old + shift < here or old < settled:
                while leaf < len(self.leaves) and place >= len(self.leaves[leaf][0]):
                    leaf, place = leaf + 1, 0
                if leaf >= len(self.leaves):
                    break
                old += self.leaves[leaf][0][place]
                place += 1
            if here >= start + len(insert) and old >= settled and old + shift == here:
                met = True
                break
            pre.append(match.group())
        if not met:
            leaf, place = len(self.leaves) - 1, len(self.leaves[-1][0])
        elif leaf >= len(self.leaves):
            leaf, place = len(self.leaves) - 1, len(self.leaves[-1][0])
        self.reencoded += len(pre)
        new = list(map(len, pre)), self.counter.count(pre)
        tail = tuple(column[place:] for column in self.leaves[leaf])
        self.leaves[first] = tuple(self.leaves[first][k][:skip] + new[k] + tail[k] for k in (0, 1))
        for gone in range(first + 1, leaf + 1):
            self.leaves[gone] = [], []
            self._update(gone)
        self._update(first)
        if len(self.leaves[first][0]) > 4 * LEAF:  # too full: deal the pre-tokens out anew, no encoding
            self._build(*([x for own in self.leaves for x in own[k]] for k in (0, 1)))


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs (doc_id, text)`` with the array ``edits`` of ``edits (doc_id, seq, start, stop, text)`` in order of ``seq``.

    Edits of a document follow each other, so they are gathered with it; ties
    of ``seq`` are taken by place and text.
    """
    one = F.struct("seq", "start", "stop", "text")
    listed = edits.where("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("edits"))
    cut = F.transform("edits", lambda e: F.struct(e["start"].cast("long").alias("start"), e["stop"].cast("long").alias("stop"), e["text"].alias("text")))
    own = docs.select(docs["doc_id"], docs["text"])
    return own.join(listed.select("doc_id", cut.alias("edits")), "doc_id", "left")


def count_edited(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """Token counts of ``docs (doc_id, text, edits)`` before and after its edits.

    Columns: ``doc_id, n_pretokens, n_tokens, n_tokens_edited, n_reencoded,
    leaves``; ``leaves`` are the token sums at the leaves of the tree after the
    edits. Edits are applied in turn, each to the text the one before left,
    offsets in code points, drawn to the ends of the text where beyond; an edit
    without ``start`` or ``stop`` does nothing, one without ``text`` deletes.
    A null text is empty, null edits are none; repeated rows and null ids come
    out as they came in. The rank file, of fixed size, is sent with the tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(path, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value)
        for batch in batches:
            rows = []
            for text, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tree = TokenTree(text, counter)
                before = tree.size, tree.total
                tree.apply(edits)
                rows.append((*before, tree.total, tree.reencoded, [sum(leaf[1]) for leaf in tree.leaves]))
            columns = [[r[i] for r in rows] for i in range(5)]
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_pretokens", "n_tokens", "n_tokens_edited", "n_reencoded", "leaves"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(docs["text"], F.lit("")).alias("text")
    own = docs.select(docs["doc_id"], text, docs["edits"].cast(EDITS).alias("edits"))
    schema = f"doc_id {kind}, n_pretokens long, n_tokens long, n_tokens_edited long, n_reencoded long, leaves array<long>"
    return own.mapInArrow(run, schema)


# --- kept trees ---------------------------------------------------------------------------------------------------

STATE = "text string, lengths binary, counts binary, n_tokens long, n_reencoded long"
_STATE = [c.split()[0] for c in STATE.split(", ")]


def _state_rows(keys: pa.Array, trees: list[TokenTree]) -> pa.RecordBatch:
    packed = [[np.array(c, np.int32).tobytes() for c in t.columns()] for t in trees]
    columns = [
        pa.array([t.text for t in trees], pa.string()), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary()),
        pa.array([t.total for t in trees], pa.int64()), pa.array([t.reencoded for t in trees], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays([keys, *columns], ["doc_id", *_STATE])


def _ranks(spark, path: str):
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def token_state(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """The trees of ``docs (doc_id, text)`` as a table to be kept: each text with its pre-tokens' characters and tokens.

    A null text is empty. Ids are to be unique; rows without one can't be edited later.
    """
    small_batches(docs.sparkSession)
    ranks = _ranks(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value)
        for batch in batches:
            trees = [TokenTree(t, counter) for t in batch.column(1).to_pylist()]
            for tree in trees:
                tree.reencoded = tree.size
            yield _state_rows(batch.column(0), trees)

    own = docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"))
    return own.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {STATE}")


def apply_edits(state: DataFrame, edits: DataFrame, path: str = RANKS) -> DataFrame:
    """The rows of :func:`token_state` that ``edits (doc_id, seq, start, stop, text)`` change, as they are afterwards.

    Only what an edit can reach is split and counted anew, which ``n_reencoded``
    counts in pre-tokens; the rest of a text comes from its row. Edits of ids
    that the state does not hold do nothing. :func:`updated` puts the rows back.
    """
    small_batches(state.sparkSession)
    ranks = _ranks(state.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value)
        for batch in batches:
            trees = []
            for text, lengths, counts, listed in zip(*(c.to_pylist() for c in batch.columns[1:])):
                tree = TokenTree.kept(text, *(np.frombuffer(b, np.int32).tolist() for b in (lengths, counts)), counter)
                tree.apply(listed)
                trees.append(tree)
            yield _state_rows(batch.column(0), trees)

    listed = with_edits(state, edits).where("edits IS NOT NULL").select("doc_id", "edits")
    rows = state.select("doc_id", "text", "lengths", "counts").join(listed, "doc_id").select("doc_id", "text", "lengths", "counts", F.col("edits").cast(EDITS))
    return rows.mapInArrow(run, f"doc_id {state.schema['doc_id'].dataType.simpleString()}, {STATE}")


def updated(state: DataFrame, changed: DataFrame) -> DataFrame:
    """``state`` with the rows of ``changed`` in place of its own; write it to a new folder."""
    return state.join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(changed)
