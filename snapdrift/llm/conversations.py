"""Conversations brought back to the form ``(s?(ua)+)?`` by the cheapest edits.

Rows of a conversation are read in order by a program of four states: nothing
yet, after system, after user, after assistant. Each state keeps its cheapest
audit, the initials of the edits so far: **K**eep, **R**erole, **D**elete,
**I**nsert. Audits of the states share their beginnings: an edit is a node below
the audit that it goes on, with its ancestors at powers of two and a rolling
hash of all edits down to it. Of equally cheap audits the least counts; where two
first differ is searched along those ancestors by hash, and nodes of equal hash
are compared before the answer is used.

A conversation may be of any length. Rows are dealt by ranges of (conversation,
turn) and read in blocks; a block that may not be a whole conversation gives the
cheapest audit from each state to each, and those are put together block by
block, as short rows. Only the hash of the repaired text is made in one task a
conversation, as it must be: it reads the text of one block at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from snapdrift.llm.common import small_batches, staged

BLOCK_ROWS = 1 << 15
BLOCK_CHARS = 1 << 24
CACHED = 100_000
SPACE = " \t\n\x0b\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
TURN = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # where a rerole or an insertion leads
ROLE = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5


class Audits:
    """A tree of edits; a node stands for the edits from the root down to it."""

    def __init__(self, modulus: int = (1 << 61) - 1, base: int = 1_000_003) -> None:
        self.modulus, self.base = modulus, base
        self.parent, self.edit, self.depth, self.hash, self.up = [0], [""], [0], [0], [[]]

    def add(self, node: int, edit: str) -> int:
        new, up, k = len(self.parent), [node], 0
        while k < len(self.up[up[k]]):  # the ancestor 2^k above, and from there 2^k more
            up.append(self.up[up[k]][k])
            k += 1
        self.parent.append(node)
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.base + ord(edit)) % self.modulus)
        self.up.append(up)
        return new

    def ancestor(self, node: int, depth: int) -> int:
        above = self.depth[node] - depth
        while above:
            k = above.bit_length() - 1
            node, above = self.up[node][k], above - (1 << k)
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.parent[node]
        return "".join(reversed(out))

    def _same(self, a: int, b: int) -> bool:
        """Whether nodes of one depth stand for the same edits, whatever their hashes say."""
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.parent[a], self.parent[b]
        return True

    def less(self, a: int, x: str, b: int, y: str) -> bool:
        """Whether the edits of ``a`` and then ``x`` come before those of ``b`` and then ``y``."""
        if a == b:
            return x < y
        common = min(self.depth[a], self.depth[b])
        p, q = self.ancestor(a, common), self.ancestor(b, common)
        if self.hash[p] == self.hash[q]:  # one goes on from the other
            left = x if self.depth[a] == common else self.edit[self.ancestor(a, common + 1)]
            right = y if self.depth[b] == common else self.edit[self.ancestor(b, common + 1)]
        else:
            for k in range(len(self.up[p]) - 1, -1, -1):
                if k < len(self.up[p]) and self.hash[self.up[p][k]] != self.hash[self.up[q][k]]:
                    p, q = self.up[p][k], self.up[q][k]
            left, right = self.edit[p], self.edit[q]
            p, q = self.parent[p], self.parent[q]
        if left != right and self._same(p, q):
            return left < right
        return self.text(a) + x < self.text(b) + y  # hashes of different edits met


def cheapest(symbols: str, state: int = START, whole: bool = True, modulus: int = (1 << 61) - 1) -> dict[int, tuple[int, str]]:
    """``state: (cost, audit)`` after rows of ``symbols``, from ``state``.

    A symbol is the initial of a role, ``o`` for any other, in upper case if the
    row is truncated, and ``x`` for a row that must go. Rows are inserted after
    each row and, at the beginning of a ``whole`` conversation, before the first.
    """
    audits, now = Audits(modulus), {state: (0, 0)}

    def offer(best: dict, to: int, cost: int, node: int, edit: str) -> None:
        old = best.get(to)
        if old is None or cost < old[0] or cost == old[0] and audits.less(node, edit, *old[1:]):
            best[to] = cost, node, edit

    def insertions(now: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
        for to, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            best = {}
            for s in sources:
                if s in now:
                    offer(best, to, now[s][0] + INSERT, now[s][1], "I")
            if to in best:
                cost, node, edit = best[to]
                old = now.get(to)
                if old is None or cost < old[0] or cost == old[0] and audits.less(node, edit, audits.parent[old[1]], audits.edit[old[1]]):
                    now[to] = cost, audits.add(node, edit)
        return now

    now = insertions(now) if whole else now
    for symbol in symbols:
        best = {}
        for s, (cost, node) in now.items():
            offer(best, s, cost + DELETE, node, "D")
            if symbol != "x":
                more = TRUNCATED if symbol.isupper() else 0
                to = AFTER.get(symbol.lower(), {}).get(s)
                if to is not None:
                    offer(best, to, cost + more, node, "K")
                if s in TURN and TURN[s] != to:
                    offer(best, TURN[s], cost + more + REROLE, node, "R")
        now = insertions({s: (cost, audits.add(node, edit)) for s, (cost, node, edit) in best.items()})
    return {s: (cost, audits.text(node)) for s, (cost, node) in now.items()}


def best_of(ends: dict[int, tuple[int, str]]) -> tuple[int, str]:
    return min(ends[s] for s in FINAL if s in ends)


def repaired(audit: str, rows: list[tuple[str, str]], state: int = START) -> list[str]:
    """The lines ``role:text`` that ``audit`` makes of ``rows (role, text)``."""
    out, rest = [], iter(rows)
    for edit in audit:
        if edit == "I":
            state = TURN[state]
            out.append(f"{ROLE[state]}:")
            continue
        role, text = next(rest)
        if edit == "K":
            state = AFTER[role[:1]][state]
        elif edit == "R":
            state = TURN[state]
            role = ROLE[state]
        if edit != "D":
            out.append(f"{role}:{text}")
    return out


# --- jobs ---------------------------------------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows damaged by the remainder of a checksum of their place.

    A null counts as one space wherever a text is read, ``turn`` stays null. Of
    20 remainders 0 drops a row, 1 empties its text, 2 takes ``.!?`` out, 3
    repeats it, 4 makes it the user's.
    """
    word = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")), F.lit(20))
    marked = rows.select("conv_id", rows["turn"].cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    return marked.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def undamaged(rows: DataFrame) -> DataFrame:
    """The same columns of rows as they are."""
    text = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", rows["turn"].cast("long").alias("turn"), text("role"), text("text"), F.lit(1).alias("copies"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with their own fault and whether an earlier turn has them, dealt and sorted by place.

    The texts that a conversation has in several turns are found from their
    digests, folded before they are shuffled.
    """
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))
    spread = rows.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    spread = spread.where("first <> last").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    met = rows["conv_id"].eqNullSafe(spread["c"]) & (rows["role"] == spread["r"]) & (rows["digest"] == spread["d"])
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(end == "", "b").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    seen = F.coalesce(F.col("first") < place, F.lit(False))
    rows = rows.join(spread, met, "left").select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"), seen.alias("seen"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    # rows of one turn may be very many: they are dealt by how their texts begin, in the same order
    return rows.repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")


COUNTS = ("n_turns", "blank", "duplicate", "truncated", "illegal")
TALLY = (*COUNTS, "min_turn", "max_turn")
TALLIES = ", ".join(f"{c} long" for c in TALLY)
ENDS = "array<struct<state: int, to: int, cost: long, audit: string>>"
BLOCKS = f"part int, seq int, {TALLIES}, cost long, audit string, repaired_sha256 string, head string, tail string, ends {ENDS}, roles array<string>, texts array<string>"
LINKS = f"part int, seq int, state int, piece string, {TALLIES}, cost long, audit string"
LEGAL = {"su", "ua", "au"}


def _kind(rows: DataFrame) -> str:
    return f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"


class _Block:
    """Rows of one conversation, in order."""

    def __init__(self) -> None:
        self.rows, self.symbols, self.turns, self.chars = [], [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, fault: str, seen: bool) -> None:
        first = role[:1]
        symbol = first if first in ("s", "u", "a") else "o"
        if fault == "b":
            self.blank += 1
            symbol = "x"
        elif seen:
            self.duplicate += 1
            symbol = "x"
        elif fault == "t":
            self.truncated += 1
            symbol = symbol.upper()
        self.illegal += bool(self.rows) and self.rows[-1][0][:1] + first not in LEGAL
        self.rows.append((role, text))
        self.symbols.append(symbol)
        self.chars += len(text)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def full(self, rows: int) -> bool:
        return len(self.rows) >= rows or self.chars >= BLOCK_CHARS

    def tally(self) -> dict:
        low, high = (self.turns[0], self.turns[-1]) if self.turns else (None, None)
        counts = len(self.turns), self.blank, self.duplicate, self.truncated, self.illegal
        return dict(zip(TALLY, (*counts, low, high)))

    def ends(self) -> dict:
        """What is needed to put this block together with others."""
        symbols = "".join(self.symbols)
        ends = [
            {"state": s, "to": t, "cost": cost, "audit": audit}
            for s in range(4)
            for t, (cost, audit) in cheapest(symbols, s, whole=False).items()
        ]
        roles, texts = (list(c) for c in zip(*self.rows))
        return {"head": roles[0][:1], "tail": roles[-1][:1], "ends": ends, "roles": roles, "texts": texts}


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Whole conversations finished; of those at the edges of a task or of many rows, blocks to be put together."""
    ddl = f"{_kind(rows)}, {BLOCKS}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out, known = TaskContext.get().partitionId(), 0, [], {}
        block, conv, last, cut = _Block(), None, None, True

        def finished() -> dict:
            symbols = "".join(block.symbols)
            if symbols not in known:
                if len(known) >= CACHED:
                    known.clear()
                known[symbols] = best_of(cheapest(symbols))
            cost, audit = known[symbols]
            lines = "\n".join(repaired(audit, block.rows))
            return {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(lines.encode()).hexdigest()}

        def close(whole: bool) -> None:
            nonlocal seq, block
            out.append({"conv_id": conv, "part": part, "seq": seq, **block.tally(), **(finished() if whole else block.ends())})
            seq, block = seq + 1, _Block()

        for batch in batches:
            for conv_id, turn, role, text, copies, fault, seen in zip(*(c.to_pylist() for c in batch.columns)):
                if last is None or conv_id != conv:
                    if last is not None:
                        close(not cut)  # the first one may have begun in another task
                        cut = False
                    conv, last = conv_id, None
                for _ in range(copies):
                    if block.full(block_rows):
                        close(False)
                        cut = True
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out.clear()
                    row = turn, role, text
                    block.add(*row, fault, seen or row == last)
                    last = row
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        if block.rows:
            close(False)
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, ddl)


class _Rope:
    """An audit as segments, one a block, that share their beginnings; ``state`` is the one it ends in."""

    __slots__ = ("before", "segment", "state")

    def __init__(self, before: _Rope | None, segment: str, state: int) -> None:
        self.before, self.segment, self.state = before, segment, state

    def less(self, other: _Rope) -> bool:
        """Whether this audit comes before ``other``, one of as many segments."""
        a, b, left, right = self, other, [], []
        while a is not b:
            left.append(a.segment)
            right.append(b.segment)
            a, b = a.before, b.before
        return "".join(reversed(left)) < "".join(reversed(right))


def _better(new: tuple[int, _Rope], old: tuple[int, _Rope] | None) -> bool:
    return old is None or new[0] < old[0] or new[0] == old[0] and new[1].less(old[1])


class _Chain:
    """Blocks of one conversation, put together in order."""

    def __init__(self) -> None:
        root = _Rope(None, "", START)
        self.now = {s: (cost, _Rope(root, audit, s)) for s, (cost, audit) in cheapest("").items()}
        self.total = dict.fromkeys(COUNTS, 0) | {"min_turn": None, "max_turn": None}
        self.places, self.tail = [], None

    def add(self, row: dict) -> None:
        total = self.total
        for c in COUNTS:
            total[c] += row[c]
        if row["min_turn"] is not None:
            total["n_turns"] -= total["max_turn"] == row["min_turn"]
            total["min_turn"] = row["min_turn"] if total["min_turn"] is None else total["min_turn"]
            total["max_turn"] = row["max_turn"]
        total["illegal"] += self.tail is not None and self.tail + row["head"] not in LEGAL
        self.tail = row["tail"]
        self.places.append((row["part"], row["seq"]))
        best: dict[int, tuple[int, _Rope]] = {}
        for e in row["ends"]:
            if e["state"] in self.now:
                cost, rope = self.now[e["state"]]
                new = cost + e["cost"], _Rope(rope, e["audit"], e["to"])
                if _better(new, best.get(e["to"])):
                    best[e["to"]] = new
        self.now = best

    def rows(self) -> list[dict]:
        """A row for each block, with the state before it and its part of the audit, and one of the whole."""
        best = None
        for s in FINAL:
            if s in self.now and _better(self.now[s], best):
                best = self.now[s]
        pieces, rope = [], best[1]
        while rope.before is not None:
            pieces.append((rope.before.state, rope.segment))
            rope = rope.before
        lead, *pieces = reversed(pieces)
        pieces[0] = START, lead[1] + pieces[0][1]  # what is inserted before the first row
        out = [{"part": p, "seq": q, "state": s, "piece": a} for (p, q), (s, a) in zip(self.places, pieces)]
        return [*out, {**self.total, "cost": best[0], "audit": "".join(a for _, a in pieces)}]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Rows of sorted batches by conversation."""
    rows = (dict(zip(b.schema.names, r)) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    return groupby(rows, key=lambda r: r["conv_id"])


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "seq")


def _linked(blocks: DataFrame) -> DataFrame:
    """Of each block the state before it and its part of the audit; of each conversation, without a place, the rest."""
    ddl = f"{_kind(blocks)}, {LINKS}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, rows in _runs(batches):
            chain = _Chain()
            for row in rows:
                chain.add(row)
            yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, **r} for r in chain.rows()], schema=schema)

    return _dealt(blocks.select("conv_id", "part", "seq", *TALLY, "head", "tail", "ends")).mapInArrow(run, ddl)


def _hashed(blocks: DataFrame, pieces: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: lines of blocks are made apart, then hashed in order."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                "\n".join(repaired(piece, list(zip(roles, texts)), state))
                for roles, texts, state, piece in zip(*(batch.column(c).to_pylist() for c in ("roles", "texts", "state", "piece")))
            ]
            kept = [batch.column(c) for c in ("conv_id", "part", "seq")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(made, pa.string())], ["conv_id", "part", "seq", "lines"])

    kind = _kind(blocks)
    schema = to_arrow_schema(StructType.fromDDL(f"{kind}, repaired_sha256 string"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, rows in _runs(batches):
            made, some = hashlib.sha256(), False
            for row in rows:
                if row["lines"]:  # a line has a colon at least
                    made.update((("\n" if some else "") + row["lines"]).encode())
                    some = True
            yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "repaired_sha256": made.hexdigest()}], schema=schema)

    both = blocks.select("conv_id", "part", "seq", "roles", "texts").join(pieces.select("part", "seq", "state", "piece"), ["part", "seq"])
    both = both.select("conv_id", "part", "seq", "roles", "texts", "state", "piece")
    return _dealt(both.mapInArrow(lines, f"{kind}, part int, seq int, lines string")).mapInArrow(digest, f"{kind}, repaired_sha256 string")


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Faults, cheapest edits and the hash of the repaired lines of each conversation of ``conv_id, turn, role, text, copies``.

    Rows come in the order of ``turn`` (nulls first), then role, then text; a
    null ``conv_id`` is a conversation of its own. A row of a role without
    letters has no initial, so it is illegal beside any other and can't be kept.
    Other columns do not matter. Conversations without rows have no result.
    """
    small_batches(rows.sparkSession)
    made = staged(_blocks(_ordered(rows), block_rows), "conversations")
    blocks = made.where("cost IS NULL")
    linked = staged(_linked(blocks), "conversation-links")
    hashed = _hashed(blocks, linked.where("part IS NOT NULL")).withColumnRenamed("conv_id", "c")
    totals = linked.where("part IS NULL")
    joined = totals.join(hashed, totals["conv_id"].eqNullSafe(hashed["c"]))
    columns = ["conv_id", *TALLY, "cost", "audit", "repaired_sha256"]
    done = made.where("cost IS NOT NULL").select(*columns).unionByName(joined.select(*columns))
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns"), F.lit(0))
    return done.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def audit_damaged(conversations: DataFrame) -> DataFrame:
    """:func:`repair` of damaged ``conversations``, one row for each id; ids without rows left have zeros."""
    found = repair(damage(conversations))
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    joined = ids.join(found, ids["id"].eqNullSafe(found["conv_id"]), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit(""), 256)
    return joined.select(
        F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256")
    )
