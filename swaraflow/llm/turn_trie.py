r"""A prefix trie of conversations by LCP-aware external mergesort.

A conversation is a path: 16 bytes for each turn, a digest of role and text, so
paths compare as their bytes do and the texts stay where they were read.  The order
is by path, then by id: it is total, so a conversation that a third of all share is
cut like any other range.

1. Each task sorts its paths in runs of bounded size.  A row of a run carries its
   LCP, the number of turns that it shares with the row before it.  The runs are a
   table in the shared folder.
2. The order is cut into ranges of bounded size.  A task takes its part of each run
   and merges them by a tree of losers that keeps, for each run, the LCP with the
   last row put out: of two rows the one that shares more is the smaller, and only
   equal LCPs call for a comparison, which begins behind the shared turns.
3. The merged stream drives a stack of the nodes on the current path.  A node is
   finished when the stream leaves it, and is then put out.  Nodes on the first or
   the last path of a range may go on in its neighbours; of them a range gives its
   share only.
4. The shares, one for each turn of two paths a range, meet in one task, in order,
   on a stack of the same kind; it holds a path at a time.  Ids that end in such a
   node come along in pieces and are hashed as they come: SHA-256 has no other way.

Defined results: turns with null ids are left out; null roles and texts are empty
ones; null turn numbers come first and equal ones follow by role, then by digest;
repeated turns are turns of their own; ids are integers; further columns, whatever
their names, are ignored; an empty table has no nodes, not even a root.  A
conversation is one row, of about 24 bytes for each of its turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .memory import trimmed
from .store import materialize
from .words import WORD_PATTERN

Batches = Iterator[pa.RecordBatch]
Row = tuple[bytes, int, np.ndarray, int]  # path, id, words of each turn, LCP

#: Bytes of a turn in a path.
TURN = 16
RUN_ROWS, RUN_TURNS = 65_536, 524_288
RANGE_ROWS, RANGE_TURNS, LEAST_RANGE_ROWS = 32_768, 262_144, 1_024
#: Ids in one piece of a list of ends.
PIECE = 1_024
WHOLE, FIRST, LAST, MORE_ENDS = 0, 1, 2, 3


def _turns(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in (role, text))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.select(F.col(conv_id).cast("bigint").alias("conv"), F.col(turn).alias("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD_PATTERN)).alias("words"))
    return rows.filter("conv is not null")


def _path(turns: Column) -> list[Column]:
    return [F.unhex(F.array_join(F.transform(turns, lambda t: t["digest"]), "")).alias("path"), F.transform(turns, lambda t: t["words"]).alias("words")]


def paths(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, path, words`` of each conversation as it stands."""
    grouped = _turns(turns, conv_id, turn, role, text).groupBy("conv").agg(_in_order())
    return grouped.select("conv", *_path(F.col("turns")))


def _in_order() -> Column:
    return F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "words"))).alias("turns")


def branched_paths(turns: DataFrame, family: int = 20, most: int = 3, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, path, words`` with the first turns taken from the first conversation of each ``family`` ids.

    Conversation c begins with the first h turns of c - c % family (all if fewer,
    none if it is absent), then goes on with its own after its first h; h is the
    checksum of its decimal id modulo ``most`` + 1.  One shuffle: by family.
    """
    rows = _turns(turns, conv_id, turn, role, text).withColumn("donor", F.col("conv") - F.col("conv") % family)
    grouped = rows.repartition("donor").groupBy("donor", "conv").agg(_in_order())
    head = F.max(F.when(F.col("conv") == F.col("donor"), F.slice("turns", 1, most))).over(Window.partitionBy("donor"))
    h = (F.crc32(F.col("conv").cast("string")) % (most + 1)).cast("int")
    built = F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    return grouped.withColumns({"head": head, "h": h}).select("conv", *_path(built))


def common_turns(a: bytes, b: bytes, start: int = 0) -> int:
    """How many turns two paths begin with alike; the first ``start`` are known to be."""
    most = min(len(a), len(b)) // TURN
    if a[start * TURN : most * TURN] == b[start * TURN : most * TURN]:
        return most
    while a[start * TURN : start * TURN + TURN] == b[start * TURN : start * TURN + TURN]:
        start += 1
    return start


class LoserTree:
    """Merges sorted runs of rows with LCPs; iterates over rows whose LCP is with the row put out before."""

    def __init__(self, runs: list[Iterable[Row]]):
        self.runs = [iter(r) for r in runs]
        self.width = 1
        while self.width < len(runs):
            self.width *= 2
        self.heads: list[Row | None] = [next(r, None) for r in self.runs] + [None] * (self.width - len(runs))
        self.shared = [0] * self.width
        self.losers = [-1] * self.width
        self.top = self._first(1)

    def _first(self, place: int) -> int:
        if place >= self.width:
            return place - self.width
        winner, self.losers[place] = self._play(self._first(2 * place), self._first(2 * place + 1))
        return winner

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs' heads."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if self.shared[a] != self.shared[b]:  # what shares more with the last row out is the smaller
            return (a, b) if self.shared[a] > self.shared[b] else (b, a)
        alike = common_turns(x[0], y[0], self.shared[a])
        at = slice(alike * TURN, alike * TURN + TURN)
        winner, loser = (a, b) if (x[0][at], x[1]) < (y[0][at], y[1]) else (b, a)
        self.shared[loser] = alike
        return winner, loser

    def __iter__(self) -> Iterator[Row]:
        while (row := self.heads[self.top]) is not None:
            at = self.top
            yield (*row[:3], self.shared[at])
            self.heads[at] = head = next(self.runs[at], None)
            self.shared[at] = 0 if head is None else head[3]
            place = (at + self.width) // 2
            while place:
                at, self.losers[place] = self._play(at, self.losers[place])
                place //= 2
            self.top = at


class Node:
    __slots__ = ("children", "depth", "ends", "key", "kids", "least", "leaves", "n", "on_first", "parent_key", "path", "saved", "words")

    def __init__(self, depth: int, words: int, path: bytes = b"", on_first: bool = False):
        self.depth, self.words, self.path, self.on_first = depth, words, path, on_first
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: list[int] = []
        self.kids: list[tuple] = []

    def found(self, n: int, least: int | None) -> None:
        self.n += n
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    def finish(self) -> None:
        if self.children == 0:
            self.leaves = 1
        self.saved += (self.n - 1) * self.words

    def take(self, child: Node) -> None:
        self.found(child.n, child.least)
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved


def _key(path: bytes, depth: int) -> bytes:
    return hashlib.md5(path[: depth * TURN]).digest()


def _decimal(ids: Iterable[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


NODES = pa.schema([
    ("part", pa.int32()), ("nth", pa.int64()), ("kind", pa.int32()), ("depth", pa.int64()), ("conv", pa.int64()), ("parent_conv", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("words", pa.int64()), ("ends", pa.binary()), ("ends_sha256", pa.string()),
])
NODES_SQL = "part int, nth bigint, kind int, depth bigint, conv bigint, parent_conv bigint, key binary, parent_key binary, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, words bigint, ends binary, ends_sha256 string"


def finished_nodes(stream: Iterable[Row], part: int) -> Iterator[tuple]:
    """Rows as in ``NODES``: whole nodes as the stream leaves them, then the shares of those on its first and last path."""
    stack: list[Node] = []
    first: list[Node] = []

    def whole(node: Node, parent_conv: int | None, parent_key: bytes | None) -> tuple:
        sha = hashlib.sha256(_decimal(node.ends)).hexdigest()
        return (part, 0, WHOLE, node.depth, node.least, parent_conv, None, parent_key, node.n, node.children, node.leaves, node.saved, node.words, None, sha)

    def leave(depth: int) -> Iterator[tuple]:
        while len(stack) > depth + 1:
            node = stack.pop()
            node.found(len(node.ends), min(node.ends, default=None))
            if node.on_first:
                first.append(node)
                continue
            node.finish()
            yield from (whole(kid, node.least, None) for kid in node.kids)
            node.kids = []
            stack[-1].take(node)
            if stack[-1].on_first:
                yield whole(node, None, _key(node.path, node.depth - 1))
            else:
                stack[-1].kids.append(node)

    for path, conv, words, shared in stream:
        begins = not stack
        if begins:
            stack.append(Node(0, 0, path, True))
        yield from leave(shared if not begins else 0)
        for depth in range(len(stack), len(path) // TURN + 1):
            stack.append(Node(depth, int(words[depth - 1]), path, begins))
        stack[-1].ends.append(conv)

    for node in stack:  # the last path is left open
        node.found(len(node.ends), min(node.ends, default=None))
        yield from (whole(kid, None, _key(node.path, node.depth)) for kid in node.kids)
    left = sorted([*first, *(n for n in stack if n.on_first)], key=lambda n: n.depth)
    nth = 0
    for kind, node in [*((FIRST, n) for n in left), *((LAST, n) for n in stack if not n.on_first)]:
        key, pieces = _key(node.path, node.depth), [_decimal(node.ends[i : i + PIECE]) for i in range(0, len(node.ends), PIECE)]
        yield (part, nth, kind, node.depth, node.least, None, key, None, node.n, node.children, node.leaves, node.saved, node.words, pieces[0] if pieces else None, None)
        for i, piece in enumerate(pieces[1:], 1):
            yield (part, nth + i, MORE_ENDS, node.depth, None, None, key, None, 0, 0, 0, 0, 0, piece, None)
        nth += max(1, len(pieces))


class _Joined(Node):
    __slots__ = ("hasher", "hashed")

    def __init__(self, depth: int, words: int, key: bytes, parent_key: bytes | None):
        super().__init__(depth, words)
        self.key, self.parent_key = key, parent_key
        self.hasher, self.hashed = hashlib.sha256(), False

    def more_ends(self, piece: bytes | None) -> None:
        if piece is not None:
            self.hasher.update(b"," + piece if self.hashed else piece)
            self.hashed = True


def stitched_nodes(shares: Iterable[tuple]) -> Iterator[tuple]:
    """Finished nodes from the shares ``kind, depth, conv, key, n_convs, n_children, n_leaves, saved, words, ends`` of all ranges in order."""
    stack: list[_Joined] = []

    def leave(depth: int) -> Iterator[tuple]:
        while len(stack) > depth:
            node = stack.pop()
            node.finish()
            if stack:
                stack[-1].take(node)
            yield (0, 0, WHOLE, node.depth, node.least, None, node.key, node.parent_key, node.n, node.children, node.leaves, node.saved, node.words, None, node.hasher.hexdigest())

    for kind, depth, least, key, n, children, leaves, saved, words, ends in shares:
        if kind == MORE_ENDS:
            stack[depth].more_ends(ends)
            continue
        if kind == LAST or len(stack) <= depth or stack[depth].key != key:
            yield from leave(depth)
            stack.append(_Joined(depth, words, key, stack[-1].key if stack else None))
        node = stack[depth]
        node.found(n, least)
        node.children += children
        node.leaves += leaves
        node.saved += saved
        node.more_ends(ends)
    yield from leave(0)


def _batched(rows: Iterable[tuple], size: int = 4096) -> Batches:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), NODES, strict=True)], schema=NODES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), NODES, strict=True)], schema=NODES)


def sorted_runs(conversations: DataFrame, rows: int = RUN_ROWS, turns: int = RUN_TURNS) -> DataFrame:
    """``run, nth, conv, path, words, shared`` from ``conv, path, words``."""
    schema = pa.schema([("run", pa.int64()), ("nth", pa.int64()), ("conv", pa.int64()), ("path", pa.binary()), ("words", pa.list_(pa.int32())), ("shared", pa.int32())])

    def sort(batches: Batches) -> Batches:
        run = TaskContext.get().partitionId() << 32
        held: list[tuple[bytes, int, list[int]]] = []
        size = 0

        def out() -> Batches:
            held.sort(key=lambda x: x[:2])
            shared = [0, *(common_turns(a[0], b[0]) for a, b in zip(held, held[1:], strict=False))]
            for i in range(0, len(held), 4096):
                part = held[i : i + 4096]
                columns = ([run] * len(part), range(i, i + len(part)), [x[1] for x in part], [x[0] for x in part], [x[2] for x in part], shared[i : i + len(part)])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for first in range(0, len(batch), 1024):
                part = batch.slice(first, 1024)
                held += zip(part.column(1).to_pylist(), part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)
                size += sum(len(x) // TURN for x, _, _ in held[-len(part) :])
                if len(held) >= rows or size >= turns:
                    yield from out()
                    held, size, run = [], 0, run + 1
        if held:
            yield from out()

    return conversations.select("conv", "path", "words").mapInArrow(trimmed(sort), "run bigint, nth bigint, conv bigint, path binary, words array<int>, shared int")


def _merged(batches: Batches) -> Iterator[Row]:
    """One range: its rows come by run, each in order."""
    runs: list[list[Row]] = []
    last = None
    for batch in batches:
        words = batch.column(3)
        flat, starts = words.flatten().to_numpy(), words.offsets.to_numpy() - words.offsets[0].as_py()
        for i, (run, conv, path, shared) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True)):
            if run != last:
                runs.append([])
                last = run
            runs[-1].append((path, conv, flat[starts[i] : starts[i + 1]], shared))
    return iter(LoserTree(runs)) if runs else iter(())


def trie_nodes(conversations: DataFrame, range_rows: int = RANGE_ROWS, range_turns: int = RANGE_TURNS, run_rows: int = RUN_ROWS) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of each node of the trie of ``conv, path, words``."""
    spark = conversations.sparkSession
    runs = materialize(sorted_runs(conversations, run_rows), "conversation-runs")
    rows, turns = runs.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    ranges = max(1, -(-rows // range_rows), -(-turns // range_turns), min(2 * spark.sparkContext.defaultParallelism, rows // LEAST_RANGE_ROWS))
    dealt = runs.repartitionByRange(ranges, "path", "conv").sortWithinPartitions("run", "nth").select("run", "conv", "path", "words", "shared")

    def merge(batches: Batches) -> Batches:
        yield from _batched(finished_nodes(_merged(batches), TaskContext.get().partitionId()))

    def stitch(batches: Batches) -> Batches:
        yield from _batched(stitched_nodes(row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True)))

    nodes = materialize(dealt.mapInArrow(trimmed(merge), NODES_SQL), "trie-nodes")
    shares = nodes.filter(F.col("kind") != WHOLE).repartition(1).sortWithinPartitions("part", "nth").select("kind", "depth", "conv", "key", "n_convs", "n_children", "n_leaves", "saved", "words", "ends")
    spine = materialize(shares.mapInArrow(trimmed(stitch), NODES_SQL), "trie-spine")

    whole = nodes.filter(F.col("kind") == WHOLE)
    parents = spine.select(F.col("key").alias("parent_key"), F.col("conv").alias("found"))
    below = whole.filter("parent_key is not null").unionByName(spine.filter("depth > 0")).join(parents, "parent_key").withColumn("parent_conv", F.col("found"))
    columns = [F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"]
    return whole.filter("parent_key is null").select(columns).unionByName(below.select(columns)).unionByName(spine.filter("depth = 0").select(columns))
