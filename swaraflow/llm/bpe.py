"""Byte-level BPE: overlapping chunk encoding and raw-byte decoding.

Pre-tokens never look behind their start and at most a few characters past
their end, so two tokenisations of overlapping chunks agree from the first
boundary that both have.  A long text is therefore cut into chunks that overlap,
the chunks are pre-tokenised apart from each other, each chunk gives up its
pieces at the boundary where the next one has come into step, and the pieces
are encoded one by one.  Texts of one chunk take the same steps in one go, and a
text in which some overlap has no common boundary (a run of thousands of equal
characters, say) is pre-tokenised whole.  Decoding concatenates the ids' bytes.

The documents are read once: that pass encodes the texts of one chunk and cuts the
others, in one go over each.  Long texts are encoded once per distinct content;
everything that meets in one task belongs to one text.

Defined results: a null text is an empty one (no ids); bytes that aren't UTF-8
are read as U+FFFD; equal texts have equal results; repeated rows are each
returned; columns other than the id and text are ignored, whatever their names;
an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .memory import trimmed
from .store import materialize

CHUNK = 32_768
OVERLAP = 2_048
#: A piece that ends so close to a cut may be a part of a longer one.
LOOK_AHEAD = 8


class _Pieces(dict):
    """Piece -> its ids as little-endian 32-bit integers; a bounded memo, refilled when full."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encode(piece.encode("utf-8", "replace")), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) > 100_000:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary file (token in base 64 and rank on each line)."""

    def __init__(self, vocabulary: str, pattern: str):
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        core = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memo = _Pieces(core._encode_single_piece)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def boundaries(self, text: str) -> list[int]:
        """The starts of all pieces and the end of the last."""
        return [m.start() for m in self.pattern.finditer(text)] + [len(text)]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.pattern.findall(text)))

    def encode_at(self, text: str, bounds: list[int]) -> bytes:
        memo = self.memo
        return b"".join([memo[text[i:j]] for i, j in zip(bounds, bounds[1:], strict=False)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def codec(vocabulary: str, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: results leave the worker as they are made."""
    for batch in batches:
        yield from (batch.slice(i, rows) for i in range(0, len(batch), rows))


def trusted(bounds: list[int], end: int, last: bool) -> list[int]:
    """The boundaries of a chunk that what follows its cut can't move."""
    return bounds if last else [b for b in bounds if b <= end - LOOK_AHEAD]


def resynchronised(before: list[int], after: list[int], step: int) -> int | None:
    """The first boundary, counted in the later chunk, that two neighbours ``step`` apart share."""
    shared = set(after)
    return next((b - step for b in before if b >= step and b - step in shared), None)


def _digest(ids: bytes, decoded: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``id, ids`` with ``ids`` as binary: little-endian unsigned 32-bit integers."""
    return _encoded(docs, vocabulary, pattern, id, text, chunk, overlap, False)


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str, id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256``: encodes, decodes and digests in one Python pass."""
    return _encoded(docs, vocabulary, pattern, id, text, chunk, overlap, True)


def _encoded(docs: DataFrame, vocabulary: str, pattern: str, id: str, text: str, chunk: int, overlap: int, digest: bool) -> DataFrame:
    if not 2 * LOOK_AHEAD < overlap <= chunk:
        raise ValueError("the overlap must exceed the look-ahead and be a chunk at most")
    docs = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    results = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "ids binary"
    names = [x.split()[0] for x in results.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.string()) if digest else (pa.binary(),)

    def columns(c: Codec, found: Iterable[bytes | None]) -> list[pa.Array]:
        """The result columns of encoded texts; nulls where there is none."""
        rows = [(None,) * len(names) if ids is None else _digest(ids, c.decode(ids)) if digest else (ids,) for ids in found]
        return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of short texts; of a long one a row with its key, then its chunks, some at a time."""
        c = codec(vocabulary, pattern)

        def rows(ids: pa.Array, encoded: list[bytes | None], cuts: list[tuple]) -> pa.RecordBatch:
            key, k, last, part = zip(*cuts, strict=True) if cuts else ((),) * 4
            kept = [ids, pa.array(key, pa.string()), pa.array(k, pa.int32()), pa.array(last, pa.bool_()), pa.array(part, pa.binary())]
            return pa.RecordBatch.from_arrays([*kept, *columns(c, encoded)], names=["id", "key", "k", "last", "part", *names])

        for batch in sliced(batches, 64):
            encoded: list[bytes | None] = []
            keys: list[str | None] = []
            for raw in batch.column(1):
                whole = raw.as_py().decode("utf-8", "replace")
                if len(whole) <= chunk:
                    encoded.append(c.encode(whole))
                    keys.append(None)
                    continue
                key = hashlib.sha256(whole.encode()).hexdigest()
                encoded.append(None)
                keys.append(key)
                starts = range(0, max(1, len(whole) - overlap), chunk)
                for first in range(0, len(starts), 16):
                    cuts = [(key, k, k == len(starts) - 1, whole[starts[k] : starts[k] + chunk + overlap].encode()) for k in range(first, min(first + 16, len(starts)))]
                    yield rows(pa.nulls(len(cuts), batch.column(0).type), [None] * len(cuts), cuts)
            yield rows(batch.column(0), encoded, [(key, None, None, None) for key in keys])

    def pretokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for batch in sliced(batches, 16):
            rows = [batch.column(i) for i in range(batch.num_columns)]
            texts = [t.decode("utf-8") for t in rows[3].to_pylist()]
            bounds = [trusted(c.boundaries(t), len(t), last) for t, last in zip(texts, rows[2].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(bounds, pa.list_(pa.int32()))], names=["key", "k", "last", "part", "bounds"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for batch in sliced(batches, 16):
            out = []
            for part, bounds, before, after in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                first = 0 if before is None else resynchronised(before, bounds, chunk)
                end = None if after is None else resynchronised(bounds, after, chunk)
                if first is None or (after is not None and end is None):
                    out.append(None)
                    continue
                stop = bounds[-1] if after is None else end + chunk
                out.append(c.encode_at(part.decode("utf-8"), [b for b in bounds if first <= b <= stop]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["key", "k", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for batch in sliced(batches, 16):
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns(c, (b"".join(x.as_py()) for x in batch.column(1)))], names=["key", *names])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for batch in sliced(batches, 4):
            texts = ([p.decode("utf-8") for p in x.as_py()] for x in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns(c, (c.encode("".join([*(p[:chunk] for p in x[:-1]), x[-1]])) for x in texts))], names=["key", *names])

    rows = materialize(docs.mapInArrow(trimmed(read), f"id {kind}, key string, k int, last boolean, part binary, {results}"), "bpe-texts")
    short = rows.filter("key is null").select("id", *names)
    long = rows.filter("key is not null and k is null").select("id", "key")
    # equal keys have equal texts, so first() is the same whichever row it takes
    cuts = rows.filter("k is not null").groupBy("key", "k").agg(F.first("last").alias("last"), F.first("part").alias("part"))
    parts = cuts.mapInArrow(trimmed(pretokenised), "key string, k int, last boolean, part binary, bounds array<int>")
    order = Window.partitionBy("key").orderBy("k")
    # two neighbours overlap from the cut on
    before, after = F.lag(F.filter("bounds", lambda b: b >= chunk)).over(order), F.lead(F.filter("bounds", lambda b: b <= overlap)).over(order)
    pieces = parts.select("key", "k", "part", "bounds", before.alias("before"), after.alias("after")).mapInArrow(trimmed(encoded), "key string, k int, ids binary")
    in_order = lambda c: F.sort_array(F.collect_list(F.struct("k", c)))  # noqa: E731  of one text
    found = pieces.groupBy("key").agg(in_order(F.coalesce("ids", F.lit(b"")).alias("ids"))["ids"].alias("ids"), F.bool_or(F.col("ids").isNull()).alias("open"))
    found = materialize(found, "bpe-pieces")
    stitched = found.filter("not open").select("key", "ids").mapInArrow(trimmed(joined), f"key string, {results}")
    unresolved = found.filter("open").select("key")
    if not unresolved.isEmpty():
        rest = rows.filter("k is not null").join(unresolved, "key", "left_semi").dropDuplicates(["key", "k"]).groupBy("key").agg(in_order("part")["part"].alias("parts"))
        stitched = stitched.union(rest.mapInArrow(trimmed(whole), f"key string, {results}"))
    return short.unionByName(long.join(stitched, "key").select("id", *names)).withColumnRenamed("id", id)
