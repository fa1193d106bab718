r"""Token ids in binary files of independent zstandard frames with a seek table.

A file is a row of zstandard frames, each with a checksum of its content.  A frame
holds ids of one document only (a long one has several), so a reader decompresses
just what it is asked for.  Two skippable frames follow, which plain decoders pass
over: the index (an Arrow stream of ``id, n`` and, as metadata, the bytes of an id and the ids of a full frame),
and the seek table in the public seekable format: compressed size, size and checksum
(low 32 bits of XXH64) of each frame, their number, a flag, a magic number.

1. Documents are dealt by ranges of their ids, sorted in each range, encoded and
   written there, a new file after ``FILE_BYTES``.  Files have names of their own
   for each attempt of a task; which ones count is what the tasks that Spark commits
   report in a table of files, so a task that fails or runs twice does no harm.  Its
   file goes when the task fails; that of a lost machine stays in the folder.
2. The table of files, a row for each, is put in order with the ids before each file.
3. A reader takes one file a task and checks every frame that it decompresses.

Encoding is the library's own.  Words between single spaces are what byte-level
pre-tokenisation can't join, so each distinct one goes through the library's
pre-tokeniser (not needed for plain letters and marks) and model once and is
remembered, within a bound; other kinds of tokenizer encode whole texts.

Defined results: a null text is empty, an empty one holds the end id alone; bytes
that aren't UTF-8 are read as U+FFFD; strings of special tokens in a text are
ordinary text; null ids come first; rows of one id follow in the order of their
texts' MD5 digests, repeated rows are each written; ids may be of any type that
Spark can order; further columns, whatever their names, are ignored; an empty table
gives no files and no rows.  A document has 2^29 ids at most.
"""

from __future__ import annotations

import gc
import re
import struct
import uuid
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .memory import trimmed
from .store import materialize, new_folder

Batches = Iterator[pa.RecordBatch]

END_ID = 2
FRAME_IDS, FILE_BYTES = 1 << 18, 64 << 20
FILES = "part int, nth int, file string, docs bigint, ids bigint, bytes bigint"
# fixed values of the public frame formats
SKIPPABLE, SEEK_TABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
ENTRY, FOOTER, HEADER = struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<II")

#: A space between two characters that aren't white space begins a piece, whatever stands around.
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Words remembered in each of two generations.
MEMO = 400_000


class _Unsafe(Exception):
    """What stands between two spaces begins or ends with white space."""


def _alphabet() -> str:
    """How byte-level tokenizers write bytes: printable ones of Latin-1 as they are, the others from U+0100 on."""
    plain = [33 <= x <= 126 or 161 <= x <= 172 or 174 <= x for x in range(256)]
    return "".join(chr(x) if plain[x] else chr(256 + plain[:x].count(False)) for x in range(256))


class _Words(dict):
    """Word -> its ids after a space; what isn't here is looked for among the ``older`` ones, then encoded."""

    def __init__(self, known: Encoder, older: dict[str, bytes]):
        self.known, self.older = known, older

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            letters = word.rstrip(".,;:!?")
            if letters.isalpha():  # and then marks, if any: a piece each
                ids = self.known.piece(" " + word) if letters == word else self[letters] + self.known.marks(word[len(letters) :])
            elif not word or word[0].isspace() or word[-1].isspace():
                raise _Unsafe
            else:
                ids = self.known.across_lines(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


class Encoder:
    """Texts to little-endian 32-bit ids, by a file of the tokenizers library."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.pieces, self.tokens = self.tokenizer.pre_tokenizer, self.tokenizer.model.tokenize
        self.by_words = self.tokenizer.normalizer is None and isinstance(self.pieces, pre_tokenizers.ByteLevel) and self.pieces.use_regex and not self.pieces.add_prefix_space
        self.alphabet, self.words = _alphabet(), _Words(self, {})
        self.marks = lru_cache(1024)(self.piece)
        self.size = self.tokenizer.get_vocab_size()

    def piece(self, piece: str) -> bytes:
        """The ids of one piece."""
        written, _ = charmap_decode(piece.encode(), "strict", self.alphabet)
        return array("I", [t.id for t in self.tokens(written)]).tobytes()

    def plain(self, text: str) -> bytes:
        """The ids of a text whose ends no white space could join to others."""
        return b"".join([self.piece(text[i:j]) for _, (i, j) in self.pieces.pre_tokenize_str(text)])

    def across_lines(self, word: str) -> bytes:
        """The ids of a space and what follows up to the next; a single line feed is a piece of its own."""
        before, feed, after = word.partition("\n")
        if not feed or before[-1].isspace() or after[0].isspace():
            return self.plain(" " + word)
        letters = after.rstrip(".,;:!?")
        if not letters.isalpha():
            return self.words[before] + self.marks(feed) + self.plain(after)
        return self.words[before] + self.marks(feed) + self.piece(letters) + (self.marks(after[len(letters) :]) if letters != after else b"")

    def encode(self, text: str) -> bytes:
        if not self.by_words:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.words) > MEMO:
            self.words = _Words(self, dict(self.words))
        first, *words = text.split(" ")
        try:
            if first[-1:].isspace() or not first:
                raise _Unsafe
            return self.plain(first) + b"".join(map(self.words.__getitem__, words))
        except _Unsafe:
            first, *words = SAFE_SPACE.split(text)
            last = [self.plain(" " + words.pop())] if words else []  # may end with white space
            return b"".join([self.plain(first), *map(self.words.__getitem__, words), *last])


@cache
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


class FrameWriter:
    """Writes one file to an open stream; the documents' own ids are of the Arrow type ``kind``."""

    def __init__(self, out, kind: pa.DataType, id_bytes: int, frame_ids: int = FRAME_IDS):
        self.out, self.kind, self.id_bytes, self.frame_ids = out, kind, id_bytes, frame_ids
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.ids, self.sizes, self.table, self.bytes = [], [], [], 0

    def add(self, id, encoded: bytes) -> None:
        ids = np.frombuffer(encoded, "<u4")
        for first in range(0, max(1, len(ids)), self.frame_ids):
            raw = ids[first : first + self.frame_ids].astype(f"<u{self.id_bytes}").tobytes()
            frame = self.compressor.compress(raw)
            self.out.write(frame)
            self.table.append(ENTRY.pack(len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.bytes += len(frame)
        self.ids.append(id)
        self.sizes.append(len(ids))

    def finish(self) -> None:
        rows = pa.RecordBatch.from_arrays([pa.array(self.ids, self.kind), pa.array(self.sizes, pa.int64())], names=["id", "n"])
        rows = rows.replace_schema_metadata({"id_bytes": str(self.id_bytes), "frame_ids": str(self.frame_ids)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as stream:
            stream.write_batch(rows)
        index = sink.getvalue().to_pybytes()
        table = b"".join(self.table) + FOOTER.pack(len(self.table), WITH_CHECKSUMS, SEEKABLE)
        self.out.write(HEADER.pack(SKIPPABLE, len(index)) + index + HEADER.pack(SEEK_TABLE, len(table)) + table)


class TokenFile:
    """Reads one file from an open random-access source: the index at once, frames when asked for."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - FOOTER.size)
        n, flag, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != SEEKABLE or flag != WITH_CHECKSUMS:
            raise ValueError("not a seekable file of frames with checksums")
        at = size - FOOTER.size - n * ENTRY.size
        source.seek(at)
        self.table = np.frombuffer(source.read(n * ENTRY.size), "<u4").reshape(n, 3)
        self.places = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        begin = int(self.places[-1]) + HEADER.size
        source.seek(begin)
        with pa.ipc.open_stream(source.read(at - HEADER.size - begin)) as stream:
            self.rows = stream.read_all()
        self.width, frame_ids = (int(self.rows.schema.metadata[x]) for x in (b"id_bytes", b"frame_ids"))
        self.sizes = self.rows.column("n").to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.frames = np.concatenate([[0], np.cumsum(np.maximum(1, -(-self.sizes // frame_ids)))])
        self.decompressor = zstandard.ZstdDecompressor()

    def ids(self, k: int) -> bytes:
        """The ids of document ``k`` of the file, as little-endian 32-bit integers."""
        first, stop = int(self.frames[k]), int(self.frames[k + 1])
        self.source.seek(int(self.places[first]))
        packed = memoryview(self.source.read(int(self.places[stop] - self.places[first])))
        parts = []
        for f in range(first, stop):
            raw = self.decompressor.decompress(packed[int(self.places[f] - self.places[first]) : int(self.places[f + 1] - self.places[first])])
            if len(raw) != self.table[f, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[f, 2]:
                raise ValueError(f"frame {f} doesn't match its checksum")
            parts.append(np.frombuffer(raw, f"<u{self.width}").astype("<u4").tobytes())
        return b"".join(parts)


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = END_ID, id: str = "doc_id", text: str = "text", folder: str | None = None, file_bytes: int = FILE_BYTES, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Writes the files to ``folder`` (a new one in the shared folder) and returns their table: ``part, nth, file, docs, ids, bytes, first``.

    ``folder`` must be one that Arrow opens on all executors; ``first`` is the number of ids before the file.
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumns({"digest": F.md5("text"), "nth": F.monotonically_increasing_id()})  # nth splits repeated rows; it is the same in every run of a task
    rows = rows.repartitionByRange("id", "digest", "nth").sortWithinPartitions("id", "digest", "nth").select("id", "text")

    def write(batches: Batches) -> Batches:
        known, part, nth = encoder(vocabulary), TaskContext.get().partitionId(), 0
        collected = gc.get_threshold()
        gc.set_threshold(200_000)  # tokens of words make many small objects, none of them in cycles
        end, width = np.array([end_id], "<u4").tobytes(), 2 if max(known.size, end_id + 1) <= 1 << 16 else 4
        store, base = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out = writer = name = None

        def close() -> pa.RecordBatch:
            writer.finish()
            out.close()
            values = (part, nth, f"{folder}/{name}", len(writer.sizes), sum(writer.sizes), writer.bytes)
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, values, strict=True))], schema)

        schema = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])
        try:
            for batch in batches:
                for key, raw in zip(batch.column(0), batch.column(1), strict=True):
                    if writer is None:
                        name = f"part-{part:06d}-{nth:03d}-{uuid.uuid4().hex}.zst"
                        out = store.open_output_stream(f"{base}/{name}", compression=None)  # else the ending .zst decides
                        writer = FrameWriter(out, batch.column(0).type, width, frame_ids)
                    writer.add(key.as_py(), known.encode(raw.as_py().decode("utf-8", "replace")) + end)
                    if writer.bytes >= file_bytes:
                        yield close()
                        out = writer = None
                        nth += 1
            if writer is not None:
                yield close()
                out = writer = None
        finally:
            gc.set_threshold(*collected)
            if out is not None:
                out.close()
                store.delete_file(f"{base}/{name}")

    files = materialize(rows.mapInArrow(trimmed(write), FILES), "token-files")
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _by_file(files: DataFrame) -> DataFrame:
    """One file a task."""
    return files.select("file", "first").repartition(max(1, files.count()))


def token_index(files: DataFrame, kind: str = "bigint") -> DataFrame:
    """``file, k, id, start, n_tokens`` of all documents (``kind``: Spark's type of their ids), from the files' ends alone."""

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = pa.fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as source:
                    f = TokenFile(source)
                n = len(f.sizes)
                columns = [pa.array([path] * n), pa.array(np.arange(n)), f.rows.column("id").combine_chunks(), pa.array(f.starts[:-1] + first), pa.array(f.sizes)]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "k", "id", "start", "n_tokens"])

    return _by_file(files).mapInArrow(trimmed(read), f"file string, k bigint, id {kind}, start bigint, n_tokens bigint")


def read_tokens(files: DataFrame, kind: str = "bigint", batch_bytes: int = 4 << 20) -> DataFrame:
    """``id, start, n_tokens, ids`` of all documents; ``ids`` as little-endian 32-bit integers."""

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = pa.fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as source:
                    f = TokenFile(source)
                    ids, done, held = [], 0, 0
                    for k in range(len(f.sizes)):
                        ids.append(f.ids(k))
                        held += len(ids[-1])
                        if held >= batch_bytes or k + 1 == len(f.sizes):
                            columns = [f.rows.column("id").slice(done, len(ids)).combine_chunks(), pa.array(f.starts[done : k + 1] + first), pa.array(f.sizes[done : k + 1]), pa.array(ids, pa.binary())]
                            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "n_tokens", "ids"])
                            ids, done, held = [], k + 1, 0

    return _by_file(files).mapInArrow(trimmed(read), f"id {kind}, start bigint, n_tokens bigint, ids binary")


def requested_tokens(files: DataFrame, wanted: DataFrame, kind: str = "bigint") -> DataFrame:
    """``id, start, n_tokens, ids`` of the documents whose ids are in ``wanted``'s only column; no other frame is decompressed."""
    ids = wanted.select(F.col(wanted.columns[0]).alias("id")).distinct()
    found = token_index(files, kind).join(ids, "id", "left_semi").select("file", "k", "id", "start", "n_tokens").repartition("file").sortWithinPartitions("file", "k")

    def read(batches: Batches) -> Batches:
        path = source = f = None
        for batch in batches:
            for first in range(0, len(batch), 64):
                part, ids = batch.slice(first, 64), []
                for name, k in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if name != path:
                        if source is not None:
                            source.close()
                        store, at = pa.fs.FileSystem.from_uri(name)
                        path, source = name, store.open_input_file(at)
                        f = TokenFile(source)
                    ids.append(f.ids(k))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in (2, 3, 4)), pa.array(ids, pa.binary())], names=["id", "start", "n_tokens", "ids"])
        if source is not None:
            source.close()

    return found.mapInArrow(trimmed(read), f"id {kind}, start bigint, n_tokens bigint, ids binary")
