"""Shards along a Hilbert curve over document metadata.

Each dimension is quantised to a few bits: a category by its place in a
dictionary of the frequent values in order (values beyond the dictionary share
the cells after it, by a checksum), a size by a log scale from the least size to
the greatest.  Either is spread over all cells of its axis, so that no dimension
is left to the curve's finest turns.  The cell's place on the Hilbert curve orders
the documents, and equal runs of that order are
the shards.  Neighbours on the curve differ in one coordinate by one, so a shard
covers narrow ranges of all dimensions and a reader can skip most files for a
filter on any of them (:func:`shard_ranges`).

The order needs no global sort: rows that are equal in all that is used are
counted as one group, cells are counted, hot cells are cut by a hash, hot groups
into chunks, the (bounded) table of pieces is summed up, and groups are numbered
within their piece.

Defined results: a null text has no bytes; a null category is a value of its own;
ties on the curve are ordered by a hash of the id, checksum and size, then by
these, so rows that are equal in all of them are interchangeable and get
neighbouring or chunk-wise neighbouring slots; columns other than those named are
ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

BITS = 5
#: Least number of pieces that the rows are numbered in, and most rows of a piece or a chunk.
PIECES, PIECE_ROWS = 512, 1_000_000
#: Share of the cells that is left to values beyond the dictionary, where there are any.
TAIL = 0.25
#: Up to so many pieces, of three numbers each, are broadcast; beyond them (10^11 rows) they are joined by a shuffle.
BROADCAST_PIECES = 100_000


def hilbert_index(point: Sequence[int], bits: int) -> int:
    """The place of a cell on the Hilbert curve through a cube of ``2 ** bits`` cells a side.

    From the highest bit down, the sub-cube of a point is found along a Gray
    code and the point is reflected and exchanged into that sub-cube's frame.
    """
    axes, n = list(point), len(point)
    for bit in range(bits - 1, 0, -1):
        high, low = 1 << bit, (1 << bit) - 1
        for i in range(n):
            if axes[i] & high:
                axes[0] ^= low
            else:
                swap = (axes[0] ^ axes[i]) & low
                axes[0] ^= swap
                axes[i] ^= swap
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    flip = 0
    for bit in range(bits - 1, 0, -1):
        if axes[-1] >> bit & 1:
            flip ^= (1 << bit) - 1
    place = 0
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            place = place << 1 | ((axis ^ flip) >> bit & 1)
    return place


def dictionary(rows: DataFrame, category: str, bits: int = BITS) -> tuple[list, int]:
    """The values that get a cell of their own, in order, and the number of cells for all others.

    All values if they fit, else the most frequent (ties: the first); the driver
    sees one value more than there are cells.
    """
    cells = 1 << bits
    top = rows.groupBy(category).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first(category)).limit(cells + 1).collect()
    tail = 0 if len(top) <= cells else max(1, int(cells * TAIL))
    return sorted((r[category] for r in top[: cells - tail]), key=lambda v: (v is not None, v)), tail


def quantised_category(value: Column, values: Sequence, tail: int, bits: int = BITS) -> Column:
    cells = (1 << bits) - tail
    cell = F.pmod(F.crc32(F.coalesce(value.cast("string"), F.lit(""))), F.lit(max(1, tail))).cast("int") + cells
    for i, v in enumerate(values):
        cell = F.when(value.isNull() if v is None else value == F.lit(v), F.lit(i * cells // len(values))).otherwise(cell)
    return cell


def size_steps(least: int, most: int, bits: int = BITS) -> list[int]:
    """The least size of each cell but the first; even on a log scale, whole numbers."""
    cells = 1 << bits
    return sorted({math.ceil(least * (most / least) ** (k / cells)) for k in range(1, cells)}) if most > least else []


def quantised_number(value: Column, steps: Sequence[int]) -> Column:
    """How many of the steps a number has reached."""
    return F.size(F.filter(F.lit(list(steps)), lambda s: s <= value)) if steps else F.lit(0)


def curve_place(coordinates: Sequence[Column], bits: int = BITS) -> Column:
    """The Hilbert index of quantised columns, by a constant table of all cells."""
    if bits * len(coordinates) > 16:
        raise ValueError("at most 16 bits in all: the table of cells is a constant of the plan")
    table = [hilbert_index(p, bits) for p in product(range(1 << bits), repeat=len(coordinates))]
    cell = F.lit(0)
    for c in coordinates:
        cell = cell * (1 << bits) + c
    # one literal that Spark parses once: as an array of literals it would take the driver a call for each cell
    return F.element_at(F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>"), cell + 1)


def hilbert_shards(docs: DataFrame, shards: int, id: str = "doc_id", text: str = "text", categories: Sequence[str] = ("lang", "source"), bits: int = BITS, chunk: int = PIECE_ROWS) -> DataFrame:
    """``id, size, text_crc32, place, shard, slot``, the coordinates ``q0, q1, ...`` (the last is the size's) and the categories as ``c0, c1, ...``.

    Shards hold equally many rows, to within one.
    """
    body = F.col(text)
    size = F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 1
    named = [f"c{i}" for i in range(len(categories))]
    rows = docs.select(F.col(id).alias("id"), size.alias("size"), F.crc32(F.coalesce(body, F.lit(""))).alias("text_crc32"), *(F.col(c).alias(n) for c, n in zip(categories, named, strict=True)))
    rows = materialize(rows, "shard-sizes")
    axes = [f"q{i}" for i in range(len(categories) + 1)]
    cells = [quantised_category(F.col(n), *dictionary(rows, n, bits), bits) for n in named]
    ends = rows.agg(F.min("size").alias("least"), F.max("size").alias("most")).first()
    rows = rows.withColumns(dict(zip(axes, [*cells, quantised_number(F.col("size"), size_steps(ends["least"] or 1, ends["most"] or 1, bits))], strict=True)))
    rows = rows.withColumn("place", curve_place([F.col(a) for a in axes], bits)).withColumn("mix", F.xxhash64("id", "text_crc32", "size"))
    equal = ["place", "mix", "id", "text_crc32", "size", *axes, *named]
    # equal rows are one group, cut into chunks: neither a hot key nor a hot group meets in one task
    groups = rows.groupBy(*equal).agg(F.count("*").alias("rows"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(chunk).cast("long")))
    groups = materialize(groups.withColumn("from", starts).withColumn("rows", F.least(F.lit(chunk).cast("long"), F.col("rows") - F.col("from"))), "shard-rows")
    total = groups.agg(F.sum("rows")).first()[0] or 0
    wanted = max(PIECES, -(-total // PIECE_ROWS))

    # at most a row for each cell of the curve, and as many more pieces as are wanted: some megabytes for each 10^11 rows
    cells = groups.groupBy("place").agg(F.greatest(F.lit(1), F.ceil(F.sum("rows") * wanted / max(1, total))).cast("int").alias("cut"))
    cut = groups.join(F.broadcast(cells), "place").withColumn("piece", F.pmod(F.xxhash64("mix", "from"), "cut")).drop("cut")
    pieces = cut.groupBy("place", "piece").agg(F.sum("rows").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("place", "piece").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("place", "piece", F.coalesce(before, F.lit(0)).alias("before"))

    order = Window.partitionBy("place", "piece").orderBy("mix", "id", "text_crc32", "size", *named, "from").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("rows").over(order), F.lit(0))
    if wanted <= BROADCAST_PIECES:
        pieces = F.broadcast(pieces)
    ranked = cut.join(pieces, ["place", "piece"]).withColumn("first", F.col("before") + ahead).withColumn("rank", F.explode(F.expr("sequence(first, first + rows - 1)")))
    n = max(1, total)
    return ranked.withColumn("shard", F.expr(f"cast(rank * {shards} div {n} as int)")).select(
        F.col("id").alias(id), "size", "text_crc32", "place", "shard", F.expr(f"rank - (cast(shard as bigint) * {n} + {shards - 1}) div {shards}").alias("slot"), *axes, *named
    )


def shard_ranges(sharded: DataFrame) -> DataFrame:
    """Per shard the least and greatest coordinates, sizes and categories: what a reader prunes files by."""
    ranged = ["size", *(c for c in sharded.columns if c[:1] in "qc" and c[1:].isdigit())]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *(f(a).alias(f"{n}_{a}") for a in ranged for n, f in (("least", F.min), ("most", F.max))))
