"""Near-duplicate documents by circulant MinHash, banding and exact verification.

Signature.  A shingle's 64-bit hash is placed in a universe of 2^22 positions by
a first permutation; a second permutation of the universe, shifted circularly by
k, gives coordinate k of the signature.  With the permuted universe laid out as
one wrapped array, all coordinates of a shingle are one contiguous slice, so
the signature is the minimum over slices.  768 coordinates are kept as two bits
each (the *sketch*); the first of them form the bands.  Bands and the sketch's
limit follow from the threshold: a pair at it misses all bands with probability
``MISS`` at most, and is beyond the limit with ``SKETCH_MISS`` at most (taking
coordinates as independent).  Bands have 8 rows (36 bands at 0.85, 63 at 0.8);
under 0.76, where 96 of them don't do, fewer rows, which makes more candidates.

Links.  Documents with equal shingle sets are one *node*.  Nodes that share a
band are candidates.  Emitting all pairs of a band would grow with the square of
its group, so links are found in two steps that lose no component:

1. each band's nodes are compared with the band's most central node (the one
   with most company in all its bands), and components are formed;
2. in bands that still hold several components, the nodes outside the band's
   largest one are compared with all nodes of *other* components that pass the
   sketch and length bounds, once per pair.  Both sides of a band are cut into
   tiles of ``TILE`` nodes, so that a hot band is many tasks.

Every link is confirmed on the full shingle sets before it counts.  Only bands
that several nodes share and the texts of candidates are shuffled: a table of bits
of fixed size (``SLOTS``), broadcast at any size of the input, drops nearly all
others in the scan, and an exact join drops the rest.  (The bits tell apart some
millions of values; beyond that they let more and more pass, up to all, and what
is left to the join grows, but not the broadcast.)

What stays quadratic: nodes of one band that all lie in different components, as
each of them may link with each; they are compared by sketch, tile by tile.

Defined results: null or word-less texts have no shingles, link with nothing and
are kept; null ids are kept apart from the minimum unless all ids of a component
are null; rows with equal ids and texts are each returned; further columns of
the input, whatever their names, are ignored (``without_near_duplicates`` keeps
them); an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .memory import trimmed
from .names import unlike
from .store import materialize, scratch
from .words import LOWER

SHINGLE = 5
#: Least similarity of near copies; ``op8_minhash_near_dedup`` asks for 0.85.
THRESHOLD = 0.8
UNIVERSE_BITS = 22
COORDINATES = 768
MOST_ROWS = 8
MISS, SKETCH_MISS = 1.1e-5, 1e-4
PLANE = COORDINATES // 64
#: Words of the table of bits (64 each), and nodes on a side of a tile of the second step.
SLOTS, TILE = 1 << 17, 1024
SEED = 20240229
_M64 = (1 << 64) - 1
_MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def banding(threshold: float) -> tuple[int, int]:
    """Bands, and rows of each, that a pair at ``threshold`` misses with a chance of ``MISS`` at most."""
    for rows in range(MOST_ROWS, 0, -1):
        share = min(threshold, 0.99) ** rows
        bands = math.ceil(math.log(MISS) / math.log1p(-share)) if share > 0 else COORDINATES + 1
        if bands * rows <= COORDINATES:
            return bands, rows
    raise ValueError(f"{COORDINATES} coordinates are too few for a threshold of {threshold}")


def sketch_limit(threshold: float) -> int:
    """As many coordinates of two sketches differ at most, but for a chance of ``SKETCH_MISS`` at ``threshold``."""
    p = 0.75 * (1 - min(threshold, 0.99))
    ways = math.lgamma(COORDINATES + 1)
    tail, most = 0.0, COORDINATES
    while most > 0:
        tail += math.exp(ways - math.lgamma(most + 1) - math.lgamma(COORDINATES - most + 1) + most * math.log(p) + (COORDINATES - most) * math.log1p(-p))
        if tail > SKETCH_MISS:
            break
        most -= 1
    return most


BANDS, ROWS = banding(0.85)


class _WordHashes(dict):
    """Word -> 64-bit hash; a bounded memo, refilled when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


@cache
def _memo() -> _WordHashes:
    return _WordHashes()


@cache
def _slices() -> np.ndarray:
    universe = np.random.default_rng(SEED).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
    return sliding_window_view(np.concatenate([universe, universe[: COORDINATES - 1]]), COORDINATES)


@cache
def _band_factors(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + 1)
    odd = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 1 << 63, bands, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(_MIX1)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(_MIX2)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of the text's 5-word shingles."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(_memo().__getitem__, words)), np.uint64)
    n = min(SHINGLE, len(h))
    last = len(h) - n + 1
    out = _mixed(h[:last] + np.uint64(n))
    for i in range(1, n):
        out = _mixed(out + h[i : i + last])
    return np.unique(out)


def signature(sets: np.ndarray, step: int = 256) -> np.ndarray:
    """All coordinates of a non-empty set."""
    at = ((sets * np.uint64(_MIX2)) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
    slices = _slices()
    least = slices[at[:step]].min(axis=0)
    for i in range(step, len(at), step):
        np.minimum(least, slices[at[i : i + step]].min(axis=0), out=least)
    return least


def _keys(signatures: np.ndarray, n_bands: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and sketches of some signatures, as 64-bit integers."""
    odd, salt = _band_factors(n_bands, n_rows)
    rows = signatures[:, : n_bands * n_rows].reshape(-1, n_bands, n_rows).astype(np.uint64)
    bands = _mixed(_mixed(rows * odd).sum(axis=2, dtype=np.uint64) + salt)
    planes = [np.packbits(((signatures >> b) & 1).astype(np.uint8), axis=1).view(np.uint64) for b in (0, 1)]
    return bands.view(np.int64), np.concatenate(planes, axis=1).view(np.int64)


def _listed(values: np.ndarray, width: int) -> pa.Array:
    offsets = np.arange(0, len(values) * width + 1, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1), pa.int64()))


def _sketched(batches: Iterator[pa.RecordBatch], n_bands: int, n_rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for start in range(0, len(batch), 256):
            sets = [shingles(t.as_py()) for t in texts[start : start + 256]]
            signatures = np.stack([signature(s) if len(s) else np.zeros(COORDINATES, np.uint32) for s in sets])
            bands, sketch = _keys(signatures, n_bands, n_rows)
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    ids[start : start + 256],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(prints, pa.binary()),
                    _listed(bands, n_bands),
                    _listed(sketch, 2 * PLANE),
                ],
                names=["id", "n", "fp", "bands", "sketch"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), 64):
            sets = [s for t in batch.column(0)[start : start + 64] if len(s := shingles(t.as_py()))]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=["fp", "shingles"],
            )


def _alike(a: str, b: str, threshold: float) -> Column:
    """The length bound and the sketch's estimate allow ``threshold``."""
    apart = " + ".join(f"bit_count(({a}.sketch[{i}] ^ {b}.sketch[{i}]) | ({a}.sketch[{i + PLANE}] ^ {b}.sketch[{i + PLANE}]))" for i in range(PLANE))
    percent = round(100 * threshold)
    return F.expr(f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and {apart} <= {sketch_limit(percent / 100)}")


def _maybe_among(rows: DataFrame, wanted: DataFrame, name: str = "id") -> DataFrame:
    """``rows`` without most of those whose ``name`` isn't in ``wanted``.

    Values are hashed to one of ``64 * SLOTS`` bits; the broadcast side is at most
    ``SLOTS`` words, whatever the number of values.
    """
    slot, bit = F.pmod(F.xxhash64(name), F.lit(SLOTS)), F.pmod(F.shiftright(F.xxhash64(name), 32), F.lit(64)).cast("int")
    bits = wanted.select(slot.alias("__slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("__slot").agg(F.bit_or("bit").alias("__bits"))
    hit = rows.withColumn("__slot", slot).join(F.broadcast(bits), "__slot").filter(F.call_function("getbit", F.col("__bits"), bit) == 1)
    return hit.drop("__slot", "__bits")


def _confirmed(edges: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The edges whose full shingle sets reach ``threshold``."""
    with scratch(edges.sparkSession):
        return _verified(materialize(edges, "candidates"), nodes, docs, threshold)


def _verified(edges: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    ends = edges.select(F.col("a").alias("fp")).union(edges.select(F.col("b").alias("fp"))).distinct()
    wanted = materialize(ends.join(nodes.select("fp", "rep"), "fp").select(F.col("rep").alias("id")).distinct(), "wanted")
    texts = _maybe_among(docs, wanted).join(wanted.withColumnRenamed("id", "__id"), F.col("id").eqNullSafe(F.col("__id")), "left_semi").select("text")
    sets = texts.mapInArrow(trimmed(_full_sets), "fp binary, shingles array<bigint>").groupBy("fp").agg(F.first("shingles").alias("shingles"))
    sets = materialize(sets, "shingle-sets")
    left = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("sb"))
    percent = round(100 * threshold)
    both = edges.join(left, "a").join(right, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return materialize(both.filter(f"100 * common >= {percent} * (na + nb - common)").select("a", "b"), "links", outlive=True)


def _tiled(open_: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs ``a, b`` of ``open_`` (``band, fp, root, n, sketch, bands, nth``) whose roots differ.

    Of two roots one isn't the band's largest; that node is on the left.  A tile
    is a part of the left nodes against a part of all; a pair meets in one tile.
    """
    sizes = open_.groupBy("band", "root").agg(F.count("*").alias("size"))
    bands = sizes.groupBy("band").agg(F.sum("size").alias("all"), F.max(F.struct("size", "root")).alias("top"))
    parts = lambda size: F.greatest(F.lit(1), F.ceil(size / TILE)).cast("int")
    bands = bands.select("band", F.col("top.root").alias("top"), parts(F.col("all")).alias("rights"), parts(F.col("all") - F.col("top.size")).alias("lefts"))
    placed = materialize(open_.join(bands, "band"), "open-bands")
    part = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = placed.filter("root <> top").withColumn("left", part("lefts")).withColumn("right", every("rights")).alias("x")
    y = placed.withColumn("right", part("rights")).withColumn("left", every("lefts")).alias("y")
    first_shared = F.expr("array_position(zip_with(x.bands, y.bands, (p, q) -> p = q), true) = x.nth")
    tile = (F.col("x.band") == F.col("y.band")) & (F.col("x.left") == F.col("y.left")) & (F.col("x.right") == F.col("y.right"))
    once = (F.col("y.root") == F.col("y.top")) | (F.col("x.fp") < F.col("y.fp"))
    pairs = x.join(y, tile & (F.col("x.root") != F.col("y.root")) & once & _alike("x", "y", threshold) & first_shared)
    return pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``id, n_shingles, component_id, kept``."""
    docs = docs.select(F.col(id).alias("id"), F.col(text).cast("binary").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    n_bands, n_rows = banding(round(100 * threshold) / 100)
    sketches = materialize(
        docs.mapInArrow(trimmed(lambda batches: _sketched(batches, n_bands, n_rows)), f"id {kind}, n bigint, fp binary, bands array<bigint>, sketch array<bigint>"), "sketches"
    )
    # equal sets have equal bands and sketches, so first() is the same whichever row it takes
    nodes = materialize(
        sketches.filter("n > 0").groupBy("fp").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "nodes",
    )
    keyed = nodes.select(F.explode("bands").alias("band"), "fp")
    sizes = materialize(keyed.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1"), "band-sizes")
    shared = materialize(_maybe_among(keyed, sizes, "band").join(sizes, "band"), "shared-bands")

    company = shared.groupBy("fp").agg(F.sum("size").alias("company"))
    leads = shared.join(company, "fp").groupBy("band").agg(F.max(F.struct("company", "fp"))["fp"].alias("a"))
    stars = shared.join(leads, "band").filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    brief = nodes.select("fp", "n", "sketch")
    x, y = brief.alias("x"), brief.alias("y")
    stars = stars.join(x, F.col("a") == F.col("x.fp")).join(y, F.col("b") == F.col("y.fp")).filter(_alike("x", "y", threshold)).select("a", "b")
    links = _confirmed(stars, nodes, docs, threshold)
    roots = connected_components(links)

    placed = shared.select("band", "fp").join(roots, F.col("fp") == F.col("node"), "left").select("band", "fp", F.coalesce("root", "fp").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
    open_ = placed.join(mixed, "band").join(nodes.select("fp", "n", "sketch", "bands"), "fp").withColumn("nth", F.array_position("bands", F.col("band")))
    more = _confirmed(_tiled(open_, threshold), nodes, docs, threshold)
    if not more.isEmpty():
        roots = connected_components(links.union(more))

    # each table is written before it is joined, so that a hot component or text is a skewed join of two plain tables
    linked = materialize(nodes.select("fp", "rep").join(roots, F.col("fp") == F.col("node")).select("fp", "rep", "root"), "linked-nodes")
    least = materialize(linked.groupBy("root").agg(F.min("rep").alias("component_id")), "component-ids")
    named = linked.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    found = nodes.select("fp", "rep").join(named, F.col("fp") == F.col("of"), "left")
    member = materialize(found.select(F.col("fp").alias("of"), F.coalesce("component_id", "rep").alias("component_id")), "members")
    return (
        sketches.select("id", "n", "fp")
        .join(member, F.col("fp") == F.col("of"), "left")
        .select(
            F.col("id").alias(id),
            F.col("n").alias("n_shingles"),
            F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col(id).eqNullSafe(F.col("component_id")))
    )


def without_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each component, the one of the least id; all columns stay.

    Rows are told apart by id and text, so an id that has several texts loses
    only those that are near copies; of rows that share id and text one stays.
    """
    key = F.struct(F.col(id).alias("id"), F.xxhash64(text).alias("sum"))
    judged = near_duplicates(docs.select(key.alias("key"), F.col(text).alias("text")), "key", "text", threshold)
    judged = materialize(judged.groupBy("key", "kept").agg(F.count("*").alias("rows")), "near-duplicates")
    (own,) = unlike(docs, "near_key")
    of = lambda rows: rows.select(F.col("key").alias(own))
    keyed = docs.withColumn(own, key)
    left = keyed.join(of(judged.filter("not kept")), own, "left_anti")
    often = of(judged.filter("kept and rows > 1"))
    if not often.isEmpty():
        repeated = left.join(often, own, "left_semi").dropDuplicates([own])
        left = left.join(often, own, "left_anti").unionByName(repeated)
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
