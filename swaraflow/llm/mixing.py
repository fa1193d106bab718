"""A mixture of sources at target weights, by Sainte-Lague apportionment.

1. Words are counted per document and source; each source's target is its weight's
   share of the whole mix, held at ``most`` times its own size, the excess being
   reshared by weight (the level at which that settles is found by one ordered
   pass over the sources).
2. The mix is a number of blocks of equally many words.  They go to sources by the
   highest quotients target / (2k + 1).  The threshold quotient is narrowed by
   counting seats over the table of sources; only seats around it are listed.
3. A source's documents are dealt to shards by a hash of id and text, and its blocks
   are split over its shards in proportion (cumulative rounding, so nothing is lost).
4. In a shard, documents in seeded order form a line of words; whole rounds of it
   are taken first, then blocks from its start.  Only the document where the last
   block ends is taken in part.

No source or shard meets in one task: a hot source has as many shards as its rows
call for, and rows that share id, text and source are one group, cut into chunks
that are dealt apart.  The table of sources, a row for each, is ordered in one
task: that is meant for sources up to some millions, not for hosts of the web.

Defined results: null or word-less texts have size 0 and nothing is taken of them;
a null source comes last; repeated rows are documents of their own, next to each
other in the line; ties of quotients go to the first source; columns other than
id, text and source are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .names import unlike
from .store import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 8
SHARDS, SHARD_ROWS, LEAST_SHARD_ROWS = 512, 1_000_000, 64
WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, rows, source_size, weight, target`` of ``source, size, copies`` rows."""
    sources = sizes.groupBy("source").agg(F.sum("copies").alias("rows"), F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    sources = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(nth - 1, F.lit(len(weights))) + 1))
    everything = Window.partitionBy()
    sources = sources.withColumn("mix", share * F.sum("source_size").over(everything)).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    left = F.col("mix") - F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("capped", F.col("cap") / F.col("weight") <= left / open_weight)
    level = (F.first("mix").over(everything) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)) / F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    return sources.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))).select("source", "rows", "source_size", "weight", "target")


def _seats(quotient: str) -> str:
    """How many of a source's quotients target / (2k + 1) are at least ``quotient``."""
    return f"cast(floor((target / {quotient} + 1) / 2) as bigint)"


def sainte_lague(targets: DataFrame, seats: int, grid: int = 32, passes: int = 12) -> DataFrame:
    """``targets`` with ``blocks``: ``seats`` in all, by the highest quotients, ties to the first source."""
    facts = targets.agg(F.count("*").alias("n"), F.sum("target").alias("sum"), F.max("target").alias("most")).first()
    n, total, most = facts["n"], facts["sum"] or 0.0, facts["most"] or 0.0
    if seats <= 0 or total <= 0:
        return targets.withColumn("blocks", F.lit(0).cast("long"))
    low = total / (2.0 * (seats + n))  # gives at least `seats`
    high = total / (2.0 * (seats - n)) if seats > n else 2.0 * most  # gives at most `seats`
    for _ in range(passes):
        marks = [low + (high - low) * i / grid for i in range(grid + 1)]
        counts = targets.agg(*(F.expr(f"sum({_seats(repr(m) + 'D')})").alias(f"c{i}") for i, m in enumerate(marks))).first()
        at = max(i for i in range(grid + 1) if counts[i] >= seats) if counts[0] >= seats else 0
        low, high = marks[at], marks[min(grid, at + 1)]
        if counts[at] - counts[min(grid, at + 1)] <= n + grid:
            break
    sure = f"least({_seats(repr(high) + 'D')}, {_seats(repr(low) + 'D')})"
    held = targets.withColumn("sure", F.expr(sure)).withColumn("possible", F.expr(_seats(repr(low) + "D")))
    rest = seats - (held.agg(F.sum("sure")).first()[0] or 0)
    near = held.filter("possible > sure").select("source", "target", F.explode(F.expr("sequence(sure, possible - 1)")).alias("k"))
    near = near.select("source", (F.col("target") / (2 * F.col("k") + 1)).alias("quotient"), "k")
    won = near.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("quotient"), F.asc_nulls_last("source"), "k"))).filter(F.col("nth") <= rest)
    won = won.groupBy(F.col("source").alias("winner")).agg(F.count("*").alias("more"))
    return held.join(won, F.col("source").eqNullSafe(F.col("winner")), "left").withColumn("blocks", F.col("sure") + F.coalesce("more", F.lit(0))).drop("winner", "more", "sure", "possible")


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, seed: int = 1, chunk: int = SHARD_ROWS) -> DataFrame:
    """``id, source, size, source_size, target, taken, shard, shard_blocks``; ``taken`` is at most ``most`` times ``size``."""
    count = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), count.alias("size"), draw.alias("draw")).groupBy("id", "source", "size", "draw").agg(F.count("*").alias("copies"))
    # a chunk of equal rows is dealt as one; the first chunk by the draw itself
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(chunk).cast("long")))
    rows = rows.withColumn("from", starts).withColumn("copies", F.least(F.lit(chunk).cast("long"), F.col("copies") - F.col("from")))
    rows = materialize(rows.withColumn("draw", F.when(F.col("from") > 0, F.md5(F.concat("draw", F.col("from").cast("string")))).otherwise(F.col("draw"))), "mix-sizes")
    targets = materialize(source_targets(rows, weights, share, most), "mix-targets")
    facts = targets.agg(F.sum("rows").alias("rows"), F.sum("source_size").alias("size")).first()
    total, words = facts["rows"] or 0, facts["size"] or 0
    wanted = max(SHARDS, -(-total // SHARD_ROWS))
    quotas = sainte_lague(targets, math.floor(share * words / block + 0.5))
    shards = F.greatest(F.lit(1), F.least(F.ceil(F.col("rows") * wanted / max(1, total)), F.ceil(F.col("rows") / LEAST_SHARD_ROWS))).cast("int")
    quotas = materialize(quotas.select(F.col("source").alias("of"), "source_size", "target", "blocks", shards.alias("shards")), "mix-quotas")

    dealt = rows.join(quotas, F.col("source").eqNullSafe(F.col("of"))).withColumn("shard", F.expr("cast(pmod(cast(conv(substring(draw, 1, 8), 16, 10) as bigint), shards) as int)"))
    parts = dealt.groupBy("of", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("shard_size"), F.first("source_size").alias("source_size"), F.first("blocks").alias("blocks"))
    so_far = F.sum("shard_size").over(Window.partitionBy("of").orderBy("shard"))
    upto = lambda words: F.when(F.col("source_size") > 0, F.floor(F.col("blocks") * (words / F.col("source_size")) + 0.5)).otherwise(0).cast("long")
    parts = parts.withColumn("upto", so_far).select(F.col("of").alias("part_of"), F.col("shard").alias("part"), "shard_size", (upto(F.col("upto")) - upto(F.col("upto") - F.col("shard_size"))).alias("shard_blocks"))

    line = Window.partitionBy("source", "shard").orderBy("draw", "id", "size", "from").rowsBetween(Window.unboundedPreceding, -1)
    mixed = dealt.join(parts, F.col("source").eqNullSafe(F.col("part_of")) & (F.col("shard") == F.col("part")))
    mixed = mixed.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(line), F.lit(0))).withColumn("goal", F.least(F.col("shard_blocks") * block, most * F.col("shard_size")))
    mixed = mixed.withColumn("nth", F.explode(F.expr("sequence(0L, copies - 1)"))).withColumn("before", F.col("before") + F.col("nth") * F.col("size"))
    taken = F.when(F.col("shard_size") > 0, F.expr("goal div shard_size * size + greatest(0L, least(size, goal % shard_size - before))")).otherwise(F.lit(0)).cast("long")
    return mixed.select(F.col("id").alias(id), F.col("source").alias(source), "size", "source_size", "target", taken.alias("taken"), "shard", "shard_blocks")


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: ``docs`` with a row for each whole copy taken and one, cut after its last word taken, for a part.

    All columns stay; a document of which nothing is taken goes.  Rows that share
    id and text take the same number of words, the mean of theirs.
    """
    key = F.concat_ws(":", F.coalesce(F.col(id).cast("string"), F.lit("")), F.hex(F.xxhash64(text)))
    own, size, taken, part, parts = unlike(docs, "id", "size", "taken", "part", "texts")
    takes = mix(docs.select(key.alias(own), text, source), own, text, source, **how).groupBy(own).agg(F.first("size").alias(size), F.floor(F.avg("taken")).cast("long").alias(taken))
    takes = materialize(takes.filter(F.col(taken) > 0), "mix-takes")
    rows = docs.withColumn(own, key).join(takes, own).withColumn(part, F.col(taken) % F.col(size))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*" + WORDS), F.lit(0)), 1, F.col(part).cast("int")), "")
    texts = F.concat(F.array_repeat(F.col(text), F.expr(f"cast(`{taken}` div `{size}` as int)")), F.when(F.col(part) > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    return rows.withColumn(parts, texts).withColumn(text, F.explode(parts)).select(*(F.col(f"`{c}`") for c in docs.columns))
