"""Semi, anti and keyed lookups.

Key tables are small in practice but that isn't relied on: no side is forced to
be broadcast, adaptive execution decides by measured size.  Filters by key stand
before any Python function, as Spark doesn't push a join below one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_held_out(rows: DataFrame, keys: DataFrame, key: str = "clip_key") -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def needed_only(rows: DataFrame, needed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(needed.select(*keys), list(keys), "left_semi")


def with_reference(items: DataFrame, clips: DataFrame, keys: Sequence[str] = ("source_id", "shard", "clip_key"), value: str = "samples") -> DataFrame:
    """Items with the value of their clip; null where there is no key or no such clip. Shards are read once."""
    found = needed_only(clips, items.filter(F.col(keys[-1]).isNotNull()), keys).select(*keys, value)
    return items.join(found.dropDuplicates(list(keys)), list(keys), "left")


def amended(locked: DataFrame, added: DataFrame, key: str = "clip_key") -> DataFrame:
    """A locked table with the added rows whose keys it doesn't hold; amending twice changes nothing."""
    return locked.unionByName(added.join(locked.select(key), key, "left_anti"), allowMissingColumns=True)


def key_union(*tables: DataFrame, key: str = "clip_key") -> DataFrame:
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.union(t.select(key))
    return out.distinct()


def unknown_names(asked: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Names asked for that aren't known; a mixture over them is an error."""
    return asked.select(name).distinct().join(known.select(name), name, "left_anti")


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows; a column that a part lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
