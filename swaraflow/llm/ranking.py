r"""Ranked lexical search by Fagin's threshold algorithm.

Terms are runs of ASCII letters and digits and of all characters from U+0080 on,
with A-Z lower-cased.  A term's weight falls with the documents that hold it; its
impact in a document grows with its occurrences, less the longer the document is;
all in integers, so a score doesn't depend on the order of its sum.

1. The items' terms are read first.  They are searched in blocks of bounded size,
   so what is sent to the tasks doesn't grow with either table.
2. One pass over the documents writes the forward index: each document's number of
   terms, and its occurrences of the block's terms.  Counts come from that table.
3. The index is read again.  Every task cuts its rows into shards of bounded size
   and, for each shard, sorts a list of impacts per term.  An item's lists are read
   round-robin, some rounds at a time; each document met for the first time is
   scored by a random lookup in the forward index; reading stops when the threshold
   (what a document unseen so far can reach) falls strictly below the k-th score.
4. The best of each shard meet in a window that keeps the k best of every item,
   cut to k in each task before they are shuffled.

A shard's best contain all of its documents that are among the best of all, as ties
are never cut: what stays unread scores strictly less.

Defined results: null and term-less texts are neither counted nor found; rows with
equal ids are documents of their own; null document ids come first among equal
scores; rows that share an item id are one item, with the terms of all their texts;
an item without terms has no rows; further columns, whatever their names, are
ignored; where either table is empty so is the result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .memory import trimmed
from .store import materialize

Batches = Iterator[pa.RecordBatch]

#: ASCII other than letters and digits separates; A-Z become small.
FOLD = bytes(ord(chr(x).lower()) if x >= 128 or chr(x).isalnum() else 32 for x in range(128)) + bytes(range(128, 256))
BEST = 50
#: (item, term) pairs of a block of items, about; documents and occurrences of a shard at most.
BLOCK_PAIRS, SHARD_DOCS, SHARD_POSTINGS = 1_000_000, 8_192, 2_000_000
#: Rounds read before the threshold is looked at: at first, and at most.
ROUNDS, MOST_ROUNDS = 16, 1_024


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Shard:
    """Some documents' occurrences of the block's terms, as impact-sorted lists and as a forward index.

    ``starts`` has, for each document and the end, where its ascending terms begin
    in ``terms``; ``order`` the documents' ranks among equal scores.
    """

    def __init__(self, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, order: np.ndarray, vocabulary: int):
        self.starts, self.terms, self.impacts, self.order = starts, terms, impacts, order
        holders = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        by_impact = np.lexsort((-impacts, terms))
        self.list_docs, self.list_impacts = holders[by_impact], impacts[by_impact]
        self.list_starts = np.searchsorted(terms[by_impact], np.arange(vocabulary + 1))

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Full scores by lookups in the forward index; ``weights`` by term, 0 for those not asked for."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[docs] - (ends - sizes), sizes)
        sums = np.concatenate([[0], np.cumsum(weights[self.terms[at]] * self.impacts[at])])
        return sums[ends] - sums[ends - sizes]

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best documents and their scores, best first."""
        first, last = self.list_starts[terms], self.list_starts[terms + 1]
        lists = (last > first) & (weights[terms] > 0)
        terms, first, last = terms[lists], first[lists], last[lists]
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        seen = np.zeros(len(self.starts) - 1, bool)
        depth, step, deepest = 0, ROUNDS, int((last - first).max(initial=0))
        while depth < deepest:
            places = first[:, None] + np.arange(depth, depth + step)[None, :]
            met = self.list_docs[places[places < last[:, None]]]
            depth += step
            new = np.unique(met[~seen[met]])
            if len(new):
                seen[new] = True
                docs, scores = np.concatenate([docs, new]), np.concatenate([scores, self.scores(new, weights)])
                kept = np.lexsort((self.order[docs], -scores))[:k]
                docs, scores = docs[kept], scores[kept]
            ends = first + depth - 1
            threshold = (weights[terms] * np.where(ends < last, self.list_impacts[np.minimum(ends, last - 1)], 0)).sum()
            if len(docs) == k and threshold < scores[-1]:
                break
            step = min(2 * step, MOST_ROUNDS)
        found = scores > 0
        return docs[found], scores[found]


def _item_terms(items: DataFrame, id: str, text: str) -> DataFrame:
    """``item, term`` once each."""
    kind = items.schema[id].dataType.simpleString()

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for item, raw in zip(batch.column(0), batch.column(1), strict=True):
                found = sorted(set(terms_of(raw.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(found), batch.column(0).type), pa.array(found, pa.binary())], names=["item", "term"])

    rows = items.select(F.col(id).alias("item"), F.col(text).cast("binary").alias("text")).filter("text is not null")
    return rows.mapInArrow(read, f"item {kind}, term binary").distinct()


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int], id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n, terms, occurrences`` of documents with a term: ``n`` counts all, the arrays hold those of the vocabulary, ascending."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    docs = docs.select(F.col(id).alias("id"), F.col(text).cast("binary").alias("text")).filter("text is not null")

    def read(batches: Batches) -> Batches:
        number = known.value
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                sizes, lengths, terms, counts = [], [0], [], []
                for raw in part.column(1):
                    words = terms_of(raw.as_py())
                    sizes.append(len(words))
                    held = sorted((number[t], c) for t, c in Counter(words).items() if t in number)
                    terms += [t for t, _ in held]
                    counts += [c for _, c in held]
                    lengths.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
                rows = pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "occurrences"])
                yield rows.filter(pa.compute.greater(rows.column(1), 0))

    kind = docs.schema["id"].dataType.simpleString()
    return materialize(docs.mapInArrow(trimmed(read), f"id {kind}, n bigint, terms array<int>, occurrences array<int>"), "forward-index")


def _search(index: DataFrame, asked: list[list[int]], weights: list[int], documents: int, total: int, k: int) -> DataFrame:
    """``item, id, score``: the best of each shard for each of the items, which are numbered."""
    sent = index.sparkSession.sparkContext.broadcast(([np.array(x, np.int64) for x in asked], np.array(weights, np.int64)))

    def of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        items, by_term = sent.value
        ids, n, terms, counts = (rows.column(i).combine_chunks() for i in range(4))
        starts = terms.offsets.to_numpy().astype(np.int64)
        holder = np.repeat(np.arange(len(ids)), np.diff(starts))
        starts, terms = starts - starts[0], terms.flatten().to_numpy()
        tf = counts.flatten().to_numpy().astype(np.int64)
        m = 50 + 50 * n.to_numpy() * documents // total
        by_id = pa.compute.sort_indices(ids, null_placement="at_start").to_numpy()
        order = np.empty(len(ids), np.int64)
        order[by_id] = np.arange(len(ids))
        shard = Shard(starts, terms, 1_000_000_000 * tf // (1000 * tf + 20 * m[holder]), order, len(by_term))
        asked_for = np.zeros_like(by_term)
        for number, wanted in enumerate(items):
            asked_for[wanted] = by_term[wanted]
            docs, scores = shard.best(wanted, asked_for, k)
            asked_for[wanted] = 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), number, np.int32)), ids.take(pa.array(docs)), pa.array(scores)], names=["item", "id", "score"])

    def search(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        docs = postings = 0
        for batch in batches:
            for first in range(0, len(batch), 1024):
                part = batch.slice(first, 1024)
                size = len(part.column(2).flatten())
                if held and (docs + len(part) > SHARD_DOCS or postings + size > SHARD_POSTINGS):
                    yield from of(pa.Table.from_batches(held))
                    held, docs, postings = [], 0, 0
                held.append(part)
                docs, postings = docs + len(part), postings + size
        if held:
            yield from of(pa.Table.from_batches(held))

    kind = index.schema["id"].dataType.simpleString()
    return index.mapInArrow(trimmed(search), f"item int, id {kind}, score bigint")


def _block(item: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(blocks))


def rank(docs: DataFrame, items: DataFrame, k: int = BEST, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``item_id, rank, id, score`` of each item's ``k`` best documents with a score above 0; equal scores by ascending id."""
    pairs = materialize(_item_terms(items, item_id, item_text), "item-terms")
    blocks = max(1, -(-pairs.count() // block_pairs))
    kind = pairs.schema["item"].dataType.simpleString()
    spark, found = docs.sparkSession, []
    for block in range(blocks):
        asked: dict[object, list[bytes]] = {}
        for item, term in pairs.filter(_block("item", blocks) == block).collect():  # of bounded size
            asked.setdefault(item, []).append(bytes(term))
        vocabulary = {t: i for i, t in enumerate(sorted({t for x in asked.values() for t in x}))}
        index = forward_index(docs, vocabulary, id, text)
        documents, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = dict(index.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a row for each term of the block at most
        weights = [weight(documents, holding.get(i, 0)) for i in range(len(vocabulary))]
        numbered = spark.createDataFrame(list(enumerate(asked)), f"item int, item_id {kind}")
        best = _search(index, [sorted(vocabulary[t] for t in x) for x in asked.values()], weights, documents, max(1, total), k)
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc("id")))).filter(F.col("rank") <= k)
        found.append(ranked.join(F.broadcast(numbered), "item").select("item_id", "rank", "id", "score"))  # of bounded size, too
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result.select(F.col("item_id").alias(item_id), "rank", F.col("id").alias(id), "score")
