"""Quality rules whose verdicts are formed per host.

1. Every document is measured once over its whole text and scored by the rules.
   The base rules are absolute.  Each other rule (:data:`RULES`) has two limits: a
   score up to the soft one is fine anywhere, one over the hard one nowhere.
2. Failures of each rule (scores over its soft limit) are summed per host with
   map-side combination, and shrunk by a beta prior fitted to all hosts by
   moments: the spread of the hosts' rates less what binomial sampling alone
   would give.  Where hosts differ no more than chance, the prior is strong.
3. The posterior's tail, how sure it is that the host's true rate exceeds the
   corpus rate, sets the rule's limit for the host, from hard (surely better than
   the corpus) to soft (surely worse).  A host more than half of whose documents
   surely fail something is dropped whole.
4. Host verdicts are joined back, and a document is kept if it fails no base
   rule, exceeds no limit of its host, and its host isn't dropped.  The join is
   left to adaptive execution: a small host table is broadcast by its measured
   size, otherwise both sides are shuffled and a hot host's partition is split.

The tail is by the normal approximation in its logistic form, so that it is one
expression in the JVM; it is a weight between two limits, not a test.

Defined results: a null text has no words, so it fails ``words``; a null host
is a host of its own; repeated rows count and are returned one by one; a score
equal to its limit is fine; hosts of equal counts get equal limits; an empty
table gives an empty table; further columns of the input pass through, but a
column with the name of one that is added here gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .names import unlike
from .store import materialize

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A score (SQL over the measures, the same in Spark and DuckDB) and its two limits."""

    score: str
    soft: float
    hard: float


#: Whether a document fails a base rule.
BASE: dict[str, str] = {"words": "n_words < 10", "repeats": "100 * n_repeat_words > 20 * n_words"}
RULES: dict[str, Rule] = {
    "symbols": Rule("n_symbols / greatest(n_words, 1)", 0.1, 0.5),
    "word_length": Rule("word_chars / greatest(n_words, 1)", 10.0, 25.0),
    "duplicate_lines": Rule("greatest(n_dup_lines - 2, 0) / greatest(n_words, 1)", 0.01, 0.1),
}
#: The prior's strength is between these numbers of documents; and the bound of a host that is dropped whole, in standard deviations.
LEAST_STRENGTH, MOST_STRENGTH, SURE = 1.0, 1_000.0, 1.645
#: Logistic slope that comes closest to the normal distribution function.
SLOPE = 1.702
ADDED = ("host_docs", "host_rate", "host_dropped", "failed_rules", "base_failed", "kept", *(f"{kind}_{r}" for r in RULES for kind in ("rate", "limit")))


def measure(text: bytes | None) -> tuple[int, int, int, int, int]:
    text = text or b""
    words = text.split()
    return (len(words), W.word_chars(text), W.symbols(text), W.duplicate_lines(text), W.repeated_words(words))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, 512) for b in batches for i in range(0, max(1, len(b)), 512)):
        at = batch.num_columns - 1  # the text comes last
        columns = list(zip(*(measure(t.as_py()) for t in batch.column(at)), strict=True)) or [()] * len(MEASURES)
        kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
        names = [n for i, n in enumerate(batch.schema.names) if i != at]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.int64()) for c in columns)], names=[*names, *MEASURES])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures in place of the text."""
    rest = docs.drop(text, *MEASURES, *ADDED)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), *(f"{m} bigint" for m in MEASURES)])
    (sent,) = unlike(rest, "text")
    return docs.select(*(F.col(f"`{c}`") for c in rest.columns), F.col(text).cast("binary").alias(sent)).mapInArrow(_measured, schema)


def fit_prior(docs: int, failed: int, hosts: int, docs_squared: float, failed_squared: float) -> tuple[float, float]:
    """Mean and strength of the beta prior, from sums over hosts: documents, failures, documents squared, and failures squared over documents.

    ``spread`` is the weighted sum of squares of the hosts' rates about the mean,
    ``chance`` what binomial sampling of equal hosts gives; the rest of it is the
    share of the variance that lies between hosts.
    """
    if not docs:
        return 0.0, MOST_STRENGTH
    mean = failed / docs
    noise = mean * (1 - mean)
    spread, chance = failed_squared - docs * mean * mean, noise * (hosts - 1)
    room = noise * (docs - docs_squared / docs - (hosts - 1))
    between = (spread - chance) / room if room > 1e-9 else 0.0
    if between <= 1 / (1 + MOST_STRENGTH):
        return mean, MOST_STRENGTH
    return mean, max(LEAST_STRENGTH, (1 - between) / between)


def _posterior(failed: Column, docs: Column, prior: tuple[float, float]) -> tuple[Column, Column]:
    """Mean and standard deviation of the rate given a host's counts."""
    mean, strength = map(F.lit, prior)
    n = docs + strength
    rate = (failed + mean * strength) / n
    return rate, F.sqrt(rate * (1 - rate) / (n + 1))


def host_verdicts(tested: DataFrame, host: str = "host", rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """Per host of ``tested`` (``any_failed`` and ``soft_<rule>`` booleans): counts, shrunk rates, limits, and whether it is dropped."""
    names = ["any_failed", *(f"soft_{r}" for r in rules)]
    counts = materialize(tested.groupBy(host).agg(F.count("*").alias("host_docs"), *(F.sum(F.col(n).cast("long")).alias(n) for n in names)), "host-counts")
    n = F.col("host_docs")
    sums = [F.sum(n).alias("docs"), F.count("*").alias("hosts"), F.sum((n * n).cast("double")).alias("docs_squared")]
    facts = counts.agg(*sums, *(s for x in names for s in (F.sum(x).alias(x), F.sum(F.col(x) * F.col(x) / n).alias(f"{x}_squared")))).first()
    prior = {x: fit_prior(facts["docs"] or 0, facts[x] or 0, facts["hosts"], facts["docs_squared"] or 0.0, facts[f"{x}_squared"] or 0.0) for x in names}
    rate, deviation = _posterior(F.col("any_failed"), n, prior["any_failed"])
    out = [F.col(host), n, rate.alias("host_rate"), (rate - SURE * deviation > 0.5).alias("host_dropped")]
    for r, rule in rules.items():
        rate, deviation = _posterior(F.col(f"soft_{r}"), n, prior[f"soft_{r}"])
        worse = F.when(deviation > 0, 1 / (1 + F.exp(-SLOPE * (rate - prior[f"soft_{r}"][0]) / deviation))).otherwise(0.5)
        out += [rate.alias(f"rate_{r}"), (rule.hard - (rule.hard - rule.soft) * worse).alias(f"limit_{r}")]
    return counts.select(*out)


def judge(docs: DataFrame, host: str = "host", text: str = "text", rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """``docs`` without the text, with the measures, the host's rates and limits, ``failed_rules``, ``base_failed`` and ``kept``."""
    base = {n: F.expr(rule) for n, rule in BASE.items()}
    score = {r: F.expr(rule.score) for r, rule in rules.items()}
    rows = materialize(measured(docs, text), "host-rules")
    fails = lambda limits: [F.coalesce(score[r] > limits[r], F.lit(False)) for r in rules]
    hard, soft = fails({r: x.hard for r, x in rules.items()}), fails({r: x.soft for r, x in rules.items()})
    any_failed = F.array_contains(F.array(*base.values(), *hard), True)
    tested = rows.select(host, any_failed.alias("any_failed"), *(s.alias(f"soft_{r}") for r, s in zip(rules, soft, strict=True)))
    (of,) = unlike(rows, "host")
    verdicts = host_verdicts(tested, host, rules).withColumnRenamed(host, of)
    limited = fails({r: F.col(f"limit_{r}") for r in rules})
    failed = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in [*base.items(), *zip(rules, limited, strict=True)])), lambda x: x.isNotNull())
    return (
        rows.join(verdicts, F.col(host).eqNullSafe(F.col(of)), "left")
        .drop(of)
        .withColumn("failed_rules", failed)
        .withColumn("base_failed", F.arrays_overlap("failed_rules", F.array(*map(F.lit, BASE))))
        .withColumn("kept", (F.size("failed_rules") == 0) & ~F.col("host_dropped"))
    )
