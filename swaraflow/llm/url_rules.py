"""URL filtering: explicit rules, and association rules mined by FP-growth.

Explicit rules name a host (with its subdomains) and the start of a path; the
longest that fits wins.  All other URLs are judged by mined rules:

1. A URL becomes tokens in *strata* of bounded size: the top-level domain, the
   name before it and what is left of it, with three segments of the path a
   stratum.  A combination lies within one stratum, so it has ``DEPTH`` tokens at
   most, and a URL of any depth gives one basket for each three segments.
2. FP-growth over the baskets of labelled URLs finds frequent combinations that
   go with the label ``block``.  They are pruned by support, by confidence on
   balanced classes (as if both labels were equally frequent, since explicit rules
   name far more of one kind), and by lift over *all* URLs: the share of blocked
   ones among all that hold the combination, against the share among all URLs, so
   that what is common everywhere isn't blocked for want of a counterexample.
3. A URL is blocked if it holds one of the combinations.  Matching is by inverted
   index: each combination is filed under its rarest token, and a URL looks up
   only those of its own tokens.

A basket has 2^DEPTH combinations, and each of them that is found is in
``min_support`` of the labelled URLs, so there are at most 2^DEPTH / min_support of
them for each stratum that an average URL has (12,800 at the defaults), whatever
the size of the input.  Only combinations that pass all pruning reach the driver.

Defined results: a null URL and one without ``://`` have an empty host and path,
fit no explicit rule, have no tokens and are allowed; of two rules of equal length
the one given last wins; without labels of both kinds nothing is mined; repeated
rows count as often as they occur and are judged each; further columns pass
through, but a column with the name of one that is added (``ADDED``) gives way to
it; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import giving_way, unlike
from .store import materialize

MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT, MIN_TOKENS = 0.005, 0.9, 2.0, 2
#: Segments of the path in a stratum, and tokens in one at most.
SEGMENTS, DEPTH = 3, 6
BLOCK, ALLOW = "=block", "=allow"
ADDED = ("host", "path", "rule", "verdict", "mined")

# fixed values: verdict, host, start of the path
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path written together), and its verdict; null if none does."""
    text = verdict = F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        text, verdict = F.when(fits, F.lit(name + start)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def strata(host: Column, path: Column) -> Column:
    """The tokens of a URL, an array for each stratum; none without a host.

    A token begins with the number of its stratum.  Segments that begin with a
    digit count by that digit and their number of digits.
    """
    labels = F.reverse(F.split(host, r"\."))
    sub = F.array_join(F.reverse(F.slice(labels, 3, 1_000_000)), ".")
    names = F.array(F.concat(F.lit("t:"), F.get(labels, 0)), F.concat(F.lit("d:"), F.coalesce(F.get(labels, 1), F.lit(""))), F.concat(F.lit("s:"), sub))
    shape = lambda x: F.concat(F.lit("n:"), F.substring(x, 1, 1), F.lit("*"), F.length(F.regexp_extract(x, "^[0-9]+", 0)).cast("string"))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.when(x.rlike("^[0-9]"), shape(x)).otherwise(F.concat(F.lit("p:"), x)))
    of = F.struct(F.filter(names, lambda x: ~x.isin("t:", "d:", "s:")).alias("names"), segments.alias("segments"))

    def cut(s: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.size(s["segments"]) - 1, F.lit(0)), F.lit(SEGMENTS))
        one = lambda i: F.concat(s["names"], F.slice(s["segments"], i + 1, SEGMENTS))
        return F.transform(numbers, lambda i: F.array_distinct(F.transform(one(i), lambda t: F.concat((i / SEGMENTS).cast("int").cast("string"), F.lit("|"), t))))

    return F.when(host == "", F.array().cast("array<array<string>>")).otherwise(F.transform(F.array(of), cut)[0])


def _indexed(rules: DataFrame) -> DataFrame:
    """``rules`` (``no, tokens``, the rarest token first) as an index ``token, no, rest``; its size has the bound of the module."""
    return F.broadcast(rules.select(F.get("tokens", 0).alias("token"), "no", F.slice("tokens", 2, DEPTH).alias("rest")))


def mine(
    labelled: DataFrame, everything: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_tokens: int = MIN_TOKENS
) -> list[tuple[str, ...]]:
    """Token combinations that go with the label ``block``; none contains another.

    ``labelled`` holds ``strata, label``, ``everything`` the ``strata`` of all URLs.
    Each combination begins with its rarest token.
    """
    count = labelled.agg(F.count_if(F.col("label") == "block").alias("block"), F.count_if(F.col("label") == "allow").alias("allow"), F.sum(F.size("strata")).alias("baskets")).first()
    blocked, allowed = count["block"], count["allow"]
    if not blocked or not allowed or not count["baskets"]:
        return []
    label = F.when(F.col("label") == "block", F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    baskets = materialize(labelled.filter(F.col("label").isNotNull()).select(F.explode("strata").alias("items"), label.alias("label")).select(F.array_append("items", F.col("label")).alias("items")), "url-baskets")
    # a rule's confidence c has the odds c / (1 - c) = balanced odds * blocked / allowed
    odds = min_confidence / max(1e-9, 1 - min_confidence) * blocked / allowed
    model = FPGrowth(itemsCol="items", minSupport=min_support * (blocked + allowed) / count["baskets"], minConfidence=odds / (1 + odds)).fit(baskets)
    found = model.associationRules.filter((F.element_at("consequent", 1) == BLOCK) & ~F.array_contains("antecedent", ALLOW) & (F.size("antecedent") >= min_tokens)).select("antecedent")
    # frequent tokens: at most 1 / min_support a stratum; as a map they order each rule by rarity
    counts = {r["item"]: r["freq"] for r in model.freqItemsets.filter(F.size("items") == 1).select(F.element_at("items", 1).alias("item"), "freq").collect()}
    rarest = F.create_map(*(F.lit(x) for kv in sorted(counts.items()) for x in kv))
    ordered = F.transform(F.array_sort(F.transform("antecedent", lambda t: F.struct(F.element_at(rarest, t).alias("n"), t.alias("t")))), lambda x: x["t"])
    rules = materialize(found.select(F.xxhash64(ordered).alias("no"), ordered.alias("tokens")), "url-rules")

    held = everything.select(F.flatten("strata").alias("tokens"))
    total = everything.count()
    hits = held.select(F.explode("tokens").alias("token"), "tokens").join(_indexed(rules), "token").filter(F.size(F.array_except("rest", "tokens")) == 0)
    totals = hits.groupBy("no").agg(F.count("*").alias("holders"))
    block_hits = labelled.filter(F.col("label") == "block").select(F.flatten("strata").alias("tokens"))
    block_hits = block_hits.select(F.explode("tokens").alias("token"), "tokens").join(_indexed(rules), "token").filter(F.size(F.array_except("rest", "tokens")) == 0)
    lifted = block_hits.groupBy("no").agg(F.count("*").alias("blocked")).join(totals, "no")
    lifted = lifted.filter(F.col("blocked") * total >= min_lift * blocked * F.col("holders")).join(rules, "no").select("tokens").collect()
    known = {frozenset(r["tokens"]): tuple(r["tokens"]) for r in lifted}
    least = [t for x, t in known.items() if not any(frozenset(y) in known for k in range(1, len(x)) for y in combinations(x, k))]
    return sorted(least)


def matches(tokens: Column, rules: Sequence[tuple[str, ...]]) -> Column:
    """Whether a URL's tokens hold one of the rules."""
    if not rules:
        return F.lit(False)
    index: dict[str, list[tuple[str, ...]]] = {}
    for rule in rules:
        index.setdefault(rule[0], []).append(rule[1:])
    filed = F.create_map(*(x for t, rest in sorted(index.items()) for x in (F.lit(t), F.array(*(F.array(*(F.lit(w) for w in r)).cast("array<string>") for r in rest)))))
    known = F.filter(tokens, lambda t: t.isin(sorted(index)))  # by hash; the map is searched for few tokens only
    return F.exists(known, lambda t: F.coalesce(F.exists(F.element_at(filed, t), lambda rest: F.size(F.array_except(rest, tokens)) == 0), F.lit(False)))


def judge(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, labels: DataFrame | None = None, **limits) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, mined``.

    ``labels`` (``url, label``) are what is mined; without them it is the pages
    that an explicit rule names, with its verdict.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    h, p, r, e, s, m = unlike(pages, "host", "path", "rule", "explicit", "strata", "mined")
    rule, verdict = explicit_rule(F.col(h), F.col(p), rules)
    judged = pages.withColumns({h: host, p: path}).withColumns({r: rule, e: verdict, s: strata(F.col(h), F.col(p))})
    facts = materialize(judged.select(F.col(s).alias("strata"), F.col(e).alias("label")), "url-strata")
    if labels is None:
        learned = facts.filter(F.col("label").isNotNull())
    else:
        learned = labels.select(strata(host_of(F.col("url")), path_of(F.col("url"))).alias("strata"), "label")
    mined = matches(F.flatten(s), mine(learned, facts, **limits))
    kept = [F.col(f"`{c}`") for c in giving_way(pages.columns, ADDED)]
    judged = judged.withColumn(m, mined)
    final = F.coalesce(e, F.when(F.col(m), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(*kept, F.col(h).alias("host"), F.col(p).alias("path"), F.col(r).alias("rule"), final.alias("verdict"), F.col(m).alias("mined"))
