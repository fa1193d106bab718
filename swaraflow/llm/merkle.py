"""Document fingerprints: a Merkle tree over sections, paragraphs and content-defined pieces.

A paragraph ends with its line feeds, a section with a paragraph that ends in a blank
line.  A paragraph is cut into pieces by content: a piece ends where the low four bits
of its last six bytes, in any one of the four planes of bits, read 101100.  That holds
for about one place in sixteen in any script or alphabet of two characters or more, and
depends on nothing but these bytes; a piece has 16 bytes at least and 96 at most.  So an
insertion changes the pieces that it touches, and cuts fall into step soon after it.
Pieces are bytes: they may end within a character.

A leaf is the digest of a piece, a paragraph that of its leaves, a section that of its
paragraphs, the root that of the sections, all of 128 bits.  The fingerprint writes the
tree out:

    root [ section [/paragraph:leaf leaf ...]*]*    (root 32, all others 8 hexadecimal digits)

Equal roots mean equal texts; the branches that differ locate edits
(:func:`edited_branches`); the share of common leaves, as written in the fingerprints,
is the likeness.

The next document (by id, then by digest of the text) is found without a global
sort or a join of texts: ids are mapped to numbers that keep their order, cut into
buckets by approximate quantiles and evenly between them; the rows of an id that
makes up a quantile are cut by the digest.  Each bucket also gets a copy of
the first document of the next one, and a window over a bucket looks one row
ahead.  Rows that share id and text are brought down to one before and
multiplied after.  Strings are mapped by the six bytes after what all ids begin
with; of strings that agree in these too, more than a bucket's rows meet in one.

Defined results: a null text is empty, and an empty text has a root and no
leaves; two texts without leaves are alike to 1, a text without leaves and one
with leaves to 0; null ids come first; rows of one id follow in the order of
their texts' MD5 digests; a single document is its own next; ids may be numbers
or strings; further columns, whatever their names, are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
import os.path
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegralType, NumericType, StringType

from .store import materialize

PARAGRAPH = r"[^\n]*\n+|[^\n]+"
LEAST, MOST, BITS = 16, 96, "101100"


def _piece() -> str:
    """The pattern of a piece in hexadecimal digits, two for each byte."""
    planes = ([("[" + "".join(f"{d:X}" for d in range(16) if (d >> b & 1) == bit) + "]") for bit in (0, 1)] for b in range(4))
    tails = "|".join("".join("." + plane[int(bit)] for bit in BITS) for plane in planes)
    return f"(?:..){{{LEAST - len(BITS)},{MOST - len(BITS)}}}?(?:{tails})|(?:..){{1,{MOST}}}"


PIECE = _piece()
#: Quantiles of the ids; even cuts between two of them, at least; rows of a bucket, about; buckets at most, so that their heads are a broadcast of bounded size.
QUANTILES, CUTS_BETWEEN, BUCKET_ROWS, MOST_BUCKETS = 128, 16, 4096, 262_144


def _short(value: Column) -> Column:
    return F.substring(value, 1, 8)


def _node(kind: str, children: Column) -> Column:
    return F.md5(F.concat(F.lit(kind), F.array_join(children, "")))


def tree(text: Column) -> Column:
    """Struct ``leaves`` (8 digits of each, by paragraph), ``paragraphs`` and ``sections`` (their digests) and ``ends`` (each section's last paragraph); all empty for an empty text."""

    def paragraph(p: Column) -> Column:
        digests = F.transform(F.regexp_extract_all(F.hex(p), F.lit(PIECE), F.lit(0)), F.md5)
        return _let(digests, lambda d: F.struct(F.transform(d, _short).alias("leaves"), _node("paragraph", d).alias("digest"), F.endswith(p, F.lit("\n\n")).alias("last")))

    def cut(made: Column) -> Column:
        n = F.size(made)
        ends = F.filter(F.transform(made, lambda m, i: F.when(m["last"] | (i == n - 1), i)), lambda i: i.isNotNull())
        return F.struct(F.transform(made, lambda m: m["leaves"]).alias("leaves"), F.transform(made, lambda m: m["digest"]).alias("paragraphs"), ends.alias("ends"))

    def sections(s: Column) -> Column:
        of = F.transform(s["ends"], lambda e, k: _node("section", F.slice(s["paragraphs"], _first(s["ends"], k) + 1, e - _first(s["ends"], k) + 1)))
        return F.struct(s["leaves"].alias("leaves"), s["paragraphs"].alias("paragraphs"), of.alias("sections"), s["ends"].alias("ends"))

    paragraphs = F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), paragraph)
    return _let(_let(paragraphs, cut), sections)


def _first(ends: Column, k: Column) -> Column:
    """The first paragraph of section ``k``."""
    return F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1) + 1)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def root(tree: Column) -> Column:
    return _node("root", tree["sections"])


def fingerprint(tree: Column) -> Column:
    paragraphs = F.zip_with(tree["paragraphs"], tree["leaves"], lambda d, x: F.concat(F.lit("/"), _short(d), F.lit(":"), F.array_join(x, "")))

    def write(s: Column) -> Column:
        return F.transform(s["ends"], lambda e, k: F.concat(F.lit(" "), _short(F.get(s["sections"], k)), F.array_join(F.slice(s["written"], _first(s["ends"], k) + 1, e - _first(s["ends"], k) + 1), "")))

    return F.concat(root(tree), F.array_join(_let(F.struct(tree["ends"].alias("ends"), tree["sections"].alias("sections"), paragraphs.alias("written")), write), ""))


def likeness(a: Column, b: Column) -> Column:
    """Twice the common leaves over all leaves, of two arrays of distinct leaves."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def leaf_set(tree: Column) -> Column:
    return F.array_distinct(F.flatten(tree["leaves"]))


def _common_start(a: Column, b: Column) -> Column:
    """How many items two arrays begin with alike."""
    unlike = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(unlike == 0, F.size(a)).otherwise(unlike - 1).cast("int")


def _differing(a: Column, b: Column) -> Column:
    """Struct ``first, stop, other`` of the span of ``a`` (and the span's length in ``b``) between the common start and end."""
    at = _common_start(a, b)
    end = F.least(_common_start(F.reverse(a), F.reverse(b)), F.least(F.size(a), F.size(b)) - at)
    return F.struct(at.alias("first"), (F.size(a) - end).alias("stop"), (F.size(b) - end - at).alias("other"))


def edited_branches(a: Column, b: Column) -> Column:
    """Where tree ``a`` differs from ``b``, by place: an array of structs ``section, paragraph, kind, first_leaf, last_leaf``; empty for equal roots.

    Sections and paragraphs count from 0 through the whole text; the paragraphs are
    those between the common start and end of both trees.  ``kind`` is ``moved`` where
    ``b`` holds the same paragraph in that span but at another place, ``edited`` where
    it doesn't, and then the leaves are those between the common start and end of the
    paragraph and its counterpart in ``b`` (all of them where it has none; ``last_leaf``
    is ``first_leaf - 1`` where something was only inserted in ``b``).  Paragraphs that
    only ``b`` has give one ``missing`` entry at the place where they would stand.
    Texts that differ in the grouping of equal paragraphs alone can't be: a paragraph
    holds its line feeds.
    """

    def within(s: Column) -> Column:
        d, own, other = s["d"], s["a"], s["b"]
        theirs = F.slice(other["paragraphs"], d["first"] + 1, d["other"])
        section = lambda i: F.size(F.filter(own["ends"], lambda e: e < i)).alias("section")

        def one(i: Column) -> Column:
            moved = F.array_contains(theirs, F.get(own["paragraphs"], i))
            leaves = F.get(own["leaves"], i)
            there = i - d["first"] < d["other"]
            span = _differing(leaves, F.coalesce(F.when(there, F.get(other["leaves"], i)), F.array().cast("array<string>")))
            edited = _let(span, lambda x: F.struct(section(i), i.alias("paragraph"), F.lit("edited").alias("kind"), x["first"].alias("first_leaf"), (x["stop"] - 1).alias("last_leaf")))
            whole = F.struct(section(i), i.alias("paragraph"), F.lit("moved").alias("kind"), F.lit(0).alias("first_leaf"), (F.size(leaves) - 1).alias("last_leaf"))
            return F.when(moved, whole).otherwise(edited)

        spans = F.filter(F.sequence(d["first"], F.greatest(d["stop"], d["first"])), lambda i: i < d["stop"])
        missing = F.struct(section(d["first"]), d["first"].alias("paragraph"), F.lit("missing").alias("kind"), F.lit(0).alias("first_leaf"), F.lit(-1).alias("last_leaf"))
        # a stands for the spans of both, so a plain insertion has no span here
        return F.when((d["stop"] == d["first"]) & (d["other"] > 0), F.array(missing)).otherwise(F.transform(spans, one))

    both = F.struct(a.alias("a"), b.alias("b"), _differing(a["paragraphs"], b["paragraphs"]).alias("d"))
    return _let(both, within)


def _place(ids: DataFrame) -> Column:
    """A double that keeps the order of the ids (equal for some that differ)."""
    kind = ids.schema["id"].dataType
    if not isinstance(kind, NumericType | StringType | BinaryType):
        raise TypeError(f"ids must be numbers or strings, not {kind.simpleString()}")
    ends = ids.agg(F.min("id").alias("least"), F.max("id").alias("most")).first()
    if isinstance(kind, IntegralType):  # from the least one on, as a double is exact up to 2^53 only
        return (F.col("id").cast("decimal(20,0)") - F.lit(ends["least"] or 0).cast("decimal(20,0)")).cast("double")
    if isinstance(kind, NumericType):
        return F.col("id").cast("double")
    as_bytes = [x.encode() if isinstance(x, str) else bytes(x or b"") for x in ends]
    start = len(os.path.commonprefix(as_bytes))
    digits = F.rpad(F.hex(F.substring(F.col("id").cast("binary"), start + 1, 6)), 12, "0")
    return F.conv(digits, 16, 10).cast("double")


def _rows_once(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Rows of one id and text as one with ``copies``, and whether there were any."""
    keys = docs.groupBy("id", "digest").agg(F.count("*").alias("copies"))
    often = materialize(keys.filter("copies > 1"), "repeated-rows")
    if often.isEmpty():
        return docs.withColumn("copies", F.lit(1)), False
    often = often.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "copies")
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
    once = docs.join(often.drop("copies"), same, "left_semi").groupBy("id", "digest").agg(F.first("text").alias("text"))
    once = once.join(often, same).select("id", "text", "digest", "copies")
    return docs.join(often, same, "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(once), True


def with_next(docs: DataFrame, id: str = "id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``id, text, next_text`` of each document; the last one's next is the first."""
    docs = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    docs, repeated = _rows_once(docs)
    docs = docs.withColumn("at", _place(docs))
    keys = materialize(docs.select("id", "digest", "at"), "document-keys")

    # a bounded list of quantiles, each value once: part k holds the places from cut k to the next
    shares = ", ".join(f"{i / QUANTILES}" for i in range(QUANTILES))
    facts = keys.agg(F.count("*").alias("rows"), F.expr(f"percentile_approx(at, array({shares}), 2000)").alias("cuts"), F.min("at").alias("least")).first()
    marks = facts["cuts"] or []
    hot = {math.nextafter(a, math.inf) for a, b in pairwise(marks) if a == b}  # a frequent id is a part of its own
    cuts = sorted({*marks, *hot, *([] if facts["least"] is None else [facts["least"]])})
    bucket_rows = max(bucket_rows, -(-2 * facts["rows"] // MOST_BUCKETS))
    part = F.when(F.col("at").isNull(), F.lit(0)).otherwise(F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<double>"), lambda c: c <= F.col("at"))))
    # per part its rows and its span: 2 QUANTILES + 1 rows at most
    spans = {r["part"]: r for r in keys.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.min("at").alias("low"), F.max("at").alias("high"), F.min("id").eqNullSafe(F.max("id")).alias("same")).collect()}
    known = sorted(spans)
    of = lambda values: F.element_at(F.create_map(*(F.lit(x) for k in known for x in (k, values[k]))), F.col("part"))
    even = {k: max(CUTS_BETWEEN, -(-spans[k]["rows"] // bucket_rows)) for k in known}
    flat = {k: spans[k]["same"] for k in known}
    within = F.floor((F.col("at") - of({k: float(spans[k]["low"] or 0) for k in known})) / of({k: max(1e-300, float(spans[k]["high"] or 0) - float(spans[k]["low"] or 0)) for k in known}) * of(even))
    by_digest = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / float(1 << 32) * of(even))
    bucket = F.when(of(flat), by_digest).otherwise(F.least(within, of(even) - 1)).cast("long") if known else F.lit(0).cast("long")
    placed = lambda rows: rows.withColumn("part", part).withColumn("bucket", bucket)

    # the first row of each bucket goes, once more, to the bucket before it; that of the first one to the last
    firsts = placed(keys).groupBy("part", "bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("k"), F.col("at").alias("a"), F.col("id").alias("i"), F.col("digest").alias("d"))).alias("head"))
    order = Window.partitionBy("part").orderBy("bucket")
    firsts = firsts.withColumn("before", F.lag("bucket").over(order))
    ends = {r["part"]: r["last"] for r in firsts.groupBy("part").agg(F.max("bucket").alias("last")).collect()}
    parts = sorted(ends)
    earlier = {p: parts[i - 1] for i, p in enumerate(parts)}
    lit_map = lambda values: F.create_map(*(F.lit(x) for kv in values.items() for x in kv)) if values else F.create_map(F.lit(0), F.lit(0))
    to_part = F.when(F.col("before").isNull(), F.element_at(lit_map(earlier), F.col("part"))).otherwise(F.col("part"))
    to_bucket = F.coalesce("before", F.element_at(lit_map({p: ends[earlier[p]] for p in parts}), F.col("part")))
    firsts = F.broadcast(firsts.select(F.col("head.i").alias("__id"), F.col("head.d").alias("__digest"), to_part.cast("int").alias("part"), to_bucket.cast("long").alias("bucket")))
    heads = docs.join(firsts, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")))
    columns = ["id", "text", "digest", "copies", "part", "bucket", "head"]
    rows = placed(docs).withColumn("head", F.lit(False)).select(columns).unionByName(heads.withColumn("head", F.lit(True)).select(columns))
    ahead = Window.partitionBy("part", "bucket").orderBy("head", "id", "digest")
    found = rows.select("id", "text", "head", "copies", F.lead("text").over(ahead).alias("next_text")).filter(~F.col("head"))
    if not repeated:
        return found.select("id", "text", "next_text")
    # of rows that are equal, all but the last are followed by an equal one
    nexts = F.when(F.col("copies") > 1, F.array(F.struct((F.col("copies") - 1).alias("n"), F.col("text").alias("t")), F.struct(F.lit(1).cast("long").alias("n"), F.col("next_text").alias("t"))))
    nexts = F.coalesce(nexts, F.array(F.struct(F.lit(1).cast("long").alias("n"), F.col("next_text").alias("t"))))
    spread = found.select("id", "text", F.inline(nexts)).select("id", "text", F.col("t").alias("next_text"), F.explode(F.expr("sequence(1L, n)")).alias("__nth"))
    return spread.drop("__nth")


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit by the next document, and their likeness.

    The edit replaces the last half of the code points (rounded down) by as many
    from the start of the next document.
    """
    rows = with_next(docs, id, text).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))"))
    rows = rows.withColumns({f"{n}_tree": tree(F.col(c)) for n, c in (("own", "text"), ("edited", "edited"), ("next", "next_text"))})
    rows = rows.select("id", "n_chars", "edited", "own_tree", "edited_tree", *(leaf_set(F.col(f"{n}_tree")).alias(f"{n}_leaves") for n in ("own", "edited", "next")))
    return rows.select(
        F.col("id").alias(id),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("own_tree")).alias("fingerprint"),
        fingerprint(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("own_leaves"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("own_leaves"), F.col("next_leaves")).alias("near_next"),
    )
