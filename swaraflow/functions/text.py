"""Text cleaning, features and keys."""

from __future__ import annotations

import logging
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

NORMALIZER_VERSION = "mr-norm-v1"
# fixed patterns: a run of Latin letters with inner marks; digits, ASCII and Devanagari; the Devanagari block
LATIN_WORD = "[A-Za-z][A-Za-z'’.\\-]*"
DIGIT = "[0-9०-९]"
DEVANAGARI = "[ऀ-ॿ]"

_HORIZONTAL = re.compile(r"[^\S\n]+")


def clean_text(text: str) -> str:
    """NFC, no characters of a category C* but line feeds, horizontal white space collapsed, ends stripped."""
    composed = unicodedata.normalize("NFC", text)
    if composed.isascii() and composed.isprintable():
        printable = composed
    else:
        printable = "".join(c for c in composed if c == "\n" or not unicodedata.category(c).startswith("C"))
    return _HORIZONTAL.sub(" ", printable).strip()


#: Bytes of text that Python works on at once: what a worker holds beside a batch goes by this, not by the batch.
SLICE = 1 << 20


def _slices(batches: Iterable[pa.Array]) -> Iterator[pa.Array]:
    """Batches of texts in parts of about ``SLICE`` bytes, or of one longer text."""
    for texts in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist(), len(texts)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            yield texts.slice(start, stop - start)


def _clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in _slices(batches):
        yield pa.array([None if t is None else clean_text(t) for t in texts.to_pylist()], pa.string())


_cleaned, _cleaned_once = F.arrow_udf(_clean, StringType()), F.arrow_udf(_clean, StringType()).asNondeterministic()


#: Texts of these characters are in NFC and hold none of a category C* but line feeds.
PLAIN = "^[\\n -~\u00a1-\u00ac\u00ae-\u02ff]*$"


def _ranges(points: Iterable[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b) for a, b in out]


def _class(points: Iterable[int], block: int = 0x800) -> str:
    """A character class for the JVM; blocks with ranges of their own inside, so that few ranges are tried for each character."""
    blocks: dict[int, list[int]] = {}
    for p in points:
        blocks.setdefault(p // block, []).append(p)
    span = lambda a, b: f"\\x{{{a:X}}}-\\x{{{b:X}}}"
    return "".join(f"[{span(k * block, (k + 1) * block - 1)}&&[{''.join(span(*r) for r in _ranges(own))}]]" for k, own in sorted(blocks.items()))


@cache
def unsettled() -> str:
    """A pattern that texts in need of Python hold: everything but settled texts.

    A settled text is in NFC by the quick check, holds nothing of a category C* but
    line feeds, and no white space but spaces and line feeds.  The tables are those of
    this Python's Unicode version: characters that composition leaves alone and that
    can't be the second of a composed pair, without a combining class, or with one and
    not next to another such.
    """
    points = [p for p in range(0x30000) if not 0xD800 <= p < 0xE000]
    pairs = (unicodedata.decomposition(chr(p)).split() for p in points)
    seconds = {int(d[1], 16) for d in pairs if len(d) == 2 and d[0][0] != "<"} | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # and Hangul's vowels and finals
    quiet = [p for p in points if chr(p) in " \n" or not (unicodedata.category(chr(p))[0] == "C" or chr(p).isspace() or p in seconds or unicodedata.normalize("NFC", chr(p)) != chr(p))]
    marks = [p for p in quiet if unicodedata.combining(chr(p))]
    return f"[^{_class(quiet)}]|[{_class(marks)}]{{2}}"


def cleaned(text: Column | str, once: bool = False) -> Column:
    """:func:`clean_text` of a column.

    Settled texts (:func:`unsettled`) of any script take a path in the JVM; Latin
    letters below U+0300 are looked for first.  Others go to Python, as Spark has no NFC.
    With ``once`` a filter on the result isn't moved below it, where it would clean each
    text a second time, in a Python worker of its own.
    """
    text = F.col(text) if isinstance(text, str) else text
    plain = text.rlike(PLAIN) | ~text.rlike(unsettled())
    single = F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text)
    here = F.btrim(single, F.lit(" \n"))
    return F.when(plain, here).otherwise((_cleaned_once if once else _cleaned)(F.when(~plain, text)))


def expanded_numbers(backend: Callable[[str, str], str], language: str):
    """A column function that puts each run of ASCII digits through ``backend``.

    A run on which the backend fails stays as it is and is logged.
    """

    def spoken(match: re.Match) -> str:
        try:
            return backend(match[0], language)
        except Exception:
            logging.getLogger(__name__).warning("number %r was not expanded", match[0])
            return match[0]

    @F.pandas_udf(StringType())
    def expand(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: re.sub("[0-9]+", spoken, x), na_action="ignore")

    return expand


def digit_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(DIGIT))


def latin_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LATIN_WORD), F.lit(0))


def latin_word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(LATIN_WORD))


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("text", StringType())]))
_QUOTE = "’".encode()


def _spans(texts: pa.Array) -> pa.Array:
    """The words of :data:`LATIN_WORD` in the texts' UTF-8 bytes: a run of a word's characters holds one word, from its first letter on."""
    held = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, content = held.buffers()
    at = np.frombuffer(offsets, np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64) if len(held) else np.zeros(1, np.int64)
    data = np.frombuffer(content, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
    at = at - at[0]
    letter = ((data | 0x20) - np.uint8(ord("a"))) < 26
    inner = letter | (data == ord("'")) | (data == ord(".")) | (data == ord("-"))
    quotes = np.flatnonzero(data == _QUOTE[0])
    quotes = quotes[quotes + 2 < len(data)]
    quotes = quotes[(data[quotes + 1] == _QUOTE[1]) & (data[quotes + 2] == _QUOTE[2])]
    for k in range(3):
        inner[quotes + k] = True
    # a run ends with its text; no text begins within a character
    edges = np.zeros(len(data) + 1, bool)
    edges[at] = True
    opens, closes = inner.copy(), inner.copy()
    opens[1:] &= ~inner[:-1] | edges[1:-1]
    closes[:-1] &= ~inner[1:] | edges[1:-1]
    run, stops = np.cumsum(opens, dtype=np.int32), np.flatnonzero(closes) + 1
    letters = np.flatnonzero(letter)
    of = run[letters]
    first = np.diff(of, prepend=0) > 0
    starts, ends = letters[first], stops[of[first] - 1]
    points = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    number = np.searchsorted(starts, at)  # of words before each text
    base = np.repeat(points[at[:-1]], np.diff(number))
    within = np.zeros(len(data) + 1, np.int8)
    within[starts] += 1
    within[ends] -= 1
    words = data[np.cumsum(within[:-1], dtype=np.int8).astype(bool)]
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    text = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(words))
    flat = pa.StructArray.from_arrays([pa.array(points[starts] - base), pa.array(points[ends] - base), text], names=["start", "end", "text"])
    return pa.ListArray.from_arrays(pa.array(number, pa.int32()), flat, mask=texts.is_null())


@F.arrow_udf(SPANS)
def latin_spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each word with its offsets in code points.

    Python, as a fold over a long text would copy its spans at each word; a slice's
    words are found in its bytes together, none is a Python object.
    """
    for texts in _slices(batches):
        yield _spans(texts)


def script_tag(text: Column) -> Column:
    return F.when(text.rlike(DEVANAGARI), F.lit("Deva")).otherwise(F.lit("Latn"))


def normalization_record(text: Column) -> Column:
    """Struct of the normalized text and its features; ``text`` is already cleaned."""
    todo = F.when(text.rlike("[0-9]"), F.array(F.lit("expand_numbers"))).otherwise(F.array().cast("array<string>"))
    return F.struct(
        text.alias("text_normalized"),
        script_tag(text).alias("script"),
        digit_count(text).alias("num_digits"),
        latin_word_count(text).alias("num_english_words"),
        latin_spans(text).alias("code_switch_spans"),
        F.lit(NORMALIZER_VERSION).alias("normalizer_version"),
        todo.alias("todos"),
    )


def sha16(value: Column) -> Column:
    return F.substring(F.sha2(value.cast("binary"), 256), 1, 16)


def clip_key(source: Column, path: Column, ordinal: Column) -> Column:
    """Key of a row: its path, or its ordinal where the path is missing or empty."""
    return sha16(F.concat(source, F.lit("::"), F.coalesce(F.nullif(path, F.lit("")), ordinal.cast("string"))))


def slug(text: Column) -> Column:
    """At most 32 letters and digits (others as ``_``), lower-cased; ``utt`` for nothing."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.coalesce(F.nullif(F.substring(plain, 1, 32), F.lit("")), F.lit("utt"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def shown(value: Column, digits: int = 3) -> Column:
    """A number for a table cell: fixed decimals, an em dash for NaN and null."""
    return F.when(value.isNull() | F.isnan(value), F.lit("—")).otherwise(F.format_string(f"%.{digits}f", value))
