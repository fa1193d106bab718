"""Interfaces of the model-side steps, which have no relational form.

Language-model generation, codecs, vocoders, transcription and speaker
embedding are callables that a user plugs in; the engine batches rows to them
and keeps what they return as columns.  A factory runs once per worker process
and task, so models load where they are used.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


class Tokenizer(Protocol):
    def encode(self, text: str, add_special_tokens: bool = False) -> list[int]: ...


class Synthesizer(Protocol):
    def __call__(self, text: str, speaker: str) -> tuple[np.ndarray, list[int], bool]: ...


class Transcriber(Protocol):
    def transcribe(self, samples: np.ndarray, rate: int, language: str | None = None) -> str: ...


class Embedder(Protocol):
    def __call__(self, samples: np.ndarray, rate: int) -> np.ndarray: ...


class Generator(Protocol):
    def __call__(self, prompt_ids: list[int], most: int) -> list[int]: ...


class Encoder(Protocol):
    """Samples to three streams of N, 2N and 4N codes."""

    def __call__(self, samples: np.ndarray) -> tuple[list[int], list[int], list[int]]: ...


class Decoder(Protocol):
    def __call__(self, token_ids: list[int]) -> np.ndarray: ...


def loaded(name: str) -> Callable:
    """The callable ``package.module:attribute``, as a factory that a worker imports where it runs."""
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"{name!r} isn't of the form package.module:attribute")
    return getattr(importlib.import_module(module), attribute)


class FileTokenizer:
    """A :class:`Tokenizer` over a raw vocabulary file (JSON of the tokenizers library)."""

    unknown_id = None

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Raw

        self.raw = Raw.from_file(path)

    def id_of(self, token: str) -> int | None:
        return self.raw.token_to_id(token)

    def encode(self, text: str, add_special_tokens: bool = False) -> list[int]:
        return self.raw.encode(text, add_special_tokens=add_special_tokens).ids

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        """``token, id``, for ``functions.tokens.resolve``."""
        return spark.createDataFrame(sorted(self.raw.get_vocab().items(), key=lambda kv: kv[1]), "token string, id int")


def _with(rows: DataFrame, needed: Sequence[str], columns: str, start: Callable[[], Callable[..., Sequence[tuple]]]) -> DataFrame:
    """``rows`` with what a callable returns for each batch of the needed columns, which it gets as lists."""
    names = [c.split()[0] for c in columns.split(", ")]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many = start()
        for batch in batches:
            found = many(*(batch[c].tolist() for c in needed))
            for i, name in enumerate(names):
                batch[name] = pd.Series([x[i] for x in found], index=batch.index, dtype=object)
            yield batch

    return rows.mapInPandas(run, f"{kept}, {columns}")


def tokenized(rows: DataFrame, factory: Callable[[], Tokenizer], text: str = "text") -> DataFrame:
    def start():
        tokenizer = factory()
        return lambda texts: [(tokenizer.encode(t),) for t in texts]

    return _with(rows, [text], "text_ids array<int>", start)


def synthesized(rows: DataFrame, factory: Callable[[], Synthesizer]) -> DataFrame:
    def start():
        speak = factory()
        return lambda texts, speakers: [speak(*x) for x in zip(texts, speakers, strict=True)]

    return _with(rows, ["text", "speaker"], "samples array<float>, token_ids array<int>, hit boolean", start)


def transcribed(rows: DataFrame, factory: Callable[[], Transcriber], rate: int, forward_language: bool = True) -> DataFrame:
    """``forward_language=False`` leaves the language to the backend's default; a backend with ``transcribe_all`` gets a batch at once."""
    forward = forward_language and "language_id" in rows.columns

    def start():
        backend = factory()

        def many(samples, languages=None):
            waves = [np.asarray(x) for x in samples]
            languages = languages or [None] * len(waves)
            if hasattr(backend, "transcribe_all"):
                return [(t,) for t in backend.transcribe_all(waves, rate, languages)]
            return [(backend.transcribe(x, rate, language),) for x, language in zip(waves, languages, strict=True)]

        return many

    return _with(rows, ["samples", *(["language_id"] if forward else [])], "hypothesis string", start)


def embedded(rows: DataFrame, factory: Callable[[], Embedder], rate: int) -> DataFrame:
    def start():
        embed = factory()
        return lambda samples: [([float(x) for x in embed(np.asarray(s), rate)],) for s in samples]

    return _with(rows, ["samples"], "vector array<double>", start)


def generated(rows: DataFrame, factory: Callable[[], Generator], most: int, stop: int | None = None) -> DataFrame:
    """``rows`` (``prompt_ids``) with the new ids, without the stop token, and whether the limit ended them."""

    def start():
        go_on = factory()

        def one(prompt: list[int]) -> tuple[list[int], bool]:
            ids = list(go_on(list(prompt), most))[:most]
            ended = stop is not None and stop in ids
            return (ids[: ids.index(stop)] if ended else ids), not ended and len(ids) >= most

        return lambda prompts: [one(p) for p in prompts]

    return _with(rows, ["prompt_ids"], "token_ids array<int>, hit boolean", start)


def coded(rows: DataFrame, factory: Callable[[], Encoder]) -> DataFrame:
    """``rows`` (``samples``) with a codec's three streams, for ``functions.tokens.interleaved``."""

    def start():
        encode = factory()
        return lambda samples: [tuple([int(c) for c in stream] for stream in encode(np.asarray(x, np.float32))) for x in samples]

    return _with(rows, ["samples"], "c0 array<int>, c1 array<int>, c2 array<int>", start)


def decoded(rows: DataFrame, factory: Callable[[], Decoder]) -> DataFrame:
    """``rows`` (``token_ids``) with their waveform, held to -1..1."""

    def start():
        decode = factory()
        return lambda ids: [(np.clip(np.asarray(decode(list(i)), np.float32), -1.0, 1.0).tolist(),) for i in ids]

    return _with(rows, ["token_ids"], "samples array<float>", start)


def decoded_pairs(rows: DataFrame, first: Callable[[], Callable[[list[int]], np.ndarray]], second: Callable[[], Callable[[list[int]], np.ndarray]]) -> DataFrame:
    """``rows`` (``token_ids``) decoded by two decoders, both held to -1..1: ``samples`` and ``stock_samples``."""

    def start():
        one, other = first(), second()
        held = lambda x: np.clip(np.asarray(x, np.float32), -1.0, 1.0).tolist()
        return lambda ids: [(held(one(list(i))), held(other(list(i)))) for i in ids]

    return _with(rows, ["token_ids"], "samples array<float>, stock_samples array<float>", start)
