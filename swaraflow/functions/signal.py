"""Waveform functions: Arrow-batched Python, as Spark has no codec and no Fourier transform.

A waveform is an ``array<float>`` of mono samples in -1..1 beside its rate.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, FloatType, StructField, StructType

from ..sources.committed import publish
from .arrays import let
from .pitch import track
from .text import slug

FRAME_S, HOP_S = 0.025, 0.010
FULL_SCALE, ROLLOFF = 0.999, 0.99
WIDEBAND_HZ, PAUSE_DB = 6000.0, -35.0
#: Resampling: zero crossings of the filter on each side, its window's shape, and the share of the lower half rate that passes.
CROSSINGS, KAISER, ROLL_OFF = 64, 14.0, 0.945


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """PCM WAV (8, 16, 24 or 32 bits) as mono floats, the channels averaged, and the rate."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width, raw = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, "<i2" if width == 2 else "<i4").astype(np.float32) / (1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1).astype(np.float32), rate


def encode(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono PCM WAV."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


@cache
def phases(up: int, down: int) -> np.ndarray:
    """The filter taps of each of ``up`` phases: a sinc under a Kaiser window, cut off below the lower half rate; a row sums to 1."""
    cutoff = ROLL_OFF * min(1.0, up / down)
    reach = int(np.ceil(CROSSINGS / cutoff))
    at = np.arange(1 - reach, reach + 1)[None, :] - np.arange(up)[:, None] / up
    taps = cutoff * np.sinc(cutoff * at) * np.i0(KAISER * np.sqrt(np.clip(1 - (at / reach) ** 2, 0, 1))) / np.i0(KAISER)
    return taps / taps.sum(axis=1, keepdims=True)


def resample(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Band-limited resampling by a polyphase filter, ceil(n * target / rate) samples; another resampler can be passed where this one is taken."""
    if rate == target or not len(samples):
        return samples
    g = np.gcd(rate, target)
    up, down = int(target // g), int(rate // g)
    taps = phases(up, down)
    reach = taps.shape[1] // 2
    padded = np.pad(np.asarray(samples, np.float64), reach)
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach)
    n = -(-len(samples) * up // down)
    out = np.empty(n, np.float32)
    for first in range(0, n, 8192):
        at = np.arange(first, min(first + 8192, n)) * down
        out[first : first + len(at)] = np.einsum("ij,ij->i", windows[at // up + 1], taps[at % up])
    return out


def _frames(x: np.ndarray, rate: int, seconds: float = FRAME_S, hop: float = HOP_S) -> list[np.ndarray]:
    width, step = max(1, int(seconds * rate)), max(1, int(hop * rate))
    return [x[i : i + width] for i in range(0, max(1, len(x) - width), step)]


def quality(samples: np.ndarray, rate: int, wideband_hz: float = WIDEBAND_HZ) -> tuple[float, float, float, float, bool]:
    """Duration, signal to noise in dB, clipping ratio, rolloff in Hz, wide band.

    The rolloff is where 99 % of the summed magnitude (not energy) is reached.
    """
    x = np.asarray(samples, np.float64)
    if not len(x):
        return 0.0, -np.inf, 1.0, 0.0, False
    energy = np.array([np.mean(f * f) for f in _frames(x, rate)]) + 1e-12
    low, high = np.percentile(energy, (10, 95))
    total = np.cumsum(np.abs(np.fft.rfft(x)))
    at = int(np.searchsorted(total, ROLLOFF * total[-1])) if total[-1] > 0 else 0
    rolloff = at * rate / len(x)
    return len(x) / rate, float(10 * np.log10(high / low)), float(np.mean(np.abs(x) >= FULL_SCALE)), rolloff, bool(rolloff >= wideband_hz)


def energy_pause(samples: np.ndarray, rate: int, pause_db: float = PAUSE_DB) -> tuple[float, float]:
    """Deviation of the frames' root mean squares, and the share of frames below the peak by ``pause_db``."""
    x = np.asarray(samples, np.float64)
    rms = np.array([np.sqrt(np.mean(f * f) + 1e-12) if len(f) else 0.0 for f in _frames(x, rate)])
    level = 20 * np.log10(rms / (rms.max() + 1e-12) + 1e-12)
    return float(rms.std()), float(np.mean(level < pause_db))


def pitch(samples: np.ndarray, rate: int) -> tuple[float | None, float | None]:
    """Mean and deviation of the pitch over voiced frames, by a probabilistic tracker; null without voiced frames."""
    found = track(samples, rate)
    found = found[np.isfinite(found)]
    return (float(found.mean()), float(found.std())) if len(found) else (None, None)


def clamped(samples: Column) -> Column:
    """Samples held to -1..1."""
    return F.transform(samples, lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)))


def fitted(samples: Column) -> Column:
    """A waveform that reaches full scale, scaled to a peak just below; others stay as they are. PCM then holds it whole, where it would cut its peaks."""
    peak = F.array_max(F.transform(samples, F.abs))
    return let(F.struct(samples.alias("x"), peak.alias("peak")), lambda s: F.when(s["peak"] >= FULL_SCALE, F.transform(s["x"], lambda v: v * (0.99 / s["peak"]))).otherwise(s["x"]))


def mel_bands(samples: np.ndarray, rate: int, bands: int = 80, width: int = 2048, hop: int = 256) -> np.ndarray:
    """Decibels of ``bands`` triangular bands, even on the mel scale, over hopping frames: ``bands`` x frames."""
    x = np.pad(np.asarray(samples, np.float64), width // 2)
    count = max(1, 1 + (len(x) - width) // hop)
    x = np.pad(x, (0, max(0, (count - 1) * hop + width - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, width)[::hop][:count]
    power = np.abs(np.fft.rfft(frames * np.hanning(width + 1)[:-1], axis=1)) ** 2
    to_mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(rate / 2), bands + 2) / 2595) - 1)
    hz = np.fft.rfftfreq(width, 1 / rate)
    rise, fall = ((hz - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - hz) / np.diff(edges)[1:, None])
    return 10 * np.log10(np.maximum(0, np.minimum(rise, fall)) @ power.T + 1e-9)


def mel_correlation(a: np.ndarray, b: np.ndarray, rate: int) -> float:
    """Correlation of two decodes' mel bands over the frames that both have; NaN where one is constant."""
    x, y = (mel_bands(s, rate) for s in (a, b))
    n = min(x.shape[1], y.shape[1])
    with np.errstate(invalid="ignore", divide="ignore"):
        return float(np.corrcoef(x[:, :n].ravel(), y[:, :n].ravel())[0, 1])


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("first_seconds", "second_seconds", "mel_correlation")]))
def decode_comparison(waves: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Two decodes of the same ids (``samples, samples, rate``): their durations and how alike they are; nulls where one is missing."""
    for first, second, rates in waves:
        rows = [(None,) * 3 if a is None or b is None else (len(a) / r, len(b) / r, mel_correlation(a, b, int(r))) for a, b, r in zip(first, second, rates, strict=True)]
        yield pd.DataFrame(rows, columns=["first_seconds", "second_seconds", "mel_correlation"], dtype="float64")


def write_waves(rows: DataFrame, path: str, rate: int, overwrite: bool = False) -> None:
    """A WAV file for each row (``idx, text, samples`` and, for an A/B pair, ``stock_samples``), named by number and slug.

    All files of a folder appear together or not at all; a null waveform has none.
    """
    named = rows.withColumn("name", F.format_string("%02d_%s", "idx", slug(F.col("text"))))
    pairs = [("", "samples"), *([("_stock", "stock_samples")] if "stock_samples" in rows.columns else [])]
    waves = F.explode(F.array(*(F.struct(F.concat("name", F.lit(f"{suffix}.wav")).alias("path"), F.col(c).alias("samples")) for suffix, c in pairs)))
    files = named.select(waves.alias("w")).filter("w.samples is not null").select("w.path", encoded(F.col("w.samples"), F.lit(rate)).alias("content"))
    publish(files, path, overwrite)


def decoded(target_rate: int | None, resampler: Callable[[np.ndarray, int, int], np.ndarray] = resample):
    """Binary WAV cells -> struct ``samples, rate, native_rate``, resampled unless ``target_rate`` is None; null and broken cells give null."""

    @F.pandas_udf("samples array<float>, rate int, native_rate int")
    def convert(cells: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in cells:
            rows = []
            for data in batch:
                try:
                    x, rate = decode(data)
                    target = target_rate or rate
                    rows.append((resampler(x, rate, target), target, rate))
                except (TypeError, wave.Error, EOFError):
                    rows.append((None, None, None))
            yield pd.DataFrame(rows, columns=["samples", "rate", "native_rate"]).astype({"rate": "Int32", "native_rate": "Int32"})

    return convert


@F.pandas_udf(BinaryType())
def encoded(waves: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """``samples, rate`` as WAV cells."""
    for samples, rates in waves:
        yield pd.Series([None if x is None else encode(np.asarray(x), int(r)) for x, r in zip(samples, rates, strict=True)], dtype=object)


@F.pandas_udf(ArrayType(FloatType()))
def resampled(waves: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Samples at ``rate`` as samples at a target rate."""
    for samples, rates, targets in waves:
        yield pd.Series([None if x is None else resample(np.asarray(x, np.float32), int(r), int(t)) for x, r, t in zip(samples, rates, targets, strict=True)], dtype=object)


@F.pandas_udf(StructType([*(StructField(n, DoubleType()) for n in ("duration_s", "snr_db", "clipping_ratio", "bandwidth_hz")), StructField("wideband", BooleanType())]))
def clip_quality(waves: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for samples, rates in waves:
        rows = [quality([], 1) if x is None else quality(x, int(r)) for x, r in zip(samples, rates, strict=True)]
        yield pd.DataFrame(rows, columns=["duration_s", "snr_db", "clipping_ratio", "bandwidth_hz", "wideband"])


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("mean_f0", "f0_std", "energy_std", "pause_ratio")]))
def prosody(waves: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for samples, rates in waves:
        rows = [(*pitch(x, int(r)), *energy_pause(x, int(r))) for x, r in zip(samples, rates, strict=True)]
        yield pd.DataFrame(rows, columns=["mean_f0", "f0_std", "energy_std", "pause_ratio"], dtype="float64")


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("energy_std", "pause_ratio")]))
def energy_and_pauses(waves: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """:func:`energy_pause` of ``samples, rate, pause_db``."""
    for samples, rates, limits in waves:
        yield pd.DataFrame([energy_pause(x, int(r), float(d)) for x, r, d in zip(samples, rates, limits, strict=True)], columns=["energy_std", "pause_ratio"])
