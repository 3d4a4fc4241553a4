"""Discrete Fourier transforms of segments (series_id, seg, ..., data). Each segment is transformed in its row; nothing is shuffled."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import places, schema_with, total
from ..params import DftParams, StftParams
from .segment import segmentation

#: Longest transform that is written as expressions; longer ones go to numpy in Arrow batches.
EXPRESSIONS = 8


#: Coefficients of sums of cosines; fixed values.
COSINES = {
    "rect": (1.0,),
    "boxcar": (1.0,),
    "hamming": (0.54, 0.46),
    "hann": (0.5, 0.5),
    "blackman": (0.42, 0.5, 0.08),
    "nuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411),
    "blackmanharris": (0.35875, 0.48829, 0.14128, 0.01168),
    "flattop": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368),
}


def _bohman(f: float) -> float:
    return 0.0 if f >= 1 else (1 - f) * math.cos(math.pi * f) + math.sin(math.pi * f) / math.pi


def _parzen(d: float, n: int) -> float:
    r = d / (n / 2)
    return 1 - 6 * r * r + 6 * r**3 if d <= (n - 1) / 4 else 2 * (1 - r) ** 3


#: Windows by place i of n, symmetric; f is the distance to the middle, as a share of half the length, d the distance in samples.
SHAPES = {
    "bartlett": lambda i, n, f, d: 1 - f,
    "barthann": lambda i, n, f, d: 0.62 - 0.24 * f + 0.38 * math.cos(math.pi * f),
    "bohman": lambda i, n, f, d: _bohman(f),
    "cosine": lambda i, n, f, d: math.sin(math.pi / n * (i + 0.5)),
    "exponential": lambda i, n, f, d: math.exp(-d),
    "lanczos": lambda i, n, f, d: 1.0 if d == 0 else math.sin(math.pi * f) / (math.pi * f),
    "parzen": lambda i, n, f, d: _parzen(d, n),
    "triang": lambda i, n, f, d: triangle(n, i),
    "tukey": lambda i, n, f, d: 1.0 if f <= 0.5 else 0.5 * (1 + math.cos(2 * math.pi * (f - 0.5))),
}


def window(name: str, n: int, symmetric: bool = False) -> list[float]:
    """Window values; periodic unless symmetric."""
    if name not in COSINES and name not in SHAPES:
        raise ValueError(f"unknown window {name!r}")
    if n <= 1:
        return [1.0] * n
    size = n if symmetric else n + 1  # a periodic window is a longer symmetric one without its last value
    if name in COSINES:
        return [sum((-1) ** k * c * math.cos(2 * math.pi * k * i / (size - 1)) for k, c in enumerate(COSINES[name])) for i in range(n)]
    half = (size - 1) / 2
    return [SHAPES[name](i, size, abs(i - half) / half, abs(i - half)) for i in range(n)]


def triangle(n: int, i: int) -> float:
    k = min(i, n - 1 - i) + 1
    return (2 * k - 1) / n if n % 2 == 0 else 2 * k / (n + 1)


def dft(segments: DataFrame, params: DftParams, norm: bool = True) -> DataFrame:
    """segments with the columns re and im, arrays over the bins 0 ... n_fft // 2, instead of data. With norm every bin is doubled
    and divided by the window's sum. n_fft None: the segment's length; shorter cuts it, longer fills it with 0."""
    own = [c for c in segments.columns if c != "data"]
    if params.n_fft is not None and params.n_fft <= EXPRESSIONS:
        return _dft_expressions(segments, own, params, norm)
    at = len(own)
    schema = schema_with(segments, own, "re array<double>, im array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(at)
            sizes = np.diff(col.offsets.to_numpy())
            res, ims = [None] * len(sizes), [None] * len(sizes)
            values, starts = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()[:-1]
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                if not n:
                    continue
                win = np.array(window(params.window, int(n)))
                x = np.fft.rfft(values[starts[rows][:, None] + np.arange(n)] * win, params.n_fft or int(n), axis=1)
                if norm:
                    x = x / abs(win.sum()) * 2
                for r, a in zip(rows.tolist(), x, strict=True):
                    res[r], ims[r] = a.real, a.imag
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(at)), pa.array(res, pa.list_(pa.float64())), pa.array(ims, pa.list_(pa.float64()))], [*own, "re", "im"])

    return segments.select(*own, "data").mapInArrow(run, schema)


def _dft_expressions(segments: DataFrame, own: list[str], params: DftParams, norm: bool) -> DataFrame:
    n = params.n_fft
    # the window is as long as the segment; its values are made from the segment's own size
    size = F.size("data").cast("double")
    w = {
        "rect": lambda i: F.lit(1.0),
        "boxcar": lambda i: F.lit(1.0),
        "hamming": lambda i: 0.54 - 0.46 * F.cos(2 * math.pi * i / size),
        "hann": lambda i: 0.5 - 0.5 * F.cos(2 * math.pi * i / size),
        "blackman": lambda i: 0.42 - 0.5 * F.cos(2 * math.pi * i / size) + 0.08 * F.cos(4 * math.pi * i / size),
    }
    if params.window not in w:
        raise ValueError(f"window {params.window!r} has no expression; use a longer n_fft")
    weighted = segments.withColumn("_x", F.transform("data", lambda x, i: x * w[params.window](i))).withColumn("_s", total(F.transform("data", lambda x, i: w[params.window](i))))
    factor = 2.0 / F.abs(F.col("_s")) if norm else F.lit(1.0)
    turn = -2 * math.pi / n

    def part(k: int, f) -> Column:
        terms = [F.coalesce(F.get("_x", F.lit(j)), F.lit(0.0)) * f(turn * ((k * j) % n)) for j in range(n)]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out * factor

    bins = range(n // 2 + 1)
    return weighted.select(*own, F.array(*[part(k, math.cos) for k in bins]).alias("re"), F.array(*[part(k, math.sin) for k in bins]).alias("im"))


def magnitudes(spectra: DataFrame, fps: int, n_fft: int) -> DataFrame:
    """spectra with frq and amp (arrays over the bins) beside re and im."""
    frq = F.transform(places(n_fft // 2 + 1), lambda k: k * (fps / n_fft))
    return spectra.withColumns({"amp": F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b)), "frq": frq})


def phase(re: Column, im: Column) -> Column:
    return F.zip_with(re, im, lambda a, b: F.atan2(b, a))


def stft(signal: DataFrame, params: StftParams) -> DataFrame:
    """series_id, seg, time, re, im, amp, frq of a long signal."""
    n_fft = params.n_fft or params.n_perseg
    spectra = dft(segmentation(signal, params.segmentation()), DftParams(params.fps, params.window, n_fft))
    return magnitudes(spectra, params.fps, n_fft).withColumn("time", F.col("center") / F.lit(float(params.fps)))


def spectrogram_centroid(spectrogram: DataFrame) -> DataFrame:
    """One centroid per series, over all its segments."""
    each = spectrogram.select("series_id", total(F.zip_with("amp", "frq", lambda a, f: a * f)).alias("w"), total(F.col("amp")).alias("s"))
    return each.groupBy("series_id").agg((F.sum("w") / F.nullif(F.sum("s"), F.lit(0.0))).alias("centroid"))


def bins(spectra: DataFrame, *columns: str) -> DataFrame:
    """One row per bin: series_id, seg, bin and the given array columns' elements."""
    zipped = F.arrays_zip(*columns) if len(columns) > 1 else F.transform(F.col(columns[0]), lambda x: F.struct(x.alias(columns[0])))
    return spectra.select("series_id", "seg", F.posexplode(zipped).alias("bin", "b")).select("series_id", "seg", F.col("bin").cast("long").alias("bin"), "b.*")


def butter_bandpass(fs: float, low: float, high: float, order: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a Butterworth band-pass, by the bilinear transform."""
    w1, w2 = (4 * np.tan(np.pi * f / fs) for f in (low, high))
    width, mid = w2 - w1, np.sqrt(w1 * w2)
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order)) * width / 2
    shift = np.sqrt(poles**2 - mid**2)
    poles = np.r_[poles + shift, poles - shift]
    gain = width**order * np.real(4.0**order / np.prod(4 - poles))
    zeros = np.r_[np.ones(order), -np.ones(order)]
    return gain * np.real(np.poly(zeros)), np.real(np.poly((4 + poles) / (4 - poles)))


def bandpass_filter(segments: DataFrame, fs: float, low: float, high: float, order: int = 4) -> DataFrame:
    """data after a causal band-pass with zero initial state. The recursion steps through the samples of a batch's segments together."""
    b, a = butter_bandpass(fs, low, high, order)
    own = [c for c in segments.columns if c != "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(x or [], float) for x in batch.column(len(own)).to_pylist()]
            x = np.zeros((max(map(len, rows), default=0), len(rows)))
            for k, r in enumerate(rows):
                x[: len(r), k] = r
            y, state = np.zeros_like(x), np.zeros((len(b), len(rows)))
            for i, v in enumerate(x):
                y[i] = b[0] * v + state[0]
                state[:-1] = state[1:] + b[1:, None] * v - a[1:, None] * y[i]
            out = [y[: len(r), k] for k, r in enumerate(rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(own))), pa.array(out, pa.list_(pa.float64()))], [*own, "data"])

    return segments.select(*own, "data").mapInArrow(run, schema_with(segments, own, "data array<double>"))
