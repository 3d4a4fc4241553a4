"""Autocorrelation, correlograms, delay embeddings and correlation dimension of segments, each within its row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import dot, euclidean, let, places, total
from .segment import delay_embedding


def acf(data: Column) -> Column:
    """r[lag] = sum x[i] x[i + lag] / sum x²; noughts for silence."""
    return let(data, lambda x: F.transform(places(F.size(x)), lambda d: F.coalesce(F.try_divide(total(F.transform(F.slice(x, 1, F.size(x) - d), lambda v, i: v * F.get(x, i + d))), dot(x, x)), F.lit(0.0))))


def corr(a: Column, b: Column) -> Column:
    """Pearson's r of two arrays; 0 where it isn't defined."""
    n = F.size(a).cast("double")
    sums = F.struct(total(a).alias("a"), total(b).alias("b"), dot(a, b).alias("ab"), dot(a, a).alias("aa"), dot(b, b).alias("bb"))
    return let(sums, lambda s: F.coalesce(F.try_divide(n * s.ab - s.a * s.b, F.sqrt(F.greatest((n * s.aa - s.a * s.a) * (n * s.bb - s.b * s.b), F.lit(0.0)))), F.lit(0.0)))


def acf_pearson(data: Column) -> Column:
    """Pearson's r of the segment and itself at lags 0 ... n - 2."""
    return let(data, lambda x: F.transform(places(F.size(x) - 1), lambda d: corr(F.slice(x, 1, F.size(x) - d), F.slice(x, d + 1, F.size(x) - d))))


def correlogram(segments: DataFrame, wlen: int, n_delay: int, sum_all: bool = False, delays: list[int] | None = None) -> DataFrame:
    """series_id, seg, lag, offset, value: max(r, 0)⁴ of windows of wlen samples and those lag samples later.

    Rows of lags 1 ... n_delay - 1 and one of noughts for lag n_delay; offsets 0 ... n - wlen - n_delay - 1. With sum_all the mean over
    all of them, a segment."""
    lags = delays if delays is not None else list(range(1, n_delay + 1))
    top = max(lags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for series, seg, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.array(x, float)
                count = len(x) - wlen - top
                if count < 1:
                    continue
                win = np.lib.stride_tricks.sliding_window_view(x, wlen)
                value = np.zeros((len(lags), count))
                a = win[:count] - win[:count].mean(1, keepdims=True)
                for k, lag in enumerate(lags):
                    if delays is None and lag == n_delay:
                        continue
                    b = win[lag : lag + count] - win[lag : lag + count].mean(1, keepdims=True)
                    below = np.sqrt((a * a).sum(1) * (b * b).sum(1))
                    r = np.divide((a * b).sum(1), below, out=np.zeros(count), where=below > 1e-12)
                    value[k] = np.maximum(r, 0) ** 4
                if sum_all:
                    for c, v in zip(out, (series, seg, None, None, value.mean()), strict=True):
                        c.append(v)
                else:
                    n = value.size
                    for c, v in zip(out, ([series] * n, [seg] * n, np.repeat(lags, count).tolist(), np.tile(np.arange(count), len(lags)).tolist(), value.ravel().tolist()), strict=True):
                        c += v
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["series_id", "seg", "lag", "offset", "value"])

    kind = segments.schema["series_id"].dataType.simpleString()
    return segments.select("series_id", F.col("seg").cast("long"), "data").mapInArrow(run, f"series_id {kind}, seg long, lag long, offset long, value double")


def embedding_dists(data: Column, delay: int, m_dim: int, metric=euclidean) -> Column:
    """Condensed distances of a segment's delay vectors: (0, 1), (0, 2), ..., (1, 2), ..."""
    pairs = lambda v: F.flatten(F.transform(v, lambda a, i: F.transform(F.slice(v, i + 2, F.size(v)), lambda b: metric(a, b))))
    return let(delay_embedding(data, delay, m_dim), pairs)


def embedding_entropy(data: Column, delay: int, m_dim: int, n_bins: int) -> Column:
    """Entropy (nats) of the delay vectors' histogram with n_bins equal bins between each dimension's ends. Cells are summed by size, so
    histograms with the same counts have the same entropy to the last bit, in whatever order their cells come; peak picking compares them."""

    def ends(v: Column, k: int) -> Column:
        c = F.transform(v, lambda x: x[k])
        low, high = F.array_min(c), F.array_max(c)
        return F.struct(F.when(high > low, low).otherwise(low - 0.5).alias("a"), F.when(high > low, high).otherwise(high + 0.5).alias("b"))

    def entropy(v: Column) -> Column:
        return let(
            F.array(*[ends(v, k) for k in range(m_dim)]),
            lambda e: let(
                F.transform(v, lambda x: sum((F.least(F.floor((x[k] - e[k].a) / (e[k].b - e[k].a) * n_bins), F.lit(n_bins - 1)) * (n_bins**k) for k in range(1, m_dim)), F.least(F.floor((x[0] - e[0].a) / (e[0].b - e[0].a) * n_bins), F.lit(n_bins - 1)))),
                lambda cells: total(F.array_sort(F.transform(F.array_distinct(cells), lambda c: let(F.size(F.filter(cells, lambda x: x == c)) / F.size(cells), lambda p: -p * F.log(p))))),
            ),
        )

    return let(delay_embedding(data, delay, m_dim), entropy)


def log_histogram_bin_edges(dists: Column, n_bins: int) -> Column:
    """Geometric edges from the least to the greatest value; a least value of 0 is replaced by the least positive step
    between neighbours, or by the least positive value."""
    low, high = F.array_min(dists), F.array_max(dists)
    steps = F.filter(F.transform(F.slice(dists, 2, F.size(dists)), lambda x, i: F.abs(x - F.get(dists, i))), lambda d: d > 0)
    positive = F.filter(dists, lambda d: d > 0)
    start = F.when(low > 0, low).otherwise(F.coalesce(F.array_min(steps), F.array_min(positive)))
    return let(F.struct(F.log(start).alias("a"), F.log(high).alias("b")), lambda e: F.transform(places(n_bins + 1), lambda i: F.exp(e.a + i * (e.b - e.a) / n_bins)))


#: Delay vectors that the correlation dimension looks at; fixed value.
CDIM_VECTORS = 2390


def cdim(segments: DataFrame, delay: int, m_dim: int, n_bins: int = 1000, scaling_size: int = 10, vectors: int = CDIM_VECTORS) -> DataFrame:
    """series_id, seg, cdim: slope of the correlation integral of 16-bit samples; null for segments that are too short.

    Distances are made block by block, so memory stays at one block of rows."""
    need = vectors + (m_dim - 1) * delay

    def one(x: np.ndarray) -> float | None:
        if len(x) < need:
            return None
        emb = np.stack([x[k * delay : k * delay + vectors] for k in range(m_dim)], 1).astype(float)
        top = 0.0
        for turn in range(2):
            hist = np.zeros(n_bins, np.int64)
            for i in range(0, vectors, 128):
                a = emb[i : i + 128]
                d = np.sqrt(np.maximum(((a[:, None, :] - emb[None, i:, :]) ** 2).sum(2), 0))
                d = d[np.arange(d.shape[1])[None, :] >= np.arange(len(a))[:, None]]
                if not turn:
                    top = max(top, float(d.max()))
                    continue
                at = np.floor((np.floor(d) - 1) / step).astype(np.int64) + 1
                at[d < 1] = 0
                hist += np.bincount(at[(d < 1) | (at + 1 < n_bins)], minlength=n_bins)[:n_bins]
            step = max(1, int(top / 1000))
        all_ = vectors * (vectors + 1) // 2
        cum = np.cumsum(hist)
        peak = int(hist[: int(0.6 * n_bins)].argmax())
        end = min(peak + scaling_size, n_bins - 1)
        run = np.log(end * step + 1) - np.log(peak * step + 1)
        if end == peak or not cum[peak] or run == 0:
            return 0.0
        out = (np.log(cum[end] / all_) - np.log(cum[peak] / all_)) / run
        return None if out < 0 else float(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([one(np.array(x)) for x in batch.column(2).to_pylist()], pa.float64())], ["series_id", "seg", "cdim"])

    kind = segments.schema["series_id"].dataType.simpleString()
    return segments.select("series_id", F.col("seg").cast("long"), "data").mapInArrow(run, f"series_id {kind}, seg long, cdim double")


def correlation_sum(data: Column, delay: int, m_dim: int, radius: float) -> Column:
    """Share of the pairs of delay vectors that are nearer than radius."""
    return let(embedding_dists(data, delay, m_dim), lambda d: F.try_divide(F.size(F.filter(d, lambda x: x < radius)).cast("double"), F.size(d).cast("double")))
