"""Onset detection: detection functions over segments, peak picking, evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import schema_with
from ..params import PeakPickingParams, SegmentationParams, StftParams
from .features import spectral_flux
from .phase_space import embedding_entropy
from .segment import segmentation
from .spectral import stft


def peaks(v: np.ndarray, params: PeakPickingParams) -> np.ndarray:
    """Flags of a series' peaks. A peak is the greatest of its neighbourhood, exceeds the neighbourhood's mean by delta and isn't
    below a decaying threshold. Places before the beginning and after the end repeat the end values."""
    b, a, alpha = params.n_before, params.n_after, params.alpha
    if not len(v):
        return np.zeros(0, bool)
    near = np.lib.stride_tricks.sliding_window_view(np.pad(v, (b, a), "edge"), a + b + 1)
    top, mean, threshold, g = np.empty(len(v)), np.empty(len(v)), np.empty(len(v)), 0.0
    for k in range(0, len(v), 65536):
        top[k : k + 65536], mean[k : k + 65536] = near[k : k + 65536].max(1), near[k : k + 65536].sum(1) / (a + b + 1)
    for k, x in enumerate(v.tolist()):
        threshold[k] = g
        g = max(x, alpha * g + (1 - alpha) * x)
    return (v >= top) & (v >= mean + params.delta) & (v >= threshold)


def pick(odf: DataFrame, params: PeakPickingParams) -> DataFrame:
    """odf (series_id, seg, frame, time, value) with is_peak. The threshold is an ordered fold: a series' values come sorted to one
    task, which holds one series at a time and works in time proportional to its length."""
    names = ["series_id", "seg", "frame", "time", "value"]
    odf = odf.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(open_).combine_chunks()
            flags = peaks(t["value"].to_numpy(), params)
            yield from t.append_column("is_peak", pa.array(flags, pa.bool_())).to_batches(max_chunksize=10_000)

        last = None
        for batch in batches:
            series, low = batch.column(0).to_pylist(), 0
            for k in range(len(series)):
                if open_ and series[k] != last or k > low and series[k] != last:
                    if k > low:
                        open_.append(batch.slice(low, k - low))
                    yield from done()
                    open_.clear()
                    low = k
                last = series[k]
            if len(series) > low:
                open_.append(batch.slice(low))
        if open_:
            yield from done()

    ordered = odf.repartition("series_id").sortWithinPartitions("series_id", "seg")
    return ordered.mapInArrow(run, schema_with(odf, names, "is_peak boolean"))


def flux_odf(signal: DataFrame, params: StftParams) -> DataFrame:
    """Spectral flux, not below its mean over the series."""
    spectrogram = stft(signal, params)
    flux = spectral_flux(spectrogram)
    mean = flux.groupBy("series_id").agg(F.avg("flux").alias("mean"))
    center = F.col("seg") * (params.n_perseg - params.n_overlap) + (0 if params.extend else params.n_perseg // 2)
    time = center / F.lit(float(params.fps))
    return flux.join(mean, "series_id").select("series_id", "seg", F.floor(time * params.fps).cast("long").alias("frame"), time.alias("time"), F.greatest("flux", "mean").alias("value"))


def flux_onsets(signal: DataFrame, params: StftParams, picking: PeakPickingParams | None = None) -> DataFrame:
    return pick(flux_odf(signal, params), picking or PeakPickingParams()).where("is_peak").drop("is_peak")


def entropy_odf(signal: DataFrame, fps: int, segments: SegmentationParams, m_dim: int = 3, delay: int = 10, n_bins: int = 10) -> DataFrame:
    """Entropy of each segment's delay embedding."""
    cut = segmentation(signal, segments)
    return cut.select("series_id", "seg", F.col("center").alias("frame"), (F.col("center") / F.lit(float(fps))).alias("time"), embedding_entropy(F.col("data"), delay, m_dim, n_bins).alias("value"))


def entropy_onsets(signal: DataFrame, fps: int, segments: SegmentationParams, picking: PeakPickingParams | None = None, **more) -> DataFrame:
    return pick(entropy_odf(signal, fps, segments, **more), picking or PeakPickingParams()).where("is_peak").drop("is_peak")


def evaluate_onsets(targets: DataFrame, estimates: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """name, precision, recall, f: greatest one-to-one matching of times within the tolerance, by a sweep over both sorted lists."""
    t = targets.groupBy("name").agg(F.sort_array(F.collect_list("time")).alias("t"))
    e = estimates.groupBy("name").agg(F.sort_array(F.collect_list("time")).alias("e"))
    none = F.expr("cast(array() as array<double>)")
    both = t.join(e, "name", "full").select("name", F.coalesce("t", none).alias("t"), F.coalesce("e", none).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                i = j = hits = 0
                while i < len(a) and j < len(b):
                    if abs(a[i] - b[j]) <= tolerance:
                        hits, i, j = hits + 1, i + 1, j + 1
                    elif a[i] < b[j]:
                        i += 1
                    else:
                        j += 1
                p, r = hits / len(b) if b else 0.0, hits / len(a) if a else 0.0
                out.append((p, r, 2 * p * r / (p + r) if p + r else 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], pa.float64()) for k in range(3))], ["name", "precision", "recall", "f"])

    return both.mapInArrow(run, f"name {targets.schema['name'].dataType.simpleString()}, precision double, recall double, f double")
