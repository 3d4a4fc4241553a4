"""Segmentation: hopping, tumbling, sliding and event-anchored windows over frames.

Signals are long: series_id, frame (from 0, without gaps), value. A frame is dealt to the segments it lies in and segments are
gathered by (series_id, seg), so no task holds more than a segment, however long a series is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import SegmentationParams


def sizes(signal: DataFrame) -> DataFrame:
    return signal.groupBy("series_id").agg((F.max("frame") + 1).alias("n"))


def _gather(signal: DataFrame, grid: DataFrame, length: int, first: Column, last: Column, start_of) -> DataFrame:
    """Segments of ``length`` frames. grid: series_id, seg. first, last: numbers of the segments a frame may lie in;
    start_of(seg): a segment's first frame. Frames outside the signal are 0."""
    dealt = signal.where(last >= first).select("series_id", "frame", "value", F.explode(F.sequence(first, last)).alias("seg"))
    dealt = dealt.select("series_id", "seg", (F.col("frame") - start_of(F.col("seg"))).cast("int").alias("j"), "value")
    rows = dealt.unionByName(grid.select("series_id", "seg", F.lit(None).cast("int").alias("j"), F.lit(None).cast("double").alias("value")))
    held = F.filter(F.sort_array(F.collect_list(F.struct("j", "value"))), lambda x: x.j.isNotNull() & (x.j < length))
    packed = rows.groupBy("series_id", "seg").agg(held.alias("held"), F.max(F.col("j").isNull()).alias("real")).where("real")
    before = F.coalesce(F.get("held", F.lit(0)).j, F.lit(0))
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    data = F.concat(zeros(before), F.transform("held", lambda x: x.value), zeros(length - before - F.size("held")))
    return packed.select("series_id", "seg", data.alias("data"))


def segmentation(signal: DataFrame, params: SegmentationParams) -> DataFrame:
    """series_id, seg, center, lo, hi, data. Series shorter than a segment have none."""
    p, step, ext = params.n_perseg, params.step, params.ext
    n = F.col("n")
    pad = F.pmod(F.pmod(-(n - p), F.lit(step)), F.lit(p)) if params.pad else F.lit(0)
    count = F.floor((n + 2 * ext + pad - params.n_overlap) / step).cast("long")
    grid = sizes(signal).where(n >= p).select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("seg"))
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("frame") + ext - p + 1) / step).cast("long"))
    last = F.floor((F.col("frame") + ext) / step).cast("long")
    out = _gather(signal, grid, p, first, last, lambda s: s * step - ext)
    center = F.col("seg") * step + (0 if params.extend else p // 2)
    return out.select("series_id", "seg", center.alias("center"), (center - p // 2).alias("lo"), (center - p // 2 + p).alias("hi"), "data")


def by_samples(signal: DataFrame, n_perseg: int, hop: int = 0) -> DataFrame:
    """Tumbling segments (hop < 1), or sliding ones; the tail is filled with 0."""
    if n_perseg < 1:
        raise ValueError("n_perseg must be positive")
    n, frame = F.col("n"), F.col("frame")
    if hop < 1:
        grid = sizes(signal).select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / n_perseg).cast("long"))).alias("seg"))
        own = F.floor(frame / n_perseg).cast("long")
        return _gather(signal, grid, n_perseg, own, own, lambda s: s * n_perseg)
    if n_perseg < 2:
        raise ValueError("n_perseg must be over 1")
    hops = F.floor((n - n_perseg) / hop).cast("long") + 1
    more = F.when((F.pmod(n - n_perseg, F.lit(hop)) > 0) & F.lit(n_perseg > hop), 1).otherwise(0)
    grid = sizes(signal).where(n >= n_perseg).select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), hops + more - 1)).alias("seg"))
    first = F.greatest(F.lit(0).cast("long"), F.ceil((frame - n_perseg + 1) / hop).cast("long"))
    return _gather(signal, grid, n_perseg, first, F.floor(frame / hop).cast("long"), lambda s: s * hop)


def by_ms(signal: DataFrame, fps: int, ms_perseg: int, hop: int = 0) -> DataFrame:
    return by_samples(signal, fps * ms_perseg // 1000, fps * hop // 1000 if hop else 0)


def by_onsets(signal: DataFrame, n_perseg: int, onsets: DataFrame, off: int = 0) -> DataFrame:
    """One segment from each onset (series_id, seg, index) on: starts are clamped to the series, the tail is filled with 0.

    The frames that each onset needs are listed and met by an equi-join, so no pairs of onsets and frames are made beyond them."""
    starts = onsets.join(sizes(signal), "series_id").select("series_id", "seg", F.least(F.greatest(F.col("index") + off, F.lit(0)), F.col("n") - 1).cast("long").alias("start"))
    wanted = starts.select("series_id", "seg", F.posexplode(F.sequence(F.col("start"), F.col("start") + n_perseg - 1)).alias("j", "frame"))
    met = wanted.join(signal, ["series_id", "frame"], "left").groupBy("series_id", "seg").agg(F.sort_array(F.collect_list(F.struct("j", F.coalesce("value", F.lit(0.0)).alias("value")))).alias("held"))
    return met.select("series_id", "seg", F.transform("held", lambda x: x.value).alias("data"))


def zero_padding(data: Column, n: int) -> Column:
    return F.concat(data, F.array_repeat(F.lit(0.0), n))


def delay_embedding(data: Column, delay: int, m_dim: int) -> Column:
    """Array of the vectors (x[i], x[i + delay], ...)."""
    count = F.size(data) - (m_dim - 1) * delay
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array(*[F.get(data, i + k * delay) for k in range(m_dim)])))


def delay_embedding_frames(signal: DataFrame, delay: int, m_dim: int) -> DataFrame:
    """The same on long signals: series_id, frame, vec, by shifting and regrouping frames, without a window over a series."""
    shifted = signal.select("series_id", "value", F.posexplode(F.array(*[F.col("frame") - k * delay for k in range(m_dim)])).alias("k", "frame")).where("frame >= 0")
    out = shifted.groupBy("series_id", "frame").agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("v"))
    return out.where(F.size("v") == m_dim).select("series_id", "frame", F.transform("v", lambda x: x.value).alias("vec"))
