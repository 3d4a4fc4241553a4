"""Features of segments and spectra as expressions on array columns: one projection computes as many as are asked for."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import dot, let, max_abs, places, schema_with, total
from ..functions.scalars import SPL_REF, c_weighting, specific_loudness, weight_factor
from .spectral import triangle, window

BANDS = 24


def energy(data: Column) -> Column:
    """Sum of squares; NaN or infinite values raise an error."""
    fine = F.forall(data, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, dot(data, data)).otherwise(F.raise_error(F.lit("energy: values must be finite")).cast("double"))


def rms(data: Column) -> Column:
    return F.sqrt(F.try_divide(dot(data, data), F.size(data).cast("double")))


def frms(amp: Column, n_sig: int, win: str | None = None) -> Column:
    """Root mean square of a signal of n_sig samples from its normalised spectrum."""
    last = n_sig // 2
    scaled = F.transform(amp, lambda a, k: F.when((k == last) & F.lit(n_sig % 2 == 0), a * n_sig).otherwise(a * n_sig / 2))
    out = F.sqrt(2.0 * dot(scaled, scaled)) / n_sig
    if win is None:
        return out
    w = window(win, n_sig, symmetric=True)
    return out / math.sqrt(sum(x * x for x in w) / n_sig)


def spl(data: Column, ref: float = SPL_REF) -> Column:
    """Level of the rms; null for silence."""
    return F.when(rms(data) > 0, 20.0 * F.log10(rms(data) / ref))


def fspl(amp: Column, ref: float = SPL_REF) -> Column:
    """Level of each bin."""
    return F.transform(amp, lambda a: 10.0 * F.log10(F.greatest(F.lit(1.0), (a / ref) * (a / ref))))


def fspl_total(amp: Column, ref: float = SPL_REF) -> Column:
    return 10.0 * F.log10(F.greatest(F.lit(1.0), total(F.transform(amp, lambda a: (a / ref) * (a / ref)))))


def fsplc(frq: Column, amp: Column, ref: float = SPL_REF) -> Column:
    """C-weighted level of each bin."""
    return fspl(F.zip_with(frq, amp, lambda f, a: c_weighting(f) * a), ref)


def fsplc_total(frq: Column, amp: Column, ref: float = SPL_REF) -> Column:
    return fspl_total(F.zip_with(frq, amp, lambda f, a: c_weighting(f) * a), ref)


def power_distribution(amp: Column) -> Column:
    return let(F.struct(amp.alias("a"), total(amp).alias("s")), lambda x: F.transform(x.a, lambda a: a / F.when(x.s == 0, 1.0).otherwise(x.s)))


def spectral_centroid(frq: Column, amp: Column) -> Column:
    return dot(frq, power_distribution(amp))


def _moment(frq: Column, amp: Column, order: int) -> Column:
    return let(
        F.struct(frq.alias("f"), power_distribution(amp).alias("p"), spectral_centroid(frq, amp).alias("c")),
        lambda x: total(F.zip_with(x.f, x.p, lambda f, p: F.pow(f - x.c, F.lit(float(order))) * p)),
    )


def spectral_spread(frq: Column, amp: Column) -> Column:
    return F.sqrt(_moment(frq, amp, 2))


def spectral_skewness(frq: Column, amp: Column) -> Column:
    return F.try_divide(_moment(frq, amp, 3), F.pow(spectral_spread(frq, amp), F.lit(3.0)))


def spectral_kurtosis(frq: Column, amp: Column) -> Column:
    return F.try_divide(_moment(frq, amp, 4), F.pow(spectral_spread(frq, amp), F.lit(4.0)))


def spectral_flux(spectrogram: DataFrame, delta: float = 1.0, sum_bins: bool = True) -> DataFrame:
    """series_id, seg, flux: the positive part of the magnitudes' gradient over time (central, one-sided at the ends).

    Each segment meets its neighbours by an equi-join-like regrouping on (series_id, seg): no window over a whole series.
    Series of one segment have no gradient and no rows."""
    dealt = spectrogram.select("series_id", "amp", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d"), "seg").select("series_id", (F.col("seg") - F.col("d")).alias("seg"), "d", "amp")
    near = dealt.groupBy("series_id", "seg").agg(*[F.max(F.when(F.col("d") == d, F.col("amp"))).alias(n) for d, n in ((-1, "before"), (0, "own"), (1, "after"))])
    near = near.where(F.col("own").isNotNull() & (F.col("before").isNotNull() | F.col("after").isNotNull()))
    width = F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), 2.0 * delta).otherwise(delta)
    rise = F.zip_with(F.coalesce("after", "own"), F.coalesce("before", "own"), lambda b, a: F.greatest((b - a) / width, F.lit(0.0)))
    return near.select("series_id", "seg", (total(rise) if sum_bins else rise).alias("flux"))


def filter_bank(frqs: list[float]) -> list[list[tuple[int, float]]]:
    """Per critical band the (bin, weight)s of its symmetric triangle."""
    bark = [13 * math.atan(0.00076 * f) + 3.5 * math.atan((f / 7500) ** 2) for f in frqs]
    out = []
    for z in range(BANDS):
        members = [k for k, b in enumerate(bark) if z <= b < z + 1]
        out.append([(k, triangle(len(members), i)) for i, k in enumerate(members)])
    return out


def band_intensities(amp: Column, frqs: list[float]) -> Column:
    """Array of the 24 bands' weighted sums, as plain arithmetic."""

    def one(members) -> Column:
        out = F.lit(0.0)
        for k, w in members:
            out = out + F.coalesce(F.get(amp, F.lit(k)), F.lit(0.0)) * w
        return out

    return F.array(*[one(m) for m in filter_bank(frqs)])


def loudness(intensities: Column) -> Column:
    return total(F.transform(intensities, specific_loudness))


def sharpness(spectra: DataFrame, intensities: Column, per_frame: bool = False) -> DataFrame:
    """series_id, seg, sharpness. The total loudness below the line is that of the whole series, or of the frame with per_frame."""
    above = total(F.transform(intensities, lambda c, i: (i + 1) * weight_factor((i + 1).cast("double")) * c))
    below = total(F.transform(intensities, lambda c: F.greatest(specific_loudness(c), F.lit(2.220446049250313e-16))))
    each = spectra.select("series_id", "seg", above.alias("above"), below.alias("below"))
    if per_frame:
        return each.select("series_id", "seg", (F.col("above") / F.col("below")).alias("sharpness"))
    sums = each.groupBy("series_id").agg(F.sum("below").alias("all"))
    return each.join(sums, "series_id").select("series_id", "seg", (F.col("above") / F.col("all")).alias("sharpness"))


def roughness(amp: Column, d_frq: float, frq_max: float) -> Column:
    """Helmholtz roughness of a frame: the autocorrelation of its strong bins, weighted by distance."""
    size = round(frq_max / d_frq) + 1
    kernel = [k * d_frq / (33 / math.e) * math.exp(-k * d_frq / 33) for k in range(size)]
    first = F.transform(places(size), lambda k: F.coalesce(F.get(amp, k), F.lit(0.0)))
    strong = let(first, lambda a: F.transform(a, lambda x: F.when(F.array_max(a) > 0, x / F.array_max(a)).otherwise(0.0)))
    strong = F.transform(strong, lambda x: F.when(x < 0.1, 0.0).otherwise(x))
    lags = let(strong, lambda a: F.transform(places(size), lambda d: F.when(d == 0, 0.0).otherwise(total(F.transform(F.slice(a, 1, F.lit(size) - d), lambda x, i: x * F.get(a, i + d))))))
    scaled = let(lags, lambda r: F.transform(r, lambda x: F.when(F.array_max(r) > 0, x / F.array_max(r)).otherwise(0.0)))
    weights = F.array(*[F.lit(k) for k in kernel])
    return let(scaled, lambda r: F.coalesce(F.try_divide(dot(r, weights), F.size(F.filter(r, lambda x: x > 0.2)).cast("double")), F.lit(0.0)))


def maxamp(data: Column) -> Column:
    return max_abs(data)


def minamp(data: Column) -> Column:
    return F.array_min(F.transform(data, lambda x: F.abs(x)))


def log_attack_time(segments: DataFrame, fps: int) -> DataFrame:
    """series_id, seg, lat: log of the time of the envelope's first peak; segments begin at onsets (``by_onsets``)."""
    own = [c for c in segments.columns if c != "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(len(own)).to_pylist():
                spec = np.fft.fft(np.array(x, float))
                n = len(spec)
                keep = np.zeros(n)
                keep[0] = 1
                keep[1 : (n + 1) // 2] = 2
                if n % 2 == 0:
                    keep[n // 2] = 1
                peak = int(np.abs(np.fft.ifft(spec * keep)).argmax())
                out.append(float(np.log(peak / fps)) if peak else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(own))), pa.array(out, pa.float64())], [*own, "lat"])

    return segments.select(*own, "data").mapInArrow(run, schema_with(segments, own, "lat double"))
