"""Queries of spectra, features and critical bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import features as X
from ..operators import spectral as S
from ..params import DftParams, StftParams
from .common import VEC, flux_cte, r6, seg_cte, spec_cte

FPS = 32000


def spectra(s, d, window="rect", n_fft=64, fps=FPS):
    return S.magnitudes(S.dft(A.sig_vec(s, d), DftParams(fps, window, n_fft)), fps, n_fft)


def _bins(df, expr, name):
    return df.select("series_id", F.posexplode(expr).alias("k", "v")).select("series_id", F.col("k").cast("long").alias("k"), r6("v").alias(name))


def _magnitude(window, n_fft):
    return (
        lambda s, d: _bins(spectra(s, d, window, n_fft), F.col("amp"), "a"),
        f"WITH {VEC}, {spec_cte('vec', 'series_id', 64, n_fft, window)} SELECT series_id, k, round(a, 6) + 0.0 AS a FROM spec",
    )


def power(s, d):
    return _bins(spectra(s, d), F.transform("amp", lambda a: a * a), "p")


def frequencies(s, d):
    return _bins(spectra(s, d), F.col("frq"), "frq")


def phase(s, d):
    x = spectra(s, d).withColumn("p", F.transform(F.arrays_zip(S.phase(F.col("re"), F.col("im")).alias("p"), "amp"), lambda z: F.when(z.amp > 1e-3, F.cos(z.p))))
    return _bins(x, F.col("p"), "cos_phase").where("cos_phase IS NOT NULL")


STFT = StftParams(16, "hamming", None, 16, 8, True, True)


def stft_magnitude(s, d):
    x = S.stft(A.sig_user(s, d), STFT)
    return x.select("series_id", "seg", r6("time").alias("time"), F.posexplode("amp").alias("k", "a")).select("series_id", "seg", "time", F.col("k").cast("long").alias("k"), r6("a").alias("a"))


def stft_small(s, d):
    """The same transform written as expressions: a short n_fft stays in the JVM."""
    x = S.stft(A.sig_user(s, d), StftParams(16, "hann", 8, 16, 8, False, False))
    return x.select("series_id", "seg", F.posexplode("amp").alias("k", "a")).select("series_id", "seg", F.col("k").cast("long").alias("k"), r6("a").alias("a"))


def spectrogram_centroid_total(s, d):
    return S.spectrogram_centroid(S.stft(A.sig_user(s, d), STFT)).select("series_id", r6("centroid").alias("centroid"))


def _vec(name, expr, sql):
    return lambda s, d: A.sig_vec(s, d).select("series_id", r6(expr(F.col("data"))).alias(name)), f"WITH {VEC} SELECT series_id, round({sql}, 6) + 0.0 AS {name} FROM vec GROUP BY series_id"


SPEC = f"WITH {VEC}, {spec_cte('vec', 'series_id', 64, 64)}"
PROB = SPEC + ", sums AS (SELECT series_id, sum(a) AS s FROM spec GROUP BY series_id), p AS (SELECT spec.series_id, k, k * 500.0::DOUBLE AS f, a, a / s AS p FROM spec JOIN sums USING (series_id)), c AS (SELECT series_id, sum(f * p) AS c FROM p GROUP BY series_id)"
SPREAD = PROB + ", sp AS (SELECT p.series_id, sqrt(sum(pow(f - c, 2) * p)) AS s FROM p JOIN c USING (series_id) GROUP BY p.series_id)"


def _spec(name, expr, sql):
    return lambda s, d: spectra(s, d).select("series_id", r6(expr()).alias(name)), sql


frq, amp = lambda: F.col("frq"), lambda: F.col("amp")


def frms(s, d):
    return spectra(s, d).select("series_id", r6(X.frms(F.transform("amp", lambda a: a / 1.0), 64)).alias("frms"))


def frms_windowed(s, d):
    return spectra(s, d).select("series_id", r6(X.frms(F.col("amp"), 64, "hamming")).alias("frms"))


def fspl_bins(s, d):
    return _bins(spectra(s, d), X.fspl(F.col("amp")), "l")


def power_distribution(s, d):
    return _bins(spectra(s, d), X.power_distribution(F.col("amp")), "p")


def flux(s, d):
    return X.spectral_flux(S.stft(A.sig_user(s, d), STFT)).select("series_id", "seg", r6("flux").alias("flux"))


def flux_per_bin(s, d):
    x = X.spectral_flux(S.stft(A.sig_user(s, d), STFT), sum_bins=False)
    return x.select("series_id", "seg", F.posexplode("flux").alias("k", "v")).select("series_id", "seg", F.col("k").cast("long").alias("k"), r6("v").alias("v"))


FRQS = [k * FPS / 64 for k in range(33)]


def bands(s, d):
    return _bins(spectra(s, d), X.band_intensities(F.col("amp"), FRQS), "v")


def filter_bank(s, d):
    rows = [(z, k, w) for z, band in enumerate(X.filter_bank(FRQS)) for k, w in band]
    return s.createDataFrame(rows, "band long, k long, w double").select("band", "k", r6("w").alias("w"))


def loudness(s, d):
    return spectra(s, d).select("series_id", r6(X.loudness(X.band_intensities(F.col("amp"), FRQS))).alias("loudness"))


def sharpness(s, d):
    return X.sharpness(spectra(s, d), X.band_intensities(F.col("amp"), FRQS)).select("series_id", r6("sharpness").alias("sharpness"))


def roughness(s, d):
    """At 64 frames a second bins are one Hertz wide."""
    return spectra(s, d, fps=64).select("series_id", r6(X.roughness(F.col("amp"), 1.0, 20.0)).alias("roughness"))


def log_attack_time(s, d):
    return X.log_attack_time(A.sig_vec(s, d), FPS).select("series_id", r6("lat").alias("lat"))


def fsplc_bins(s, d):
    return _bins(spectra(s, d), X.fsplc(F.col("frq"), F.col("amp")), "l")


def bandpass(s, d):
    return _bins(S.bandpass_filter(A.sig_vec(s, d), 64.0, 4.0, 12.0), F.col("data"), "x")


_BANK = """bark AS (SELECT k, floor(13 * atan(0.00076::DOUBLE * k * 500) + 3.5::DOUBLE * atan(pow(k * 500.0::DOUBLE / 7500, 2)))::BIGINT AS band FROM range(0, 33) AS k(k)),
pos AS (SELECT band, k, row_number() OVER (PARTITION BY band ORDER BY k) AS i, count(*) OVER (PARTITION BY band) AS n FROM bark WHERE band < 24),
bank AS (SELECT band, k, CASE WHEN n % 2 = 0 THEN (2 * least(i, n + 1 - i) - 1) / n::DOUBLE ELSE 2 * least(i, n + 1 - i) / (n + 1)::DOUBLE END AS w FROM pos)"""
_CB = f"{SPEC}, {_BANK}, cb AS (SELECT s.series_id, z.z, coalesce(sum(b.w * spec.a), 0) AS v FROM (SELECT DISTINCT series_id FROM spec) s CROSS JOIN range(0, 24) AS z(z) LEFT JOIN bank b ON b.band = z.z LEFT JOIN spec ON spec.series_id = s.series_id AND spec.k = b.k GROUP BY ALL)"
_SL = "pow(10 * log10(greatest(v, 1e-11::DOUBLE) / 1e-11::DOUBLE), 0.23::DOUBLE)"
_STFT = f"WITH {seg_cte(16, 8, True, True)}, {spec_cte('seg', 'series_id, seg', 16, 16, 'hamming')}"

def _recursion(b, a) -> str:
    """The filter as a difference equation over a segment's samples, outside of which all is nought."""
    past = " + ".join([f"{v!r}::DOUBLE * coalesce(CASE WHEN i >= {k} THEN x[i + 1 - {k}] END, 0)" if k else f"{v!r}::DOUBLE * x[i + 1]" for k, v in enumerate(b)])
    fed = " ".join(f"- ({v!r}::DOUBLE) * coalesce(CASE WHEN i >= {k} THEN y[i + 1 - {k}] END, 0)" for k, v in enumerate(a) if k)
    return f"""WITH RECURSIVE v AS (SELECT vec_id AS series_id, embedding::DOUBLE[] AS x FROM embeddings),
f(series_id, x, i, y) AS (SELECT series_id, x, 0, []::DOUBLE[] FROM v UNION ALL
  SELECT series_id, x, i + 1, list_append(y, ({past}) {fed}) FROM f WHERE i < 64)
SELECT series_id, k.k, round(y[k.k + 1], 6) + 0.0 AS x FROM f, range(0, 64) AS k(k) WHERE i = 64"""


_BANDPASS = _recursion(*(c.tolist() for c in S.butter_bandpass(64.0, 4.0, 12.0)))

QUERIES = {
    "dft_magnitude": _magnitude("rect", 64),
    "dft_hamming": _magnitude("hamming", 64),
    "dft_hann": _magnitude("hann", 64),
    "dft_nfft_padded": _magnitude("rect", 128),
    "dft_nfft_cut": _magnitude("hamming", 16),
    "dft_power": (power, f"{SPEC} SELECT series_id, k, round(a * a, 6) + 0.0 AS p FROM spec"),
    "dft_phase": (phase, f"{SPEC} SELECT series_id, k, round(cos(atan2(im, re)), 6) + 0.0 AS cos_phase FROM spec WHERE a > 1e-3"),
    "frequencies": (frequencies, f"{SPEC} SELECT series_id, k, round(k * 500.0::DOUBLE, 6) + 0.0 AS frq FROM spec"),
    "stft_magnitude": (stft_magnitude, f"{_STFT} SELECT series_id, seg, round(seg * 8 / 16.0::DOUBLE, 6) + 0.0 AS time, k, round(a, 6) + 0.0 AS a FROM spec"),
    "stft_small": (stft_small, f"WITH {seg_cte(16, 8, False, False)}, {spec_cte('seg', 'series_id, seg', 16, 8, 'hann')} SELECT series_id, seg, k, round(a, 6) + 0.0 AS a FROM spec"),
    "spectrogram_centroid_total": (spectrogram_centroid_total, f"{_STFT} SELECT series_id, round(sum(a * k) / nullif(sum(a), 0), 6) + 0.0 AS centroid FROM spec GROUP BY series_id"),
    "energy": _vec("energy", X.energy, "sum(x * x)"),
    "rms": _vec("rms", X.rms, "sqrt(avg(x * x))"),
    "spl": _vec("spl", X.spl, "CASE WHEN avg(x * x) > 0 THEN 20 * log10(sqrt(avg(x * x)) / 2e-5::DOUBLE) END"),
    "maxamp": _vec("maxamp", X.maxamp, "max(abs(x))"),
    "minamp": _vec("minamp", X.minamp, "min(abs(x))"),
    "l1_norm": _vec("l1", lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + F.abs(b)), "sum(abs(x))"),
    "frms": (frms, f"{SPEC} SELECT series_id, round(sqrt(2 * sum(pow(CASE WHEN k = 32 THEN a * 64 ELSE a * 32 END, 2))) / 64, 6) + 0.0 AS frms FROM spec GROUP BY series_id"),
    "frms_windowed": (
        frms_windowed,
        f"{SPEC} SELECT series_id, round(sqrt(2 * sum(pow(CASE WHEN k = 32 THEN a * 64 ELSE a * 32 END, 2))) / 64 / max(w), 6) + 0.0 AS frms FROM spec CROSS JOIN (SELECT sqrt(avg(pow(0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * i / 63), 2))) AS w FROM range(0, 64) AS t(i)) GROUP BY series_id",
    ),
    "fspl": (fspl_bins, f"{SPEC} SELECT series_id, k, round(10 * log10(greatest(1, pow(a / 2e-5::DOUBLE, 2))), 6) + 0.0 AS l FROM spec"),
    "fspl_total": _spec("l", lambda: X.fspl_total(F.col("amp")), f"{SPEC} SELECT series_id, round(10 * log10(greatest(1, sum(pow(a / 2e-5::DOUBLE, 2)))), 6) + 0.0 AS l FROM spec GROUP BY series_id"),
    "fsplc": _spec(
        "l",
        lambda: X.fsplc_total(F.col("frq"), F.col("amp")),
        f"{SPEC} SELECT series_id, round(10 * log10(greatest(1, sum(pow(148693636.0::DOUBLE * f * f / ((f * f + 148693636.0::DOUBLE) * (f * f + 424.36::DOUBLE)) * a / 2e-5::DOUBLE, 2)))), 6) + 0.0 AS l FROM (SELECT *, k * 500.0::DOUBLE AS f FROM spec) GROUP BY series_id",
    ),
    "centroid": _spec("c", lambda: X.spectral_centroid(frq(), amp()), f"{PROB} SELECT series_id, round(c, 6) + 0.0 AS c FROM c"),
    "spread": _spec("s", lambda: X.spectral_spread(frq(), amp()), f"{SPREAD} SELECT series_id, round(s, 6) + 0.0 AS s FROM sp"),
    "skewness": _spec("v", lambda: X.spectral_skewness(frq(), amp()), f"{SPREAD} SELECT p.series_id, round(sum(pow((f - c) / s, 3) * p), 6) + 0.0 AS v FROM p JOIN c USING (series_id) JOIN sp USING (series_id) GROUP BY p.series_id"),
    "kurtosis": _spec("v", lambda: X.spectral_kurtosis(frq(), amp()), f"{SPREAD} SELECT p.series_id, round(sum(pow((f - c) / s, 4) * p), 6) + 0.0 AS v FROM p JOIN c USING (series_id) JOIN sp USING (series_id) GROUP BY p.series_id"),
    "power_distribution": (power_distribution, f"{PROB} SELECT series_id, k, round(p, 6) + 0.0 AS p FROM p"),
    "flux": (flux, f"{_STFT}, {flux_cte()} SELECT series_id, seg, round(flux, 6) + 0.0 AS flux FROM flux"),
    "flux_per_bin": (flux_per_bin, f"{_STFT}, {flux_cte()} SELECT series_id, seg, k, round(greatest(CASE WHEN before IS NULL THEN after - a WHEN after IS NULL THEN a - before ELSE (after - before) / 2 END, 0), 6) + 0.0 AS v FROM grad WHERE before IS NOT NULL OR after IS NOT NULL"),
    "filter_bank": (filter_bank, f"WITH {_BANK} SELECT band, k, round(w, 6) + 0.0 AS w FROM bank"),
    "critical_bands": (bands, f"{_CB} SELECT series_id, z AS k, round(v, 6) + 0.0 AS v FROM cb"),
    "loudness": (loudness, f"{_CB} SELECT series_id, round(sum({_SL}), 6) + 0.0 AS loudness FROM cb GROUP BY series_id"),
    "sharpness": (sharpness, f"{_CB} SELECT series_id, round(sum((z + 1) * greatest(1, 0.066::DOUBLE * exp(0.171::DOUBLE * (z + 1))) * v) / sum(greatest({_SL}, 2.220446049250313e-16::DOUBLE)), 6) + 0.0 AS sharpness FROM cb GROUP BY series_id"),
    "roughness": (
        roughness,
        f"""{SPEC}, f AS (SELECT series_id, k, a / max(a) OVER (PARTITION BY series_id) AS a FROM spec WHERE k <= 20), g AS (SELECT series_id, k, CASE WHEN a < 0.1 THEN 0 ELSE a END AS a FROM f),
l AS (SELECT x.series_id, y.k - x.k AS lag, CASE WHEN y.k = x.k THEN 0 ELSE sum(x.a * y.a) END AS r FROM g x JOIN g y ON x.series_id = y.series_id AND y.k >= x.k GROUP BY x.series_id, y.k - x.k, y.k = x.k),
m AS (SELECT series_id, lag, coalesce(r / nullif(max(r) OVER (PARTITION BY series_id), 0), 0) AS r FROM l)
SELECT series_id, round(coalesce(sum(r * lag / (33 / exp(1)) * exp(-lag / 33.0::DOUBLE)) / nullif(count(*) FILTER (r > 0.2), 0), 0), 6) + 0.0 AS roughness FROM m GROUP BY series_id""",
    ),
    "log_attack_time": (
        log_attack_time,  # the analytic signal: bins above nought count twice, the middle one once
        f"""WITH {VEC}, ft AS (SELECT series_id, k, sum(x * cos(2 * pi() * k * j / 64)) * w AS re, -sum(x * sin(2 * pi() * k * j / 64)) * w AS im
  FROM vec CROSS JOIN (SELECT k, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS w FROM range(0, 33) AS k(k)) GROUP BY series_id, k, w),
env AS (SELECT series_id, j, sqrt(pow(sum(re * cos(2 * pi() * k * j / 64) - im * sin(2 * pi() * k * j / 64)), 2) + pow(sum(re * sin(2 * pi() * k * j / 64) + im * cos(2 * pi() * k * j / 64)), 2)) AS e FROM ft CROSS JOIN range(0, 64) AS j(j) GROUP BY series_id, j),
top AS (SELECT series_id, j, row_number() OVER (PARTITION BY series_id ORDER BY round(e, 9) DESC, j) AS r FROM env)
SELECT series_id, round(CASE WHEN j > 0 THEN ln(j / {FPS}::DOUBLE) ELSE 0 END, 6) + 0.0 AS lat FROM top WHERE r = 1""",
    ),
    "bandpass": (bandpass, _BANDPASS),
    "fsplc_bins": (fsplc_bins, f"{SPEC} SELECT series_id, k, round(10 * log10(greatest(1, pow(148693636.0::DOUBLE * f * f / ((f * f + 148693636.0::DOUBLE) * (f * f + 424.36::DOUBLE)) * a / 2e-5::DOUBLE, 2))), 6) + 0.0 AS l FROM (SELECT series_id, k, k * 500.0::DOUBLE AS f, a FROM spec)"),
}
