"""Queries of scalar functions, generators and reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import generators as G
from ..functions import scalars as S
from ..sources import audio
from .common import SIG, VEC, r6

EVENTS = "SELECT event_id, {} AS {} FROM events"


def _event(name: str, expr, sql: str):
    return lambda s, d: A.table(s, d, "events").select("event_id", expr(F.col("value")).alias(name)), EVENTS.format(sql, name)


def _r(sql: str) -> str:
    return f"round({sql}, 6) + 0.0"


def fti16(s, d):
    return A.table(s, d, "events").select("event_id", S.fti16(F.col("value") / 1000.0).cast("long").alias("v"))


def channels(s, d):
    """Event types as the channels of one signal per user."""
    e = A.table(s, d, "events").where("event_type IS NOT NULL")
    return e.select(F.col("user_id").alias("series_id"), F.col("event_type").alias("channel"), F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("frame"), "value")


def mono_mixdown(s, d):
    return audio.mono(channels(s, d)).select("series_id", "frame", r6("value").alias("value"))


def read_offset_padded(s, d):
    return audio.read_frames(A.sig_user(s, d), 40, 60).select("series_id", "frame", r6("value").alias("value"))


def read_negative_offset(s, d):
    return audio.read_frames(A.sig_user(s, d), 20, -5).select("series_id", "frame", r6("value").alias("value"))


def read_normalized(s, d):
    return audio.read_frames(A.sig_user(s, d), norm=True).select("series_id", "frame", r6("value").alias("value"))


def _grouped(f, *, whole: bool = False):
    def query(s, d):
        return f(A.sig_user(s, d), [] if whole else ["series_id"]).select("series_id", "frame", r6("value").alias("value"))

    return query


def _cols(f):
    return lambda s, d: f(A.sig_user(s, d), ["frame"]).select("series_id", "frame", r6("value").alias("value"))


def _win(sql: str, over: str = "PARTITION BY series_id") -> str:
    return f"WITH {SIG} SELECT series_id, frame, {_r(sql.replace('{w}', f'OVER ({over})'))} AS value FROM sig"


def within_any(s, d):
    bounds = s.createDataFrame([(10.0, 20.0), (50.0, 55.5), (90.0, 200.0)], "low double, high double")
    return S.within_any(A.table(s, d, "events").select("event_id", "value"), "value", bounds).select("event_id")


def sinusoid(s, d):
    return G.sinusoid(s, [440.0, 550.0, 660.0], [1.0, 0.5, 0.25], fps=9000, length=0.2).select("frame", r6("value").alias("value"))


def sinusoid_comps(s, d):
    return G.sinusoid(s, [440.0, 550.0], 1.0, fps=1000, comps=True).select("comp", "frame", r6("value").alias("value"))


def lorenz(s, d):
    return G.lorenz_attractor(s, 200).select("frame", r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"))


def earthquakes(s, d):
    return G.earthquakes(s).select("t", "n")


def repath(s, d):
    p = A.table(s, d, "pages").select("page_id", F.concat(F.lit("/in/a.b/"), F.col("page_id").cast("string"), F.lit(".wav")).alias("p"))
    return p.select("page_id", S.repath(F.col("p"), "/out", ".csv").alias("path"))


def ndarray_roundtrip(s, d):
    v = A.sig_vec(s, d)
    return v.select("series_id", F.posexplode(audio.decode_ndarray(audio.encode_ndarray(F.col("data")))).alias("j", "x")).select("series_id", F.col("j").cast("long").alias("j"), r6("x").alias("x"))


def rowdiag(s, d):
    m = A.obs(s, d).select(F.col("id").alias("i"), F.posexplode("x").alias("j", "v")).withColumn("j", F.col("j").cast("long"))
    return S.rowdiag(m, 3).select("i", "j", r6("v").alias("v"))


_WEIGHT = "148693636.0::DOUBLE * v * v / ((v * v + 148693636.0::DOUBLE) * (v * v + 424.36::DOUBLE))"

QUERIES = {
    "c_weighting": _event("w", lambda v: r6(S.c_weighting(v)), _r(_WEIGHT.replace("v", "value").replace("avalueg", "avg"))),
    "freq2mel": _event("mel", lambda v: r6(S.freq2mel(F.abs(v))), _r("1125 * ln(1 + abs(value) / 700)")),
    "mel2freq": _event("f", lambda v: r6(S.mel2freq(v)), _r("700 * (exp(value / 1125) - 1)")),
    "amp_from_spl": _event("a", lambda v: r6(S.amp(v / 10)), _r("pow(10::DOUBLE, 0.05::DOUBLE * (value / 10)) * 2e-5::DOUBLE")),
    "limit_db": _event("v", lambda v: r6(S.limit(v, 120.0, 130.0)), _r("least(CASE WHEN value < 20 THEN 0 ELSE value END, pow(10::DOUBLE, 6.5::DOUBLE) * 2e-5::DOUBLE)")),
    "fti16": (fti16, "SELECT event_id, greatest(least(floor(value / 1000 * 32768), 32767), -32768)::BIGINT AS v FROM events"),
    "frq2cbr": _event("z", lambda v: r6(S.frq2cbr(v * 10)), _r("13 * atan(0.00076::DOUBLE * value * 10) + 3.5::DOUBLE * atan(pow(value * 10 / 7500, 2))")),
    "level": _event("l", lambda v: r6(S.level(v)), _r("10 * log10(greatest(value, 1e-11::DOUBLE) / 1e-11::DOUBLE)")),
    "specific_loudness": _event("l", lambda v: r6(S.specific_loudness(v)), _r("pow(10 * log10(greatest(value, 1e-11::DOUBLE) / 1e-11::DOUBLE), 0.23::DOUBLE)")),
    "weight_factor": _event("w", lambda v: r6(S.weight_factor(v / 10)), _r("greatest(1.0::DOUBLE, 0.066::DOUBLE * exp(0.171::DOUBLE * (value / 10)))")),
    "mono_mixdown": (mono_mixdown, f"SELECT user_id AS series_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS frame, {_r('avg(value)')} AS value FROM events WHERE event_type IS NOT NULL GROUP BY ALL"),
    "read_offset_padded": (read_offset_padded, f"WITH {SIG} SELECT s.series_id, f.f AS frame, {_r('coalesce(sig.x, 0)')} AS value FROM (SELECT DISTINCT series_id FROM sig) s CROSS JOIN range(0, 40) AS f(f) LEFT JOIN sig ON sig.series_id = s.series_id AND sig.frame = f.f + 60"),
    "read_negative_offset": (read_negative_offset, f"WITH {SIG} SELECT s.series_id, f.f AS frame, {_r('coalesce(sig.x, 0)')} AS value FROM (SELECT DISTINCT series_id FROM sig) s CROSS JOIN range(0, 20) AS f(f) LEFT JOIN sig ON sig.series_id = s.series_id AND sig.frame = f.f - 5"),
    "read_normalized": (read_normalized, _win("x / max(abs(x)) {w}")),
    "normalize_maxabs": (_grouped(S.normalize_max), _win("x / max(abs(x)) {w}")),
    "minmax_rows": (_grouped(S.scale), _win("(x - min(x) {w}) / (max(x) {w} - min(x) {w})")),
    "minmax_array": (_grouped(S.scale, whole=True), _win("(x - min(x) {w}) / (max(x) {w} - min(x) {w})", "")),
    "minmax_cols": (_cols(S.scale), _win("coalesce((x - min(x) {w}) / nullif(max(x) {w} - min(x) {w}, 0), 0)", "PARTITION BY frame")),
    "scale": (_grouped(lambda df, by: S.scale(df, by, -1.0, 2.0)), _win("-1 + 3 * (x - min(x) {w}) / (max(x) {w} - min(x) {w})")),
    "standardize": (_grouped(S.standardize), _win("(x - avg(x) {w}) / stddev_pop(x) {w}")),
    "smooth_stat": (_grouped(S.smooth_stat), _win("CASE WHEN x BETWEEN avg(x) {w} - stddev_pop(x) {w} AND avg(x) {w} + stddev_pop(x) {w} THEN avg(x) {w} ELSE x END")),
    "within_any": (within_any, "SELECT event_id FROM events WHERE value BETWEEN 10 AND 20 OR value BETWEEN 50 AND 55.5 OR value BETWEEN 90 AND 200"),
    "sinusoid": (sinusoid, f"SELECT i AS frame, {_r('sin(2 * pi() * 440 * i / 9000) + 0.5::DOUBLE * sin(2 * pi() * 550 * i / 9000) + 0.25::DOUBLE * sin(2 * pi() * 660 * i / 9000)')} AS value FROM range(0, 1800) AS t(i)"),
    "sinusoid_comps": (sinusoid_comps, f"SELECT c::BIGINT AS comp, i AS frame, {_r('sin(2 * pi() * (440 + 110 * c) * i / 1000)')} AS value FROM range(0, 1000) AS t(i), range(0, 2) AS c(c)"),
    "lorenz": (
        lorenz,
        f"""WITH RECURSIVE l(frame, x, y, z) AS (SELECT 0::BIGINT, 0::DOUBLE, 1::DOUBLE, 1.05::DOUBLE UNION ALL
  SELECT frame + 1, x + 0.01::DOUBLE * (10 * (y - x)), y + 0.01::DOUBLE * (x * (28 - z) - y), z + 0.01::DOUBLE * (x * y - 8::DOUBLE / 3 * z) FROM l WHERE frame < 199)
SELECT frame, {_r("x")} AS x, {_r("y")} AS y, {_r("z")} AS z FROM l""",
    ),
    "earthquakes": (earthquakes, f"SELECT t.i - 1 AS t, a[t.i]::BIGINT AS n FROM (SELECT {list(G.EARTHQUAKES)} AS a), range(1, 108) AS t(i)"),
    "repath": (repath, "SELECT page_id, '/out/' || page_id::VARCHAR || '.csv' AS path FROM pages"),
    "ndarray_roundtrip": (ndarray_roundtrip, f"WITH {VEC} SELECT series_id, j, {_r('x')} AS x FROM vec"),
    "rowdiag": (rowdiag, f"WITH {VEC} SELECT series_id AS i, j, {_r('x')} AS v FROM vec WHERE j = series_id + 3"),
}
