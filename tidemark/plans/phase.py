"""Queries of autocorrelation, phase space and onsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import onsets as O
from ..operators import phase_space as P
from ..params import PeakPickingParams, SegmentationParams, StftParams
from .common import VEC, flux_cte, r6, seg_cte, spec_cte

PICK = PeakPickingParams(3, 3, 0.1, 0.5)
STFT = StftParams(16, "hamming", None, 16, 8, True, True)
SEG = SegmentationParams(32, 16)


def _lags(expr, name="r"):
    return lambda s, d: A.sig_vec(s, d).select("series_id", F.posexplode(expr(F.col("data"))).alias("lag", "v")).select("series_id", F.col("lag").cast("long").alias("lag"), r6("v").alias(name))


def correlogram(s, d):
    return P.correlogram(A.sig_vec(s, d), 8, 6).select("series_id", "lag", "offset", r6("value").alias("value"))


def correlogram_total(s, d):
    return P.correlogram(A.sig_vec(s, d), 8, 6, sum_all=True).select("series_id", r6("value").alias("value"))


def correlogram_delay(s, d):
    return P.correlogram(A.sig_vec(s, d), 8, 0, delays=[2, 5]).select("series_id", "lag", "offset", r6("value").alias("value"))


def embedding_dists(s, d):
    x = A.sig_vec(s, d).select("series_id", F.posexplode(P.embedding_dists(F.col("data"), 2, 3)).alias("p", "v"))
    return x.select("series_id", F.col("p").cast("long").alias("p"), r6("v").alias("d"))


def correlation_sum(s, d):
    return A.sig_vec(s, d).select("series_id", r6(P.correlation_sum(F.col("data"), 2, 3, 2.0)).alias("c"))


def embedding_entropy(s, d):
    return A.sig_vec(s, d).select("series_id", r6(P.embedding_entropy(F.col("data"), 2, 3, 5)).alias("h"))


def log_hist_edges(s, d):
    x = A.sig_vec(s, d).select("series_id", F.posexplode(P.log_histogram_bin_edges(P.embedding_dists(F.col("data"), 2, 3), 6)).alias("i", "v"))
    return x.select("series_id", F.col("i").cast("long").alias("i"), r6("v").alias("edge"))


def cdim(s, d):
    """One segment for 3000 events, in order, as whole numbers."""
    e = A.table(s, d, "events").select(F.floor(F.col("event_id") / 3000).cast("long").alias("series_id"), "event_id", F.floor(F.col("value")).alias("v"))
    x = e.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "v"))).alias("r")).select("series_id", F.lit(0).cast("long").alias("seg"), F.transform("r", lambda z: z.v.cast("double")).alias("data"))
    return P.cdim(x, 2, 3, 1000, 10).select("series_id", r6("cdim").alias("cdim"))


def peak_pick(s, d):
    odf = A.sig_user(s, d).select("series_id", F.col("frame").alias("seg"), "frame", F.col("frame").cast("double").alias("time"), "value")
    return O.pick(odf, PICK).where("is_peak").select("series_id", "frame")


def flux_odf(s, d):
    return O.flux_odf(A.sig_user(s, d), STFT).select("series_id", "seg", "frame", r6("time").alias("time"), r6("value").alias("value"))


def flux_onsets(s, d):
    return O.flux_onsets(A.sig_user(s, d), STFT, PeakPickingParams(1, 1, 0.1, 0.1)).select("series_id", "seg", "frame", r6("time").alias("time"))


def entropy_odf(s, d):
    return O.entropy_odf(A.sig_user(s, d), 16, SEG, 2, 2, 4).select("series_id", "seg", "frame", r6("time").alias("time"), r6("value").alias("value"))


def entropy_onsets(s, d):
    return O.entropy_onsets(A.sig_user(s, d), 16, SEG, PeakPickingParams(1, 1, 0.1, 0.01), m_dim=2, delay=2, n_bins=4).select("series_id", "seg", "frame")


def evaluate_onsets(s, d):
    """Onsets by flux held against onsets by entropy, over all frames."""
    signal = A.sig_user(s, d)
    t = O.entropy_onsets(signal, 16, SEG, PeakPickingParams(1, 1, 0.1, 0.01), m_dim=2, delay=2, n_bins=4)
    e = O.flux_onsets(signal, STFT, PeakPickingParams(1, 1, 0.1, 0.1))
    return O.evaluate_onsets(*(x.select(F.col("series_id").alias("name"), "time") for x in (t, e))).select("name", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f").alias("f"))


def _peaks_sql(source: str, keys: str, b: int, a: int, alpha: float, delta: float) -> str:
    """ok: rows of source (series_id, seg, v) that are peaks. The threshold is the recursion itself."""
    return f"""ix AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY seg) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM {source}),
near AS (SELECT x.series_id, x.i, max(y.v) AS top, sum(y.v * (1 + CASE WHEN y.i = 0 THEN greatest({b} - x.i, 0) ELSE 0 END + CASE WHEN y.i = y.n - 1 THEN greatest(x.i + {a} - (y.n - 1), 0) ELSE 0 END)) / {a + b + 1} AS mean
  FROM ix x JOIN ix y ON x.series_id = y.series_id AND y.i BETWEEN x.i - {b} AND x.i + {a} GROUP BY x.series_id, x.i),
g AS (SELECT series_id, i, v, 0::DOUBLE AS g FROM ix WHERE i = 0 UNION ALL SELECT ix.series_id, ix.i, ix.v, greatest(g.v, {alpha}::DOUBLE * g.g + {1 - alpha}::DOUBLE * g.v) FROM g JOIN ix ON ix.series_id = g.series_id AND ix.i = g.i + 1),
ok AS (SELECT ix.* FROM ix JOIN near USING (series_id, i) JOIN g USING (series_id, i) WHERE ix.v >= top AND ix.v >= mean + {delta}::DOUBLE AND ix.v >= g.g)"""


_EMB = f"{VEC}, e AS (SELECT a.series_id, a.j AS i, a.x AS x, b.x AS y, c.x AS z FROM vec a JOIN vec b ON b.series_id = a.series_id AND b.j = a.j + 2 JOIN vec c ON c.series_id = a.series_id AND c.j = a.j + 4), dd AS (SELECT p.series_id, p.i AS i, q.i AS j, row_number() OVER (PARTITION BY p.series_id ORDER BY p.i, q.i) - 1 AS p, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) AS d FROM e p JOIN e q ON p.series_id = q.series_id AND p.i < q.i)"
_CORR = f"""{VEC}, o AS (SELECT DISTINCT series_id, off, lag FROM vec CROSS JOIN range(0, {{count}}) AS off(off) CROSS JOIN (SELECT unnest({{lags}}) AS lag)),
cg AS (SELECT o.series_id, o.lag, o.off, coalesce(pow(greatest(CASE WHEN stddev_pop(a.x) > 1e-9 AND stddev_pop(b.x) > 1e-9 THEN corr(a.x, b.x) ELSE 0 END, 0), 4), 0) AS value
  FROM o JOIN vec a ON a.series_id = o.series_id AND a.j >= o.off AND a.j < o.off + 8 JOIN vec b ON b.series_id = o.series_id AND b.j = a.j + o.lag GROUP BY ALL)"""


def _entropy_sql(emb: str, dims: list[str], bins: int, keys: str) -> str:
    """h: keys, h from an embedding."""
    ends = ", ".join(f"min({c}) AS a{k}, max({c}) AS b{k}" for k, c in enumerate(dims))
    cells = ", ".join(f"least(floor(({c} - CASE WHEN b{k} > a{k} THEN a{k} ELSE a{k} - 0.5 END) / CASE WHEN b{k} > a{k} THEN b{k} - a{k} ELSE 1 END * {bins}), {bins - 1}) AS c{k}" for k, c in enumerate(dims))
    names = ", ".join(f"c{k}" for k in range(len(dims)))
    return f"""en AS (SELECT {keys}, {ends}, count(*) AS n FROM {emb} GROUP BY {keys}), ce AS (SELECT {keys}, n, {cells} FROM {emb} JOIN en USING ({keys})),
hc AS (SELECT {keys}, {names}, count(*) / max(n)::DOUBLE AS p FROM ce GROUP BY {keys}, {names}), h AS (SELECT {keys}, -sum(p * ln(p)) AS h FROM hc GROUP BY {keys})"""


_ODF = f"WITH RECURSIVE {seg_cte(16, 8, True, True)}, {spec_cte('seg', 'series_id, seg', 16, 16, 'hamming')}, {flux_cte()}, odf AS (SELECT series_id, seg, greatest(flux, avg(flux) OVER (PARTITION BY series_id)) AS v FROM flux)"
_EODF = f"WITH RECURSIVE {seg_cte(32, 16, True, True)}, e2 AS (SELECT a.series_id, a.seg, a.x AS x, b.x AS y FROM seg a JOIN seg b ON b.series_id = a.series_id AND b.seg = a.seg AND b.j = a.j + 2), {_entropy_sql('e2', ['x', 'y'], 4, 'series_id, seg')}, odf AS (SELECT series_id, seg, h AS v FROM h)"
#: Onsets by flux and by entropy. Frames are a sixteenth of a second apart, so within the tolerance of evaluate_onsets only equal ones match.
_ONSETS = f"{_ODF}, {_peaks_sql('odf', 'series_id', 1, 1, 0.1, 0.1)} SELECT series_id, seg * 8 AS frame FROM ok"
_EONSETS = f"{_EODF}, {_peaks_sql('odf', 'series_id', 1, 1, 0.1, 0.01)} SELECT series_id, seg * 16 AS frame FROM ok"
_E3 = f"WITH {VEC}, e AS (SELECT a.series_id, a.x AS x, b.x AS y, c.x AS z FROM vec a JOIN vec b ON b.series_id = a.series_id AND b.j = a.j + 2 JOIN vec c ON c.series_id = a.series_id AND c.j = a.j + 4)"

QUERIES = {
    "acf": (_lags(P.acf), f"WITH {VEC} SELECT a.series_id, b.j - a.j AS lag, round(sum(a.x * b.x) / max(t.s), 6) + 0.0 AS r FROM vec a JOIN vec b ON a.series_id = b.series_id AND b.j >= a.j JOIN (SELECT series_id, sum(x * x) AS s FROM vec GROUP BY series_id) t ON t.series_id = a.series_id GROUP BY a.series_id, b.j - a.j"),
    "acf_pearson": (_lags(P.acf_pearson), f"WITH {VEC} SELECT a.series_id, b.j - a.j AS lag, round(coalesce(corr(a.x, b.x), 0), 6) + 0.0 AS r FROM vec a JOIN vec b ON a.series_id = b.series_id AND b.j >= a.j AND b.j - a.j < 63 GROUP BY a.series_id, b.j - a.j"),
    "correlogram": (correlogram, f"WITH {_CORR.format(count=50, lags=[1, 2, 3, 4, 5])} SELECT series_id, lag::BIGINT AS lag, off AS \"offset\", round(value, 6) + 0.0 AS value FROM cg UNION ALL SELECT DISTINCT series_id, 6::BIGINT, off, 0.0::DOUBLE FROM o"),
    "correlogram_total": (correlogram_total, f"WITH {_CORR.format(count=50, lags=[1, 2, 3, 4, 5])} SELECT series_id, round(sum(value) / 300, 6) + 0.0 AS value FROM cg GROUP BY series_id"),
    "correlogram_delay": (correlogram_delay, f"WITH {_CORR.format(count=51, lags=[2, 5])} SELECT series_id, lag::BIGINT AS lag, off AS \"offset\", round(value, 6) + 0.0 AS value FROM cg"),
    "embedding_dists": (embedding_dists, f"WITH {_EMB} SELECT series_id, p, round(d, 6) + 0.0 AS d FROM dd"),
    "correlation_sum": (correlation_sum, f"WITH {_EMB} SELECT series_id, round(count(*) FILTER (d < 2.0) / count(*)::DOUBLE, 6) + 0.0 AS c FROM dd GROUP BY series_id"),
    "embedding_entropy": (embedding_entropy, f"{_E3}, {_entropy_sql('e', ['x', 'y', 'z'], 5, 'series_id')} SELECT series_id, round(h, 6) + 0.0 AS h FROM h"),
    "log_hist_edges": (log_hist_edges, f"WITH {_EMB}, mm AS (SELECT series_id, min(d) AS a, max(d) AS b FROM dd GROUP BY series_id) SELECT series_id, i, round(exp(ln(a) + i * (ln(b) - ln(a)) / 6), 6) + 0.0 AS edge FROM mm CROSS JOIN range(0, 7) AS i(i)"),
    "cdim": (cdim, None),
    "peak_pick": (peak_pick, f"WITH RECURSIVE src AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seg, value AS v FROM events), {_peaks_sql('src', 'series_id', 3, 3, 0.1, 0.5)} SELECT series_id, seg AS frame FROM ok"),
    "flux_odf": (flux_odf, f"{_ODF} SELECT series_id, seg, seg * 8 AS frame, round(seg * 8 / 16.0::DOUBLE, 6) + 0.0 AS time, round(v, 6) + 0.0 AS value FROM odf"),
    "flux_onsets": (flux_onsets, f"{_ODF}, {_peaks_sql('odf', 'series_id', 1, 1, 0.1, 0.1)} SELECT series_id, seg, seg * 8 AS frame, round(seg * 8 / 16.0::DOUBLE, 6) + 0.0 AS time FROM ok"),
    "entropy_odf": (entropy_odf, f"{_EODF} SELECT series_id, seg, seg * 16 AS frame, round(seg * 16 / 16.0::DOUBLE, 6) + 0.0 AS time, round(v, 6) + 0.0 AS value FROM odf"),
    "entropy_onsets": (entropy_onsets, f"{_EODF}, {_peaks_sql('odf', 'series_id', 1, 1, 0.1, 0.01)} SELECT series_id, seg, seg * 16 AS frame FROM ok"),
    "evaluate_onsets": (
        evaluate_onsets,
        f"""WITH e AS ({_ONSETS}), t AS ({_EONSETS}), names AS (SELECT series_id FROM e UNION SELECT series_id FROM t),
n AS (SELECT names.series_id, (SELECT count(*) FROM e WHERE e.series_id = names.series_id) AS ne, (SELECT count(*) FROM t WHERE t.series_id = names.series_id) AS nt,
  (SELECT count(*) FROM e JOIN t ON e.frame = t.frame AND e.series_id = t.series_id WHERE e.series_id = names.series_id) AS hits FROM names),
pr AS (SELECT series_id, CASE WHEN ne > 0 THEN hits / ne::DOUBLE ELSE 0 END AS p, CASE WHEN nt > 0 THEN hits / nt::DOUBLE ELSE 0 END AS r FROM n)
SELECT series_id AS name, round(p, 6) + 0.0 AS precision, round(r, 6) + 0.0 AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) + 0.0 AS f FROM pr""",
    ),
}
