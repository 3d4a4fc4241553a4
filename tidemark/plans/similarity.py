"""Queries of maps, distances and hidden Markov models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.arrays import METRICS, hellinger_rows
from ..operators import hmm as H
from ..operators import som as M
from .common import VEC, r6


def units(s, d):
    """A 5 x 5 map: the first 25 vectors."""
    return A.obs(s, d).where("id < 25").select(F.col("id").alias("unit"), F.col("x").alias("w"))


def matched(s, d, metric="euclidean"):
    return M.best_match(A.obs(s, d), units(s, d), metric)


def bmu_flat(s, d):
    return matched(s, d).select("id", "unit", r6("error").alias("error"))


def bmu_cityblock(s, d):
    return matched(s, d, "cityblock").select("id", "unit", r6("error").alias("error"))


def bmu_cosine(s, d):
    return matched(s, d, "cosine").select("id", r6("error").alias("error"))


def bmu_grid(s, d):
    return M.match_grid(matched(s, d), 5).select("id", "row", "col")


def som_transform(s, d):
    return M.transform(A.obs(s, d), units(s, d)).select("id", F.posexplode("w").alias("f", "w")).select("id", F.col("f").cast("long").alias("f"), r6("w").alias("w"))


def calibrate(s, d):
    return M.calibrate(A.obs(s, d), units(s, d))


def distribute(s, d):
    return M.distribute(matched(s, d), units(s, d))


def hit_counts(s, d):
    return M.hit_counts(matched(s, d), units(s, d))


def quantization_error(s, d):
    return M.quantization_error(matched(s, d)).select(r6("quantization_error").alias("qe"))


def topographic_error(s, d):
    return M.topographic_error(matched(s, d), 5).select(r6("topographic_error").alias("te"))


def umatrix(s, d):
    return M.umatrix(units(s, d), 5, 5).select("unit", r6("value").alias("value"))


def batch_som_epoch(s, d):
    x = M.batch_epoch(A.obs(s, d), units(s, d), 5, 5, 1.5)
    return x.select("unit", F.posexplode("w").alias("f", "w")).select("unit", F.col("f").cast("long").alias("f"), r6("w").alias("w"))


def _nbh(make):
    def query(s, d):
        p = M.grid_pairs(s, 6, 4)
        dr, dc = F.abs(F.col("rowa") - F.col("rowb")).cast("double"), F.abs(F.col("cola") - F.col("colb")).cast("double")
        return p.select(F.col("unita").alias("a"), F.col("unitb").alias("b"), r6(make(dr, dc)).alias("h"))

    return query


_PAIRS = "(SELECT a, b, abs(a // 4 - b // 4)::DOUBLE AS dr, abs(a % 4 - b % 4)::DOUBLE AS dc FROM range(0, 24) AS a(a), range(0, 24) AS b(b))"


def _nbh_sql(sql: str) -> str:
    return f"SELECT a, b, round({sql}, 6) + 0.0 AS h FROM {_PAIRS}"


def moore(s, d):
    return M.neighbours(s, 6, 4, 1)


def von_neumann(s, d):
    return M.von_neumann(s, 6, 4)


def _schedule(values):
    return lambda s, d: s.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "k long, v double").select("k", r6("v").alias("v"))


def hellinger(s, d):
    p = A.prob(s, d)
    ref = F.array(*[F.lit(0.2)] * 5)
    return p.select("series_id", r6(METRICS["hellinger"](F.col("p"), ref)).alias("h"))


KINDS_SQL = "(SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events))"


def transitions(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = A.table(s, d, "events").select(F.col("user_id").alias("series_id"), F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b"))
    return e.where("b IS NOT NULL")


def states(s, d):
    return sorted(r[0] for r in A.table(s, d, "events").select("event_type").distinct().collect())


def tpm(s, d):
    return H.empirical_tpm(transitions(s, d), states(s, d))


def empirical_tpm(s, d):
    return tpm(s, d).select("series_id", "i", "j", r6("p").alias("p"))


def logit_tpm(s, d):
    return H.logit_tpm(tpm(s, d)).where("w IS NOT NULL").select("series_id", "i", "j", r6("w").alias("w"))


def expit_roundtrip(s, d):
    t = tpm(s, d)
    whole = t.where("i = j").groupBy("series_id").agg(F.min("p").alias("least")).where("least > 0").select("series_id")
    return H.expit_tpm(H.logit_tpm(t.join(whole, "series_id", "left_semi")), 5).select("series_id", "i", "j", r6("p").alias("p"))


def off_diagonal(s, d):
    return H.off_diagonal(tpm(s, d)).select("series_id", "i", "j", r6("p").alias("p"))


def hellinger_stm(s, d):
    t = tpm(s, d).groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("i", "j", "p"))).alias("r")).select("series_id", F.transform("r", lambda x: x.p).alias("p"))
    ref = F.array(*[F.lit(0.2)] * 25)
    return t.select("series_id", F.posexplode(hellinger_rows(F.col("p"), ref, 5)).alias("i", "h")).select("series_id", F.col("i").cast("long").alias("i"), r6("h").alias("h"))


def stationary(s, d):
    return H.stationary(tpm(s, d), 5).select("series_id", F.posexplode("delta").alias("i", "p")).select("series_id", "i", r6("p").alias("p"))


def _lam(make):
    return lambda s, d: make(A.counts_daily(s, d)).select("series_id", F.posexplode("lam").alias("k", "v")).select("series_id", F.col("k").cast("long").alias("k"), r6("v").alias("lam"))


_COUNTS = "ct AS (SELECT o_orderpriority AS series_id, o_orderdate::DATE AS t, count(*) AS n FROM orders GROUP BY ALL)"


def gamma_uniform(s, d):
    return H.gamma_uniform(s, 4).select("i", "j", r6("p").alias("p"))


def sort_param(s, d):
    o = A.obs(s, d)
    return o.select("id", F.posexplode(H.sort_param(F.slice("x", 1, 32), F.slice("x", 33, 32))).alias("k", "v")).select("id", F.col("k").cast("long").alias("k"), r6("v").alias("v"))


def hmm_fit(s, d):
    m = H.fit(A.counts_daily(s, d), 3, max_iter=100)
    return m.select("series_id", *[r6(F.col("lam")[k]).alias(f"lam{k}") for k in range(3)], r6("nll").alias("nll"), r6("aic").alias("aic"), r6("bic").alias("bic"), "n_iter", "success")


def hmm_score(s, d):
    c = A.counts_daily(s, d)
    return H.score(c, H.fit(c, 2, max_iter=50)).select("series_id", r6("log_likelihood").alias("log_likelihood"), F.size("states").alias("n"))


def pca(s, d):
    _, comps, mean = M.pca(A.obs(s, d), 2)
    return M.pca_project(A.obs(s, d), comps, mean).select("id", r6(F.abs(F.col("scores")[0])).alias("a"), r6(F.abs(F.col("scores")[1])).alias("b"))


def incremental_som(s, d):
    w = M.fit_incremental(A.obs(s, d), 4, 4, 5, 0.5, 2.0)
    return w.select("unit", F.posexplode("w").alias("f", "w")).select("unit", "f", r6("w").alias("w"))


def batch_som(s, d):
    w, _ = M.fit_batch(A.obs(s, d), 4, 4, 4, 2.0)
    return w.select("unit", F.posexplode("w").alias("f", "w")).select("unit", "f", r6("w").alias("w"))


_NN = f"""{VEC}, dist AS (SELECT a.series_id AS id, b.series_id AS unit, {{}} AS d FROM vec a JOIN vec b ON a.j = b.j AND b.series_id < 25 GROUP BY a.series_id, b.series_id),
rk AS (SELECT id, unit, d, row_number() OVER (PARTITION BY id ORDER BY d, unit) AS r FROM dist), best AS (SELECT id, unit, d FROM rk WHERE r = 1)"""
_EUC = "WITH " + _NN.format("sqrt(sum(pow(a.x - b.x, 2)))")
_TPM = f"""tr AS (SELECT user_id AS series_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
kinds AS {KINDS_SQL}, cnt AS (SELECT series_id, x.k AS i, y.k AS j, count(*) AS c FROM tr JOIN kinds x ON x.event_type = a JOIN kinds y ON y.event_type = b GROUP BY ALL),
gr AS (SELECT series_id, i, j FROM (SELECT DISTINCT series_id FROM cnt), range(0, 5) AS i(i), range(0, 5) AS j(j)),
fl AS (SELECT gr.*, coalesce(c, 0) AS c, sum(coalesce(c, 0)) OVER (PARTITION BY series_id, i) AS s FROM gr LEFT JOIN cnt USING (series_id, i, j)),
tpm AS (SELECT series_id, i, j, CASE WHEN s > 0 THEN c / s::DOUBLE ELSE 0.2 END AS p FROM fl)"""

QUERIES = {
    "bmu_flat": (bmu_flat, f"{_EUC} SELECT id, unit, round(d, 6) + 0.0 AS error FROM best"),
    "bmu_cityblock": (bmu_cityblock, "WITH " + _NN.format("sum(abs(a.x - b.x))") + " SELECT id, unit, round(d, 6) + 0.0 AS error FROM best"),
    "bmu_cosine": (bmu_cosine, "WITH " + _NN.format("1 - sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x))") + " SELECT id, round(d, 6) + 0.0 AS error FROM best"),
    "bmu_grid": (bmu_grid, f"{_EUC} SELECT id, unit // 5 AS \"row\", unit % 5 AS col FROM best"),
    "som_transform": (som_transform, f"{_EUC} SELECT best.id, vec.j AS f, round(vec.x, 6) + 0.0 AS w FROM best JOIN vec ON vec.series_id = best.unit"),
    "calibrate": (calibrate, f"{_EUC} SELECT unit, label::BIGINT AS label FROM (SELECT unit, id, row_number() OVER (PARTITION BY unit ORDER BY d, id) AS r FROM dist) JOIN embeddings ON vec_id = id WHERE r = 1"),
    "distribute": (distribute, f"{_EUC} SELECT u.u AS unit, best.id FROM range(0, 25) AS u(u) LEFT JOIN best ON best.unit = u.u"),
    "hit_counts": (hit_counts, f"{_EUC} SELECT u.u AS unit, count(best.id) AS hits FROM range(0, 25) AS u(u) LEFT JOIN best ON best.unit = u.u GROUP BY u.u"),
    "quantization_error": (quantization_error, f"{_EUC} SELECT round(avg(d), 6) + 0.0 AS qe FROM best"),
    "topographic_error": (topographic_error, f"{_EUC} SELECT round(avg(CASE WHEN greatest(abs(a.unit // 5 - b.unit // 5), abs(a.unit % 5 - b.unit % 5)) > 1 THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS te FROM rk a JOIN rk b ON a.id = b.id AND a.r = 1 AND b.r = 2"),
    "umatrix": (
        umatrix,
        f"""{_EUC}, nb AS (SELECT a, b FROM range(0, 25) AS a(a), range(0, 25) AS b(b) WHERE abs(a // 5 - b // 5) <= 1 AND abs(a % 5 - b % 5) <= 1),
u AS (SELECT a AS unit, sum(d) / count(*) AS v FROM nb JOIN dist ON dist.id = a AND dist.unit = b GROUP BY a) SELECT unit, round(v / max(v) OVER (), 6) + 0.0 AS value FROM u""",
    ),
    "batch_som_epoch": (
        batch_som_epoch,
        f"""{_EUC}, s AS (SELECT unit, j, sum(x) AS s, count(*) AS c FROM best JOIN vec ON vec.series_id = best.id GROUP BY unit, j)
SELECT t.t AS unit, j AS f, round(sum(h * s) / sum(h * c), 6) + 0.0 AS w FROM (SELECT t, s.*, exp(-(pow(t // 5 - unit // 5, 2) + pow(t % 5 - unit % 5, 2)) / (2 * 1.5::DOUBLE * 1.5::DOUBLE)) AS h FROM range(0, 25) AS t(t), s) t GROUP BY t.t, j""",
    ),
    "nbh_gaussian": (_nbh(lambda a, b: M.gaussian(a * a + b * b, 1.5)), _nbh_sql("exp(-(dr * dr + dc * dc) / 4.5::DOUBLE)")),
    "nbh_mexican": (_nbh(lambda a, b: M.mexican(a * a + b * b, 1.5)), _nbh_sql("(1 - (dr * dr + dc * dc) / 2.25::DOUBLE) * exp(-(dr * dr + dc * dc) / 4.5::DOUBLE)")),
    "nbh_star": (_nbh(lambda a, b: M.star(a + b, 2.0)), _nbh_sql("CASE WHEN dr + dc <= 2 THEN 1.0::DOUBLE ELSE 0 END")),
    "nbh_rect": (_nbh(lambda a, b: M.rect(F.greatest(a, b), 2.0)), _nbh_sql("CASE WHEN greatest(dr, dc) <= 2 THEN 1.0::DOUBLE ELSE 0 END")),
    "nbh_gauss_kern": (_nbh(lambda a, b: M.gauss_kern(F.sqrt(a * a + b * b), 1.5)), _nbh_sql("exp(-sqrt(dr * dr + dc * dc) / 1.5::DOUBLE)")),
    "moore": (moore, f"SELECT a AS unit, b AS nbr FROM {_PAIRS} WHERE dr <= 1 AND dc <= 1"),
    "von_neumann": (von_neumann, f"SELECT a AS unit, b AS nbr FROM {_PAIRS} WHERE dr + dc = 1"),
    "decrease_linear": (_schedule(M.decrease_linear(4.0, 9)), "SELECT k, round(4 - 3 * k / 8.0::DOUBLE, 6) + 0.0 AS v FROM range(0, 9) AS k(k)"),
    "decrease_expo": (_schedule(M.decrease_expo(4.0, 9)), "SELECT k, round(4 * pow(0.25::DOUBLE, k / 8.0::DOUBLE), 6) + 0.0 AS v FROM range(0, 9) AS k(k)"),
    "hellinger": (
        hellinger,
        f"""WITH kinds AS {KINDS_SQL}, c AS (SELECT u.user_id, kinds.k, count(e.event_id) AS c FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN kinds LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = kinds.event_type GROUP BY ALL),
p AS (SELECT user_id, c / sum(c) OVER (PARTITION BY user_id)::DOUBLE AS p FROM c) SELECT user_id AS series_id, round(sqrt(sum(pow(sqrt(p) - sqrt(0.2::DOUBLE), 2)) / 2), 6) + 0.0 AS h FROM p GROUP BY user_id""",
    ),
    "hellinger_stm": (hellinger_stm, f"WITH {_TPM} SELECT series_id, i, round(sqrt(sum(pow(sqrt(p) - sqrt(0.2::DOUBLE), 2)) / 2), 6) + 0.0 AS h FROM tpm GROUP BY series_id, i"),
    "empirical_tpm": (empirical_tpm, f"WITH {_TPM} SELECT series_id, i, j, round(p, 6) + 0.0 AS p FROM tpm"),
    "off_diagonal": (off_diagonal, f"WITH {_TPM} SELECT series_id, i, j, round(p, 6) + 0.0 AS p FROM tpm WHERE i <> j"),
    "logit_tpm": (logit_tpm, f"WITH {_TPM} SELECT a.series_id, a.i, a.j, round(ln(a.p / b.p), 6) + 0.0 AS w FROM tpm a JOIN tpm b ON a.series_id = b.series_id AND a.i = b.i AND b.j = b.i WHERE a.i <> a.j AND a.p > 0 AND b.p > 0"),
    "expit_roundtrip": (expit_roundtrip, f"WITH {_TPM} SELECT series_id, i, j, round(p, 6) + 0.0 AS p FROM tpm WHERE series_id IN (SELECT series_id FROM tpm WHERE i = j GROUP BY series_id HAVING min(p) > 0)"),
    "gamma_uniform": (gamma_uniform, "SELECT i, j, round(CASE WHEN i = j THEN 0.8::DOUBLE ELSE 0.2::DOUBLE / 3 END, 6) + 0.0 AS p FROM range(0, 4) AS i(i), range(0, 4) AS j(j)"),
    "lambda_linear": (_lam(lambda c: H.lambda_linear(c, 4)), f"WITH {_COUNTS}, e AS (SELECT series_id, min(n) AS a, max(n) AS b FROM ct GROUP BY series_id) SELECT series_id, k, round(a + (b - a) * k / 3.0::DOUBLE, 6) + 0.0 AS lam FROM e CROSS JOIN range(0, 4) AS k(k)"),
    "lambda_quantile": (_lam(lambda c: H.lambda_quantile(c, 4)), f"WITH {_COUNTS} SELECT series_id, k, round(quantile_cont(n::DOUBLE, 0.2) FILTER (k = 0), 6) + 0.0 AS lam FROM ct, range(0, 1) AS k(k) GROUP BY series_id, k UNION ALL SELECT series_id, 1, round(quantile_cont(n::DOUBLE, 0.4), 6) + 0.0 FROM ct GROUP BY series_id UNION ALL SELECT series_id, 2, round(quantile_cont(n::DOUBLE, 0.6), 6) + 0.0 FROM ct GROUP BY series_id UNION ALL SELECT series_id, 3, round(quantile_cont(n::DOUBLE, 0.8), 6) + 0.0 FROM ct GROUP BY series_id"),
    "lambda_hist": (
        _lam(lambda c: H.lambda_hist(c, 3)),
        f"""WITH {_COUNTS}, e AS (SELECT series_id, CASE WHEN max(n) > min(n) THEN min(n)::DOUBLE ELSE min(n) - 0.5 END AS a, CASE WHEN max(n) > min(n) THEN max(n)::DOUBLE ELSE max(n) + 0.5 END AS b FROM ct GROUP BY series_id),
bn AS (SELECT series_id, least(floor((n - a) / (b - a) * 10), 9) AS k, count(*) AS c FROM ct JOIN e USING (series_id) GROUP BY ALL),
al AS (SELECT e.series_id, a, b, k.k, coalesce(c, 0) AS c FROM e CROSS JOIN range(0, 10) AS k(k) LEFT JOIN bn ON bn.series_id = e.series_id AND bn.k = k.k),
tp AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY c DESC, k DESC) AS r FROM al)
SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY k) - 1 AS k, round(a + (k + 0.5) * (b - a) / 10, 6) + 0.0 AS lam FROM tp WHERE r <= 3""",
    ),
    "sort_param": (sort_param, f"WITH {VEC} SELECT a.series_id AS id, row_number() OVER (PARTITION BY a.series_id ORDER BY a.x, b.x) - 1 AS k, round(b.x, 6) + 0.0 AS v FROM vec a JOIN vec b ON a.series_id = b.series_id AND b.j = a.j + 32 WHERE a.j < 32"),
    "stationary": (
        stationary,  # the matrix averaged with the identity has the same distribution and settles; it is squared thirty times
        f"""WITH RECURSIVE {_TPM}, sq(series_id, k, m) AS (SELECT series_id, 0, list((p + CASE WHEN i = j THEN 1 ELSE 0 END) / 2 ORDER BY i, j) FROM tpm GROUP BY series_id
  UNION ALL SELECT series_id, k + 1, list_transform(range(0, 25), lambda c: list_sum(list_transform(range(0, 5), lambda l: m[c // 5 * 5 + l + 1] * m[l * 5 + c % 5 + 1]))) FROM sq WHERE k < 30)
SELECT series_id, i.i::INTEGER AS i, round(m[i.i + 1], 6) + 0.0 AS p FROM sq, range(0, 5) AS i(i) WHERE k = 30""",
    ),
    "hmm_fit": (hmm_fit, None),
    "hmm_score": (hmm_score, None),
    "pca": (pca, None),
    "incremental_som": (incremental_som, None),
    "batch_som": (batch_som, None),
}
