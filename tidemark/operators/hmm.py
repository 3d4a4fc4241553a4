"""Poisson hidden Markov models of count series (series_id, t, n): initial values, Baum-Welch, scores and decoding.

A model is fitted per series in its own group; a series is an ordered fold and stays together.
"""

from __future__ import annotations

import dataclasses
import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ITER, TOLERANCE = 1000, 1e-5


def check_counts(counts: DataFrame) -> DataFrame:
    """counts; negative or missing numbers raise an error."""
    return counts.withColumn("n", F.when(F.col("n") >= 0, F.col("n")).otherwise(F.raise_error(F.lit("counts must be non-negative integers")).cast("long")))


def is_stochastic(p: np.ndarray) -> bool:
    p = np.asarray(p, float)
    return p.ndim in (1, 2) and (p.ndim == 1 or p.shape[0] == p.shape[1]) and bool((p >= 0).all()) and bool(np.isclose(p.sum(-1), 1).all())


def lambda_linear(counts: DataFrame, m: int) -> DataFrame:
    ends = counts.groupBy("series_id").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    return ends.select("series_id", F.array(*[F.col("a") + (F.col("b") - F.col("a")) * (k / (m - 1) if m > 1 else 0.0) for k in range(m)]).alias("lam"))


def lambda_quantile(counts: DataFrame, m: int) -> DataFrame:
    """Quantiles by linear interpolation; counts are few distinct numbers, which is what the exact aggregate holds."""
    at = [0.5] if m == 1 else [0.25, 0.75] if m == 2 else np.linspace(1 / (m + 1), 1, m + 1)[:-1].tolist()
    return counts.groupBy("series_id").agg(F.percentile("n", F.array(*map(F.lit, at))).alias("lam"))


def lambda_hist(counts: DataFrame, m: int) -> DataFrame:
    """Centres of the m most frequent of ten bins, in order; of equal ones the higher bin."""
    ends = counts.groupBy("series_id").agg(F.min("n").cast("double").alias("a"), F.max("n").cast("double").alias("b"))
    ends = ends.select("series_id", F.when(F.col("b") > F.col("a"), F.col("a")).otherwise(F.col("a") - 0.5).alias("a"), F.when(F.col("b") > F.col("a"), F.col("b")).otherwise(F.col("b") + 0.5).alias("b"))
    bins = counts.join(ends, "series_id").select("series_id", "a", "b", F.least(F.floor((F.col("n") - F.col("a")) / (F.col("b") - F.col("a")) * 10), F.lit(9)).alias("k"))
    sums = bins.groupBy("series_id", "a", "b", "k").agg(F.count(F.lit(1)).alias("c"))
    zero = ends.select("series_id", "a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("k"), F.lit(0).cast("long").alias("c"))
    all_ = sums.unionByName(zero).groupBy("series_id", "a", "b", "k").agg(F.sum("c").alias("c"))
    top = all_.groupBy("series_id", "a", "b").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "k")), asc=False), 1, m).alias("top"))
    return top.select("series_id", F.sort_array(F.transform("top", lambda x: F.col("a") + (x.k + 0.5) * (F.col("b") - F.col("a")) / 10)).alias("lam"))


def lambda_random(counts: DataFrame, m: int, seed: int = 0) -> DataFrame:
    ends = counts.groupBy("series_id").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    return ends.select("series_id", F.array(*[F.floor(F.col("a") + F.rand(seed + k) * (F.col("b") - F.col("a"))).cast("double") for k in range(m)]).alias("lam"))


def gamma_uniform(spark: SparkSession, m: int, diag: float = 0.8) -> DataFrame:
    """i, j, p; a single state stays where it is."""
    off = (1 - diag) / (m - 1) if m > 1 else 0.0
    pairs = spark.range(m * m).select(F.floor(F.col("id") / m).cast("long").alias("i"), (F.col("id") % m).alias("j"))
    return pairs.withColumn("p", F.when(F.col("i") == F.col("j"), diag if m > 1 else 1.0).otherwise(off))


def gamma_softmax(m: int, seed: int = 0) -> np.ndarray:
    e = np.exp(np.random.default_rng(seed).random((m, m)))
    return e / e.sum(1, keepdims=True)


def gamma_dirichlet(alpha, seed: int = 0) -> np.ndarray:
    """Rows are drawn with the parameters rolled by one place each."""
    alpha = np.asarray(alpha, float)
    if (alpha <= 0).any():
        raise ValueError("parameters must be positive")
    rng = np.random.default_rng(seed)
    return np.stack([rng.dirichlet(np.roll(alpha, k)) for k in range(len(alpha))])


def delta_uniform(m: int) -> np.ndarray:
    return np.full(m, 1 / m)


def delta_softmax(m: int, seed: int = 0) -> np.ndarray:
    e = np.exp(np.random.default_rng(seed).random(m))
    return e / e.sum()


def delta_dirichlet(alpha, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).dirichlet(np.asarray(alpha, float))


def stationary_distr(gamma: np.ndarray) -> np.ndarray:
    m = len(gamma)
    return np.linalg.solve((np.eye(m) - gamma + np.ones((m, m))).T, np.ones(m))


def empirical_tpm(events: DataFrame, states: list[str]) -> DataFrame:
    """series_id, i, j, p from transitions (series_id, a, b), counted in every task first; rows without any are uniform."""
    number = {s: k for k, s in enumerate(states)}
    as_no = F.create_map(*[F.lit(x) for s, k in number.items() for x in (s, k)])
    seen = events.groupBy("series_id", as_no[F.col("a")].cast("long").alias("i"), as_no[F.col("b")].cast("long").alias("j")).agg(F.count(F.lit(1)).alias("c"))
    m = len(states)
    cells = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in range(m) for j in range(m)])
    grid = seen.select("series_id").distinct().select("series_id", F.explode(cells).alias("x")).select("series_id", "x.i", "x.j")
    full = grid.join(seen, ["series_id", "i", "j"], "left").na.fill(0, ["c"])
    sums = full.groupBy("series_id", "i").agg(F.sum("c").alias("s"))
    return full.join(sums, ["series_id", "i"]).select("series_id", "i", "j", F.when(F.col("s") > 0, F.col("c") / F.col("s")).otherwise(1.0 / m).alias("p"))


def off_diagonal(tpm: DataFrame) -> DataFrame:
    return tpm.where("i <> j")


def set_off_diagonal(tpm: DataFrame, values: DataFrame) -> DataFrame:
    """tpm with off-diagonal p from values (series_id, i, j, p)."""
    new = values.withColumnRenamed("p", "q")
    return tpm.join(new, ["series_id", "i", "j"], "left").withColumn("p", F.when(F.col("i") != F.col("j"), F.coalesce("q", "p")).otherwise(F.col("p"))).drop("q")


def logit_tpm(tpm: DataFrame) -> DataFrame:
    """Working parameters ln(p_ij / p_ii) of the off-diagonal; null where either is 0."""
    diag = tpm.where("i = j").select("series_id", "i", F.col("p").alias("d"))
    return tpm.join(diag, ["series_id", "i"]).where("i <> j").select("series_id", "i", "j", F.when((F.col("p") > 0) & (F.col("d") > 0), F.log(F.col("p") / F.col("d"))).alias("w"))


def expit_tpm(working: DataFrame, m: int) -> DataFrame:
    """The matrix of working parameters: exp, 1 on the diagonal, rows to sum 1. Null working parameters give 0."""
    e = working.select("series_id", "i", "j", F.coalesce(F.exp("w"), F.lit(0.0)).alias("e"))
    diag = working.select("series_id").distinct().select("series_id", F.explode(F.array(*[F.lit(k).cast("long") for k in range(m)])).alias("i"))
    full = e.unionByName(diag.select("series_id", "i", F.col("i").alias("j"), F.lit(1.0).alias("e")))
    sums = full.groupBy("series_id", "i").agg(F.sum("e").alias("s"))
    return full.join(sums, ["series_id", "i"]).select("series_id", "i", "j", (F.col("e") / F.col("s")).alias("p"))


def sort_param(key: Column, values: Column) -> Column:
    """values in the order of key (arrays of one length)."""
    return F.transform(F.sort_array(F.arrays_zip(key.alias("k"), values.alias("v"))), lambda x: x.v)


def log_poisson(x: np.ndarray, lam: np.ndarray) -> np.ndarray:
    fact = np.array([math.lgamma(v + 1) for v in x])
    return x[:, None] * np.log(np.maximum(lam, 1e-300)) - lam - fact[:, None]


def forward(x: np.ndarray, lam: np.ndarray, gamma: np.ndarray, delta: np.ndarray):
    """Scaled forward probabilities, scales with the emissions' shift, emissions."""
    lp = log_poisson(x, lam)
    shift = lp.max(1)
    e = np.exp(lp - shift[:, None])
    alpha, c = np.zeros_like(e), np.zeros(len(x))
    a = delta * e[0]
    for t in range(len(x)):
        a = a if t == 0 else (alpha[t - 1] @ gamma) * e[t]
        c[t] = a.sum()
        alpha[t] = a / c[t]
    return alpha, c, shift, e


def log_likelihood(x, lam, gamma, delta) -> float:
    _, c, shift, _ = forward(np.asarray(x), lam, gamma, delta)
    return float((np.log(c) + shift).sum())


def baum_welch(x: np.ndarray, lam: np.ndarray, gamma: np.ndarray, delta: np.ndarray, max_iter: int = MAX_ITER, tol: float = TOLERANCE) -> dict:
    x = np.asarray(x, np.int64)
    success, n_iter, history = False, 0, []
    for n_iter in range(1, max_iter + 1):
        alpha, c, shift, e = forward(x, lam, gamma, delta)
        history.append(-float((np.log(c) + shift).sum()))
        beta = np.ones_like(alpha)
        for t in range(len(x) - 2, -1, -1):
            beta[t] = gamma @ (e[t + 1] * beta[t + 1]) / c[t + 1]
        g = alpha * beta
        g /= g.sum(1, keepdims=True)
        xi = gamma * (alpha[:-1].T @ (e[1:] * beta[1:] / c[1:, None]))
        rows = xi.sum(1, keepdims=True)
        new_gamma = np.where(rows > 0, xi / np.maximum(rows, 1e-300), gamma)
        new_lam, new_delta = (g * x[:, None]).sum(0) / np.maximum(g.sum(0), 1e-300), g[0]
        change = max(np.abs(new_lam - lam).max(), np.abs(new_gamma - gamma).max(), np.abs(new_delta - delta).max())
        lam, gamma, delta = new_lam, new_gamma, new_delta
        if change < tol:
            success = True
            break
    m = len(lam)
    nll, k = -log_likelihood(x, lam, gamma, delta), m * m + m - 1
    return {"lam": lam, "gamma": gamma, "delta": delta, "nll": nll, "aic": 2 * nll + 2 * k, "bic": 2 * nll + k * math.log(len(x)), "n_iter": n_iter, "success": success, "history": history}


def viterbi(x, lam, gamma, delta) -> np.ndarray:
    lp, lg = log_poisson(np.asarray(x), lam), np.log(np.maximum(gamma, 1e-300))
    best, back = np.log(np.maximum(delta, 1e-300)) + lp[0], []
    for t in range(1, len(lp)):
        s = best[:, None] + lg
        back.append(s.argmax(0))
        best = s.max(0) + lp[t]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


MODEL = "lam array<double>, gamma array<array<double>>, delta array<double>, aic double, bic double, nll double, n_iter int, success boolean"

LAMBDAS = ("quantile", "linear", "hist", "random")
GAMMAS = ("uniform", "softmax", "dirichlet")
DELTAS = ("stationary", "uniform", "softmax", "dirichlet")


@dataclasses.dataclass(frozen=True)
class HmmParams:
    """Hyper-parameters: number of states, and initial values by the name of a method or as numbers.

    dirichlet needs the parameters gamma_dp or delta_dp, one positive number for each state; uniform gamma needs fill_diag."""

    m_states: int
    init_lambda: str | tuple = "quantile"
    init_gamma: str | tuple = "uniform"
    init_delta: str | tuple = "stationary"
    gamma_dp: tuple | None = None
    delta_dp: tuple | None = None
    fill_diag: float | None = 0.8
    seed: int = 0

    def __post_init__(self):
        m = self.m_states
        if isinstance(m, bool) or not isinstance(m, int) or m < 1:
            raise ValueError("the number of states must be a positive integer")
        for dp in (self.gamma_dp, self.delta_dp):
            if dp is not None and (len(dp) != m or min(dp) <= 0):
                raise ValueError("Dirichlet parameters: a positive number for each state")
        if self.fill_diag is not None and not 0 <= self.fill_diag <= 1:
            raise ValueError("fill_diag lies in [0, 1]")
        for name, methods, dp in (("init_lambda", LAMBDAS, ()), ("init_gamma", GAMMAS, self.gamma_dp), ("init_delta", DELTAS, self.delta_dp)):
            value = getattr(self, name)
            if isinstance(value, str):
                if value not in methods:
                    raise ValueError(f"unknown initial values {value!r}")
                if value == "dirichlet" and dp is None:
                    raise ValueError(f"{name} by Dirichlet distributions needs their parameters")
            elif isinstance(value, tuple | list | np.ndarray):
                given = np.asarray(value, float)
                if given.shape != ((m, m) if name == "init_gamma" else (m,)):
                    raise ValueError(f"{name} must have {m} states")
                if name == "init_lambda" and (given < 0).any():
                    raise ValueError("means can't be negative")
                if name != "init_lambda" and not is_stochastic(given):
                    raise ValueError(f"{name} must be stochastic")
            else:
                raise TypeError(f"{name} must be a name or numbers")
        if isinstance(self.init_gamma, str) and self.init_gamma == "uniform" and self.fill_diag is None:
            raise ValueError("uniform initial transitions need fill_diag")

    def to_dict(self) -> dict:
        plain = lambda v: np.asarray(v, float).tolist() if isinstance(v, tuple | list | np.ndarray) else v
        return {f.name: plain(getattr(self, f.name)) for f in dataclasses.fields(self)}

    def to_json(self) -> str:
        return json.dumps(self.to_dict())

    def gamma(self) -> np.ndarray:
        m = self.m_states
        if not isinstance(self.init_gamma, str):
            return np.asarray(self.init_gamma, float)
        if self.init_gamma == "softmax":
            return gamma_softmax(m, self.seed)
        if self.init_gamma == "dirichlet":
            return gamma_dirichlet(self.gamma_dp, self.seed)
        out = np.full((m, m), (1 - self.fill_diag) / max(1, m - 1))
        np.fill_diagonal(out, self.fill_diag if m > 1 else 1.0)
        return out

    def delta(self, gamma: np.ndarray) -> np.ndarray:
        if not isinstance(self.init_delta, str):
            return np.asarray(self.init_delta, float)
        make = {"stationary": lambda: stationary_distr(gamma), "uniform": lambda: delta_uniform(self.m_states), "softmax": lambda: delta_softmax(self.m_states, self.seed), "dirichlet": lambda: delta_dirichlet(self.delta_dp, self.seed)}
        return make[self.init_delta]()

    def lambdas(self, counts: DataFrame) -> DataFrame:
        """series_id, lam."""
        if not isinstance(self.init_lambda, str):
            return counts.groupBy("series_id").agg(F.first(F.array(*[F.lit(float(v)) for v in self.init_lambda])).alias("lam"))
        if self.init_lambda == "random":
            return lambda_random(counts, self.m_states, self.seed)
        return {"quantile": lambda_quantile, "linear": lambda_linear, "hist": lambda_hist}[self.init_lambda](counts, self.m_states)


def fit(counts: DataFrame, m: int | HmmParams, init: str = "quantile", diag: float = 0.8, max_iter: int = MAX_ITER) -> DataFrame:
    """One model per series. m: hyper-parameters, or the number of states with the method for means and the diagonal."""
    params = m if isinstance(m, HmmParams) else HmmParams(m, init_lambda=init, fill_diag=diag)
    counts, named = check_counts(counts), isinstance(params.init_lambda, str)
    kind = counts.schema["series_id"].dataType.simpleString()

    def run(key, left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame(columns=["series_id", "lam", "gamma", "delta", "aic", "bic", "nll", "n_iter", "success"])
        x = left.sort_values("t")["n"].to_numpy()
        lam = np.maximum(np.asarray(right["lam"].iloc[0], float), 1e-3)
        if named:
            lam = lam + np.arange(len(lam)) * 1e-3  # equal means would never part
        gamma = params.gamma()
        r = baum_welch(x, lam, gamma, params.delta(gamma), max_iter)
        return pd.DataFrame([(key[0], r["lam"], [g for g in r["gamma"]], r["delta"], r["aic"], r["bic"], r["nll"], r["n_iter"], r["success"])], columns=["series_id", "lam", "gamma", "delta", "aic", "bic", "nll", "n_iter", "success"])

    start = params.lambdas(counts).select(F.col("series_id").alias("series"), "lam")
    return counts.groupBy("series_id").cogroup(start.groupBy("series")).applyInPandas(run, f"series_id {kind}, {MODEL}")


def models_json(models: DataFrame, params: HmmParams | None = None) -> DataFrame:
    """series_id, model: fitted models as JSON objects with params, quality, success and, if given, hyper_params."""
    parts = [F.struct("lam", "gamma", "delta").alias("params"), F.struct("aic", "bic", "nll", "n_iter").alias("quality"), F.col("success")]
    text = F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
    if params is not None:
        text = F.concat(F.lit(f'{{"hyper_params":{params.to_json()},'), F.substr(text, F.lit(2)))
    return models.select("series_id", text.alias("model"))


def score(counts: DataFrame, models: DataFrame) -> DataFrame:
    """series_id, log_likelihood of counts under their series' model, and the decoded states."""
    kind = counts.schema["series_id"].dataType.simpleString()

    def run(key, left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame(columns=["series_id", "log_likelihood", "states"])
        x, r = left.sort_values("t")["n"].to_numpy(), right.iloc[0]
        p = (np.asarray(r["lam"], float), np.array([np.asarray(g, float) for g in r["gamma"]]), np.asarray(r["delta"], float))
        return pd.DataFrame([(key[0], log_likelihood(x, *p), viterbi(x, *p).tolist())], columns=["series_id", "log_likelihood", "states"])

    return counts.groupBy("series_id").cogroup(models.groupBy("series_id")).applyInPandas(run, f"series_id {kind}, log_likelihood double, states array<long>")


def stationary(tpm: DataFrame, m: int) -> DataFrame:
    """series_id, delta of matrices (series_id, i, j, p)."""
    rows = tpm.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("i", "j", "p"))).alias("r")).select("series_id", F.transform("r", lambda x: x.p).alias("p"))

    @F.pandas_udf("array<double>")
    def solve(p):
        import pandas as pd

        return pd.Series([stationary_distr(np.asarray(v, float).reshape(m, m)) for v in p])

    return rows.select("series_id", solve("p").alias("delta"))
