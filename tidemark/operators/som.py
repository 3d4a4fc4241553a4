"""Self-organising maps: units are a small table (unit, w); observations (id, x) are as many as they like.

A map has a few thousand units at most, fixed by its shape, so units are sent to the tasks as a literal array and each
observation finds its best unit in its row: no join and no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import distance_of, schema_with, total
from ..functions.arrays import metric as metric_of

#: Largest map whose units are sent to the tasks.
MAX_UNITS = 10_000


def grid(spark: SparkSession, dx: int, dy: int) -> DataFrame:
    """unit, row, col in row-major order."""
    return spark.range(dx * dy).select(F.col("id").alias("unit"), F.floor(F.col("id") / dy).cast("long").alias("row"), (F.col("id") % dy).alias("col"))


def grid_pairs(spark: SparkSession, dx: int, dy: int) -> DataFrame:
    """All pairs of units with their places; the grid's size is fixed by the map's shape."""
    g = grid(spark, dx, dy)
    a, b = (g.select(*[F.col(c).alias(f"{c}{k}") for c in g.columns]) for k in "ab")
    return a.crossJoin(F.broadcast(b))


def neighbours(spark: SparkSession, dx: int, dy: int, radius: int = 1) -> DataFrame:
    """(unit, nbr) in the Chebyshev ball, the unit itself included."""
    near = (F.abs(F.col("rowa") - F.col("rowb")) <= radius) & (F.abs(F.col("cola") - F.col("colb")) <= radius)
    return grid_pairs(spark, dx, dy).where(near).select(F.col("unita").alias("unit"), F.col("unitb").alias("nbr"))


def von_neumann(spark: SparkSession, dx: int, dy: int) -> DataFrame:
    near = F.abs(F.col("rowa") - F.col("rowb")) + F.abs(F.col("cola") - F.col("colb")) == 1
    return grid_pairs(spark, dx, dy).where(near).select(F.col("unita").alias("unit"), F.col("unitb").alias("nbr"))


def is_neighbour(ax: Column, ay: Column, bx: Column, by: Column, metric: str = "chebyshev") -> Column:
    a, b = F.array(ax.cast("double"), ay.cast("double")), F.array(bx.cast("double"), by.cast("double"))
    return metric_of(metric)(a, b) <= 1


def gaussian(d2: Column, radius: float) -> Column:
    return F.exp(-d2 / (2 * radius * radius))


def mexican(d2: Column, radius: float) -> Column:
    return (1.0 - d2 / (radius * radius)) * gaussian(d2, radius)


def star(d1: Column, radius: float) -> Column:
    return (d1 <= radius).cast("double")


def rect(dmax: Column, radius: float) -> Column:
    return (dmax <= radius).cast("double")


def gauss_kern(d: Column, radius: float) -> Column:
    return F.exp(-d / radius)


def decrease_linear(start: float, steps: int, stop: float = 1.0) -> list[float]:
    if steps < 1:
        raise ValueError("at least one step")
    return [start] if steps == 1 else [start + (stop - start) * k / (steps - 1) for k in range(steps)]


def decrease_expo(start: float, steps: int, stop: float = 1.0) -> list[float]:
    if steps < 1:
        raise ValueError("at least one step")
    return [start] if steps == 1 else [start * (stop / start) ** (k / (steps - 1)) for k in range(steps)]


def _units(units: DataFrame) -> Column:
    rows = units.orderBy("unit").limit(MAX_UNITS + 1).collect()
    if len(rows) > MAX_UNITS:
        raise ValueError(f"a map has {MAX_UNITS} units at most")
    return F.array(*[F.struct(F.lit(int(r.unit)).cast("long").alias("unit"), F.array(*[F.lit(float(v)) for v in r.w]).alias("w")) for r in rows])


def weights(units: DataFrame) -> np.ndarray:
    return np.array([r.w for r in units.orderBy("unit").collect()], float)


def best_match(obs: DataFrame, units: DataFrame, metric="euclidean") -> DataFrame:
    """obs with unit (least number on ties), error and second, the next best unit."""
    w = weights(units)
    if isinstance(metric, str) and metric in ("euclidean", "sqeuclidean", "cityblock", "chebyshev"):
        return _best_arrow(obs, w, metric)
    m = metric_of(metric)
    ranked = F.sort_array(F.transform(_units(units), lambda u: F.struct(m(F.col("x"), u.w).alias("d"), u.unit.alias("unit"))))
    out = obs.withColumn("_r", F.slice(ranked, 1, 2))
    return out.withColumns({"unit": F.get("_r", F.lit(0)).unit, "error": F.get("_r", F.lit(0)).d, "second": F.get("_r", F.lit(1)).unit}).drop("_r")


def _best_arrow(obs: DataFrame, w: np.ndarray, metric: str) -> DataFrame:
    own = obs.columns
    at = own.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                x = np.array(part.column(at).to_pylist(), float).reshape(part.num_rows, -1)
                d = np.empty((len(x), len(w)))
                for u, v in enumerate(w):
                    e = np.abs(x - v)
                    d[:, u] = e.sum(1) if metric == "cityblock" else e.max(1) if metric == "chebyshev" else (e * e).sum(1)
                if metric == "euclidean":
                    d = np.sqrt(d)
                first = d.argmin(1)
                error = d[np.arange(len(x)), first]
                d[np.arange(len(x)), first] = np.inf
                second = d.argmin(1) if len(w) > 1 else first
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(first, pa.int64()), pa.array(error, pa.float64()), pa.array(second, pa.int64())], [*own, "unit", "error", "second"])

    return obs.mapInArrow(run, schema_with(obs, own, "unit long, error double, second long"))


def match_grid(matched: DataFrame, dy: int) -> DataFrame:
    return matched.withColumns({"row": F.floor(F.col("unit") / dy).cast("long"), "col": F.col("unit") % dy})


def transform(obs: DataFrame, units: DataFrame, metric="euclidean") -> DataFrame:
    """id and its best unit's weights."""
    return best_match(obs, units, metric).select("id", "unit").join(F.broadcast(units.select("unit", "w")), "unit").select("id", "w")


def calibrate(obs: DataFrame, units: DataFrame, metric="euclidean") -> DataFrame:
    """unit, label of its nearest observation (least id on ties). Each task keeps one candidate per unit."""
    m = metric_of(metric)
    near = F.explode(F.transform(_units(units), lambda u: F.struct(u.unit.alias("unit"), m(F.col("x"), u.w).alias("d"))))
    pairs = obs.select("id", "label", near.alias("n")).select("n.unit", F.struct("n.d", "id", "label").alias("c"))
    return pairs.groupBy("unit").agg(F.min("c").alias("c")).select("unit", "c.label")


def hit_counts(matched: DataFrame, units: DataFrame) -> DataFrame:
    """unit, hits; units without observations have none."""
    counts = matched.groupBy("unit").agg(F.count(F.lit(1)).alias("hits"))
    return units.select("unit").join(counts, "unit", "left").select("unit", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def distribute(matched: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, id) for each observation, and (unit, null) for units without any: the lists themselves have no bound and stay rows."""
    return units.select("unit").join(matched.select("unit", "id"), "unit", "left")


def quantization_error(matched: DataFrame) -> DataFrame:
    return matched.agg(F.avg("error").alias("quantization_error"))


def topographic_error(matched: DataFrame, dy: int) -> DataFrame:
    """Share of observations whose two best units aren't neighbours."""
    row = lambda c: F.floor(F.col(c) / dy)
    far = F.greatest(F.abs(row("unit") - row("second")), F.abs(F.col("unit") % dy - F.col("second") % dy)) > 1
    return matched.agg(F.avg(far.cast("double")).alias("topographic_error"))


def umatrix(units: DataFrame, dx: int, dy: int, radius: int = 1, scale: bool = True, norm: bool = True, metric="euclidean") -> DataFrame:
    """unit, value: distances to the neighbours, over their number (the unit itself counts), over the largest."""
    m = metric_of(metric)
    w = F.broadcast(units.select("unit", "w"))
    pairs = neighbours(units.sparkSession, dx, dy, radius).join(w, "unit").join(F.broadcast(units.select(F.col("unit").alias("nbr"), F.col("w").alias("v"))), "nbr")
    each = pairs.groupBy("unit").agg(F.sum(m(F.col("w"), F.col("v"))).alias("s"), F.count(F.lit(1)).alias("n"))
    each = each.select("unit", (F.col("s") / F.col("n") if scale else F.col("s")).alias("value"))
    if not norm:
        return each
    top = each.agg(F.max("value").alias("top"))
    return each.crossJoin(F.broadcast(top)).select("unit", F.coalesce(F.try_divide(F.col("value"), F.col("top")), F.lit(0.0)).alias("value"))


def batch_epoch(obs: DataFrame, units: DataFrame, dx: int, dy: int, radius: float, metric="euclidean", nh_shape: str = "gaussian") -> DataFrame:
    """unit, w after one batch epoch: neighbourhood-weighted means of the observations. Sums per unit are made in every task, so
    the shuffle has a row per task, unit and feature at most."""
    matched = best_match(obs, units, metric).select("unit", F.posexplode("x").alias("f", "v"))
    sums = matched.groupBy("unit", "f").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("c"))
    pairs = grid_pairs(units.sparkSession, dx, dy)
    h = _shape(nh_shape)((F.col("rowa") - F.col("rowb")).cast("double"), (F.col("cola") - F.col("colb")).cast("double"), radius, F).cast("double")
    spread = pairs.select(F.col("unita").alias("target"), F.col("unitb").alias("unit"), h.alias("h"))
    made = sums.join(F.broadcast(spread), "unit").groupBy("target", "f").agg(F.sum(F.col("h") * F.col("s")).alias("a"), F.sum(F.col("h") * F.col("c")).alias("b"))
    new = made.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("f", F.try_divide("a", "b").alias("w")))).alias("n"))
    joined = units.join(new, units.unit == new.target, "left")
    return joined.select("unit", F.when(F.col("n").isNotNull() & F.forall("n", lambda x: x.w.isNotNull()), F.transform("n", lambda x: x.w)).otherwise(F.col("w")).alias("w"))


#: Neighbourhood shapes by name, of the differences of rows and columns (numpy arrays or columns alike).
SHAPES = {
    "gaussian": lambda dr, dc, r, x: x.exp(-(dr * dr + dc * dc) / (2 * r * r)),
    "mexican": lambda dr, dc, r, x: (1 - (dr * dr + dc * dc) / (r * r)) * x.exp(-(dr * dr + dc * dc) / (2 * r * r)),
    "star": lambda dr, dc, r, x: ((abs(dr) if x is np else x.abs(dr)) + (abs(dc) if x is np else x.abs(dc)) <= r),
    "rect": lambda dr, dc, r, x: (np.maximum(abs(dr), abs(dc)) <= r) if x is np else (x.greatest(x.abs(dr), x.abs(dc)) <= r),
}


def _shape(name: str):
    if name not in SHAPES:
        raise ValueError(f"unknown neighbourhood {name!r}: one of {sorted(SHAPES)}")
    return SHAPES[name]


def _initial(obs: DataFrame, dx: int, dy: int, init, seed: int) -> DataFrame:
    """Initial units: rnd (uniform between the features' ends), hist, stm or pca, a function of (obs, dx, dy, seed), or numbers."""
    if callable(init):
        return init(obs, dx, dy, seed)
    if isinstance(init, np.ndarray | list):
        w = np.asarray(init, float)
        if w.ndim != 2 or len(w) != dx * dy:
            raise ValueError("a row of weights for each unit")
        return _frame(obs.sparkSession, w)
    if init == "rnd":
        return sample_uniform(obs, dx * dy, seed)
    if init == "pca":
        return sample_pca(obs, dx, dy)
    if init in ("hist", "stm"):
        return (sample_hist if init == "hist" else sample_stm)(obs.sparkSession, dx * dy, len(obs.select("x").first().x), seed)
    raise ValueError(f"unknown initial weights {init!r}")


def _checked(eta: float, radius: float, n_iter: int) -> None:
    if not 0 < eta <= 1:
        raise ValueError("eta lies in (0, 1]")
    if radius < 1 or n_iter < 1:
        raise ValueError("the radius and the number of iterations are 1 at least")


def fit_batch(obs: DataFrame, dx: int, dy: int, epochs: int, radius: float, seed: int = 10, metric="euclidean", nh_shape: str = "gaussian", init="rnd", decrease=decrease_linear) -> tuple[DataFrame, list[float]]:
    """Units after batch training with a falling radius, and each epoch's quantisation error. Weights pass through the driver (they
    are a map's, not the data's); each epoch is one pass over the observations."""
    spark = obs.sparkSession
    _checked(1.0, radius, epochs)
    units, errors = _initial(obs, dx, dy, init, seed), []
    for r in decrease(radius, epochs):
        errors.append(quantization_error(best_match(obs, units, metric)).first()[0])
        rows = batch_epoch(obs, units, dx, dy, r, metric, nh_shape).collect()
        units = spark.createDataFrame([(r.unit, list(r.w)) for r in rows], "unit long, w array<double>")
    return units, errors


def fit_incremental(obs: DataFrame, dx: int, dy: int, n_iter: int, eta: float, radius: float, seed: int = 10, ball_only: bool = False, metric: str = "euclidean", nh_shape: str = "gaussian", init="rnd") -> DataFrame:
    """The order-dependent trainer: observations are seen one after the other, so they go to one task as the method demands. Use
    fit_batch for data of any size. ball_only: only units within the radius move."""
    _checked(eta, radius, n_iter)
    shape, far = _shape(nh_shape), distance_of(metric)
    start = None if isinstance(init, str) and init == "rnd" else weights(_initial(obs, dx, dy, init, seed))

    def run(pdf):
        import pandas as pd

        x = np.stack(pdf.sort_values("id")["x"].to_numpy()).astype(float)
        rng = np.random.RandomState(seed)
        w = rng.uniform(x.min(0), x.max(0), (dx * dy, x.shape[1])) if start is None else start.copy()
        place = np.stack(np.divmod(np.arange(dx * dy), dy), 1)
        for e, r in zip(decrease_linear(eta, n_iter, 0.0), decrease_expo(radius, n_iter, 1.0), strict=True):
            for k in rng.permutation(len(x)):
                d = place - place[far(w, x[k]).argmin()]
                h = np.asarray(shape(d[:, 0], d[:, 1], r, np), float)
                if ball_only:
                    h = h * (np.abs(d).max(1) <= r)
                w += e * h[:, None] * (x[k] - w)
        return pd.DataFrame({"unit": np.arange(len(w)), "w": list(w)})

    return obs.select("id", "x", F.lit(0).alias("all")).groupBy("all").applyInPandas(run, "unit long, w array<double>")


def _ends(obs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    e = obs.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy("f").collect()
    return np.array([r.a for r in e]), np.array([r.b for r in e])


def _frame(spark: SparkSession, w: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(w)], "unit long, w array<double>")


def sample_uniform(obs: DataFrame, n_units: int, seed: int = 10) -> DataFrame:
    low, high = _ends(obs)
    return _frame(obs.sparkSession, np.random.default_rng(seed).uniform(low, high, (n_units, len(low))))


def sample_hist(spark: SparkSession, n_units: int, n_feats: int, seed: int = 10) -> DataFrame:
    return _frame(spark, np.random.default_rng(seed).dirichlet(np.ones(n_feats), n_units))


def sample_stm(spark: SparkSession, n_units: int, n_feats: int, seed: int = 10) -> DataFrame:
    n = math.isqrt(n_feats)
    if n * n != n_feats:
        raise ValueError("the number of features must be a square")
    return _frame(spark, np.random.default_rng(seed).dirichlet(np.ones(n), n_units * n).reshape(n_units, n_feats))


def pca(obs: DataFrame, n_comps: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(singular values, components, mean) of the centred observations, from one pass that sums products."""
    f = len(obs.select("x").first().x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, g, n = np.zeros(f), np.zeros((f, f)), 0
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(batch.num_rows, -1)
            s, g, n = s + x.sum(0), g + x.T @ x, n + len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(f * f + f + 1), pa.int64()), "v": pa.array(np.r_[g.ravel(), s, n])})

    v = np.array([r.v for r in obs.select("x").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()])
    n, mean = v[-1], v[f * f : -1] / v[-1]
    values, vectors = np.linalg.eigh(v[: f * f].reshape(f, f) - n * np.outer(mean, mean))
    top = np.argsort(-values)[:n_comps]
    return np.sqrt(np.maximum(values[top], 0)), vectors[:, top].T, mean


def pca_project(obs: DataFrame, components: np.ndarray, mean: np.ndarray) -> DataFrame:
    parts = [total(F.zip_with("x", F.array(*[F.lit(float(a)) for a in c]), lambda x, a: x * a)) - float(c @ mean) for c in components]
    return obs.select("id", F.array(*parts).alias("scores"))


def sample_pca(obs: DataFrame, dx: int, dy: int) -> DataFrame:
    """Units on the grid spanned by the two leading components."""
    sv, comps, mean = pca(obs, 2)
    sd = sv / math.sqrt(max(1, obs.count() - 1))
    a, b = np.meshgrid(np.linspace(-sd[0], sd[0], dx), np.linspace(-sd[1], sd[1], dy), indexing="ij")
    return _frame(obs.sparkSession, np.stack([a.ravel(), b.ravel()], 1) @ comps + mean)
