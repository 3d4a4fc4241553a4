"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reference sound pressure and intensity level; fixed values.
SPL_REF = 2e-5
INTENSITY_REF = 1e-11
#: Constants of the C-weighting curve; fixed values.
C_HIGH, C_LOW = 148693636.0, 424.36


def c_weighting(f: Column) -> Column:
    f2 = f * f
    return C_HIGH * f2 / ((f2 + C_HIGH) * (f2 + C_LOW))


def freq2mel(f: Column) -> Column:
    return 1125.0 * F.log(1.0 + f / 700.0)


def mel2freq(z: Column) -> Column:
    return 700.0 * (F.exp(z / 1125.0) - 1.0)


def amp(spl: Column, ref: float = SPL_REF) -> Column:
    return F.pow(F.lit(10.0), 0.05 * spl) * ref


def limit(v: Column, ldb: float | None = None, udb: float | None = None) -> Column:
    """Values below the amplitude of ldb become 0, values above that of udb the latter; None: no bound."""
    out = F.when(v < 10.0 ** (0.05 * ldb) * SPL_REF, 0.0).otherwise(v) if ldb is not None else v
    return F.least(out, F.lit(10.0 ** (0.05 * udb) * SPL_REF)) if udb is not None else out


def fti16(v: Column) -> Column:
    return F.greatest(F.least(F.floor(v * 32768.0), F.lit(32767)), F.lit(-32768)).cast("short")


def frq2cbr(f: Column) -> Column:
    """Critical-band rate in Bark."""
    return 13.0 * F.atan(0.00076 * f) + 3.5 * F.atan(F.pow(f / 7500.0, F.lit(2.0)))


def level(intensity: Column) -> Column:
    return 10.0 * F.log10(F.greatest(intensity, F.lit(INTENSITY_REF)) / INTENSITY_REF)


def specific_loudness(intensity: Column) -> Column:
    return F.pow(level(intensity), F.lit(0.23))


def weight_factor(z: Column) -> Column:
    return F.greatest(F.lit(1.0), 0.066 * F.exp(0.171 * z))


def within(v: Column, low: Column, high: Column) -> Column:
    return v.between(low, high)


def within_any(df: DataFrame, column: str, intervals: DataFrame) -> DataFrame:
    """Rows whose value lies in any of the closed intervals (low, high). The intervals are few and come from the caller."""
    return df.join(F.broadcast(intervals), F.col(column).between(F.col("low"), F.col("high")), "left_semi")


def repath(path: Column, folder: str | None = None, ext: str | None = None) -> Column:
    """A path's file name in another folder, with another extension."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    name = F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(ext)) if ext is not None else name
    return F.concat_ws("/", F.lit(folder), name) if folder is not None else F.concat(F.regexp_replace(path, r"[^/]+$", ""), name)


def normalize_max(df: DataFrame, by: list[str], column: str = "value") -> DataFrame:
    """Values over their group's largest absolute value (0 stays 0). One small aggregate per group, joined back."""
    peak = df.groupBy(*by).agg(F.max(F.abs(column)).alias("_peak"))
    return df.join(peak, by).withColumn(column, F.coalesce(F.try_divide(F.col(column), F.col("_peak")), F.lit(0.0))).drop("_peak")


def scale(df: DataFrame, by: list[str], low: float = 0.0, high: float = 1.0, column: str = "value") -> DataFrame:
    """Min-max scaling to [low, high] within groups; by=[]: over all values."""
    ends = df.groupBy(*by).agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    both = df.join(ends, by) if by else df.crossJoin(F.broadcast(ends))
    return both.withColumn(column, low + (high - low) * F.coalesce(F.try_divide(F.col(column) - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0))).drop("_a", "_b")


def _moments(df: DataFrame, by: list[str], column: str) -> DataFrame:
    return df.join(df.groupBy(*by).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s")), by)


def standardize(df: DataFrame, by: list[str], column: str = "value") -> DataFrame:
    return _moments(df, by, column).withColumn(column, F.coalesce(F.try_divide(F.col(column) - F.col("_m"), F.col("_s")), F.lit(0.0))).drop("_m", "_s")


def smooth_stat(df: DataFrame, by: list[str], column: str = "value") -> DataFrame:
    """Values within one standard deviation of the mean become the mean."""
    near = F.col(column).between(F.col("_m") - F.col("_s"), F.col("_m") + F.col("_s"))
    return _moments(df, by, column).withColumn(column, F.when(near, F.col("_m")).otherwise(F.col(column))).drop("_m", "_s")


def rowdiag(entries: DataFrame, k: int) -> DataFrame:
    """The k-th diagonal of matrices given as (i, j, ...)."""
    return entries.where(F.col("j") == F.col("i") + k)


def rank_by(df: DataFrame, by: list[str], key: str, out: str) -> DataFrame:
    """Position of each row in its group in order of key."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1).cast("long"))
