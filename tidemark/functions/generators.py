"""Signals made from parameters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Earthquakes of magnitude 7 or more in the world, 1900 to 2006; fixed values.
EARTHQUAKES = (
    13, 14, 8, 10, 16, 26, 32, 27, 18, 32, 36, 24, 22, 23, 22, 18, 25, 21, 21, 14, 8, 11, 14, 23, 18, 17, 19, 20, 22, 19, 13, 26, 13, 14, 22, 24,
    21, 22, 26, 21, 23, 24, 27, 41, 31, 27, 35, 26, 28, 36, 39, 21, 17, 22, 17, 19, 15, 34, 10, 15, 22, 18, 15, 20, 15, 22, 19, 16, 30, 27, 29, 23,
    20, 16, 21, 21, 25, 16, 18, 15, 18, 14, 10, 15, 8, 15, 6, 11, 8, 7, 18, 16, 13, 12, 13, 20, 15, 16, 12, 18, 15, 16, 13, 15, 16, 11, 11,
)


def earthquakes(spark: SparkSession) -> DataFrame:
    """series_id, t (years since 1900), n."""
    text = ",".join(map(str, EARTHQUAKES))
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("t", "n")).select(F.lit("earthquakes").alias("series_id"), F.col("t").cast("long").alias("t"), F.col("n").cast("long").alias("n"))


def sinusoid(spark: SparkSession, frqs: list[float], amps: float | list[float] = 1.0, fps: int = 9000, length: float = 1.0, noise: float | None = None, comps: bool = False, seed: int = 0) -> DataFrame:
    """frame, value: sum of sinusoids, or with comps one series (comp) for each."""
    amps = [float(amps)] * len(frqs) if isinstance(amps, int | float) else [float(a) for a in amps]
    if len(amps) != len(frqs):
        raise ValueError("one amplitude, or one for each frequency")
    wave = [a * F.sin(F.lit(2 * math.pi * f) * F.col("id") / F.lit(float(fps))) for f, a in zip(frqs, amps, strict=True)]
    extra = F.randn(seed) * noise if noise else F.lit(0.0)
    frames = spark.range(int(fps * length))
    if comps:
        parts = F.array(*[F.struct(F.lit(k).cast("long").alias("comp"), (w + extra).alias("value")) for k, w in enumerate(wave)])
        return frames.select(F.col("id").alias("frame"), F.explode(parts).alias("p")).select("p.comp", "frame", "p.value")
    total = wave[0]
    for w in wave[1:]:
        total = total + w
    return frames.select(F.col("id").alias("frame"), (total + extra).alias("value"))


def noise(spark: SparkSession, level: float, n: int = 9000, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("frame"), (F.randn(seed) * level).alias("value"))


def lorenz_attractor(spark: SparkSession, n: int, sigma: float = 10.0, rho: float = 28.0, beta: float = 8 / 3, init: tuple = (0.0, 1.0, 1.05), dt: float = 0.01) -> DataFrame:
    """frame, x, y, z by Euler steps, row 0 being init. An ordered fold: one task makes it, some rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, z = map(float, init)
        for _ in batches:
            for k in range(0, n, 65536):
                rows = np.empty((min(65536, n - k), 3))
                for i in range(len(rows)):
                    rows[i] = x, y, z
                    x, y, z = x + dt * (sigma * (y - x)), y + dt * (x * (rho - z) - y), z + dt * (x * y - beta * z)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(rows))), *(pa.array(rows[:, c].copy()) for c in range(3))], ["frame", "x", "y", "z"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "frame long, x double, y double, z double")


def norm_circle(spark: SparkSession, n_classes: int, n_per_class: int, class_std: float, center: tuple = (0.0, 0.0), radius: float = 5.0, seed: int = 0) -> DataFrame:
    """label, x, y: Gaussian blobs round a circle."""
    angle = F.lit(2 * math.pi) * F.col("label") / F.lit(float(n_classes))
    std = math.sqrt(math.sqrt(class_std))
    points = spark.range(n_classes * n_per_class).select((F.col("id") % n_classes).alias("label"), F.randn(seed).alias("a"), F.randn(seed + 1).alias("b"))
    return points.select("label", (center[0] + radius * F.sin(angle) + std * F.col("a")).alias("x"), (center[1] + radius * F.cos(angle) + std * F.col("b")).alias("y"))
