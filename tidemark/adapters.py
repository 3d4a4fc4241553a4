"""Driver tables as signals, spectra and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sig_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per user of events: series_id, frame, value."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), (F.row_number().over(w) - 1).cast("long").alias("frame"), "value")


def sig_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a segment of 64 samples: series_id, seg, data."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("series_id"), F.lit(0).cast("long").alias("seg"), F.col("embedding").cast("array<double>").alias("data"))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("long").alias("label"))


def prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of event types by user: series_id, p (types in alphabetical order)."""
    e = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type").count().na.fill(0)
    kinds = sorted(c for c in e.columns if c != "user_id")
    total = sum((F.col(f"`{c}`") for c in kinds[1:]), F.col(f"`{kinds[0]}`"))
    return e.select(F.col("user_id").alias("series_id"), F.array(*[F.col(f"`{c}`") / total for c in kinds]).alias("p"))


def counts_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per day and priority: series_id, t (days since 1970), n."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series_id"), F.datediff(F.col("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long").alias("t")).agg(F.count(F.lit(1)).alias("n"))
