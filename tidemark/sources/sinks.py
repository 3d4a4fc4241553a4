"""Writing features, and names of output files."""

from __future__ import annotations

import io
import json
from pathlib import PurePosixPath

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(df: DataFrame) -> DataFrame:
    """Struct columns' fields become columns, one level deep; of equal names the last stays."""
    found: dict[str, F.Column] = {}
    for field in df.schema:
        if isinstance(field.dataType, T.StructType):
            found |= {f.name: F.col(f"`{field.name}`.`{f.name}`").alias(f.name) for f in field.dataType}
        else:
            found[field.name] = F.col(f"`{field.name}`")
    return df.select(*found.values())


def feature_rows(df: DataFrame) -> DataFrame:
    """Array columns side by side, with their index; as many rows as the shortest has."""
    flat = flatten(df)
    arrays = [f.name for f in flat.schema if isinstance(f.dataType, T.ArrayType)]
    rest = [c for c in flat.columns if c not in arrays]
    size = F.least(*[F.size(a) for a in arrays]) if len(arrays) > 1 else F.size(arrays[0])
    return flat.select(*rest, F.posexplode(F.slice(F.arrays_zip(*arrays), F.lit(1), size)).alias("index", "_r")).select(*rest, "index", "_r.*")


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def to_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One file in any store that Spark can write to."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def save_npy(spark: SparkSession, data, path: str) -> None:
    """One array, of the driver's size, as an .npy file without pickled objects; ``load_npy`` reads it."""
    held = io.BytesIO()
    np.save(held, np.asarray(data), allow_pickle=False)
    write_bytes(spark, path, held.getvalue())


def save_weights(units: DataFrame, path: str) -> None:
    """A map's weights, a row for each unit."""
    save_npy(units.sparkSession, [r.w for r in units.orderBy("unit").collect()], path)


def save_map(units: DataFrame, path: str, **about) -> None:
    """A map as JSON: its weights by unit, and what else there is to say about it."""
    write_bytes(units.sparkSession, path, json.dumps({"weights": [list(r.w) for r in units.orderBy("unit").collect()]} | about).encode())


def load_map(spark: SparkSession, path: str) -> DataFrame:
    """unit, w of a saved map."""
    read = spark.read.option("multiLine", True).schema("weights array<array<double>>").json(path)
    return read.select(F.posexplode("weights").alias("unit", "w")).select(F.col("unit").cast("long").alias("unit"), "w")


def generate_outpath(source: str, out: str | None = None, suffix: str | None = None) -> str:
    """The source's name with the suffix in the working folder, in the folder out, or out itself if it has an extension."""
    name = PurePosixPath(source).stem + (f".{suffix.lstrip('.')}" if suffix else "")
    if out is None:
        return name
    return out if PurePosixPath(out).suffix else str(PurePosixPath(out) / name)
