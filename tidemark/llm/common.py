"""Shared pieces of the training-data operators: tables, shared work folder, whole-text access, size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid
import weakref
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcasts larger than this many bytes are not made; each caller has another way beyond it.
BROADCAST_LIMIT = 64 << 20
#: Texts that a task takes from the JVM at once, in jobs that read whole texts.
TEXT_ROWS = 1000

#: Where the tables of ``materialize`` lie.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset one is made, if driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(base)
    return base


@contextmanager
def own_job(spark: SparkSession, rows: int | None = None) -> Iterator[None]:
    """Jobs run herein delete their shuffle files when they end, and hand Python ``rows`` rows at once."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)} if rows else {})
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors. ``discard`` deletes it."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with own_job(spark, rows):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that nothing reads any more."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path is not None:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def fold(doc_id, mod: int = 5) -> int:
    """crc32 of the decimal text of an id, modulo mod (None: 0)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def fold_column(doc_id: Column, mod: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def utf8(column) -> list[bytes]:
    """A pyarrow string column as a list of UTF-8 bytes; null becomes empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def strings(column):
    """A pyarrow string column as strings with 64-bit offsets that begin at 0; null becomes empty. (``ascii_lower`` of pyarrow 23 misreads
    other offsets, which casts of slices have.)"""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.large_string())
    return pc.if_else(pc.is_null(column), "", column)
