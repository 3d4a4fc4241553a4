"""Audio, arrays and JSON as DataFrames. Files are read by Spark (binaryFile), so any of its stores will do."""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_wav(blob: bytes) -> tuple[int, np.ndarray]:
    """(frames a second, float64 (frames, channels)) of RIFF PCM of 8, 16, 24 or 32 bits or 32- or 64-bit floats."""
    if blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(blob):
        kind, size = blob[at : at + 4], struct.unpack("<I", blob[at + 4 : at + 8])[0]
        body = blob[at + 8 : at + 8 + size]
        if kind == b"fmt ":
            fmt = struct.unpack("<HHIIHH", body[:16])
            code = struct.unpack("<H", body[24:26])[0] if fmt[0] == 0xFFFE else fmt[0]
        elif kind == b"data":
            if fmt is None:
                raise ValueError("data before format")
            channels, fps, bits = fmt[1], fmt[2], fmt[5]
            if code == 3:
                x = np.frombuffer(body, {32: "<f4", 64: "<f8"}[bits]).astype(float)
            elif bits == 8:
                x = (np.frombuffer(body, np.uint8).astype(float) - 128) / 128
            elif bits == 24:
                b = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
                x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 2.0**23
            else:
                x = np.frombuffer(body, {16: "<i2", 32: "<i4"}[bits]) / 2.0 ** (bits - 1)
            return fps, x[: len(x) // channels * channels].reshape(-1, channels)
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """series_id (path), fps, channel, frame, value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fps, x = decode_wav(blob)
                for k in range(0, len(x), 65536):
                    part = x[k : k + 65536]
                    n, c = part.shape
                    cols = [pa.array([name] * (n * c)), pa.array(np.full(n * c, fps, np.int32)), pa.array(np.tile(np.arange(c, dtype=np.int32), n)), pa.array(np.repeat(np.arange(k, k + n), c)), pa.array(part.ravel())]
                    yield pa.RecordBatch.from_arrays(cols, ["series_id", "fps", "channel", "frame", "value"])

    return _files(spark, path, "*.wav").mapInArrow(run, "series_id string, fps int, channel int, frame long, value double")


def audio_info(spark: SparkSession, path: str) -> DataFrame:
    """path, fps, n_frames, n_channels, hash (SHA-256 of the mono samples as little-endian doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(decode_wav(b)) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f for f, _ in rows], pa.int32()), pa.array([len(x) for _, x in rows], pa.int64()), pa.array([x.shape[1] for _, x in rows], pa.int32()), pa.array([hashlib.sha256(x.mean(1).astype("<f8").tobytes()).hexdigest() for _, x in rows])], ["path", "fps", "n_frames", "n_channels", "hash"])

    return _files(spark, path, "*.wav").mapInArrow(run, "path string, fps int, n_frames long, n_channels int, hash string")


def mono(signal: DataFrame) -> DataFrame:
    """The mean of the channels."""
    keys = [c for c in signal.columns if c not in ("channel", "value")]
    return signal.groupBy(*keys).agg(F.avg("value").alias("value"))


def read_frames(signal: DataFrame, n_frames: int = -1, offset: int = 0, norm: bool = False) -> DataFrame:
    """Frames offset ... offset + n_frames - 1, numbered from 0; outside the signal they are 0. n_frames < 1: all from offset on.
    norm: over each channel's largest absolute value. Only the frames wanted are read."""
    if offset < 0 and n_frames < 1:
        raise ValueError("a negative offset needs n_frames")
    keys = [c for c in signal.columns if c not in ("frame", "value")]
    inside = signal.where(F.col("frame") >= offset)
    if n_frames >= 1:
        inside = inside.where(F.col("frame") < offset + n_frames)
    out = inside.withColumn("frame", F.col("frame") - offset)
    if n_frames >= 1:
        grid = signal.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_frames - 1).cast("long"))).alias("frame"))
        out = grid.join(out, [*keys, "frame"], "left").select(*keys, "frame", F.coalesce("value", F.lit(0.0)).alias("value"))
    if norm:
        peak = out.groupBy(*keys).agg(F.max(F.abs("value")).alias("_p"))
        out = out.join(peak, keys).select(*keys, "frame", F.coalesce(F.try_divide("value", "_p"), F.lit(0.0)).alias("value"))
    return out


def load_npy(spark: SparkSession, path: str) -> DataFrame:
    """path, shape, data (row by row) of .npy files; pickled objects are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [np.load(io.BytesIO(b), allow_pickle=False) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(a.shape) for a in arrays], pa.list_(pa.int64())), pa.array([a.astype(float).ravel() for a in arrays], pa.list_(pa.float64()))], ["path", "shape", "data"])

    return _files(spark, path, "*.npy").mapInArrow(run, "path string, shape array<long>, data array<double>")


NDARRAY = "struct<__ndarray__:boolean,__dtype__:string,data:array<double>>"


def encode_ndarray(data, dtype: str = "float64"):
    """A JSON envelope of an array column; NaN is kept."""
    return F.to_json(F.struct(F.lit(True).alias("__ndarray__"), F.lit(dtype).alias("__dtype__"), data.alias("data")))


def decode_ndarray(text):
    """The array of an envelope; null for other JSON."""
    parsed = F.from_json(text, NDARRAY)
    return F.when(parsed["__ndarray__"] & parsed["__dtype__"].isNotNull(), parsed["data"])


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)
