"""The window operators on streams of (series_id, ts, value)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import PeakPickingParams


def windowed(stream: DataFrame, length: str, hop: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Energy, rms and extreme amplitudes of tumbling or hopping windows; state ends with the watermark."""
    w = F.window("ts", length, hop) if hop else F.window("ts", length)
    out = stream.withWatermark("ts", late).groupBy("series_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * F.col("value")).alias("energy"), F.max(F.abs("value")).alias("maxamp"), F.min(F.abs("value")).alias("minamp"))
    return out.select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "energy", F.sqrt(F.col("energy") / F.col("n")).alias("rms"), "maxamp", "minamp")


def peak_threshold(stream: DataFrame, params: PeakPickingParams) -> DataFrame:
    """series_id, ts, value, above: the causal part of peak picking (the decaying threshold), with one number of state a series.

    Values of one series are taken in order of time within each batch; batches are expected in order."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = stream.schema["series_id"].dataType.simpleString()

    def run(key, frames: Iterator, state):
        import pandas as pd

        g = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(frames)).sort_values("ts")
        above = []
        for v in rows["value"]:
            above.append(bool(v >= g))
            g = max(v, params.alpha * g + (1 - params.alpha) * v)
        state.update((float(g),))
        yield pd.DataFrame({"series_id": key[0], "ts": rows["ts"], "value": rows["value"], "above": above})

    return stream.select("series_id", "ts", "value").groupBy("series_id").applyInPandasWithState(run, f"series_id {kind}, ts timestamp, value double, above boolean", "g double", "append", GroupStateTimeout.NoTimeout)
