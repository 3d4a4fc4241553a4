"""Queries of segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import segment as G
from ..params import SegmentationParams
from .common import SIG, r6, seg_cte


def _long(df: DataFrame) -> DataFrame:
    return df.select("series_id", "seg", F.posexplode("data").alias("j", "x")).select("series_id", "seg", F.col("j").cast("long").alias("j"), r6("x").alias("x"))


def _segmentation(extend: bool, pad: bool):
    return (
        lambda s, d: _long(G.segmentation(A.sig_user(s, d), SegmentationParams(16, 6, extend, pad))),
        f"WITH {seg_cte(16, 6, extend, pad)} SELECT series_id, seg, j, round(x, 6) + 0.0 AS x FROM seg",
    )


def bounds(s, d):
    return G.segmentation(A.sig_user(s, d), SegmentationParams(16, 8)).select("series_id", "seg", "center", "lo", "hi")


def by_samples(s, d):
    return _long(G.by_samples(A.sig_user(s, d), 16))


def by_samples_hop(s, d):
    return _long(G.by_samples(A.sig_user(s, d), 16, 5))


def by_ms(s, d):
    return _long(G.by_ms(A.sig_user(s, d), 1000, 12))


def by_onsets(s, d):
    onsets = A.sig_user(s, d).where("frame % 10 = 7").select("series_id", F.floor(F.col("frame") / 10).cast("long").alias("seg"), F.col("frame").alias("index"))
    return _long(G.by_onsets(A.sig_user(s, d), 8, onsets, 2))


def zero_padding(s, d):
    v = A.sig_vec(s, d)
    return _long(v.withColumn("data", G.zero_padding(F.col("data"), 3)))


def delay_embedding(s, d):
    out = G.delay_embedding_frames(A.sig_user(s, d), 3, 3)
    return out.select("series_id", "frame", *[r6(F.col("vec")[k]).alias(f"x{k}") for k in range(3)])


_TUMBLE = """WITH {sig}, g AS (SELECT series_id, n, unnest(range(0, (n + {p} - 1) // {p})) AS seg FROM (SELECT series_id, max(n) AS n FROM sig GROUP BY series_id))
SELECT g.series_id, g.seg, j.j, round(coalesce(x, 0), 6) + 0.0 AS x FROM g CROSS JOIN range(0, {p}) AS j(j) LEFT JOIN sig ON sig.series_id = g.series_id AND sig.frame = g.seg * {p} + j.j"""

QUERIES = {
    "segment_extend_pad": _segmentation(True, True),
    "segment_extend_nopad": _segmentation(True, False),
    "segment_noextend_pad": _segmentation(False, True),
    "segment_noextend_nopad": _segmentation(False, False),
    "segment_bounds": (bounds, f"WITH {seg_cte(16, 8, True, True)} SELECT series_id, seg, seg * 8 AS center, seg * 8 - 8 AS lo, seg * 8 + 8 AS hi FROM segs"),
    "by_samples": (by_samples, _TUMBLE.format(sig=SIG, p=16)),
    "by_ms": (by_ms, _TUMBLE.format(sig=SIG, p=12)),
    "by_samples_hop": (
        by_samples_hop,
        f"""WITH {SIG}, g AS (SELECT series_id, unnest(range(0, (n - 16) // 5 + 1 + CASE WHEN (n - 16) % 5 > 0 THEN 1 ELSE 0 END)) AS seg FROM (SELECT series_id, max(n) AS n FROM sig GROUP BY series_id HAVING max(n) >= 16))
SELECT g.series_id, g.seg, j.j, round(coalesce(x, 0), 6) + 0.0 AS x FROM g CROSS JOIN range(0, 16) AS j(j) LEFT JOIN sig ON sig.series_id = g.series_id AND sig.frame = g.seg * 5 + j.j""",
    ),
    "by_onsets": (
        by_onsets,
        f"""WITH {SIG}, o AS (SELECT series_id, frame // 10 AS seg, least(frame + 2, n - 1) AS st FROM sig WHERE frame % 10 = 7)
SELECT o.series_id, o.seg, j.j, round(coalesce(x, 0), 6) + 0.0 AS x FROM o CROSS JOIN range(0, 8) AS j(j) LEFT JOIN sig ON sig.series_id = o.series_id AND sig.frame = o.st + j.j""",
    ),
    "zero_padding": (zero_padding, "SELECT vec_id AS series_id, 0::BIGINT AS seg, j, round(coalesce(embedding[j + 1]::DOUBLE, 0), 6) + 0.0 AS x FROM embeddings CROSS JOIN range(0, 67) AS j(j)"),
    "delay_embedding": (
        delay_embedding,
        f"""WITH {SIG}, e AS (SELECT series_id, frame, x AS x0, lead(x, 3) OVER w AS x1, lead(x, 6) OVER w AS x2 FROM sig WINDOW w AS (PARTITION BY series_id ORDER BY frame))
SELECT series_id, frame, round(x0, 6) + 0.0 AS x0, round(x1, 6) + 0.0 AS x1, round(x2, 6) + 0.0 AS x2 FROM e WHERE x2 IS NOT NULL""",
    ),
}
