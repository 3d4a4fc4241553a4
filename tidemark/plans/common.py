"""Pieces that the query modules share: rounding, and common table expressions of their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c) -> Column:
    """Rounded to six places, without negative noughts."""
    return F.round(c if isinstance(c, Column) else F.col(c), 6) + 0.0


#: Signals by user: series_id, frame, x, n (frames of the series).
SIG = """sig AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS x,
  count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def seg_cte(p: int, o: int, extend: bool, pad: bool) -> str:
    """seg: series_id, seg, j, x of all segments."""
    step, ext = p - o, p // 2 if extend else 0
    padding = f"(((({p} - n) % {step}) + {step}) % {step}) % {p}" if pad else "0"
    return f"""{SIG}, ns AS (SELECT series_id, max(n) AS n FROM sig GROUP BY series_id HAVING max(n) >= {p}),
segs AS (SELECT series_id, n, unnest(range(0, ((n + {2 * ext} + {padding} - {o}) // {step})::BIGINT)) AS seg FROM ns),
seg AS (SELECT s.series_id, s.seg, j.j, coalesce(sig.x, 0.0) AS x FROM segs s CROSS JOIN range(0, {p}) AS j(j)
  LEFT JOIN sig ON sig.series_id = s.series_id AND sig.frame = s.seg * {step} + j.j - {ext})"""


#: Embeddings as segments of 64 samples: series_id, j, x.
VEC = "vec AS (SELECT vec_id AS series_id, unnest(range(0, 64)) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings)"

WINDOWS_SQL = {"rect": "1.0::DOUBLE", "hamming": "(0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * j / {n}))", "hann": "(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / {n}))"}


def spec_cte(source: str, keys: str, n: int, n_fft: int, window: str = "rect") -> str:
    """spec: keys, k, re, im, a of the source's segments (keys, j, x)."""
    w = WINDOWS_SQL[window].format(n=n)
    return f"""spec AS (SELECT {keys}, k, re, im, sqrt(re * re + im * im) AS a FROM (
  SELECT {keys}, k, sum(x * {w} * cos(2 * pi() * k * j / {n_fft})) * 2 / max(ws) AS re, -sum(x * {w} * sin(2 * pi() * k * j / {n_fft})) * 2 / max(ws) AS im
  FROM {source} CROSS JOIN range(0, {n_fft // 2 + 1}) AS k(k) CROSS JOIN (SELECT sum({w}) AS ws FROM range(0, {n}) AS j(j)) AS w WHERE j < {n_fft} GROUP BY {keys}, k))"""


def flux_cte(keys: str = "series_id") -> str:
    """flux: series_id, seg, flux from spec (series_id, seg, k, a)."""
    return f"""grad AS (SELECT {keys}, seg, k, lag(a) OVER w AS before, a, lead(a) OVER w AS after FROM spec WINDOW w AS (PARTITION BY {keys}, k ORDER BY seg)),
flux AS (SELECT {keys}, seg, sum(greatest(CASE WHEN before IS NULL THEN after - a WHEN after IS NULL THEN a - before ELSE (after - before) / 2 END, 0)) AS flux
  FROM grad WHERE before IS NOT NULL OR after IS NOT NULL GROUP BY {keys}, seg)"""
