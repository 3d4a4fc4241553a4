"""Every registered query with a DuckDB statement against it, on the smallest tables."""

import math
import os
from fractions import Fraction

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog, similarity

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def rows(names, data):
    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v + 0.0
        return v

    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, sf, name):
    got = catalog.queries()[name](spark, sf)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows(got.columns, got.collect()), rows(names, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and q is not None and math.isclose(p, q, rel_tol=1e-9, abs_tol=2e-6)) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - {"cdim"}))
def test_rows_only(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_evaluation_is_of_detected_onsets(spark, sf):
    """Frames are a sixteenth of a second apart, so within the tolerance only equal ones match."""
    times = {n: {} for n in ("flux_onsets", "entropy_onsets")}
    for n, found in times.items():
        for r in catalog.queries()[n](spark, sf).collect():
            found.setdefault(r.series_id, []).append(r.frame / 16)
    got = {r.name: r for r in catalog.queries()["evaluate_onsets"](spark, sf).collect()}
    assert set(got) == set(times["flux_onsets"]) | set(times["entropy_onsets"])
    for name, r in got.items():
        e, t = (sorted(times[n].get(name, [])) for n in ("flux_onsets", "entropy_onsets"))
        hits = len({round(x * 16) for x in e} & {round(x * 16) for x in t})
        assert math.isclose(r.precision, hits / len(e) if e else 0, abs_tol=1e-6)
        assert math.isclose(r.recall, hits / len(t) if t else 0, abs_tol=1e-6)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_stationary_against_fractions(spark, sf, size):
    """The SQL's squaring drifts by some 1e-8, which shows in the sixth place now and then; the query has the places of the exact solution."""
    path = sf.replace("sf0.001", size)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet')")
    cells: dict = {}
    for series, i, j, c, s in con.execute(f"WITH {similarity._TPM} SELECT series_id, i, j, c, s FROM fl").fetchall():
        cells.setdefault(series, {})[i, j] = Fraction(int(c), int(s)) if s else Fraction(1, 5)
    got = {(r.series_id, r.i): r.p for r in catalog.queries()["stationary"](spark, path).collect()}
    assert set(got) == {(series, i) for series in cells for i in range(5)}
    for series, p in cells.items():
        # pi (1 - P + ones) = ones, by elimination
        m = [[(r == c) - p[c, r] + 1 for c in range(5)] + [Fraction(1)] for r in range(5)]
        for k in range(5):
            pivot = next(r for r in range(k, 5) if m[r][k])
            m[k], m[pivot] = m[pivot], m[k]
            m[k] = [x / m[k][k] for x in m[k]]
            m = [row if r == k else [x - row[k] * y for x, y in zip(row, m[k], strict=True)] for r, row in enumerate(m)]
        for i in range(5):
            assert abs(Fraction(got[series, i]) - m[i][5]) <= Fraction(1, 2 * 10**6) + Fraction(1, 10**12)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
