"""Small expressions on array<double> columns. None of them needs a shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, use) -> Column:
    """use(value), value being computed once."""
    return F.transform(F.array(value), use)[0]


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def places(n) -> Column:
    """0, ..., n - 1."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def at(a: Column, i) -> Column:
    """Element i from 0; 0.0 outside."""
    return F.coalesce(F.get(a, i), F.lit(0.0))


def max_abs(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


METRICS = {
    "euclidean": euclidean,
    "sqeuclidean": lambda a, b: total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))),
    "cityblock": lambda a, b: total(F.zip_with(a, b, lambda x, y: F.abs(x - y))),
    "chebyshev": lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))),
    "cosine": lambda a, b: 1.0 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)),
    "correlation": lambda a, b: let(F.struct(a.alias("a"), b.alias("b"), (total(a) / F.size(a)).alias("c"), (total(b) / F.size(b)).alias("d")), lambda s: METRICS["cosine"](F.transform(s.a, lambda x: x - s.c), F.transform(s.b, lambda x: x - s.d))),
    "canberra": lambda a, b: total(F.zip_with(a, b, lambda x, y: F.coalesce(F.try_divide(F.abs(x - y), F.abs(x) + F.abs(y)), F.lit(0.0)))),
    "braycurtis": lambda a, b: total(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / total(F.zip_with(a, b, lambda x, y: F.abs(x + y))),
    "hellinger": lambda a, b: F.sqrt(total(F.zip_with(a, b, lambda x, y: (F.sqrt(x) - F.sqrt(y)) * (F.sqrt(x) - F.sqrt(y)))) / 2.0),
}


def metric(name):
    """A metric by name, or a function of two array columns."""
    if callable(name):
        return name
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}")
    return METRICS[name]


#: Distances of the rows of w from x, in numpy.
DISTANCES = {
    "euclidean": lambda w, x: np.sqrt(((w - x) ** 2).sum(1)),
    "sqeuclidean": lambda w, x: ((w - x) ** 2).sum(1),
    "cityblock": lambda w, x: np.abs(w - x).sum(1),
    "chebyshev": lambda w, x: np.abs(w - x).max(1),
    "cosine": lambda w, x: 1 - (w @ x) / np.sqrt((w * w).sum(1) * (x @ x)),
    "correlation": lambda w, x: DISTANCES["cosine"](w - w.mean(1, keepdims=True), x - x.mean()),
    "canberra": lambda w, x: np.divide(np.abs(w - x), np.abs(w) + np.abs(x), out=np.zeros(w.shape), where=np.abs(w) + np.abs(x) > 0).sum(1),
    "braycurtis": lambda w, x: np.abs(w - x).sum(1) / np.abs(w + x).sum(1),
    "hellinger": lambda w, x: np.sqrt(((np.sqrt(w) - np.sqrt(x)) ** 2).sum(1) / 2),
}


def distance_of(name: str):
    """A metric in numpy by name, or a function of (rows, vector)."""
    if callable(name):
        return name
    if name not in DISTANCES:
        raise ValueError(f"unknown metric {name!r}")
    return DISTANCES[name]


def hellinger_rows(a: Column, b: Column, n: int) -> Column:
    """Hellinger distance of each row of two flattened n x n matrices."""
    return F.transform(places(n), lambda i: METRICS["hellinger"](F.slice(a, i * n + 1, n), F.slice(b, i * n + 1, n)))


def schema_with(df: DataFrame, columns: list[str], more: str) -> T.StructType:
    """The schema of some columns of df, and further fields as DDL."""
    return T.StructType([*df.select(*columns).schema.fields, *T.StructType.fromDDL(more).fields])
