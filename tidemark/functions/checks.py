"""Checks of arguments, JSON forms of values and exact sums, on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def assert_array(arr: np.ndarray, ndim: int, size: int, lower_bound: float = -math.inf, upper_bound: float = math.inf, name: str = "arr") -> None:
    """ValueError if the number of dimensions, the size or an element is not as wanted."""
    found = np.asarray(arr)
    if found.ndim != ndim:
        raise ValueError(f"{name} must have {ndim} dimensions, not {found.ndim}")
    if found.size != size:
        raise ValueError(f"{name} must have {size} elements, not {found.size}")
    if (found < lower_bound).any() or (found > upper_bound).any():
        raise ValueError(f"{name} must lie between {lower_bound} and {upper_bound}")


def assert_and_pass(check: Callable, value):
    """value, after check(value) unless it is None."""
    if value is not None:
        check(value)
    return value


def jsonify(value):
    """What json can write: plain values and containers as they are, arrays as lists, the rest as text."""
    if value is None or isinstance(value, dict | list | tuple | str | int | float):
        return value
    if isinstance(value, np.ndarray | np.generic):
        return value.tolist()
    return str(value)


def time_stamp(fmt: str | None = None) -> str:
    """The time in UTC, in ISO 8601 or by a format."""
    now = datetime.now(UTC)
    return now.isoformat() if fmt is None else now.strftime(fmt)


def fsum(values: Column) -> Column:
    """Sum of an array's elements with the rounding errors summed beside it (Neumaier's scheme)."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def add(a: Column, x: Column) -> Column:
        t = a.s + x
        lost = F.when(F.abs(a.s) >= F.abs(x), (a.s - t) + x).otherwise((x - t) + a.s)
        return F.struct(t.alias("s"), (a.c + lost).alias("c"))

    return F.aggregate(values, zero, add, lambda a: a.s + a.c)
