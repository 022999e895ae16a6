"""Scores of class probabilities as Column expressions, and tail probabilities."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Right-closed bins: edges as numpy's linspace gives them.
EDGES = [k * 0.1 for k in range(1, 10)]


def rps_1x2(p: list[Column], y: Column) -> Column:
    """Ranked probability score of ordered classes, divided by classes - 1. The order of
    ``p`` is the order of the classes, and matters."""
    out, seen, real = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for k in range(len(p) - 1):
        seen = seen + p[k]
        real = real + F.when(y == k, 1.0).otherwise(0.0)
        out = out + F.pow(seen - real, F.lit(2.0))
    return out / F.lit(float(len(p) - 1))


def probability_of(p: list[Column], y: Column) -> Column:
    out = F.when(y == 0, p[0])
    for k in range(1, len(p)):
        out = out.when(y == k, p[k])
    return out


def log_loss(p: list[Column], y: Column, eps: float = 1e-15) -> Column:
    """Of one row; probabilities are clipped, not scaled to one again."""
    return -F.log(F.least(F.greatest(probability_of(p, y), F.lit(eps)), F.lit(1 - eps)))


def argmax(p: list[Column]) -> Column:
    """Index of the largest, the first of equal ones."""
    top = F.greatest(*p)
    out = F.when(p[0] == top, 0)
    for k in range(1, len(p)):
        out = out.when(p[k] == top, k)
    return out


def entropy(p: list[Column]) -> Column:
    return -sum((x * F.log(x + F.lit(1e-10)) for x in p[1:]), p[0] * F.log(p[0] + F.lit(1e-10)))


def bin_index(p: Column) -> Column:
    """0..9: how many inner edges the probability exceeds."""
    return sum((F.when(p > F.lit(e), 1).otherwise(0) for e in EDGES[1:]), F.when(p > F.lit(EDGES[0]), 1).otherwise(0))


def _tail(one):
    """An Arrow function of a column; made when called, as workers import this module."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(one)

    return F.pandas_udf(run, "double")


def normal_sf(z: Column | str) -> Column:
    """P(Z > z) of a standard normal."""
    return _tail(lambda x: 0.5 * math.erfc(x / math.sqrt(2.0)))(z)


def chi2_1_sf(x: Column | str) -> Column:
    """P(X > x) of a chi-square with one degree of freedom."""
    return _tail(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2.0)))(x)
