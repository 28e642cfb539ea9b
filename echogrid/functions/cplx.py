"""Complex algebra on pairs of real columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def pair(prefix: str = "") -> Pair:
    """The columns ``{prefix}re`` and ``{prefix}im``."""
    return F.col(f"{prefix}re"), F.col(f"{prefix}im")


def mul(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def conj_mul(a: Pair, b: Pair) -> Pair:
    """a times the conjugate of b."""
    return a[0] * b[0] + a[1] * b[1], a[1] * b[0] - a[0] * b[1]


def add(a: Pair, b: Pair) -> Pair:
    return a[0] + b[0], a[1] + b[1]


def sub(a: Pair, b: Pair) -> Pair:
    return a[0] - b[0], a[1] - b[1]


def scale(a: Pair, k) -> Pair:
    return a[0] * k, a[1] * k


def rotate(a: Pair, angle: Column) -> Pair:
    """a times exp(i angle)."""
    return mul(a, (F.cos(angle), F.sin(angle)))


def power(a: Pair) -> Column:
    return a[0] * a[0] + a[1] * a[1]


def modulus(a: Pair) -> Column:
    return F.hypot(a[0], a[1])


def phase(a: Pair) -> Column:
    return F.atan2(a[1], a[0])


def divide(a: Pair, b: Pair) -> Pair:
    """a over b; null where b is zero."""
    d = F.nullif(power(b), F.lit(0.0))
    re, im = conj_mul(a, b)
    return re / d, im / d


def mean(a: Pair) -> Pair:
    """Aggregate: the complex mean."""
    return F.avg(a[0]), F.avg(a[1])
