"""Plane and space geometry as Column expressions: everything stays in generated code, NULL marks a missing joint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def norm(*v: Column) -> Column:
    total = v[0] * v[0]
    for c in v[1:]:
        total = total + c * c
    return F.sqrt(total)


def dot(a: tuple, b: tuple) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        total = total + x * y
    return total


def angle(a: tuple, b: tuple) -> Column:
    """Unsigned angle in degrees; NULL where either vector is shorter than EPS (GEO-02)."""
    na, nb = norm(*a), norm(*b)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb)))
    return F.when((na >= EPS) & (nb >= EPS), F.degrees(F.acos(cos)))


def slope(dx: Column, dy: Column) -> Column:
    """Directed slope in degrees (GEO-03)."""
    return F.degrees(F.atan2(dy, dx))


def mid(a: tuple, b: tuple) -> tuple:
    return tuple((x + y) / 2 for x, y in zip(a, b, strict=True))


def minus(a: tuple, b: tuple) -> tuple:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def _product_error(a: Column, b: float, p: Column) -> Column:
    """What the rounded product p = a * b is short of the exact one (two halves of 26 bits each)."""
    split = 134217729.0
    hi = a * split - (a * split - a)
    b_hi = b * split - (b * split - b)
    lo, b_lo = a - hi, b - b_hi
    return ((hi * b_hi - p) + hi * b_lo + lo * b_hi) + lo * b_lo


def exact_round(c: Column, digits: int) -> Column:
    """GEO-16: the exact binary value rounded to ``digits`` decimals, ties to even, as Python's ``round`` does; Spark's own works on the decimal text.
    NULL, NaN and what is too large to have decimals stay."""
    scale = float(10**digits)
    p = c * F.lit(scale)
    down = F.floor(p).cast("double")
    over = (p - down - 0.5) + _product_error(c, scale, p)
    whole = F.when((over > 0) | ((over == 0) & (down % 2 != 0)), down + 1).otherwise(down)
    return F.when(F.abs(p) < 4503599627370496.0, whole / scale).otherwise(c)


def decimals(c: Column, digits: int) -> Column:
    """The number as text with ``digits`` decimals, rounded exactly; NULL stays."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", exact_round(c, digits)))
