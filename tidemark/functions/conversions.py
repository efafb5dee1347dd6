"""From raw to physical values: the seven conversions, and how absent values come about."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Not a number and infinities are absent."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def numeric(x: Column, kind: str) -> Column:
    """As a double; a boolean counts 0 or 1."""
    return (x.cast("int") if kind == "bool" else x).cast("double")


def linear(x: Column, a: float, b: float) -> Column:
    return F.lit(float(a)) + F.lit(float(b)) * x


def rational(x: Column, p: tuple[float, ...]) -> Column:
    """(p1 x² + p2 x + p3) / (p4 x² + p5 x + p6); absent where the divisor is zero."""
    p1, p2, p3, p4, p5, p6 = (F.lit(float(v)) for v in p)
    return F.try_divide(p1 * x * x + p2 * x + p3, p4 * x * x + p5 * x + p6)


def table(x: Column, keys: list[float], values: list[float]) -> Column:
    """The value of the greatest key that isn't above x; the first one below all keys."""
    if not keys:
        return x
    rows = sorted(zip(map(float, keys), map(float, values)))
    out = F.lit(rows[0][1])
    for key, value in rows[1:]:
        out = F.when(x >= F.lit(key), F.lit(value)).otherwise(out)
    return F.when(x.isNotNull(), out)


def table_interpolated(x: Column, keys: list[float], values: list[float]) -> Column:
    """Linear between neighbouring keys, held beyond them; equal keys give the left value."""
    if not keys:
        return x
    rows = sorted(zip(map(float, keys), map(float, values)))
    out = F.lit(rows[0][1])
    for (k0, v0), (k1, v1) in zip(rows, rows[1:]):
        between = F.lit(v0) + (x - F.lit(k0)) * F.lit(v1 - v0) / F.lit(k1 - k0) if k1 > k0 else F.lit(v0)
        out = F.when(x >= F.lit(k0), between).otherwise(out)
    return F.when(x.isNotNull(), F.when(x >= F.lit(rows[-1][0]), F.lit(rows[-1][1])).otherwise(out))


def nearest_table(keys: list[float], values: list[float]) -> tuple[list[float], list[float]]:
    """Keys and values of the floor table that gives the value of the nearest key: limits lie midway."""
    rows = sorted(zip(keys, values))
    return [rows[0][0], *((a[0] + b[0]) / 2 for a, b in zip(rows, rows[1:]))], [v for _, v in rows]


def value_to_text(x: Column, labels: list[tuple[float, str]], default: str) -> Column:
    """The first label of an equal key."""
    out = F.lit(default)
    for key, label in reversed(labels):
        out = F.when(x == F.lit(key), F.lit(label)).otherwise(out)
    return F.when(x.isNotNull(), out)


def range_to_text(x: Column, ranges: list[tuple[float, float, str]], default: str) -> Column:
    """The first label whose range, both ends included, holds x."""
    out = F.lit(default)
    for low, high, label in reversed(ranges):
        out = F.when((x >= F.lit(low)) & (x <= F.lit(high)), F.lit(label)).otherwise(out)
    return F.when(x.isNotNull(), out)


def complex_linear(z: Column, a: float, b: float) -> Column:
    """On struct<re, im>: real coefficients, complex arithmetic."""
    return F.struct((F.lit(float(a)) + F.lit(float(b)) * z["re"]).alias("re"), (F.lit(float(b)) * z["im"]).alias("im"))


def complex_rational(z: Column, p: tuple[float, ...]) -> Column:
    p1, p2, p3, p4, p5, p6 = (F.lit(float(v)) for v in p)
    re, im = z["re"], z["im"]
    square_re, square_im = re * re - im * im, 2 * re * im
    n_re, n_im = p1 * square_re + p2 * re + p3, p1 * square_im + p2 * im
    d_re, d_im = p4 * square_re + p5 * re + p6, p4 * square_im + p5 * im
    norm = d_re * d_re + d_im * d_im
    return F.struct(F.try_divide(n_re * d_re + n_im * d_im, norm).alias("re"), F.try_divide(n_im * d_re - n_re * d_im, norm).alias("im"))
