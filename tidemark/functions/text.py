"""How cells read: shortest numbers, hexadecimal bytes, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def six_digits(x: Column) -> Column:
    """Six significant digits without trailing zeros, an exponent beyond 1e21 or below 1e-4."""

    @F.pandas_udf("string")
    def shown(values):
        return values.map(lambda v: None if v is None or v != v else f"{v:.6g}")

    return shown(x.cast("double"))


def cell(value: Column, kind: str) -> Column:
    """struct<present, num, text> of a value of a field type."""
    number = value.cast("double") if kind in ("uint", "sint", "float") else value.cast("int").cast("double") if kind == "bool" else F.lit(None).cast("double")
    if kind == "bytes":
        text = F.lower(F.hex(value))
    elif kind == "float":
        text = six_digits(value)
    elif kind == "complex":
        text = F.concat(six_digits(value["re"]), F.when(value["im"] >= 0, F.lit("+")).otherwise(F.lit("")), six_digits(value["im"]), F.lit("i"))
    else:
        text = value.cast("string")
    return F.struct(value.isNotNull().alias("present"), number.alias("num"), text.alias("text"))


def duration(ticks: Column, exponent: int) -> Column:
    """As a day-time interval of microseconds; finer ticks would be lost and are refused."""
    if exponent < -6:
        raise ValueError("ticks finer than microseconds stay ticks")
    return F.make_dt_interval(secs=(ticks * F.lit(10 ** (exponent + 6))).cast("decimal(38,0)") / F.lit(1_000_000).cast("decimal(38,0)"))
