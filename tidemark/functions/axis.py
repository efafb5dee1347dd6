"""Axis columns: implicit, explicit and logarithmic axes, ticks and bucket positions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The finest tick exponent and the largest whole number a double holds exactly.
EXACT = 2**53


def implicit_axis(base: Column, index: Column, step) -> Column:
    """base + index * step; stays BIGINT if all are."""
    return base + index * F.lit(step)


def explicit_axis(base: Column, raw: Column, scale) -> Column:
    """base + raw field * scale, without a detour over doubles."""
    return base + raw * F.lit(scale)


def log_axis(base: Column, index: Column, ratio: float) -> Column:
    return base * F.pow(F.lit(float(ratio)), index)


def ticks_to_seconds(ticks: Column, exponent: int) -> Column:
    return ticks * F.lit(10.0**exponent) if exponent >= 0 else ticks / F.lit(10.0**-exponent)


def seconds_to_ticks(seconds: Column, exponent: int) -> Column:
    """Half away from zero."""
    return F.round(seconds * F.lit(10.0**-exponent) if exponent < 0 else seconds / F.lit(10.0**exponent)).cast("long")


def tick_exponent(largest: float, finest: int = -18) -> int:
    """The finest exponent at which the largest magnitude still counts exactly in a double."""
    exponent = finest
    while exponent < 0 and abs(largest) / 10.0**exponent >= EXACT:
        exponent += 1
    return exponent


def utc_micros(timestamp: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), timestamp).cast("timestamp"))


class Buckets:
    """Positions of n equal buckets over [start, end], linear or logarithmic.

    A logarithmic axis needs a positive, non-empty range; otherwise buckets are linear.
    """

    def __init__(self, start: float, end: float, n: int, scale: str = "linear"):
        self.start, self.end, self.n = start, end, max(1, n)
        self.log = scale == "log" and start > 0 and end > start
        if self.log:
            self.low, self.width = math.log10(start), math.log10(end) - math.log10(start)

    def at(self, x: Column) -> Column:
        """The bucket of x; the end belongs to the last one; null below the range."""
        if self.log:
            share = F.when(x > 0, (F.log10(x) - F.lit(self.low)) / F.lit(self.width))
        elif self.end == self.start:
            share = F.lit(0.0)
        else:
            share = (x - F.lit(self.start)).cast("double") / F.lit(float(self.end - self.start))
        return F.when(share >= 0, F.least(F.lit(self.n - 1), F.floor(share * self.n).cast("int")))

    def edge(self, bucket: Column) -> Column:
        share = bucket.cast("double") / F.lit(float(self.n))
        if self.log:
            return F.pow(F.lit(10.0), F.lit(self.low) + share * F.lit(self.width))
        return F.lit(float(self.start)) + share * F.lit(float(self.end - self.start))

    def centre(self, bucket: Column) -> Column:
        return (self.edge(bucket) + self.edge(bucket + 1)) / 2
