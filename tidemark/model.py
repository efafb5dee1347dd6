"""Streams as the driver sees them: schemas, fields and conversions, and the columns they become."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import types as T

from .functions import conversions

#: Fixed values of the format, by number.
TYPES = ("uint", "sint", "float", "bool", "bytes", "string", "complex")
AXIS_KINDS = ("time", "frequency", "angle", "distance", "index", "other")
AXIS_MODES = ("implicit", "explicit", "log")
CONVERSIONS = ("identity", "linear", "rational", "table", "table_interp", "value_to_text", "range_to_text")


class SchemaError(ValueError):
    """A schema that no reader may accept."""


@dataclass(frozen=True)
class Conversion:
    """kind and its parameters: linear (a, b); rational (p1 … p6); tables (keys, values); texts (rows, default)."""

    kind: str = "identity"
    params: tuple = ()

    def column(self, x: Column) -> Column:
        make = {"linear": conversions.linear, "table": conversions.table, "table_interp": conversions.table_interpolated, "value_to_text": conversions.value_to_text, "range_to_text": conversions.range_to_text}
        if self.kind == "identity":
            return x
        if self.kind == "rational":
            return conversions.rational(x, self.params)
        return make[self.kind](x, *self.params)


@dataclass(frozen=True)
class Field:
    name: str
    offset: int
    width: int
    type: str = "uint"
    big_endian: bool = False
    variable: bool = False
    guard: tuple[int, int] | None = None
    conversion: Conversion = Conversion()
    unit: str = ""
    desc: str = ""
    meta: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Schema:
    uuid: str
    name: str
    record_bits: int
    fields: tuple[Field, ...]
    axis_kind: str = "time"
    axis_mode: str = "implicit"
    axis_exp: int = -9
    axis_unit: str = "s"
    axis_step: Any = 1
    axis_scale: Any = 1
    axis_field: int = 0
    meta: tuple[tuple[str, str], ...] = field(default=())

    @property
    def record_bytes(self) -> int:
        return -(-self.record_bits // 8)

    @property
    def timed(self) -> bool:
        return self.axis_kind == "time"

    def validate(self) -> Schema:
        """Raises SchemaError for what no reader may accept."""
        if self.axis_mode not in AXIS_MODES or self.axis_kind not in AXIS_KINDS:
            raise SchemaError(f"{self.name}: unknown axis")
        if self.axis_mode == "log" and (self.timed or not (0 < self.axis_step < math.inf) or self.axis_step == 1):
            raise SchemaError(f"{self.name}: a logarithmic axis needs a positive ratio other than 1 and can't be time")
        if self.axis_mode == "explicit" and not self.axis_field < len(self.fields):
            raise SchemaError(f"{self.name}: the axis field doesn't exist")
        for i, f in enumerate(self.fields):
            blob = f.type in ("bytes", "string")
            widths = {"float": (16, 32, 64), "complex": (64, 128)}.get(f.type)
            if f.variable and (not blob or f.width):
                raise SchemaError(f"{f.name}: only bytes and strings without a width can be variable")
            if not f.variable and blob and (f.offset % 8 or f.width % 8):
                raise SchemaError(f"{f.name}: bytes must be aligned")
            if not f.variable and not blob and (f.width not in widths if widths else not 1 <= f.width <= 64):
                raise SchemaError(f"{f.name}: {f.width} bits")
            if not f.variable and f.offset + f.width > self.record_bits:
                raise SchemaError(f"{f.name}: beyond the record")
            if f.conversion.kind != "identity" and (blob or f.type == "complex" and f.conversion.kind not in ("linear", "rational")):
                raise SchemaError(f"{f.name}: {f.conversion.kind} doesn't apply to {f.type}")
            if f.guard:
                g = self.fields[f.guard[0]] if f.guard[0] < len(self.fields) else None
                if g is None or g is f or f.guard[0] == i or g.type not in ("uint", "sint", "bool") or g.variable or g.guard:
                    raise SchemaError(f"{f.name}: bad guard")
        return self


def field_type(f: Field) -> T.DataType:
    if f.conversion.kind in ("value_to_text", "range_to_text"):
        return T.StringType()
    if f.type == "complex":
        return T.StructType().add("re", "double").add("im", "double")
    if f.conversion.kind != "identity":
        return T.DoubleType()
    return {"float": T.DoubleType(), "bool": T.BooleanType(), "bytes": T.BinaryType(), "string": T.StringType()}.get(f.type) or (T.DecimalType(20, 0) if f.type == "uint" and f.width == 64 else T.LongType())
