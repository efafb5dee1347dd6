"""Foreign recordings as containers: records are canonical already, so only their frames are new.

By default axes stay doubles of the unit they have. With ticks, a time axis becomes whole ticks: the finest exponent down to
nanoseconds at which the longest time still counts exactly in a double, in a 64-bit field behind the record's own ones. Records whose time is
absent or no number stand at tick 0; their time field says so.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import axis as axes
from ..functions import conversions
from ..model import Field, Schema
from . import container, mdf4, spice

#: The finest exponent of ticks, nanoseconds.
FINEST = -9
#: Fixed values of MDF4: what a master channel counts.
MASTER_KINDS = {1: "time", 2: "angle", 3: "distance", 4: "index"}


def with_ticks(rows: DataFrame, schema: Schema, seconds: Column) -> tuple[DataFrame, Schema]:
    """rows (record, ...) and their schema with a time axis of ticks, for the seconds of each record."""
    longest = rows.agg(F.max(F.abs(seconds))).first()[0] or 0.0
    exponent = axes.tick_exponent(longest, FINEST)
    ticks = F.coalesce(axes.seconds_to_ticks(seconds, exponent), F.lit(0).cast("long"))
    at = 8 * schema.record_bytes
    field = Field("axis ticks", at, 64, "sint", True, unit=f"1e{exponent} s")
    identity = str(uuid.uuid5(uuid.NAMESPACE_OID, f"{schema.uuid}:ticks:{exponent}"))
    timed = replace(schema, uuid=identity, record_bits=at + 64, fields=(*schema.fields, field), axis_kind="time", axis_mode="explicit", axis_exp=exponent, axis_unit="s", axis_step=0, axis_scale=1, axis_field=len(schema.fields))
    return rows.withColumn("record", F.concat("record", F.unhex(F.lpad(F.hex(ticks), 16, "0")))), timed


def mdf4_to_container(spark: SparkSession, path: str, out: str, ticks: bool = False) -> list[str]:
    """Every group that has records as a stream of its own, of one file or of all files of a folder; warnings of what was left out or raw.
    With ticks, times become ticks and other masters keep the kind of what they count."""
    spark.dataSource.register(mdf4.Mdf4)
    warnings = []
    for group in mdf4.groups_of(path):
        schema = mdf4.group_schema(group, path)
        rows = spark.read.format("mdf4").option("group", group.name).load(path)
        base = F.lit(0.0) if schema.axis_mode == "explicit" else F.col("rec_idx").cast("double")
        master = next((c for c in group.channels if c.kind == mdf4.MASTER), None)
        if ticks and schema.axis_mode == "explicit":
            if MASTER_KINDS.get(master.sync) == "time":
                rows, schema = with_ticks(rows, schema, container.value_column(schema, schema.axis_field).cast("double"))
                base = F.lit(0).cast("long")
            else:
                schema = replace(schema, axis_kind=MASTER_KINDS.get(master.sync, "other"))
        container.write(rows.repartitionByRange("rec_idx").select(base.alias("axis"), "run_id", "record", "tails", "rec_idx"), out, schema)
        warnings += [f"{group.name}: {w}" for w in group.warnings]
    return warnings


def spice_to_container(spark: SparkSession, path: str, out: str, ticks: bool = False) -> Schema:
    """The axis becomes an explicit 64-bit field, each variable a 64-bit float, two for complex ones. With ticks, so do times."""
    raw = spice.header_of(container.list_files(path)[0][0])
    rows = spice.read(spark, path)
    fields, columns, at = [Field(raw.variables[0][0], 0, 64, "float", unit=spice.UNITS.get(raw.variables[0][1], ""))], [F.col("axis").alias(raw.variables[0][0])], 64
    for name, kind in raw.variables[1:]:
        for part in (("re", "im") if raw.complex else (None,)):
            label = f"{name}.{part}" if part else name
            fields.append(Field(label, at, 64, "float", unit=spice.UNITS.get(kind, "")))
            columns.append((F.col(f"`{name}`").getField(part) if part else F.col(f"`{name}`")).alias(label))
            at += 64
    kind = {"time": "other", "frequency": "frequency"}.get(raw.variables[0][1], "other")
    schema = Schema(str(uuid.uuid5(uuid.NAMESPACE_OID, f"spice:{raw.plot}:{raw.variables}")), raw.analysis, at, tuple(fields), kind, "explicit", 0, fields[0].unit, 1.0, 1.0, 0, (("analysis", raw.analysis),))
    ready = rows.select(F.lit(0.0).alias("base"), F.col("run_no").alias("run_id"), *columns)
    coded = container.encode(_plain(ready), _plain_schema(schema))
    base = F.col("base")
    if ticks and raw.variables[0][1] == "time":
        coded, schema = with_ticks(coded, schema, conversions.finite(F.col("f0")))
        base = F.lit(0).cast("long")
    container.write(coded.select(base.alias("axis"), "run_id", "record", "tails"), out, schema)
    return schema


def _plain(rows: DataFrame) -> DataFrame:
    """Columns f0, f1, … for the encoder, as names may hold dots and brackets."""
    return rows.toDF("base", "run_id", *[f"f{i}" for i in range(len(rows.columns) - 2)])


def _plain_schema(schema: Schema) -> Schema:
    return replace(schema, fields=tuple(replace(f, name=f"f{i}") for i, f in enumerate(schema.fields)))
