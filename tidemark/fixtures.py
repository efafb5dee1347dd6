"""Generated recordings: a large time stream and stepped frequency sweeps, made by expressions over a range, and files of foreign formats."""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Conversion, Field, Schema
from .sources import container

#: States of the pump, records of a state, frame and segment, and how far apart surges are.
STATES = ((0.0, "off"), (1.0, "priming"), (2.0, "running"), (3.0, "flushing"), (4.0, "draining"))
STATE_RECORDS, FRAME_RECORDS, SEGMENT_FRAMES, SURGE_EVERY = 180_000, 50_000, 40, 1_700_000

PUMP = Schema(
    str(uuid.uuid5(uuid.NAMESPACE_OID, "tidemark/pump")), "pump", 88,
    (
        Field("flow", 0, 16, unit="l/min", conversion=Conversion("linear", (0.0, 0.05))), Field("state", 16, 8, conversion=Conversion("value_to_text", (STATES, "?"))),
        Field("pressure", 24, 24, "sint", unit="Pa", conversion=Conversion("linear", (101_325.0, 2.0))), Field("level", 48, 16, unit="mm"),
        Field("dose", 64, 16, unit="ml", guard=(1, 3), conversion=Conversion("linear", (0.0, 0.2))), Field("surge", 80, 1, "bool"),
    ), axis_step=10_000,
)


def pump(spark: SparkSession, n: int) -> DataFrame:
    """Raw values of n records: a saw of flow, a parabola of pressure, a falling level, and a surge now and then."""
    i = F.col("id")
    saw, surge = i % 9_000, i % SURGE_EVERY == SURGE_EVERY // 2
    return spark.range(n).select(
        (i * 10_000).alias("axis"), F.lit(0).cast("long").alias("run_id"), F.when(surge, F.lit(65_000)).otherwise(saw * 5 + i % 7).alias("flow"), (F.floor(i / STATE_RECORDS) % len(STATES)).alias("state"),
        F.floor((saw - 4_500) * (saw - 4_500) / 64).cast("long").alias("pressure"), (F.lit(40_000) - F.floor(i / 300) % 40_000).alias("level"), (i % 4_001).alias("dose"), surge.cast("int").alias("surge"),
    )


def filter_schema(per_octave: int = 12) -> Schema:
    fields = (Field("gain", 0, 32, "float", unit="dB"), Field("phase", 32, 32, "float", unit="rad"))
    return Schema(str(uuid.uuid5(uuid.NAMESPACE_OID, f"tidemark/filter/{per_octave}")), "filter", 64, fields, "frequency", "log", 0, "Hz", 2.0 ** (1 / per_octave), 1.0)


def filter_response(spark: SparkSession, runs: int = 5, points: int = 120, per_octave: int = 12) -> DataFrame:
    """The response of a low pass of first order from 16 Hz on, whose corner doubles from run to run."""
    rows = spark.range(runs * points).select(F.floor(F.col("id") / points).alias("run_id"), (F.col("id") % points).alias("i"))
    r = F.lit(16.0) * F.pow(F.lit(2.0), F.col("i") / per_octave) / (F.lit(100.0) * F.pow(F.lit(2.0), F.col("run_id")))
    return rows.select(F.lit(16.0).alias("axis"), "run_id", "i", (F.lit(-10.0) * F.log10(1 + r * r)).alias("gain"), (-F.atan(r)).alias("phase"))


def write_pump(spark: SparkSession, path: str, n: int) -> None:
    """Each task writes whole frames of a contiguous range of records."""
    container.write_values(pump(spark, n), path, PUMP, frameRecords=FRAME_RECORDS, segmentFrames=SEGMENT_FRAMES)


def write_files(rows: DataFrame, path: str, suffix: str, content: Callable[[pa.Table], bytes]) -> None:
    """A file per task of what content makes of its rows, which it holds whole. Files get their names once the job is done, so that attempts that
    failed leave nothing to read; no rows give no file."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            store, folder = container.open_store(path)
            store.create_dir(folder, recursive=True)
            name = f"part-{uuid.uuid4().hex}{suffix}"
            with store.open_output_stream(f"{folder}/.{name}", compression=None) as out:
                out.write(content(pa.Table.from_batches(held)))
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    store, folder = container.open_store(path)
    for r in rows.mapInArrow(put, "name string").collect():
        store.move(f"{folder}/.{r.name}", f"{folder}/{r.name}")


def packed(table: pa.Table, dtype: np.dtype) -> np.ndarray:
    """The columns as one packed array; absent numbers are NaN in float fields, else 0."""
    out = np.zeros(table.num_rows, dtype)
    for name in dtype.names:
        column = table[name]
        out[name] = column.fill_null(math.nan if dtype[name].kind == "f" else 0).to_numpy()
    return out


def mdf4_bytes(group: str, channels: list[tuple[str, int, int, int, int, int, int | None]], records: bytes, n: int, width: int, invalid: int) -> bytes:
    """An MDF4 file of one sorted group. Channels: name, channel type, what a master counts, data type, byte, bits, invalidation bit or none."""
    blocks: dict[str, tuple[str, list[str], bytes]] = {
        "head": ("HD", ["data group", "", "", "", "", ""], bytes(32)),
        "data group": ("DG", ["", "group", "data", ""], bytes(8)),
        "group": ("CG", ["", "channel 0", "name", "", "", ""], struct.pack("<QQHHIII", 0, n, 0, 0, 0, width, invalid)),
        "name": ("TX", [], group.encode() + b"\0"),
    }
    for i, (name, kind, counts, type_, at, bits, absent) in enumerate(channels):
        following = f"channel {i + 1}" if i + 1 < len(channels) else ""
        info = struct.pack("<BBBBIIIIBBH6d", kind, counts, type_, 0, at, bits, 0 if absent is None else 2, absent or 0, 0, 0, 0, *[0.0] * 6)
        blocks[f"channel {i}"] = ("CN", [following, "", f"name {i}", "", "", "", "", ""], info)
        blocks[f"name {i}"] = ("TX", [], name.encode() + b"\0")
    blocks["data"] = ("DT", [], records)
    places, end = {"": 0}, 64
    for key, (_, links, body) in blocks.items():
        places[key], end = end, end + -(-(24 + 8 * len(links) + len(body)) // 8) * 8
    out = [b"MDF     4.10    tidemark" + bytes(4) + struct.pack("<H", 410) + bytes(34)]
    for kind, links, body in blocks.values():
        size = 24 + 8 * len(links) + len(body)
        out.append(b"##" + kind.encode() + bytes(4) + struct.pack("<QQ", size, len(links)) + struct.pack(f"<{len(links)}q", *(places[x] for x in links)) + body + bytes(-size % 8))
    return b"".join(out)


def write_mdf4(rows: DataFrame, path: str) -> None:
    """rows (t in seconds, event_id, value) as MDF4 files of a group "events"; an absent value has its invalidation bit set."""
    record = np.dtype([("t", "<f8"), ("event_id", "<u8"), ("value", "<f8"), ("absent", "u1")])

    def content(table: pa.Table) -> bytes:
        table = table.append_column("absent", pa.array(table["value"].is_null().to_numpy().astype(np.uint8)))
        channels = [("t", 2, 1, 4, 0, 64, None), ("event_id", 0, 0, 0, 8, 64, None), ("value", 0, 0, 4, 16, 64, 0)]
        return mdf4_bytes("events", channels, packed(table, record).tobytes(), table.num_rows, 24, 1)

    write_files(rows.select("t", "event_id", "value"), path, ".mf4", content)


def write_spice(rows: DataFrame, path: str) -> None:
    """rows (t in seconds, event_id, value) as simulator raw files of a transient analysis; an absent value is no number."""
    record = np.dtype([("t", "<f8"), ("event_id", "<f8"), ("value", "<f8")])

    def content(table: pa.Table) -> bytes:
        head = f"Title: events\nPlotname: Transient Analysis\nFlags: real forward double\nNo. Variables: 3\nNo. Points: {table.num_rows}\nOffset: 0.0\nVariables:\n\t0\ttime\ttime\n\t1\tV(event_id)\tvoltage\n\t2\tI(value)\tdevice_current\nBinary:\n"
        return head.encode() + packed(table, record).tobytes()

    write_files(rows.select("t", F.col("event_id").cast("double"), "value").sortWithinPartitions("t"), path, ".raw", content)
