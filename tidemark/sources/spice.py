"""Simulator raw files: a header as text, then points of fixed stride. format("spiceraw") splits by points."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.decimate import detect_runs
from .container import list_files, open_store

#: Units by variable kind, analyses by plot name.
UNITS = {"time": "s", "frequency": "Hz", "voltage": "V", "device_current": "A", "subckt_current": "A", "current": "A"}
ANALYSES = {"Transient Analysis": "tran", "AC Analysis": "ac", "DC transfer characteristic": "dc", "Operating Point": "op", "Noise Spectral Density": "noise"}


class RawError(ValueError):
    """A raw file that isn't read: compressed, fast access, text values or a broken header."""


@dataclass(frozen=True)
class Raw:
    plot: str
    flags: tuple[str, ...]
    n_points: int
    shift: float
    variables: tuple[tuple[str, str], ...]
    start: int

    @property
    def complex(self) -> bool:
        return "complex" in self.flags

    @property
    def analysis(self) -> str:
        return ANALYSES.get(self.plot, self.plot)

    @property
    def dtype(self) -> np.dtype:
        """The axis is always 64-bit, the others 32-bit unless the file says double; complex values have two parts."""
        parts = 2 if self.complex else 1
        sizes = ["<f8", *["<f8" if "double" in self.flags else "<f4"] * (len(self.variables) - 1)]
        return np.dtype([(f"v{i}", s, (parts,)) for i, s in enumerate(sizes)])


def parse_header(head: bytes) -> Raw:
    wide = head[1:2] == b"\0"
    mark = "Binary:\n".encode("utf-16-le" if wide else "latin-1")
    at = head.find(mark)
    if at < 0:
        raise RawError("values as text" if "Values:".encode("utf-16-le" if wide else "latin-1") in head else "no header")
    lines = head[:at].decode("utf-16-le" if wide else "latin-1").splitlines()
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x and not x.startswith("\t"))}
    flags = tuple(fields.get("flags", "").lower().split())
    for bad in ("compressed", "fastaccess"):
        if bad in flags:
            raise RawError(f"{bad} files aren't read")
    n = int(fields["no. variables"])
    rows = [x.split() for x in lines[next(i for i, x in enumerate(lines) if x.lower().startswith("variables")) + 1 :] if x.strip()][:n]
    if len(rows) != n or n < 1:
        raise RawError("variables are missing")
    return Raw(fields.get("plotname", ""), flags, int(fields["no. points"]), float(fields.get("offset", 0) or 0), tuple((r[1], r[2].lower()) for r in rows), at + len(mark))


def header_of(path: str) -> Raw:
    store, inner = open_store(path)
    with store.open_input_file(inner) as file:
        return parse_header(file.read_at(min(file.size(), 1 << 20), 0))


class Points(InputPartition):
    def __init__(self, file: str, first: int, last: int):
        self.file, self.first, self.last = file, first, last


class RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.points = options["path"], int(options.get("splitpoints", 1 << 20))

    def partitions(self) -> list[Points]:
        out = []
        for path, size in list_files(self.path):
            raw = header_of(path)
            n = min(raw.n_points, (size - raw.start) // raw.dtype.itemsize)
            out += [Points(path, at, min(n, at + self.points)) for at in range(0, n, self.points)]
        return out or [Points("", 0, 0)]

    def read(self, part: Points) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        raw = header_of(part.file)
        store, inner = open_store(part.file)
        size, names = raw.dtype.itemsize, [x for x, _ in raw.variables]
        with store.open_input_file(inner) as file:
            for at in range(part.first, part.last, 16_384):
                n = min(16_384, part.last - at)
                data = np.frombuffer(file.read_at(n * size, raw.start + at * size), raw.dtype)
                axis = data["v0"][:, 0]
                axis = (np.abs(axis) if raw.variables[0][1] == "time" else axis) + raw.shift
                re = np.stack([data[f"v{i}"][:, 0].astype(float) for i in range(1, len(names))], axis=1) if len(names) > 1 else np.zeros((n, 0))
                im = np.stack([data[f"v{i}"][:, 1].astype(float) for i in range(1, len(names))], axis=1) if raw.complex and len(names) > 1 else None
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * re.shape[1])
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) if x is not None else pa.nulls(n, pa.list_(pa.float64())) for x in (re, im)]
                yield pa.RecordBatch.from_arrays([pa.array([part.file] * n), pa.array(np.arange(at, at + n)), pa.array(axis), *lists], names=["file", "point", "axis", "re", "im"])


class SpiceRaw(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spiceraw"

    def schema(self) -> str:
        return "file string, point long, axis double, re array<double>, im array<double>"

    def reader(self, schema) -> RawReader:
        return RawReader({k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, point, run_no, axis and a column per variable (a struct of re and im in a complex file). Runs begin where the axis goes back."""
    raw = header_of(list_files(path)[0][0])
    spark.dataSource.register(SpiceRaw)
    points = spark.read.format("spiceraw").options(**options).load(path)
    columns = []
    for i, (name, kind) in enumerate(raw.variables[1:]):
        re, im = F.get("re", F.lit(i)), F.get("im", F.lit(i))
        columns.append((F.struct(re.alias("re"), im.alias("im")) if raw.complex else re).alias(name, metadata={"unit": UNITS.get(kind, "")}))
    return detect_runs(points, ["file"], ["point"]).select("file", "point", "run_no", "axis", *columns)
