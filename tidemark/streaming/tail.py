"""Tailing recordings that grow: a stream source whose offset is a place in each file.

The offset of a file is the end of its last intact frame and the SYNC of the segment it stands in; the segment's schemas are read again
from there. A torn tail waits for the next trigger. New files of the folder join as they appear.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.container import DATA, SYNC, VIEWS, RecordingReader, Walk, check_header, list_files, open_store


class Tail(InputPartition):
    def __init__(self, file: str, sync: int, start: int, end: int):
        self.file, self.sync, self.start, self.end = file, sync, start, end


class RecordingTail(DataSourceStreamReader):
    def __init__(self, options: dict, schema):
        self.reader = RecordingReader(options, schema)
        self.path, self.seen = options["path"], {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path, size in list_files(self.path):
            end, sync, known = self.seen.get(path, (16, 16, 0))
            if size <= known:
                continue
            store, inner = open_store(path)
            with store.open_input_file(inner) as file:
                if size < 16:
                    continue
                check_header(file.read_at(16, 0), path)
                walk = Walk(file, size, end)
                for at, type_, _, _ in walk.frames():
                    sync = at if type_ == SYNC else sync
            self.seen[path] = (walk.at, sync, size)
        return {p: [end, sync] for p, (end, sync, _) in self.seen.items()}

    def partitions(self, start: dict, end: dict) -> list[Tail]:
        out = []
        for path, (stop, _) in end.items():
            begin, sync = start.get(path, (16, 16))
            if stop > begin:
                out.append(Tail(path, sync, begin, stop))
        return out or [Tail("", 0, 0, 0)]

    def read(self, part: Tail) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        store, inner = open_store(part.file)
        with store.open_input_file(inner) as file:
            walk, rows = Walk(file, part.end, part.sync), []
            for at, type_, stream, payload in walk.frames():
                if at < part.start:
                    continue
                if self.reader.view == "records":
                    if type_ == DATA and (batch := self.reader.records(part.file, walk, at, stream, payload)):
                        yield batch
                    continue
                rows += self.reader.rows(part.file, walk, at, type_, stream, payload)
            if rows:
                yield self.reader.batch(rows)


class RecordingStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording_stream"

    def schema(self) -> str:
        return VIEWS[self.options.get("view", "records")]

    def streamReader(self, schema) -> RecordingTail:
        return RecordingTail({k.lower(): v for k, v in self.options.items()}, schema)


def read_stream(spark: SparkSession, path: str, view: str = "records", **options) -> DataFrame:
    spark.dataSource.register(RecordingStream)
    return spark.readStream.format("recording_stream").option("view", view).options(**options).load(path)


def anchored(records: DataFrame, meta: DataFrame) -> DataFrame:
    """A late clock: the last time.anchor of a file, <monotonic ns>:<unix ns>, dates its records at read time, as unix_ns."""
    pair = F.split("value", ":")
    anchors = meta.where("key = 'time.anchor'").groupBy("file").agg(F.max_by(F.struct(pair[0].cast("long").alias("mono"), pair[1].cast("long").alias("unix")), F.col("frame_offset")).alias("anchor"))
    return records.join(anchors, "file", "left").withColumn("unix_ns", F.col("axis") - F.col("anchor.mono") + F.col("anchor.unix")).drop("anchor")
