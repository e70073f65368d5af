"""CSV segments as a streaming source that goes by their names and numbers their rows."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

ROWS = 10_000


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class Segment(InputPartition):
    def __init__(self, name: str, number: int):
        self.name, self.number = name, number


class SegmentReader(DataSourceStreamReader):
    """Offsets are names: a batch takes the segments whose names follow the last one taken, in the order of names.

    A segment that appears later under an earlier name is not taken any more, as it would come out of order.
    """

    def __init__(self, options: dict):
        self.folder, self.prefix, self.columns = options["path"], options.get("prefix", "segment-"), json.loads(options["columns"])

    def names(self) -> list[str]:
        system, folder = _opened(self.folder)
        found = system.get_file_info(fs.FileSelector(folder))
        return sorted(f.base_name for f in found if f.is_file and f.base_name.startswith(self.prefix) and f.base_name.endswith(".csv"))

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max(self.names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return [Segment(name, i) for i, name in enumerate(self.names()) if start["last"] < name <= end["last"]]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        system, folder = _opened(self.folder)
        with system.open_input_stream(f"{folder.rstrip('/')}/{partition.name}") as raw:
            rows = csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", newline=""))
            if next(rows, None) != self.columns:
                raise ValueError(f"the header of {partition.name} is missing or differs")
            held, first = [], 0
            for row in rows:
                if row:
                    if len(row) != len(self.columns):
                        raise ValueError(f"row {first + len(held)} of {partition.name} has {len(row)} fields")
                    held.append(row)
                if len(held) == ROWS:
                    yield self._batch(held, first, partition)
                    held, first = [], first + len(held)
            if held:
                yield self._batch(held, first, partition)

    def _batch(self, rows: list[list[str]], first: int, partition: Segment) -> pa.RecordBatch:
        n = len(rows)
        at = range(first, first + n)
        values = [pa.array([x or None for x in column], pa.string()) for column in zip(*rows)]
        own = [pa.array([partition.name] * n), pa.array(at, pa.int64()), pa.array([partition.number << 32 | i for i in at], pa.int64())]
        return pa.record_batch([*values, *own], names=[*self.columns, "segment", "segment_row", "seq"])


class SegmentSource(DataSource):
    """Options: path, columns (a JSON list, which the headers must equal) and prefix."""

    @classmethod
    def name(cls) -> str:
        return "flow_segments"

    def schema(self) -> T.StructType:
        out = T.StructType([T.StructField(c, T.StringType()) for c in json.loads(self.options["columns"])])
        return out.add("segment", "string").add("segment_row", "long").add("seq", "long")

    def streamReader(self, schema: T.StructType) -> SegmentReader:
        return SegmentReader(self.options)


def by_name(spark: SparkSession, folder: str, columns: list[str], session: str) -> DataFrame:
    """CSV segments of a folder as a stream of texts, with segment, segment_row (the row's number in its file, from 0), seq and capture_session_id.

    seq rises with segment name and row, whatever the files' times. A segment is read by one task, row by row, so it should be of
    bounded size, as a capture's segments are. Columns of one name can't be told apart and are an error.
    """
    if len(set(columns)) < len(columns):
        raise ValueError("columns of one name")
    spark.dataSource.register(SegmentSource)
    stream = spark.readStream.format("flow_segments").option("columns", json.dumps(columns)).load(folder)
    return stream.withColumn("capture_session_id", F.lit(session))
