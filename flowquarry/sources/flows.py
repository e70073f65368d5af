"""Flow CSV scans with provenance, header checks and row order; manifests; sinks."""

from __future__ import annotations

import csv
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.functions.columns import finite, normalize_name, normalize_python, number_error


def files_of(spark: SparkSession, paths: list[str]) -> list[tuple[int, str]]:
    """(position of the path, file) of all files under the paths, in the paths' order and then by name; nothing is read."""
    return [(i, f) for i, p in enumerate(paths) for f in sorted(spark.read.text(p).inputFiles())]


def headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, pos, name) of the first line of each file, by its full path; a byte order mark is dropped and quoted names are read as such.

    Only the first partition of a file is opened, up to its first line; the driver holds one line a file.
    """

    def first_line(file: str) -> tuple[str, list[str]]:
        line = spark.read.text(unquote(file)).limit(1).collect()  # Spark names files as URLs
        return file, next(csv.reader([line[0][0].removeprefix("\ufeff")]), []) if line else []

    with ThreadPool(8) as pool:
        found = pool.map(first_line, [f for _, f in files_of(spark, paths)])
    rows = [(f, i, n) for f, names in found for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "file string, pos int, name string")


def header_check(named: DataFrame) -> DataFrame:
    """One row: files, distinct normalised ordered headers, and whether there is just one."""
    one = named.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", normalize_name("name").alias("n")))).alias("h"))
    return one.agg(F.count("*").alias("n_files"), F.countDistinct(F.col("h")["n"]).alias("n_headers")).withColumn("equal", F.col("n_headers") <= 1)


def _mangled(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}.{k}" if k else n)
    return out


def text_columns(raw: DataFrame, names: list[str]) -> set[str]:
    """Columns that hold a text which is neither blank nor a number, anywhere in the files. `1d` and `2f` are texts; `nan` and `inf` are numbers."""
    row = raw.agg(*[F.max(number_error(F.col(f"`{c}`"))).alias(f"_{i}") for i, c in enumerate(names)]).first()
    return {c for i, c in enumerate(names) if row[i]}


def numbered(rows: DataFrame) -> DataFrame:
    """rows of a file scan (file_path, block_start, and _id from monotonically_increasing_id) with row_seq, the row's number in its file from 0.

    A block is read in one stretch, so a row's number in its block is a difference of ids. Rows are counted per block, and the blocks before are
    added up: the number is the same however the files are cut. The scan is read twice.
    """
    blocks = rows.groupBy(F.col("file_path").alias("_f"), F.col("block_start").alias("_b")).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_f", "_b", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    met = rows.join(blocks, (F.col("file_path") == F.col("_f")) & (F.col("block_start") == F.col("_b")))
    return met.withColumn("row_seq", F.col("_id") + F.col("_shift")).drop("_f", "_b", "_shift", "_id")


def scan_csv(spark: SparkSession, paths: list[str], numeric: bool = True, text: set[str] | None = None) -> DataFrame:
    """Flow CSVs as one table with source_file and the row order (file_pos, file_path, row_seq), which no cut of the files changes.

    Headers are compared after normalisation and must agree, in order. With `numeric`, columns of numbers become
    doubles and all others stay text; which these are is found in a pass over all files, unless `text` names them. In a column
    that `text` does not name, what is no number is null.
    """
    if not paths:
        raise ValueError("at least one file is needed")
    named = headers(spark, paths)
    if not header_check(named).first()["equal"]:
        raise ValueError("the files' headers differ")
    one = named.groupBy("pos").agg(F.min_by("name", "file").alias("name"))
    names = [r["name"] for r in one.orderBy("pos").collect()]  # one header
    columns = [normalize_python(n) for n in _mangled([n.strip() for n in names])]
    if len(set(columns)) < len(columns):
        raise ValueError("columns collide after normalisation")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(paths)
    if numeric and text is None:
        text = text_columns(raw, columns)
    meta = raw.metadataColumn("_metadata")
    number = lambda c: F.when(~number_error(c), F.trim(c).try_cast("double"))
    typed = [F.col(f"`{c}`") if not numeric or c in text else number(F.col(f"`{c}`")).alias(c) for c in columns]
    rows = raw.select(*typed, meta["file_name"].alias("source_file"), meta["file_path"].alias("file_path"), meta["file_block_start"].alias("block_start"), F.monotonically_increasing_id().alias("_id"))
    # the two ways of naming a local file differ in the slashes after its scheme
    order = spark.createDataFrame([(re.sub("^file:/+", "file:/", f), i) for i, f in files_of(spark, paths)], "_file string, file_pos int")
    return numbered(rows).join(order, F.regexp_replace("file_path", "^file:/+", "file:/") == F.col("_file"), "left").drop("_file")


def ingest(spark: SparkSession, paths: list[str], folder: str, **options) -> DataFrame:
    """scan_csv, written once, so that later scans need no pass for kinds and numbers."""
    scan_csv(spark, paths, **options).write.parquet(folder)
    return spark.read.parquet(folder)


#: Files up to this size are hashed as one row by Spark's reader, which holds a row several times over; larger ones piece by piece.
ROW_BYTES, PIECE = 16 << 20, 8 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(quote(path, safe=":/"))  # the reader's paths are no URLs


def _readable(path: str) -> bool:
    try:
        system, place = _opened(path)
        return system.get_file_info(place).type == fs.FileType.File
    except (OSError, ValueError):  # no such file system, or none that can be reached
        return False


def _streamed(spark: SparkSession, path: str) -> str:
    """The file's SHA-256, by the driver's JVM: any store that Spark reads, a buffer at a time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(conf).open(place)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def _resolved(spark: SparkSession, path: str) -> str:
    """Where a path of a file system that only names others (viewfs, links) leads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(conf).resolvePath(place).toString()


def _hashed_in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, file, size) rows to (file, size, sha256): a file is read through its file system, a piece at a time."""
    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            system, place = _opened(path)
            digest = hashlib.sha256()
            with system.open_input_stream(place) as stream:
                while piece := stream.read(PIECE):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield pa.record_batch([batch.column(1), batch.column(2), pa.array(found, pa.string())], names=["file", "size", "sha256"])


def _hashed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all lines in their order, of which one batch is held at a time."""
    digest, n, size = hashlib.sha256(), 0, 0
    for batch in batches:
        for row in batch.to_pylist():
            digest.update(f"{row['file']}\0{row['size']}\0{row['sha256']}\n".encode())
            n, size = n + 1, size + row["size"]
    yield pa.record_batch([pa.array([n], pa.int64()), pa.array([size], pa.int64()), pa.array([digest.hexdigest()])], names=["n_files", "bytes", "sha256"])


def _elsewhere(spark: SparkSession, large: DataFrame) -> tuple[DataFrame, list[tuple[str, int, str]]]:
    """(large with the places that its paths lead to, a file a task; lines of the files whose place pyarrow can't open either). The driver holds a path a file."""
    rows = [(_resolved(spark, r["path"]), *r) for r in large.collect()]
    known = [_readable(place) for place, *_ in rows]
    with ThreadPool(8) as pool:
        rest = pool.map(lambda r: (r[2], r[3], _streamed(spark, r[1])), [r for r, ok in zip(rows, known) if not ok])
    there = [(place, file, size) for (place, _, file, size), ok in zip(rows, known) if ok]
    return spark.createDataFrame(there, "path string, file string, size long").repartition(max(1, len(there))), rest


def manifest(spark: SparkSession, path: str, pattern: str = "*", row_bytes: int = ROW_BYTES) -> tuple[DataFrame, DataFrame]:
    """((path under the folder, size, sha256) per file, (n_files, bytes, sha256) over the lines `file\\0size\\0sha256\\n` in the order of files).

    Contents are hashed on executors. A file of more than `row_bytes` is read in pieces through pyarrow's file systems (local, s3, gs, hdfs, abfs), by the
    place that its own file system resolves it to if its name can't be opened; so it may have any size. Large files of a store that pyarrow doesn't
    know are streamed through the driver's JVM, some at a time. Empty files are passed over, as Spark's listing does.
    A hash of all lines is a chain: one task takes them in order, a batch at a time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    folder = path.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    own = F.col("path").substr(F.locate(folder, "path") + len(folder), F.length("path"))
    small = files.where(F.col("length") <= row_bytes).select(own.alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large, line = files.where(F.col("length") > row_bytes).select("path", own.alias("file"), F.col("length").alias("size")), "file string, size long, sha256 string"
    one = large.first()
    if one and not _readable(one["path"]):
        large, rest = _elsewhere(spark, large)
        small = small.union(spark.createDataFrame(rest, line))
    each = small.union(large.mapInArrow(_hashed_in_pieces, line))
    whole = each.repartition(1).sortWithinPartitions("file").mapInArrow(_hashed_lines, "n_files long, bytes long, sha256 string")
    none = {"n_files": F.lit(0), "bytes": F.lit(0), "sha256": F.lit(hashlib.sha256(b"").hexdigest())}  # an empty plan may run no task
    return each, whole.agg(*[F.coalesce(F.max(c), v).alias(c) for c, v in none.items()])


def leakage_config(spark: SparkSession, path: str) -> dict[str, str]:
    """column -> reason of a JSON file {"columns": {...}}, names normalised."""
    text = spark.read.option("wholetext", True).text(path).first()["value"]
    found = json.loads(text).get("columns")
    if not isinstance(found, dict) or not all(isinstance(v, str) for v in found.values()):
        raise ValueError("the config needs an object 'columns' of texts")
    return {normalize_python(k): v for k, v in found.items()}


PROFILE_FIELDS = ("source_files", "label_column", "rows", "mapped_class_distribution")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.json(path)
    missing = [c for c in PROFILE_FIELDS if c not in df.columns]
    if missing:
        raise ValueError(f"the profile lacks {missing}")
    return df


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines; numbers that JSON has no word for (NaN, infinities) are null."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    df = df.select(*[finite(F.col(f"`{c}`")).alias(c) if isinstance(t, (T.DoubleType, T.FloatType)) else F.col(f"`{c}`") for c, t in fields.items()])
    df.write.mode("overwrite").json(path)


def write_sorted_csv(df: DataFrame, path: str, by: str) -> None:
    df.orderBy(F.desc(by)).write.mode("overwrite").option("header", True).csv(path)


def write_scored(scored: DataFrame, path: str, batch_id: int) -> None:
    """One wide batch, whole or not at all: its partition is replaced, so a repeated batch changes nothing."""
    out = scored.withColumn("batch_id", F.lit(batch_id))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def write_segment(df: DataFrame, folder: str, name: str, by: str) -> None:
    """df as one CSV file with a header, in the order of `by`: a segment, whose size a capture bounds. It is written aside and moved into place whole."""
    spark, aside = df.sparkSession, f"{folder.rstrip('/')}-{uuid.uuid4().hex}"
    df.coalesce(1).sortWithinPartitions(by).write.option("header", True).csv(aside)
    made = spark.read.text(aside).inputFiles()[0]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(conf)
    system.mkdirs(place)
    if not system.rename(jvm.org.apache.hadoop.fs.Path(unquote(made)), jvm.org.apache.hadoop.fs.Path(folder, name)):
        raise OSError(f"{name} can't be moved to {folder}")


def write_snapshot(df: DataFrame, path: str) -> int:
    """df as the next version of a small table that is replaced whole, such as the registry of models; its number.

    The rows are written first and the version's record last. A record is never overwritten: of two writers of one version one fails.
    """
    spark, folder = df.sparkSession, f"rows-{uuid.uuid4().hex}"
    last = _versions(spark, path)
    number = last[0] + 1 if last else 1
    df.write.parquet(f"{path}/{folder}")
    spark.createDataFrame([(number, folder, df.schema.json())], "number long, folder string, columns string").coalesce(1).write.mode("error").parquet(f"{path}/versions/{number:09d}")
    return number


def _versions(spark: SparkSession, path: str) -> tuple[int, str, str] | None:
    """The last version's number, folder and columns."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path, "versions")
    if not place.getFileSystem(conf).exists(place):
        return None
    found = spark.read.schema("number long, folder string, columns string").parquet(f"{path}/versions/*").orderBy(F.desc("number")).first()
    return tuple(found) if found else None


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last version."""
    last = _versions(spark, path)
    if not last:
        raise ValueError(f"no version of {path}")
    return spark.read.schema(T.StructType.fromJson(json.loads(last[2]))).parquet(f"{path}/{last[1]}")
