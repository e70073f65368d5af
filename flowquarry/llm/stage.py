"""Written intermediate tables, which cut the lineage and outlive lost executors, and places that name rows in every scan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a local session gets a temporary one; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="flowquarry-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def settled(df: DataFrame) -> DataFrame:
    """df, written as Parquet into the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `settled` gave, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        base = f"{shared_dir(spark).rstrip('/')}/table-"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if base.split(":", 1)[-1].lstrip("/") in folder:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def file_place(table: DataFrame) -> tuple[Column, int]:
    """A long that is another one for each row of a table read straight from Parquet files (no join or explode above it), and the files' bytes.

    It is a hash of the file's path plus the row's number in the file, so it is the same in every scan, however the
    files are cut into tasks then. That no two files' numbers overlap is checked on the files' row counts; another seed
    is taken if they do.
    """
    meta = table.metadataColumn("_metadata")
    files = table.select(meta["file_path"].alias("f"), meta["row_index"].alias("i"), meta["file_size"].alias("s")).groupBy("f").agg(F.max("i").alias("last"), F.max("s").alias("size"))
    whole = files.agg(F.max("last").alias("last"), F.sum("size").alias("size")).first()
    width = (whole["last"] or 0).bit_length()
    for seed in range(64):
        start = F.xxhash64("f", F.lit(seed))
        # files whose numbers overlap share a cell; the highest cell is left out, so that no number runs over
        cells = files.select(F.explode(F.array_distinct(F.array(F.shiftright(start, width), F.shiftright(start, width) + 1))).alias("cell"))
        worst = cells.groupBy("cell").count().agg(F.max("count").alias("n"), F.max("cell").alias("top")).first()
        if (worst["n"] or 0) <= 1 and (worst["top"] or 0) < 1 << (63 - width):
            return F.xxhash64(meta["file_path"], F.lit(seed)) + meta["row_index"], whole["size"] or 0
    raise ValueError("the files' rows can't be numbered")
