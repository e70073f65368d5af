"""Exact ranks inside groups of any size.

A window over a group sorts the group in one task. Here all rows are dealt out by ranges of (group, order), whose bounds Spark takes from a sample
of the rows, so tasks are even however the order's values lie and however many rows one group has. Rows are numbered in
their range, and the counts of the ranges before are added up per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.plans.shared import new_folder


def ranked(df: DataFrame, group: list[Column], order: list[Column], rank: str, size: str) -> DataFrame:
    """Add rank (from 0, in `order`) and size of each row's group; a null group is a group. The sorted rows are written once."""
    keys, by = [f"_g{i}" for i in range(len(group))], [f"_o{i}" for i in range(len(order))]
    wide = df.withColumns({**dict(zip(keys, group)), **dict(zip(by, order))})
    path = new_folder(df.sparkSession, "ranks")
    # the id's low 33 bits number the rows of a task, the bits above are the task
    wide.repartitionByRange(*keys, *by).sortWithinPartitions(*keys, *by).drop(*by).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_id", 33))
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_m").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_m"), F.min("_id").alias("_first"))
    heads = heads.withColumns({"_shift": before - F.col("_first"), size: F.sum("_m").over(whole)})
    other = [f"_h{i}" for i in range(len(group))]
    heads = heads.select(*[F.col(k).alias(o) for k, o in zip(keys, other)], F.col("_part").alias("_hp"), "_shift", size)
    match = F.col("_part") == F.col("_hp")
    for k, o in zip(keys, other):
        match = match & F.col(k).eqNullSafe(F.col(o))
    out = rows.join(heads, match).withColumn(rank, F.col("_id") + F.col("_shift"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], rank, size)
