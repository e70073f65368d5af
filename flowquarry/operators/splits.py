"""Splits with exact counts that do not depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.operators import ranks
from flowquarry.operators.profile import q

SEED = 42


def shuffle_key(key: str, seed: int = SEED) -> Column:
    """A fixed pseudo-random order of rows."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), q(key).cast("string")))


def ranked(df: DataFrame, label: str, key: str, seed: int = SEED) -> DataFrame:
    """Add rank_in_class (from 0) in the shuffled order and n_class; a class may hold nearly all rows."""
    shuffled = shuffle_key(key, seed)
    return ranks.ranked(df, [q(label)], [shuffled, q(key)], "rank_in_class", "n_class")


def quotas(df: DataFrame, label: str, take: Column) -> DataFrame:
    """(label, quota) by largest remainder: shares of `take` (a total over all rows) in proportion to the classes."""
    n = df.groupBy(q(label).alias("label")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    share = n.crossJoin(F.broadcast(total)).withColumn("exact", F.col("n").cast("double") * take / F.col("total"))  # one row per class
    share = share.withColumn("base", F.floor("exact"))
    whole = share.agg((F.max(take) - F.sum("base")).alias("left"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("exact") - F.col("base")), "label")
    more = (F.row_number().over(order) <= F.col("left")).cast("long")
    return share.crossJoin(F.broadcast(whole)).select("label", "n", (F.col("base") + more).cast("long").alias("quota"))


def stratified_split(df: DataFrame, label: str, key: str, fraction: float = 0.2, seed: int = SEED) -> DataFrame:
    """Add split ('train' or 'test') with the exact number of test rows, ceil(fraction * rows), shared out by class."""
    quota = quotas(df, label, F.ceil(F.lit(float(fraction)) * F.col("total"))).select(F.col("label").alias("_label"), "quota")
    out = ranked(df, label, key, seed).join(F.broadcast(quota), q(label) == F.col("_label"))  # one row per class
    return out.withColumn("split", F.when(F.col("rank_in_class") < F.col("quota"), "test").otherwise("train")).select(*[q(c) for c in df.columns], "split")


def stratified_sample(df: DataFrame, label: str, key: str, size: int, seed: int = SEED) -> DataFrame:
    """Exactly min(size, rows) rows, classes in proportion."""
    quota = quotas(df, label, F.least(F.lit(size), F.col("total"))).select(F.col("label").alias("_label"), "quota")
    out = ranked(df, label, key, seed).join(F.broadcast(quota), q(label) == F.col("_label"))
    return out.where(F.col("rank_in_class") < F.col("quota")).select(*[q(c) for c in df.columns])


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """Add fold (0 .. k-1); every class is dealt out evenly."""
    return ranked(df, label, key, seed).withColumn("fold", (F.col("rank_in_class") % k).cast("int")).drop("rank_in_class", "n_class")


def blocks(df: DataFrame, label: str, order: str, size: int, fraction: float = 0.2, file_col: str = "source_file") -> DataFrame:
    """Add block, n_blocks, scenario_group and split: the last blocks of each (file, class) are the test rows.

    A stratum of one block is cut in two at max(1, floor(n * (1 - fraction))).
    """
    if not 0 < fraction < 1 or size < 1:
        raise ValueError("fraction must lie between 0 and 1 and the block size must be positive")
    out = ranks.ranked(df, [q(file_col), q(label)], [q(order)], "_rank", "_n")
    edge = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(1.0 - fraction)))
    whole = F.ceil(F.col("_n") / F.lit(float(size)))
    block = F.when(whole == 1, (F.col("_rank") >= edge).cast("long")).otherwise(F.floor(F.col("_rank") / F.lit(float(size))))
    n_blocks = F.when(whole == 1, F.when(F.col("_n") > 1, 2).otherwise(1)).otherwise(whole)
    out = out.withColumn("block", block.cast("long")).withColumn("n_blocks", n_blocks.cast("long"))
    test = F.greatest(F.lit(1), F.ceil(F.col("n_blocks") * F.lit(float(fraction)))).cast("long")
    out = out.withColumn("n_test_blocks", test).withColumn("split", F.when(F.col("block") >= F.col("n_blocks") - test, "test").otherwise("train"))
    group = F.concat(q(file_col), F.lit("|"), q(label), F.lit("|block-"), F.col("block").cast("string"))
    return out.withColumn("scenario_group", group).drop("_rank", "_n")


def strata(blocked: DataFrame, label: str, file_col: str = "source_file") -> DataFrame:
    keys = [q(file_col).alias(file_col), q(label).alias("label")]
    return blocked.groupBy(*keys).agg(F.count("*").alias("n"), F.max("n_blocks").alias("n_blocks"), F.max("n_test_blocks").alias("n_test_blocks"))


def overlap(split: DataFrame, group: str) -> DataFrame:
    """Groups on both sides of the split (must be none)."""
    return split.where("split = 'train'").select(group).intersect(split.where("split = 'test'").select(group))


def block_guards(blocked: DataFrame, label: str, classes: tuple[str, ...], file_col: str = "source_file", least: int = 2) -> DataFrame:
    """One row of faults of a split by blocks: strata under `least` rows, groups on both sides, (side, class) pairs without a row."""
    small = strata(blocked, label, file_col).agg(F.count_if(F.col("n") < least).alias("small_strata"))
    sides = blocked.groupBy("scenario_group").agg(F.countDistinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared_groups"))
    there = blocked.where(q(label).isin(*classes)).agg((F.lit(2 * len(classes)) - F.countDistinct("split", q(label))).cast("long").alias("missing_sides"))
    return small.crossJoin(F.broadcast(sides)).crossJoin(F.broadcast(there))  # one row each


def check_blocks(blocked: DataFrame, label: str, classes: tuple[str, ...], file_col: str = "source_file") -> None:
    faults = {k: n for k, n in block_guards(blocked, label, classes, file_col).first().asDict().items() if n}
    if faults:
        raise ValueError(f"the split by blocks fails: {faults}")


def missing_classes(df: DataFrame, label: str, classes: tuple[str, ...]) -> DataFrame:
    every = df.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    return every.subtract(df.select(q(label).alias("label")))
