"""Profiles of labelled flow tables: each is one aggregation over the table, whatever its width."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.functions.columns import finite, is_infinite, map_label
from flowquarry.operators.quantiles import exact_quantiles
from flowquarry.schema import CLASSES


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def q(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name}`")


def tidy(row: DataFrame, names: list[str], value: str, key: str = "column_name") -> DataFrame:
    """A one-row frame with columns 0, 1, ... as rows (name, value)."""
    pairs = F.array(*[F.struct(F.lit(n).alias(key), F.col(f"_{i}").alias(value)) for i, n in enumerate(names)])
    return row.select(F.explode(pairs).alias("p")).select(f"p.{key}", f"p.{value}")


def _per_column(df: DataFrame, names: list[str], measure, value: str) -> DataFrame:
    if not names:
        return df.sparkSession.createDataFrame([], f"column_name string, {value} long")
    return tidy(df.agg(*[measure(n).alias(f"_{i}") for i, n in enumerate(names)]), names, value)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def column_types(df: DataFrame) -> DataFrame:
    """(column_name, n_values, position, data_type): each column's place, type and values that are not null."""
    n = _per_column(df, df.columns, lambda c: F.count(q(c)), "n_values")
    types = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return n.join(df.sparkSession.createDataFrame(types, "position long, column_name string, data_type string"), "column_name")


def raw_class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows per raw label, null as <missing>, the most frequent first."""
    n = df.groupBy(F.coalesce(q(label), F.lit("<missing>")).alias("raw_label")).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "raw_label")


def _by_raw_label(df: DataFrame, label: str) -> DataFrame:
    """(raw, n, mapped): the rules for labels then run once per distinct label and not once per row."""
    n = df.groupBy(q(label).alias("raw")).agg(F.count("*").alias("n"))
    return n.withColumn("mapped", map_label("raw"))


def excluded_class_distribution(df: DataFrame, label: str) -> DataFrame:
    out = _by_raw_label(df, label).where("mapped is null")
    return out.groupBy(F.coalesce("raw", F.lit("<missing>")).alias("raw_label")).agg(F.sum("n").alias("n"))


def mapped_class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per class; every class has a row, 0 and 0.0 if need be."""
    # one aggregate row, unpivoted: dense without a join
    per = [F.coalesce(F.sum(F.when(F.col("mapped") == c, F.col("n"))), F.lit(0)).cast("long").alias(f"_{i}") for i, c in enumerate(CLASSES)]
    row = _by_raw_label(df, label).agg(*per, F.sum(F.when(F.col("mapped").isNotNull(), F.col("n"))).alias("total"))
    share = lambda i: F.coalesce(F.round(F.try_divide(100.0 * F.col(f"_{i}"), F.col("total")), 4), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"_{i}").alias("n"), share(i).alias("percentage")) for i, c in enumerate(CLASSES)])
    return row.select(F.explode(rows).alias("r")).select("r.*")


def missing_values(df: DataFrame) -> DataFrame:
    """Nulls and NaNs per column."""
    kinds = dict(df.dtypes)
    gone = lambda n: F.count_if(q(n).isNull() | (F.isnan(q(n)) if kinds[n] in ("double", "float") else F.lit(False)))
    return _per_column(df, df.columns, gone, "n_missing")


def infinite_values(df: DataFrame) -> DataFrame:
    return _per_column(df, numeric_columns(df), lambda n: F.count_if(is_infinite(q(n))), "n_infinite")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that equal an earlier row in all columns."""
    each = df.groupBy(*[q(c) for c in df.columns]).agg(F.count("*").alias("_n"))
    return each.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def descriptive_statistics(df: DataFrame, names: list[str] | None = None, approx: bool = False) -> DataFrame:
    """count, mean, std, min, quartiles and max of the finite values of each numeric column.

    Quartiles are exact and interpolated (a few passes), or approximate in the one pass of the others.
    """
    names = names or numeric_columns(df)
    quartiles = [0.25, 0.5, 0.75]

    def measure(n: str) -> Column:
        c = finite(q(n).cast("double"))
        base = [F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")]
        return F.struct(*base, *([F.percentile_approx(c, quartiles, 10_000).alias("q")] if approx else []))

    out = tidy(df.agg(*[measure(n).alias(f"_{i}") for i, n in enumerate(names)]), names, "s")
    if approx:
        at = [F.get("s.q", F.lit(i)) for i in range(3)]
    else:
        exact = exact_quantiles(df, names, quartiles)
        table = F.create_map(*[x for n in names for x in (F.lit(n), F.array(*[F.lit(v).cast("double") for v in exact[n]]))])
        at = [F.get(F.element_at(table, F.col("column_name")), F.lit(i)) for i in range(3)]
    return out.select("column_name", "s.n", "s.mean", "s.std", "s.min", at[0].alias("p25"), at[1].alias("p50"), at[2].alias("p75"), "s.max")


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one value, null counting as one; min and max tell, so no distinct values are kept."""
    kinds = dict(df.dtypes)

    def measure(n: str) -> Column:
        c = q(n)
        same = F.coalesce(F.min(c) == F.max(c), F.lit(True))
        return same & (F.coalesce(F.bool_and(c.isNull()), F.lit(True)) | F.coalesce(F.bool_and(c.isNotNull()), F.lit(True)))

    usable = [n for n in df.columns if not kinds[n].startswith("map")]
    return _per_column(df, usable, measure, "is_constant").where("is_constant").select("column_name")


def low_variance_columns(df: DataFrame, names: list[str] | None = None, threshold: float = 0.01, approx: bool = False) -> DataFrame:
    """Numeric columns whose share of distinct finite values is at most the threshold."""
    names = names or numeric_columns(df)
    if approx:
        measure = lambda n: F.try_divide(F.approx_count_distinct(finite(q(n).cast("double")), 0.01).cast("double"), F.count(finite(q(n).cast("double"))))
        return _per_column(df, names, measure, "ratio").where(F.col("ratio") <= threshold)
    # long form: one shuffle of (column, value) counts, instead of expanding every row once per distinct aggregate
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), finite(q(n).cast("double")).alias("v")) for n in names]))
    values = df.select(pairs.alias("p")).select("p.*").where("v is not null").groupBy("column_name", "v").agg(F.count("*").alias("n"))
    out = values.groupBy("column_name").agg((F.count("*") / F.sum("n")).alias("ratio"))
    return out.where(F.col("ratio") <= threshold)


def correlation(df: DataFrame, names: list[str] | None = None, centre: bool = True) -> DataFrame:
    """Pairwise-complete Pearson correlations of finite values, (column_a, column_b, r) for a <= b; null if undefined.

    Each task adds up the moment matrices of its rows with matrix products and emits one row per pair, so
    the shuffle holds pairs and not rows, and no plan grows with the number of pairs.
    """
    names = names or numeric_columns(df)
    width = len(names)
    data = df.select(*[finite(q(n).cast("double")).alias(f"_{i}") for i, n in enumerate(names)])
    if centre:
        means = data.agg(*[F.avg(f"_{i}").alias(f"_{i}") for i in range(width)]).first()
        shift = np.array([m or 0.0 for m in means])
    else:
        shift = np.zeros(width)
    a, b = np.triu_indices(width)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, width, width))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - shift
            here = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total += [here.T @ here, x.T @ here, here.T @ x, (x * x).T @ here, here.T @ (x * x), x.T @ x]
        yield pa.record_batch([pa.array(a), pa.array(b), *(pa.array(t[a, b]) for t in total)], names=["a", "b", "n", "sa", "sb", "saa", "sbb", "sab"])

    parts = data.mapInArrow(moments, "a long, b long, n double, sa double, sb double, saa double, sbb double, sab double")
    s = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    cov = F.col("sab") - F.try_divide(F.col("sa") * F.col("sb"), F.col("n"))
    va, vb = F.col("saa") - F.try_divide(F.col("sa") * F.col("sa"), F.col("n")), F.col("sbb") - F.try_divide(F.col("sb") * F.col("sb"), F.col("n"))
    tiny = 1e-12
    r = F.when((va > tiny * F.col("saa")) & (vb > tiny * F.col("sbb")), F.try_divide(cov, F.sqrt(va * vb)))
    label = F.array(*[F.lit(n) for n in names])
    return s.select(F.get(label, F.col("a")).alias("column_a"), F.get(label, F.col("b")).alias("column_b"), r.alias("r"))


def imbalance(df: DataFrame, label: str, limit: float = 3.0) -> DataFrame:
    """Largest class over smallest class, and whether that is `limit` or more; null ratio if a class is empty."""
    n = mapped_class_distribution(df, label)
    return n.agg(F.round(F.try_divide(F.max("n").cast("double"), F.min("n")), 6).alias("ratio")).withColumn("imbalanced", F.coalesce(F.col("ratio") >= limit, F.lit(True)))


def leakage_columns(df: DataFrame, reasons: dict[str, str]) -> DataFrame:
    rows = [(i, c, reasons[c]) for i, c in enumerate(df.columns) if c in reasons]
    return df.sparkSession.createDataFrame(rows, "position long, column_name string, reason string")


def profile_warnings(df: DataFrame, label: str) -> DataFrame:
    """One row per warning: imbalance, constant columns, the twin header-length column."""
    uneven = imbalance(df, label).where("imbalanced").select(F.lit("class_imbalance").alias("kind"), F.lit(None).cast("string").alias("column_name"))
    fixed = constant_columns(df).select(F.lit("constant_column").alias("kind"), "column_name")
    twin = [c for c in df.columns if c in ("fwd_header_length.1", "fwd_header_length_1")]
    doubled = df.sparkSession.createDataFrame([("twin_column", c) for c in twin], "kind string, column_name string")
    return uneven.union(fixed).union(doubled)


def profile_consistency(df: DataFrame, claimed: dict[str, object], label: str, file_col: str) -> DataFrame:
    """One row per way in which the table differs from an earlier profile (rows, label_column, source_files)."""
    found = df.agg(F.count("*").cast("string").alias("rows"), F.array_join(F.array_sort(F.collect_set(file_col)), ",").alias("source_files"))
    checks = [("rows", F.col("rows"), str(claimed["rows"])), ("label_column", F.lit(label), str(claimed["label_column"])), ("source_files", F.col("source_files"), ",".join(sorted(claimed["source_files"])))]
    rows = F.array(*[F.struct(F.lit(k).alias("field"), F.lit(c).alias("claimed"), v.alias("found")) for k, v, c in checks])
    return found.select(F.explode(rows).alias("r")).select("r.*").where(~F.col("claimed").eqNullSafe(F.col("found")))
