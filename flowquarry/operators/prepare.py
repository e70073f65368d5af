"""Cleaning of labelled flow tables: scope, order-keeping dedup, feature projection, guards, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.functions.columns import finite, is_infinite, map_label, normalize_python
from flowquarry.operators.profile import numeric_columns, q, tidy
from flowquarry.schema import CLASSES


def normalize_columns(df: DataFrame) -> DataFrame:
    """Normalised column names; two columns of one name are an error."""
    names = [normalize_python(c) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns collide after normalisation: {twice}")
    return df.toDF(*names)


def in_scope(df: DataFrame, label: str) -> DataFrame:
    """Rows whose label maps to a class, the class in place of the label."""
    return df.withColumn(label, map_label(q(label))).where(q(label).isNotNull())


def dedup_keep_first(df: DataFrame, order: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """The first row, in `order`, of rows that are equal in all columns but `order` and `ignore`.

    An aggregation over whole keys: tasks combine their own copies first, so a row with any number of
    copies sends one per task.
    """
    key = [c for c in df.columns if c not in order and c not in ignore]
    rest = [*order, *[c for c in df.columns if c in ignore]]
    first = df.groupBy(*[q(c) for c in key]).agg(F.min(F.struct(*[q(c).alias(f"_{i}") for i, c in enumerate(rest)])).alias("_first"))
    at = {c: F.col(f"_first._{i}") for i, c in enumerate(rest)}
    return first.select(*[(at[c] if c in at else q(c)).alias(c) for c in df.columns])


def leakage_split(df: DataFrame, leakage: dict[str, str], extra: tuple[str, ...] = ("source_file",)) -> tuple[list[str], list[str]]:
    """(metadata columns, candidate columns), in column order."""
    meta = [c for c in df.columns if c in leakage or c in extra]
    return meta, [c for c in df.columns if c not in meta]


def feature_names(df: DataFrame, leakage: dict[str, str], label: str) -> list[str]:
    _, candidates = leakage_split(df, leakage)
    numeric = set(numeric_columns(df))
    out = [c for c in candidates if c in numeric and c != label]
    if not out:
        raise ValueError("no numeric feature remains")
    return out


def dropped_columns(df: DataFrame, leakage: dict[str, str], label: str) -> DataFrame:
    """(column_name, reason) of the columns that become no features."""
    numeric = set(numeric_columns(df))
    rows = []
    for c in df.columns:
        if c in leakage or c == "source_file":
            rows.append((c, leakage.get(c, "source-file provenance")))
        elif c not in numeric and c != label:
            rows.append((c, "non-numeric"))
    return df.sparkSession.createDataFrame(rows, "column_name string, reason string")


def finite_features(df: DataFrame, features: list[str], narrow: bool = True) -> DataFrame:
    """Features with null for NaN and infinities, narrowed to float; the other columns stay."""
    new = {c: finite(q(c).cast("double")) for c in features}
    return df.select(*[(new[c].cast("float") if narrow else new[c]).alias(c) if c in new else q(c) for c in df.columns])


def guards(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """One row of checks that a preparation must pass."""
    mapped = map_label(q(label))
    full = [F.count(finite(q(c).cast("double"))) > 0 for c in features]
    has = F.lit(True)
    for f in full:
        has = has & f
    counts = [F.count_if(mapped == c) for c in CLASSES]
    every, two = F.lit(True), F.lit(True)
    for n in counts:
        every, two = every & (n > 0), two & (n >= 2)
    return df.agg(
        F.lit(label in df.columns).alias("label_present"),
        every.alias("all_classes"),
        two.alias("two_rows_per_class"),
        F.lit(len(features) > 0).alias("numeric_features"),
        has.alias("no_empty_feature"),
    )


def check_guards(df: DataFrame, label: str, features: list[str], fraction: float) -> None:
    if not 0 < fraction < 1:
        raise ValueError("the test fraction must lie between 0 and 1")
    row = guards(df, label, features).first()
    failed = [k for k, ok in row.asDict().items() if not ok]
    if failed:
        raise ValueError(f"preparation fails: {failed}")


def audit(raw: DataFrame, label: str, order: list[str], ignore: tuple[str, ...], split: DataFrame) -> DataFrame:
    """(stage, label, n): raw rows, rows in scope, rows after dedup, rows of each split."""
    kept = in_scope(raw, label)
    single = dedup_keep_first(kept, order, ignore)
    stages = [("scope", kept), ("dedup", single)]
    out = raw.groupBy().agg(F.count("*").alias("n")).select(F.lit("raw").alias("stage"), F.lit("all").alias("label"), "n")
    for name, df in stages:
        out = out.union(df.groupBy(q(label).alias("label")).agg(F.count("*").alias("n")).select(F.lit(name), "label", "n"))
    return out.union(split.groupBy("split", q(label).alias("label")).agg(F.count("*").alias("n")).select("split", "label", "n"))


def infinities(df: DataFrame, features: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(is_infinite(q(c))).alias(c) for c in features])


def column_audit(df: DataFrame, leakage: dict[str, str], label: str) -> DataFrame:
    """(column_name, outcome, infinities): why a column becomes no feature, or 'feature' with the infinities that become null."""
    features = feature_names(df, leakage, label)
    removed = dropped_columns(df, leakage, label).select("column_name", F.col("reason").alias("outcome"), F.lit(None).cast("long").alias("infinities"))
    kept = infinities(df, features).toDF(*[f"_{i}" for i in range(len(features))])
    return tidy(kept, features, "infinities").select("column_name", F.lit("feature").alias("outcome"), "infinities").union(removed)


def feature_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])
