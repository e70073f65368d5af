"""Audits over columns, captures, headers and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.columns import finite, map_label, normalize_name
from flowquarry.operators.profile import q
from flowquarry.schema import CLASSES, FEATURE_ALIASES, METADATA_ALIASES, POLICIES, REPRODUCED, REPRODUCTION


def source_distribution(df: DataFrame, label: str, file_col: str = "source_file") -> DataFrame:
    """Rows and rows per class of each capture, before any filter."""
    mapped = map_label(q(label))
    return df.groupBy(q(file_col).alias("source_file")).agg(F.count("*").alias("rows_total"), *[F.count_if(mapped == c).alias(c.lower()) for c in CLASSES])


def class_source_files(df: DataFrame, label: str, file_col: str = "source_file") -> DataFrame:
    """Captures that hold each class, and whether it is confined to one."""
    pairs = df.select(map_label(q(label)).alias("label"), q(file_col).alias("f")).where("label is not null").distinct()
    out = pairs.groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("f")), ",").alias("files"), F.count("*").alias("n_files"))
    return out.withColumn("single_capture", F.col("n_files") == 1)


def file_holdout_valid(df: DataFrame, label: str, file_col: str = "source_file") -> DataFrame:
    return class_source_files(df, label, file_col).agg(F.coalesce(~F.bool_or("single_capture"), F.lit(True)).alias("valid"))


def pair_audit(df: DataFrame, a: str, b: str, limit: float = 0.99) -> DataFrame:
    """Rows where both are finite, whether all are equal, Pearson's r (null if undefined) and whether |r| is very high."""
    x, y = finite(q(a).cast("double")), finite(q(b).cast("double"))
    pair = df.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    out = pair.agg(F.count("*").alias("rows_compared"), F.coalesce(F.bool_and(F.col("x") == F.col("y")), F.lit(True)).alias("identical"), r.alias("r"))
    r = F.when(F.col("rows_compared") > 1, F.col("r"))
    return out.select("rows_compared", "identical", F.round(r, 6).alias("r"), F.coalesce(F.abs(r) >= limit, F.lit(False)).alias("very_high"))


def identical_percentage(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows whose raw values are equal, in percent; null for an empty table."""
    same = q(a).cast("string").eqNullSafe(q(b).cast("string"))
    return df.agg(F.round(100.0 * F.avg(same.cast("int")), 4).alias("percentage"))


def reconcile_missing(submitted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return submitted.select(key).join(stored, key, "left_anti")


def reconcile_present(submitted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return submitted.select(key).join(stored, key, "left_semi")


def mapped_headers(headers: DataFrame) -> DataFrame:
    """headers (file, pos, name) with the normalised name and the model name it stands for."""
    aliases = headers.sparkSession.createDataFrame(list(FEATURE_ALIASES.items()), "alias string, target string")
    named = headers.withColumn("normalized", normalize_name("name"))
    out = named.join(F.broadcast(aliases), F.col("normalized") == F.col("alias"), "left")  # the alias table is fixed
    return out.withColumn("mapped", F.coalesce("target", "normalized")).select("file", "pos", "name", "normalized", "mapped", F.col("alias").isNotNull().alias("is_alias"))


def _required(headers: DataFrame, required: list[str]) -> DataFrame:
    dim = headers.sparkSession.createDataFrame(list(enumerate(required)), "ord long, feature string")
    return headers.select("file").distinct().crossJoin(F.broadcast(dim))  # files x features of one model


def available(headers: DataFrame, required: list[str], policy: str) -> DataFrame:
    """(file, feature) that a file offers under a policy; a reproduction adds copies of its sources."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    have = mapped_headers(headers).select("file", F.col("mapped").alias("feature")).distinct()
    if policy != REPRODUCTION:
        return have
    rules = [(t, s) for t, s in REPRODUCED.items() if t in required]
    copies = headers.sparkSession.createDataFrame(rules, "target string, source string")
    return have.union(have.join(F.broadcast(copies), F.col("feature") == F.col("source")).select("file", F.col("target").alias("feature"))).distinct()


def compat_missing(headers: DataFrame, required: list[str], policy: str) -> DataFrame:
    """Required features that a file does not offer, in model order."""
    have = available(headers, required, policy)
    return _required(headers, required).join(have, ["file", "feature"], "left_anti").select("file", "ord", "feature")


def compat_extra(headers: DataFrame, required: list[str]) -> DataFrame:
    """Normalised names that are no alias, no feature and no metadata."""
    known = headers.sparkSession.createDataFrame([(c,) for c in {*required, *METADATA_ALIASES, *FEATURE_ALIASES}], "normalized string")
    return mapped_headers(headers).select("file", "normalized").distinct().join(F.broadcast(known), "normalized", "left_anti")


def compat_matches(headers: DataFrame, required: list[str]) -> DataFrame:
    """(file, feature, kind): matched as written, after normalisation, or by alias."""
    need, named = _required(headers, required).select("file", "feature"), mapped_headers(headers)
    exact = need.join(named.select("file", F.col("name").alias("feature")), ["file", "feature"], "left_semi").select("file", "feature", F.lit("exact").alias("kind"))
    plain = need.join(named.select("file", F.col("normalized").alias("feature")), ["file", "feature"], "left_semi").subtract(exact.select("file", "feature"))
    alias = need.join(named.where("is_alias").select("file", F.col("mapped").alias("feature")), ["file", "feature"], "left_semi")
    return exact.union(plain.select("file", "feature", F.lit("normalized"))).union(alias.select("file", "feature", F.lit("alias")))


def compat_duplicates(headers: DataFrame) -> DataFrame:
    """Names that a file has more than once, as written ('raw') or after mapping ('mapped')."""
    named = mapped_headers(headers)
    out = [named.groupBy("file", F.col(c).alias("name")).agg(F.count("*").alias("n")).where("n > 1").select("file", F.lit(k).alias("kind"), "name", "n") for k, c in (("raw", "name"), ("mapped", "mapped"))]
    return out[0].union(out[1])


def compat_verdict(headers: DataFrame, required: list[str], policy: str) -> DataFrame:
    """Per file: counts of missing features and duplicate names, the state of the twin column, compatible or not."""
    files = headers.select("file").distinct()
    lost = compat_missing(headers, required, policy).groupBy("file").agg(F.count("*").alias("n_missing"))
    twice = compat_duplicates(headers).where("kind = 'mapped'").groupBy("file").agg(F.count("*").alias("n_duplicates"))
    have = available(headers, required, policy)
    twin = have.groupBy("file").agg(F.bool_or(F.col("feature") == "fwd_header_length").alias("_a"), F.bool_or(F.col("feature") == "fwd_header_length.1").alias("_b"))
    out = files.join(lost, "file", "left").join(twice, "file", "left").join(twin, "file", "left").na.fill(0, ["n_missing", "n_duplicates"])
    return out.select("file", "n_missing", "n_duplicates", (F.col("_a") != F.col("_b")).alias("incomplete_pair"), ((F.col("n_missing") == 0) & (F.col("n_duplicates") == 0)).alias("compatible"))


def policy_summary(headers: DataFrame, required: list[str]) -> DataFrame:
    """Per file and policy: exact, alias, reproduced, missing and resolved features."""
    kinds = compat_matches(headers, required).groupBy("file").agg(F.count_if(F.col("kind") == "exact").alias("n_exact"), F.count_if(F.col("kind") == "alias").alias("n_alias"))
    out = None
    plain = available(headers, required, POLICIES[0])
    for policy in POLICIES:
        own = available(headers, required, policy).subtract(plain).groupBy("file").agg(F.count("*").alias("n_reproduced"))
        lost = compat_verdict(headers, required, policy)
        row = kinds.join(own, "file", "left").join(lost, "file").na.fill(0, ["n_reproduced"])
        row = row.select("file", F.lit(policy).alias("policy"), "n_exact", "n_alias", "n_reproduced", "n_missing", (F.lit(len(required)) - F.col("n_missing")).alias("n_resolved"), "compatible")
        out = row if out is None else out.union(row)
    return out


def mapping_audit(headers: DataFrame, required: list[str], policy: str) -> DataFrame:
    """(file, feature, status): how each required feature is served; features present under their own name are 'exact'."""
    alias = compat_matches(headers, required).where("kind = 'alias'").select("file", "feature", F.lit(True).alias("_alias"))
    plain = available(headers, required, POLICIES[0]).withColumn("_plain", F.lit(True))
    have = available(headers, required, policy).withColumn("_have", F.lit(True))
    out = _required(headers, required).join(alias, ["file", "feature"], "left").join(plain, ["file", "feature"], "left").join(have, ["file", "feature"], "left")
    status = (
        F.when(F.col("_alias"), "alias_verified").when(F.col("_plain"), "exact").when(F.col("_have"), "artifact_reproduced")
        .when(F.col("feature").isin(*REPRODUCED), "incompatible").otherwise("unresolved")
    )
    return out.select("file", "feature", status.alias("status"))


def feature_set_diff(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Names that only one side has."""
    left, right = a.select(name), b.select(name)
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))


def constraint_violations(predictions: DataFrame, alerts: DataFrame) -> DataFrame:
    """Rows that break a stored table's rules: (rule, id)."""
    from flowquarry.schema import SEVERITIES, STATUSES

    bad = lambda df, c, ok, rule, i: df.where(~F.coalesce(F.col(c).isin(*ok), F.lit(False))).select(F.lit(rule).alias("rule"), F.col(i).alias("id"))
    twice = predictions.groupBy("flow_id").agg(F.count("*").alias("n"), F.min("flow_id").alias("id")).where("n > 1").select(F.lit("one_prediction_per_flow").alias("rule"), "id")
    out = bad(predictions, "predicted_label", CLASSES, "predicted_label", "prediction_id").union(bad(alerts, "severity", SEVERITIES, "severity", "alert_id"))
    return out.union(bad(alerts, "status", STATUSES, "status", "alert_id")).union(twice)


def result_contract(submitted: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """(problem, id): results with an unknown label or a missing field, and submitted rows without a result."""
    label = ~F.coalesce(F.col("predicted_label").isin(*CLASSES), F.lit(False))
    gap = F.col("confidence").isNull() | F.col("model_version").isNull()
    out = results.where(label).select(F.lit("unknown_label").alias("problem"), F.col(key).alias("id"))
    out = out.union(results.where(gap).select(F.lit("missing_field"), F.col(key)))
    return out.union(submitted.join(results, key, "left_anti").select(F.lit("no_result"), F.col(key)))
