"""Reads over scored flows: joins, filters, pages, alerts, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.columns import alert_description, alert_title, minute, report_time, severity
from flowquarry.schema import ALERT_THRESHOLD, CLASSES, MAX_PAGE_SIZE, PAGE_SIZE


def prediction_flow(predictions: DataFrame, flows: DataFrame) -> DataFrame:
    return predictions.join(flows, "flow_id")


def prediction_detail(predictions: DataFrame, flows: DataFrame, models: DataFrame) -> DataFrame:
    # no hint: Spark broadcasts the registry while it is small, by the size it measures
    return prediction_flow(predictions, flows).join(models, "model_id")


def alert_detail(alerts: DataFrame, predictions: DataFrame, flows: DataFrame) -> DataFrame:
    return alerts.join(predictions, "prediction_id").join(flows, "flow_id")


def prediction_alert(predictions: DataFrame, alerts: DataFrame) -> DataFrame:
    return predictions.join(alerts, "prediction_id", "left")


def filtered(df: DataFrame, **equal: object) -> DataFrame:
    """Equality filters; a value of None adds none."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def page(df: DataFrame, key: str, limit: int | None = None, offset: int = 0, before: int | None = None) -> DataFrame:
    """Newest first by key. `before` pages by key, which stays cheap however deep; offset pages by count."""
    limit = min(PAGE_SIZE, MAX_PAGE_SIZE) if limit is None else limit
    if not 1 <= limit <= MAX_PAGE_SIZE or offset < 0:
        raise ValueError(f"limit must lie in 1..{MAX_PAGE_SIZE} and offset must not be negative")
    if before is not None:
        df = df.where(F.col(key) < before)
    out = df.orderBy(F.desc(key))
    return (out.offset(offset) if offset else out).limit(limit)


def by_id(df: DataFrame, key: str, value: int) -> DataFrame:
    return df.where(F.col(key) == value)


def write_by_id(df: DataFrame, path: str, key: str, group_bytes: int = 8 << 20) -> None:
    """df as Parquet files that are ranges of the key, sorted, in row groups of about `group_bytes` with Bloom filters on the key.

    A look-up by id, or a page by key, then reads the row groups whose range holds the key; ids that are not there mostly none.
    """
    out = df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite")
    out.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.block.size", group_bytes).parquet(path)


def alerts_from(predictions: DataFrame, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """An alert for every attack at or above the threshold."""
    hit = predictions.where((F.col("predicted_label") != "Normal") & (F.col("confidence") >= threshold))
    return hit.select(
        F.col("prediction_id").alias("alert_id"), "prediction_id", severity("predicted_label").alias("severity"), alert_title("predicted_label").alias("title"),
        alert_description("predicted_label", "confidence").alias("description"), F.lit("ACTIVE").alias("status"), F.col("prediction_time").alias("created_at"),
    )


def current_status(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Alerts with the status that the log of acknowledgements (alert_id, ack_time) gives; the first one counts."""
    first = acks.groupBy("alert_id").agg(F.min("ack_time").alias("acknowledged_at"))
    out = alerts.drop("status", "acknowledged_at").join(first, "alert_id", "left")
    return out.withColumn("status", F.when(F.col("acknowledged_at").isNull(), "ACTIVE").otherwise("ACKNOWLEDGED"))


def _of_class(name: str, c: str = "predicted_label") -> Column:
    return F.count_if(F.col(c) == name)


def dashboard_predictions(predictions: DataFrame) -> DataFrame:
    """Totals, also over no rows (0, and a null time)."""
    return predictions.agg(
        F.count("*").alias("total_flows"), *[_of_class(c).alias(f"total_{c.lower()}") for c in CLASSES], F.max("prediction_time").alias("latest")
    )


def dashboard_alerts(alerts: DataFrame) -> DataFrame:
    active = F.col("status") == "ACTIVE"
    return alerts.agg(
        F.count_if(active).alias("active"), F.count_if(active & (F.col("severity") == "HIGH")).alias("active_high"),
        F.count_if(active & (F.col("severity") == "MEDIUM")).alias("active_medium"), F.count_if(F.col("status") == "ACKNOWLEDGED").alias("acknowledged"),
    )


def timeline(predictions: DataFrame, minutes: int = 60, now: Column | None = None) -> DataFrame:
    """Classes per minute over the last minutes before `now` (default: the latest prediction); empty minutes have no row."""
    if not 1 <= minutes <= 1440:
        raise ValueError("minutes must lie in 1..1440")
    if now is None:
        latest = predictions.agg(F.max("prediction_time").alias("_now"))
        predictions = predictions.crossJoin(F.broadcast(latest))  # one row
        now = F.col("_now")
    recent = predictions.where(F.col("prediction_time") >= now - F.make_dt_interval(mins=F.lit(minutes)))
    return recent.groupBy(minute("prediction_time").alias("bucket")).agg(*[_of_class(c).alias(c.lower()) for c in CLASSES])


def timeline_long(line: DataFrame) -> DataFrame:
    return line.unpivot(["bucket"], [c.lower() for c in CLASSES], "class", "flows")


def predictions_report(detail: DataFrame) -> DataFrame:
    return detail.select(
        report_time("prediction_time").alias("Time"), F.col("source_ip").alias("Source IP"), F.col("source_port").alias("Src Port"),
        F.col("destination_ip").alias("Destination IP"), F.col("destination_port").alias("Dst Port"), F.col("protocol").alias("Protocol"),
        F.col("predicted_label").alias("Class"), F.col("confidence").alias("Confidence"),
    )


def alerts_report(detail: DataFrame) -> DataFrame:
    return detail.select(
        F.col("alert_id").alias("ID"), report_time("created_at").alias("Time"), F.col("severity").alias("Severity"), F.col("title").alias("Alert"),
        F.col("predicted_label").alias("Class"), F.col("confidence").alias("Confidence"), F.col("source_ip").alias("Source IP"),
        F.col("destination_ip").alias("Destination IP"), F.col("status").alias("Status"),
    )


def model_upsert(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """The registry after one incoming version: updated or added, and the only active one."""
    fields = [c for c in incoming.columns if c != "model_version"]
    new = incoming.select(F.col("model_version").alias("_version"), *[F.col(c).alias(f"_{c}") for c in fields])
    out = registry.join(new, F.col("model_version") == F.col("_version"), "full_outer")
    chosen = [F.when(F.col("_version").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in registry.columns else F.col(f"_{c}").alias(c) for c in fields]
    return out.select(F.coalesce("model_version", "_version").alias("model_version"), *chosen, F.col("_version").isNotNull().alias("is_active"))


def model_info(registry: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Fields of a model's JSON metadata; what is not there is null."""
    get = lambda p: F.get_json_object(metadata, p)
    number = lambda p: get(p).try_cast("double")
    return registry.select(
        "model_version", F.coalesce(get("$.model_name"), F.lit("Random Forest")).alias("model_name"), number("$.metrics.accuracy").alias("accuracy"),
        number("$.metrics.macro_f1").alias("macro_f1"), number("$.metrics.classification_report.DDoS.recall").alias("ddos_recall"),
        number("$.metrics.classification_report.PortScan.recall").alias("portscan_recall"),
    )


def ingestion_counters(tagged: DataFrame) -> DataFrame:
    """Rows per disposition of a tagged batch (accepted, duplicate, rejected)."""
    return tagged.groupBy("disposition").agg(F.count("*").alias("n"))


def orphan_predictions(predictions: DataFrame, flows: DataFrame) -> DataFrame:
    """Predictions whose flow is not there."""
    return predictions.join(flows.select("flow_id"), "flow_id", "left_anti")


def referenced_models(models: DataFrame, predictions: DataFrame) -> DataFrame:
    """Models that a prediction names."""
    return models.join(predictions.select("model_id"), "model_id", "left_semi")


def orphan_alerts(alerts: DataFrame, predictions: DataFrame) -> DataFrame:
    """Alerts whose prediction is not there."""
    return alerts.join(predictions.select("prediction_id"), "prediction_id", "left_anti")


def session_counters(tagged: DataFrame, predictions: DataFrame, session: str) -> DataFrame:
    """Per session of the tagged rows: rows per disposition, submitted (accepted) rows, predictions and these by class."""
    kind = lambda k: F.count_if(F.col("disposition") == k)
    rows = tagged.groupBy(session).agg(F.count("*").alias("extracted"), kind("accepted").alias("submitted"), kind("duplicate").alias("duplicates"), kind("rejected").alias("rejected"))
    made = predictions.groupBy(session).agg(F.count("*").alias("successful"), *[_of_class(c).alias(c.lower()) for c in CLASSES])
    return rows.join(made, session, "left").na.fill(0, [c for c in made.columns if c != session])


def session_rates(predictions: DataFrame, alerts: DataFrame, session: str) -> DataFrame:
    """Per session: flows, attacks, share of Normal, share of candidate false alarms, alerts."""
    attack = F.col("predicted_label") != "Normal"
    out = predictions.groupBy(session).agg(F.count("*").alias("n"), F.count_if(attack).alias("attacks"))
    raised = predictions.select("prediction_id", session).join(alerts.select("prediction_id"), "prediction_id").groupBy(session).agg(F.count("*").alias("alerts"))
    out = out.join(raised, session, "left").na.fill(0, ["alerts"])
    return out.select(session, "n", "attacks", F.round((F.col("n") - F.col("attacks")) / F.col("n"), 6).alias("normal_rate"), F.round(F.col("attacks") / F.col("n"), 6).alias("candidate_fpr"), "alerts")


def run_gate(counters: DataFrame) -> DataFrame:
    """Sessions (segments, extracted, produced, required, successful, failed, persisted) with their status."""
    ok = (
        (F.col("segments") > 0) & (F.col("extracted") > 0) & (F.col("produced") == F.col("required")) & (F.col("successful") > 0)
        & (F.col("failed") == 0) & (F.col("persisted") == F.col("successful"))
    )
    return counters.withColumn("status", F.when(ok, "completed").otherwise("failed"))
