"""Flow tables derived from the driver's event table, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.columns import map_label
from flowquarry.operators.store import alerts_from



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event, some repeated; raw labels, nulls, NaNs and infinities in place. `seq` is the row order."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    kind = F.col("event_type")
    label = F.when(kind == "view", "BENIGN").when(kind == "click", "  normal ").when(kind == "purchase", "DDoS   Hulk").when(kind == "error", "Port Scan").when(i % 11 != 0, "Bot")
    value = F.when(i % 97 == 0, F.lit(None)).when(i % 89 == 0, float("nan")).when(i % 83 == 0, float("inf")).otherwise(F.col("value"))
    base = e.select(
        i.alias("flow_id"), (i * 2).alias("seq"), F.col("ts").cast("timestamp").alias("capture_time"), F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("source_ip"),
        F.concat(F.lit("192.168.1."), (i % 20).cast("string")).alias("destination_ip"), (1024 + F.col("user_id") % 500).alias("source_port"),
        F.when(i % 3 == 0, 80).when(i % 3 == 1, 443).otherwise(22).cast("long").alias("destination_port"), F.when(i % 2 == 0, "TCP").otherwise("UDP").alias("protocol"),
        F.concat(F.lit("capture-"), (F.col("user_id") % 3).cast("string")).alias("source_file"), label.alias("raw_label"), value.cast("double").alias("flow_duration"),
        F.get_json_object("props", "$.k").cast("double").alias("packets"), (i % 40).cast("double").alias("fwd_header_length"),
        (i % 40 + F.when(i % 1000 == 7, 1).otherwise(0)).cast("double").alias("fwd_header_length_1"), F.lit(1.0).alias("constant_value"),
    )
    return base.union(base.where("flow_id % 50 = 0").withColumn("seq", F.col("seq") + 1))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows in scope with a prediction by rule: wrong for every 17th flow."""
    f = flows(spark, sf_dir).where("seq % 2 = 0").withColumn("label", map_label("raw_label")).where("label is not null")
    wrong = F.when(F.col("label") == "Normal", "DDoS").when(F.col("label") == "DDoS", "PortScan").otherwise("Normal")
    return f.select(
        F.col("flow_id").alias("prediction_id"), "flow_id", (1 + F.col("flow_id") % 2).alias("model_id"), "label", F.when(F.col("flow_id") % 17 == 0, wrong).otherwise(F.col("label")).alias("predicted_label"),
        (F.lit(0.5) + (F.col("flow_id") % 50) / 100.0).alias("confidence"), F.col("capture_time").alias("prediction_time"),
    )


def models(spark: SparkSession) -> DataFrame:
    rows = [(1, "v1", "forest", 0.91), (2, "v2", "forest-tuned", 0.97), (3, "v3", "spare", 0.5)]
    return spark.createDataFrame(rows, "model_id long, model_version string, model_name string, macro_f1 double")


def stored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).where("seq % 2 = 0").select("flow_id", "capture_time", "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "source_file", "packets")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts_from(scored(spark, sf_dir))


def acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An acknowledgement of every third alert after an hour, and again of every sixth after two."""
    a = alerts(spark, sf_dir).select("alert_id", "created_at")
    hour = lambda n: (F.col("created_at") + F.make_dt_interval(hours=F.lit(n))).alias("ack_time")
    return a.where("alert_id % 3 = 0").select("alert_id", hour(1)).union(a.where("alert_id % 6 = 0").select("alert_id", hour(2)))


_WRONG = "case label when 'Normal' then 'DDoS' when 'DDoS' then 'PortScan' else 'Normal' end"
_TIGHT = "replace(regexp_replace(lower(trim(raw_label)), '\\s+', ' ', 'g'), ' ', '')"
MAP_LABEL_SQL = f"case when {_TIGHT} in ('benign', 'normal') then 'Normal' when {_TIGHT} like '%ddos%' then 'DDoS' when {_TIGHT} like '%portscan%' then 'PortScan' end"

#: DuckDB's version of the views, to put before a query.
VIEWS_SQL = f"""
with base as (
  select event_id as flow_id, event_id * 2 as seq, ts as capture_time, concat('10.0.0.', user_id::varchar) as source_ip,
    concat('192.168.1.', (event_id % 20)::varchar) as destination_ip, 1024 + user_id % 500 as source_port,
    (case event_id % 3 when 0 then 80 when 1 then 443 else 22 end)::bigint as destination_port,
    case when event_id % 2 = 0 then 'TCP' else 'UDP' end as protocol, concat('capture-', (user_id % 3)::varchar) as source_file,
    case event_type when 'view' then 'BENIGN' when 'click' then '  normal ' when 'purchase' then 'DDoS   Hulk' when 'error' then 'Port Scan'
      else case when event_id % 11 <> 0 then 'Bot' end end as raw_label,
    case when event_id % 97 = 0 then null when event_id % 89 = 0 then 'NaN'::double when event_id % 83 = 0 then 'Infinity'::double else value end as flow_duration,
    json_extract_string(props, '$.k')::double as packets, (event_id % 40)::double as fwd_header_length,
    (event_id % 40 + case when event_id % 1000 = 7 then 1 else 0 end)::double as fwd_header_length_1, 1.0::double as constant_value
  from events),
flows as (select * from base union all select * replace (seq + 1 as seq) from base where flow_id % 50 = 0),
labelled as (select *, {MAP_LABEL_SQL} as label from flows),
stored as (select flow_id, capture_time, source_ip, destination_ip, source_port, destination_port, protocol, source_file, packets from flows where seq % 2 = 0),
scored as (
  select flow_id as prediction_id, flow_id, 1 + flow_id % 2 as model_id, label, case when flow_id % 17 = 0 then {_WRONG} else label end as predicted_label,
    0.5::double + (flow_id % 50) / 100.0::double as confidence, capture_time as prediction_time
  from labelled where seq % 2 = 0 and label is not null),
models as (select * from (values (1::bigint, 'v1', 'forest', 0.91::double), (2, 'v2', 'forest-tuned', 0.97), (3, 'v3', 'spare', 0.5)) t(model_id, model_version, model_name, macro_f1)),
alerts as (
  select prediction_id as alert_id, prediction_id, case when predicted_label = 'DDoS' then 'HIGH' else 'MEDIUM' end as severity, prediction_time as created_at
  from scored where predicted_label <> 'Normal' and confidence >= 0.7::double),
acks as (
  select alert_id, created_at + interval 1 hour as ack_time from alerts where alert_id % 3 = 0
  union all select alert_id, created_at + interval 2 hour from alerts where alert_id % 6 = 0),
status as (
  select a.*, k.acknowledged_at, case when k.acknowledged_at is null then 'ACTIVE' else 'ACKNOWLEDGED' end as status
  from alerts a left join (select alert_id, min(ack_time) as acknowledged_at from acks group by 1) k using (alert_id))
"""

