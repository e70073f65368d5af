"""Registered queries over the flow views, each with the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions import columns as C
from flowquarry.operators import adapt, audit, metrics, prepare, profile, splits, store
from flowquarry.plans import ml
from flowquarry.plans import views as V
from flowquarry.schema import CLASSES, FEATURE_ALIASES, FEATURES, LEAKAGE, METADATA_ALIASES, REPRODUCED, REPRODUCTION, STRICT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (V.VIEWS_SQL if views else "") + sql
        return f

    return add


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


ORDER, KEY_IGNORE = ["seq"], ("source_file",)
FIN = "case when isfinite(flow_duration) then flow_duration end"
KEYS = "flow_id, capture_time, source_ip, destination_ip, source_port, destination_port, protocol, raw_label, flow_duration, packets, fwd_header_length, fwd_header_length_1, constant_value"
SINGLE_SQL = f", single as (select * exclude (rn) from (select *, row_number() over (partition by {KEYS} order by seq) as rn from labelled where label is not null) where rn = 1)\n"
NUMERIC = ["flow_duration", "packets", "fwd_header_length", "fwd_header_length_1", "constant_value"]
FEATURE_COLS = ["flow_duration", "packets", "fwd_header_length", "fwd_header_length_1", "constant_value", "source_port", "destination_port"]


def single(s, d) -> DataFrame:
    """Rows in scope, deduplicated, with the class as `label`."""
    f = V.flows(s, d).withColumn("label", C.map_label("raw_label")).where("label is not null")
    return prepare.dedup_keep_first(f, ORDER, KEY_IGNORE)


# -- scalar functions


@query("select raw_label, label, count(*) as n from labelled group by all")
def map_label(s, d):
    return V.flows(s, d).groupBy("raw_label", C.map_label("raw_label").alias("label")).agg(F.count("*").alias("n"))


@query("select label, case label when 'Normal' then 0 when 'DDoS' then 1 when 'PortScan' then 2 end as label_index, count(*) as n from labelled group by all")
def label_index(s, d):
    f = V.flows(s, d).withColumn("label", C.map_label("raw_label"))
    return f.groupBy("label", C.label_index("label").alias("label_index")).agg(F.count("*").alias("n"))


@query(
    "select distinct regexp_replace(replace(lower(trim(concat('  ', p_name, ' / ', p_brand, ' '))), '/', '_'), '\\s+', '_', 'g') as name from part", views=False
)
def fn_normalize_name(s, d):
    raw = F.concat(F.lit("  "), "p_name", F.lit(" / "), "p_brand", F.lit(" "))
    return V.table(s, d, "part").select(C.normalize_name(raw).alias("name")).distinct()


NUMBER_TEXT_SQL = "case flow_id % 9 when 0 then '' when 1 then 'nan' when 2 then '-Infinity' when 3 then '1.5d' when 4 then 'abc' when 5 then ' 12.25 ' when 6 then '1e3' else packets::varchar end"


def _number_text() -> F.Column:
    i = F.col("flow_id") % 9
    out = F.when(i == 0, "").when(i == 1, "nan").when(i == 2, "-Infinity").when(i == 3, "1.5d").when(i == 4, "abc").when(i == 5, " 12.25 ").when(i == 6, "1e3")
    return out.otherwise(F.col("packets").cast("string"))


@query(
    f"select flow_id, case when regexp_full_match(trim(t), '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?') then round(t::double, 6) end as number,"
    f" t in ('1.5d', 'abc') as rejected from (select flow_id, {NUMBER_TEXT_SQL} as t from stored)"
)
def fn_parse_numeric(s, d):
    f = V.stored_flows(s, d).select("flow_id", _number_text().alias("t"))
    return f.select("flow_id", F.round(C.parse_number("t"), 6).alias("number"), C.number_error("t").alias("rejected"))


@query(
    "select flow_id, case when flow_id % 4 = 0 then null else strftime(date_trunc('second', capture_time), '%Y-%m-%d %H:%M:%S') end as at from stored"
)
def fn_parse_ts(s, d):
    iso = F.date_format("capture_time", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("flow_id") % 4 == 0, "not a time").when(F.col("flow_id") % 4 == 1, F.concat(iso, F.lit("Z"))).otherwise(iso)
    return V.stored_flows(s, d).select("flow_id", C.time_text(C.parse_timestamp(text)).alias("at"))


def _identity_sql(**fields: str) -> str:
    return "sha256(to_json(struct_pack(" + ", ".join(f"{k} := ({v})::varchar" for k, v in fields.items()) + "))::varchar)"


LIVE_SQL = _identity_sql(
    capture_session_id="source_file", source_ip="source_ip", destination_ip="destination_ip", source_port="source_port", destination_port="destination_port", protocol="protocol",
    capture_time="strftime(capture_time, '%Y-%m-%d %H:%M:%S')", flow_duration="flow_id % 7",
)
RUN_SQL = _identity_sql(
    capture_time="strftime(capture_time, '%Y-%m-%d %H:%M:%S')", destination_ip="destination_ip", destination_port="destination_port", protocol="protocol", source_ip="source_ip",
    source_port="source_port", flow_duration="flow_id % 7", total_fwd_packets="null", total_backward_packets="flow_id % 3",
)


@query(f"select flow_id, {LIVE_SQL} as fingerprint from stored")
def live_fingerprint(s, d):
    f = V.stored_flows(s, d).withColumnRenamed("source_file", "capture_session_id").withColumns({"capture_time": C.time_text("capture_time"), "flow_duration": F.col("flow_id") % 7})
    return f.select("flow_id", adapt.live_fingerprint().alias("fingerprint"))


@query(f"select flow_id, case when flow_id % 5 = 0 then concat('own-', flow_id::varchar) else {RUN_SQL} end as fingerprint from stored")
def flow_fingerprint(s, d):
    i = F.col("flow_id")
    f = V.stored_flows(s, d).withColumns(
        {"capture_time": C.time_text("capture_time"), "flow_duration": i % 7, "total_fwd_packets": F.lit(None).cast("long"), "total_backward_packets": i % 3}
    )
    own = F.when(i % 5 == 0, F.concat(F.lit("own-"), i.cast("string")))
    return f.select("flow_id", adapt.flow_fingerprint(own).alias("fingerprint"))


@query("select predicted_label as label, concat(case when predicted_label = 'DDoS' then 'HIGH' else 'MEDIUM' end, ' confidence ', predicted_label, ' detected') as title,"
       " concat('The model classified this flow as ', predicted_label, ' with confidence ', printf('%.4f', confidence), '.') as description, count(*) as n from scored group by all")  # fmt: skip
def alert_text(s, d):
    p = V.scored(s, d)
    return p.groupBy(F.col("predicted_label").alias("label"), C.alert_title("predicted_label").alias("title"), C.alert_description("predicted_label", "confidence").alias("description")).agg(F.count("*").alias("n"))


@query("select event_id, json_extract_string(props, '$.k')::double as k, json_extract_string(props, '$.absent') as absent from events", views=False)
def json_features(s, d):
    m = F.from_json("props", "map<string,double>")
    return V.table(s, d, "events").select("event_id", F.element_at(m, "k").alias("k"), F.get_json_object("props", "$.absent").alias("absent"))


@query("select flow_id, flow_id % 3 <> 0 as valid from stored")
def session_id_check(s, d):
    made = C.session_id("capture_time", "flow_id")
    text = F.when(F.col("flow_id") % 3 == 0, F.concat(made, F.lit("x"))).otherwise(made)
    return V.stored_flows(s, d).select("flow_id", C.session_id_ok(text).alias("valid"))


# -- projections and filters


@query("select o_orderkey, o_custkey, o_orderstatus from orders", views=False)
def normalized_projection(s, d):
    raw = V.table(s, d, "orders").select(F.col("o_orderkey").alias(" O_OrderKey "), F.col("o_custkey").alias("O_CUSTKEY"), F.col("o_orderstatus").alias("o_orderstatus"))
    return prepare.normalize_columns(raw)


@query("select flow_id, seq, label from labelled where label is not null")
def label_filter(s, d):
    return prepare.in_scope(V.flows(s, d), "raw_label").select("flow_id", "seq", F.col("raw_label").alias("label"))


@query("select * exclude (flow_id, source_ip, destination_ip, source_file, capture_time) from flows")
def leakage_projection(s, d):
    f = V.flows(s, d).drop("capture_time")
    _, rest = prepare.leakage_split(f, LEAKAGE)
    return f.select(*rest)


@query("select seq, source_port, destination_port, flow_duration, packets, fwd_header_length, fwd_header_length_1, constant_value from flows where isfinite(flow_duration)")
def numeric_projection(s, d):
    f = V.flows(s, d)
    return f.where(C.finite("flow_duration").isNotNull()).select(*prepare.feature_names(f, LEAKAGE, "raw_label"))


@query(f"select seq, round(({FIN})::float::double, 3) as flow_duration, packets::float::double as packets from flows")
def finite_features(s, d):
    f = prepare.finite_features(V.flows(s, d).select("seq", "flow_duration", "packets"), ["flow_duration", "packets"])
    return f.select("seq", F.round(F.col("flow_duration").cast("double"), 3).alias("flow_duration"), F.col("packets").cast("double").alias("packets"))


RAW_FLOW = {"Dst Port": "destination_port", "Flow Duration": "flow_id % 1000", "Fwd Header Len": "source_port", "Fwd URG Flags": "flow_id % 2"}
ADAPT_NEED = ["destination_port", "flow_duration", "fwd_header_length", "fwd_urg_flags"]
ADAPT_SQL = f"select flow_id, destination_port::double as destination_port, case when flow_id % 9 = 7 then (flow_id % 1000)::double when flow_id % 9 = 8 then (flow_id % 1000)::double when flow_id % 9 = 5 then 12.25 when flow_id % 9 = 6 then 1000.0 end as flow_duration, source_port::double as fwd_header_length, (flow_id % 2)::double as fwd_urg_flags"


def _extracted(s, d) -> DataFrame:
    i = F.col("flow_id")
    text = F.when(i % 9 >= 7, (i % 1000).cast("string")).otherwise(_number_text())
    return V.stored_flows(s, d).select(
        "flow_id", F.col("destination_port").cast("string").alias("Dst Port"), text.alias("Flow Duration"), F.col("source_port").cast("string").alias("Fwd Header Len"),
        (i % 2).cast("string").alias(" Fwd URG Flags"),
    )


@query(f"{ADAPT_SQL}, case when flow_id % 9 in (3, 4) then 'not numeric: flow_duration' end as reject_reason from stored")
def adapt_flows(s, d):
    return adapt.adapt(_extracted(s, d), ADAPT_NEED, STRICT, ("flow_id",))


@query(f"{ADAPT_SQL}, source_port::double as fwd_header_length_1, (flow_id % 2)::double as cwe_flag_count from stored where flow_id % 9 not in (3, 4)")
def adapt_flows_artifact(s, d):
    good, _ = adapt.split_rejects(adapt.adapt(_extracted(s, d), [*ADAPT_NEED, *REPRODUCED], REPRODUCTION, ("flow_id",)))
    return good.withColumnRenamed("fwd_header_length.1", "fwd_header_length_1")


@query("select flow_id, 'not numeric: flow_duration' as reject_reason from stored where flow_id % 9 in (3, 4)")
def adapt_rejects(s, d):
    _, bad = adapt.split_rejects(adapt.adapt(_extracted(s, d), ADAPT_NEED, STRICT, ("flow_id",)))
    return bad.select("flow_id", "reject_reason")


@query(
    "select flow_id, strftime(capture_time, '%Y-%m-%d %H:%M:%S') as capture_time, case when flow_id % 2 = 0 then source_ip else destination_ip end as source_ip,"
    " source_port::varchar as source_port, null::varchar as destination_ip, null::varchar as destination_port, 'given' as protocol from stored"
)
def flow_metadata(s, d):
    f = V.stored_flows(s, d).select(
        "flow_id", C.time_text("capture_time").alias("Timestamp"), F.when(F.col("flow_id") % 2 == 0, F.col("source_ip")).otherwise("").alias("Src IP"),
        F.col("destination_ip").alias("Source IP"), "source_port", F.col("protocol").alias("Protocol"),
    )
    return f.select("flow_id", *adapt.metadata([c for c in f.columns if c != "flow_id"], {"protocol": F.lit("given")}))


@query(
    "select flow_id, case when flow_id % 6 = 5 then 'extra_one' else '' end as extra_features, case flow_id % 6 when 0 then 'missing: b' when 1 then 'not numeric: a'"
    " when 2 then 'duplicate features' when 5 then 'extra: extra_one' end as reject_reason,"
    " case when flow_id % 6 in (0, 5) or flow_id % 6 = 3 then (flow_id % 10)::double end as a, case when flow_id % 6 in (1, 3, 4, 5) then 2.5::double end as b from stored"
)
def validate_feature_map(s, d):
    i = F.col("flow_id")
    a = F.when(i % 6 == 1, "x").when(i % 6 == 4, "inf").otherwise((i % 10).cast("string"))
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), (F.lit(v) if isinstance(v, str) else v).alias("value"))
    first = entry(" A ", a)
    pairs = (
        F.when(i % 6 == 0, F.array(first)).when(i % 6 == 2, F.array(first, entry("a", "1"), entry("b", "2.5")))
        .when(i % 6 == 5, F.array(first, entry("B", "2.5"), entry("extra one", "1"))).otherwise(F.array(first, entry("B", "2.5")))
    )
    f = V.stored_flows(s, d).select("flow_id", F.map_from_entries(pairs).alias("features"))
    out = adapt.validate_map(f, "features", ["a", "b"])
    return out.select("flow_id", "extra_features", "reject_reason", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))


@query("select flow_id, case when flow_id % 7 = 0 then 'source_port' when flow_id % 7 = 1 then 'destination_ip' when flow_id % 7 = 2 then 'protocol' end as reject_reason from stored")
def metadata_constraints(s, d):
    i = F.col("flow_id")
    f = V.stored_flows(s, d).withColumns(
        {
            "source_port": F.when(i % 7 == 0, 65_536 + F.col("source_port")).otherwise(F.col("source_port")),
            "destination_ip": F.when(i % 7 == 1, F.repeat("destination_ip", F.lit(9))).otherwise(F.col("destination_ip")),
            "protocol": F.when(i % 7 == 2, F.repeat("protocol", F.lit(11))).otherwise(F.col("protocol")),
        }
    )
    return adapt.metadata_rejects(f).select("flow_id", "reject_reason")


# -- joins, pages and reads of the store

DETAIL = "s.prediction_id, s.flow_id, s.predicted_label, round(s.confidence, 6) as confidence, f.source_ip, f.destination_ip, f.protocol"


def _detail(df, *more):
    return df.select("prediction_id", "flow_id", "predicted_label", *r6("confidence"), "source_ip", "destination_ip", "protocol", *more)


@query(f"select {DETAIL} from scored s join stored f using (flow_id)")
def prediction_flow_join(s, d):
    return _detail(store.prediction_flow(V.scored(s, d), V.stored_flows(s, d)))


@query(f"select {DETAIL}, m.model_version, m.model_name from scored s join stored f using (flow_id) join models m using (model_id)")
def prediction_detail(s, d):
    return _detail(store.prediction_detail(V.scored(s, d), V.stored_flows(s, d), V.models(s)), "model_version", "model_name")


@query(f"select {DETAIL}, a.alert_id, a.severity from alerts a join scored s using (prediction_id) join stored f using (flow_id)")
def alert_detail(s, d):
    return _detail(store.alert_detail(V.alerts(s, d), V.scored(s, d), V.stored_flows(s, d)), "alert_id", "severity")


@query("select s.prediction_id, s.predicted_label, a.severity from scored s left join alerts a using (prediction_id)")
def prediction_alert_left(s, d):
    return store.prediction_alert(V.scored(s, d), V.alerts(s, d)).select("prediction_id", "predicted_label", "severity")


@query("select flow_id from stored where flow_id not in (select flow_id from scored where flow_id % 4 <> 0)")
def reconcile_missing(s, d):
    return audit.reconcile_missing(V.stored_flows(s, d), V.scored(s, d).where("flow_id % 4 <> 0"), "flow_id")


@query("select flow_id from stored where flow_id in (select flow_id from scored where flow_id % 4 <> 0)")
def reconcile_present(s, d):
    return audit.reconcile_present(V.stored_flows(s, d), V.scored(s, d).where("flow_id % 4 <> 0"), "flow_id")


@query("select prediction_id, flow_id from scored where flow_id % 10 = 0")
def orphan_predictions(s, d):
    return store.orphan_predictions(V.scored(s, d), V.stored_flows(s, d).where("flow_id % 10 <> 0")).select("prediction_id", "flow_id")


@query("select alert_id, prediction_id from alerts where prediction_id in (select prediction_id from scored where flow_id % 10 = 0)")
def orphan_alerts(s, d):
    return store.orphan_alerts(V.alerts(s, d), V.scored(s, d).where("flow_id % 10 <> 0")).select("alert_id", "prediction_id")


@query("select model_id, model_version from models where model_id in (select model_id from scored)")
def referenced_models(s, d):
    return store.referenced_models(V.models(s), V.scored(s, d)).select("model_id", "model_version")


PAGED = f"select {DETAIL} from scored s join stored f using (flow_id)"


@query(f"{PAGED} where predicted_label = 'DDoS' and f.source_ip = '10.0.0.7' order by prediction_id desc limit 50")
def list_predictions(s, d):
    return store.page(_detail(store.filtered(store.prediction_flow(V.scored(s, d), V.stored_flows(s, d)), predicted_label="DDoS", source_ip="10.0.0.7", destination_ip=None)), "prediction_id")


@query(f"{PAGED} order by prediction_id desc limit 20 offset 40")
def predictions_page(s, d):
    return store.page(_detail(store.prediction_flow(V.scored(s, d), V.stored_flows(s, d))), "prediction_id", 20, 40)


@query(f"{PAGED} where s.prediction_id < 5000 order by prediction_id desc limit 20")
def predictions_page_by_key(s, d):
    return store.page(_detail(store.prediction_flow(V.scored(s, d), V.stored_flows(s, d))), "prediction_id", 20, before=5000)


@query("select prediction_id, predicted_label, round(confidence, 6) as confidence from scored order by prediction_id desc limit 20")
def latest_predictions(s, d):
    return store.page(V.scored(s, d).select("prediction_id", "predicted_label", *r6("confidence")), "prediction_id", 20)


@query("select alert_id, severity, status from status where severity = 'HIGH' and status = 'ACTIVE' order by alert_id desc limit 50")
def list_alerts(s, d):
    now = store.current_status(V.alerts(s, d), V.acks(s, d))
    return store.page(store.filtered(now, severity="HIGH", status="ACTIVE").select("alert_id", "severity", "status"), "alert_id")


@query("select prediction_id, predicted_label from scored where prediction_id = 1234")
def prediction_by_id(s, d):
    return store.by_id(V.scored(s, d), "prediction_id", 1234).select("prediction_id", "predicted_label")


@query("select alert_id, prediction_id, severity, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at from alerts")
def alerts_from_predictions(s, d):
    return V.alerts(s, d).select("alert_id", "prediction_id", "severity", C.time_text("created_at").alias("created_at"))


@query("select alert_id, status, strftime(acknowledged_at, '%Y-%m-%d %H:%M:%S') as acknowledged_at from status")
def alerts_current_status(s, d):
    return store.current_status(V.alerts(s, d), V.acks(s, d)).select("alert_id", "status", C.time_text("acknowledged_at").alias("acknowledged_at"))


@query(
    "select strftime(s.prediction_time, '%d %b %Y · %H:%M:%S') as \"Time\", f.source_ip as \"Source IP\", f.source_port as \"Src Port\", f.destination_ip as \"Destination IP\","
    " f.destination_port as \"Dst Port\", f.protocol as \"Protocol\", s.predicted_label as \"Class\", s.confidence as \"Confidence\" from scored s join stored f using (flow_id)"
)
def predictions_report(s, d):
    return store.predictions_report(store.prediction_flow(V.scored(s, d), V.stored_flows(s, d)))


@query(
    "select a.alert_id as \"ID\", strftime(a.created_at, '%d %b %Y · %H:%M:%S') as \"Time\", a.severity as \"Severity\", concat(a.severity, ' confidence ', s.predicted_label, ' detected') as \"Alert\","
    " s.predicted_label as \"Class\", s.confidence as \"Confidence\", f.source_ip as \"Source IP\", f.destination_ip as \"Destination IP\", a.status as \"Status\""
    " from status a join scored s using (prediction_id) join stored f using (flow_id)"
)
def alerts_report(s, d):
    now = store.current_status(V.alerts(s, d), V.acks(s, d))
    return store.alerts_report(store.alert_detail(now, V.scored(s, d), V.stored_flows(s, d)))


@query(
    "select count(*) as total_flows, count(*) filter (predicted_label = 'Normal') as total_normal, count(*) filter (predicted_label = 'DDoS') as total_ddos,"
    " count(*) filter (predicted_label = 'PortScan') as total_portscan, strftime(max(prediction_time), '%Y-%m-%d %H:%M:%S') as latest from scored"
)
def dashboard_predictions(s, d):
    return store.dashboard_predictions(V.scored(s, d)).withColumn("latest", C.time_text("latest"))


@query(
    "select count(*) filter (status = 'ACTIVE') as active, count(*) filter (status = 'ACTIVE' and severity = 'HIGH') as active_high,"
    " count(*) filter (status = 'ACTIVE' and severity = 'MEDIUM') as active_medium, count(*) filter (status = 'ACKNOWLEDGED') as acknowledged from status"
)
def dashboard_alerts(s, d):
    return store.dashboard_alerts(store.current_status(V.alerts(s, d), V.acks(s, d)))


LINE_SQL = "select date_trunc('minute', prediction_time) as bucket, count(*) filter (predicted_label = 'Normal') as normal, count(*) filter (predicted_label = 'DDoS') as ddos, count(*) filter (predicted_label = 'PortScan') as portscan from scored where prediction_time >= (select max(prediction_time) from scored) - interval 1440 minute group by 1"


@query(f"select strftime(bucket, '%Y-%m-%d %H:%M:%S') as bucket, normal, ddos, portscan from ({LINE_SQL})")
def timeline(s, d):
    return store.timeline(V.scored(s, d), 1440).withColumn("bucket", C.time_text("bucket"))


@query(f"select strftime(bucket, '%Y-%m-%d %H:%M:%S') as bucket, class, flows from (unpivot ({LINE_SQL}) on normal, ddos, portscan into name class value flows)")
def timeline_long(s, d):
    return store.timeline_long(store.timeline(V.scored(s, d), 1440)).withColumn("bucket", C.time_text("bucket"))


@query(
    "select m.model_version, case when m.model_version = 'v2' then 'forest-new' else m.model_name end as model_name, case when m.model_version = 'v2' then n.f1 else m.macro_f1 end as macro_f1,"
    " m.model_version = 'v2' as is_active from models m, (select round(avg((label = predicted_label)::int), 6) as f1 from scored) n"
)
def model_registry_upsert(s, d):
    score = V.scored(s, d).agg(F.round(F.avg((F.col("label") == F.col("predicted_label")).cast("int")), 6).alias("macro_f1"))
    new = score.select(F.lit("v2").alias("model_version"), F.lit("forest-new").alias("model_name"), "macro_f1")
    return store.model_upsert(V.models(s).drop("model_id"), new)


@query("select concat('v', model_id::varchar) as model_version, 'Random Forest' as model_name, round(avg((label = predicted_label)::int), 6) as accuracy, null::double as macro_f1, 0.5::double as ddos_recall, null::double as portscan_recall from scored group by model_id")
def model_info(s, d):
    per = V.scored(s, d).groupBy("model_id").agg(F.round(F.avg((F.col("label") == F.col("predicted_label")).cast("int")), 6).alias("acc"))
    text = F.format_string('{"metrics": {"accuracy": %s, "classification_report": {"DDoS": {"recall": 0.5}}}}', F.col("acc").cast("string"))
    return store.model_info(per.select(F.concat(F.lit("v"), F.col("model_id").cast("string")).alias("model_version"), text.alias("metadata")))


# -- profile


def _union_all(parts: list[str]) -> str:
    return " union all ".join(parts)


@query("select count(*) as n_rows, 15::bigint as n_columns from flows")
def profile_shape(s, d):
    return profile.shape(V.flows(s, d))


COLUMNS = [*KEYS.split(", ")[:1], "seq", "capture_time", "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "source_file", "raw_label", *NUMERIC]
TYPE_SQL = "replace(split_part(lower(any_value(typeof({c}))), ' ', 1), 'varchar', 'string')"


@query(_union_all([f"select {i}::bigint as position, '{c}' as column_name, {TYPE_SQL.format(c=c)} as data_type, count({c}) as n_values from flows" for i, c in enumerate(COLUMNS)]))
def column_types(s, d):
    return profile.column_types(V.flows(s, d).select(*COLUMNS))


@query("select coalesce(raw_label, '<missing>') as raw_label, count(*) as n from flows group by 1")
def raw_class_distribution(s, d):
    return profile.raw_class_distribution(V.flows(s, d), "raw_label")


@query("select coalesce(raw_label, '<missing>') as raw_label, count(*) as n from labelled where label is null group by 1")
def excluded_class_distribution(s, d):
    return profile.excluded_class_distribution(V.flows(s, d), "raw_label")


CLASS_DIM = "(values ('Normal'), ('DDoS'), ('PortScan')) c(label)"


@query(f"select c.label, count(l.label) as n, coalesce(round(100.0::double * count(l.label) / (select count(label) from labelled), 4), 0) as percentage from {CLASS_DIM} left join labelled l on l.label = c.label group by 1")
def mapped_class_distribution(s, d):
    return profile.mapped_class_distribution(V.flows(s, d), "raw_label")


MISSING_COLS = ["flow_id", "seq", "capture_time", "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "source_file", "raw_label", *NUMERIC]


@query(_union_all([f"select '{c}' as column_name, count(*) filter ({c} is null{f' or isnan({c})' if c in NUMERIC else ''}) as n_missing from flows" for c in MISSING_COLS]))
def missing_values(s, d):
    return profile.missing_values(V.flows(s, d))


@query(_union_all([f"select '{c}' as column_name, {f'count(*) filter (isinf({c}))' if c in NUMERIC else 'count(*) filter (false)'} as n_infinite from flows" for c in MISSING_COLS if c in NUMERIC or c in ("flow_id", "seq", "source_port", "destination_port")]))
def infinite_values(s, d):
    return profile.infinite_values(V.flows(s, d))


@query("select count(*) - (select count(*) from (select distinct * exclude (seq) from flows)) as duplicate_rows from flows")
def duplicate_rows(s, d):
    return profile.duplicate_rows(V.flows(s, d).drop("seq"))


def _stats_sql(c: str) -> str:
    v = f"case when isfinite({c}) then {c} end"
    q = ", ".join(f"round(quantile_cont({v}, {p}), 6) as p{int(p * 100)}" for p in (0.25, 0.5, 0.75))
    return f"select '{c}' as column_name, count({v}) as n, round(avg({v}), 6) as mean, round(stddev_samp({v}), 6) as std, min({v}) as min, {q}, max({v}) as max from flows"


@query(_union_all([_stats_sql(c) for c in NUMERIC]))
def descriptive_statistics(s, d):
    out = profile.descriptive_statistics(V.flows(s, d), NUMERIC)
    return out.select("column_name", "n", *r6("mean", "std"), "min", *r6("p25", "p50", "p75"), "max")


@query(f"select column_name from ({_union_all([f'select {chr(39)}{c}{chr(39)} as column_name, count(distinct {c}) as n from flows' for c in MISSING_COLS])}) where n <= 1")
def constant_columns(s, d):
    return profile.constant_columns(V.flows(s, d))


@query(f"select * from ({_union_all([f'select {chr(39)}{c}{chr(39)} as column_name, round(count(distinct {c})::double / count({c}), 6) as ratio from (select case when isfinite({c}) then {c} end as {c} from flows)' for c in NUMERIC])}) where ratio <= 0.01")
def low_variance_columns(s, d):
    return profile.low_variance_columns(V.flows(s, d), NUMERIC).select("column_name", *r6("ratio"))


CORR_COLS = ["flow_duration", "packets", "fwd_header_length", "fwd_header_length_1", "constant_value"]


def _corr_sql(a: str, b: str) -> str:
    fin = lambda c: f"case when isfinite({c}) then {c} end"
    r = f"corr({fin(a)}, {fin(b)})"
    if "constant_value" in (a, b):
        r = "max(null::double)"
    return f"select '{a}' as column_a, '{b}' as column_b, round({r}, 6) as r from flows"


@query(_union_all([_corr_sql(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i:]]))
def numeric_correlation(s, d):
    return profile.correlation(V.flows(s, d), CORR_COLS).select("column_a", "column_b", *r6("r"))


LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(_union_all([f"select '{a}' as column_a, '{b}' as column_b, round(corr({a}, {b}), 6) as r from lineitem" for i, a in enumerate(LINE_COLS) for b in LINE_COLS[i:]]), views=False)
def lineitem_correlation(s, d):
    return profile.correlation(V.table(s, d, "lineitem"), LINE_COLS).select("column_a", "column_b", *r6("r"))


@query(_union_all([_stats_sql(c).replace("from flows", "from lineitem") for c in LINE_COLS]), views=False)
def lineitem_statistics(s, d):
    out = profile.descriptive_statistics(V.table(s, d, "lineitem"), LINE_COLS)
    return out.select("column_name", "n", *r6("mean", "std"), "min", *r6("p25", "p50", "p75"), "max")


@query("select label, count(*) as n from labelled where label is not null group by 1")
def class_distribution(s, d):
    return prepare.in_scope(V.flows(s, d), "raw_label").groupBy(F.col("raw_label").alias("label")).agg(F.count("*").alias("n"))


@query(f"select round(max(n)::double / nullif(min(n), 0), 6) as ratio, coalesce(max(n)::double / nullif(min(n), 0) >= 3, true) as imbalanced from (select count(l.label) as n from {CLASS_DIM} left join labelled l on l.label = c.label group by c.label)")
def imbalance_check(s, d):
    return profile.imbalance(V.flows(s, d), "raw_label")


@query("select * from (values (0::bigint, 'flow_id', 'names the row'), (3, 'source_ip', 'names the sender'), (4, 'destination_ip', 'names the receiver')) t(position, column_name, reason) where exists (select 1 from events)", views=False)
def leakage_found(s, d):
    return profile.leakage_columns(V.flows(s, d), LEAKAGE)


@query("select 'constant_column' as kind, 'constant_value' as column_name union all select 'twin_column', 'fwd_header_length_1'"
       f" union all select 'class_imbalance', null from (select count(l.label) as n from {CLASS_DIM} left join labelled l on l.label = c.label group by c.label) having max(n) >= 3 * min(n)")  # fmt: skip
def profile_warnings(s, d):
    return profile.profile_warnings(V.flows(s, d), "raw_label")


@query("select 'rows' as field, '1' as claimed, count(*)::varchar as found from flows union all select 'source_files', 'capture-0,capture-9', string_agg(distinct source_file, ',' order by source_file) from flows")
def profile_consistency(s, d):
    return profile.profile_consistency(V.flows(s, d), {"rows": 1, "label_column": "raw_label", "source_files": ["capture-9", "capture-0"]}, "raw_label", "source_file")


# -- captures


@query("select source_file, count(*) as rows_total, count(*) filter (label = 'Normal') as normal, count(*) filter (label = 'DDoS') as ddos, count(*) filter (label = 'PortScan') as portscan from labelled group by 1")
def source_distribution(s, d):
    return audit.source_distribution(V.flows(s, d), "raw_label")


CONFINED = "case when label = 'PortScan' then 'capture-9' else source_file end"


def _confined(s, d):
    return V.flows(s, d).withColumn("source_file", F.when(C.map_label("raw_label") == "PortScan", "capture-9").otherwise(F.col("source_file")))


@query(f"select label, string_agg(distinct {CONFINED}, ',' order by {CONFINED}) as files, count(distinct {CONFINED}) as n_files, count(distinct {CONFINED}) = 1 as single_capture from labelled where label is not null group by 1")
def class_source_files(s, d):
    return audit.class_source_files(_confined(s, d), "raw_label")


@query(f"select label, min({CONFINED}) as files from labelled where label is not null group by 1 having count(distinct {CONFINED}) = 1")
def single_capture_classes(s, d):
    return audit.class_source_files(_confined(s, d), "raw_label").where("single_capture").select("label", "files")


@query("select not exists (select 1 from labelled where label = 'PortScan') as valid")
def file_holdout_valid(s, d):
    return audit.file_holdout_valid(_confined(s, d), "raw_label")


@query("select count(*) as rows_compared, bool_and(fwd_header_length = fwd_header_length_1) as identical, round(corr(fwd_header_length, fwd_header_length_1), 6) as r, abs(corr(fwd_header_length, fwd_header_length_1)) >= 0.99 as very_high from flows")
def feature_pair_audit(s, d):
    return audit.pair_audit(V.flows(s, d), "fwd_header_length", "fwd_header_length_1")


@query("select round(100.0::double * avg((fwd_header_length = fwd_header_length_1)::int), 4) as percentage from flows")
def identical_percentage(s, d):
    return audit.identical_percentage(V.flows(s, d), "fwd_header_length", "fwd_header_length_1")


# -- metrics

N = {a: f"count(*) filter (label = '{a}')" for a in CLASSES}
P = {a: f"count(*) filter (predicted_label = '{a}')" for a in CLASSES}
TP = {a: f"count(*) filter (label = '{a}' and predicted_label = '{a}')" for a in CLASSES}


@query(_union_all([f"select '{a}' as label, " + ", ".join(f"count(*) filter (label = '{a}' and predicted_label = '{b}') as pred_{b.lower()}" for b in CLASSES) + " from scored" for a in CLASSES]))
def confusion_matrix(s, d):
    return metrics.confusion_matrix(V.scored(s, d))


REPORT_SQL = _union_all(
    [
        f"select '{a}' as label, {N[a]} as support, coalesce({TP[a]}::double / nullif({P[a]}, 0), 0) as precision, coalesce({TP[a]}::double / nullif({N[a]}, 0), 0) as recall,"
        f" coalesce(2.0::double * {TP[a]} / nullif({N[a]} + {P[a]}, 0), 0) as f1, coalesce(({P[a]} - {TP[a]})::double / nullif(count(*) - {N[a]}, 0), 0) as fpr from scored"
        for a in CLASSES
    ]
)


@query(f"select label, support, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, round(fpr, 6) as fpr from ({REPORT_SQL})")
def classification_report(s, d):
    return metrics.classification_report(V.scored(s, d))


@query(
    "select sum(support)::bigint as n, (select round(avg((label = predicted_label)::int), 6) from scored) as accuracy, "
    + ", ".join(f"round(sum({k}) / 3, 6) as macro_{k}, round(sum({k} * support) / sum(support), 6) as weighted_{k}" for k in ("precision", "recall", "f1"))
    + f" from ({REPORT_SQL})"
)
def macro_weighted_metrics(s, d):
    return metrics.overall(V.scored(s, d))


@query(f"select label, round(fpr, 6) as fpr from ({REPORT_SQL})")
def fpr_one_vs_rest(s, d):
    return metrics.classification_report(V.scored(s, d)).select("label", "fpr")


ERRORS_SQL = "count(*) filter (label = 'Normal' and predicted_label <> 'Normal')"


@query(f"select {ERRORS_SQL} as normal_as_attack, count(*) filter (label = 'DDoS' and predicted_label = 'Normal') as ddos_as_normal, count(*) filter (label = 'PortScan' and predicted_label = 'Normal') as portscan_as_normal, round({ERRORS_SQL}::double / {N['Normal']}, 6) as normal_fpr from scored")
def ids_error_counts(s, d):
    return metrics.error_counts(V.scored(s, d))


EXPERIMENT_SQL = """, experiments as (
  select f.source_file as name, round(avg((label = predicted_label)::int), 6) as macro_f1, round(avg(case when label = 'DDoS' then (predicted_label = 'DDoS')::int end), 6) as ddos_recall,
    round(avg(case when label = 'PortScan' then (predicted_label = 'PortScan')::int end), 6) as portscan_recall, round(avg(case when label = 'Normal' then (predicted_label <> 'Normal')::int end), 6) as normal_fpr,
    round(avg(confidence), 6) as latency
  from scored s join stored f using (flow_id) group by 1)
"""
EXPERIMENT_COLS = ["macro_f1", "ddos_recall", "portscan_recall", "normal_fpr", "latency"]


def _experiments(s, d) -> DataFrame:
    p = V.scored(s, d).join(V.stored_flows(s, d).select("flow_id", "source_file"), "flow_id")
    share = lambda label, ok: F.round(F.avg(F.when(F.col("label") == label, ok.cast("int"))), 6)
    pred = F.col("predicted_label")
    return p.groupBy(F.col("source_file").alias("name")).agg(
        F.round(F.avg((F.col("label") == pred).cast("int")), 6).alias("macro_f1"), share("DDoS", pred == "DDoS").alias("ddos_recall"),
        share("PortScan", pred == "PortScan").alias("portscan_recall"), share("Normal", pred != "Normal").alias("normal_fpr"), F.round(F.avg("confidence"), 6).alias("latency"),
    )


@query(EXPERIMENT_SQL + "select * from experiments order by macro_f1 desc, ddos_recall desc, portscan_recall desc, normal_fpr, latency, name = 'capture-1' desc, name limit 1")
def select_best_model(s, d):
    return metrics.select_best(_experiments(s, d), "capture-1")


DELTA_SQL = EXPERIMENT_SQL + _union_all([f"select '{c}' as metric, a.{c} as a, b.{c} as b, round(b.{c} - a.{c}, 6) as delta from experiments a, experiments b where a.name = 'capture-0' and b.name = 'capture-1'" for c in EXPERIMENT_COLS])


@query("select label, round((select count(*) from scored)::double / (3 * count(*)), 6) as weight from scored group by 1")
def class_weights(s, d):
    return ml.class_weights(V.scored(s, d), "label").select("label", *r6("weight"))


TRAIN = "flow_id % 5 <> 0"
MEDIAN_SQL = f"(select quantile_cont({FIN}, 0.5) from flows where {TRAIN})"


@query(f"select 'flow_duration' as column_name, round({MEDIAN_SQL}, 6) as median union all select 'packets', round(quantile_cont(packets, 0.5), 6) from flows where {TRAIN}")
def train_medians(s, d):
    return ml.medians(V.flows(s, d).where(TRAIN), ["flow_duration", "packets"]).select("column_name", *r6("median"))


@query(f"select seq, round(coalesce({FIN}, {MEDIAN_SQL}), 6) as flow_duration from flows")
def imputed_rows(s, d):
    f = V.flows(s, d)
    return ml.impute(f.select("seq", "flow_id", "flow_duration"), f.where(TRAIN), ["flow_duration"]).select("seq", *r6("flow_duration"))


@query(DELTA_SQL)
def model_delta(s, d):
    e = _experiments(s, d)
    return metrics.delta(e.where("name = 'capture-0'"), e.where("name = 'capture-1'"), EXPERIMENT_COLS)


@query("".join([EXPERIMENT_SQL, "select name, macro_f1 from experiments order by macro_f1 desc, name limit 1"]))
def best_cv_candidate(s, d):
    e = _experiments(s, d)
    return e.orderBy(F.desc("macro_f1"), "name").limit(1).select("name", "macro_f1")


def _side_sql(test: str) -> str:
    """The five metrics of the predictions for which `test` holds, on one row."""
    classes = ", ".join(f"('{c}')" for c in CLASSES)
    return (
        f"(with p as (select * from scored where {test}), per as (select c.label, (select count(*) from p where label = c.label and predicted_label = c.label)::double as tp,"
        f" (select count(*) from p where label = c.label)::double as n, (select count(*) from p where predicted_label = c.label)::double as said from (values {classes}) c(label)),"
        " f as (select label, n, case when said > 0 then tp / said else 0 end as pr, case when n > 0 then tp / n else 0 end as rc from per),"
        " g as (select *, case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0 end as f1 from f)"
        " select round((select avg((label = predicted_label)::int) from p), 6) as accuracy, round(avg(pr), 6) as macro_precision, round(avg(rc), 6) as macro_recall, round(avg(f1), 6) as macro_f1,"
        " round(sum(f1 * n) / sum(n), 6) as weighted_f1 from g)"
    )


EXPERIMENT_METRICS = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1"]


@query(f"select metric, a, b, round(b - a, 6) as delta from (unpivot {_side_sql('flow_id % 5 = 0')} on {', '.join(EXPERIMENT_METRICS)} into name metric value a) x join (unpivot {_side_sql('flow_id % 5 <> 0')} on {', '.join(EXPERIMENT_METRICS)} into name metric value b) y using (metric)")
def experiment_delta(s, d):
    p = V.scored(s, d)
    return metrics.delta(metrics.overall(p.where("flow_id % 5 = 0")), metrics.overall(p.where("flow_id % 5 <> 0")), EXPERIMENT_METRICS)


# -- preparation, splits


@query(SINGLE_SQL + "select seq, label from single")
def dedup_keep_first(s, d):
    return single(s, d).select("seq", "label")


@query("select source_ip, destination_ip, source_port, min(seq) as seq from flows group by 1, 2, 3")
def dedup_fingerprint(s, d):
    f = V.flows(s, d).withColumn("fp", C.identity("source_ip", "destination_ip", "source_port")).select("fp", "source_ip", "destination_ip", "source_port", "seq")
    return prepare.dedup_keep_first(f, ["seq"]).select("source_ip", "destination_ip", "source_port", "seq")


@query(
    SINGLE_SQL + "select 'raw' as stage, 'all' as label, count(*) as n from flows union all select 'scope', label, count(*) from labelled where label is not null group by 2"
    " union all select 'dedup', label, count(*) from single group by 2 union all select case when flow_id % 5 = 0 then 'test' else 'train' end, label, count(*) from single group by 1, 2"
)
def preparation_audit(s, d):
    split = single(s, d).withColumn("split", F.when(F.col("flow_id") % 5 == 0, "test").otherwise("train")).drop("raw_label").withColumnRenamed("label", "raw_label")
    return prepare.audit(V.flows(s, d), "raw_label", ORDER, KEY_IGNORE, split)


REMOVED = {c: LEAKAGE[c] for c in ("flow_id", "source_ip", "destination_ip")} | {"source_file": "source-file provenance"} | dict.fromkeys(("capture_time", "protocol"), "non-numeric")
KEPT = [c for c in COLUMNS if c not in REMOVED and c != "raw_label"]


@query(SINGLE_SQL + _union_all([f"select '{c}' as column_name, 'feature' as outcome, count(*) filter ({f'isinf({c})' if c in NUMERIC else 'false'}) as infinities from single" for c in KEPT]
                               + [f"select '{c}', '{why}', null from (select 1)" for c, why in REMOVED.items()]))
def preparation_columns(s, d):
    return prepare.column_audit(single(s, d).drop("raw_label").withColumnRenamed("label", "raw_label"), LEAKAGE, "raw_label")


@query(f"select true as label_present, count(distinct label) = 3 as all_classes, (select min(n) >= 2 and count(*) = 3 from (select count(*) as n from labelled where label is not null group by label)) as two_rows_per_class, true as numeric_features, count({FIN}) > 0 and count(packets) > 0 as no_empty_feature from labelled")
def preparation_guards(s, d):
    return prepare.guards(V.flows(s, d), "raw_label", ["flow_duration", "packets"])


QUOTA_SQL = """, per as (select label, count(*) as n from single group by 1),
share as (select label, n, n::double * {take} / sum(n) over () as exact, {take} as total from per),
quota as (select label, n, (floor(exact) + case when row_number() over (order by exact - floor(exact) desc, label) <= total - sum(floor(exact)) over () then 1 else 0 end)::bigint as quota from share),
ranked as (select seq, s.label, quota, row_number() over (partition by s.label order by md5(concat('42|', seq::varchar)), seq) - 1 as rk from single s join quota q on s.label = q.label)
"""


@query(SINGLE_SQL + QUOTA_SQL.format(take="ceil(0.2::double * sum(n) over ())") + "select seq, label, case when rk < quota then 'test' else 'train' end as split from ranked")
def stratified_split(s, d):
    return splits.stratified_split(single(s, d), "label", "seq").select("seq", "label", "split")


@query(SINGLE_SQL + QUOTA_SQL.format(take="least(500, sum(n) over ())") + "select seq, label from ranked where rk < quota")
def stratified_sample(s, d):
    return splits.stratified_sample(single(s, d), "label", "seq", 500).select("seq", "label")


@query(SINGLE_SQL + QUOTA_SQL.format(take="least(500, sum(n) over ())") + "select seq, label, (rk % 5)::int as fold from ranked")
def stratified_folds(s, d):
    return splits.stratified_folds(single(s, d), "label", "seq").select("seq", "label", "fold")


BLOCK_SQL = SINGLE_SQL + """, placed as (
  select *, row_number() over (partition by source_file, label order by seq) - 1 as rk, count(*) over (partition by source_file, label) as cnt from single),
blocked as (
  select seq, source_file, label, cnt, case when cnt <= {size} then (rk >= greatest(1, floor(cnt * (1 - 0.2::double))))::bigint else (rk // {size})::bigint end as block,
    case when cnt <= {size} then case when cnt > 1 then 2 else 1 end else ceil(cnt / {size}.0::double)::bigint end as n_blocks from placed),
cut as (
  select *, greatest(1, ceil(n_blocks * 0.2::double))::bigint as n_test_blocks, concat(source_file, '|', label, '|block-', block::varchar) as scenario_group from blocked),
sides as (select *, case when block >= n_blocks - n_test_blocks then 'test' else 'train' end as split from cut)
""".format(size=200)


def _blocks(s, d):
    return splits.blocks(single(s, d), "label", "seq", 200)


@query(BLOCK_SQL + "select seq, scenario_group, block from sides")
def scenario_blocks(s, d):
    return _blocks(s, d).select("seq", "scenario_group", "block")


@query(BLOCK_SQL + "select seq, label, split from sides")
def scenario_split(s, d):
    return _blocks(s, d).select("seq", "label", "split")


@query(BLOCK_SQL + "select source_file, label, count(*) as n, max(n_blocks)::bigint as n_blocks, max(n_test_blocks) as n_test_blocks from sides group by 1, 2")
def scenario_strata(s, d):
    return splits.strata(_blocks(s, d), "label")


@query(BLOCK_SQL + "select scenario_group from sides where split = 'train' intersect select scenario_group from sides where split = 'test'")
def split_overlap(s, d):
    return splits.overlap(_blocks(s, d), "scenario_group")


@query(BLOCK_SQL + "select (select count(*) from (select 1 from sides group by source_file, label having count(*) < 400)) as small_strata,"
       " (select count(*) from (select scenario_group from sides group by 1 having count(distinct split) > 1)) as shared_groups,"
       " (select 6 - count(*) from (select distinct split, label from sides)) as missing_sides")  # fmt: skip
def scenario_guards(s, d):
    return splits.block_guards(_blocks(s, d), "label", CLASSES, least=400)


@query(f"select label from {CLASS_DIM} where label not in (select label from labelled where label is not null and label <> 'PortScan')")
def missing_classes(s, d):
    return splits.missing_classes(single(s, d).where("label <> 'PortScan'"), "label", CLASSES)


@query("select flow_id, source_file from flows union all select flow_id, 'again' from flows where seq % 2 = 1")
def union_captures(s, d):
    f = V.flows(s, d).select("flow_id", "source_file")
    return f.unionByName(V.flows(s, d).where("seq % 2 = 1").select(F.lit("again").alias("source_file"), "flow_id"))


# -- headers


def _header_names() -> list[str]:
    back = {t: a for a, t in FEATURE_ALIASES.items()}
    out = []
    for i, f in enumerate(FEATURES):
        if f in REPRODUCED:
            continue
        out.append(back[f] if f in back and i % 2 == 0 else f.replace("_", " ").title() if i % 3 == 0 else f)
    return [*out, "Src IP", "Mystery Column", "Label"]


HEADER_NAMES = _header_names()


def _headers(s, d) -> DataFrame:
    files = V.table(s, d, "events").select((F.col("user_id") % 5).alias("f")).distinct()
    dim = s.createDataFrame(list(enumerate(HEADER_NAMES)), "pos long, name string")
    f, pos = F.col("f"), F.col("pos")
    out = files.crossJoin(F.broadcast(dim)).where(~((f > 0) & ((pos + f) % 29 == 0)))
    again = files.where("f = 3").crossJoin(F.broadcast(dim.where("pos in (5, 6)"))).withColumn("pos", F.col("pos") + 200)
    return out.union(again).select(F.concat(F.lit("file-"), F.col("f").cast("string")).alias("file"), "pos", "name")


def _values(rows: list[tuple], names: str) -> str:
    return "(values " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::bigint" for x in r) + ")" for r in rows) + f") {names}"


NAMES = "norm as (select *, regexp_replace(replace(lower(trim(name)), '/', '_'), '\\s+', '_', 'g') as normalized from headers)"
HEADERS_SQL = f"""with dim as (select * from {_values(list(enumerate(HEADER_NAMES)), 't(pos, name)')}), files as (select distinct user_id % 5 as f from events),
headers as (select concat('file-', f::varchar) as file, pos, name from files, dim where not (f > 0 and (pos + f) % 29 = 0) union all select 'file-3', pos + 200, name from files, dim where f = 3 and pos in (5, 6)),
{NAMES}, aliases as (select * from {_values(list(FEATURE_ALIASES.items()), 't(alias, target)')}), required as (select * from {_values(list(enumerate(FEATURES)), 't(ord, feature)')}),
mapped as (select n.*, coalesce(a.target, n.normalized) as mapped, a.alias is not null as is_alias from norm n left join aliases a on n.normalized = a.alias),
have as (select distinct file, mapped as feature from mapped), rules as (select * from {_values(list(REPRODUCED.items()), 't(target, source)')}),
have_more as (select * from have union select h.file, r.target from have h join rules r on h.feature = r.source),
need as (select f.file, ord, feature from (select distinct file from headers) f, required),
dups as (select file, 'raw' as kind, name, count(*) as n from mapped group by 1, 2, 3 having count(*) > 1 union all select file, 'mapped', mapped, count(*) from mapped group by 1, 2, 3 having count(*) > 1),
exact as (select n.file, n.feature from need n where exists (select 1 from headers h where h.file = n.file and h.name = n.feature)),
matches as (select *, 'exact' as kind from exact union all
  (select n.file, n.feature, 'normalized' from need n where exists (select 1 from norm h where h.file = n.file and h.normalized = n.feature) and not exists (select 1 from exact e where e.file = n.file and e.feature = n.feature)) union all
  (select n.file, n.feature, 'alias' from need n where exists (select 1 from mapped h where h.file = n.file and h.mapped = n.feature and h.is_alias)))
"""
REQUIRED = list(FEATURES)


@query(HEADERS_SQL + "select file, ord, feature from need n where not exists (select 1 from have h where h.file = n.file and h.feature = n.feature)", views=False)
def compat_missing(s, d):
    return audit.compat_missing(_headers(s, d), REQUIRED, STRICT)


KNOWN_SQL = ", ".join(f"'{x}'" for x in METADATA_ALIASES)


@query(HEADERS_SQL + f"select distinct file, normalized from norm where normalized not in (select feature from required) and normalized not in (select alias from aliases) and normalized not in ({KNOWN_SQL})", views=False)
def compat_extra(s, d):
    return audit.compat_extra(_headers(s, d), REQUIRED)


@query(HEADERS_SQL + "select * from matches", views=False)
def compat_matches(s, d):
    return audit.compat_matches(_headers(s, d), REQUIRED)


@query(HEADERS_SQL + "select * from dups", views=False)
def compat_duplicates(s, d):
    return audit.compat_duplicates(_headers(s, d))


def _verdict_sql(have: str) -> str:
    lost = f"(select count(*) from need n where n.file = f.file and not exists (select 1 from {have} h where h.file = n.file and h.feature = n.feature))"
    twice = "(select count(*) from dups u where u.file = f.file and u.kind = 'mapped')"
    has = lambda x: f"exists (select 1 from {have} h where h.file = f.file and h.feature = '{x}')"
    return f"select f.file, {lost} as n_missing, {twice} as n_duplicates, {has('fwd_header_length')} <> {has('fwd_header_length.1')} as incomplete_pair, {lost} = 0 and {twice} = 0 as compatible from (select distinct file from headers) f"


@query(HEADERS_SQL + _verdict_sql("have_more"), views=False)
def compat_verdict(s, d):
    return audit.compat_verdict(_headers(s, d), REQUIRED, REPRODUCTION)


def _policy_sql(policy: str, have: str, new: str) -> str:
    kind = lambda k: f"(select count(*) from matches m where m.file = v.file and m.kind = '{k}')"
    return f"select v.file, '{policy}' as policy, {kind('exact')} as n_exact, {kind('alias')} as n_alias, {new} as n_reproduced, v.n_missing, 78 - v.n_missing as n_resolved, v.compatible from ({_verdict_sql(have)}) v"


NEW_SQL = "(select count(*) from have_more m where m.file = v.file and not exists (select 1 from have h where h.file = m.file and h.feature = m.feature))"


@query(HEADERS_SQL + _policy_sql(STRICT, "have", "0::bigint") + " union all " + _policy_sql(REPRODUCTION, "have_more", NEW_SQL), views=False)
def compat_policy_summary(s, d):
    return audit.policy_summary(_headers(s, d), REQUIRED)


@query(
    HEADERS_SQL + "select n.file, n.feature, case when exists (select 1 from matches m where m.file = n.file and m.feature = n.feature and m.kind = 'alias') then 'alias_verified'"
    " when exists (select 1 from have h where h.file = n.file and h.feature = n.feature) then 'exact' when exists (select 1 from have_more h where h.file = n.file and h.feature = n.feature) then 'artifact_reproduced'"
    " when n.feature in (select target from rules) then 'incompatible' else 'unresolved' end as status from need n", views=False
)
def mapping_audit(s, d):
    return audit.mapping_audit(_headers(s, d), REQUIRED, REPRODUCTION)


@query(HEADERS_SQL + "select feature, 'left' as side from have where file = 'file-0' and feature not in (select feature from have where file = 'file-1') union all select feature, 'right' from have where file = 'file-1' and feature not in (select feature from have where file = 'file-0')", views=False)
def feature_set_diff(s, d):
    have = audit.available(_headers(s, d), REQUIRED, STRICT)
    return audit.feature_set_diff(have.where("file = 'file-0'"), have.where("file = 'file-1'"), "feature")


# -- quality of stored tables and runs


@query(
    "select 'predicted_label' as rule, prediction_id as id from scored where flow_id % 40 = 0 union all select 'severity', alert_id from alerts where alert_id % 30 = 0"
    " union all select 'status', alert_id from alerts where alert_id % 50 = 0 union all select 'one_prediction_per_flow', flow_id from scored where flow_id % 60 = 0"
)
def constraint_violations(s, d):
    p, a = V.scored(s, d), V.alerts(s, d)
    bad = p.withColumn("predicted_label", F.when(F.col("flow_id") % 40 == 0, "Bot").otherwise(F.col("predicted_label")))
    twice = bad.union(p.where("flow_id % 60 = 0"))
    a = a.withColumn("severity", F.when(F.col("alert_id") % 30 == 0, F.lit(None)).otherwise(F.col("severity"))).withColumn("status", F.when(F.col("alert_id") % 50 == 0, "LOST").otherwise(F.col("status")))
    return audit.constraint_violations(twice, a)


@query(
    "select 'unknown_label' as problem, flow_id as id from scored where flow_id % 40 = 1 union all select 'missing_field', flow_id from scored where flow_id % 40 = 2"
    " union all select 'no_result', flow_id from stored where flow_id not in (select flow_id from scored)"
)
def result_contract(s, d):
    i = F.col("flow_id")
    p = V.scored(s, d).withColumn("predicted_label", F.when(i % 40 == 1, F.lit(None)).otherwise(F.col("predicted_label")))
    p = p.withColumn("confidence", F.when(i % 40 == 2, F.lit(None)).otherwise(F.col("confidence"))).withColumn("model_version", F.lit("v1"))
    return audit.result_contract(V.stored_flows(s, d), p, "flow_id")


TAGGED_SQL = "select case when flow_id % 9 in (3, 4) then 'rejected' when rn > 1 then 'duplicate' else 'accepted' end as disposition, source_file from (select flow_id, source_file, seq, row_number() over (partition by flow_id order by seq) as rn from flows)"


def _tagged(s, d) -> DataFrame:
    from pyspark.sql import Window

    again = F.row_number().over(Window.partitionBy("flow_id").orderBy("seq")) > 1
    kind = F.when((F.col("flow_id") % 9).isin(3, 4), "rejected").when(F.col("_again"), "duplicate").otherwise("accepted")
    return V.flows(s, d).withColumn("_again", again).select(kind.alias("disposition"), "source_file")


@query(
    f"select t.*, coalesce(successful, 0) as successful, coalesce(normal, 0) as normal, coalesce(ddos, 0) as ddos, coalesce(portscan, 0) as portscan from (select source_file, count(*) as extracted,"
    f" count(*) filter (disposition = 'accepted') as submitted, count(*) filter (disposition = 'duplicate') as duplicates, count(*) filter (disposition = 'rejected') as rejected from ({TAGGED_SQL}) group by 1) t"
    " left join (select source_file, count(*) as successful, count(*) filter (predicted_label = 'Normal') as normal, count(*) filter (predicted_label = 'DDoS') as ddos,"
    " count(*) filter (predicted_label = 'PortScan') as portscan from scored join stored using (flow_id) where flow_id % 9 not in (3, 4) group by 1) p using (source_file)"
)
def session_counters(s, d):
    p = V.scored(s, d).where(~(F.col("flow_id") % 9).isin(3, 4)).join(V.stored_flows(s, d).select("flow_id", "source_file"), "flow_id")
    return store.session_counters(_tagged(s, d), p, "source_file")


@query(f"select disposition, count(*) as n from ({TAGGED_SQL}) group by 1")
def ingestion_counters(s, d):
    return store.ingestion_counters(_tagged(s, d))


@query(
    f"select source_file, 1::bigint as segments, count(*) as extracted, 78::bigint as required, 78::bigint as produced, count(*) filter (disposition = 'accepted') as successful,"
    f" count(*) filter (disposition = 'rejected' and source_file <> 'capture-1') as failed, count(*) filter (disposition = 'accepted') as persisted,"
    f" case when count(*) filter (disposition = 'rejected' and source_file <> 'capture-1') = 0 then 'completed' else 'failed' end as status from ({TAGGED_SQL}) group by 1"
)
def run_gate(s, d):
    is_ = lambda k: F.count_if(F.col("disposition") == k)
    counted = _tagged(s, d).groupBy("source_file").agg(
        F.lit(1).cast("long").alias("segments"), F.count("*").alias("extracted"), F.lit(len(FEATURES)).cast("long").alias("required"), F.lit(78).cast("long").alias("produced"),
        is_("accepted").alias("successful"), F.count_if((F.col("disposition") == "rejected") & (F.col("source_file") != "capture-1")).alias("failed"), is_("accepted").alias("persisted"),
    )
    return store.run_gate(counted)


@query(
    "select f.source_file, count(*) as n, count(*) filter (predicted_label <> 'Normal') as attacks, round(count(*) filter (predicted_label = 'Normal')::double / count(*), 6) as normal_rate,"
    " round(count(*) filter (predicted_label <> 'Normal')::double / count(*), 6) as candidate_fpr, count(a.alert_id) as alerts from scored s join stored f using (flow_id) left join alerts a using (prediction_id) group by 1"
)
def session_rates(s, d):
    p = V.scored(s, d).join(V.stored_flows(s, d).select("flow_id", "source_file"), "flow_id")
    return store.session_rates(p, V.alerts(s, d), "source_file")
