"""Registered queries that write, train or stream: their inputs are the driver's tables, or files written from them."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowquarry.functions import columns as C
from flowquarry.operators import metrics, splits, store
from flowquarry.plans import ml
from flowquarry.plans import views as V
from flowquarry.plans.shared import new_folder
from flowquarry.queries import SINGLE_SQL, _number_text, query, r6, single
from flowquarry.schema import CLASSES
from flowquarry.sources import flows as S
from flowquarry.streaming import segments as G
from flowquarry.streaming import source as N

CSV_COLUMNS = ["flow_id", "source_ip", "flow_duration", "packets", "label"]


def _csv(s: SparkSession, d: str) -> list[str]:
    """Two captures as CSV files of one name each, written from the flow view."""
    base = new_folder(s, "csv")
    f = V.flows(s, d).where("seq % 2 = 0").select("flow_id", "source_ip", "flow_duration", "packets", F.col("raw_label").alias(" Label "), F.concat(F.lit("kind, "), "protocol").alias("Attack Category"))
    for k in (0, 1):
        f.where(F.col("flow_id") % 2 == k).repartitionByRange(4, "flow_id").sortWithinPartitions("flow_id").write.option("header", True).csv(f"{base}/capture-{k}")
    return [f"{base}/capture-0", f"{base}/capture-1"]


@query("select concat('kind, ', protocol) as attack_category, count(*) as n, count(raw_label) as labelled, round(sum(packets), 3) as packets, count(distinct flow_id % 2) as captures from flows where seq % 2 = 0 group by 1")
def csv_scan_roundtrip(s, d):
    f = S.scan_csv(s, _csv(s, d))
    return f.groupBy("attack_category").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.round(F.sum("packets"), 3).alias("packets"), F.countDistinct("file_pos").alias("captures"))


@query("select count(distinct 1) as n_headers, count(distinct 1) <= 1 as equal, count(*) > 0 as filled from flows")
def header_schema_check(s, d):
    named = S.headers(s, _csv(s, d))
    return S.header_check(named).select("n_headers", "equal", (F.col("n_files") > 0).alias("filled"))


@query("select ordinal_position::int - 1 as pos, column_name as name from (select 1 as ordinal_position, 'flow_id' as column_name union all select 2, 'source_ip' union all select 3, 'flow_duration' union all select 4, 'packets' union all select 5, 'Label' union all select 6, 'Attack Category')")
def header_columns(s, d):
    return S.headers(s, _csv(s, d)).select("pos", F.trim("name").alias("name")).distinct()


@query()
def dataset_manifest(s, d):
    return S.manifest(s, d, "*.parquet")[1]


@query("select flow_id % 2 as capture, count(*) as n, min(flow_id) as first_id, max(flow_id) as last_id from flows where seq % 2 = 0 group by 1")
def row_sequence(s, d):
    """Captures were written in the order of flow_id: the stored sequence's first and last rows are those of the least and largest id."""
    f = S.ingest(s, _csv(s, d), new_folder(s, "ingested"), text={"source_ip", "label", "attack_category"})
    at = F.struct("file_path", "block_start", "row_seq")
    f = f.withColumn("flow_id", F.col("flow_id").cast("long"))
    return f.groupBy(F.col("file_pos").cast("long").alias("capture")).agg(F.count("*").alias("n"), F.min_by("flow_id", at).alias("first_id"), F.max_by("flow_id", at).alias("last_id"))


@query("select prediction_id, predicted_label, 7 as batch_id from scored")
def scored_flows_write(s, d):
    path, p = new_folder(s, "scored"), V.scored(s, d).select("prediction_id", "predicted_label")
    S.write_scored(p, path, 7)
    S.write_scored(p, path, 7)  # a batch that runs again replaces itself
    return s.read.parquet(path)


# -- training

#: Rows that a search sees at most, and its folds.
TUNING_ROWS, FOLDS = 50_000, 5
FEATURES = ["flow_duration", "packets", "fwd_header_length", "value_per_packet", "destination_port"]


def _training(s, d) -> DataFrame:
    """Flows in scope with features that tell the classes apart, in part; a fixed order, split and folds. Queries of a session share the table."""

    def make():
        f = single(s, d)
        shift = F.when(F.col("label") == "DDoS", 40.0).when(F.col("label") == "PortScan", 90.0).otherwise(0.0)
        f = f.withColumn("value_per_packet", shift + C.finite("flow_duration") / (1 + F.col("packets")))
        f = ml.with_index(splits.stratified_split(f, "label", "seq"), "label")
        path = new_folder(s, "training")  # written once: every fit reads it
        f.select("seq", "label", "label_index", "split", "source_file", *FEATURES).repartitionByRange("seq").sortWithinPartitions("seq").write.parquet(path)
        return s.read.parquet(path)

    return _once(s, d, "training", make)


_FOUND: dict[tuple, object] = {}


def _once(s, d, name: str, make):
    """What make() gives, once per session and content of the table that the flows come from."""
    e = V.table(s, d, "events")
    content = e.agg(F.count("*"), F.bit_xor(F.xxhash64(*e.columns)), F.sum(F.xxhash64(*e.columns).cast("decimal(38,0)"))).first()
    key = (s.sparkContext.applicationId, name, *content)
    if key not in _FOUND:
        _FOUND[key] = make()
    return _FOUND[key]


def _fitted(s, d):
    def make():
        train = _training(s, d)
        return train, ml.fit(train.where("split = 'train'"), FEATURES)

    return _once(s, d, "baseline", make)


@query()
def rf_baseline_metrics(s, d):
    rows, model = _fitted(s, d)
    return metrics.overall(ml.named_predictions(model.transform(rows.where("split = 'test'"))))


@query()
def rf_scenario_metrics(s, d):
    rows = splits.blocks(_training(s, d).drop("split"), "label", "seq", 200)
    model = ml.fit(rows.where("split = 'train'"), FEATURES)
    return metrics.classification_report(ml.named_predictions(model.transform(rows.where("split = 'test'"))))


def _search(s, d) -> DataFrame:
    """The search's results, written; queries that ask for them in a session share one search."""

    def make():
        rows = _training(s, d).where("split = 'train'")
        path, out = new_folder(s, "sample"), new_folder(s, "search")
        splits.stratified_folds(splits.stratified_sample(rows, "label", "seq", TUNING_ROWS), "label", "seq", FOLDS).write.parquet(path)
        ml.search(s.read.parquet(path), FEATURES).write.parquet(out)
        return s.read.parquet(out)

    return _once(s, d, "search", make)


@query()
def cv_results(s, d):
    return ml.cv_results(_search(s, d))


@query(f"select {ml.CANDIDATES}::bigint as candidates, {FOLDS}::bigint as folds, {ml.CANDIDATES * FOLDS}::bigint as results, true as in_range, true as best_is_largest, count(*) > 0 as filled from flows")
def cv_contract(s, d):
    """What must hold of the search: every candidate on every fold, scores between 0 and 1, and the best candidate has the largest mean."""
    found = _search(s, d)
    means = ml.cv_results(found)
    best = ml.best_candidate(means).select(F.col("mean_test_f1").alias("best"))
    counts = found.agg(F.countDistinct("candidate").alias("candidates"), F.countDistinct("fold").alias("folds"), F.count("*").alias("results"), F.min(F.col("test_f1").between(0, 1) & F.col("train_f1").between(0, 1)).alias("in_range"))
    largest = means.agg(F.max("mean_test_f1").alias("most"))
    return counts.crossJoin(best).crossJoin(largest).select("candidates", "folds", "results", "in_range", (F.col("best") == F.col("most")).alias("best_is_largest"), (F.col("results") > 0).alias("filled"))  # one row each


@query()
def best_cv_result(s, d):
    """The candidate that the search takes, of the table of results."""
    return ml.best_candidate(ml.cv_results(_search(s, d)))


@query()
def rf_tuned_cv(s, d):
    """Search on a sample, refit the best on all training rows, evaluate once on the test rows."""
    best = ml.best_candidate(ml.cv_results(_search(s, d))).first()
    params = ml.candidates(ml.SPACE, ml.CANDIDATES)[best["candidate"]]
    rows = _training(s, d)
    model = ml.fit(rows.where("split = 'train'"), FEATURES, **params)
    return metrics.overall(ml.named_predictions(model.transform(rows.where("split = 'test'"))))


SCORED_SQL = "select flow_id, 'v1' as model_version, 'label,protocol' as ignored, true as named, true as best, true as same from stored where flow_id % 3 = 1"


@query(SCORED_SQL)
def score_contract(s, d):
    """The scoring contract over stored rows: features in any order, other columns named as ignored, the label the likeliest class, and both ways of scoring alike."""
    _, model = _fitted(s, d)
    f = V.flows(s, d).where("seq % 2 = 0 and flow_id % 3 = 1")
    batch = f.select("protocol", "packets", F.lit("x").alias("label"), "flow_id", "destination_port", F.col("flow_duration"), (F.col("flow_duration") / (1 + F.col("packets"))).alias("value_per_packet"), "fwd_header_length")
    out = ml.score_batch(model, batch, "v1", ["flow_id"])
    plain = ml.score_by_pipeline(model, batch, "v1").select("flow_id", F.col("predicted_label").alias("other"), F.col("confidence").alias("_c"))
    met = out.join(plain, "flow_id")
    ignored = F.array_join(F.array_sort("ignored_features"), ",")
    return met.select(
        "flow_id", "model_version", ignored.alias("ignored"), F.col("predicted_label").isin(*CLASSES).alias("named"),
        (F.col("confidence") == F.array_max(F.map_values("probabilities"))).alias("best"), ((F.col("predicted_label") == F.col("other")) & (F.abs(F.col("confidence") - F.col("_c")) < 1e-12)).alias("same"),
    )


@query()
def score_flows(s, d):
    rows, model = _fitted(s, d)
    out = ml.score(model, rows.drop("label_index"), "v1")
    return out.select("seq", "predicted_label", *r6("confidence"), "model_version")


@query(SINGLE_SQL + "select seq, 1::double as total, true as is_largest from single")
def probability_map(s, d):
    """What must hold of every row's probabilities: they add up to 1, and the confidence is the largest."""
    rows, model = _fitted(s, d)
    out = ml.score(model, rows, "v1")
    total = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, x: a + x)
    return out.select("seq", F.round(total, 6).alias("total"), (F.col("confidence") == F.array_max(F.map_values("probabilities"))).alias("is_largest"))


@query()
def feature_importance_topk(s, d):
    _, model = _fitted(s, d)
    return ml.importances(s, model, FEATURES).orderBy(F.desc("importance"), "feature").limit(20)


@query()
def publish_model(s, d):
    """Save the whole pipeline, register it with its macro F1 on the test rows and the hash of its files, and make it the only active one."""
    rows, model = _fitted(s, d)
    path = new_folder(s, "model")
    model.write().overwrite().save(path)
    reached = ml.MacroF1().evaluate(model.transform(rows.where("split = 'test'")))
    _, whole = S.manifest(s, path)
    new = whole.select(F.lit("v4").alias("model_version"), F.lit("forest").alias("model_name"), F.lit(reached).alias("macro_f1"), F.col("sha256").alias("files_sha256"))
    return store.model_upsert(V.models(s).drop("model_id"), new)


@query()
def model_integrity(s, d):
    """Whether a saved pipeline's files still hash as its stored record says: as it was saved, and after a file was added."""
    _, model = _fitted(s, d)
    path, record = new_folder(s, "model"), new_folder(s, "record")
    model.write().overwrite().save(path)
    S.manifest(s, path)[1].select("sha256", F.lit(",".join(FEATURES)).alias("features")).write.parquet(record)
    known = s.read.parquet(record).first()  # one row
    features = ",".join(PipelineModel.load(path).stages[0].getInputCols())

    def state(name: str) -> tuple[str, bool, bool]:
        return name, S.manifest(s, path)[1].first()["sha256"] == known["sha256"], features == known["features"]

    saved = state("saved")
    s.range(1).write.json(f"{path}/added")
    return s.createDataFrame([saved, state("changed")], "state string, same_files boolean, same_features boolean")


# -- streams


def _segments(s, d, name: str, df: DataFrame, files: int = 3) -> str:
    path = new_folder(s, name)
    df.repartition(files).write.parquet(path)
    return path


def _stream(s, d, name: str, df: DataFrame) -> DataFrame:
    return G.read_segments(s, _segments(s, d, name, df), df.schema, "session-1", "parquet")


@query("select count(*) as n, 1::bigint as sessions from stored")
def stream_segments(s, d):
    out = G.drain(_stream(s, d, "seg", V.stored_flows(s, d)), new_folder(s, "out"), new_folder(s, "ck"))
    return out.agg(F.count("*").alias("n"), F.countDistinct("capture_session_id").alias("sessions"))


@query("select source_file, count(*) as n, sum(flow_id)::bigint as ids, round(sum(packets), 3) as packets, 1::bigint as sessions from stored group by 1")
def stream_csv_segments(s, d):
    """The segments as CSV files with headers, one a batch."""
    f, path = V.stored_flows(s, d).select("flow_id", "source_file", "packets"), new_folder(s, "segcsv")
    f.repartition(3).write.option("header", True).csv(path)
    out = G.drain(G.read_segments(s, path, f.schema, "session-1"), new_folder(s, "out"), new_folder(s, "ck"))
    return out.groupBy("source_file").agg(F.count("*").alias("n"), F.sum("flow_id").alias("ids"), F.round(F.sum("packets"), 3).alias("packets"), F.countDistinct("capture_session_id").alias("sessions"))


@query("select distinct flow_id from flows")
def stream_dedup(s, d):
    f = V.flows(s, d).select("flow_id", "capture_time", "seq")
    out = G.drain(G.dedup(_stream(s, d, "dup", f), "flow_id", "capture_time", "60 days"), new_folder(s, "out"), new_folder(s, "ck"))
    return out.select("flow_id")


@query("select count(*) as n, count(distinct source_ip) as accepted from stored")
def stream_fifo_dedup(s, d):
    f = V.stored_flows(s, d).select(F.col("flow_id").alias("seq"), F.col("source_ip").alias("fingerprint"), "source_file")
    with G.rocksdb(s):
        captures = _stream(s, d, "fifo", f).withColumn("capture_session_id", F.col("source_file"))
        out = G.drain(G.fifo_dedup(captures), new_folder(s, "out"), new_folder(s, "ck"))
    return out.agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"))


LAST = "(select max(prediction_time) from scored)"


@query(
    "select strftime(date_trunc('minute', prediction_time), '%Y-%m-%d %H:%M:%S') as bucket, count(*) filter (predicted_label = 'Normal') as normal, count(*) filter (predicted_label = 'DDoS') as ddos,"
    f" count(*) filter (predicted_label = 'PortScan') as portscan from scored group by date_trunc('minute', prediction_time) having date_trunc('minute', prediction_time) + interval 1 minute <= {LAST} - interval 1 minute"
)
def stream_timeline(s, d):
    """Minutes that the watermark has passed."""
    p = V.scored(s, d).select("prediction_time", "predicted_label")
    path = new_folder(s, "time")
    p.write.parquet(path)
    # all segments are one batch, in which no row is late
    out = G.drain(G.timeline(G.read_segments(s, path, p.schema, "session-1", "parquet", per_batch=100_000)), new_folder(s, "out"), new_folder(s, "ck"))
    return out.withColumn("bucket", C.time_text("bucket"))


@query("select f.source_file, count(*) as n, count(*) filter (predicted_label <> 'Normal') as attacks from scored s join stored f using (flow_id) group by 1")
def stream_session_counts(s, d):
    p = V.scored(s, d).join(V.stored_flows(s, d).select("flow_id", "source_file"), "flow_id").select("source_file", "predicted_label")
    return G.drain_latest(G.session_counts(_stream(s, d, "sess", p), "source_file"), new_folder(s, "out"), new_folder(s, "ck"))


NEED = ["flow_duration", "packets"]


def _scoring_stream(s, d, only: str = "true") -> str:
    f = V.stored_flows(s, d).select(F.col("flow_id"), _number_text().alias("Flow Duration"), F.col("packets").cast("string").alias("Packets")).where(only)
    label = F.when(F.col("flow_id") % 3 == 0, "DDoS").otherwise("Normal")
    scorer = lambda df: df.select(F.col("flow_id").alias("prediction_id"), label.alias("predicted_label"), F.lit(0.9).alias("confidence"), F.lit(None).cast("timestamp").alias("prediction_time"), "capture_session_id")
    path = new_folder(s, "run")
    keep = ("flow_id", "segment", "segment_row", "capture_session_id")
    G.score_batches(_stream(s, d, "score", f), NEED, scorer, path, new_folder(s, "ck"), keep).awaitTermination()
    return path


@query("select flow_id, 'not numeric: flow_duration' as reject_reason from stored where flow_id % 9 in (3, 4)")
def stream_rejects(s, d):
    return G.committed(s, _scoring_stream(s, d), "rejects").select("flow_id", "reject_reason")


@query("select flow_id as alert_id, 'HIGH' as severity from stored where flow_id % 9 not in (3, 4) and flow_id % 3 = 0")
def stream_score(s, d):
    return G.alerts(s, _scoring_stream(s, d)).select("alert_id", "severity")


@query("select 'session-1' as capture_session_id, count(*) filter (flow_id % 9 not in (3, 4)) as scored, count(*) filter (flow_id % 9 in (3, 4)) as rejected, 'failed' as status from stored")
def stream_session_status(s, d):
    return G.session_status(s, _scoring_stream(s, d))


@query("select 'session-1' as capture_session_id, count(*) as scored, 0::bigint as rejected, 'completed' as status from stored where flow_id % 9 not in (3, 4)")
def stream_session_completed(s, d):
    """A session without rejects."""
    return G.session_status(s, _scoring_stream(s, d, "flow_id % 9 not in (3, 4)"))


@query(
    "select count(*) as extracted, count(*) filter (flow_id % 9 not in (3, 4)) as scored, count(*) filter (flow_id % 9 in (3, 4)) as rejected, count(*) filter (flow_id % 9 not in (3, 4) and flow_id % 3 <> 0) as normal,"
    " count(*) filter (flow_id % 9 not in (3, 4) and flow_id % 3 = 0) as ddos, 0::bigint as portscan from stored"
)
def stream_counters(s, d):
    """Counters that were observed while the stream wrote its rows."""
    return G.observed_counters(s, _scoring_stream(s, d))


@query(
    "select concat('segment-', lpad((2 - flow_id % 3)::varchar, 6, '0'), '.csv') as segment, row_number() over (partition by flow_id % 3 order by flow_id) - 1 as segment_row, flow_id,"
    " count(*) over (order by 2 - flow_id % 3, flow_id) - 1 as place from stored"
)
def stream_segments_by_name(s, d):
    """Segments in the order of their names, which is not that of their writing, with each row's number in its file."""
    base, f = new_folder(s, "named"), V.stored_flows(s, d).select("flow_id", "packets")
    for k in range(3):
        part = f.where(F.col("flow_id") % 3 == k)
        S.write_segment(part, f"{base}/in", f"segment-{2 - k:06d}.csv", "flow_id")
    stream = N.by_name(s, f"{base}/in", ["flow_id", "packets"], "session-1")
    out = G.drain(stream, f"{base}/out", f"{base}/ck")
    # seq tells the order; places are counted per segment and added up
    before = out.groupBy(F.col("segment").alias("_s")).agg(F.count("*").alias("_n"))
    before = before.select("_s", (F.sum("_n").over(Window.orderBy("_s")) - F.col("_n")).alias("_before"))  # one row a segment
    rows = out.join(before, F.col("segment") == F.col("_s"))
    return rows.select("segment", "segment_row", F.col("flow_id").cast("long").alias("flow_id"), (F.col("_before") + F.col("seq") % (1 << 32)).alias("place"))


@query(
    "select 1 - flow_id % 2 as capture, row_number() over (partition by flow_id % 2 order by flow_id) - 1 as row_seq, flow_id, concat(flow_id % 10, case when flow_id % 4 < 2 then 'd' else 'f' end) as code,"
    " case when flow_id % 5 = 0 then 'nan' when flow_id % 5 = 1 then 'inf' when flow_id % 5 = 2 then 'blank' else 'number' end as kind, case when flow_id % 5 > 2 then flow_id / 4 end as amount from stored"
)
def csv_numbers(s, d):
    """A column of texts that a lenient reader takes for numbers stays text; row numbers are those of the file."""
    f = V.stored_flows(s, d).select("flow_id")
    i = F.col("flow_id")
    amount = F.when(i % 5 == 0, "NaN").when(i % 5 == 1, "inf").when(i % 5 == 2, " ").otherwise((i / 4).cast("string"))
    f = f.select(i, F.concat((i % 10).cast("string"), F.when(i % 4 < 2, "d").otherwise("f")).alias("code"), amount.alias("amount"))
    base = new_folder(s, "numbers")
    for k in (1, 0):
        S.write_segment(f.where(i % 2 == k), f"{base}/{1 - k}", "flows.csv", "flow_id")
    rows = S.scan_csv(s, [f"{base}/0", f"{base}/1"])
    a = F.col("amount")
    kind = F.when(a.isNull(), "blank").when(F.isnan(a), "nan").when(F.abs(a) == float("inf"), "inf").otherwise("number")
    return rows.select(F.col("file_pos").cast("long").alias("capture"), "row_seq", F.col("flow_id").cast("long").alias("flow_id"), "code", kind.alias("kind"), C.finite("amount").alias("amount"))


@query(
    "select model_version, model_name, round(macro_f1, 6) as macro_f1, false as is_active from models where model_version <> 'v2' union all"
    " select 'v4', 'forest', round(avg((label = predicted_label)::int), 6), false from scored union all select 'v2', 'forest-again', round(avg((label = predicted_label)::int), 6), true from scored"
)
def registry_published(s, d):
    """The registry as stored versions: a new model is published, then an old one again, each of which becomes the only active one."""
    path = new_folder(s, "registry")
    S.write_snapshot(V.models(s).drop("model_id").withColumn("is_active", F.lit(False)), path)
    right = V.scored(s, d).agg(F.avg((F.col("label") == F.col("predicted_label")).cast("int")).alias("macro_f1"))
    for version, name in (("v4", "forest"), ("v2", "forest-again")):
        incoming = right.select(F.lit(version).alias("model_version"), F.lit(name).alias("model_name"), "macro_f1")
        S.write_snapshot(store.model_upsert(S.read_snapshot(s, path), incoming), path)
    return S.read_snapshot(s, path).select("model_version", "model_name", *r6("macro_f1"), "is_active")


@query("select prediction_id, predicted_label from scored where prediction_id in (1234, 4321)")
def stored_predictions_by_id(s, d):
    """Look-ups in a store that is sorted by id."""
    path = new_folder(s, "by-id")
    store.write_by_id(V.scored(s, d), path, "prediction_id")
    found = s.read.parquet(path)
    return store.by_id(found, "prediction_id", 1234).union(store.by_id(found, "prediction_id", 4321)).select("prediction_id", "predicted_label")


@query("select prediction_id, predicted_label from scored where prediction_id < 5000 order by prediction_id desc limit 20")
def stored_predictions_page(s, d):
    """A page by key in such a store."""
    path = new_folder(s, "by-id")
    store.write_by_id(V.scored(s, d).select("prediction_id", "predicted_label"), path, "prediction_id")
    return store.page(s.read.parquet(path), "prediction_id", 20, before=5000)
