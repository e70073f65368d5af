"""Small cases with known results."""

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.functions import columns as C
from flowquarry.operators import adapt, audit, metrics, prepare, profile, splits, store
from flowquarry.plans import ml
from flowquarry.schema import CLASSES, FEATURE_ALIASES, FEATURES, LEAKAGE, REPRODUCED, REPRODUCTION, STRICT
from flowquarry.sources import flows as S
from flowquarry.streaming import segments as G


def column(df, name):
    return [r[name] for r in df.collect()]


def test_fixed_tables():
    assert len(FEATURES) == len(set(FEATURES)) == 78 and len(FEATURE_ALIASES) == 50
    assert set(FEATURE_ALIASES.values()) <= set(FEATURES) and set(REPRODUCED) <= set(FEATURES)


@pytest.mark.parametrize(
    "raw, label",
    [("BENIGN", "Normal"), (" normal ", "Normal"), ("DDoS", "DDoS"), ("  DDoS   Hulk ", "DDoS"), ("PortScan", "PortScan"), ("port\tscan", "PortScan"), ("Bot", None), (None, None), ("normal traffic", None)],
)
def test_labels(spark, raw, label):
    assert column(spark.createDataFrame([(raw,)], "x string").select(C.map_label("x").alias("y")), "y") == [label]


def test_names(spark):
    raw = [" Flow Duration ", "Source IP/Port", "  Multiple   Spaces "]
    assert column(spark.createDataFrame([(x,) for x in raw], "x string").select(C.normalize_name("x").alias("y")), "y") == [C.normalize_python(x) for x in raw]
    with pytest.raises(ValueError):
        prepare.normalize_columns(spark.createDataFrame([(1, 2)], "`Source IP` int, source_ip int"))


def test_numbers(spark):
    cases = {"12.5": (12.5, False), " 7 ": (7.0, False), "": (None, False), None: (None, False), "nan": (None, False), "-inf": (None, False), "1.5d": (None, True), "true": (None, True), "1e3": (1000.0, False)}
    out = spark.createDataFrame([(k,) for k in cases], "x string").select("x", C.parse_number("x").alias("n"), C.number_error("x").alias("e"))
    assert {r["x"]: (r["n"], r["e"]) for r in out.collect()} == cases


def test_profile(spark):
    df = prepare.normalize_columns(
        spark.createDataFrame([("BENIGN", 1.0, "a"), ("DDoS Hulk", float("inf"), "b"), ("Port Scan", 3.0, "c"), ("Bot", 4.0, "d")], "` Label ` string, `Flow Duration` double, `Source IP` string")
    )
    assert {r["label"]: r["n"] for r in profile.mapped_class_distribution(df, "label").collect()} == dict.fromkeys(CLASSES, 1)
    assert {r["raw_label"]: r["n"] for r in profile.excluded_class_distribution(df, "label").collect()} == {"Bot": 1}
    assert {r["column_name"]: r["n_infinite"] for r in profile.infinite_values(df).collect()} == {"flow_duration": 1}
    assert set(column(profile.leakage_columns(df, LEAKAGE), "column_name")) == {"label", "source_ip"}
    empty = profile.mapped_class_distribution(df.limit(0), "label").collect()
    assert [(r["n"], r["percentage"]) for r in empty] == [(0, 0.0)] * 3
    assert profile.duplicate_rows(df.union(df)).first()[0] == 4


def test_constant_and_undefined(spark):
    df = spark.createDataFrame([(1.0, None, 2.0, None), (1.0, None, 3.0, 5.0), (1.0, None, float("nan"), 5.0)], "a double, b double, c double, d double")
    assert set(column(profile.constant_columns(df), "column_name")) == {"a", "b"}
    r = {(x["column_a"], x["column_b"]): x["r"] for x in profile.correlation(df).collect()}
    assert r["a", "c"] is None and r["a", "a"] is None and abs(r["c", "c"] - 1) < 1e-9 and r["b", "c"] is None


def test_preparation(spark):
    rows = [(label, f"{label}{i}", f"10.0.0.{i}", "TCP", float(i + 100 * k), 1.0 * i, i) for k, label in enumerate(["BENIGN", "DDoS", "PortScan"]) for i in range(10)]
    rows += [("Bot", "x", "y", "TCP", 1.0, 1.0, 99), (*rows[0][:6], 100)]
    df = spark.createDataFrame(rows, "label string, flow_id string, source_ip string, protocol string, flow_duration double, packets double, seq long")
    kept = prepare.dedup_keep_first(prepare.in_scope(df, "label"), ["seq"])
    assert kept.count() == 30 and 0 in column(kept, "seq") and 100 not in column(kept, "seq")
    assert prepare.feature_names(kept.drop("seq"), LEAKAGE, "label") == ["flow_duration", "packets"]
    split = splits.stratified_split(kept, "label", "seq").groupBy("split", "label").count().collect()
    assert {(r["split"], r["label"]): r["count"] for r in split} == {(s, c): n for s, n in (("test", 2), ("train", 8)) for c in CLASSES}
    prepare.check_guards(df, "label", ["flow_duration"], 0.2)
    with pytest.raises(ValueError):
        prepare.check_guards(df.where("label <> 'DDoS'"), "label", ["flow_duration"], 0.2)
    with pytest.raises(ValueError):
        prepare.check_guards(df, "label", ["flow_duration"], 1.0)


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("seq"), F.when(F.col("id") % 7 == 0, "DDoS").when(F.col("id") % 5 == 0, "PortScan").otherwise("Normal").alias("label"))
    one, many = (splits.stratified_split(df.repartition(n), "label", "seq") for n in (1, 7))
    assert one.exceptAll(many).isEmpty() and one.where("split = 'test'").count() == 100
    assert splits.stratified_sample(df, "label", "seq", 33).count() == 33
    folds = splits.stratified_folds(df, "label", "seq", 5).groupBy("label", "fold").count().groupBy("label").agg((F.max("count") - F.min("count")).alias("d"))
    assert max(column(folds, "d")) <= 1


def test_ranks_with_one_far_value_and_one_large_group(spark):
    from flowquarry.operators import ranks

    rows = [("big", i * 7 % 5000, i) for i in range(5000)] + [("big", 10**15, -1), (None, 3, -2), (None, 1, -3), ("one", None, -4)]
    df = spark.createDataFrame(rows, "g string, v long, id long").repartition(6)
    out = ranks.ranked(df, [F.col("g")], [F.col("v")], "rank", "n")
    got = {(r["g"], r["v"]): (r["rank"], r["n"]) for r in out.collect()}
    assert len(got) == 5004 and all(got["big", v] == (v, 5001) for v in range(5000)) and got["big", 10**15] == (5000, 5001)
    assert got[None, 1] == (0, 2) and got[None, 3] == (1, 2) and got["one", None] == (0, 1)
    assert ranks.ranked(df.limit(0), [F.col("g")], [F.col("v")], "rank", "n").isEmpty()
    # the large group is spread evenly over the tasks that sort it
    sizes = df.repartitionByRange(4, "g", "v").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 2500


@pytest.mark.parametrize("size", [5, 100])
def test_blocks(spark, size):
    rows = [(f"c{k}.csv", c, i + 1000 * k) for k, c in enumerate(CLASSES) for i in range(30)]
    df = splits.blocks(spark.createDataFrame(rows, "source_file string, label string, seq long"), "label", "seq", size)
    assert splits.overlap(df, "scenario_group").isEmpty()
    assert {(r["split"], r["label"]) for r in df.select("split", "label").collect()} == {(s, c) for s in ("train", "test") for c in CLASSES}
    n = df.where("split = 'test'").count()
    assert n == (30 if size == 5 else 18)


def test_metrics(spark):
    truth, pred = ["Normal"] * 2 + ["DDoS"] * 2 + ["PortScan"] * 2, ["Normal", "DDoS", "DDoS", "Normal", "PortScan", "Normal"]
    df = spark.createDataFrame(list(zip(truth, pred)), "label string, predicted_label string")
    assert [tuple(r)[1:] for r in metrics.confusion_matrix(df).collect()] == [(1, 1, 0), (1, 1, 0), (1, 0, 1)]
    assert column(metrics.classification_report(df), "fpr") == [0.5, 0.25, 0.0]
    assert tuple(metrics.error_counts(df).first())[:3] == (1, 1, 1)
    assert abs(metrics.overall(df).first()["macro_f1"] - (0.4 + 0.5 + 2 / 3) / 3) < 1e-6


def test_selection(spark):
    schema = "name string, macro_f1 double, ddos_recall double, portscan_recall double, normal_fpr double, latency double"
    best = lambda rows: metrics.select_best(spark.createDataFrame(rows, schema), "baseline").first()["name"]
    assert best([("baseline", 0.9, 0.9, 0.9, 0.02, 1.0), ("tuned", 0.8, 1.0, 1.0, 0.0, 0.1)]) == "baseline"
    assert best([("baseline", 0.9, 0.9, 0.9, 0.02, 1.0), ("tuned", 0.9, 0.9, 0.9, 0.01, 2.0)]) == "tuned"
    assert best([("tuned", 0.9, 0.9, 0.9, 0.02, 1.0), ("baseline", 0.9, 0.9, 0.9, 0.02, 1.0)]) == "baseline"


def test_adapter(spark):
    need = ["destination_port", "flow_duration", "fwd_header_length", "fwd_header_length.1"]
    df = spark.createDataFrame([("443", "12.5", "inf", "192.168.56.20")], "`Destination Port` string, `Flow Duration` string, `Fwd Header Length` string, `Source IP` string")
    with pytest.raises(ValueError):
        adapt.adapt(df, need, STRICT)
    assert list(adapt.adapt(df, need, REPRODUCTION).first()) == [443.0, 12.5, None, None, None]
    assert df.select(*adapt.metadata(df.columns)).first()["source_ip"] == "192.168.56.20"
    with pytest.raises(ValueError):
        adapt.resolve(["dst_port", "Destination Port"], ["destination_port"])


def test_headers(spark):
    need = ["destination_port", "flow_duration", "fwd_header_length", "fwd_header_length.1"]
    make = lambda names: spark.createDataFrame([("f", i, n) for i, n in enumerate(names)], "file string, pos int, name string")
    verdict = lambda names, policy=STRICT: audit.compat_verdict(make(names), need, policy).first()
    assert verdict(need)["compatible"] and not verdict(need[:3])["compatible"] and verdict(need[:3], REPRODUCTION)["compatible"]
    assert verdict(need[:3])["incomplete_pair"] and verdict([*need, "dst_port"])["n_duplicates"] == 1
    assert column(audit.compat_extra(make([*need, "Label"]), need), "normalized") == ["label"]


def test_store(spark):
    rule = {1: ("Normal", 0.99), 10: ("DDoS", 0.95), 20: ("PortScan", 0.90), 30: ("DDoS", 0.60)}
    rows = [(i, label, c) for i, (label, c) in rule.items()]
    p = spark.createDataFrame(rows, "prediction_id long, predicted_label string, confidence double").withColumn("prediction_time", F.timestamp_seconds("prediction_id"))
    alerts = store.alerts_from(p)
    assert sorted(column(alerts, "severity")) == ["HIGH", "MEDIUM"]
    acks = spark.createDataFrame([(10,), (10,)], "alert_id long").withColumn("ack_time", F.timestamp_seconds(F.lit(5)))
    assert tuple(store.dashboard_alerts(store.current_status(alerts, acks)).first()) == (1, 0, 1, 1)
    assert tuple(store.dashboard_predictions(p).first())[:4] == (4, 1, 2, 1)
    assert tuple(store.dashboard_predictions(p.limit(0)).first()) == (0, 0, 0, 0, None)
    assert sum(r["normal"] + r["ddos"] + r["portscan"] for r in store.timeline(p, 60).collect()) == 4
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}):
        with pytest.raises(ValueError):
            store.page(p, "prediction_id", **bad)


def test_csv_scan(spark, tmp_path):
    for name, text in (("first.csv", "﻿ Feature , Label \n1,BENIGN\n"), ("second.csv", "feature,label\n2,DDoS\n")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    df = S.scan_csv(spark, [str(tmp_path / "first.csv"), str(tmp_path / "second.csv")])
    rows = df.orderBy("file_pos", "block_start", "row_seq").collect()
    assert [(r["feature"], r["label"], r["source_file"]) for r in rows] == [(1.0, "BENIGN", "first.csv"), (2.0, "DDoS", "second.csv")]
    (tmp_path / "third.csv").write_text("label,feature\nx,1\n")
    with pytest.raises(ValueError):
        S.scan_csv(spark, [str(tmp_path / "first.csv"), str(tmp_path / "third.csv")])
    (tmp_path / "c.json").write_text(json.dumps({"columns": {"Flow ID": "id"}}))
    assert S.leakage_config(spark, str(tmp_path / "c.json")) == {"flow_id": "id"}
    each, whole = S.manifest(spark, str(tmp_path), "*.csv")
    assert each.count() == 3 and whole.first()["n_files"] == 3


def test_csv_scan_keeps_text_and_tells_files_of_one_name_apart(spark, tmp_path):
    for folder, rows in (("cap-10", '1,"Bot, a",7\n2,x,\n'), ("cap-1", "3,y,nan\n"), ("cap 2", "4,,inf\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text('Flow ID,"attack_category", Packets \n' + rows)
    paths = [str(tmp_path / f) for f in ("cap-10", "cap-1", "cap 2")]
    out = S.ingest(spark, paths, str(tmp_path / "out")).orderBy("file_pos", "file_path", "block_start", "row_seq")
    got = [(r["file_pos"], r["flow_id"], r["attack_category"], str(r["packets"])) for r in out.collect()]
    assert got == [(0, 1.0, "Bot, a", "7.0"), (0, 2.0, "x", "None"), (1, 3.0, "y", "nan"), (2, 4.0, None, "inf")]
    assert S.headers(spark, paths).select("file").distinct().count() == 3
    assert dict(S.scan_csv(spark, paths, text={"flow_id"}).dtypes)["flow_id"] == "string"


def test_fingerprints_tell_fields_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "c"), ("\\N", "c"), ("", "c"), ('a","y":"b', "c")]
    df = spark.createDataFrame(rows, "x string, y string").select(C.identity("x", "y").alias("f"))
    assert df.distinct().count() == len(rows)


def test_report_without_words_for_nan(spark, tmp_path):
    S.write_report(spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (0.5, 3)], "x double, n int"), str(tmp_path / "r"))
    lines = [json.loads(line) for f in (tmp_path / "r").glob("*.json") for line in f.read_text().splitlines()]
    assert {r["n"]: r.get("x") for r in lines} == {1: None, 2: None, 3: 0.5}
    S.write_sorted_csv(spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "k string, n int"), str(tmp_path / "c"), "n")
    parts = sorted((tmp_path / "c").glob("*.csv"))
    assert [line for f in parts for line in f.read_text().splitlines() if line != "k,n"] == ["b,3", "c,2", "a,1"]
    (tmp_path / "p.json").write_text(json.dumps({"source_files": ["a"], "label_column": "label", "rows": 1}))
    with pytest.raises(ValueError):
        S.read_profile(spark, str(tmp_path / "p.json"))


def test_saved_pipeline_scores_alike(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rows = [(c, 10.0 * k + i % 5, None if i == 0 else 10.0 * k) for k, c in enumerate(CLASSES) for i in range(20)]
    df = ml.with_index(spark.createDataFrame(rows, "label string, feature_a double, `feature.b` double"), "label").coalesce(1)
    model = ml.fit(df, ["feature_a", "feature.b"], numTrees=3, maxDepth=3)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a, b = (ml.score(m, df.drop("label_index"), "v1").collect() for m in (model, again))
    assert a == b and len(a) == 60


def test_search_of_a_small_space(spark):
    rows = [(c, 10.0 * k + i % 5, i % 2) for k, c in enumerate(CLASSES) for i in range(12)]
    df = ml.with_index(spark.createDataFrame(rows, "label string, feature_a double, fold int"), "label").coalesce(1)
    found = ml.search(df, ["feature_a"], {"numTrees": [2, 3], "maxDepth": [2], "balanced": [True, False]}, n=3)
    assert found.count() == 6 and found.where("test_f1 >= 0.8").count() == 6 and ml.cv_results(found).count() == 3
    assert len(ml.candidates(ml.SPACE, 20)) == 20 and set(ml.SPACE["balanced"]) == {True, False}


def test_macro_f1_of_counts(spark):
    cases = [[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 0.0)], [(1.0, 1.0)] * 3, [(0.0, 2.0), (2.0, 2.0), (None, 1.0)], []]
    for rows in cases:
        df = spark.createDataFrame(rows, "label_index double, prediction double")
        expected = metrics.overall(ml.named_predictions(df.where("label_index is not null"))).first()["macro_f1"]
        assert ml.MacroF1().evaluate(df) == expected


def test_forest_wraps_trees_late(spark):
    rows = [(c, 10.0 * k + i % 5) for k, c in enumerate(CLASSES) for i in range(12)]
    df = ml.with_index(spark.createDataFrame(rows, "label string, feature_a double"), "label").coalesce(1)
    model = ml.fit(df, ["feature_a"], numTrees=3, maxDepth=2).stages[-1]
    assert isinstance(model, ml.ForestModel) and len(model.trees) == model.getNumTrees == 3


def test_score_batch(spark):
    rows = [(c, float(10 * i + k % 3), 5.0) for i, c in enumerate(CLASSES) for k in range(12)]
    df = ml.with_index(spark.createDataFrame(rows, "label string, feature_a double, feature_b double"), "label").coalesce(1)
    model = ml.fit(df, ["feature_a", "feature_b"], numTrees=3, maxDepth=3)
    batch = spark.createDataFrame([(1, 5.0, 0.0, "x", "y"), (2, 5.0, 20.0, "x", "y")], "id long, feature_b double, feature_a double, other string, own string")
    out = ml.score_batch(model, batch, "v1", ["id", "own"])
    assert set(out.columns) == {"id", "own", "predicted_label", "confidence", "probabilities", "model_version", "ignored_features"}
    assert [(r["id"], r["predicted_label"], r["ignored_features"]) for r in out.orderBy("id").collect()] == [(1, "Normal", ["other"]), (2, "PortScan", ["other"])]
    assert ml.score_batch(model, batch.drop("other"), "v1", ["id", "own"]).first()["ignored_features"] == []
    for bad in (batch.limit(0), batch.drop("feature_a")):
        with pytest.raises(ValueError):
            ml.score_batch(model, bad, "v1", ["id"])


def test_block_guards(spark):
    rows = [(i, c, "a.csv", i % 10) for i, c in enumerate(c for c in CLASSES for _ in range(30))]
    df = spark.createDataFrame(rows, "seq long, label string, source_file string, x long")
    splits.check_blocks(splits.blocks(df, "label", "seq", 5), "label", CLASSES)
    one = splits.blocks(df.where("label <> 'DDoS' or seq = 30"), "label", "seq", 5)
    assert splits.block_guards(one, "label", CLASSES).first().asDict() == {"small_strata": 1, "shared_groups": 0, "missing_sides": 1}
    with pytest.raises(ValueError):
        splits.check_blocks(one, "label", CLASSES)
    none = splits.blocks(df.limit(0), "label", "seq", 5)
    assert splits.block_guards(none, "label", CLASSES).first()["missing_sides"] == 6


def test_session_counters_without_predictions(spark):
    tagged = spark.createDataFrame([("a", "accepted"), ("a", "rejected")], "session string, disposition string")
    none = spark.createDataFrame([], "session string, predicted_label string")
    row = store.session_counters(tagged, none, "session").first().asDict()
    assert row == {"session": "a", "extracted": 2, "submitted": 1, "duplicates": 0, "rejected": 1, "successful": 0, "normal": 0, "ddos": 0, "portscan": 0}


def test_csv_segments_with_a_byte_order_mark_and_wrong_headers(spark, tmp_path):
    def run(name, text):
        (tmp_path / name).mkdir()
        (tmp_path / name / "segment-000001.csv").write_bytes(text)
        stream = G.read_segments(spark, str(tmp_path / name), feature_types, "session-1")
        return G.drain(stream, str(tmp_path / name / "out"), str(tmp_path / name / "ck")).collect()

    feature_types = T.StructType([T.StructField(c, T.StringType()) for c in ("Flow Duration", "Destination Port")])
    rows = run("marked", b"\xef\xbb\xbfFlow Duration,Destination Port\n100,80\n")
    assert [(r["Flow Duration"], r["Destination Port"], r["segment"], r["capture_session_id"]) for r in rows] == [("100", "80", "segment-000001.csv", "session-1")]
    for name, text in {"swapped": b"Destination Port,Flow Duration\n80,100\n", "none": b"100,80\n101,81\n"}.items():
        with pytest.raises(StreamingQueryException):
            run(name, text)


def test_fifo_dedup_over_frames_with_a_full_cap(spark, tmp_path):
    import random
    from collections import deque

    rng = random.Random(3)
    rows = [(i, rng.choice([None, *"abcdefgh"])) for i in range(400)]
    df = spark.createDataFrame(rng.sample(rows, 400), "seq long, fingerprint string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    last, expected = deque(maxlen=4), []
    for i, fp in rows:
        expected.append((i, fp, fp not in last))
        if fp not in last:
            last.append(fp)
    key, stream = "spark.sql.execution.arrow.maxRecordsPerBatch", G.read_segments(spark, str(tmp_path / "in"), df.schema, "s", "parquet")
    spark.conf.set(key, 7)
    try:
        with G.rocksdb(spark):
            out = G.drain(G.fifo_dedup(stream, 4), str(tmp_path / "out"), str(tmp_path / "ck"))
    finally:
        spark.conf.unset(key)
    assert [tuple(r)[1:] for r in out.orderBy("seq").collect()] == expected


def test_scoring_stream_uses_its_threshold(spark, tmp_path):
    df = spark.createDataFrame([("1", "a"), ("x", "b"), ("3", "c")], "`Flow Duration` string, flow_id string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = G.read_segments(spark, str(tmp_path / "in"), df.schema, "s", "parquet")
    scorer = lambda d: d.select(F.col("flow_id").alias("prediction_id"), F.lit("DDoS").alias("predicted_label"), F.lit(0.6).alias("confidence"), F.lit(None).cast("timestamp").alias("prediction_time"))
    for threshold, n in ((0.5, 2), (0.7, 0)):
        path = str(tmp_path / f"out{threshold}")
        G.score_batches(stream, ["flow_duration"], scorer, path, str(tmp_path / f"ck{threshold}"), ("flow_id", "segment_row"), threshold).awaitTermination()
        assert G.alerts(spark, path).count() == n
        assert [tuple(r) for r in G.committed(spark, path, "rejects").select("flow_id", "segment_row").collect()] == [("b", 1)]


def test_medians_and_forest(spark):
    rows = [(c, 10.0 * k + i % 5, None if i == 0 else 10.0 * k) for k, c in enumerate(CLASSES) for i in range(20)]
    df = ml.with_index(spark.createDataFrame(rows, "label string, feature_a double, feature_b double"), "label")
    m = {r["column_name"]: r["median"] for r in ml.medians(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (float("nan"),)], "x double"), ["x"]).collect()}
    assert m == {"x": 2.5}
    model = ml.fit(df, ["feature_a", "feature_b"], numTrees=5, maxDepth=4)
    assert ml.MacroF1().evaluate(model.transform(df)) >= 0.8
    out = ml.score(model, df.drop("label_index"), "v1").first()
    assert abs(sum(out["probabilities"].values()) - 1) < 1e-9 and out["confidence"] == max(out["probabilities"].values())
    assert ml.importances(spark, model, ["feature_a", "feature_b"]).count() == 2


def test_fifo_dedup(spark, tmp_path):
    df = spark.createDataFrame([(i, fp) for i, fp in enumerate("aaba")], "seq long, fingerprint string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = G.read_segments(spark, str(tmp_path / "in"), df.schema, "s", "parquet")
    with G.rocksdb(spark):
        out = G.drain(G.fifo_dedup(stream, 1), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert [r["accepted"] for r in out.orderBy("seq").collect()] == [True, False, True, True]
    with pytest.raises(ValueError):
        G.LastSeen(0)


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "prediction_id long")
    for batch in (1, 2, 2):
        S.write_scored(df, str(tmp_path / "scored"), batch)
    assert spark.read.parquet(str(tmp_path / "scored")).count() == 4


@pytest.mark.parametrize("bins, few", [(4, 2), (256, 2000)])
def test_exact_quantiles(spark, bins, few):
    import random

    from flowquarry.operators.quantiles import exact_quantiles

    rng = random.Random(1)
    rows = [(rng.gauss(0, 1) * 10 ** rng.randint(-3, 3), float(rng.randint(0, 3)), None, rng.choice([-1.7e308, 0.0, 1.7e308]), float("nan") if i % 3 else 2.0) for i in range(997)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    p = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = exact_quantiles(df, df.columns, p, bins, few)
    expected = df.select(*[F.percentile(C.finite(c), F.array(*[F.lit(x) for x in p])).alias(c) for c in df.columns]).first()
    for c in df.columns:
        if expected[c] is None:
            assert got[c] == [None] * len(p)
        else:
            assert all(abs(x - y) <= 1e-12 * max(abs(y), 1.0) for x, y in zip(got[c], expected[c])), c


def test_registered_models_use_the_whole_job(monkeypatch):
    from unittest import mock

    from flowquarry import jobs

    fit, search, folds, sample = mock.MagicMock(), mock.MagicMock(), mock.MagicMock(), mock.MagicMock()
    for module, name, new in [(jobs.ml, "fit", fit), (jobs.ml, "search", search), (jobs.splits, "stratified_folds", folds), (jobs.splits, "stratified_sample", sample)]:
        monkeypatch.setattr(module, name, new)
    for name in ("_training", "new_folder"):
        monkeypatch.setattr(jobs, name, mock.MagicMock())
    jobs._fitted(mock.MagicMock(), "")
    jobs._search(mock.MagicMock(), "")
    assert fit.call_args.kwargs == {} and len(search.call_args.args) == 2 and search.call_args.kwargs == {}
    assert sample.call_args.args[-1] == 50_000 and folds.call_args.args[-1] == 5
    assert (jobs.ml.TREES, jobs.ml.CANDIDATES) == (100, 20)
