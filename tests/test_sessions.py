"""Sessions of segments: order by name, rejects, batch records, retries; row numbers of scans."""

import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from flowquarry.operators import store
from flowquarry.sources import flows as S
from flowquarry.streaming import segments as G
from flowquarry.streaming import source as N

KEEP = ("flow_id", "segment", "segment_row", "capture_session_id")


def scorer(df):
    return df.select(F.col("flow_id").alias("prediction_id"), F.lit("DDoS").alias("predicted_label"), F.lit(0.9).alias("confidence"), F.lit(None).cast("timestamp").alias("prediction_time"), "capture_session_id")


def segments(folder, texts):
    """Files of these texts; the last one is the oldest."""
    folder.mkdir(parents=True)
    for i, (name, text) in enumerate(texts.items()):
        (folder / name).write_text(text, encoding="utf-8")
        os.utime(folder / name, (2_000_000_000 - 1000 * i,) * 2)
    return str(folder)


def run(spark, tmp_path, texts, score=scorer, **options):
    folder = segments(tmp_path / "in", texts)
    stream = N.by_name(spark, folder, ["flow_id", "Flow Duration"], "s1")
    G.score_batches(stream, ["flow_duration"], score, str(tmp_path / "out"), str(tmp_path / "ck"), KEEP, **options).awaitTermination()
    return str(tmp_path / "out")


def test_segments_come_by_name_and_rows_by_number(spark, tmp_path):
    texts = {"segment-000001.csv": "﻿flow_id,Flow Duration\na,1\n\nb,x\n", "segment-000002.csv": 'flow_id,Flow Duration\n"c, d",\ne,y\n', "segment-000003.csv": "flow_id,Flow Duration\n", "notes.txt": "flow_id\n"}
    folder = segments(tmp_path / "in", texts)
    out = G.drain(N.by_name(spark, folder, ["flow_id", "Flow Duration"], "s1"), str(tmp_path / "a"), str(tmp_path / "b"))
    assert [tuple(r)[:4] for r in out.orderBy("seq").collect()] == [("a", "1", "segment-000001.csv", 0), ("b", "x", "segment-000001.csv", 1), ("c, d", None, "segment-000002.csv", 0), ("e", "y", "segment-000002.csv", 1)]
    path = run(spark, tmp_path / "scored", texts)
    rejects = G.committed(spark, path, "rejects").orderBy("segment").collect()
    assert [(r["flow_id"], r["segment"], r["segment_row"]) for r in rejects] == [("b", "segment-000001.csv", 1), ("e", "segment-000002.csv", 1)]


def test_later_segments_are_taken_once(spark, tmp_path):
    folder = segments(tmp_path / "in", {"segment-2.csv": "x\n1\n"})
    again = lambda: sorted(r["x"] for r in G.drain(N.by_name(spark, folder, ["x"], "s"), str(tmp_path / "out"), str(tmp_path / "ck")).collect())
    assert again() == ["1"]
    (tmp_path / "in" / "segment-3.csv").write_text("x\n2\n")
    assert again() == ["1", "2"] and again() == ["1", "2"]


@pytest.mark.parametrize("text", ["Flow Duration,flow_id\n1,a\n", "a,1\n", "", "flow_id,Flow Duration\na\n"])
def test_wrong_segments_end_the_stream(spark, tmp_path, text):
    with pytest.raises(StreamingQueryException):
        run(spark, tmp_path, {"segment-1.csv": text}, retries=0)


def test_session_without_rejects_and_one_without_scores(spark, tmp_path):
    good = run(spark, tmp_path / "good", {"segment-1.csv": "flow_id,Flow Duration\na,1\nb,2\n"})
    assert tuple(G.session_status(spark, good).first()) == ("s1", 2, 0, "completed") and G.committed(spark, good, "rejects").isEmpty()
    assert "reject_reason" in G.committed(spark, good, "rejects").columns and G.alerts(spark, good).count() == 2
    bad = run(spark, tmp_path / "bad", {"segment-1.csv": "flow_id,Flow Duration\na,x\n"})
    assert tuple(G.session_status(spark, bad).first()) == ("s1", 0, 1, "failed") and G.committed(spark, bad, "scored").isEmpty() and G.alerts(spark, bad).isEmpty()
    for path, expected in ((good, (2, 2, 0, 0, 2, 0)), (bad, (1, 0, 1, 0, 0, 0))):
        assert tuple(G.observed_counters(spark, path).first()) == expected


def test_a_batch_that_fails_half_way_is_tried_again(spark, tmp_path):
    calls = []

    def late(df):
        calls.append(1)
        if len(calls) == 1:  # rejects are written by now
            raise OSError("not now")
        return scorer(df)

    path = run(spark, tmp_path / "a", {"segment-1.csv": "flow_id,Flow Duration\na,1\nb,x\n"}, late, retries=1, pause=0.01)
    assert len(calls) == 2 and len(os.listdir(f"{path}/rejects")) == 2  # the first try's folder is there, and not read
    assert G.committed(spark, path, "rejects").count() == 1 and G.committed(spark, path, "scored").count() == 1
    calls.clear()
    with pytest.raises(StreamingQueryException):
        run(spark, tmp_path / "b", {"segment-1.csv": "flow_id,Flow Duration\na,1\n"}, lambda df: calls.append(1) or 1 / 0, retries=2, pause=0.01)
    assert len(calls) == 3
    with pytest.raises(Exception, match="records"):
        G.committed(spark, str(tmp_path / "b" / "out"), "scored")


def test_row_numbers_do_not_depend_on_the_cut(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 1)):
        (tmp_path / f"{name}.csv").write_text("id,code,x\n" + "".join(f"{name}{i},{i % 7}{'df'[i % 2]},{'NaN' if i % 3 else i}\n" for i in range(n)))
    key, found = "spark.sql.files.maxPartitionBytes", []
    for size in ("1000", "128m"):
        spark.conf.set(key, size)
        try:
            df = S.scan_csv(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")])
            assert (df.rdd.getNumPartitions() > 5) == (size == "1000")
            found.append(sorted((r["file_pos"], r["row_seq"], r["id"], r["code"], str(r["x"])) for r in df.collect()))
        finally:
            spark.conf.unset(key)
    assert found[0] == found[1]
    assert [x[:4] for x in found[0]] == [(0, 0, "b0", "0d"), *((1, i, f"a{i}", f"{i % 7}{'df'[i % 2]}") for i in range(3000))]
    assert found[0][1][4] == "0.0" and found[0][2][4] == "nan"


def test_segment_file(spark, tmp_path):
    S.write_segment(spark.createDataFrame([(2, "b"), (1, "a")], "n int, x string").repartition(2), str(tmp_path / "in"), "segment-1.csv", "n")
    assert (tmp_path / "in" / "segment-1.csv").read_text() == "n,x\n1,a\n2,b\n"
    assert json.dumps(os.listdir(tmp_path / "in")).count("segment-1.csv") >= 1


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "registry")
    with pytest.raises(ValueError, match="no version"):
        S.read_snapshot(spark, path)
    for n in (1, 2, 0):
        S.write_snapshot(spark.range(n), path)
        assert S.read_snapshot(spark, path).count() == n  # also a version without rows
    # rows of a writer that failed before its record are not read
    spark.range(9).write.parquet(f"{path}/rows-lost")
    assert S.read_snapshot(spark, path).isEmpty() and S.write_snapshot(spark.range(5), path) == 4
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        spark.range(1).write.mode("error").parquet(f"{path}/versions/000000004")


def rows_scanned(df):
    """Rows that the scan gave to the rest of the plan, and the rows found."""
    found = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while not plan.nodeName().startswith(("Scan", "BatchScan")):
        plan = plan.finalPhysicalPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan.child()
    return plan.metrics().apply("numOutputRows").value(), len(found)


def test_look_ups_read_few_row_groups(spark, tmp_path):
    path, n = str(tmp_path / "by-id"), 200_000
    df = spark.range(n).select((F.col("id") * 2).alias("prediction_id"), F.sha2(F.col("id").cast("string"), 256).alias("x")).orderBy("x")
    store.write_by_id(df, path, "prediction_id", 1 << 16)
    stored = spark.read.parquet(path)
    scanned, found = rows_scanned(store.by_id(stored, "prediction_id", 123_456))
    assert found == 1 and scanned < n // 10
    # an id that is not there lies in a group's range, but not in its filter
    assert rows_scanned(store.by_id(stored, "prediction_id", 123_457)) == (0, 0)
    scanned, found = rows_scanned(stored.where("prediction_id < 1000"))
    assert found == 500 and scanned < n // 10


@pytest.mark.parametrize("row_bytes", [1 << 30, 100])
def test_manifest_of_files_of_any_size(spark, tmp_path, row_bytes):
    import hashlib

    (tmp_path / "d" / "sub folder").mkdir(parents=True)
    contents = {"b.csv": b"x" * 50, "a.csv": bytes(range(256)) * 40_000, "sub folder/c é.csv": b"y", "other.txt": b"no"}
    for name, data in contents.items():
        (tmp_path / "d" / name).write_bytes(data)
    each, whole = S.manifest(spark, str(tmp_path / "d"), "*.csv", row_bytes)
    sums = {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in contents.items() if n.endswith(".csv")}
    got = {r["file"]: (r["size"], r["sha256"]) for r in each.collect()}
    assert {n.replace("%20", " ").replace("%C3%A9", "é"): v for n, v in got.items()} == sums
    lines = "".join(f"{n}\0{got[n][0]}\0{got[n][1]}\n" for n in sorted(got)).encode()
    assert tuple(whole.first()) == (3, sum(x for x, _ in sums.values()), hashlib.sha256(lines).hexdigest())


def test_manifest_of_no_file(spark, tmp_path):
    (tmp_path / "d").mkdir()
    assert S.manifest(spark, str(tmp_path / "d"), "*.csv")[1].first()["n_files"] == 0


def test_manifest_holds_no_large_file_as_a_row(spark, tmp_path, monkeypatch):
    import hashlib

    (tmp_path / "d").mkdir()
    data = {"large é %41.bin": bytes(range(256)) * 70_000, "small.bin": b"x" * 1000}
    for name, content in data.items():
        (tmp_path / "d" / name).write_bytes(content)
    lines = "".join(f"{n}\0{len(b)}\0{hashlib.sha256(b).hexdigest()}\n" for n, b in sorted(data.items())).encode()
    plain = (2, sum(map(len, data.values())), hashlib.sha256(lines).hexdigest())
    # the reader refuses a row over 17 MB; the large file has 17.9 MB
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 17 << 20)
    try:
        assert tuple(S.manifest(spark, str(tmp_path / "d"))[1].first()) == plain
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    # a store that pyarrow can't open, whose paths lead elsewhere, and one whose paths don't
    readable = S._readable
    for elsewhere in (True, False):
        turns = iter([False])
        monkeypatch.setattr(S, "_readable", lambda path, turns=turns, elsewhere=elsewhere: next(turns, elsewhere) and readable(path))
        assert tuple(S.manifest(spark, str(tmp_path / "d"), "*", 1000)[1].first()) == plain
