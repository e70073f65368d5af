"""Structured Streaming over a folder of flow segments: adapt, deduplicate, score, alert, count."""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from flowquarry.operators import adapt, store
from flowquarry.schema import CLASSES


def read_segments(spark: SparkSession, folder: str, schema: T.StructType, session: str, kind: str = "csv", per_batch: int = 1) -> DataFrame:
    """New files of the folder in batches, with session and segment; nothing of these becomes a feature.

    The file source orders by modification time, so segments should be moved in whole and one after another; `source.by_name` goes by name.
    A CSV segment whose header is missing or differs from the schema ends the stream with an error; a byte order mark is dropped.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    raw = reader.option("header", True).option("enforceSchema", False).csv(folder) if kind == "csv" else reader.format(kind).load(folder)
    row = F.col("_metadata.row_index") if kind == "parquet" else F.lit(None).cast("long")  # only Parquet numbers its rows
    return raw.select("*", F.col("_metadata.file_name").alias("segment"), row.alias("segment_row"), F.lit(session).alias("capture_session_id"))


def dedup(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Keep one row per key within the delay; state is bounded by the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


class LastSeen(StatefulProcessor):
    """Per session the last `capacity` accepted keys, oldest out first; a repeat does not make a key younger. A null is a key like any other.

    A session's rows of one batch are held together, so batches should be few segments.
    """

    def __init__(self, capacity: int):
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.keys = handle.getListState("keys", "fingerprint string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        order = deque(k[0] for k in self.keys.get())
        seen, out, before = set(order), [], len(order)
        # the batch's rows of a session come in several frames; their order is that of all of them together
        batch = pd.concat([f[["seq", "fingerprint"]] for f in rows]).sort_values("seq", kind="stable", na_position="first")
        for seq, fp in zip(batch["seq"], batch["fingerprint"].astype(object).where(batch["fingerprint"].notna(), None)):
            fresh = fp not in seen
            if fresh:
                order.append(fp)
                seen.add(fp)
                if len(order) > self.capacity:
                    seen.discard(order.popleft())
            out.append((key[0], seq, fp, fresh))
        if len(order) != before or any(x[3] for x in out):
            self.keys.put([(k,) for k in order])
        yield pd.DataFrame(out, columns=["capture_session_id", "seq", "fingerprint", "accepted"])

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fifo_dedup(stream: DataFrame, capacity: int = 50_000) -> DataFrame:
    """(capture_session_id, seq, fingerprint, accepted); exact, one state per session. Needs the RocksDB state store."""
    return stream.groupBy("capture_session_id").transformWithStateInPandas(
        LastSeen(capacity), "capture_session_id string, seq long, fingerprint string, accepted boolean", outputMode="append", timeMode="None"
    )


def timeline(predictions: DataFrame, ts: str = "prediction_time", delay: str = "1 minute") -> DataFrame:
    """Classes per minute; a minute is emitted once the watermark has passed it, later rows are dropped."""
    w = predictions.withWatermark(ts, delay).groupBy(F.window(ts, "1 minute").alias("w"))
    return w.agg(*[F.count_if(F.col("predicted_label") == c).alias(c.lower()) for c in CLASSES]).select(F.col("w.start").alias("bucket"), *[c.lower() for c in CLASSES])


def session_counts(predictions: DataFrame, session: str) -> DataFrame:
    return predictions.groupBy(session).agg(F.count("*").alias("n"), F.count_if(F.col("predicted_label") != "Normal").alias("attacks"))


RECORD = "batch_id long, threshold double, kind string, folder string, columns string, n long, normal long, ddos long, portscan long"


def score_batches(
    stream: DataFrame, required: list[str], scorer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, keep: tuple[str, ...], threshold: float = 0.7, retries: int = 2, pause: float = 1.0
) -> StreamingQuery:
    """Adapt, score and store each micro-batch: rejects, scored rows, and alerts that follow from these.

    A try of a batch writes folders of its own. The batch's record, written last, names them with their columns, row counts and counts by
    class, which are observed while the rows are written; readers open what records name and nothing else. A batch that fails
    is tried again up to `retries` times, after pauses that double; the stream ends with the last error. A batch that runs again
    after its record was written replaces the record.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, batch = batch.sparkSession, batch.persist()  # read for the rejects and for the scores
        try:
            good, bad = adapt.split_rejects(adapt.adapt(batch, required, keep=keep))
            record = []
            for kind, make in (("rejects", lambda: bad.select(*keep, "reject_reason")), ("scored", lambda: scorer(good))):
                rows = make()
                said = F.col("predicted_label") if kind == "scored" else F.lit("")
                seen, folder = Observation(), f"{path}/{kind}/batch-{batch_id}-{uuid.uuid4().hex}"
                counts = [F.count_if(said == c).alias(c.lower()) for c in CLASSES]
                rows.withColumn("batch_id", F.lit(batch_id).cast("long")).observe(seen, F.count(F.lit(1)).alias("n"), *counts).write.parquet(folder)
                found = seen.get
                record.append((batch_id, threshold, kind, folder, T.StructType([*rows.schema.fields]).add("batch_id", "long").json(), *(found[c] for c in ("n", *(c.lower() for c in CLASSES)))))
            spark.createDataFrame(record, RECORD).coalesce(1).write.mode("overwrite").parquet(f"{path}/records/batch={batch_id}")
        finally:
            batch.unpersist()

    def tried(batch: DataFrame, batch_id: int) -> None:
        for turn in range(retries + 1):
            try:
                return write(batch, batch_id)
            except Exception:
                if turn == retries:
                    raise
                time.sleep(pause * 2**turn)

    return stream.writeStream.foreachBatch(tried).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def records(spark: SparkSession, path: str) -> DataFrame:
    """What whole batches hold: a row a batch and kind."""
    return spark.read.schema(RECORD).parquet(f"{path}/records")


def committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of whole batches, in the columns that were stored; none, if no batch has any."""
    own = records(spark, path).where(F.col("kind") == name).orderBy("batch_id").collect()  # one row a batch
    if not own:
        raise ValueError(f"no batch of {path} is whole")
    schema = T.StructType.fromJson(json.loads(own[-1]["columns"]))
    folders = [r["folder"] for r in own if r["n"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def observed_counters(spark: SparkSession, path: str) -> DataFrame:
    """One row of counters, from the records alone: extracted, scored, rejected and the scored rows by class."""
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    scored, rejected = of("scored", "n"), of("rejects", "n")
    return records(spark, path).agg((scored + rejected).alias("extracted"), scored.alias("scored"), rejected.alias("rejected"), *[of("scored", c.lower()).alias(c.lower()) for c in CLASSES])


def session_status(spark: SparkSession, path: str) -> DataFrame:
    """(capture_session_id, scored, rejected, status) of whole batches; a session with a reject, or without a scored row, has failed."""
    rows = [committed(spark, path, name).select("capture_session_id", F.lit(name).alias("_kind")) for name in ("scored", "rejects")]
    n = rows[0].union(rows[1]).groupBy("capture_session_id").agg(F.count_if(F.col("_kind") == "scored").alias("scored"), F.count_if(F.col("_kind") == "rejects").alias("rejected"))
    return n.withColumn("status", F.when((F.col("rejected") == 0) & (F.col("scored") > 0), "completed").otherwise("failed"))


def alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts of whole batches, by the threshold that each was scored with."""
    done = records(spark, path).where("kind = 'scored'").select("batch_id", "threshold")
    return store.alerts_from(committed(spark, path, "scored").join(done, "batch_id"), F.col("threshold"))


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and read back what it wrote."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_latest(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an aggregate in complete mode; the last batch's table counts."""
    spark, last = stream.sparkSession, []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        last.append(batch_id)

    stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/batch={last[-1]}") if last else spark.createDataFrame([], stream.schema)
