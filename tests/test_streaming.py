"""Streams run to their end give what batches give."""

import pytest
from pyspark.sql import functions as F

from catalune.streaming import changes as S
from catalune.streaming import queue


@pytest.fixture
def events(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    far = spark.createDataFrame([(10**9, 10**9, "view", 0.0)], "event_id long, user_id long, event_type string, value double").withColumn("ts", F.lit("2030-01-01").cast("timestamp_ntz"))
    cols = ["event_id", "ts", "user_id", "event_type", "value"]
    src.select(*cols).unionByName(far.select(*cols)).repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "events"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "events")).schema).parquet(str(tmp_path / "events")), src


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_presence(spark, events, tmp_path):
    stream, batch = events
    got = run(S.presence(stream, "user_id", "ts", "12 hours", "1 hour"), tmp_path, "presence")
    want = batch.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "12 hours").alias("w")).agg(F.count("*").alias("n"))
    assert {(r["user_id"], r["start"], r["n"]) for r in got.collect()} == {(r["user_id"], r["w"]["start"], r["n"]) for r in want.collect()}


def test_rates_and_limits(spark, events, tmp_path):
    stream, batch = events
    got = run(S.over_limit(stream, "user_id", "ts", "6 hours", 1, "1 hour"), tmp_path, "limits")
    want = batch.groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count("*").alias("n")).where("n > 1")
    assert {(r["user_id"], r["start"], r["n"]) for r in got.collect()} == {(r["user_id"], r["w"]["start"], r["n"]) for r in want.collect()}


def test_fold_is_idempotent(spark, events, tmp_path):
    stream, batch = events
    path = str(tmp_path / "table")
    fold = S.fold_into(path, ["user_id"], ["value"], "event_id")
    log = stream.withColumn("op", F.when(F.col("event_type") == "error", "delete").otherwise("update")).select("user_id", "op", "value", "event_id")
    log.writeStream.foreachBatch(fold).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    last = batch.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), "event_id").alias("x")).where("x.event_type <> 'error'")
    want = {(r["user_id"], r["x"]["value"]) for r in last.collect()} | {(10**9, 0.0)}
    assert {tuple(r) for r in S.folded(spark, path).collect()} == want
    fold(spark.createDataFrame([(1, "update", 9.9, 1)], "user_id long, op string, value double, event_id long"), 0)
    assert {tuple(r) for r in S.folded(spark, path).collect()} == want


def test_queue_and_retries(spark, events, tmp_path):
    stream, batch = events
    e = stream.select("user_id", "event_id", "event_type", (F.col("event_id") % 40).alias("song"))
    got = {r["user_id"]: r["current"] for r in run(queue.live(e, "user_id", "event_id", "event_type", "song").withColumnRenamed("k", "user_id"), tmp_path, "queue", "update").collect()}
    b = batch.select("user_id", "event_id", "ts", "event_type", (F.col("event_id") % 40).alias("song"))
    want = {r["user_id"]: r["current"] for r in queue.replay(b, "user_id", "event_id", "event_type", "song").collect()}
    assert {k: v for k, v in got.items() if k < 10**9} == {k: None if v is None else float(v) for k, v in want.items()}
    tries = run(S.retries(stream.where("event_type = 'error'"), "user_id", F.col("value") < 50), tmp_path, "retries", "update")
    assert {r["k"]: r["tries"] for r in tries.collect()} == {r["user_id"]: r["count"] for r in batch.where("event_type = 'error'").groupBy("user_id").count().collect()}


def test_feed_resets(spark):
    log = spark.range(100).withColumnRenamed("id", "rev")
    assert S.feed(log, "rev", 90, 99).count() == 9 and S.feed(log, "rev", 1, 900).first()["reset"]


def test_bursts(spark, events, tmp_path):
    stream, batch = events
    got = run(S.coalesced(stream, "user_id", "ts", "12 hours", "1 hour"), tmp_path, "bursts")
    want = batch.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "12 hours").alias("w")).agg(F.max(F.col("ts").cast("timestamp")).alias("last"), F.count("*").alias("n"))
    assert {(r["user_id"], r["last"], r["n"]) for r in got.collect()} == {(r["user_id"], r["last"], r["n"]) for r in want.collect()}
