"""Streams: presence, rates, limits, the change feed. Each has a batch twin among the queries."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def presence(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n): a key is there until nothing is heard of it for ``gap``."""
    d = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return d.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def coalesced(changes: DataFrame, key: str, ts: str, quiet: str, late: str) -> DataFrame:
    """(key, first, last, n): changes of a key that follow one another within ``quiet`` are one, told when it is over."""
    d = changes.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    burst = d.groupBy(key, F.session_window(ts, quiet).alias("w")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))
    return burst.select(key, "first", "last", "n")


def rates(events: DataFrame, keys: list[str], ts: str, amount: str, width: str, step: str | None, late: str) -> DataFrame:
    """(keys, start, n, amount) of tumbling or sliding windows."""
    d = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    w = F.window(ts, width, step) if step else F.window(ts, width)
    return d.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum(amount).alias("amount")).select(*keys, F.col("w.start").alias("start"), "n", "amount")


def over_limit(events: DataFrame, key: str, ts: str, width: str, most: int, late: str) -> DataFrame:
    return rates(events.withColumn("__one", F.lit(1)), [key], ts, "__one", width, None, late).where(F.col("n") > most)


def fold_into(path: str, key: list[str], cols: list[str], rev: str):
    """For foreachBatch: keeps the last change of each key in a table of versions, one a batch; a batch that was
    written before is skipped, so a restart counts nothing twice."""

    def run(batch: DataFrame, number: int) -> None:
        from catalune.operators.changes import fold_log

        spark = batch.sparkSession
        at = lambda n: f"{path}/version={n:09d}"
        done = version(spark, path)
        if done is not None and done >= number:
            return
        last = batch.groupBy(*key).agg(F.max_by(F.struct("op", *cols), rev).alias("x")).select(*key, "x.*").withColumn(rev, F.lit(0))
        base = spark.read.parquet(at(done)) if done is not None else spark.createDataFrame([], batch.select(*key, *cols).schema)
        fold_log(base, last, key, cols, rev).write.mode("overwrite").parquet(at(number))

    return run


def version(spark, path: str) -> int | None:
    """The newest complete version of a folded table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
    return max((int(x.getName().split("=")[1]) for x in found if x.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))), default=None)


def folded(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version(spark, path):09d}")


def retries(failures: DataFrame, key: str, transient: Column, most: int = 3) -> DataFrame:
    """(key, tries, state) after each batch of failures: waiting for another try, failed, or given up after ``most``."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState):
        tries, last = json.loads(state.get[0]) if state.exists else (0, "waiting")
        for pdf in batches:
            for again in pdf["again"]:
                tries += 1
                last = "failed" if not again else "gave up" if tries >= most else "waiting"
        state.update((json.dumps([tries, last]),))
        yield pd.DataFrame([{"k": k[0], "tries": tries, "state": last}])

    d = failures.select(F.col(key).alias("k"), transient.alias("again"))
    return d.groupBy("k").applyInPandasWithState(run, f"k {failures.schema[key].dataType.simpleString()}, tries int, state string", "s string", "update", GroupStateTimeout.NoTimeout)


def feed(log: DataFrame, rev: str, since: int, newest: int, kept: int = 500) -> DataFrame:
    """Changes after a revision; a reader too far behind gets one row that tells it to start anew."""
    if newest - since > kept:
        return log.sparkSession.createDataFrame([(newest, True)], f"{rev} long, reset boolean")
    return log.where(F.col(rev) > since).select(rev, F.lit(False).alias("reset"))
