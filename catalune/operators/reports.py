"""Reports: collection statistics, histograms, overlaps, insights, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: Column, step: int) -> DataFrame:
    """(from, n): buckets of ``step`` from the lowest to the highest known positive value, empty ones too."""
    got = df.where(value > 0).groupBy((F.floor(value / step) * step).cast("long").alias("from")).agg(F.count("*").alias("n"))
    spine = got.agg(F.min("from").alias("lo"), F.max("from").alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi", F.lit(step).cast("long"))).alias("from"))
    return spine.join(got, "from", "left").select("from", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def known_sum(c: str) -> Column:
    """Of known positive values."""
    return F.coalesce(F.sum(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0))


def middle(df: DataFrame, c: str, name: str) -> DataFrame:
    """One row: the exact median of the known values. Values are counted first and ranked by ranges, so no task holds
    them all; only one sum a range meets in one place."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number isn't changed at run time
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("k"))
    ranged = counts.repartitionByRange(n, "v").withColumn("r", F.spark_partition_id())
    sizes = ranged.groupBy("r").agg(F.sum("k").alias("s"))
    before = sizes.select("r", F.coalesce(F.sum("s").over(W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b"), F.sum("s").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("all"))
    end = F.sum("k").over(W.partitionBy("r").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    placed = ranged.withColumn("e", end).join(before, "r").select("v", (F.col("b") + F.col("e")).alias("e"), "k", "all")
    at = lambda k: (F.col("e") - F.col("k") <= k) & (k < F.col("e"))
    half = sum((F.when(at(F.floor(k / 2)), F.col("v")).otherwise(0.0) for k in (F.col("all") - 1, F.col("all"))), F.lit(0.0))
    return placed.agg((F.sum(half) / 2).alias(name))


def unknown(c: str) -> Column:
    return F.count_if(F.col(c).isNull() | (F.col(c) <= 0))


def kinds(c: str) -> Column:
    """Distinct values, blanks and case aside."""
    return F.count_distinct(F.nullif(F.lower(F.trim(c)), F.lit("")))


def venn(df: DataFrame, key: list[str], member: list[Column]) -> DataFrame:
    """(region, n) over all 2^k regions of up to three sets: keys by exactly which sets they are in."""
    mask = sum(((F.max(m.cast("int")) * (1 << i)) for i, m in enumerate(member)), F.lit(0))
    got = df.groupBy(*key).agg(mask.alias("region")).groupBy("region").agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(1 << len(member)).select(F.col("id").cast("int").alias("region"))
    return spine.join(got, "region", "left").select("region", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def top(counts: DataFrame, n: int, by: str = "n", name: str = "value") -> DataFrame:
    return counts.orderBy(F.desc(by), name).limit(n)


def removal_impact(df: DataFrame, lists: DataFrame, chosen: DataFrame, key: str, list_key: str) -> DataFrame:
    """What goes with the chosen rows: how many, how many lists hold some, how many entries."""
    picked = df.join(chosen, key, "left_semi")
    entries = lists.join(chosen, key, "left_semi")
    a = picked.agg(F.count("*").alias("rows"))
    b = entries.agg(F.count_distinct(list_key).alias("lists"), F.count("*").alias("entries"))
    return a.crossJoin(b)  # one row each


def distinct_per_row(df: DataFrame, id_col: str, values: Column, drop: list[str] | None = None) -> DataFrame:
    """(value, n): in how many rows a value stands, a "(2)" behind names left out, some values not counted."""
    v = F.array_distinct(F.transform(values, lambda x: F.regexp_replace(x, r" \(\d+\)$", "")))
    out = df.select(F.explode(v).alias("value"))
    return (out.where(~F.col("value").isin(drop)) if drop else out).groupBy("value").agg(F.count("*").alias("n"))


def certainty(similarity: Column, said: Column, names: Column, spread: Column, probable: Column) -> Column:
    """0 to 100: how sure a group is one recording."""
    c = 60 + 40 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce(similarity, F.lit(0.4)) - 0.4) / 0.55))
    c = c - F.when(names > 1, 10).otherwise(0) - F.when(spread > 2, 10).otherwise(0)
    c = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(c + 0.5)))
    return F.when(said, 100.0).when(probable, F.when(spread <= 1, 60.0).otherwise(50.0)).otherwise(c).cast("long")


def copy_score(grade: Column, lossless: Column, rate: Column, bits: Column, bitrate: Column, main: Column) -> Column:
    """Grade first, then lossless, then the main place, then resolution or bit rate."""
    rank = F.when(grade == "ok", 3).when(grade == "info", 2).when(grade == "bad", 0).otherwise(1)
    quality = F.when(lossless, 1e6 + rate / 1000 * F.coalesce(F.nullif(bits, F.lit(0)), F.lit(16))).otherwise(F.coalesce(bitrate, F.lit(0)))
    return rank * 1e7 + quality + F.when(main, 5e5).otherwise(0)


def insights(df: DataFrame, group: str, order: list, key_n: str, minor: str, length: str, bpm: str) -> DataFrame:
    """Per list: totals, tempo range, and how its neighbours' keys go together."""
    from catalune.functions.music import key_fit

    w = W.partitionBy(group).orderBy(*order)
    fit = key_fit(F.lag(key_n).over(w), F.lag(minor).over(w), F.col(key_n), F.col(minor))
    d = df.withColumns({"__fit": fit, "__i": F.row_number().over(w)}).withColumn("__pair", F.col("__i") > 1)
    return d.groupBy(group).agg(
        F.count("*").alias("n"), known_sum(length).alias("total"), F.min(F.when(F.col(bpm) > 0, F.col(bpm))).alias("slowest"), F.max(F.when(F.col(bpm) > 0, F.col(bpm))).alias("fastest"),
        F.count_if(F.col("__pair") & (F.col("__fit") >= 0.85)).alias("good"), F.count_if(F.col("__pair") & (F.col("__fit") >= 0.5) & (F.col("__fit") < 0.85)).alias("ok"),
        F.count_if(F.col("__pair") & (F.col("__fit") < 0.5)).alias("clash"), F.count_if(F.col("__pair") & F.col("__fit").isNull()).alias("unknown"),
    )
