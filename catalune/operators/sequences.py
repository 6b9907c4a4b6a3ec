"""Windows over ordered rows: positions, runs, ramps, rates, smoothing. Orders must be total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ramp(i: Column, n: Column, start: float, end: float) -> Column:
    """The i-th (from 0) of n targets from start to end."""
    return F.when(n <= 1, start).otherwise(start + (end - start) * i / (n - 1))


def islands(df: DataFrame, key: list, order: list, on: Column) -> DataFrame:
    """(key..., first, last, n) of each run of consecutive rows for which ``on`` holds; first and last are positions."""
    w = W.partitionBy(*key).orderBy(*order)
    d = df.withColumns({"__i": F.row_number().over(w), "__on": F.coalesce(on, F.lit(False))})
    d = d.withColumn("__run", F.col("__i") - F.sum(F.col("__on").cast("long")).over(w))
    return d.where("__on").groupBy(*key, "__run").agg(F.min("__i").alias("first"), F.max("__i").alias("last"), F.count("*").alias("n")).drop("__run")


def smooth(value: Column, key: list, order: list, width: int) -> Column:
    """Mean of the ``width`` rows before, the row and as many after it, fewer at the ends."""
    return F.avg(value).over(W.partitionBy(*key).orderBy(*order).rowsBetween(-width, width))


def rises(value: Column, key: list, order: list) -> Column:
    """How much a value is above the one before, 0 if not."""
    return F.greatest(F.lit(0.0), value - F.lag(value).over(W.partitionBy(*key).orderBy(*order)))


def deltas(value: Column, key: list, order: list, mod: int = 256) -> Column:
    """Difference to the row before, modulo; the first row is kept."""
    w = W.partitionBy(*key).orderBy(*order)
    return F.pmod(value - F.coalesce(F.lag(value).over(w), F.lit(0)), F.lit(mod))


def undelta(delta: Column, key: list, order: list, mod: int = 256) -> Column:
    return F.pmod(F.sum(delta).over(W.partitionBy(*key).orderBy(*order)), F.lit(mod))


def trailing_rate(df: DataFrame, key: list, ms: str, amount: str, span_ms: int, least_ms: int) -> DataFrame:
    """Adds rate: amount a second over the trailing span, null before ``least_ms`` of it are seen."""
    w = W.partitionBy(*key).orderBy(ms).rangeBetween(-span_ms, 0)
    seen = F.col(ms) - F.min(ms).over(w)
    return df.withColumn("rate", F.when(seen >= least_ms, F.sum(amount).over(w) / (seen / 1000)))


def autocorrelation(df: DataFrame, key: list[str], pos: str, value: str, lags: int) -> DataFrame:
    """(key..., lag, r): Σ e(i) e(i-L) / (n-L) for L = 1 .. lags; an equi-join on the shifted position."""
    n = df.groupBy(*key).agg(F.count("*").alias("n"))
    later = df.select(*key, F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), F.col(pos).alias("__p"), F.col(value).alias("__v")).withColumn(pos, F.col("__p") - F.col("lag"))
    return later.join(df.select(*key, pos, value), [*key, pos]).groupBy(*key, "lag").agg(F.sum(F.col("__v") * F.col(value)).alias("s")).join(n, key).select(*key, "lag", (F.col("s") / (F.col("n") - F.col("lag"))).alias("r"))


def shrunk(df: DataFrame, key: list, order: list, value: str, parts: int, how=F.max) -> DataFrame:
    """(key..., part, value): rows cut into ``parts`` equal pieces, each summed up by ``how``."""
    w = W.partitionBy(*key)
    d = df.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    return d.groupBy(*key, F.floor(F.col("__i") * parts / F.col("__n")).cast("int").alias("part")).agg(how(value).alias(value))
