"""Browsing by the values of a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def year_of(c: Column) -> Column:
    """The first year 1800 to 2099 that stands by itself, or ''."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"\b(1[89]\d\d|20\d\d)\b", 1)


def decade_of(year: Column) -> Column:
    return F.when(year != "", F.concat(F.substring(year, 1, 3), F.lit("0s"))).otherwise("")


def value_counts(df: DataFrame, value: Column, ord_col: str, fold: bool = True) -> DataFrame:
    """(value, n): blanks dropped, any case one value, shown as first spelled."""
    v = df.select(F.trim(value).alias("v"), F.col(ord_col).alias("o")).where("v <> ''")
    return v.groupBy((F.lower("v") if fold else F.col("v")).alias("k")).agg(F.min_by("v", "o").alias("value"), F.count("*").alias("n")).select("value", "n")


def _modal(counts: DataFrame, key: list[str], spelling: str, n: str) -> DataFrame:
    """The spelling with most rows; ties: one with a capital first, then the first in order."""
    small = (~F.col(spelling).rlike(r"^\p{Lu}")).cast("int")
    return counts.groupBy(*key).agg(F.min_by(spelling, F.struct(-F.col(n), small, F.col(spelling))).alias(spelling))


def facet_items(df: DataFrame, value: str, seconds: str, artist: str | None = None, share: float = 0.6) -> DataFrame:
    """Every value of a field: key, value (as most rows spell it), tracks, seconds; with an artist column also sub: the
    leading artist, or "Various artists" where there are several and it has less than ``share`` of the rows.

    Rows are pre-aggregated by spelling, so a value with very many rows is no more than a few rows afterwards.
    """
    v = F.trim(F.coalesce(value, F.lit("")))
    spelled = df.groupBy(F.lower(v).alias("key"), v.alias("value")).agg(F.count("*").alias("n"), F.sum(seconds).alias("s"))
    total = spelled.groupBy("key").agg(F.sum("n").alias("tracks"), F.sum("s").alias("seconds"))
    out = total.join(_modal(spelled, ["key"], "value", "n"), "key")
    if artist is None:
        return out
    a = F.trim(F.coalesce(artist, F.lit("")))
    by = df.where(a != "").groupBy(F.lower(v).alias("key"), F.lower(a).alias("ak")).agg(F.count("*").alias("an"), F.min(a).alias("shown"))
    top = by.groupBy("key").agg(F.count("*").alias("kinds"), F.max("an").alias("most"), F.min_by("shown", F.struct(-F.col("an"), F.col("ak"))).alias("lead"))
    sub = F.when((F.col("kinds") > 1) & (F.col("most") / F.col("tracks") < share), "Various artists").otherwise(F.coalesce("lead", F.lit("")))
    return out.join(top, "key", "left").select("key", "value", "tracks", "seconds", sub.alias("sub"))


def facet_sorted(items: DataFrame, by: str = "name", numeric: bool = True) -> DataFrame:
    """By name (numbers in it by value) or by rows; the blank value last."""
    name = [F.lower("value")]
    if numeric:  # digits padded, so that 9 comes before 10
        name = [F.array_join(F.transform(F.regexp_extract_all(F.lower("value"), F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 12, "0")).otherwise(p)), "")]
    return items.orderBy((F.col("key") == "").cast("int"), *([F.desc("tracks")] if by == "tracks" else []), *name, "key")


def first_each(df: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
