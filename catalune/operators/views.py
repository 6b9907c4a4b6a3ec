"""The list query: views, facet filters, search, duplicate collapse, sort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def classify(remote: Column, linked: Column, stale: Column, error: Column, transient: Column) -> Column:
    """Where a row's analysis stands: done, failed, waiting, elsewhere or nofile."""
    return F.when(remote, F.when(error & ~transient, "failed").otherwise("elsewhere")).when(~linked, "nofile").when(stale, "waiting").when(error, F.when(transient, "waiting").otherwise("failed")).otherwise("done")


def facet_filter(df: DataFrame, single: dict[str, list], many: dict[str, list] | None = None, any_of: bool = False) -> DataFrame:
    """Or within a column's values, and across columns; array columns must hold all values, or any of them."""
    conds = [F.col(c).isin(v) for c, v in single.items() if v]
    for c, v in (many or {}).items():
        want = F.array(*map(F.lit, v))
        if v:
            conds.append(F.arrays_overlap(c, want) if any_of else F.size(F.array_except(want, c)) == 0)
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def search(df: DataFrame, text: str, cols: list[str]) -> DataFrame:
    """Rows whose columns hold every word of the text somewhere, whatever the case."""
    hay = F.lower(F.concat_ws(" ", *cols))
    words = text.lower().split()
    return df.where(reduce(lambda a, b: a & b, [F.contains(hay, F.lit(w)) for w in words])) if words else df


def values_of(df: DataFrame, col: str, none: str) -> DataFrame:
    """One row a value of an array column; rows without values get the bucket ``none``."""
    return df.withColumn(col, F.explode(F.when(F.coalesce(F.size(col), F.lit(0)) <= 0, F.array(F.lit(none))).otherwise(F.col(col))))


def counts_except(df: DataFrame, ticked: dict[str, list]) -> DataFrame:
    """(facet, value, n): each facet's counts under the filters of all others; ticked values without rows count 0.

    One pass: each row is tagged with the facets whose filter it fails; a row counts for a facet if it fails no other.
    """
    fails = {c: (~F.col(c).isin(v) if v else F.lit(False)) for c, v in ticked.items()}
    bad = reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(True)).cast("int") for f in fails.values()])
    one = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"), (F.col("__bad") - F.coalesce(f, F.lit(True)).cast("int") == 0).alias("on")) for c, f in fails.items()))
    got = df.withColumn("__bad", bad).select(F.explode(one).alias("x")).select("x.*").where("on").groupBy("facet", "value").agg(F.count("*").alias("n"))
    want = [(c, str(x)) for c, v in ticked.items() for x in v]
    if not want:
        return got
    spine = df.sparkSession.createDataFrame(want, "facet string, value string")
    return got.join(spine, ["facet", "value"], "full_outer").select("facet", "value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def collapse(df: DataFrame, group: str, order: list) -> DataFrame:
    """Of rows that share a group the first stays; rows without one all do."""
    alone = df.where(F.col(group).isNull())
    first = df.where(F.col(group).isNotNull()).withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy(*order))).where("__n = 1").drop("__n")
    return alone.unionByName(first)


def keyed_sort(df: DataFrame, key: Column, ord_col: str, down: bool = False) -> DataFrame:
    """By key, then by the given order; missing last. Downwards all of it is turned round, missing first."""
    by = [key.isNull(), key, F.col(ord_col)]
    return df.orderBy(*(b.desc() if down else b.asc() for b in by))


def keyset_page(df: DataFrame, cursor: str, after: int, limit: int, cost: str | None = None, budget: int | None = None) -> DataFrame:
    """Rows beyond a cursor, at most ``limit``; of these as many as keep the running cost within the budget, one at least."""
    page = df.where(F.col(cursor) > after).orderBy(cursor).limit(limit)
    if cost is None:
        return page
    # the page is bounded by limit, so one task may run through it
    w = W.orderBy(cursor).rowsBetween(W.unboundedPreceding, W.currentRow)
    return page.withColumns({"__run": F.sum(cost).over(w), "__n": F.row_number().over(W.orderBy(cursor))}).where((F.col("__run") <= budget) | (F.col("__n") == 1)).drop("__run", "__n")


def locale_key(c: Column) -> Column:
    """To sort texts as a reader expects: by the root locale, case and accents aside."""
    return F.collate(c, "UNICODE_CI_AI")
