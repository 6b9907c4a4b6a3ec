"""The interactive list as one lazy plan: filter, search, collapse duplicates, sort, first page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalune.operators import views


def listing(rows: DataFrame, single: dict, text: str, text_cols: list[str], group: str | None, group_order: list, key: Column, ord_col: str, down: bool = False, limit: int = 100) -> DataFrame:
    """Filters come before duplicates are collapsed: a group shows its first row that passes. The sort and the limit
    are one top-k; only that page is numbered."""
    out = views.search(views.facet_filter(rows, single), text, text_cols)
    if group:
        out = views.collapse(out, group, group_order)
    page = views.keyed_sort(out, key, ord_col, down).limit(limit)
    by = [key.isNull(), key, F.col(ord_col)]
    return page.withColumn("place", F.row_number().over(W.orderBy(*(b.desc() if down else b.asc() for b in by))))


def global_position(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds each row's place (from 1) in a global order without bringing all rows to one task.

    Rows are dealt into ranges; a range's first place is what lies in the ranges before, of which there is one count
    each. The order must be total.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number isn't changed at run time
    ranged = df.repartitionByRange(n, *order).withColumn("__r", F.spark_partition_id())
    sizes = ranged.groupBy("__r").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__b", F.coalesce(F.sum("__n").over(W.orderBy("__r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__r", "__b")
    numbered = ranged.withColumn("__i", F.row_number().over(W.partitionBy("__r").orderBy(*order)))
    return numbered.join(before, "__r").withColumn(name, F.col("__b") + F.col("__i")).drop("__r", "__b", "__i")
