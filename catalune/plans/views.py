"""Named views of a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent(df: DataFrame, at: str, now: DataFrame, days: int = 30) -> DataFrame:
    """Rows of the last days; ``now`` is a frame of one row, its only column the moment."""
    (name,) = now.columns
    return df.crossJoin(F.broadcast(now)).where(F.col(at) > F.col(name) - F.make_interval(days=F.lit(days))).drop(name)


def where(cond: Column):
    return lambda df: df.where(cond)


def members(df: DataFrame, entries: DataFrame, key: str, list_col: str, list_id, pos: str) -> DataFrame:
    """A list's rows in its order; entries without a row are dropped, repeated ones count once."""
    own = entries.where(F.col(list_col) == list_id).groupBy(key).agg(F.min(pos).alias("__pos"))
    return df.join(own, key).orderBy("__pos").drop("__pos")


VIEWS = {
    "all": lambda df: df,
    "recent": recent,
    "pending": lambda df, state="state": df.where(F.col(state) == "waiting"),
    "failed": lambda df, state="state": df.where(F.col(state) == "failed"),
    "unlinked": lambda df, status="status": df.where(F.col(status) != "linked"),
    "attention": lambda df, grade="grade": df.where(F.col(grade).isin("warn", "bad")),
    "list": members,
    "source": lambda df, source, col="sources": df.where(F.array_contains(col, source)),
    "tag": lambda df, tag, col="tags": df.where(F.exists(col, lambda t: F.lower(t) == tag.lower())),
    "root": lambda df, root, col="root_id": df.where(F.col(col) == root),
    "facet": lambda df, value, key: df.where(F.lower(F.trim(value)) == key),
    "dupes": lambda df, group="group": df.where(F.col(group).isNotNull()),
}
