"""Following an external tree: by id, then by path; renames, held deletions, order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gone_for_good(seen: DataFrame, reads: DataFrame, key: list[str], at: str, read_at: str, seconds: int) -> DataFrame:
    """Keys that two readings at least ``seconds`` apart both missed: last seen before the first of them.

    ``reads`` are the times of complete readings, in event time, so a rerun decides alike.
    """
    last = reads.agg(F.max(read_at).alias("__last"))
    first = reads.crossJoin(F.broadcast(last)).where(F.col(read_at) <= F.col("__last") - F.make_interval(secs=F.lit(seconds))).agg(F.max(read_at).alias("__first"))
    return seen.crossJoin(F.broadcast(first)).where(F.col(at) < F.col("__first")).select(*key)


def synced(have: DataFrame, read: DataFrame, complete: bool = True) -> DataFrame:
    """have (id, ext, path, name) against read (ext, path, name): (id, ext, path, name, state).

    Matched by ext, else by path; matched with another name is renamed; a list that wasn't read is held, and only if
    the reading was complete; what was read and is unknown is new.
    """
    by_ext = have.join(read.select("ext", F.col("path").alias("p2"), F.col("name").alias("n2")), "ext")
    left = have.join(by_ext.select("id"), "id", "left_anti")
    free = read.join(by_ext.select("ext"), "ext", "left_anti")
    by_path = left.drop("ext").join(free.select(F.col("ext"), "path", F.col("name").alias("n2")), "path").withColumn("p2", F.col("path"))
    by_path = by_path.withColumn("__n", F.row_number().over(W.partitionBy("ext").orderBy("id"))).where("__n = 1").drop("__n")
    cols = ["id", "ext", "p2", "n2", "name"]
    matched = by_ext.select(*cols).unionByName(by_path.select(*cols))
    state = F.when(F.col("name") == F.col("n2"), "kept").otherwise("renamed")
    out = matched.select("id", "ext", F.col("p2").alias("path"), F.col("n2").alias("name"), state.alias("state"))
    missed = have.join(out.select("id"), "id", "left_anti").select("id", "ext", "path", "name", F.lit("held" if complete else "kept").alias("state"))
    new = read.join(out.select("ext"), "ext", "left_anti").select(F.lit(None).cast(have.schema["id"].dataType).alias("id"), "ext", "path", "name", F.lit("new").alias("state"))
    return out.unionByName(missed).unionByName(new)


def merge_order(base: list, own: list, other: list, hidden: frozenset = frozenset()) -> list:
    """Three-way merge of ordered items: removals of either side count, the other side's additions go behind the
    nearest item that precedes them there and is left, own order kept; hidden items stay where they were."""
    b, mine, theirs = set(base), set(own), set(other)
    out = [x for x in own if x in theirs or x not in b or x in hidden]
    for i, x in enumerate(other):
        if x in b or x in mine:
            continue
        at = next((out.index(p) + 1 for p in reversed(other[:i]) if p in out), 0)
        out.insert(at, x)
    return out


def merged_orders(df: DataFrame, key: str, base: str, own: str, other: str) -> DataFrame:
    """merge_order of each row's three arrays; one list fits a row, so this runs batch by batch, not by group."""

    def run(batches):
        for pdf in batches:
            pdf["items"] = [merge_order(list(x), list(y), list(z)) for x, y, z in zip(pdf["b"], pdf["o"], pdf["r"], strict=True)]
            yield pdf[["k", "items"]]

    d = df.select(F.col(key).alias("k"), F.col(base).alias("b"), F.col(own).alias("o"), F.col(other).alias("r"))
    return d.mapInPandas(run, f"k {df.schema[key].dataType.simpleString()}, items array<string>").withColumnRenamed("k", key)
