"""Trees and graphs: walks, closures, chains, components. Iterations write what they have to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_OWN: list[str] = []


def kept(df: DataFrame) -> DataFrame:
    """df written to the folder that driver and executors share, and read back: lineage ends, executors may be lost."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="catalune-"))
        base = f"file://{_OWN[0]}"
    path = f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _sibling_numbers(n: DataFrame) -> DataFrame:
    """(id, parent, __n): places from 1 among the rows of one parent, by __o and id."""
    n = kept(n.repartitionByRange("parent", "__o", "id").withColumn("pid", F.spark_partition_id()))
    own = F.row_number().over(W.partitionBy("parent", "pid").orderBy("__o", "id"))
    upto = W.partitionBy("parent").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    before = n.groupBy("parent", "pid").agg(F.count("*").alias("__c")).withColumn("__b", F.coalesce(F.sum("__c").over(upto), F.lit(0)))
    before = before.select(F.col("parent").alias("__p"), F.col("pid").alias("__q"), "__b")
    both = n.withColumn("__n", own).join(before, F.col("parent").eqNullSafe(F.col("__p")) & (F.col("pid") == F.col("__q")))
    return both.select("id", "parent", (F.col("__n") + F.col("__b")).alias("__n"))


def tree_walk(nodes: DataFrame, id_col: str, parent: str, order: Column, skip: Column | None = None) -> DataFrame:
    """Every node reachable from a root (parent null or unknown): depth, and a path of padded sibling numbers that
    sorts as the walk goes. Nodes on a cycle are never reached; subtrees of ``skip`` nodes are left out. The walk goes
    on until a level is empty, however deep the tree is.

    Siblings are numbered by ranges of the order over the whole table, each partition its own, so that very many
    children of one node, or roots, are no task of their own.
    """
    own = nodes.where(~skip) if skip is not None else nodes
    n = own.select(F.col(id_col).alias("id"), F.col(parent).alias("parent"), order.alias("__o"))
    n = _sibling_numbers(n).select("id", "parent", F.lpad(F.col("__n").cast("string"), 9, "0").alias("__n"))
    known = nodes.select(F.col(id_col).alias("parent"))
    level = n.join(known, "parent", "left_anti").select("id", F.lit(0).alias("depth"), F.col("__n").alias("path"))
    n, out, depth = kept(n), None, 0
    while True:
        level, depth = kept(level), depth + 1
        out = level if out is None else out.unionByName(level)
        if level.isEmpty():
            break
        level = n.join(level.select(F.col("id").alias("parent"), F.col("path").alias("__p")), "parent").select("id", F.lit(depth).alias("depth"), F.concat("__p", F.lit("/"), "__n").alias("path"))
    return out


def closure(nodes: DataFrame, id_col: str, parent: str) -> DataFrame:
    """(ancestor, id, depth) of every node and each of its ancestors, itself included, however deep; a pair that a cycle
    gives again isn't followed further, so cycles end."""
    link = nodes.select(F.col(id_col).alias("id"), F.col(parent).alias("up"))
    link = kept(link)
    step = link.select(F.col("id").alias("ancestor"), "id", F.lit(0).alias("depth"))
    out, depth = step, 0
    while True:
        depth += 1
        up = step.join(link.select(F.col("id").alias("ancestor"), F.col("up")), "ancestor").where("up is not null and up <> id")
        step = up.select(F.col("up").alias("ancestor"), "id", F.lit(depth).alias("depth")).distinct()
        if depth >= 64 and depth % 16 == 0:  # deeper than trees are: a cycle that a node leads into gives known pairs only
            step = step.join(out.select("ancestor", "id"), ["ancestor", "id"], "left_anti")
        step = kept(step)
        if step.isEmpty():
            break
        out = out.unionByName(step)
    return out.groupBy("ancestor", "id").agg(F.min("depth").alias("depth"))


def linked_order(items: DataFrame, chain: str, id_col: str, next_col: str) -> DataFrame:
    """Places (from 0) along next-pointers by pointer doubling: log2 of the longest chain joins. Items that no chain
    from a head reaches follow, by id."""
    nodes = items.select(F.col(chain).alias("c"), F.col(id_col).alias("id"), F.col(next_col).alias("to"))
    there = nodes.select("c", F.col("id").alias("to"), F.lit(True).alias("__there"))
    nodes = nodes.join(there, ["c", "to"], "left").select("c", "id", F.when(F.col("__there"), F.col("to")).alias("to"))
    # distance to the end of the chain, doubled each round; a cycle never gets one, and rounds that end nothing are the last
    step = kept(nodes.select("c", "id", "to", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("d")))
    open_ = step.where("to is not null").count()
    while open_:
        ahead = step.select("c", F.col("id").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"))
        far = F.when(F.col("to").isNull(), F.col("d")).otherwise(F.col("d") + F.col("d2"))
        step = kept(step.join(ahead, ["c", "to"], "left").select("c", "id", F.col("to2").alias("to"), far.alias("d")))
        was, open_ = open_, step.where("to is not null").count()
        if was == open_:
            break
    ends = kept(step.select("c", "id", F.when(F.col("to").isNull(), F.col("d")).alias("left")))
    # where each distance occurs once and none is missing, it is the place; only other chains need to be sorted
    sizes = ends.groupBy("c").agg(F.count("*").alias("n"), F.count("left").alias("known"), F.max("left").alias("most"))
    twice = ends.where("left is not null").groupBy("c", "left").agg(F.count("*").alias("k")).where("k > 1").select("c").distinct().withColumn("forked", F.lit(True))
    whole = sizes.join(twice, "c", "left").withColumn("simple", F.col("forked").isNull() & (F.col("known") == F.col("n")) & (F.col("most") == F.col("n") - 1)).select("c", "n", "simple")
    both = ends.join(whole, "c")
    w = W.partitionBy("c").orderBy(F.col("left").isNull(), F.desc("left"), "id")
    placed = both.where("simple").select("c", "id", (F.col("n") - 1 - F.col("left")).cast("long").alias("pos"))
    sorted_ = both.where("not simple").select("c", "id", (F.row_number().over(w) - 1).cast("long").alias("pos"))
    return placed.unionByName(sorted_).select(F.col("c").alias(chain), F.col("id").alias(id_col), "pos")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the smallest node of each component, for nodes with links; alternating star contractions."""
    e = kept(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = kept(e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or now[0] == 0:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
