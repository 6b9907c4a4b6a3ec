"""What several training-data operators need: tables, shared scratch folders, label samples, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
_LOCAL: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset: one machine) a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="catalune-"))
        base = f"file://{_LOCAL[0]}"
    return base.rstrip("/")


def open_at(uri: str):
    """pyarrow's file system and path of a URI; a path without scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Scratch:
    """A new folder in the shared one. Tables written here cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/catalune-{what}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")


def fold(id_col: str, mod: int):
    """crc32 of the id as text, modulo mod; null ids are in fold -1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod, F.lit(-1))


def label_rows(labels: DataFrame, id_col: str, label_col: str, train) -> DataFrame:
    """The ids of each class (0, 1): (id, y).

    Rows without id or label are left out, as are ids whose rows disagree; ``train`` is a condition on the rows.
    """
    return (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & train)
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("y1"))
        .where("y = y1")
        .drop("y1")
    )


def label_sample(labels: DataFrame, id_col: str, label_col: str, train, per_class: int) -> DataFrame:
    """At most per_class of label_rows of each class, the first by hash of the id: (id, y)."""
    y = label_rows(labels, id_col, label_col, train)
    one = lambda k: y.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(per_class)
    return one(0).unionByName(one(1))


def sampled_texts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whole texts of the sampled ids: (id, y, text). The sample has a fixed bound, so it is broadcast.

    Of an id with several texts the least is taken, so reruns agree; null texts stand aside for others.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return d.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("text").alias("text"))


def packed(docs: DataFrame, id_col: str, digest: Column) -> DataFrame:
    """(row, key, hash): all columns in one struct, so that no name of theirs can meet one of ours; select row.* after."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("key"), digest.alias("hash"))


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8; null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str = "text", rows: int = 2000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows and, unless one row has more, ``size`` bytes of text: what is made
    of a part stays small."""
    n = batch.num_rows
    bytes_ = np.zeros(n) if text not in batch.schema.names else pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(bytes_), 0
    while at < n:
        before = upto[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(upto, before + size, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """For mapInArrow: f on slices of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                yield f(part)

    return run


def numbered(df: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """df with ``i``, the place of each row among those of equal keys, from 0. The rows of a key may be very many: each
    partition of df counts its own, and the counts before it are added. df is written to the shared folder, so that
    both readings see the same partitions."""
    df = scratch.keep(df.withColumn("pid", F.spark_partition_id()), name)
    own = df.withColumn("i", F.row_number().over(W.partitionBy(*keys, "pid").orderBy(F.lit(0))) - 1)
    upto = W.partitionBy(*keys).orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    before = df.groupBy(*keys, "pid").agg(F.count("*").alias("own")).withColumn("before", F.coalesce(F.sum("own").over(upto), F.lit(0)))
    same = [own[k].eqNullSafe(before[k]) for k in (*keys, "pid")]
    return own.join(before, same).select(*(own[c] for c in df.columns if c != "pid"), (own["i"] + before["before"]).alias("i"))


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable, for every node that has a link to another one.

    Alternating large-star and small-star steps; the edges of each round are written to the shared folder, and a
    round that leaves their number and checksum as they were is the last. Both steps are grouped minima and joins,
    so a node with very many links is split by adaptive execution. Links of a node with itself count for nothing.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, seen, n = scratch.keep(e, "cc0"), None, 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        n += 1
        e = scratch.keep(e, f"cc{n}")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or now[0] == 0:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
