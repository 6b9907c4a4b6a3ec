"""Duplicate detection: fingerprint pieces joined within bounded buckets, groups, best copies, rewritten lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalune.operators import graphs

MOST = 60  #: pieces under one key; keys with more tell nothing apart and are left out, which is the operator's rule


def pieces(fps: DataFrame, id_col: str, words: str, loud: str | None = None, least: int = 64) -> DataFrame:
    """(id, key, pos): two tagged 16-bit halves of each 32-bit word of a loud enough frame."""
    d = fps.select(F.col(id_col).alias("id"), F.posexplode(words).alias("pos", "w"), *([F.col(loud).alias("__l")] if loud else []))
    if loud:
        d = d.where(F.get("__l", F.col("pos")) >= least)
    low, high = F.col("w").bitwiseAND(65535), F.shiftrightunsigned(F.col("w"), 16).bitwiseAND(65535) + 65536
    return d.select("id", F.explode(F.array(low, high)).alias("key"), "pos")


def votes(p: DataFrame, fresh: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """(a, b, off, n): how often two tracks share a piece at an offset. Keys with more than ``most`` pieces are left
    out, so a key gives at most most²/2 pairs. With ``fresh`` ids, only pairs that hold one of them."""
    size = p.groupBy("key").agg(F.count("*").alias("__n")).where(F.col("__n").between(2, most)).select("key")
    p = p.join(size, "key")
    x, y = p, p
    if fresh is not None:
        new = fresh.select(F.col(fresh.columns[0]).alias("id"), F.lit(True).alias("fresh")).distinct()
        p = p.join(new, "id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
        x, y = p.where("fresh"), p
    x = x.select("key", F.col("id").alias("i"), F.col("pos").alias("pi"), *([F.col("fresh").alias("fi")] if fresh is not None else []))
    y = y.select("key", F.col("id").alias("j"), F.col("pos").alias("pj"), *([F.col("fresh").alias("fj")] if fresh is not None else []))
    both = x.join(y, "key")
    both = both.where("i < j") if fresh is None else both.where("i <> j and (not fj or i < j)")
    first = F.col("i") < F.col("j")
    return both.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.when(first, F.col("pj") - F.col("pi")).otherwise(F.col("pi") - F.col("pj")).alias("off")).agg(F.count("*").alias("n"))


def bit_errors(a: Column, b: Column, off: Column) -> tuple[Column, Column]:
    """Share of differing bits of two word arrays, b shifted by off, and how many words overlap."""
    start = F.greatest(F.lit(0), -off)
    n = F.greatest(F.lit(0), F.least(F.size(a) - start, F.size(b) - start - off))
    pair = F.zip_with(F.slice(a, start + 1, n), F.slice(b, start + off + 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    bits = F.aggregate(pair, F.lit(0), lambda s, x: s + x)
    return F.when(n > 0, bits / (32 * n)), n


def confirmed(v: DataFrame, fps: DataFrame, id_col: str, words: str, least_votes: int = 4, least_words: int = 1, most_errors: float = 0.3) -> DataFrame:
    """(a, b, ber, off, frames): pairs whose best offset, of the three with most pooled votes and two either side,
    has few enough differing bits over enough words."""
    w = W.partitionBy("a", "b")
    by_off = w.orderBy("off").rangeBetween(-1, 1)
    pooled = v.withColumn("pool", F.sum("n").over(by_off)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("pool"), "off")))
    best = pooled.withColumn("top", F.max("pool").over(w)).where((F.col("top") >= least_votes) & (F.col("rank") <= 3))
    tries = best.select("a", "b", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: F.col("off") + d)).alias("off")).distinct()
    fa, fb = (fps.select(F.col(id_col).alias(k), F.col(words).alias(f"w{k}")) for k in "ab")
    ber, frames = bit_errors(F.col("wa"), F.col("wb"), F.col("off"))
    scored = tries.join(fa, "a").join(fb, "b").select("a", "b", "off", ber.alias("ber"), frames.alias("frames")).where(F.col("frames") >= least_words)
    return scored.groupBy("a", "b").agg(F.min(F.struct("ber", "off", "frames")).alias("x")).select("a", "b", "x.ber", "x.off", "x.frames").where(F.col("ber") <= most_errors)


def name_groups(df: DataFrame, id_col: str, key: list[str], length: str, within: float = 3.0) -> DataFrame:
    """(id, group): rows of one key chained by lengths at most ``within`` apart; unknown lengths link to all of a key.

    Sorted by length, neighbours decide: no pairs are made, however large a key is.
    """
    w = W.partitionBy(*key).orderBy(F.col(length).asc_nulls_last(), id_col)
    any_unknown = F.max(F.col(length).isNull().cast("int")).over(W.partitionBy(*key)) == 1
    d = df.withColumn("__new", (~any_unknown & (F.col(length) - F.lag(length).over(w) > within)).cast("int"))
    d = d.withColumn("__g", F.sum(F.coalesce("__new", F.lit(0))).over(w))
    g = W.partitionBy(*key, "__g")
    return d.withColumns({"group": F.min(id_col).over(g), "__n": F.count("*").over(g)}).where("__n > 1").select(F.col(id_col).alias("id"), "group")


def groups(matches: DataFrame, manual: DataFrame | None = None, apart: DataFrame | None = None) -> DataFrame:
    """(node, label) of what sound and hand say, but for pairs kept apart."""
    e = matches.select("a", "b")
    if apart is not None:
        e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    return graphs.components(e.unionByName(manual.select("a", "b")) if manual is not None else e, "a", "b")


def best_lists(entries: DataFrame, best: DataFrame, list_col: str, item: str, pos: str) -> DataFrame:
    """Entries with each copy replaced by its best one; the first of what is then the same stays. ``best``: (item, best)."""
    d = entries.join(best.select(F.col(best.columns[0]).alias(item), F.col(best.columns[1]).alias("__b")), item, "left").withColumn(item, F.coalesce("__b", item))
    return d.groupBy(list_col, item).agg(F.min(pos).alias(pos))
