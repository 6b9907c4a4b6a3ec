"""Smaller operators: detection, retries, plans for downloads, bands of a spectrum, text merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def detected(found: DataFrame, known: DataFrame, slack: int = 1) -> DataFrame:
    """found (place, path, app, file, mtime) against known (id, place, path, app, file, mtime): state and the known id.

    The place and path decide, else app and file if one known library only has them; a newer file is changed.
    """
    k1 = known.select("place", "path", F.col("id").alias("id1"), F.col("mtime").alias("m1"))
    k2 = known.groupBy("app", "file").agg(F.count("*").alias("__n"), F.min("id").alias("id2"), F.min("mtime").alias("m2")).where("__n = 1").drop("__n")
    d = found.join(k1, ["place", "path"], "left").join(k2, ["app", "file"], "left")
    id_, m = F.coalesce("id1", "id2"), F.when(F.col("id1").isNotNull(), F.col("m1")).otherwise(F.col("m2"))
    state = F.when(id_.isNull(), "new").when(F.col("mtime") - m > slack, "changed").otherwise("imported")
    return d.select("place", "path", "app", "file", id_.alias("id"), state.alias("state"))


def retry_wait(n: Column, schedule: str = "soon") -> Column:
    """Seconds before the n-th try (from 1): soon doubles to 15 without end, late grows by 8 to 60, ten times."""
    if schedule == "soon":
        return F.least(F.lit(15), F.pow(F.lit(2), F.least(n - 1, F.lit(10))).cast("int"))
    return F.when(n <= 10, F.least(F.lit(60), 8 * n))


def retry_state(failures: DataFrame, key: str, order: str, transient: Column, most: int = 3) -> DataFrame:
    """(key, tries, state): waiting for another try, failed for good, or given up."""
    d = failures.withColumn("__again", transient).groupBy(key).agg(F.count("*").cast("int").alias("tries"), F.max_by("__again", order).alias("__last"))
    return d.select(key, "tries", F.when(~F.col("__last"), "failed").when(F.col("tries") >= most, "gave up").otherwise("waiting").alias("state"))


def text_merge(local: Column, remote: Column) -> Column:
    """Both texts, one a line, unless one holds the other."""
    l, r = F.trim(F.coalesce(local, F.lit(""))), F.trim(F.coalesce(remote, F.lit("")))  # noqa: E741
    return F.when(F.contains(l, r), l).when(F.contains(r, l), r).otherwise(F.concat(l, F.lit("\n"), r))


def order_clash(base: Column, local: Column, remote: Column) -> Column:
    """Both sides put their common items in another order than the base has, and not in the same."""
    common = F.array_intersect(F.array_intersect(base, local), remote)
    in_order = lambda a: F.filter(a, lambda x: F.array_contains(common, x))
    b, l, r = in_order(base), in_order(local), in_order(remote)  # noqa: E741
    return (l != b) & (r != b) & (l != r)


def download_plan(entries: DataFrame, list_col: str, name: Column, ext: Column, order: list) -> DataFrame:
    """Adds file: a padded number, a portable name, unique within its list whatever the case."""
    from catalune.functions.text import safe_name

    w = W.partitionBy(list_col)
    d = entries.withColumns({"__n": F.row_number().over(w.orderBy(*order)).cast("string"), "__c": F.count("*").over(w).cast("string"), "__name": safe_name(name)})
    d = d.withColumn("__base", F.concat(F.lpad("__n", F.greatest(F.lit(2), F.length("__c")), F.lit("0")), F.lit(" "), F.col("__name"), ext))
    return d.withColumn("file", F.col("__base")).drop("__n", "__c", "__name", "__base")


def band_levels(df: DataFrame, key: list[str], band: str, level: str, parts: tuple = (0.1, 0.5, 0.95)) -> DataFrame:
    """Per key and band the levels below which given shares of its frames lie."""
    return df.groupBy(*key, band).agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {level})").alias(f"p{int(p * 100)}") for p in parts))


def beyond_wall(levels: DataFrame, key: list[str], band: str, wall: Column, level: str = "p95", least: float = 0.0) -> DataFrame:
    """Per key: how many bands above the wall still sound, the highest of them, and the gaps below the wall."""
    above, loud = F.col(band) > wall, F.col(level) > least
    return levels.groupBy(*key).agg(F.count_if(above & loud).alias("beyond"), F.max(F.when(above & loud, F.col(band))).alias("highest"), F.count_if(~above & ~loud).alias("holes"))


def impact_text(rows: Column, rated: Column, lists: Column) -> Column:
    """"412 songs, 30 rated, in 5 playlists"."""
    many = lambda n, w: F.concat(n.cast("string"), F.lit(f" {w}"), F.when(n == 1, "").otherwise("s"))
    return F.concat_ws(", ", many(rows, "song"), F.when(rated > 0, F.concat(rated.cast("string"), F.lit(" rated"))), F.when(lists > 0, F.concat(F.lit("in "), many(lists, "playlist"))))
