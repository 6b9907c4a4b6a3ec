"""Queries of the smaller operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalune.functions import dates, music
from catalune.operators import further as U
from catalune.queries import query


@query(
    "detect_libraries", "M2 S6 M34",
    """WITH k AS (SELECT p_partkey AS id, p_brand AS place, p_name AS path, p_type AS app, cast(p_size AS VARCHAR) AS file, p_retailprice AS mtime FROM part WHERE p_partkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) = 1),
       f AS (SELECT p_partkey, p_brand AS place, p_name AS path, p_type AS app, cast(p_size AS VARCHAR) AS file, p_retailprice + CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END AS mtime FROM part WHERE p_partkey % 7 = 0),
       u AS (SELECT app, file, min(id) AS id, min(mtime) AS mtime FROM k GROUP BY 1, 2 HAVING count(*) = 1)
       SELECT f.place, f.path, f.app, f.file, coalesce(k.id, u.id) AS id, CASE WHEN coalesce(k.id, u.id) IS NULL THEN 'new' WHEN f.mtime - CASE WHEN k.id IS NOT NULL THEN k.mtime ELSE u.mtime END > 1 THEN 'changed' ELSE 'imported' END AS state
       FROM f LEFT JOIN k ON k.place = f.place AND k.path = f.path LEFT JOIN u ON u.app = f.app AND u.file = f.file""",
)
def detect_libraries(t):
    cols = [F.col("p_brand").alias("place"), F.col("p_name").alias("path"), F.col("p_type").alias("app"), F.col("p_size").cast("string").alias("file")]
    p = t.part
    known = p.where("p_partkey % 3 = 0").withColumn("n", F.row_number().over(W.partitionBy("p_brand", "p_name").orderBy("p_partkey"))).where("n = 1").select(F.col("p_partkey").alias("id"), *cols, F.col("p_retailprice").alias("mtime"))
    found = p.where("p_partkey % 7 = 0").select(*cols, (F.col("p_retailprice") + F.when(F.col("p_partkey") % 2 == 0, 2).otherwise(0)).alias("mtime"))
    return U.detected(found, known)


@query("retry_backoff", "M33", "SELECT cast(n AS INTEGER) AS n, cast(least(15, pow(2, least(n - 1, 10))) AS INTEGER) AS soon, CASE WHEN n <= 10 THEN cast(least(60, 8 * n) AS INTEGER) END AS late FROM range(1, 15) r(n)")
def retry_backoff(t):
    n = F.col("id").cast("int")
    return t.spark.range(1, 15).select(n.alias("n"), U.retry_wait(n).alias("soon"), U.retry_wait(n, "late").alias("late"))


@query("retry_states", "C19 F8", "SELECT user_id, cast(count(*) AS INTEGER) AS tries, CASE WHEN max_by(value, event_id) >= 50 THEN 'failed' WHEN count(*) >= 3 THEN 'gave up' ELSE 'waiting' END AS state FROM events WHERE event_type = 'error' GROUP BY user_id")
def retry_states(t):
    return U.retry_state(t.events.where("event_type = 'error'"), "user_id", "event_id", F.col("value") < 50)


@query("text_merge", "P33", "SELECT p_partkey, CASE WHEN contains(p_name, split_part(p_name, ' ', 1)) AND p_partkey % 2 = 0 THEN p_name ELSE p_name || chr(10) || p_brand END AS merged FROM part")
def text_merge(t):
    other = F.when(F.col("p_partkey") % 2 == 0, F.substring_index("p_name", " ", 1)).otherwise(F.col("p_brand"))
    return t.part.select("p_partkey", U.text_merge(F.col("p_name"), other).alias("merged"))


@query("order_clashes", "C10", "SELECT n_regionkey, n_regionkey % 2 = 1 AS clash FROM nation GROUP BY n_regionkey")
def order_clashes(t):
    l = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("b"))  # noqa: E741
    swapped = F.concat(F.slice("b", 2, 1), F.slice("b", 1, 1), F.slice("b", 3, 9))
    return l.select("n_regionkey", U.order_clash(F.col("b"), F.reverse("b"), F.when(F.col("n_regionkey") % 2 == 1, swapped).otherwise(F.col("b"))).alias("clash"))


@query("download_plan", "S21 M18", """WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS n, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem)
       SELECT l_orderkey, lpad(cast(n AS VARCHAR), cast(greatest(2, length(cast(c AS VARCHAR))) AS INTEGER), '0') || ' ' || p_name || '.bin' AS file FROM r JOIN part ON p_partkey = l_partkey""")
def download_plan(t):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return U.download_plan(d, "l_orderkey", F.col("p_name"), F.lit(".bin"), ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]).select("l_orderkey", "file")


@query(
    "band_levels", "D9 D10",
    """WITH b AS (SELECT label, i AS band, embedding[i]::DOUBLE AS level FROM embeddings, range(1, 17) r(i)), p AS (SELECT label, band, quantile_disc(level, 0.95) AS p95 FROM b GROUP BY 1, 2)
       SELECT label, count(*) FILTER (WHERE band > 10 AND p95 > 0.2) AS beyond, max(CASE WHEN band > 10 AND p95 > 0.2 THEN band END) AS highest, count(*) FILTER (WHERE band <= 10 AND p95 <= 0.2) AS holes FROM p GROUP BY label""",
)
def band_levels(t):
    b = t.embeddings.select("label", F.posexplode(F.slice("embedding", 1, 16)).alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("band"), F.col("x").cast("double").alias("level"))
    return U.beyond_wall(U.band_levels(b, ["label"], "band", "level", (0.95,)), ["label"], "band", F.lit(10), least=0.2)


@query("impact_texts", "P30 A13", """SELECT p_brand, cast(count(*) AS VARCHAR) || CASE WHEN count(*) = 1 THEN ' song' ELSE ' songs' END || CASE WHEN count(*) FILTER (WHERE p_size > 45) > 0 THEN ', ' || cast(count(*) FILTER (WHERE p_size > 45) AS VARCHAR) || ' rated' ELSE '' END
       || ', in ' || cast(count(DISTINCT p_type) AS VARCHAR) || CASE WHEN count(DISTINCT p_type) = 1 THEN ' playlist' ELSE ' playlists' END AS text FROM part GROUP BY p_brand""")
def impact_texts(t):
    d = t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 45).alias("r"), F.count_distinct("p_type").alias("l"))
    return d.select("p_brand", U.impact_text(F.col("n"), F.col("r"), F.col("l")).alias("text"))


@query("snap_and_loop", "P27", """WITH g AS (SELECT event_id, value AS t, 90 + event_id % 60 AS bpm FROM events), s AS (SELECT event_id, greatest(0.0, 0.25 + floor((t - 0.25) / (60.0 / bpm) + 0.5) * (60.0 / bpm)) AS snapped, bpm FROM g)
       SELECT event_id, round(snapped, 6) AS snapped, round(snapped + 4 * 60.0 / bpm, 6) AS loop_end FROM s""")
def snap_and_loop(t):
    d = t.events.select("event_id", F.col("value").alias("t"), (90 + F.col("event_id") % 60).alias("bpm"))
    d = d.withColumn("s", music.snapped(F.col("t"), F.lit(0.25), F.col("bpm")))
    return d.select("event_id", F.round("s", 6).alias("snapped"), F.round(F.col("s") + 4 * 60.0 / F.col("bpm"), 6).alias("loop_end"))


@query("set_lengths", "P28", "SELECT event_id, CASE WHEN (event_id * 37) % 1440 > (event_id * 91) % 1440 THEN ((event_id * 37) % 1440 - (event_id * 91) % 1440) * 60 ELSE ((event_id * 37) % 1440 - (event_id * 91) % 1440) * 60 + 86400 END AS seconds FROM events")
def set_lengths(t):
    at = lambda m: F.timestamp_seconds((F.col("event_id") * m % 1440) * 60)
    return t.events.select("event_id", dates.set_seconds(at(91), at(37)).alias("seconds"))


@query("change_feed", "C15 T8", "SELECT event_id AS rev FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 200")
def change_feed(t):
    newest = t.events.agg(F.max("event_id")).first()[0]
    from catalune.streaming.changes import feed

    return feed(t.events.select(F.col("event_id").alias("rev")), "rev", newest - 200, newest).select("rev")


@query("file_scan_states", "S5 J23 S3", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'missing' WHEN page_id % 5 = 0 THEN 'changed' ELSE 'same' END AS state FROM pages")
def file_scan_states(t):
    from catalune.operators.changes import reconcile

    known = t.pages.select("page_id", F.length("html").alias("size"))
    seen = known.where("page_id % 4 <> 0").withColumn("size", F.col("size") + F.when(F.col("page_id") % 5 == 0, 1).otherwise(0))
    return reconcile(known, seen, ["page_id"], ["size"])
