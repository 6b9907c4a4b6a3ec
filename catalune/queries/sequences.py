"""Windows over ordered rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalune.operators import sequences as S
from catalune.queries import query

KEY, ORDER = ["user_id"], ["ts", "event_id"]


@query("ordinal_position", "W1", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events")
def ordinal_position(t):
    return t.events.select("event_id", (F.row_number().over(W.partitionBy(*KEY).orderBy(*ORDER)) - 1).cast("long").alias("pos"))


@query("tempo_ramp", "W3", "SELECT event_id, round(CASE WHEN count(*) OVER (PARTITION BY user_id) <= 1 THEN 100 ELSE 100 + 40.0 * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / (count(*) OVER (PARTITION BY user_id) - 1) END, 6) AS target FROM events")
def tempo_ramp(t):
    w = W.partitionBy(*KEY)
    i, n = F.row_number().over(w.orderBy(*ORDER)) - 1, F.count("*").over(w)
    return t.events.select("event_id", F.round(S.ramp(i, n, 100.0, 140.0), 6).alias("target"))


@query("smooth", "W4 W5", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS detrended, round(10 * log10(avg(pow(10, value / 10)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), 4) AS db FROM (SELECT event_id, user_id, ts, least(value, 90) AS value FROM events)")
def smooth(t):
    d = t.events.withColumn("value", F.least("value", F.lit(90.0)))
    db = 10 * F.log10(S.smooth(F.pow(F.lit(10.0), F.col("value") / 10), KEY, ORDER, 2))
    return d.select("event_id", F.round(F.col("value") - S.smooth(F.col("value"), KEY, ORDER, 3), 6).alias("detrended"), F.round(db, 4).alias("db"))


@query(
    "islands", "W6",
    """WITH n AS (SELECT user_id, value > 20 AS on_, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT *, i - sum(on_::INT) OVER (PARTITION BY user_id ORDER BY i) AS run FROM n)
       SELECT user_id, min(i) AS first, max(i) AS last, count(*) AS n FROM r WHERE on_ GROUP BY user_id, run HAVING count(*) >= 3""",
)
def islands(t):
    return S.islands(t.events, KEY, ORDER, F.col("value") > 20).where("n >= 3").select("user_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "n")


@query("flux", "W7", "SELECT user_id, round(sum(greatest(0, value - prev)), 4) AS flux FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY user_id")
def flux(t):
    return t.events.select("user_id", S.rises(F.col("value"), KEY, ORDER).alias("r")).groupBy("user_id").agg(F.round(F.sum("r"), 4).alias("flux"))


@query(
    "acf_small", "W8",
    """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value AS v FROM events), n AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1)
       SELECT a.user_id, l AS lag, round(sum(a.v * b.v) / (any_value(n) - l), 1) AS r FROM e a JOIN range(1, 9) x(l) ON true JOIN e b ON b.user_id = a.user_id AND b.i = a.i - l JOIN n ON n.user_id = a.user_id GROUP BY a.user_id, l""",
)
def acf_small(t):
    d = t.events.select("user_id", F.row_number().over(W.partitionBy(*KEY).orderBy(*ORDER)).alias("i"), F.col("value").alias("v"))
    return S.autocorrelation(d, KEY, "i", "v", 8).select("user_id", F.col("lag").cast("long").alias("lag"), F.round("r", 1).alias("r"))


@query("first_per_key", "W9", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_per_key(t):
    from catalune.operators.facets import first_each

    return first_each(t.events, ["user_id", "event_type"], ORDER).select("user_id", "event_type", "event_id")


@query("topk_per_group", "W10", "SELECT l_orderkey, l_extendedprice, n FROM (SELECT l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS n FROM lineitem) WHERE n <= 3")
def topk_per_group(t):
    w = W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber")
    return t.lineitem.select("l_orderkey", "l_extendedprice", F.row_number().over(w).alias("n")).where("n <= 3").withColumn("n", F.col("n").cast("long"))


@query("gap_to_next", "W11", """WITH r AS (SELECT l_orderkey, l_quantity, row_number() OVER w AS n, lead(l_quantity) OVER w AS nx FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_linenumber, l_extendedprice))
       SELECT l_orderkey, l_quantity - CASE WHEN l_quantity - nx <= 3 THEN 10 ELSE 0 END AS sure FROM r WHERE n = 1""")
def gap_to_next(t):
    w = W.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    d = t.lineitem.select("l_orderkey", "l_quantity", F.row_number().over(w).alias("n"), F.lead("l_quantity").over(w).alias("nx")).where("n = 1")
    return d.select("l_orderkey", (F.col("l_quantity") - F.when(F.col("l_quantity") - F.col("nx") <= 3, 10).otherwise(0)).alias("sure"))


@query("pad_numbering", "W12 S21", """WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS n, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem)
       SELECT l_orderkey, lpad(cast(n AS VARCHAR), cast(greatest(2, length(cast(c AS VARCHAR))) AS INTEGER), '0') || ' ' || cast(l_partkey AS VARCHAR) AS file FROM r""")
def pad_numbering(t):
    w = W.partitionBy("l_orderkey")
    d = t.lineitem.select("l_orderkey", "l_partkey", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")).cast("string").alias("n"), F.count("*").over(w).cast("string").alias("c"))
    return d.select("l_orderkey", F.concat(F.lpad("n", F.greatest(F.lit(2), F.length("c")), F.lit("0")), F.lit(" "), F.col("l_partkey").cast("string")).alias("file"))


@query("trailing_rate", "W13", """WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, value FROM events), r AS (SELECT event_id, sum(value) OVER w AS s, (ms - min(ms) OVER w) AS seen FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW))
       SELECT event_id, CASE WHEN seen >= 3600000 THEN round(s / (seen / 1000.0), 9) END AS rate FROM r""")
def trailing_rate(t):
    e = t.events.select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ms"), "value")
    return S.trailing_rate(e, KEY, "ms", "value", 86_400_000, 3_600_000).select("event_id", F.round("rate", 9).alias("rate"))


@query("delta_encode", "W14 S22", """WITH e AS (SELECT user_id, event_id, ts, cast(floor(value) AS BIGINT) % 256 AS v FROM events), d AS (SELECT *, ((v - coalesce(lag(v) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0)) % 256 + 256) % 256 AS delta FROM e)
       SELECT event_id, delta, v AS back FROM d""")
def delta_encode(t):
    d = t.events.select("user_id", "event_id", "ts", F.pmod(F.floor("value"), F.lit(256)).alias("v"))
    d = d.withColumn("delta", S.deltas(F.col("v"), KEY, ORDER))
    return d.select("event_id", "delta", S.undelta(F.col("delta"), KEY, ORDER).alias("back"))


@query("downsample", "W15", """WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
       SELECT user_id, cast(floor(i * 8 / n) AS INTEGER) AS part, max(value) AS value FROM e GROUP BY 1, 2""")
def downsample(t):
    return S.shrunk(t.events, KEY, ORDER, "value", 8)


@query("session_presence", "C20", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
       SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def session_presence(t):
    d = t.events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return d.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


@query("fixed_window_limit", "C21", "SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n, count(*) > 2 AS over FROM events GROUP BY 1, 2")
def fixed_window_limit(t):
    d = t.events.groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return d.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", (F.col("n") > 2).alias("over"))


@query("count_throttle", "C24", """WITH e AS (SELECT event_id, event_type, lag(event_type) OVER w AS pt, ts - lag(ts) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT event_id FROM e WHERE pt IS DISTINCT FROM event_type OR gap >= INTERVAL 24 HOUR""")
def count_throttle(t):
    w = W.partitionBy(*KEY).orderBy(*ORDER)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    d = t.events.withColumns({"pt": F.lag("event_type").over(w), "gap": at - F.lag(at).over(w)})
    return d.where(~F.col("pt").eqNullSafe(F.col("event_type")) | (F.col("gap") >= 86_400_000_000)).select("event_id")


@query("sequence_guard", "C22 C2", "SELECT user_id, event_type, max_by(value, event_id) AS value, max(event_id) AS rev FROM events GROUP BY 1, 2")
def sequence_guard(t):
    return t.events.groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("rev"))
