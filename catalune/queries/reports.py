"""Aggregations and reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalune.operators import facets, reports
from catalune.queries import query


@query("value_counts_ci", "A1", """WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE ' ' || p_name END AS v FROM part WHERE p_partkey % 11 <> 0)
       SELECT min_by(trim(v), p_partkey) AS value, count(*) AS n FROM v GROUP BY lower(trim(v))""")
def value_counts_ci(t):
    v = F.when(F.col("p_partkey") % 11 == 0, "  ").when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name"))
    return facets.value_counts(t.part, v, "p_partkey")


@query(
    "collection_stats", "A2 A3 A4 A7",
    """SELECT count(*) AS n, round(sum(CASE WHEN o_totalprice > 0 THEN o_totalprice ELSE 0 END), 2) AS total, count(*) FILTER (WHERE o_totalprice IS NULL OR o_totalprice <= 0) AS unknown,
       count(DISTINCT lower(n_name)) AS nations, count(DISTINCT o_custkey) AS customers, min(o_totalprice) AS lowest, max(o_totalprice) AS highest, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS middle,
       count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus <> 'F') AS open_
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
def collection_stats(t):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows at every scale
    p = "o_totalprice"
    half = reports.middle(d, p, "half").select(F.round("half", 4).alias("middle"))
    whole = d.agg(
        F.count("*").alias("n"), F.round(reports.known_sum(p), 2).alias("total"), reports.unknown(p).alias("unknown"), reports.kinds("n_name").alias("nations"), F.count_distinct("o_custkey").alias("customers"),
        F.min(p).alias("lowest"), F.max(p).alias("highest"), F.round(F.avg(p), 4).alias("mean"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") != "F").alias("open_"),
    )
    return whole.crossJoin(half)  # one row each


@query("histogram_steps", "A5", """WITH b AS (SELECT cast(floor(o_totalprice / 5000) * 5000 AS BIGINT) AS f, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY 1)
       SELECT s.f AS "from", coalesce(n, 0) AS n FROM (SELECT unnest(range((SELECT min(f) FROM b), (SELECT max(f) FROM b) + 1, 5000)) AS f) s LEFT JOIN b USING (f)""")
def histogram_steps(t):
    return reports.histogram(t.orders, F.col("o_totalprice"), 5000)


@query("monthly_added", "A6 P12", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def monthly_added(t):
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("grade_matrix", "A7", """SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS high,
       count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS none FROM orders GROUP BY o_orderstatus""")
def grade_matrix(t):
    g = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderpriority") == "2-HIGH", "high").otherwise("none")
    out = t.orders.withColumn("g", g).groupBy("o_orderstatus").pivot("g", ["urgent", "high", "none"]).count()
    return out.na.fill(0, ["urgent", "high", "none"])


@query(
    "facet_items_album", "A8",
    """WITH s AS (SELECT lower(trim(p_name)) AS key, trim(p_name) AS v, count(*) AS n, sum(p_retailprice) AS s FROM part GROUP BY 1, 2),
       m AS (SELECT key, v, row_number() OVER (PARTITION BY key ORDER BY n DESC, CASE WHEN regexp_matches(v, '^[A-Z]') THEN 0 ELSE 1 END, v) AS i FROM s),
       a AS (SELECT lower(trim(p_name)) AS key, lower(p_brand) AS ak, min(p_brand) AS shown, count(*) AS an FROM part GROUP BY 1, 2),
       r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY an DESC, ak) AS i, count(*) OVER (PARTITION BY key) AS kinds FROM a),
       t AS (SELECT key, cast(sum(n) AS BIGINT) AS tracks, sum(s) AS seconds FROM s GROUP BY key)
       SELECT key, m.v AS value, tracks, round(seconds, 2) AS seconds, CASE WHEN kinds > 1 AND an / tracks < 0.6 THEN 'Various artists' ELSE shown END AS sub
       FROM t JOIN m USING (key) JOIN r USING (key) WHERE m.i = 1 AND r.i = 1""",
)
def facet_items_album(t):
    return facets.facet_items(t.part, F.col("p_name"), "p_retailprice", F.col("p_brand")).withColumn("seconds", F.round("seconds", 2))


@query("facet_items_segment", "A8", "SELECT lower(c_mktsegment) AS key, min(c_mktsegment) AS value, count(*) AS tracks, round(sum(c_acctbal), 2) AS seconds FROM customer GROUP BY 1")
def facet_items_segment(t):
    return facets.facet_items(t.customer, F.col("c_mktsegment"), "c_acctbal").select("key", "value", "tracks", F.round("seconds", 2).alias("seconds"))


@query(
    "list_insights", "A10 J27 W2",
    """WITH e AS (SELECT user_id, ts, event_id, value, (event_id % 12) + 1 AS n, event_id % 5 = 0 AS minor FROM events), l AS (
       SELECT *, lag(n) OVER w AS pn, lag(minor) OVER w AS pm, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       d AS (SELECT *, ((n - pn) % 12 + 12) % 12 AS d FROM l), f AS (SELECT *, CASE WHEN pm = minor THEN CASE WHEN least(d, 12 - d) = 0 THEN 1 WHEN least(d, 12 - d) = 1 THEN 0.9 WHEN d = 2 THEN 0.5 ELSE 0 END WHEN least(d, 12 - d) = 0 THEN 0.85 ELSE 0 END AS fit FROM d)
       SELECT user_id, count(*) AS n, round(sum(CASE WHEN value > 0 THEN value ELSE 0 END), 4) AS total, min(CASE WHEN value > 0 THEN value END) AS slowest, max(CASE WHEN value > 0 THEN value END) AS fastest,
       count(*) FILTER (WHERE i > 1 AND fit >= 0.85) AS good, count(*) FILTER (WHERE i > 1 AND fit >= 0.5 AND fit < 0.85) AS ok, count(*) FILTER (WHERE i > 1 AND fit < 0.5) AS clash, count(*) FILTER (WHERE i > 1 AND fit IS NULL) AS unknown FROM f GROUP BY user_id""",
)
def list_insights(t):
    e = t.events.select("user_id", "ts", "event_id", "value", (F.col("event_id") % 12 + 1).alias("n"), (F.col("event_id") % 5 == 0).alias("minor"))
    return reports.insights(e, "user_id", ["ts", "event_id"], "n", "minor", "value", "value").withColumn("total", F.round("total", 4)).withColumn("n", F.col("n"))


@query("tag_counts", "A11", "SELECT value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS value FROM part) GROUP BY value")
def tag_counts(t):
    tags = t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("tag"))
    return facets.value_counts(tags, F.col("tag"), "p_partkey")


@query(
    "venn3", "A12",
    """WITH m AS (SELECT user_id, cast(ts AS DATE) AS day, max((event_type = 'click')::INT) + 2 * max((event_type = 'purchase')::INT) + 4 * max((event_type = 'view')::INT) AS region FROM events GROUP BY 1, 2)
       SELECT cast(r AS INTEGER) AS region, count(region) AS n FROM range(0, 8) t(r) LEFT JOIN m ON region = r GROUP BY r""",
)
def venn3(t):
    kind = lambda k: F.col("event_type") == k
    return reports.venn(t.events.withColumn("day", F.to_date("ts")), ["user_id", "day"], [kind("click"), kind("purchase"), kind("view")])


@query("removal_impact", "A13 U5", """WITH c AS (SELECT p_partkey FROM part WHERE p_brand = 'Brand#12')
       SELECT (SELECT count(*) FROM part WHERE p_partkey IN (FROM c)) AS rows, count(DISTINCT l_orderkey) AS lists, count(*) AS entries FROM lineitem WHERE l_partkey IN (FROM c)""")
def removal_impact(t):
    chosen = t.part.where("p_brand = 'Brand#12'").select("p_partkey")
    return reports.removal_impact(t.part, t.lineitem.select("l_orderkey", F.col("l_partkey").alias("p_partkey")), chosen, "p_partkey", "l_orderkey")


@query("shared_counts", "A14", "SELECT count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'F') AS local FROM lineitem")
def shared_counts(t):
    return t.lineitem.agg(F.count("*").alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("local"))


@query("rule_values", "A15", """SELECT value, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ') || [p_type]) AS value FROM part) WHERE value NOT IN ('PROMO') GROUP BY value""")
def rule_values(t):
    vals = F.concat(F.split("p_name", " "), F.array(F.concat("p_type", F.when(F.col("p_partkey") % 2 == 0, " (2)").otherwise(""))))
    return reports.distinct_per_row(t.part, "p_partkey", vals, ["PROMO"])


@query("seed_profile", "A16", """SELECT p_type, array_to_string(list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))), ',') AS words, round(avg(p_size), 6) AS size, round(avg(p_retailprice), 4) AS price FROM part GROUP BY p_type""")
def seed_profile(t):
    d = t.part
    words = d.select("p_type", F.explode(F.split("p_name", " ")).alias("w")).groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("w")), ",").alias("words"))
    return d.groupBy("p_type").agg(F.round(F.avg("p_size"), 6).alias("size"), F.round(F.avg("p_retailprice"), 4).alias("price")).join(words, "p_type").select("p_type", "words", "size", "price")


@query(
    "group_certainty", "A17 A18",
    """WITH g AS (SELECT p_name, count(DISTINCT p_brand) AS names, max(p_retailprice) - min(p_retailprice) AS spread, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_name HAVING count(*) > 1),
       s AS (SELECT *, 60 + 40 * greatest(0.0, least(1.0, (first % 100) / 100.0 / 0.55 - 0.4 / 0.55)) - CASE WHEN names > 1 THEN 10 ELSE 0 END - CASE WHEN spread > 2 THEN 10 ELSE 0 END AS c FROM g)
       SELECT p_name, names, CASE WHEN first % 7 = 0 THEN 100 WHEN first % 5 = 0 THEN CASE WHEN spread <= 1 THEN 60 ELSE 50 END ELSE cast(greatest(0, least(100, floor(c + 0.5))) AS BIGINT) END AS sure,
       concat_ws('; ', CASE WHEN spread > 3 THEN 'lengths differ' END, CASE WHEN names > 1 THEN 'other artists' END) AS concerns FROM s""",
)
def group_certainty(t):
    g = t.part.groupBy("p_name").agg(F.count_distinct("p_brand").alias("names"), (F.max("p_retailprice") - F.min("p_retailprice")).alias("spread"), F.count("*").alias("n"), F.min("p_partkey").alias("first")).where("n > 1")
    sure = reports.certainty((F.col("first") % 100) / 100, F.col("first") % 7 == 0, F.col("names"), F.col("spread"), F.col("first") % 5 == 0)
    concerns = F.concat_ws("; ", F.when(F.col("spread") > 3, "lengths differ"), F.when(F.col("names") > 1, "other artists"))
    return g.select("p_name", "names", sure.alias("sure"), concerns.alias("concerns"))


@query(
    "best_copy", "A19 M3",
    """WITH s AS (SELECT p_partkey, p_name, CASE p_type WHEN 'PROMO' THEN 3 WHEN 'LARGE' THEN 2 WHEN 'SMALL' THEN 0 ELSE 1 END * 1e7 + CASE WHEN p_size > 25 THEN 1e6 + 44.1 * 16 ELSE p_retailprice END + CASE WHEN p_brand = 'Brand#12' THEN 5e5 ELSE 0 END AS score FROM part),
       r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY score DESC, p_partkey) AS i, count(*) OVER (PARTITION BY p_name) AS n FROM s)
       SELECT p_name, p_partkey AS best, n - 1 AS others FROM r WHERE i = 1 AND n > 1""",
)
def best_copy(t):
    grade = F.when(F.col("p_type") == "PROMO", "ok").when(F.col("p_type") == "LARGE", "info").when(F.col("p_type") == "SMALL", "bad").otherwise("warn")
    score = reports.copy_score(grade, F.col("p_size") > 25, F.lit(44100), F.lit(0), F.col("p_retailprice"), F.col("p_brand") == "Brand#12")
    best = t.part.withColumn("score", score).groupBy("p_name").agg(F.max_by("p_partkey", F.struct("score", -F.col("p_partkey"))).alias("best"), (F.count("*") - 1).alias("others"))
    return best.where("others > 0")


@query("signups_by_day", "A20 A24", "SELECT event_type, cast(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def signups_by_day(t):
    return t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("group_concat", "A21", "SELECT n_regionkey, count(DISTINCT n_name) AS n, string_agg(n_name, ', ' ORDER BY n_name) AS names, max(n_nationkey) AS last FROM nation GROUP BY n_regionkey")
def group_concat(t):
    return t.nation.groupBy("n_regionkey").agg(F.count_distinct("n_name").alias("n"), F.expr("listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name)").alias("names"), F.max("n_nationkey").alias("last"))


@query("json_state", "A22", """SELECT user_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS state FROM (SELECT user_id, event_type, cast(count(*) AS VARCHAR) AS n FROM events WHERE event_type <> 'view' GROUP BY 1, 2) GROUP BY user_id""")
def json_state(t):
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    state = n.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return state.select("user_id", F.to_json(F.map_filter("m", lambda k, _: k != "view")).alias("state")).where("state <> '{}'")


@query(
    "signal_stats", "A23",
    """SELECT user_id, max(abs(value)) AS peak, round(sqrt(avg(value * value)), 6) AS rms, cast(bit_or(cast(floor(value) AS BIGINT)) AS BIGINT) AS bits, round(corr(value, epoch_us(ts) / 1e6), 6) AS corr FROM events GROUP BY user_id""",
)
def signal_stats(t):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t.events.groupBy("user_id").agg(F.max(F.abs("value")).alias("peak"), F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"), F.bit_or(F.floor("value")).alias("bits"), F.round(F.corr("value", at), 6).alias("corr"))


@query(
    "throughput_history", "A24 M22",
    """WITH b AS (SELECT event_type, cast(floor(epoch_us(ts) / 1e6 / 3600) AS BIGINT) AS hour, count(*) AS n, sum(value) AS mb FROM events GROUP BY 1, 2)
       SELECT event_type, hour, n, round(mb, 4) AS mb, CASE WHEN n >= 5 AND mb / n > 60 THEN 'more at once' WHEN n < 2 THEN 'idle' ELSE 'fine' END AS advice FROM b""",
)
def throughput_history(t):
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600)
    b = t.events.groupBy("event_type", hour.alias("hour")).agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    advice = F.when((F.col("n") >= 5) & (F.col("s") / F.col("n") > 60), "more at once").when(F.col("n") < 2, "idle").otherwise("fine")
    return b.select("event_type", "hour", "n", F.round("s", 4).alias("mb"), advice.alias("advice"))


@query("perf_counters", "A25 M27", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS max, max_by(value, event_id) AS last FROM events GROUP BY event_type")
def perf_counters(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("max"), F.max_by("value", "event_id").alias("last"))


@query("entry_resolution", "A26 S15", """SELECT l_returnflag, count(*) AS entries, count(p_partkey) FILTER (WHERE p_size > 20) AS matched, count(*) FILTER (WHERE p_size <= 20) AS other, count(*) FILTER (WHERE p_partkey IS NULL) AS gone
       FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 0) ON l_partkey = p_partkey GROUP BY l_returnflag""")
def entry_resolution(t):
    d = t.lineitem.join(t.part.where("p_partkey % 10 <> 0"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return d.groupBy("l_returnflag").agg(F.count("*").alias("entries"), F.count_if(F.col("p_size") > 20).alias("matched"), F.count_if(F.col("p_size") <= 20).alias("other"), F.count_if(F.col("p_partkey").isNull()).alias("gone"))


@query("top10_counts", "T4 A1", "SELECT o_custkey AS value, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, value LIMIT 10")
def top10_counts(t):
    return reports.top(t.orders.groupBy(F.col("o_custkey").alias("value")).agg(F.count("*").alias("n")), 10)


@query(
    "users_overview", "J25 A20 A21 J26",
    """SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS devices, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS seen,
       coalesce((SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_custkey = c_custkey), 0) AS bytes FROM customer ORDER BY bytes DESC, c_custkey LIMIT 100""",
)
def users_overview(t):
    t.customer.createOrReplaceTempView("own_customer")
    t.orders.createOrReplaceTempView("own_orders")
    return t.spark.sql("""SELECT c_custkey, (SELECT count(*) FROM own_orders WHERE o_custkey = c_custkey) AS devices, (SELECT max(o_orderdate) FROM own_orders WHERE o_custkey = c_custkey) AS seen,
       coalesce((SELECT round(sum(o_totalprice), 2) FROM own_orders WHERE o_custkey = c_custkey), 0) AS bytes FROM own_customer ORDER BY bytes DESC, c_custkey LIMIT 100""")


@query("cube_overlap", "A12 F5", "SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_overlap(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n")


@query("usage_limits", "M16 M20", """WITH u AS (SELECT c_mktsegment AS tier, sum(o_totalprice) AS used FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), l AS (SELECT tier, CASE tier WHEN 'BUILDING' THEN 4e8 ELSE 6e8 END AS cap, used FROM u)
       SELECT tier, round(used, 2) AS used, round(100 * used / cap, 4) AS percent, used + 1e6 > cap AS over FROM l""")
def usage_limits(t):
    u = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("tier")).agg(F.sum("o_totalprice").alias("u"))
    cap = F.when(F.col("tier") == "BUILDING", 4e8).otherwise(6e8)
    return u.select("tier", F.round("u", 2).alias("used"), F.round(100 * F.col("u") / cap, 4).alias("percent"), (F.col("u") + 1e6 > cap).alias("over"))
