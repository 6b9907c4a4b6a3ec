"""Merge, change data, reconciliation and edits: sides are deterministic edits of customer, supplier and part."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalune.operators import changes as C
from catalune.operators import edits as E
from catalune.queries import query

_SIDES = """b AS (SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS seg FROM customer WHERE c_custkey % 10 <> 9),
       l AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS bal, CASE WHEN c_custkey % 5 = 0 THEN 'LOCAL' ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 11 <> 0),
       r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 = 0 THEN c_acctbal + 2 WHEN c_custkey % 7 = 0 THEN c_acctbal + 3 ELSE c_acctbal END AS bal, CASE WHEN c_custkey % 10 = 0 THEN 'REMOTE' ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 13 <> 0)"""


def _sides(t):
    c, K, bal, seg = t.customer, F.col("c_custkey"), F.col("c_acctbal"), F.col("c_mktsegment")  # noqa: N806
    one = lambda d, b, s: d.select(K.alias("k"), b.alias("bal"), s.alias("seg"))
    b = one(c.where(K % 10 != 9), bal, seg)
    l = one(c.where(K % 11 != 0), F.when(K % 3 == 0, bal + 1).otherwise(bal), F.when(K % 5 == 0, "LOCAL").otherwise(seg))  # noqa: E741
    r = one(c.where(K % 13 != 0), F.when(K % 6 == 0, bal + 2).when(K % 7 == 0, bal + 3).otherwise(bal), F.when(K % 10 == 0, "REMOTE").otherwise(seg))
    return b, l, r


@query("reconcile_full_outer", "J23", f"WITH {_SIDES} SELECT k, CASE WHEN b.k IS NULL THEN 'new' WHEN l.k IS NULL THEN 'missing' WHEN b.bal = l.bal AND b.seg = l.seg THEN 'same' ELSE 'changed' END AS state FROM b FULL JOIN l USING (k)")
def reconcile_full_outer(t):
    b, l, _ = _sides(t)  # noqa: E741
    return C.reconcile(b, l, ["k"], ["bal", "seg"])


@query("cdc_diff", "C1", f"WITH {_SIDES} SELECT k, CASE WHEN b.k IS NULL THEN 'insert' WHEN r.k IS NULL THEN 'delete' ELSE 'update' END AS op, r.bal, r.seg FROM b FULL JOIN r USING (k) WHERE b.k IS NULL OR r.k IS NULL OR b.bal <> r.bal OR b.seg <> r.seg")
def cdc_diff(t):
    b, _, r = _sides(t)
    return C.diff(b, r, ["k"], ["bal", "seg"])


@query("cdc_apply", "C2", f"WITH {_SIDES} SELECT k, bal, seg FROM r")
def cdc_apply(t):
    b, l, r = _sides(t)  # noqa: E741
    # two steps in one log: to local, then from there to remote
    log = C.diff(b, l, ["k"], ["bal", "seg"]).withColumn("rev", F.lit(1)).unionByName(C.diff(l, r, ["k"], ["bal", "seg"]).withColumn("rev", F.lit(2)))
    return C.fold_log(b, log, ["k"], ["bal", "seg"], "rev")


@query(
    "merge3_fields", "C9 C11",
    f"""WITH {_SIDES}, j AS (SELECT k, b.bal AS bb, b.seg AS bs, b.k IS NOT NULL AS hb, l.bal AS lb, l.seg AS ls, hl, r.bal AS rb, r.seg AS rs, hr FROM b FULL JOIN (SELECT *, true AS hl FROM l) l USING (k) FULL JOIN (SELECT *, true AS hr FROM r) r USING (k)),
       h AS (SELECT * REPLACE (coalesce(hl, false) AS hl, coalesce(hr, false) AS hr, coalesce(bb IS NOT NULL, false) AS hb) FROM j)
       SELECT k, CASE WHEN hl AND hr THEN true WHEN NOT hl AND NOT hr THEN false WHEN NOT hb THEN true WHEN hl THEN false ELSE rb <> bb OR rs <> bs END AS there,
       CASE WHEN hl AND hr THEN CASE WHEN rb IS DISTINCT FROM bb OR NOT hb THEN rb ELSE lb END WHEN hl THEN lb ELSE rb END AS bal, CASE WHEN hl AND hr THEN CASE WHEN rs IS DISTINCT FROM bs OR NOT hb THEN rs ELSE ls END WHEN hl THEN ls ELSE rs END AS seg,
       concat_ws(',', CASE WHEN hb AND hl <> hr AND CASE WHEN hl THEN lb <> bb OR ls <> bs ELSE rb <> bb OR rs <> bs END THEN '*' END, CASE WHEN hl AND hr AND (lb IS DISTINCT FROM bb) AND (rb IS DISTINCT FROM bb) AND lb <> rb THEN 'bal' END,
       CASE WHEN hl AND hr AND (ls IS DISTINCT FROM bs) AND (rs IS DISTINCT FROM bs) AND ls <> rs THEN 'seg' END) AS clashes FROM h""",
)
def merge3_fields(t):
    b, l, r = _sides(t)  # noqa: E741
    return C.merge3(b, l, r, ["k"], ["bal", "seg"]).withColumn("clashes", F.array_join("clashes", ","))


@query("clash_resolution", "C11", f"WITH {_SIDES} SELECT k, CASE WHEN k % 2 = 0 THEN l.seg ELSE r.seg END AS seg FROM b JOIN l USING (k) JOIN r USING (k) WHERE l.seg <> b.seg AND r.seg <> b.seg AND l.seg <> r.seg")
def clash_resolution(t):
    b, l, r = _sides(t)  # noqa: E741
    m = C.merge3(b, l, r, ["k"], ["bal", "seg"]).where(F.array_contains("clashes", "seg"))
    chosen = l.where("k % 2 = 0").select("k", F.col("seg").alias("mine"))
    return m.join(b.select("k"), "k", "left_semi").join(chosen, "k", "left").select("k", F.coalesce("mine", "seg").alias("seg"))


@query("set_merge", "U2 C10", """WITH s AS (SELECT p_partkey, string_split(p_name, ' ') AS b, string_split(p_name, ' ') || ['mine'] AS l, [split_part(p_name, ' ', 1), 'theirs'] AS r FROM part)
       SELECT p_partkey, array_to_string(CASE WHEN split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) THEN [split_part(p_name, ' ', 1), 'mine', 'theirs'] ELSE [split_part(p_name, ' ', 1), 'mine', 'theirs'] END, ',') AS merged FROM s JOIN part USING (p_partkey)""")
def set_merge(t):
    b = F.split("p_name", " ")
    return t.part.select("p_partkey", F.array_join(C.merge_sets(b, F.concat(b, F.array(F.lit("mine"))), F.array(F.get(b, F.lit(0)), F.lit("theirs"))), ",").alias("merged"))


@query("slot_merge", "C12 C13", """WITH s AS (SELECT s_suppkey, s_acctbal AS b, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + 1 ELSE s_acctbal + 0.0001 END AS o, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 2 ELSE s_acctbal END AS a FROM supplier)
       SELECT s_suppkey, round(CASE WHEN s_suppkey % 2 <> 0 AND s_suppkey % 3 = 0 THEN a ELSE o END, 4) AS value, s_suppkey % 6 = 0 AS clash, CASE WHEN o = b THEN a ELSE o END AS info FROM s""")
def slot_merge(t):
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    o, a = F.when(k % 2 == 0, b + 1).otherwise(b + 0.0001), F.when(k % 3 == 0, b + 2).otherwise(b)
    value, clash = C.slot_merge(o, a, b)
    return t.supplier.select("s_suppkey", F.round(value, 4).alias("value"), clash.alias("clash"), C.own_change(a, o, b).alias("info"))


@query("compaction_due", "C6", "SELECT user_id, count(*) AS entries, cast(sum(length(props)) AS BIGINT) AS bytes, count(*) >= 70 OR (sum(length(props)) >= 500 AND count(*) >= 60) AS due FROM events GROUP BY user_id")
def compaction_due(t):
    e = t.events.select("user_id", F.length("props").alias("size"))
    return C.compaction_due(e, "user_id", "size", 70, 500, 60)


@query("touched_paths", "C7", "SELECT DISTINCT event_type || '/' || user_id % 16 AS path FROM events WHERE event_id > 1000 AND event_id <= 1200")
def touched_paths(t):
    return t.events.where("event_id > 1000 and event_id <= 1200").select(F.concat("event_type", F.lit("/"), (F.col("user_id") % 16).cast("string")).alias("path")).distinct()


@query("retention", "C8", "SELECT event_id, ts < TIMESTAMP '2024-01-15' - INTERVAL 7 DAY AS purge FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-15'")
def retention(t):
    now = F.lit("2024-01-15").cast("timestamp_ntz")
    return t.events.where((F.col("event_type") == "error") & (F.col("ts") < now)).select("event_id", (F.col("ts") < now - F.make_interval(days=F.lit(7))).alias("purge"))


@query("append_guard", "C5", """WITH RECURSIVE e AS (SELECT user_id, event_id, event_id % 3 + row_number() OVER w // 3 AS base, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
       f AS (SELECT user_id, event_id, i, base = 0 AS accepted, (base = 0)::BIGINT AS revision FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, base = revision, revision + (base = revision)::BIGINT FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
       SELECT user_id, event_id, accepted, revision FROM f""")
def append_guard(t):
    from catalune.operators.folds import appended

    seen = F.floor(F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) / 3)  # the revision that a writer last read, roughly
    return appended(t.events.select("user_id", "event_id", (F.col("event_id") % 3 + seen).alias("base")), "user_id", "event_id", "base")


@query("push_batches", "C4", """WITH RECURSIVE e AS (SELECT user_id, event_id, floor(value * 10)::BIGINT AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
       f AS (SELECT user_id, event_id, i, 0::BIGINT AS batch, size AS filled FROM e WHERE i = 1
         UNION ALL SELECT e.user_id, e.event_id, e.i, batch + (filled + e.size > 1500)::BIGINT, CASE WHEN filled + e.size > 1500 THEN e.size ELSE filled + e.size END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
       SELECT user_id, event_id, batch FROM f""")
def push_batches(t):
    from catalune.operators.folds import batches

    return batches(t.events.select("user_id", "event_id", F.floor(F.col("value") * 10).cast("long").alias("size")), "user_id", "event_id", "size", 1500)


@query("pull_changes", "C3", """WITH c AS (SELECT unnest([500, 4000]) AS cursor), s AS (SELECT user_id, max_by(value, event_id) AS value FROM events WHERE event_id <= 2000 GROUP BY user_id),
       l AS (SELECT user_id, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events WHERE event_id > 2000 GROUP BY user_id)
       SELECT 4000 AS cursor, user_id, event_id, value FROM l WHERE event_id > 4000 UNION ALL SELECT 500, user_id, coalesce(l.event_id, 2000), coalesce(l.value, s.value) FROM l FULL JOIN s USING (user_id)""")
def pull_changes(t):
    from catalune.operators.folds import pulled

    log = t.events.where("event_id > 2000")
    snapshot = t.events.where("event_id <= 2000").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"))
    one = lambda cursor: pulled(snapshot, 2000, log, cursor, "user_id", "event_id", ["value"]).select(F.lit(cursor).alias("cursor"), "user_id", "event_id", "value")
    return one(4000).unionByName(one(500))


@query("upsert", "U7 C3", f"WITH {_SIDES} SELECT k, coalesce(CASE WHEN r.k % 4 <> 0 THEN r.bal END, b.bal) AS bal, coalesce(r.seg, b.seg) AS seg FROM b FULL JOIN r USING (k)")
def upsert(t):
    b, _, r = _sides(t)
    return C.upsert(b, r.withColumn("bal", F.when(F.col("k") % 4 != 0, F.col("bal"))), ["k"], ["bal", "seg"])


@query("partial_read_guard", "C23", "SELECT (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0) AS n, (SELECT count(*) FROM supplier) AS was, NOT ((SELECT count(*) FROM supplier) >= 4 AND (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0) * 2 < (SELECT count(*) FROM supplier)) AS ok")
def partial_read_guard(t):
    return C.complete_read(t.supplier.where("s_suppkey % 3 = 0"), t.supplier)


@query("shared_projection", "C14 J21 M11 M21", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS local, CASE WHEN c_custkey % 2 = 0 THEN 'a,me,z' ELSE 'a,me' END AS owners, CASE WHEN c_custkey % 2 = 0 THEN 'a,z' ELSE 'a,z' END AS folded FROM customer")
def shared_projection(t):
    even = F.col("c_custkey") % 2 == 0
    copies = F.map_filter(F.map_from_arrays(F.array(F.lit("a"), F.lit("me")), F.array("c_mktsegment", F.when(even, F.col("c_name")))), lambda _, v: v.isNotNull())
    z = F.when(even, C.with_copy(copies, "z", F.lit("x"))).otherwise(C.with_copy(C.with_copy(copies, "z", F.lit("x")), "z", F.lit(None).cast("string")))
    own = F.when(even, z).otherwise(C.with_copy(copies, "me", F.lit("y")))
    keys = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    return t.customer.select("c_custkey", C.local_view(copies, "me").alias("local"), keys(own).alias("owners"), keys(C.renamed_computer(own, "me", "z")).alias("folded"))


@query("adopt_collections", "J20 U1 J22", """WITH o AS (SELECT p_partkey AS id, lower(p_name) AS name, p_brand, p_size FROM part WHERE p_partkey % 2 = 0), s AS (SELECT p_partkey AS id, lower(p_name) AS name, p_brand, p_size FROM part WHERE p_partkey % 2 = 1),
       m AS (SELECT o.id, min(s.id) AS into_id FROM o JOIN s ON o.name = s.name AND o.p_brand = s.p_brand AND abs(o.p_size - s.p_size) <= 3 GROUP BY o.id) SELECT o.id, coalesce(into_id, o.id) AS shared_id, into_id IS NULL AS added FROM o LEFT JOIN m USING (id)""")
def adopt_collections(t):
    from catalune.operators.matching import band_join

    side = lambda k, n: t.part.where(F.col("p_partkey") % 2 == k).select(F.col("p_partkey").alias(n), F.lower("p_name").alias("name"), "p_brand", F.col("p_size").alias(f"size_{n}"))
    o, s = side(0, "id"), side(1, "into_id")
    m = band_join(o, s, "size_id", "size_into_id", 3, ["name", "p_brand"]).groupBy("id").agg(F.min("into_id").alias("into_id"))
    return o.join(m, "id", "left").select("id", F.coalesce("into_id", "id").alias("shared_id"), F.col("into_id").isNull().alias("added"))


@query("absorb_records", "J22 M10", "SELECT l_orderkey, count(DISTINCT CASE WHEN l_partkey % 10 = 1 THEN l_partkey - 1 ELSE l_partkey END) AS parts FROM lineitem GROUP BY l_orderkey")
def absorb_records(t):
    into = t.part.where("p_partkey % 10 = 1").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") - 1).alias("to"))
    d = t.lineitem.select("l_orderkey", "l_partkey").join(into, "l_partkey", "left")
    return d.groupBy("l_orderkey").agg(F.count_distinct(F.coalesce("to", "l_partkey")).alias("parts"))


@query("tidy_sources", "J24 F10", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def tidy_sources(t):
    kept = t.orders.join(t.customer.where("c_acctbal > 9000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return kept.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("exclusive_flag", "M5", "SELECT s_suppkey, s_suppkey = 7 AS main FROM supplier")
def exclusive_flag(t):
    return E.exclusive(t.supplier.select("s_suppkey"), "s_suppkey", F.lit(7), "main")


@query("rate_and_edit", "2.13", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 3.5::DOUBLE END AS rating, CASE WHEN p_size > 40 THEN 'Edited' ELSE p_name END AS p_name, CASE WHEN p_size > 40 THEN 'p_name' ELSE '' END AS edited FROM part")
def rate_and_edit(t):
    d = t.part.select("p_partkey", "p_size", "p_name", F.lit(None).cast("double").alias("rating"), F.array().cast("array<string>").alias("edited"))
    d = E.set_info(E.rate(d, F.col("p_size") > 40, 3.4), F.col("p_size") > 40, {"p_name": "Edited"})
    return d.select("p_partkey", "rating", "p_name", F.array_join("edited", ",").alias("edited"))


@query("tag_renames", "2.13", "SELECT p_partkey, CASE WHEN list_contains(string_split(p_name, ' '), 'blue') THEN array_to_string(list_transform(string_split(p_name, ' '), lambda x: CASE WHEN x = 'blue' THEN 'azure' ELSE x END), '|') ELSE replace(p_name, ' ', '|') END AS tags FROM part")
def tag_renames(t):
    d = E.rename_tag(t.part.select("p_partkey", F.split("p_name", " ").alias("tags")), "Blue", "azure")
    return d.select("p_partkey", F.array_join("tags", "|").alias("tags"))


@query("list_moves", "2.13", "SELECT n_regionkey, array_to_string(list_concat(list_filter(l, lambda x: x <> l[3])[1:1], [l[3]], list_filter(l, lambda x: x <> l[3])[2:]), ',') AS items FROM (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS l FROM nation GROUP BY 1)")
def list_moves(t):
    l = t.nation.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("l"))  # noqa: E741
    return l.select("n_regionkey", F.array_join(E.insert_at(F.col("l"), F.slice("l", 3, 1), F.lit(1)), ",").alias("items"))


@query("profile_union", "M17", "SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 5 <> 0 UNION SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 <> 0")
def profile_union(t):
    gone = t.customer.where("c_custkey % 5 = 0").select("c_custkey")
    have, new = t.customer.where("c_custkey % 2 = 0").select("c_custkey"), t.customer.where("c_custkey % 3 = 0").select("c_custkey")
    return have.unionByName(new).distinct().join(gone, "c_custkey", "left_anti")


@query("refused_pairs", "M29 U4", "SELECT p_partkey, p_size FROM part WHERE p_size >= 45 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def refused_pairs(t):
    return t.part.where("p_size >= 45").join(t.lineitem.where("l_discount > 0.09"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_size")


@query("use_once", "M31", "SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def use_once(t):
    return t.events.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("cascading_delete", "M32", "SELECT count(*) AS left_over FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))")
def cascading_delete(t):
    gone = t.orders.join(t.customer.where("c_nationkey = 3"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return t.lineitem.join(gone, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("left_over"))


@query("credential_lookup", "M30", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND c_acctbal > 9500")
def credential_lookup(t):
    return t.orders.where("o_orderstatus = 'O'").join(t.customer.where("c_acctbal > 9500"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("vocabulary_merge", "M1", """WITH u AS (SELECT p_type AS v, 0 AS pri, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT unnest(['promo', 'Extra', 'small', 'House']), 1, 0), r AS (SELECT v, n, pri, row_number() OVER (PARTITION BY lower(v) ORDER BY pri, v) AS i FROM u) SELECT v AS value, n, pri = 0 AS own FROM r WHERE i = 1""")
def vocabulary_merge(t):
    own = t.part.groupBy(F.col("p_type").alias("v")).agg(F.count("*").alias("n")).withColumn("pri", F.lit(0))
    preset = t.spark.createDataFrame([(x,) for x in ("promo", "Extra", "small", "House")], "v string").select("v", F.lit(0).cast("long").alias("n"), F.lit(1).alias("pri"))
    d = own.unionByName(preset).groupBy(F.lower("v").alias("k")).agg(F.min_by(F.struct("v", "n", "pri"), F.struct("pri", "v")).alias("x"))
    return d.select(F.col("x.v").alias("value"), "x.n", (F.col("x.pri") == 0).alias("own"))


@query("djlist_entries", "M8", "SELECT l_orderkey, l_partkey, min(l_linenumber) AS first FROM lineitem WHERE l_partkey % 100 = 5 GROUP BY 1, 2")
def djlist_entries(t):
    songs = t.part.where("p_partkey % 100 = 5").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.join(songs, "l_partkey", "left_semi").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("first"))


@query("write_back_queue", "M12", "SELECT p_partkey, CASE WHEN p_size > 45 THEN 'p_size' ELSE 'p_size,p_name' END AS fields FROM part WHERE p_size > 45 OR p_partkey % 40 = 0")
def write_back_queue(t):
    pending = F.array_compact(F.array(F.when((F.col("p_size") > 45) | (F.col("p_partkey") % 40 == 0), "p_size"), F.when((F.col("p_partkey") % 40 == 0) & (F.col("p_size") <= 45), "p_name")))
    return t.part.select("p_partkey", pending.alias("f")).where(F.size("f") > 0).select("p_partkey", F.array_join("f", ",").alias("fields"))


@query("result_verification", "M13", "SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE abs(l_quantity * 1.0000000001 - l_quantity) <= 1e-9 * abs(l_quantity)) AS agree FROM lineitem GROUP BY 1")
def result_verification(t):
    again = F.col("l_quantity") * 1.0000000001
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.abs(again - F.col("l_quantity")) <= 1e-9 * F.abs("l_quantity")).alias("agree"))


@query("cue_precedence", "M6 M7", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '1,2,5' WHEN c_custkey % 2 = 0 THEN '3,9' ELSE '4' END AS cues FROM customer")
def cue_precedence(t):
    from catalune.operators.making import add_cue, cues_for

    k = F.col("c_custkey")
    own = F.when(k % 3 == 0, add_cue(F.array(F.lit(5), F.lit(1)), F.lit(2)))
    return t.customer.select("c_custkey", F.array_join(cues_for(own, F.when(k % 2 == 0, F.array(F.lit(3), F.lit(9))), F.array(F.lit(4))), ",").alias("cues"))
