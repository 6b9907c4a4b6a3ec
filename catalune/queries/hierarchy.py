"""Trees and chains: region, nation, customer and orders as folders; conversations as next-pointer chains."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalune.operators import graphs as G
from catalune.queries import query

_NODES = """nodes AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
       UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer UNION ALL SELECT 'x1', 'x2', 'loop' UNION ALL SELECT 'x2', 'x1', 'loop')"""
_WALK = f"""WITH RECURSIVE {_NODES}, s AS (SELECT *, lpad(cast(row_number() OVER (PARTITION BY parent ORDER BY name, id) AS VARCHAR), 9, '0') AS n FROM nodes),
       w AS (SELECT id, 0 AS depth, n AS path, name FROM s WHERE parent IS NULL UNION ALL SELECT s.id, depth + 1, path || '/' || s.n, s.name FROM w JOIN s ON s.parent = w.id)"""
_CLOSURE = f"""WITH RECURSIVE {_NODES}, c AS (SELECT id AS ancestor, id, 0 AS depth FROM nodes UNION ALL SELECT nodes.parent, c.id, depth + 1 FROM c JOIN nodes ON nodes.id = c.ancestor WHERE nodes.parent IS NOT NULL AND nodes.parent <> c.id AND depth < 8)"""


def _trees(name, ops, sql):
    """Registers f(t, nodes) over all regions, nations and customers, and a loop of two."""

    def put(f):
        query(name, ops, sql)(lambda t: f(t, _nodes(t, t.customer)))
        return f

    return put


def _nodes(t, customer):
    one = lambda d, p, k, up, pk, name: d.select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), (F.concat(F.lit(up), F.col(pk).cast("string")) if up else F.lit(None).cast("string")).alias("parent"), F.col(name).alias("name"))
    loop = t.spark.createDataFrame([("x1", "x2", "loop"), ("x2", "x1", "loop")], "id string, parent string, name string")
    return one(t.region, "r", "r_regionkey", None, None, "r_name").unionByName(one(t.nation, "n", "n_nationkey", "r", "n_regionkey", "n_name")).unionByName(one(customer, "c", "c_custkey", "n", "c_nationkey", "c_name")).unionByName(loop)


@_trees("tree_walk", "H1", f"{_WALK} SELECT id, depth, path FROM w")
def tree_walk(t, nodes):
    return G.tree_walk(nodes, "id", "parent", F.col("name"))


@_trees("ancestor_paths", "H2 P26", f"""WITH RECURSIVE {_NODES}, w AS (SELECT id, name AS path FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, path || ' / ' || n.name FROM w JOIN nodes n ON n.parent = w.id) SELECT id, path FROM w""")
def ancestor_paths(t, nodes):
    reach = G.tree_walk(nodes, "id", "parent", F.col("name")).select("id")
    c = G.closure(nodes, "id", "parent").join(reach, "id", "left_semi").join(nodes.select(F.col("id").alias("ancestor"), "name"), "ancestor")
    return c.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "name"))), lambda x: x["name"]), " / ").alias("path"))


@_trees("descendants", "H3 H7", f"{_CLOSURE} SELECT id FROM c WHERE ancestor = 'r2'")
def descendants(t, nodes):
    return G.closure(nodes, "id", "parent").where("ancestor = 'r2'").select("id")


@_trees("descendant_counts", "H3 M26", f"{_CLOSURE} SELECT ancestor, count(DISTINCT id) AS n FROM c GROUP BY ancestor")
def descendant_counts(t, nodes):
    return G.closure(nodes, "id", "parent").groupBy("ancestor").agg(F.count_distinct("id").alias("n"))


@query("linked_order", "H4 S11", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 5 = 4 THEN 1 ELSE 0 END * 0, turn) - 1 AS pos FROM conversations")
def linked_order(t):
    c = t.conversations.select("conv_id", "turn", F.lead("turn").over(W.partitionBy("conv_id").orderBy("turn")).alias("next"))
    return G.linked_order(c, "conv_id", "turn", "next")


@_trees("cycle_refusal", "H5", f"{_CLOSURE}, m AS (SELECT 'r0' AS id, 'n0' AS into_id UNION ALL SELECT 'n3', 'r0' UNION ALL SELECT 'n0', 'n0' UNION ALL SELECT 'r1', 'r0') SELECT m.id, m.into_id, EXISTS (SELECT 1 FROM c WHERE c.ancestor = m.id AND c.id = m.into_id) AS refused FROM m")
def cycle_refusal(t, nodes):
    m = t.spark.createDataFrame([("r0", "n0"), ("n3", "r0"), ("n0", "n0"), ("r1", "r0")], "id string, into_id string")
    under = G.closure(nodes, "id", "parent").select(F.col("ancestor").alias("id"), F.col("id").alias("into_id"), F.lit(True).alias("under"))
    return m.join(under, ["id", "into_id"], "left").select("id", "into_id", F.coalesce("under", F.lit(False)).alias("refused"))


@query("sibling_positions", "H8", "SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS position FROM nation")
def sibling_positions(t):
    return t.nation.select("n_nationkey", (F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_name")) - 1).cast("long").alias("position"))


@query("folder_items", "U6 J5 H9", """WITH o AS (SELECT n_regionkey AS folder, o_orderkey, l_partkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN lineitem ON l_orderkey = o_orderkey)
       SELECT folder, l_partkey, min(o_orderkey) AS first, count(DISTINCT o_orderkey) AS lists FROM o GROUP BY 1, 2""")
def folder_items(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows at every scale
    d = o.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return d.groupBy(F.col("n_regionkey").alias("folder"), "l_partkey").agg(F.min("o_orderkey").alias("first"), F.count_distinct("o_orderkey").alias("lists"))


@_trees("mirror_selection", "M24 M23", f"{_CLOSURE} SELECT id FROM c WHERE ancestor IN ('n4', 'n9') UNION SELECT ancestor FROM c WHERE id IN ('n4', 'n9')")
def mirror_selection(t, nodes):
    c = G.closure(nodes, "id", "parent")
    flagged = ["n4", "n9"]
    return c.where(F.col("ancestor").isin(flagged)).select("id").unionByName(c.where(F.col("id").isin(flagged)).select(F.col("ancestor").alias("id"))).distinct()


@query("tree_diff", "M23 H6", "SELECT n_name AS path, CASE WHEN n_nationkey % 4 = 0 THEN 'gone' WHEN n_nationkey % 5 = 0 THEN 'moved' END AS change FROM nation WHERE n_nationkey % 4 = 0 OR n_nationkey % 5 = 0")
def tree_diff(t):
    from catalune.operators.changes import diff

    before = t.nation.select(F.col("n_name").alias("path"), F.col("n_regionkey").alias("parent"))
    after = t.nation.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("path"), F.when(F.col("n_nationkey") % 5 == 0, 99).otherwise(F.col("n_regionkey")).alias("parent"))
    return diff(before, after, ["path"], ["parent"]).select("path", F.when(F.col("op") == "delete", "gone").otherwise("moved").alias("change"))


@query("held_deletions", "H6", "SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING max(ts) < TIMESTAMP '2024-01-27'")
def held_deletions(t):
    from catalune.operators.linked import gone_for_good

    # a list is seen at each event; readings go on to the end of the month
    seen = t.events.groupBy("user_id", "event_type").agg(F.max("ts").alias("seen"))
    reads = t.spark.createDataFrame([("2024-01-27 00:00:00",), ("2024-01-28 00:00:00",)], "at string").select(F.col("at").cast("timestamp_ntz").alias("at"))
    return gone_for_good(seen, reads, ["user_id", "event_type"], "seen", "at", 60)
