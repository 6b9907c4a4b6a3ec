"""Generators and recommenders: part as songs (size as tempo, brand digits as key, price as rating)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalune.functions import music as M
from catalune.operators import making as K
from catalune.queries import query

_FIT = """CASE WHEN {m1} = {m2} THEN CASE WHEN least((({n2} - {n1}) % 12 + 12) % 12, 12 - (({n2} - {n1}) % 12 + 12) % 12) = 0 THEN 1.0 WHEN least((({n2} - {n1}) % 12 + 12) % 12, 12 - (({n2} - {n1}) % 12 + 12) % 12) = 1 THEN 0.9 WHEN (({n2} - {n1}) % 12 + 12) % 12 = 2 THEN 0.5 ELSE 0.0 END
       WHEN (({n2} - {n1}) % 12 + 12) % 12 = 0 THEN 0.85 ELSE 0.0 END"""


@query("key_fit", "G1", f"SELECT a.n_nationkey AS a, b.n_nationkey AS b, cast({_FIT.format(n1='(a.n_nationkey % 12 + 1)', n2='(b.n_nationkey % 12 + 1)', m1='(a.n_nationkey >= 12)', m2='(b.n_nationkey >= 12)')} AS DOUBLE) AS fit FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def key_fit(t):
    a, b = (t.nation.select(F.col("n_nationkey").alias(k), "n_regionkey") for k in "ab")
    n, m = (lambda c: F.col(c) % 12 + 1), (lambda c: F.col(c) >= 12)
    return a.join(b, "n_regionkey").select("a", "b", M.key_fit(n("a"), m("a"), n("b"), m("b")).alias("fit"))


@query("tempo_fit", "G2", "SELECT p_partkey, round(1 - least(abs(p_size - 30.0) / 30, abs(p_size * 2 - 30.0) / 30, abs(p_size / 2.0 - 30.0) / 30) / 0.08, 9) AS fit FROM part")
def tempo_fit(t):
    return t.part.select("p_partkey", F.round(M.tempo_fit(F.col("p_size").cast("double"), F.lit(30.0), 0.08, True), 9).alias("fit"))


@query("tag_fit", "G3", "SELECT p_partkey, least(1.0, (list_contains(string_split(p_name, ' '), 'blue')::INT + list_contains(string_split(p_name, ' '), 'anvil')::INT + list_contains(string_split(p_name, ' '), 'large')::INT) / 2.0)::DOUBLE AS fit FROM part")
def tag_fit(t):
    return t.part.select("p_partkey", M.tag_fit(F.split("p_name", " "), ["blue", "anvil", "large"]).alias("fit"))


_POOL = "p_partkey, p_size, p_partkey % 12 + 1 AS n, p_partkey % 5 < 3 AS minor, p_partkey % 6 AS rating, p_name, p_type"


@query("score_candidates", "G6 G4", f"""WITH c AS (SELECT {_POOL} FROM part WHERE p_partkey % 5 <> 0), s AS (SELECT p_partkey, 2 * (1 - abs(p_size - 30.0) / 30 / 0.5) + 2.5 * {_FIT.format(n1='3', n2='n', m1='true', m2='minor')} + 4 * rating / 5.0 + 3 * list_contains(string_split(p_name, ' '), 'blue')::INT AS score FROM c WHERE 1 - abs(p_size - 30.0) / 30 / 0.5 >= 0)
       SELECT p_partkey, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, p_partkey LIMIT 25""")
def score_candidates(t):
    p = t.part.withColumns({"n": F.col("p_partkey") % 12 + 1, "minor": F.col("p_partkey") % 5 < 3, "rating": F.col("p_partkey") % 6})
    c = K.pool(p, "p_partkey", F.lit(True), avoided=t.part.where("p_partkey % 5 = 0").select("p_partkey")).where(M.tempo_fit(F.col("p_size"), F.lit(30.0), 0.5) >= 0)
    s = K.score(F.col("n"), F.col("minor"), F.lit(3), F.lit(True), F.col("p_size"), F.lit(30.0), F.col("rating"), F.split("p_name", " "), ["blue"], 0.5)
    return c.select("p_partkey", F.round(s, 6).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(25)


@query("playlist_greedy", "G4 T5")
def playlist_greedy(t):
    p = t.part.withColumns({"n": F.col("p_partkey") % 12 + 1, "minor": F.col("p_partkey") % 5 < 3, "rating": F.col("p_partkey") % 6, "tags": F.split("p_name", " ")})
    return K.playlists(p, "p_type", "p_partkey", "p_size", "n", "minor", "rating", "tags", "p_partkey", count=12, start=20.0, end=40.0, tolerance=0.1, want=["blue"])


@query("playlist_seeded", "G4 T5")
def playlist_seeded(t):
    p = t.part.withColumns({"n": F.col("p_partkey") % 12 + 1, "minor": F.col("p_partkey") % 5 < 3, "rating": F.col("p_partkey") % 6, "tags": F.split("p_name", " ")})
    return K.playlists(p, "p_type", "p_partkey", "p_size", "n", "minor", "rating", "tags", "p_partkey", count=10, start=20.0, end=40.0, tolerance=0.1, want=["blue"], randomness=0.7, seed=42)


_U32 = "4294967296"
_DRAW = f"""(SELECT xor(u, u >> 14) / {_U32}.0 FROM (SELECT xor(t, (t + ((((x2 >> 16) * y2) % {_U32}) * 65536 + (x2 & 65535) * y2) % {_U32}) % {_U32}) AS u FROM (SELECT t, xor(t, t >> 7) AS x2, t | 61 AS y2 FROM (SELECT ((((x >> 16) * y) % {_U32}) * 65536 + (x & 65535) * y) % {_U32} AS t FROM (SELECT xor(a, a >> 15) AS x, a | 1 AS y FROM (SELECT (seed + turn * 1831565813) % {_U32} AS a))))))"""


@query("slot_reroll", "G5 G1 G2", f"""WITH p AS (SELECT p_type, p_partkey AS id, p_size::DOUBLE AS bpm, p_partkey % 12 + 1 AS n, p_partkey % 5 < 3 AS minor, 0.8 * (p_partkey % 6) AS points FROM part),
       f AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY id) AS i FROM p), l AS (SELECT p_type, list(id ORDER BY id) AS slots FROM f WHERE i <= 5 GROUP BY p_type HAVING count(*) = 5),
       b AS (SELECT l.p_type, slots, x.n AS bn, x.minor AS bm, y.n AS an, y.minor AS am FROM l JOIN p x ON x.p_type = l.p_type AND x.id = slots[2] JOIN p y ON y.p_type = l.p_type AND y.id = slots[4]),
       s AS (SELECT p.p_type, p.id, row_number() OVER (PARTITION BY p.p_type ORDER BY p.id) AS turn, 42 + 2 * 7919 + 5 AS seed, 2 * (1 - abs(bpm - 30) / 30 / 0.3) + 2.5 * ({_FIT.format(n1='bn', n2='n', m1='bm', m2='minor')} + {_FIT.format(n1='n', n2='an', m1='minor', m2='am')}) / 2 + points AS score
         FROM p JOIN b USING (p_type) WHERE NOT list_contains(slots, p.id) AND 1 - abs(bpm - 30) / 30 / 0.3 >= 0),
       d AS (SELECT p_type, id, turn, score + {_DRAW} * 1.1 AS v FROM s)
       SELECT p_type, id FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY v DESC, turn) AS k FROM d) WHERE k = 1""")
def slot_reroll(t):
    p = t.part.select("p_type", F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("bpm"), (F.col("p_partkey") % 12 + 1).alias("n"), (F.col("p_partkey") % 5 < 3).alias("minor"), K.points(F.col("p_partkey") % 6, F.array(), []).alias("points"), F.col("p_partkey").alias("o"))
    first = p.withColumn("i", F.row_number().over(W.partitionBy("p_type").orderBy("id"))).where("i <= 5")
    lists = first.groupBy("p_type").agg(F.array_sort(F.collect_list("id")).alias("slots")).where("size(slots) = 5").withColumns({"at": F.lit(2), "target": F.lit(30.0)})
    return K.rerolled(lists, p, "p_type", seed=42, tolerance=0.2, randomness=0.5)


@query("record_pool", "M28 G7", "SELECT l_orderkey AS record, p_partkey AS song, 'song' AS kind FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey UNION ALL SELECT NULL, p_partkey, 'library' FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def record_pool(t):
    own = t.lineitem.select(F.col("l_orderkey").alias("record"), F.col("l_partkey").alias("song")).distinct()
    on = own.join(t.part.select(F.col("p_partkey").alias("song")), "song").select("record", "song", F.lit("song").alias("kind"))
    rest = t.part.select(F.lit(None).cast("long").alias("record"), F.col("p_partkey").alias("song"), F.lit("library").alias("kind")).join(own.select("song"), "song", "left_anti")
    return on.unionByName(rest.select("record", "song", "kind"))


@query("record_builder", "G7 G8", """WITH c AS (SELECT p_partkey, p_brand, (p_type = 'PROMO')::INT * 2 + (1 - abs(p_size - 25) / 25.0) AS score FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS n FROM c)
       SELECT p_partkey, p_brand, round(score, 6) AS score FROM r WHERE n <= 2 ORDER BY r.score DESC, p_partkey LIMIT 20""")
def record_builder(t):
    s = F.when(F.col("p_type") == "PROMO", 2).otherwise(0) + (1 - F.abs(F.col("p_size") - 25) / 25.0)
    c = t.part.select("p_partkey", "p_brand", s.alias("s"))
    w = W.partitionBy("p_brand").orderBy(F.desc("s"), "p_partkey")
    return c.withColumn("n", F.row_number().over(w)).where("n <= 2").orderBy(F.desc("s"), "p_partkey").limit(20).select("p_partkey", "p_brand", F.round("s", 6).alias("score"))


@query("cover_keys", "G10 P20", r"SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || '|' || replace(lower(p_brand), '#', ' ') AS key FROM part")
def cover_keys(t):
    from catalune.functions.text import bare

    return t.part.select("p_partkey", F.concat_ws("|", bare(F.concat("p_name", F.lit(" (Deluxe Edition) [X]"))), bare(F.col("p_brand"))).alias("key"))


@query("list_order_merge", "W16 U3 M25 C10")
def list_order_merge(t):
    from catalune.operators.linked import merged_orders

    l = t.nation.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("b"))  # noqa: E741
    d = l.select("n_regionkey", "b", F.concat(F.reverse("b"), F.array(F.lit("mine"))).alias("o"), F.concat(F.slice("b", 1, 2), F.array(F.lit("theirs")), F.slice("b", 4, 9)).alias("r"))
    return merged_orders(d, "n_regionkey", "b", "o", "r")


@query("play_queue", "G9")
def play_queue(t):
    from catalune.streaming.queue import replay

    song = F.col("event_id") % 40
    e = t.events.select("user_id", "event_id", "event_type", song.alias("song"), F.sequence(song - song % 8, song - song % 8 + 7).alias("songs"))
    return replay(e, "user_id", "event_id", "event_type", "song", "songs")
