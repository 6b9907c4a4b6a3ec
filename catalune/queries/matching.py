"""Joins and entity resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalune.functions import text as X
from catalune.operators import duplicates as D
from catalune.operators import matching as J
from catalune.queries import query

ALL = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_ALL = ", ".join(ALL)


@query("dj_values", "J2", f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ALL}) AS ord FROM lineitem)
       SELECT l_orderkey, min_by(l_discount, ord) FILTER (WHERE l_discount <> 0) AS l_discount, min_by(l_tax, ord) FILTER (WHERE l_tax <> 0) AS l_tax, min_by(l_returnflag, ord) AS l_returnflag FROM o GROUP BY l_orderkey""")
def dj_values(t):
    o = t.lineitem.withColumn("ord", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ALL)))
    return J.first_values(o, "l_orderkey", "ord", ["l_discount", "l_tax", "l_returnflag"])


@query("membership", "J3", "SELECT l_partkey, count(*) AS lists FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_partkey")
def membership(t):
    return t.lineitem.select("l_orderkey", "l_partkey").distinct().groupBy("l_partkey").agg(F.count("*").alias("lists"))


@query("ordered_items", "J4 U1", f"""WITH o AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ALL}) AS pos FROM lineitem), f AS (SELECT l_orderkey, l_partkey, min(pos) AS pos FROM o GROUP BY 1, 2)
       SELECT l_orderkey, string_agg(p_name, '|' ORDER BY pos) AS names FROM f JOIN part ON p_partkey = l_partkey WHERE p_size > 5 GROUP BY l_orderkey""")
def ordered_items(t):
    o = t.lineitem.select("l_orderkey", "l_partkey", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ALL)).alias("pos")).groupBy("l_orderkey", "l_partkey").agg(F.min("pos").alias("pos"))
    d = o.join(t.part.where("p_size > 5"), F.col("l_partkey") == F.col("p_partkey"))
    return d.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p_name"))), lambda x: x["p_name"]), "|").alias("names"))


@query("twin_files", "J6 M4", """WITH k AS (SELECT p_partkey, p_name, p_size, row_number() OVER (PARTITION BY p_name, p_size, p_partkey % 2 ORDER BY p_retailprice, p_partkey) AS n FROM part)
       SELECT a.p_partkey AS a, b.p_partkey AS b FROM k a JOIN k b ON a.p_name = b.p_name AND a.p_size = b.p_size AND a.n = b.n WHERE a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1""")
def twin_files(t):
    k = t.part.select("p_partkey", "p_name", "p_size", F.row_number().over(W.partitionBy("p_name", "p_size", F.col("p_partkey") % 2).orderBy("p_retailprice", "p_partkey")).alias("n"))
    a, b = k.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "a"), k.where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "b")
    return a.join(b, ["p_name", "p_size", "n"]).select("a", "b")


@query("import_by_path", "J7 P25", """WITH k AS (SELECT s_suppkey, lower(replace(s_name, '#', '/')) AS path, 0 AS pri FROM supplier UNION ALL SELECT s_suppkey, 'supplier/' || lpad(cast(s_suppkey + 1 AS VARCHAR), 9, '0'), 1 FROM supplier),
       r AS (SELECT p_partkey, s_suppkey, row_number() OVER (PARTITION BY p_partkey ORDER BY pri, s_suppkey) AS n FROM part JOIN k ON path = 'supplier/' || lpad(cast(p_partkey % 120 AS VARCHAR), 9, '0')) SELECT p_partkey, s_suppkey FROM r WHERE n = 1""")
def import_by_path(t):
    s = t.supplier
    keys = s.select("s_suppkey", F.lower(F.replace("s_name", F.lit("#"), F.lit("/"))).alias("path"), F.lit(0).alias("pri")).unionByName(s.select("s_suppkey", F.concat(F.lit("supplier/"), F.lpad((F.col("s_suppkey") + 1).cast("string"), 9, "0")).alias("path"), F.lit(1).alias("pri")))
    p = t.part.select("p_partkey", F.lower(F.concat(F.lit("Supplier/"), F.lpad((F.col("p_partkey") % 120).cast("string"), 9, "0"))).alias("path"))
    return p.join(keys, "path").groupBy("p_partkey").agg(F.min_by("s_suppkey", F.struct("pri", "s_suppkey")).alias("s_suppkey"))


@query("name_size_match", "J8", """WITH b AS (SELECT a.p_partkey AS a, b.p_partkey AS b, count(*) OVER (PARTITION BY a.p_partkey) AS n FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1 WHERE abs(a.p_retailprice - b.p_retailprice) <= 200) SELECT a, b FROM b WHERE n = 1""")
def name_size_match(t):
    a = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("a"), "p_name", "p_brand", F.col("p_retailprice").alias("x"))
    b = t.part.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("b"), "p_name", "p_brand", F.col("p_retailprice").alias("y"))
    return J.unique_range_match(a, b, ["p_name", "p_brand"], "x", "y", 200).select("a", "b")


@query(
    "suffix_match", "J9",
    r"""WITH p AS (SELECT page_id, string_split(lower(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$|/$', '')), '/') AS s FROM pages), q AS (SELECT page_id, s, s[-1] AS k FROM p WHERE len(s) > 1 AND s[-1] <> ''),
       b AS (SELECT a.page_id AS a, b.page_id AS b, CASE WHEN a.s[-2] IS DISTINCT FROM b.s[-2] OR len(a.s) < 2 OR len(b.s) < 2 THEN 1 WHEN a.s[-3] IS DISTINCT FROM b.s[-3] OR len(a.s) < 3 OR len(b.s) < 3 THEN 2 ELSE 3 END AS score FROM q a JOIN q b USING (k) WHERE a.page_id % 2 = 0 AND b.page_id % 2 = 1),
       m AS (SELECT *, max(score) OVER (PARTITION BY a) AS best FROM b), n AS (SELECT *, count(*) OVER (PARTITION BY a) AS n FROM m WHERE score = best) SELECT a AS page_id, b AS file_id, score FROM n WHERE n = 1""",
)
def suffix_match(t):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$|/$", "")
    p = t.pages.select("page_id", path.alias("path")).where(F.size(F.split("path", "/")) > 1).where(F.element_at(F.split("path", "/"), -1) != "")
    a = p.where("page_id % 2 = 0").select("page_id", "path", F.lit(1).alias("size"))
    b = p.where("page_id % 2 = 1").select(F.col("page_id").alias("file_id"), F.col("path").alias("fpath"), F.lit(2).alias("fsize"))
    return J.longest_suffix(a, b, "page_id", "path", "file_id", "fpath", "size", "fsize")


@query("vote_prefix", "J10", r"""WITH v AS (SELECT regexp_extract(url, '://([^/]*)', 1) AS root, regexp_extract(url, '://[^/]*/([a-z]+)/', 1) AS prefix, count(*) AS votes FROM pages GROUP BY 1, 2), r AS (SELECT *, count(*) OVER (PARTITION BY root) AS kinds, row_number() OVER (PARTITION BY root ORDER BY votes DESC, prefix) AS i FROM v)
       SELECT root, prefix, votes FROM r WHERE i = 1 AND (votes >= 2 OR kinds = 1)""")
def vote_prefix(t):
    d = t.pages.select(F.regexp_extract("url", "://([^/]*)", 1).alias("root"), F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1).alias("prefix"))
    return J.vote_prefix(d, "root", "prefix")


def _packed(d, name, fields):
    """The columns ``fields`` in one struct: each is made once, however often others use it."""
    return d.withColumn(name, F.struct(*fields)).drop(*fields)


def _title(d, name, title):
    d = d.withColumns({"title": X.song_name(title), "version": X.version(title)})
    d = d.withColumns({"joined": F.replace("title", F.lit(" "), F.lit("")), "words": X.words(F.col("title")), "file": F.lit("")})
    return _packed(d, name, ["title", "joined", "words", "file", "version"])


def _credit(d, name, artist, length):
    d = d.withColumns({"artist": X.song_name(artist), "artists": X.artists(artist), "duration": length.cast("double")})
    d = d.withColumns({"artist_words": X.words(F.col("artist")), "album": F.lit(""), "size": F.lit(0)})
    return _packed(d, name, ["artist", "artists", "artist_words", "album", "duration", "size"])


@query("relink_scored", "J11 J12 W10 W11 M15 M29", """WITH p AS (SELECT p_partkey AS id, p_name AS title, replace(p_name, ' ', '') AS joined, list_distinct(list_filter(string_split(p_name, ' '), lambda w: length(w) > 1)) AS words, replace(lower(p_brand), '#', ' ') AS brand, p_size AS d FROM part),
       o AS (SELECT * FROM p WHERE id % 10 = 0), c AS (SELECT * FROM p WHERE id % 10 <> 0), cw AS (SELECT id, unnest(words) AS w FROM c), n AS (SELECT w, count(*) AS n FROM cw GROUP BY w),
       r AS (SELECT id, min_by(w, (n, w)) AS w FROM (SELECT id, unnest(words) AS w FROM o) JOIN n USING (w) GROUP BY id),
       b AS (SELECT r.id AS o, cw.id AS c FROM r JOIN cw USING (w) UNION SELECT o.id, c.id FROM o JOIN c USING (joined)),
       f AS (SELECT o.id AS o, c.id AS c, o.title AS ot, c.title AS ct, o.joined AS oj, c.joined AS cj, o.brand AS ob, c.brand AS cb, list_filter(string_split(o.brand, ' '), lambda w: length(w) > 1) AS bw, list_filter(string_split(c.brand || ' friends', ' '), lambda w: length(w) > 1) AS dw, abs(o.d - c.d) AS d, o.d > 0 AND c.d > 0 AS known, len(list_intersect(o.words, c.words)) / greatest(len(o.words), len(c.words)) AS share FROM b JOIN o ON o.id = b.o JOIN c ON c.id = b.c),
       g AS (SELECT o, c, CASE WHEN ot = ct OR (oj = cj AND length(oj) >= 4) THEN 45 WHEN least(length(ot), length(ct)) >= 4 AND (contains(ot, ct) OR contains(ct, ot)) THEN 30 WHEN share >= 0.6 THEN floor(25 * share + 0.5) END AS t,
         CASE WHEN ob = cb OR contains(cb || ' friends', ob) OR len(list_intersect(bw, dw)) / greatest(len(bw), len(dw)) >= 0.5 THEN 15 ELSE -15 END AS a,
         CASE WHEN NOT known THEN 6 WHEN d <= 1.5 THEN 20 WHEN d <= 3 THEN 14 WHEN d <= 6 THEN 5 WHEN d <= 20 THEN -25 ELSE -50 END AS l FROM f),
       s AS (SELECT o, c, greatest(0, least(100, t + a + l))::INT AS sure FROM g WHERE t IS NOT NULL),
       k AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY sure DESC, c) AS rank FROM s WHERE sure >= 50), z AS (SELECT *, sure - lead(sure) OVER (PARTITION BY o ORDER BY rank) AS gap FROM k WHERE rank <= 3)
       SELECT o, c, CASE WHEN rank = 1 AND gap <= 3 THEN greatest(0, sure - 10) ELSE sure END::INT AS sure, rank::INT AS rank FROM z""")
def relink_scored(t):
    # equal songs score alike: distinct titles are compared first, then the distinct songs of titles that may be the
    # same; of equal songs only the first three can be among the best three
    same, most = ["p_name", "p_brand", "p_size"], 3
    p = t.part.select("p_partkey", *same)
    old, new = p.where("p_partkey % 10 = 0"), p.where("p_partkey % 10 <> 0")
    fields = lambda d, *structs: {f: F.col(f"{s}.{f}") for s in structs for f in d.schema[s].dataType.names}
    o_names = _title(old.select(F.col("p_name").alias("o_name")).distinct(), "so", F.concat("o_name", F.lit(" (Album Version)")))
    c_names = _title(new.groupBy(F.col("p_name").alias("c_name")).agg(F.count("*").alias("rows")), "sc", F.col("c_name"))
    joined = lambda c: F.nullif(F.col(c), F.lit(""))
    names = J.blocked_pairs(o_names, c_names, "o_name", F.col("so.words"), "c_name", F.col("sc.words"), [joined("so.joined")], [joined("sc.joined")], F.col("rows"))
    names = names.where(J.says_same_title(fields(names, "so"), fields(names, "sc"))).select("o_name", "c_name", "so", "sc").distinct()
    songs = _credit(old.groupBy(*same).agg(F.min("p_partkey").alias("o")), "ao", F.col("p_brand"), F.col("p_size")).select("o", F.col("p_name").alias("o_name"), "ao")
    first = new.distinct().withColumn("i", F.row_number().over(W.partitionBy(*same).orderBy("p_partkey"))).where(F.col("i") <= most)
    found = _credit(first.groupBy(*same).agg(F.collect_list("p_partkey").alias("cs")), "ac", F.concat("p_brand", F.lit(" & Friends")), F.col("p_size")).select("cs", F.col("p_name").alias("c_name"), "ac")
    both = J.spread_join(songs.join(names.hint("merge"), "o_name"), found, ["c_name"], ["cs"])
    score = J.relink_score(fields(both, "so", "ao"), fields(both, "sc", "ac"))
    scored = both.select("o", "cs", score.alias("sure")).where("sure >= 50").select("o", F.explode("cs").alias("c"), "sure").distinct()
    best = J.best_matches(scored, "o", "c", "sure", most=most)
    # the matches of a song are those of all that equal it
    alike = old.distinct().join(old.groupBy(*(F.col(c).alias(f"{c}_") for c in same)).agg(F.min("p_partkey").alias("song")).hint("merge"), reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"{c}_")) for c in same)))
    return alike.select(F.col("p_partkey").alias("o"), "song").join(best.withColumnRenamed("o", "song").hint("merge"), "song").select("o", "c", "sure", "rank")


@query("word_overlap", "J12 P34", """WITH w AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS b FROM part)
       SELECT p_partkey, len(list_intersect(a, b)) / greatest(len(a), len(b)) AS share FROM w""")
def word_overlap(t):
    a, b = F.array_distinct(F.split("p_name", " ")), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "))
    return t.part.select("p_partkey", X.overlap(a, b).alias("share"))


@query("record_match", "J13", """WITH c AS (SELECT a.p_partkey AS track, b.p_partkey AS song, CASE WHEN a.p_partkey % 50 = 0 AND b.p_partkey = a.p_partkey + 1 THEN 0 WHEN a.p_brand = b.p_brand AND a.p_type = b.p_type THEN 1 ELSE 2 END AS stage, abs(a.p_size - b.p_size) AS gap
       FROM part a JOIN part b ON a.p_name = b.p_name WHERE a.p_partkey % 20 = 0 AND b.p_partkey % 20 <> 0 AND abs(a.p_size - b.p_size) <= 8), r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY stage, gap, song) AS n FROM c) SELECT track, song, stage FROM r WHERE n = 1""")
def record_match(t):
    a = t.part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("track"), "p_name", F.col("p_brand").alias("ab"), F.col("p_type").alias("at"), F.col("p_size").alias("x"))
    b = t.part.where("p_partkey % 20 <> 0").select(F.col("p_partkey").alias("song"), "p_name", "p_brand", "p_type", F.col("p_size").alias("y"))
    both = J.band_join(a, b, "x", "y", 8, ["p_name"])
    stage = F.when((F.col("track") % 50 == 0) & (F.col("song") == F.col("track") + 1), 0).when((F.col("ab") == F.col("p_brand")) & (F.col("at") == F.col("p_type")), 1).otherwise(2)
    best = both.withColumns({"stage": stage, "gap": F.abs(F.col("x") - F.col("y"))}).groupBy("track").agg(F.min(F.struct("stage", "gap", "song")).alias("m"))
    return best.select("track", "m.song", "m.stage")


def _words(t):
    bits = F.transform("embedding", lambda x: (x > 0).cast("long"))
    word = lambda a: F.aggregate(F.slice(bits, a + 1, 32), F.lit(0).cast("long"), lambda s, b: s * 2 + b)
    return t.embeddings.select("vec_id", F.array(word(0), word(32)).alias("words"))


_PIECES = """w AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INT) AS b FROM embeddings), v AS (SELECT vec_id, list_reduce(list_transform(b[1:32], lambda x: x::BIGINT), lambda s, x: s * 2 + x) AS w1, list_reduce(list_transform(b[33:64], lambda x: x::BIGINT), lambda s, x: s * 2 + x) AS w2 FROM w),
       p AS (SELECT vec_id, w1 & 65535 AS key, 0 AS pos FROM v UNION ALL SELECT vec_id, (w1 >> 16) + 65536, 0 FROM v UNION ALL SELECT vec_id, w2 & 65535, 1 FROM v UNION ALL SELECT vec_id, (w2 >> 16) + 65536, 1 FROM v),
       k AS (SELECT key FROM p GROUP BY key HAVING count(*) BETWEEN 2 AND 60), q AS (SELECT p.* FROM p JOIN k USING (key)),
       m AS (SELECT a.vec_id AS a, b.vec_id AS b, b.pos - a.pos AS off, count(*) AS n FROM q a JOIN q b ON a.key = b.key AND a.vec_id < b.vec_id GROUP BY 1, 2, 3)"""


@query("near_duplicates", "J14 D7", f"WITH {_PIECES} SELECT * FROM m")
def near_duplicates(t):
    return D.votes(D.pieces(_words(t), "vec_id", "words")).select("a", "b", F.col("off").cast("int").alias("off"), "n")


@query("confirmed_matches", "J14 D7", f"""WITH {_PIECES}, s AS (SELECT *, sum(n) OVER (PARTITION BY a, b ORDER BY off RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS pool FROM m),
       r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY pool DESC, off) AS i FROM s), c AS (SELECT DISTINCT a, b, off + d AS off FROM r, range(-2, 3) x(d) WHERE i <= 3 AND abs(off + d) <= 1),
       e AS (SELECT c.a, c.b, c.off, 2 - abs(c.off) AS frames, CASE c.off WHEN 0 THEN (bit_count(xor(x.w1, y.w1)) + bit_count(xor(x.w2, y.w2))) / 64.0 WHEN 1 THEN bit_count(xor(x.w1, y.w2)) / 32.0 ELSE bit_count(xor(x.w2, y.w1)) / 32.0 END AS ber FROM c JOIN v x ON x.vec_id = c.a JOIN v y ON y.vec_id = c.b)
       SELECT a, b, ber, off, frames FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ber, off, frames) AS k FROM e) WHERE k = 1 AND ber <= 0.3""")
def confirmed_matches(t):
    fps = _words(t)
    return D.confirmed(D.votes(D.pieces(fps, "vec_id", "words")), fps, "vec_id", "words", least_votes=1, least_words=1)


@query("incremental_matches", "J15", f"WITH {_PIECES} SELECT * FROM m WHERE a % 10 = 0 OR b % 10 = 0")
def incremental_matches(t):
    fps = _words(t)
    return D.votes(D.pieces(fps, "vec_id", "words"), fresh=fps.where("vec_id % 10 = 0").select("vec_id"))


@query("bit_error_rate", "D7", """WITH w AS (SELECT vec_id, label, list_transform(embedding, lambda x: (x > 0)::INT) AS b FROM embeddings), f AS (SELECT label, min_by(b, vec_id) AS b0 FROM w GROUP BY label)
       SELECT vec_id, len(list_filter(list_zip(b, b0), lambda p: p[1] <> p[2])) / 64.0 AS ber FROM w JOIN f USING (label)""")
def bit_error_rate(t):
    e = _words(t).join(t.embeddings.select("vec_id", "label"), "vec_id")
    first = e.groupBy("label").agg(F.min_by("words", "vec_id").alias("w0"))
    ber, _ = D.bit_errors(F.col("words"), F.col("w0"), F.lit(0))
    return e.join(first, "label").select("vec_id", ber.alias("ber"))


@query("components", "J16")
def components(t):
    e = t.orders.where("o_custkey > 7").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") - 7).alias("b"))
    return D.groups(e)


@query("name_groups", "J17", """WITH o AS (SELECT p_partkey, p_name, p_type, p_retailprice AS d, p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_name, p_type ORDER BY p_retailprice, p_partkey) AS gap FROM part), g AS (SELECT *, sum(CASE WHEN gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY p_name, p_type ORDER BY d, p_partkey) AS g FROM o),
       s AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_name, p_type, g) AS "group", count(*) OVER (PARTITION BY p_name, p_type, g) AS n FROM g) SELECT id, "group" FROM s WHERE n > 1""")
def name_groups(t):
    return D.name_groups(t.part, "p_partkey", ["p_name", "p_type"], "p_retailprice", 3)


@query("dup_groups", "J18 U4", """WITH RECURSIVE g AS (SELECT p_partkey AS a, lead(p_partkey) OVER (PARTITION BY p_name, p_brand, p_type ORDER BY p_partkey) AS b FROM part), e AS (SELECT a, b FROM g WHERE b IS NOT NULL AND (a + b) % 7 <> 0 UNION SELECT 1, 2),
       n AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT x AS node, x AS y FROM n UNION SELECT r.node, n.y FROM r JOIN n ON n.x = r.y) SELECT node, min(y) AS label FROM r GROUP BY node""")
def dup_groups(t):
    e = t.part.select(F.col("p_partkey").alias("a"), F.lead("p_partkey").over(W.partitionBy("p_name", "p_brand", "p_type").orderBy("p_partkey")).alias("b")).where("b is not null")
    manual = t.spark.createDataFrame([(1, 2)], "a long, b long")
    return D.groups(e, manual=manual, apart=e.where("(a + b) % 7 = 0"))


@query("rewrite_lists", "J19", f"""WITH b AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS best FROM part), o AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ALL}) AS pos FROM lineitem)
       SELECT l_orderkey, best AS l_partkey, min(pos) AS pos FROM o JOIN b ON p_partkey = l_partkey GROUP BY 1, 2""")
def rewrite_lists(t):
    best = t.part.join(t.part.groupBy("p_name").agg(F.min("p_partkey").alias("best")), "p_name").select("p_partkey", "best")
    o = t.lineitem.select("l_orderkey", "l_partkey", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ALL)).cast("long").alias("pos"))
    return D.best_lists(o, best, "l_orderkey", "l_partkey", "pos")


@query("asof_latest", "J8 W13", """SELECT o_orderkey, (SELECT max(event_id) FROM events WHERE user_id = o_custkey % 150 AND event_id <= o_orderkey) AS latest FROM orders""")
def asof_latest(t):
    o = t.orders.select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"))
    e = t.events.select("user_id", F.col("event_id").alias("latest"))
    return J.asof_join(o, e, ["user_id"], "o_orderkey", "latest", ["latest"]).select("o_orderkey", "latest")
