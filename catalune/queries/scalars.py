"""Scalar derivations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalune.functions import music as M
from catalune.functions import text as X
from catalune.queries import query


@query(
    "state_classify", "P3 F7",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate,
       CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_tax > 0.06 THEN 'failed' ELSE 'elsewhere' END
            WHEN l_linestatus <> 'O' AND l_discount > 0.08 THEN 'nofile'
            WHEN l_quantity IS NULL OR l_quantity < 10 OR l_shipdate IS DISTINCT FROM date_trunc('day', l_shipdate) THEN 'waiting'
            WHEN l_tax > 0.06 THEN CASE WHEN l_returnflag = 'A' THEN 'waiting' ELSE 'failed' END
            ELSE 'done' END AS state FROM lineitem""",
)
def state_classify(t):
    from catalune.operators.views import classify

    error = F.col("l_tax") > 0.06
    state = classify(remote=F.col("l_returnflag") == "R", linked=~((F.col("l_linestatus") != "O") & (F.col("l_discount") > 0.08)), stale=F.col("l_quantity").isNull() | (F.col("l_quantity") < 10) | ~F.col("l_shipdate").eqNullSafe(F.date_trunc("day", "l_shipdate").cast("timestamp_ntz")), error=error, transient=F.col("l_returnflag") == "A")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", state.alias("state"))


@query(
    "overlay_verdict", "P2",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'ok' ELSE o_orderpriority END AS shown,
       (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS overridden FROM orders""",
)
def overlay_verdict(t):
    # an override counts only while the label is still the one that was cleared
    still = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    return t.orders.select("o_orderkey", F.when(still, "ok").otherwise(F.col("o_orderpriority")).alias("shown"), still.alias("overridden"))


@query(
    "effective_value", "P4 P24",
    """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 7 = 0 THEN c_acctbal END, CASE WHEN c_custkey % 3 = 0 THEN -c_acctbal END,
       CASE WHEN c_acctbal > 0 THEN c_acctbal END) AS value,
       CASE WHEN coalesce(nullif(CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END, ''), '') = '' AND c_custkey % 10 <> 0 THEN c_name
            ELSE CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END END AS filled FROM customer""",
)
def effective_value(t):
    from catalune.operators.edits import fill_if_empty

    k = F.col("c_custkey")
    seg = F.when(k % 5 == 0, "").otherwise(F.col("c_mktsegment"))
    value = F.coalesce(F.when(k % 7 == 0, F.col("c_acctbal")), F.when(k % 3 == 0, -F.col("c_acctbal")), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return t.customer.select("c_custkey", value.alias("value"), fill_if_empty(seg, F.col("c_name"), edited=k % 10 == 0).alias("filled"))


@query(
    "octave_fold", "P5 P6",
    """WITH f AS (SELECT o_orderkey, CASE WHEN o_totalprice > 0 THEN o_totalprice * pow(2.0, -floor(log2(o_totalprice / 60.0))) END AS v FROM orders)
       SELECT o_orderkey, v AS folded, CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN v >= 120 THEN v / 2 ELSE v * 2 END ELSE v END AS shown,
       CASE WHEN abs(v - floor(v + 0.5)) < 0.05 THEN cast(cast(floor(v + 0.5) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', floor(v * 10 + 0.5) / 10) END AS label FROM f""",
)
def octave_fold(t):
    v = M.octave_fold(F.col("o_totalprice"), 60.0)
    d = t.orders.select("o_orderkey", v.alias("folded"))
    return d.select("o_orderkey", "folded", M.flipped(F.col("folded"), F.col("o_orderkey") % 4 == 0).alias("shown"), M.tempo_text(F.col("folded")).alias("label"))


@query(
    "quality_bucket", "P7 T2",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
       CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'Could not analyse' WHEN l_returnflag = 'N' THEN 'Not analysed'
            WHEN l_discount >= 0.07 THEN 'suspect' ELSE 'ok' END AS bucket,
       CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 3 WHEN l_returnflag = 'N' THEN 2 WHEN l_discount >= 0.07 THEN 1 ELSE 0 END AS rank
       FROM lineitem""",
)
def quality_bucket(t):
    failed, none, odd = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"), F.col("l_returnflag") == "N", F.col("l_discount") >= 0.07
    pick = lambda a, b, c, d: F.when(failed, a).when(none, b).when(odd, c).otherwise(d)
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", pick("Could not analyse", "Not analysed", "suspect", "ok").alias("bucket"), pick(3, 2, 1, 0).alias("rank"))


@query(
    "format_bucket", "P8",
    """SELECT page_id, CASE WHEN regexp_matches(url, '[.]html?([?#]|$)') THEN 'HTML' WHEN regexp_matches(url, '[?]') THEN 'QUERY'
       ELSE upper(regexp_extract(url, '://[^/]*[.]([a-z]+)/', 1)) END AS format FROM pages""",
)
def format_bucket(t):
    u = F.col("url")
    form = F.when(u.rlike(r"\.html?([?#]|$)"), "HTML").when(u.contains("?"), "QUERY").otherwise(F.upper(F.regexp_extract(u, r"://[^/]*\.([a-z]+)/", 1)))
    return t.pages.select("page_id", form.alias("format"))


@query(
    "facet_value_year", "P9 P12 A6",
    r"""WITH y AS (SELECT o_orderkey, regexp_extract('on ' || strftime(o_orderdate, '%Y-%m-%d'), '\b(1[89]\d\d|20\d\d)\b', 1) AS year, strftime(o_orderdate, '%Y-%m') AS month FROM orders)
       SELECT year, CASE WHEN year <> '' THEN substr(year, 1, 3) || '0s' ELSE '' END AS decade, month, count(*) AS n FROM y GROUP BY ALL""",
)
def facet_value_year(t):
    from catalune.operators.facets import decade_of, year_of

    text = F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    d = t.orders.select(year_of(text).alias("year"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return d.groupBy("year", decade_of(F.col("year")).alias("decade"), "month").agg(F.count("*").alias("n"))


@query(
    "key_label", "P10",
    """WITH k AS (SELECT n_nationkey, n_nationkey % 12 AS tonic, n_nationkey >= 12 AS minor FROM nation),
       f AS (SELECT *, ((CASE WHEN minor THEN (tonic + 3) % 12 ELSE tonic END) * 7) % 12 AS pos FROM k)
       SELECT n_nationkey, cast((pos + 7) % 12 + 1 AS VARCHAR) || CASE WHEN minor THEN 'A' ELSE 'B' END AS camelot,
       cast(pos + 1 AS VARCHAR) || CASE WHEN minor THEN 'm' ELSE 'd' END AS open_key,
       CASE WHEN minor THEN ['C','C♯','D','E♭','E','F','F♯','G','G♯','A','B♭','B'][tonic + 1] || ' minor' ELSE ['C','D♭','D','E♭','E','F','F♯','G','A♭','A','B♭','B'][tonic + 1] || ' major' END AS musical FROM f""",
)
def key_label(t):
    k = t.nation.select("n_nationkey", (F.col("n_nationkey") % 12).alias("tonic"), (F.col("n_nationkey") >= 12).alias("minor"))
    label = lambda n: M.key_label(F.col("tonic"), F.col("minor"), n)
    return k.select("n_nationkey", label("camelot").alias("camelot"), label("open").alias("open_key"), label("musical").alias("musical"))


@query(
    "key_neighbours", "P11",
    """WITH k AS (SELECT n_nationkey, n_nationkey % 12 AS tonic, n_nationkey >= 12 AS minor FROM nation),
       f AS (SELECT *, ((CASE WHEN minor THEN (tonic + 3) % 12 ELSE tonic END) * 7) % 12 AS pos FROM k),
       n AS (SELECT n_nationkey, 0 AS i, (pos + 11) % 12 AS p, minor AS m FROM f UNION ALL SELECT n_nationkey, 1, (pos + 1) % 12, minor FROM f UNION ALL SELECT n_nationkey, 2, pos, NOT minor FROM f)
       SELECT n_nationkey, i, cast(CASE WHEN m THEN ((p * 7) % 12 + 9) % 12 ELSE (p * 7) % 12 END AS INTEGER) AS tonic, m AS minor FROM n""",
)
def key_neighbours(t):
    near = M.neighbours(F.col("n_nationkey") % 12, F.col("n_nationkey") >= 12)
    return t.nation.select("n_nationkey", F.posexplode(near).alias("i", "k")).select("n_nationkey", "i", "k.tonic", "k.minor")


@query(
    "hashtags", "P13",
    r"""SELECT page_id, list_transform(list_filter(regexp_extract_all(html, '<h1>([^<]*)', 1), lambda x: x <> ''), lambda x: lower(trim(x))) AS tags FROM pages""",
)
def hashtags(t):
    found = F.regexp_extract_all("html", F.lit("<h1>([^<]*)"), F.lit(1))
    return t.pages.select("page_id", F.transform(F.filter(found, lambda x: x != ""), lambda x: F.lower(F.trim(x))).alias("tags"))


@query(
    "found_tags", "P13 P14",
    """WITH w AS (SELECT p_partkey, p_name, p_type, lower(p_brand) AS b FROM part),
       a AS (SELECT p_partkey, 1 AS i, trim(split_part(p_name, ' ', 1)) AS tag FROM w UNION ALL SELECT p_partkey, 2, trim(split_part(p_name, ' ', 2)) FROM w
             UNION ALL SELECT p_partkey, 3, p_type FROM w UNION ALL SELECT p_partkey, 4, replace(b, '#', '_') FROM w UNION ALL SELECT p_partkey, 5, upper(p_type) FROM w),
       r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(tag) ORDER BY i) AS n FROM a WHERE tag <> '')
       SELECT p_partkey, string_agg(tag, '|' ORDER BY i) AS tags FROM r WHERE n = 1 GROUP BY p_partkey""",
)
def found_tags(t):
    grouping = F.replace("p_name", F.lit(" "), F.lit(" ; "))
    comment = F.concat(F.lit("/* "), "p_type", F.lit(" */ about #"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")), F.lit(" and x#not #"), F.upper("p_type"))
    return t.part.select("p_partkey", F.array_join(X.found_tags(grouping, comment), "|").alias("tags"))


@query(
    "tag_edits", "P14 P15",
    """SELECT p_partkey, CASE WHEN lower(split_part(p_name, ' ', 1)) = lower(split_part(p_name, ' ', 2)) THEN split_part(p_name, ' ', 1) ELSE replace(p_name, ' ', '|') END || '|sale' AS added,
       array_to_string(list_filter(string_split(p_name, ' '), lambda x: lower(x) <> lower(p_type)), '|') AS removed FROM part""",
)
def tag_edits(t):
    tags = F.split("p_name", " ")
    added = X.add_tags(tags, F.array(F.lit(" #sale "), F.upper(F.get(tags, F.lit(0)))))
    return t.part.select("p_partkey", F.array_join(added, "|").alias("added"), F.array_join(X.remove_tags(tags, F.array(F.concat(F.lit("#"), F.col("p_type")))), "|").alias("removed"))


@query(
    "stable_colour", "P16",
    """WITH RECURSIVE b AS (SELECT DISTINCT lower(p_brand) AS tag FROM part), h AS (
       SELECT tag, 0 AS i, cast(2166136261 AS BIGINT) AS h FROM b UNION ALL
       SELECT tag, i + 1, (xor(h, cast(ascii(substr(tag, i + 1, 1)) AS BIGINT)) * 16777619) % 4294967296 FROM h WHERE i < length(tag))
       SELECT tag, h AS hash, h % 12 AS colour FROM h WHERE i = length(tag)""",
)
def stable_colour(t):
    d = t.part.select(F.lower("p_brand").alias("tag")).distinct().withColumn("hash", X.fnv1a(F.col("tag")))
    return d.select("tag", "hash", (F.col("hash") % 12).alias("colour"))


@query(
    "fold_names", "P17",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(left_part)), '&|\band\b', ' ', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) AS folded
       FROM (SELECT doc_id, split_part(text, chr(10), 1) AS left_part FROM documents)""",
)
def fold_names(t):
    return t.documents.select("doc_id", X.fold(F.get(F.split("text", "\n"), F.lit(0))).alias("folded"))


_KINDS = "instrumental|inst|a ?cappella|acappella|live|unplugged|remix|dub|acoustic|demo|extended|radio edit|radio version|edit|clean version|clean"


@query(
    "song_names", "P18 P19 P20",
    rf"""WITH n AS (SELECT p_partkey, p_name || CASE p_partkey % 6 WHEN 0 THEN ' (Album Version)' WHEN 1 THEN ' [X 01]' WHEN 2 THEN ' (Live at Hyde Park)' WHEN 3 THEN ' feat. Someone (Remix)' WHEN 4 THEN ' - Radio Edit' ELSE '' END AS name FROM part),
       c AS (SELECT *, regexp_replace(lower(name), '\b(feat|ft|featuring)\b\.?[^()\[\]]*', ' ', 'g') AS t FROM n),
       b AS (SELECT *, regexp_replace(regexp_replace(t, '\[[^\]]*\]', ' ', 'g'), '\(\s*((album|version|original|mix|{_KINDS}|[0-9]+)\s*)*\)', ' ', 'g') AS s, regexp_replace(t, '\([^)]*\)|\[[^\]]*\]', ' ', 'g') AS r FROM c),
       m AS (SELECT p_partkey, unnest(regexp_extract_all(concat_ws(' ', regexp_extract(lower(name), '\(([^)]*)\)', 1), string_split(lower(name), ' - ')[2], 'live'), '\b({_KINDS})\b', 1)) AS w FROM n),
       v AS (SELECT p_partkey, string_agg(DISTINCT w, ',' ORDER BY w) AS version FROM (SELECT p_partkey, CASE w WHEN 'radio edit' THEN 'edit' WHEN 'inst' THEN 'instrumental' ELSE w END AS w FROM m) GROUP BY p_partkey)
       SELECT p_partkey, name, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) AS song, trim(regexp_replace(r, '[^a-z0-9]+', ' ', 'g')) AS bare, version FROM b JOIN v USING (p_partkey)""",
)
def song_names(t):
    name = F.concat("p_name", F.element_at(F.array(*map(F.lit, [" (Album Version)", " [X 01]", " (Live at Hyde Park)", " feat. Someone (Remix)", " - Radio Edit", ""])), (F.col("p_partkey") % 6 + 1).cast("int")))
    d = t.part.select("p_partkey", name.alias("name"))
    return d.select("p_partkey", "name", X.song_name(F.col("name")).alias("song"), X.bare(F.col("name")).alias("bare"), X.version(F.col("name"), F.lit("Live in town")).alias("version"))


@query(
    "version_words", "P19",
    r"""WITH v AS (SELECT p_partkey, lower(p_name || ' (' || CASE p_partkey % 5 WHEN 0 THEN 'Extended Remix' WHEN 1 THEN 'Radio Edit' WHEN 2 THEN 'Inst' WHEN 3 THEN 'Clean' ELSE 'Original' END || ')') AS name FROM part),
       w AS (SELECT p_partkey, unnest(regexp_extract_all(regexp_extract(name, '\(([^)]*)\)', 1), '\b(extended|remix|radio edit|inst|clean)\b', 1)) AS w FROM v),
       s AS (SELECT DISTINCT p_partkey, CASE w WHEN 'radio edit' THEN 'edit' WHEN 'inst' THEN 'instrumental' ELSE w END AS w FROM w)
       SELECT v.p_partkey, coalesce(string_agg(w, ',' ORDER BY w), '') AS version FROM v LEFT JOIN s USING (p_partkey) GROUP BY v.p_partkey""",
)
def version_words(t):
    word = F.element_at(F.array(*map(F.lit, ["Extended Remix", "Radio Edit", "Inst", "Clean", "Original"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", X.version(F.concat("p_name", F.lit(" ("), word, F.lit(")"))).alias("version"))


@query(
    "artist_split", "P21 J12",
    """WITH a AS (SELECT s_suppkey, trim(regexp_replace(strip_accents(lower(s_name)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS x, s_nationkey FROM supplier),
       p AS (SELECT a.s_suppkey, a.x, n.n_name, trim(regexp_replace(lower(n_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS y FROM a JOIN nation n ON n_nationkey = s_nationkey)
       SELECT s_suppkey, CASE WHEN x < y THEN x || '+' || y ELSE y || '+' || x END AS artists FROM p""".replace("\\\\", "\\"),
)
def artist_split(t):
    d = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return d.select("s_suppkey", F.array_join(X.artists(F.concat("s_name", F.lit(" feat. "), "n_name")), "+").alias("artists"))


@query(
    "path_names", "P22 P25 P20",
    r"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS path FROM pages),
       b AS (SELECT page_id, path, regexp_extract(rtrim(path, '/'), '([^/]*)$', 1) AS base FROM u)
       SELECT page_id, base, regexp_replace(lpad(cast(page_id % 30 AS VARCHAR), 2, '0') || ' - ' || base, '^(\d{1,2}-)?\d{1,3}(\s*[-._)]\s*|\s+)', '') AS stem0,
       'Maker ' || cast(page_id % 3 AS VARCHAR) AS artist, regexp_replace(base, '[.][^.]+$', '') AS title FROM b""",
)
def path_names(t):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", "")
    d = t.pages.select("page_id", X.base_name(path).alias("base"))
    number = F.lpad((F.col("page_id") % 30).cast("string"), 2, "0")
    artist, title = X.artist_title(F.concat(number, F.lit(" Maker "), (F.col("page_id") % 3).cast("string"), F.lit(" - "), "base"))
    title = F.when(F.col("base").contains("."), title).otherwise(F.col("base"))
    stem0 = F.regexp_replace(F.concat(number, F.lit(" - "), "base"), r"^(\d{1,2}-)?\d{1,3}(\s*[-._)]\s*|\s+)", "")
    return d.select("page_id", "base", stem0.alias("stem0"), artist.alias("artist"), title.alias("title"))


@query(
    "field_pick", "P23",
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, 'none') AS picked FROM orders""",
)
def field_pick(t):
    from catalune.operators.edits import pick_field

    k = F.col("o_orderkey")
    frames = F.map_filter(F.map_from_arrays(F.array(F.lit("tit2"), F.lit("©NAM"), F.lit("title")), F.array(F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise(""), F.when(k % 2 == 0, F.col("o_orderstatus")), F.lit("none"))), lambda _, v: v.isNotNull())
    return t.orders.select("o_orderkey", pick_field(frames, ["TIT2", "©nam", "title"]).alias("picked"))


@query(
    "unique_paths", "P26 M18 M19",
    """WITH r AS (SELECT p_partkey, p_brand, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part)
       SELECT p_partkey, p_brand || '/' || p_name || CASE WHEN n > 1 THEN '#' || cast(n AS VARCHAR) ELSE '' END AS path_id,
       p_name || CASE WHEN n > 1 THEN ' (' || cast(n AS VARCHAR) || ')' ELSE '' END || '.bin' AS file, p_name || '.bin' AS first_name FROM r""",
)
def unique_paths(t):
    from catalune.operators.edits import first_name, numbered

    d = numbered(t.part, ["p_brand", "p_name"], ["p_partkey"], "n")
    file = F.concat("p_name", F.when(F.col("n") > 1, F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise(""), F.lit(".bin"))
    return d.select("p_partkey", F.concat("p_brand", F.lit("/"), "p_name", F.when(F.col("n") > 1, F.concat(F.lit("#"), F.col("n").cast("string"))).otherwise("")).alias("path_id"), file.alias("file"), first_name(file).alias("first_name"))


@query(
    "grid_maths", "P27",
    """WITH g AS (SELECT event_id, value AS t, 60 + event_id % 120 AS bpm FROM events), p AS (SELECT *, 60.0 / bpm AS p FROM g),
       f AS (SELECT *, t - floor(t / p) * p AS beat0 FROM p)
       SELECT event_id, round(beat0, 6) AS beat0, cast(floor((t - beat0) / p + 0.5) AS BIGINT) % 4 AS bar,
       cast(ceil((t + 30.0 - beat0) / p) - ceil((t + 0.01 - beat0) / p) AS BIGINT) AS beats FROM f""",
)
def grid_maths(t):
    d = t.events.select("event_id", F.col("value").alias("t"), (60 + F.col("event_id") % 120).alias("bpm"))
    p = 60.0 / F.col("bpm")
    d = d.withColumn("beat0", F.col("t") - F.floor(F.col("t") / p) * p)
    bar = F.floor((F.col("t") - F.col("beat0")) / p + 0.5).cast("long") % 4
    return d.select("event_id", F.round("beat0", 6).alias("beat0"), bar.alias("bar"), M.beats_between(F.col("beat0"), F.col("bpm"), F.col("t") + 0.01, F.col("t") + 30.0).alias("beats"))


@query(
    "tap_tempo", "P27",
    """WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
       SELECT user_id, count(*) AS taps, CASE WHEN count(*) >= 4 AND avg(gap) > 0 THEN round(6e13 / avg(gap), 6) END AS per_million_minutes FROM g GROUP BY user_id""",
)
def tap_tempo(t):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    d = t.events.select("user_id", (us - F.lag(us).over(w)).alias("gap"))
    avg = F.avg("gap")
    return d.groupBy("user_id").agg(F.count("*").alias("taps"), F.when((F.count("*") >= 4) & (avg > 0), F.round(6e13 / avg, 6)).alias("per_million_minutes"))


@query(
    "date_helpers", "P28 F9",
    """SELECT o_orderkey, date_diff('day', DATE '1995-06-17', cast(o_orderdate AS DATE)) AS days_until,
       cast(o_orderdate AS DATE) + 1 <= TIMESTAMP '1995-06-17 12:00:00' AS past,
       (o_orderstatus = 'O' AND o_totalprice < 100000 AND date_diff('day', DATE '1995-06-17', cast(o_orderdate AS DATE)) BETWEEN 0 AND 400) AS needs
       FROM orders""",
)
def date_helpers(t):
    from catalune.functions.dates import days_until, is_past, needs_music

    now = F.lit("1995-06-17 12:00:00").cast("timestamp_ntz")
    day = F.to_date("o_orderdate")
    needs = needs_music(F.col("o_orderstatus") == "O", F.when(F.col("o_totalprice") < 100000, 0).otherwise(1), F.lit(400), days_until(day, now))
    return t.orders.select("o_orderkey", days_until(day, now).cast("long").alias("days_until"), is_past(day, F.lit(None).cast("timestamp_ntz"), now).alias("past"), needs.alias("needs"))


@query(
    "month_grid", "P29",
    """WITH m AS (SELECT unnest(range(1, 13)) AS month), s AS (SELECT month, make_date(1996, cast(month AS INTEGER), 1) AS first FROM m),
       w AS (SELECT month, first, first - (isodow(first) - 1)::INTEGER AS monday, unnest(range(0, 6)) AS week FROM s)
       SELECT month, week, cast(monday + (week * 7)::INTEGER AS DATE) AS monday FROM w WHERE week < 4 OR month(monday + (week * 7)::INTEGER) = month""",
)
def month_grid(t):
    from catalune.functions.dates import month_weeks

    months = t.spark.range(1, 13).withColumnRenamed("id", "month")
    return months.select("month", F.posexplode(month_weeks(F.make_date(F.lit(1996), F.col("month").cast("int"), F.lit(1)))).alias("week", "monday")).withColumn("week", F.col("week").cast("long"))


@query(
    "human_formats", "P30",
    """SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN printf('%.0f B', o_totalprice) WHEN o_totalprice < 1e6 THEN printf('%.1f kB', floor(o_totalprice / 100 + 0.5) / 10) ELSE printf('%.1f MB', floor(o_totalprice / 1e5 + 0.5) / 10) END AS bytes,
       cast(cast(floor(o_totalprice / 3600) AS BIGINT) AS VARCHAR) || ':' || lpad(cast(cast(floor(o_totalprice / 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ':' || lpad(cast(cast(floor(o_totalprice) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock
       FROM orders""",
)
def human_formats(t):
    from catalune.functions.dates import byte_text, clock_text

    return t.orders.select("o_orderkey", byte_text(F.col("o_totalprice")).alias("bytes"), clock_text(F.col("o_totalprice")).alias("clock"))


@query(
    "prng_stream", "P31",
    """WITH a AS (SELECT s AS seed, n, (s + n * 1831565813) % 4294967296 AS a FROM range(0, 50) x(s), range(1, 21) y(n)),
       b AS (SELECT *, xor(a, a >> 15) AS x, a | 1 AS y FROM a),
       c AS (SELECT *, ((((x >> 16) * y) % 4294967296) * 65536 + (x & 65535) * y) % 4294967296 AS t FROM b),
       d AS (SELECT *, xor(t, t >> 7) AS x2, t | 61 AS y2 FROM c),
       e AS (SELECT *, xor(t, (t + ((((x2 >> 16) * y2) % 4294967296) * 65536 + (x2 & 65535) * y2) % 4294967296) % 4294967296) AS u FROM d)
       SELECT seed, n, xor(u, u >> 14) / 4294967296.0 AS r FROM e""",
)
def prng_stream(t):
    d = t.spark.range(0, 50).select(F.col("id").alias("seed"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("n"))
    d = d.withColumn("n", F.col("n").cast("long"))
    return d.select("seed", "n", M.prng(F.col("seed"), F.col("n")).alias("r"))


@query("text_digest", "P32", "SELECT doc_id, sha256(text) AS digest, cast(length(text) AS BIGINT) AS n FROM documents")
def text_digest(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("n"))


@query(
    "json_paths", "P33 M9",
    """SELECT event_id, cast(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN cast(json_extract(props, '$.k') AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS parity,
       '{"k":' || cast(json_extract(props, '$.k') AS VARCHAR) || ',"user":' || cast(user_id AS VARCHAR) || '}' AS set_at FROM events""",
)
def json_paths(t):
    from catalune.operators.edits import set_key

    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("event_id", k.alias("k"), F.when(k % 2 == 0, "even").otherwise("odd").alias("parity"), set_key(F.col("props"), "user", F.col("user_id").cast("string")).alias("set_at"))


@query(
    "deep_equality", "P34",
    """SELECT event_id, cast(json_extract(props, '$.k') AS BIGINT) % 3 = 0 AS same FROM events""",
)
def deep_equality(t):
    from catalune.operators.edits import same_json

    k = F.get_json_object("props", "$.k").cast("long")
    a = F.format_string('{"a":1,"k":%d}', k)
    b = F.when(k % 3 == 0, F.format_string('{"k":%d, "a":1}', k)).otherwise(F.format_string('{"k":%d,"a":2}', k))
    return t.events.select("event_id", same_json(a, b).alias("same"))


@query(
    "safe_names", "S21 W12",
    r"""WITH n AS (SELECT page_id, coalesce(nullif(rtrim(trim(regexp_replace(regexp_replace(url, '[\\/:*?"<>|]', '_', 'g'), '\s+', ' ', 'g')), '. '), ''), 'Untitled') AS n FROM pages), e AS (SELECT *, regexp_extract(n, '.(\.[^.]{0,7})$', 1) AS ext FROM n)
       SELECT page_id, CASE WHEN length(n) > 120 THEN rtrim(substr(n, 1, 120 - length(ext)), '. ') || ext ELSE n END AS name FROM e""",
)
def safe_names(t):
    return t.pages.select("page_id", X.safe_name(F.col("url")).alias("name"))
