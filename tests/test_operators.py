"""Operators on small rows: ties, nulls, both directions, identities."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalune.functions import music as M
from catalune.functions import text as X
from catalune.operators import changes as C
from catalune.operators import duplicates as D
from catalune.operators import edits, facets, graphs, matching, signals, views
from catalune.operators.linked import merge_order, synced
from catalune.operators.making import Numbers, fill_slots
from catalune.plans.listing import global_position
from catalune.streaming.queue import EMPTY, step


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "want"), [("Café & Bär", "cafe bar"), ("A and B", "a b"), ("Привет, мир!", "привет мир"), ("東京 (live)", "東京 live"), (None, ""), ("Sand", "sand")])
def test_fold(spark, name, want):
    assert one(spark, X.fold(F.lit(name))) == want


@pytest.mark.parametrize(("name", "want"), [("Song (Album Version)", "song"), ("Song (Live at Town)", "song live at town"), ("Song [CAT 1] feat. X (Remix)", "song"), ("[all]", "all"), ("Song (Numa Crew)", "song numa crew"), ("Feather", "feather")])
def test_song_name(spark, name, want):
    assert one(spark, X.song_name(F.lit(name))) == want


@pytest.mark.parametrize(("title", "album", "want"), [("Song (Extended Mix)", "", "extended"), ("Song - Radio Edit", "", "edit"), ("Clean Bandit", "", ""), ("Song", "Live in Rome", "live"), ("Song (Dub) [Remix]", "", "dub,remix")])
def test_version(spark, title, album, want):
    assert one(spark, X.version(F.lit(title), F.lit(album))) == want


def test_tags(spark):
    assert one(spark, X.found_tags(F.lit("House; Deep | house"), F.lit("/* Warm / Peak */ say #Vocal not a#b"))) == ["House", "Deep", "Warm", "Peak", "Vocal"]
    assert one(spark, X.remove_tags(F.array(F.lit("A"), F.lit("b")), F.array(F.lit("#a")))) == ["b"]


def test_prng_in_sql_and_python(spark):
    for seed in (0, 1, 42, 4294967295):
        n = Numbers(seed)
        want = [n() for _ in range(5)]
        got = spark.range(1, 6).select(M.prng(F.lit(seed).cast("long"), F.col("id")).alias("r")).collect()
        assert [r["r"] for r in got] == want


def test_sort_turns_everything_round(spark):
    d = spark.createDataFrame([(1, 2.0), (2, None), (3, 2.0), (4, 1.0)], "id int, k double")
    up = [r["id"] for r in views.keyed_sort(d, F.col("k"), "id").collect()]
    assert up == [4, 1, 3, 2]
    assert [r["id"] for r in views.keyed_sort(d, F.col("k"), "id", down=True).collect()] == up[::-1]


def test_facet_items_spelling_and_various(spark):
    d = spark.createDataFrame([("one", "A", 1.0), ("One", "B", 2.0), ("ONE ", "C", None), (None, "A", 1.0)], "v string, a string, s double")
    got = {r["key"]: r for r in facets.facet_items(d, F.col("v"), "s", F.col("a")).collect()}
    assert got["one"]["value"] == "ONE" and got["one"]["sub"] == "Various artists" and got["one"]["tracks"] == 3 and got[""]["tracks"] == 1


def test_counts_except_keeps_ticked(spark):
    d = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "p string, q string")
    got = {(r["facet"], r["value"]): r["n"] for r in views.counts_except(d, {"p": ["a", "zz"], "q": ["x"]}).collect()}
    assert got == {("p", "a"): 1, ("p", "b"): 1, ("p", "zz"): 0, ("q", "x"): 1}


def test_tree_walk_leaves_cycles_out(spark):
    d = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("d", "gone")], "id string, parent string")
    got = {r["id"]: r["depth"] for r in graphs.tree_walk(d, "id", "parent", F.col("id")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 0}


def test_linked_order_keeps_broken_chains(spark):
    d = spark.createDataFrame([(1, 10, 30), (1, 20, None), (1, 30, 20), (1, 41, 42), (1, 42, 41)], "c int, id int, nxt int")
    got = sorted(graphs.linked_order(d, "c", "id", "nxt").collect(), key=lambda r: r["pos"])
    assert [r["id"] for r in got] == [10, 30, 20, 41, 42]


def test_components_against_union_find(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = graphs.components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()
    assert {r["node"]: r["label"] for r in got} == {x: find(x) for x in linked}


def test_components_of_nothing(spark):
    assert graphs.components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def _rows(df):
    return {r["k"]: (r["v"] if r["there"] else None) for r in df.collect() if r["there"]}


def test_merge3_identities(spark):
    f = lambda d: spark.createDataFrame(list(d.items()), "k int, v string")
    b, x = {1: "a", 2: "b", 3: None}, {1: "a", 2: "c", 4: "d"}
    for base, local, remote in ((b, x, b), (b, b, x), (b, x, x)):
        m = C.merge3(f(base), f(local), f(remote), ["k"], ["v"])
        assert _rows(m) == x and all(not r["clashes"] for r in m.collect())


def test_merge3_clashes(spark):
    f = lambda d: spark.createDataFrame(list(d.items()), "k int, v string")
    m = {r["k"]: r for r in C.merge3(f({1: "a", 2: "b", 3: "c"}), f({1: "x", 2: "y"}), f({1: "z", 3: "w"}), ["k"], ["v"]).collect()}
    assert (m[1]["v"], m[1]["clashes"]) == ("z", ["v"])
    assert (m[2]["there"], m[2]["clashes"]) == (False, ["*"]) and (m[3]["there"], m[3]["v"], m[3]["clashes"]) == (True, "w", ["*"])


def test_diff_then_fold_is_identity(spark):
    f = lambda rows: spark.createDataFrame(rows, "k int, v string")
    a, b = f([(1, "a"), (2, None), (3, "c")]), f([(2, "x"), (3, "c"), (4, None)])
    log = C.diff(a, b, ["k"], ["v"]).withColumn("rev", F.lit(1))
    assert sorted(C.fold_log(a, log, ["k"], ["v"], "rev").collect()) == sorted(b.collect())


def test_incremental_votes_equal_full(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(32) for _ in range(30)]
    fps = [(i, [w ^ (1 << rnd.randrange(32)) if rnd.random() < 0.2 else w for w in (base if i % 2 else base[3:])]) for i in range(8)] + [(9, [rnd.getrandbits(32) for _ in range(30)])]
    d = spark.createDataFrame(fps, "id int, words array<bigint>")
    p = D.pieces(d, "id", "words")
    full = {tuple(r) for r in D.votes(p).collect()}
    fresh = {tuple(r) for r in D.votes(p, spark.createDataFrame([(1,), (4,)], "id int")).collect()}
    assert fresh == {r for r in full if {r[0], r[1]} & {1, 4}} and fresh
    got = D.confirmed(D.votes(p), d, "id", "words", least_words=10).collect()
    assert {(r["a"], r["b"]) for r in got} >= {(1, 3), (2, 4)} and all(9 not in (r["a"], r["b"]) for r in got)


def test_name_groups_chain(spark):
    d = spark.createDataFrame([(1, "k", 10.0), (2, "k", 13.0), (3, "k", 16.0), (4, "k", 30.0), (5, "j", None), (6, "j", 99.0)], "id int, k string, d double")
    assert {r["id"]: r["group"] for r in D.name_groups(d, "id", ["k"], "d").collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}


def test_suffix_match_needs_one_winner(spark):
    t = spark.createDataFrame([(1, "C:\\m\\a\\x.mp3", 5), (2, "q/x.mp3", 0)], "t int, p string, s int")
    f = spark.createDataFrame([(1, "a/x.mp3", 5), (2, "b/x.mp3", 6)], "f int, fp string, fs int")
    assert [(r["t"], r["f"], r["score"]) for r in matching.longest_suffix(t, f, "t", "p", "f", "fp", "s", "fs").collect()] == [(1, 1, 2)]


def test_asof_and_band(spark):
    l = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")  # noqa: E741
    r = spark.createDataFrame([(1, 2, "a"), (1, 5, "b")], "k int, u int, v string")
    assert sorted((x["k"], x["t"], x["v"]) for x in matching.asof_join(l, r, ["k"], "t", "u", ["v"]).collect()) == [(1, 1, None), (1, 5, "b"), (2, 9, None)]
    assert sorted((x["t"], x["u"]) for x in matching.band_join(l, r.drop("k"), "t", "u", 3).collect()) == [(1, 2), (5, 2), (5, 5)]


def test_no_cartesian_product(spark):
    l, r = spark.range(5).withColumnRenamed("id", "a"), spark.range(5).withColumnRenamed("id", "b")  # noqa: E741
    plan = matching.band_join(l, r, "a", "b", 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filters_reach_the_scan(spark):
    d = views.facet_filter(spark.read.parquet("/root/testdata/sf0.001/part.parquet"), {"p_brand": ["Brand#12"]}).select("p_partkey")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_brand), EqualTo(p_brand,Brand#12)]" in plan and "p_retailprice" not in plan.split("ReadSchema")[1]


def test_global_position(spark):
    d = spark.range(200).select((F.col("id") * 7919 % 1000).alias("v"), "id")
    got = sorted(global_position(d, [F.col("v"), F.col("id")], "n").collect(), key=lambda r: r["n"])
    assert [r["n"] for r in got] == list(range(1, 201)) and [(r["v"], r["id"]) for r in got] == sorted((r["v"], r["id"]) for r in got)


def test_merge_order():
    assert merge_order(list("abcd"), list("dcba"), list("abd")) == list("dba")
    assert merge_order(list("abc"), list("abc"), list("abxc")) == list("abxc")
    assert merge_order(list("abc"), list("abc"), list("c"), hidden=frozenset("a")) == list("ac")


def test_synced_states(spark):
    have = spark.createDataFrame([(1, "e1", "/A", "A"), (2, "e2", "/B", "B"), (3, "e3", "/C", "C")], "id int, ext string, path string, name string")
    read = spark.createDataFrame([("e1", "/A2", "A2"), ("e9", "/B", "B"), ("e7", "/N", "N")], "ext string, path string, name string")
    assert {r["name"]: r["state"] for r in synced(have, read).collect()} == {"A2": "renamed", "B": "kept", "C": "held", "N": "new"}


def _pool(n=60, seed=42):
    r = random.Random(seed)
    return [{"id": i, "bpm": r.choice([None, 100.0 + r.randrange(60)]), "key": r.choice([None, (r.randrange(1, 13), r.random() < 0.5)]), "rating": r.choice([None, 1, 5]), "tags": r.sample(["a", "b", "c"], 2)} for i in range(n)]


@pytest.mark.parametrize("randomness", [0.0, 0.8])
def test_playlist_invariants(randomness):
    how = dict(count=20, start=110.0, end=140.0, tolerance=0.06, want=["a"], first=3, include=[7, 9], randomness=randomness, seed=9, strict=True)
    a, b = fill_slots(_pool(), **how), fill_slots(_pool(), **how)
    ids = [s["id"] for s in a]
    assert a == b and len(set(ids)) == len(ids) == 20 and ids[0] == 3 and {7, 9} <= set(ids)
    assert a[0]["target"] == 110 and a[-1]["target"] == 140
    assert fill_slots([], **how) == []


def test_queue_moves_and_goes_back():
    q = EMPTY
    for action, song in (("add", 1), ("add", 2), ("top", 2), ("advance", None), ("advance", None), ("back", None), ("drop", 2)):
        q = step(q, action, song)
    assert q == EMPTY | {"next": [1]} or q == EMPTY | {"rest": [1]}


def test_queue_from_a_list():
    q = step(EMPTY, "start", 3, songs=[1, 2, 3, 4, 5, 6])
    assert (q["current"], q["rest"], q["source"]) == (3, [4, 5, 6], [1, 2, 3, 4, 5, 6])
    q = step(q, "add", songs=[6, 9])
    q = step(q, "top", 8)
    assert q["next"] == [8, 6, 9] and q["rest"] == [4, 5]
    q = step(q, "add", songs=[9], at=1)
    assert q["next"] == [8, 9, 6]
    q = step(q, "later", songs=[6], at=1)
    assert q["next"] == [8, 9] and q["rest"] == [4, 6, 5]
    q = step(q, "advance", playable={9, 4, 5, 6})
    assert q["current"] == 9 and q["next"] == [] and q["played"] == [3]
    q = step(q, "jump", part="rest", at=1)
    assert (q["current"], q["rest"], q["played"]) == (6, [5], [3, 9])
    q = step(q, "back")
    assert (q["current"], q["rest"], q["played"]) == (9, [6, 5], [3])
    q = step(q, "clear", part="rest")
    q = step(q, "advance", repeat=True)
    assert (q["current"], q["rest"]) == (1, [2, 3, 4, 5, 6])
    mixed = step(q, "reshuffle", shuffle=5)
    assert sorted(mixed["rest"]) == [2, 3, 4, 5, 6] and step(mixed, "reshuffle")["rest"] == [2, 3, 4, 5, 6]
    q = step(q, "prune", songs=[2, 4, 9])
    assert q == {"current": None, "next": [], "rest": [2, 4], "source": [2, 4], "played": [9]}
    assert step(EMPTY, "advance")["current"] is None and step(EMPTY, "back") == EMPTY and step(EMPTY, "jump") == EMPTY


def test_memo_is_made_again_only_when_its_parts_move(spark):
    from catalune.plans.memo import Memo, Revisions

    rev = Revisions()
    memo, calls = Memo(rev), []
    build = lambda: calls.append(1) or spark.range(len(calls))
    assert memo.get("a", ["tracks"], build).count() == 1 and memo.get("a", ["tracks"], build).count() == 1
    rev.touch("lists")
    assert memo.get("a", ["tracks"], build).count() == 1 and memo.made == 1
    rev.touch("tracks", "lists")
    assert memo.get("a", ["tracks"], build).count() == 2


def test_folds(spark):
    from catalune.operators.folds import appended, batches, ordered_fold, pulled

    d = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("b", 1, 1), ("b", 2, 0), (None, 1, 0)], "k string, o int, base int")
    assert sorted(map(tuple, appended(d, "k", "o", "base").collect())) == [("a", 1, True, 1), ("a", 2, False, 1), ("a", 3, True, 2), ("b", 1, False, 0), ("b", 2, True, 1)]
    s = spark.createDataFrame([("a", i, n) for i, n in enumerate([4, 5, 3, 20, 1, None, 9])], "k string, o int, n int")
    assert [r["batch"] for r in batches(s, "k", "o", "n", 10).orderBy("o").collect()] == [0, 0, 1, 2, 3, 3, 3]
    assert ordered_fold(d, "k", "o", ["base"], 0, lambda q, b: (q + b, (q + b,)), "total long", last=True).orderBy("k").collect() == [("a", 1), ("b", 1)]
    log = spark.createDataFrame([("x", 5, "l5"), ("x", 8, "l8"), ("y", 6, "l6")], "k string, seq long, v string")
    snap = spark.createDataFrame([("x", "s"), ("z", "s")], "k string, v string")
    get = lambda cursor: sorted(map(tuple, pulled(snap, 4, log, cursor, "k", "seq", ["v"]).collect()))
    assert get(6) == [("x", 8, "l8")] and get(2) == [("x", 8, "l8"), ("y", 6, "l6"), ("z", 4, "s")]


def test_edits(spark):
    d = spark.createDataFrame([(1, ["x", "Y"], 1.0), (2, ["z"], None)], "id int, tags array<string>, rating double")
    assert [r["tags"] for r in edits.rename_tag(d, "y", "X").orderBy("id").collect()] == [["x"], ["z"]]
    assert [r["rating"] for r in edits.rate(d, F.col("id") == 2, 9).orderBy("id").collect()] == [1.0, 5.0]
    assert one(spark, edits.insert_at(F.array(*map(F.lit, "abc")), F.array(F.lit("c")), F.lit(1))) == ["a", "c", "b"]


def test_tempo_and_key_of_a_tone(spark):
    d = signals.tones(spark.createDataFrame([(1, 440.0, 120.0), (2, 261.63, 100.0)], "id int, hz double, bpm double"))
    got = {r["id"]: r for r in signals.analysed(d).collect()}
    assert abs(got[1]["bpm"] - 120) < 3 and abs(got[1]["peak_hz"] - 440) < 10
    empty = spark.createDataFrame([(1, 8000, []), (2, 8000, None)], "id int, rate int, pcm array<float>")
    assert all(r["bpm"] is None for r in signals.analysed(empty).collect())


def test_fingerprint_survives_noise():
    rng = np.random.default_rng(1)
    t = np.arange(8000 * 6) / 8000
    x = sum(np.sin(2 * np.pi * f * t * (1 + 0.1 * np.sin(t))) for f in (300, 500, 900)) + 0.1 * rng.normal(size=len(t))
    a, _ = signals.fingerprint(x, 8000)
    b, _ = signals.fingerprint(x + 0.05 * rng.normal(size=len(x)), 8000)
    c, _ = signals.fingerprint(rng.normal(size=len(x)), 8000)
    ber = lambda p, q: np.mean([bin(i ^ j).count("1") / 32 for i, j in zip(p, q, strict=True)])
    assert ber(a, b) < 0.3 < 0.4 < ber(a, c)


def _song(spark, rows):
    d = spark.createDataFrame(rows, "id int, title string, artist string, d double")
    name = X.song_name(F.col("title"))
    return d.select("id", F.struct(name.alias("title"), F.replace(name, F.lit(" "), F.lit("")).alias("joined"), X.words(name).alias("words"), F.lit("").alias("file"), X.song_name(F.col("artist")).alias("artist"), X.artists(F.col("artist")).alias("artists"), X.words(X.song_name(F.col("artist"))).alias("artist_words"), F.lit("").alias("album"), X.version(F.col("title")).alias("version"), F.col("d").alias("duration"), F.lit(0).alias("size")).alias("s"))


def test_relink_scores(spark):
    old = _song(spark, [(1, "Blue River", "A & B", 200.0), (2, "Ruff House", "C", None), (3, "Alone", "D", 100.0)]).withColumnRenamed("id", "o").withColumnRenamed("s", "so")
    new = _song(spark, [(10, "Blue River", "B, A", 201.0), (11, "Blue River (Remix)", "A", 200.0), (12, "Ruffhouse", "C", 90.0), (13, "Blue Table", "Z", 200.0), (14, "River Blue", "A", 300.0)]).withColumnRenamed("id", "c").withColumnRenamed("s", "sc")
    joined = lambda c: F.nullif(F.col(c), F.lit(""))
    both = matching.blocked_pairs(old, new, "o", F.col("so.words"), "c", F.col("sc.words"), [joined("so.joined")], [joined("sc.joined")])
    f = old.schema["so"].dataType.names
    got = {(r["o"], r["c"]): r["x"] for r in both.select("o", "c", matching.relink_score({k: F.col(f"so.{k}") for k in f}, {k: F.col(f"sc.{k}") for k in f}).alias("x")).collect()}
    # title 45, artist 25 or 15, length 20, 6 if unknown, -50 if far; another version 40 at most; other titles 0
    assert got[1, 10] == 90 and got[1, 11] == 40 and got[2, 12] == 76 and got.get((1, 13), 0) == 0 and got.get((1, 14), 0) == 0
    assert not any(o == 3 for o, _ in got)
    top = matching.best_matches(spark.createDataFrame([(1, 10, 90), (1, 11, 88), (1, 12, 60), (1, 13, 55), (2, 10, 49)], "o int, c int, x int"), "o", "c", "x").collect()
    assert sorted((r["c"], r["x"], r["rank"]) for r in top) == [(10, 80, 1), (11, 88, 2), (12, 60, 3)]


def test_trees_hold_all_customers(spark):
    from catalune.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    at = lambda name: spark.read.parquet(f"{sf}/{name}.parquet").collect()
    up = {f"r{r['r_regionkey']}": (None, r["r_name"]) for r in at("region")} | {f"n{r['n_nationkey']}": (f"r{r['n_regionkey']}", r["n_name"]) for r in at("nation")}
    up |= {f"c{r['c_custkey']}": (f"n{r['c_nationkey']}", r["c_name"]) for r in at("customer")}
    assert len(up) > 1000
    chain = lambda x: [x, *(chain(up[x][0]) if up[x][0] else [])]
    loop = {("x1", "x1"), ("x1", "x2"), ("x2", "x1"), ("x2", "x2")}
    pairs = {(a, x) for x in up for a in chain(x)} | loop
    got = lambda name: [tuple(r) for r in QUERIES[name](spark, sf).collect()]
    assert sorted((i, d) for i, d, _ in got("tree_walk")) == sorted((x, len(chain(x)) - 1) for x in up)
    assert dict(got("ancestor_paths")) == {x: " / ".join(up[a][1] for a in reversed(chain(x))) for x in up}
    assert sorted(got("descendants")) == sorted((x,) for a, x in pairs if a == "r2")
    assert dict(got("descendant_counts")) == {a: sum(b == a for b, _ in pairs) for a in {a for a, _ in pairs}}
    assert {(i, m): r for i, m, r in got("cycle_refusal")} == {(i, m): (i, m) in pairs for i, m in (("r0", "n0"), ("n3", "r0"), ("n0", "n0"), ("r1", "r0"))}
    assert sorted(got("mirror_selection")) == sorted({(x,) for a, x in pairs if a in ("n4", "n9")} | {(a,) for a, x in pairs if x in ("n4", "n9")})


def test_whole_queries_hold_all_rows(spark):
    from catalune.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    at = lambda name: spark.read.parquet(f"{sf}/{name}.parquet").collect()
    got = lambda name: QUERIES[name](spark, sf)
    orders, lines, parts = at("orders"), at("lineitem"), at("part")
    assert got("histogram_steps").agg(F.sum("n")).first()[0] == sum(r["o_totalprice"] > 0 for r in orders)
    assert got("download_plan").count() == len(lines)
    songs = {r["p_partkey"] for r in parts}
    own = {(r["l_orderkey"], r["l_partkey"]) for r in lines if r["l_partkey"] in songs}
    assert {(r["record"], r["song"]) for r in got("record_pool").collect()} == own | {(None, p) for p in songs - {s for _, s in own}}
    label = {}
    for r in orders:
        if r["o_custkey"] > 7:
            a, b = (label.setdefault(x, x) for x in (r["o_custkey"], r["o_custkey"] - 7))
            label = {x: min(a, b) if y in (a, b) else y for x, y in label.items()}
    assert dict(map(tuple, got("components").collect())) == label


@pytest.mark.parametrize("how", [{}, {"randomness": 0.7, "seed": 42}, {"include": [5999, 3], "strict": True}])
def test_playlists_score_all_candidates(spark, how):
    from catalune.operators.making import playlists

    # 6,000 candidates: the best of the first slots have no rating and come last by rating
    rows = [(i, "g", 20.0 + i % 7 if i % 50 else 100.0, 8 if i < 5900 else 3, True, None if i >= 5900 else 5 - i % 2, ["blue"] if i >= 5900 else ["x"], i) for i in range(6000)]
    d = spark.createDataFrame(rows, "id long, g string, bpm double, n int, minor boolean, rating int, tags array<string>, o long")
    how = {"count": 12, "start": 20.0, "end": 40.0, "tolerance": 0.1, "want": ["blue"]} | how
    got = [(r["slot"], r["id"]) for r in playlists(d, "g", "id", "bpm", "n", "minor", "rating", "tags", "o", **how).orderBy("slot").collect()]
    pool = [{"id": i, "bpm": bpm, "key": (n, minor), "rating": rating, "tags": tags} for i, _, bpm, n, minor, rating, tags, _ in rows]
    assert got == [(r["slot"], r["id"]) for r in fill_slots(pool, **how)] and (how.get("randomness") or any(i >= 5900 for _, i in got))


def test_playlists_without_want(spark):
    from catalune.operators.making import playlists

    d = spark.createDataFrame([(i, "g", 20.0, 8, True, 1, ["x"], i) for i in range(40)], "id long, g string, bpm double, n int, minor boolean, rating int, tags array<string>, o long")
    assert [r["id"] for r in playlists(d, "g", "id", "bpm", "n", "minor", "rating", "tags", "o", count=3, start=None, end=None, tolerance=0.1).orderBy("slot").collect()] == [0, 1, 2]


def test_no_query_stands_for_what_is_left_out():
    from catalune.queries import OPERATORS

    assert OPERATORS["spectrum_peaks"] == "D1 D2" and not {"S20", "M35", "D15"} & {x for ops in OPERATORS.values() for x in ops.split()}


@pytest.mark.parametrize("name,want", [("con", "_con"), ("COM1.txt", "_COM1.txt"), ("a/b:c", "a_b_c"), ("  x . ", "x"), ("", "Untitled"), ("...", "Untitled"), ("y" * 130 + ".flac", "y" * 115 + ".flac"), ("z" * 130, "z" * 120), ("a" * 118 + " b.longextension", "a" * 118 + " b"), (None, "Untitled")])
def test_safe_names(spark, name, want):
    assert one(spark, X.safe_name(F.lit(name).cast("string"))) == want


def _largest_join(df):
    """Rows that the largest join of a query puts out, after it ran."""
    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        kids = [walk(p.children().apply(i)) for i in range(p.children().size())]
        own = p.metrics().get("numOutputRows").get().value() if "Join" in name else 0
        return max([own, *kids])

    return walk(df._jdf.queryExecution().executedPlan())


def _parts(tmp_path, spark, rows):
    d = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    d.write.parquet(f"{tmp_path}/part.parquet")
    return d


def _duckdb_rows(tmp_path, name):
    import duckdb

    from catalune.queries import ORACLE

    c = duckdb.connect()
    c.sql(f"create view part as from '{tmp_path}/part.parquet/*.parquet'")
    got = c.execute(ORACLE[name])
    return [d[0] for d in got.description], sorted(got.fetchall())


def test_relink_scores_equal_songs_once(spark, tmp_path):
    from catalune.queries import QUERIES

    # 40 copies of 200 parts, some of them unlike their copies, and names that are null, empty, or no word's
    rows = [(k * 200 + r["p_partkey"], r["p_name"], r["p_brand"], r["p_type"], (r["p_size"] + k) if r["p_partkey"] % 7 == 0 else r["p_size"], r["p_retailprice"]) for k in range(40) for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()]
    rows += [(9000 + i, n, "Brand#1", "LARGE", i % 4, 1.0) for i, n in enumerate(["a b", "ab", "red ring rod", "redring", "red ring"] * 8)]
    _parts(tmp_path, spark, rows)
    df = QUERIES["relink_scored"](spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.collect())
    cols, want = _duckdb_rows(tmp_path, "relink_scored")
    assert df.columns == cols and got == want and len(got) > 700
    assert _largest_join(df) < 3_000 and "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_similar_pairs_of_equal_rows(spark, tmp_path):
    from catalune.operators import matching
    from catalune.queries import QUERIES

    nan = float("nan")
    odd = [0.0, -0.0, 5.0, 10.0, 10.5, -3.0, None, nan, 166.0, 176.5, 177.0, 1e300, float("inf"), 940.0, 1000.0]
    rows = [(i, "x" if i % 3 else "y", "b", "t" if i % 5 else None, 1, odd[i % 15]) for i in range(400)] + [(i, "hot", "b", "t", 1, 900.0 + 40 * (i % 3)) for i in range(1000, 1600)]
    rows += [(7, "x", "b", "t", 1, 5.0), (7, "x", "b", "t", 1, 10.0), (None, "x", "b", "t", 1, 5.0), (9, None, "b", "t", 1, 5.0)]
    d = _parts(tmp_path, spark, rows)
    df = QUERIES["similar_length"](spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.collect())
    cols, want = _duckdb_rows(tmp_path, "similar_length")
    assert df.columns == cols and got == want
    assert _largest_join(df) < 2_000 < len(got)  # of pairs of rows, 180,000 are those of one name alone
    small = matching.BLOCK
    try:
        matching.BLOCK = 7
        assert sorted(tuple(r) for r in matching.similar_pairs(d, "p_partkey", ["p_name", "p_type"], "p_retailprice").collect()) == want
    finally:
        matching.BLOCK = small
