import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalune.llm import fmindex as F8
from catalune.llm.common import Scratch

RX = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def brute(items, text, size=13):
    w, hit, found = RX.findall(lower(text)), set(), set()
    for i, t in items:
        v = RX.findall(lower(t))
        for k in range(max(1, len(v) - size + 1) if v else 0):
            x = v[k : k + size]
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit |= set(range(p, p + len(x)))
                    found.add(i)
    return len(w), sorted(hit), found


@pytest.mark.parametrize("seed", range(40))
def test_against_brute_force(seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(F8, "SHARD", rnd.choice([5, 50, 10**6]))
    words = ["a", "b", "é", "c1", "d"]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randrange(9)))) for i in range(rnd.randrange(6))] + [(77, None)]
    docs = ["!".join(rnd.choices([*words, "A", "zz"], k=rnd.randrange(60))) for _ in range(6)] + [" ".join([rnd.choice(items)[1] or "q"] * 5), ""]
    size = rnd.choice([3, 4, 13])
    got = F8.Windows(items, size).hits([d.encode() for d in docs])
    assert [(n, p.tolist(), i) for n, p, i in got] == [brute(items, d, size) for d in docs]


def test_search_and_locate():
    text = np.array([1, 2, 1, 2, 3, 0, 2, 1, 2, 0], np.int32)
    x = F8.FMIndex(text)
    lo, hi = x.search(np.array([[1, 2], [2, 3], [3, 1]]), np.array([2, 2, 2]))
    assert (hi - lo).tolist() == [3, 1, 0] and sorted(x.locate(np.arange(lo[0], hi[0])).tolist()) == [0, 2, 7]


def test_spans():
    assert F8.spans_of(np.array([1, 2, 3, 7, 9, 10])) == [[1, 4], [7, 8], [9, 11]] and F8.spans_of(np.array([])) == []


def test_documents(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    for block in (F8.BLOCK, 3000):
        got = {r["doc_id"]: r for r in F8.contamination(docs, bench, block=block).collect()}
        hits = 0
        for r in docs.collect():
            n, hit, found = brute(items, r["text"]) if len(r["text"]) < 6000 else (got[r["doc_id"]]["n_words"], None, None)
            x = got[r["doc_id"]]
            if hit is not None:
                hits += bool(hit)
                sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
                assert (x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) == (n, len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= n)
        assert hits
    clean = F8.drop_contaminated(docs, bench)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, x in got.items() if not x["contaminated"]} and clean.columns == docs.columns


def test_odd_documents(spark, odd):
    bench = spark.createDataFrame([(1, "no id here"), (2, None), (3, "!!"), (4, "no id here"), (None, "word")], "item_id int, text string")
    got = F8.contamination(odd, bench).collect()
    assert len(got) == 13 and [r["n_items"] for r in got if r["doc_id"] is None and r["n_words"]] == [2]
    assert F8.drop_contaminated(odd, bench).columns == odd.columns
    assert F8.contamination(odd.limit(0), bench).count() == 0 and F8.contamination(odd, bench.limit(0)).where("contaminated").count() == 0


def test_long_items_and_many_blocks(spark, monkeypatch):
    """An item of more windows than a piece, and blocks of a few words: nothing is lost at the cuts."""
    monkeypatch.setattr(F8, "PIECE", 5)
    rnd = random.Random(8)
    long = [f"w{rnd.randrange(40)}" for _ in range(400)]
    items = [("long", " ".join(long)), ("long", "once more another text of the same item in thirteen words or more here"), (None, "three plain words"), ("s", "only two")]
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("item", F.lit("own"))
    texts = [" ".join(long[i : i + 13 + i % 9]) for i in range(0, 380, 7)] + [" ".join(long), "three plain words and only two", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for block in (F8.BLOCK, 200):
        got = F8.contamination(d, bench, block=block).orderBy("doc_id").collect()
        for r, t in zip(got, texts, strict=True):
            n, hit, found = brute(items, t)
            assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, len(hit), len(found - {None}))
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found - {None})).encode()).hexdigest()
    assert len(F8.blocks_of(bench, 13, "item_id", "text", 200, Scratch(spark, "t"))) > 5


@pytest.mark.parametrize("common", ["q", "w1"])
def test_memory_of_a_shard(common, monkeypatch):
    """Neither the words of all documents together nor the runs of a frequent word are held: a part of the texts' size does."""
    import tracemalloc

    monkeypatch.setattr(F8, "SHARD", 10_000)
    w = F8.Windows([("one", "w1"), ("long", " ".join(f"v{i}" for i in range(20)))])
    docs = [(f"u{d} {common} " * 1000).encode() for d in range(300)]
    tracemalloc.start()
    got = w.hits(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(n, len(p), i) for n, p, i in got] == [(2000, 1000, {"one"}) if common == "w1" else (2000, 0, set())] * 300
    # a hit word's place takes 8 bytes, twice while they are united
    assert peak < sum(map(len, docs)) + 16 * sum(len(p) for _, p, _ in got)
