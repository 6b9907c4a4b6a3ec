import random

import numpy as np
import pytest
import xxhash

from catalune.llm import simhash as S
from catalune.llm.common import Scratch, connected_components


def slow(text, k=3):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, d=2):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", " \n", "a", "a b", "A b C", "a b c d a b c d", "é è\x0b ö  x\u00a0y z\x1cq r", "w " * 1000])
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == slow(text)


@pytest.mark.parametrize("cap", [1, 2, 7, 1024])
def test_links_connect_all_near_pairs(spark, cap):
    rnd = random.Random(cap)
    centres = [rnd.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    fps = list({c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(5))) for c in centres for _ in range(12)})
    d = spark.createDataFrame([(S.signed(f),) for f in fps], "fp long")
    scratch = Scratch(spark, "t")
    links = S.near_links(d, scratch, cap=cap)
    pairs = {(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in links.collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    label = {r["node"]: r["label"] for r in connected_components(links, scratch).collect()}
    want = classes(fps)
    got = [label.get(S.signed(f), S.signed(f)) for f in fps]
    assert len({*zip(got, want, strict=True)}) == len(set(got)) == len(set(want))


def test_documents(spark, docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    fps = [slow(t) for _, t in rows]
    want = {(rows[i][0], f"{fps[i]:016x}", rows[c][0]) for i, c in enumerate(classes(fps))}
    assert {tuple(r) for r in S.components(docs).collect()} == want
    kept = S.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for *_, c in want})


def test_odd_documents(spark, odd):
    got = [tuple(r) for r in S.components(odd).collect()]
    assert len(got) == 13 and {c for d, f, c in got if f == "0" * 16} == {3}
    assert {c for d, _, c in got if d in (1, 2)} == {1}
    kept = S.keep_first(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids.count("1") == 1 and "2" not in ids and ids.count("9") == 2 and "None" in ids and "4" not in ids
    assert S.components(odd.limit(0)).count() == 0 and S.keep_first(odd.limit(0)).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(60)]
    rnd.shuffle(edges)
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r["node"]: r["label"] for r in got} == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert np.array_equal(sorted({r["node"] for r in got}), sorted(r["node"] for r in got))
