"""Quality, toxicity, language and rules: held-out accuracy, and odd input."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalune.llm import crf, isoforest, langzip, nbsvm


def test_nbsvm_learns(spark):
    rnd = random.Random(1)
    good = [" ".join(rnd.choices(["alpha", "beta", "gamma", "delta"], k=30)) for _ in range(60)]
    bad = [" ".join(w + "%%" for w in rnd.choices(["alpha", "beta", "gamma", "delta"], k=30)) for _ in range(30)] + [" ".join([rnd.choice("abcd") * 3] * 20) for _ in range(30)]
    mark = np.zeros(nbsvm.DIM, np.uint8)
    x = [nbsvm.features(t.encode(), mark) for t in good + bad]
    y = [1] * 60 + [0] * 60
    m = nbsvm.fit(x[::2], y[::2])
    got = [m.score(v) >= 0.5 for v in x[1::2]]
    assert not mark.any() and np.mean(np.array(got) == np.array(y[1::2])) > 0.95
    assert nbsvm.fit([], []).score(x[0]) == 0.5 and nbsvm.fit(x[:3], [1, 1, 1]).score(x[0]) == 1.0


def test_quality_held_out(spark, docs, labels):
    got = nbsvm.quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() >= 0.9


def test_quality_of_odd_documents(spark, odd, docs, labels):
    got = nbsvm.quality(odd, labels).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    m = nbsvm.train(docs, labels, __import__("pyspark.sql.functions", fromlist=["lit"]).lit(True))
    assert nbsvm.keep_good(odd, m).columns == odd.columns
    assert nbsvm.quality(odd.limit(0), labels).count() == 0 and nbsvm.quality(odd, labels.limit(0)).where("score = 0.5").count() == 13


def test_posterior_is_exact():
    rng = np.random.default_rng(2)
    for t in ([[2.0, -2.0], [1.0, -1.0]], [[0.0, 0.0], [0.0, 0.0]], [[3.0, -3.0], [-2.0, 2.5]]):
        m = crf.Field(t=np.array(t), start=-1.0)
        e, first = rng.normal(-1, 3, 4000), np.zeros(4000, bool)
        starts = [0, 1, 40, 2500, 3999]
        first[starts] = True
        want = []
        for a, z in zip(starts, [*starts[1:], 4000], strict=True):
            n = z - a
            x = np.stack([np.zeros(n), e[a:z]], 1)
            f, b = x.copy(), np.zeros((n, 2))
            f[0, 1] += m.start
            for i in range(1, n):
                f[i] = [np.logaddexp(*(f[i - 1] + m.t[:, s])) + x[i, s] for s in (0, 1)]
            for i in range(n - 2, -1, -1):
                b[i] = [np.logaddexp(*(m.t[s] + b[i + 1] + x[i + 1])) for s in (0, 1)]
            want.append(np.exp(f[:, 1] + b[:, 1] - np.logaddexp(*f[-1])))
        assert np.abs(np.concatenate(want) - crf.posterior(e, first, m)).max() < 1e-8
    assert len(crf.posterior(np.empty(0), np.empty(0, bool), m)) == 0


def test_toxicity_finds_words():
    rnd = random.Random(4)
    base = ["stone", "river", "paper", "green", "window", "table"]
    texts, y = [], []
    for i in range(240):
        w = rnd.choices(base, k=60)
        if i % 3 == 0:
            w[rnd.randrange(60)] = w[rnd.randrange(60)] = "Scoundrel!"
        texts.append(" ".join(w).encode())
        y.append(int(i % 3 == 0))
    m = crf.learn(texts[:160], y[:160], sum(y[:160]) / 160)
    tag = crf.Tagger(m)
    ps = tag.marginals(texts[160:])
    assert [tag.score(p) >= 0.5 for p in ps] == [bool(v) for v in y[160:]]
    t = "Ünter scoundrel, river".encode()
    (span,) = tag.spans(t, tag.marginals([t])[0])
    assert t.decode()[span["first"] : span["end"]] == "scoundrel"


def test_toxicity_of_odd_documents(spark, odd, labels):
    got = crf.toxicity(odd, labels).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 for r in got)
    assert crf.toxicity(odd.limit(0), labels).count() == 0


def test_language_held_out(spark, docs):
    got = langzip.language(docs).join(docs, "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() >= 0.9


def test_language_of_odd_documents(spark, odd):
    got = langzip.language(odd).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5)} == {"und"} and {r["lang_pred"] for r in got} <= {"und", "en", "fr", "de"}
    assert langzip.language(odd.limit(0)).count() == 0
    assert langzip.Model({}).predict(b"text")[0] == "und" and langzip.Model({"a": b"x "}).predict(b"text") == ("a", 1.0, False)


def slow_statistics(t):
    w = re.findall("[^\x20\x09-\x0d]+", t)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("seed", range(30))
def test_statistics(seed):
    rnd = random.Random(seed)
    t = "".join(rnd.choices(["a ", "b ", "é", "\n", "x#y ", "|", "\x0b", "\x85", "a b a b\n", "<p>"], k=rnd.randrange(120)))
    assert isoforest.statistics(t.encode()) == slow_statistics(t)


def test_rules(spark, docs, labels, odd):
    forest = isoforest.train(docs, labels)
    got = isoforest.judge(docs, forest).join(labels, "doc_id").toPandas()
    for r in docs.limit(50).collect():
        x = got[got["doc_id"] == r["doc_id"]]
        if len(x):
            assert tuple(x[isoforest.STATS].iloc[0]) == slow_statistics(r["text"])
    good = got[(got["quality"] == 1) & ~got["base_failed"]]
    assert good["kept"].mean() > 0.97 and not got[got["base_failed"]]["kept"].any()
    rows = isoforest.judge(odd, forest).collect()
    assert len(rows) == 13 and all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in rows)
    assert isoforest.judge(odd.limit(0), forest).count() == 0
    assert isoforest.judge(odd, isoforest.train(odd.limit(0), labels)).count() == 13


def test_forest_of_all_labelled_rows(spark):
    """More labelled rows of a class than 4,000, against the trees' own calibration over all of them."""
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(3000)]
    text = lambda i: " ".join(rnd.choices(words, k=rnd.randint(20, 60))) + " %$" * (rnd.randint(3, 20) if i % 10 == 0 and i % 40 else rnd.randint(0, 3))
    rows = [(i, text(i)) for i in range(9000)] + [(3, "no word of the first three"), (5, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1) for i in range(8900)] + [(1, 0), (None, 1)], "doc_id long, quality int")
    known = [(i, t) for i, t in rows if i < 8900 and i != 1]
    x = isoforest.ratios(np.array([isoforest.statistics((t or "").encode()) for _, t in known], float))
    good = np.array([i % 10 > 0 for i, _ in known])
    f = isoforest.train(d, y)
    assert f.rows == 256 and f.least == isoforest.calibrate(f, x, good) and good.sum() > 8000
    got = isoforest.train_and_judge(d, y).collect()
    want = isoforest.judge(d, f).collect()
    key = lambda r: (r["doc_id"], r["n_words"])
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) == 9002
    own = isoforest.labelled(isoforest.measured(d), y).where("y = 1")
    each = isoforest.draws(own, int(good.sum()))
    assert len(each) == 128 and all(len(e) == 256 for e in each) and len({tuple(r) for e in each for r in e}) > 4500
    assert [len(e) for e in isoforest.draws(own.limit(100), 100, 3)] == [100] * 3


def test_forest_of_few_labels(spark, odd, labels):
    assert isoforest.train_and_judge(odd.limit(0), labels).count() == 0
    for rows in ([], [(1, 1), (2, 1)], [(1, 0), (8, 0)], [(1, 1), (8, 0), (9, 1)]):
        y = spark.createDataFrame(rows, "doc_id long, quality int")
        assert isoforest.train_and_judge(odd, y).count() == 13
        assert (isoforest.train(odd, y).least == 2.0) == (len({q for _, q in rows}) < 2)


def test_every_language_is_learned(spark):
    rnd = random.Random(7)
    own = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(71 * 60)]
    words = lambda k, n: " ".join(rnd.choices(own[60 * k : 60 * k + 60], k=n))
    rows = [(100 * k + i, words(k, 60), f"l{k:02d}") for k in range(70) for i in range(3 if k < 69 else 2)] + [(90_000 + i, words(70, 30_000), "zz") for i in range(2)]
    assert len(rows[-1][1]) > 200_000
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langzip.train(d, F.lit(True))
    assert len(m.dicts) == 71 and all(len(x) <= langzip.DICT_BYTES for x in m.dicts.values())
    assert [m.predict(t.encode())[0] for _, t, _ in rows[::9]] == [x for *_, x in rows[::9]]
    assert m.predict(rows[-1][1].encode())[0] == "zz"


def test_dictionary_words_by_texts(spark):
    d = spark.createDataFrame([(1, "B a", "x"), (2, "a é\na", "x"), (3, "", "x"), (4, None, "x"), (5, "c", None), (6, "  ", "y")], "doc_id long, text string, lang string")
    assert langzip.train(d, F.lit(True)).dicts == {"x": "é b a ".encode()}
    assert langzip.train(d, F.lit(True), dict_bytes=4).dicts == {"x": b"b a "}


def slow_places(text):
    """n-grams one by one, hashed as the classifier hashes them."""
    a, out = list(text), set()
    m = 1 << 32
    for i in range(len(a)):
        out.add(a[i])
        if i + 1 < len(a):
            two = (a[i] * 257 + a[i + 1]) % m
            out.add(((two * 2654435761) % m) >> 14)
            if i + 2 < len(a):
                out.add((((two * 263 + a[i + 2]) % m * 2246822519 + 77) % m) >> 14)
    kind = lambda c: 0 if 48 <= c < 58 else 1 if 97 <= c < 123 else 2 if 65 <= c < 91 else 3 if c >= 128 else 4
    shapes, last = [], b""
    for w in text.split():
        shapes.append(b"=" if w == last else b"%d%d%d" % (kind(w[0]), kind(w[-1]), 0 if len(w) == 1 else 1 if len(w) < 4 else 2))
        last = w
    for n in (1, 2, 3):
        out |= {zlib.crc32(b" ".join(shapes[i : i + n])) >> 14 for i in range(len(shapes) - n + 1)}
    return sorted(out)


def test_nbsvm_features_ratios_and_dual(docs):
    texts = [r["text"].encode() for r in docs.limit(40).collect()] + [b"", b"a", b"ab", b"x x x Y1 9", "\u00e9 \u6f22".encode(), b"\xff\xfe bad utf"]
    mark = np.zeros(nbsvm.DIM, np.uint8)
    rows = [nbsvm.features(t, mark) for t in texts]
    assert [r.tolist() for r in rows] == [slow_places(t) for t in texts]
    assert all(np.array_equal(nbsvm.from_bitmap(nbsvm.to_bitmap(r)), r) for r in rows)
    y = np.array([1 if i % 3 else -1 for i in range(len(rows))])
    ratio = nbsvm.log_count_ratio(rows, y, least=0.0)
    for place in [*rows[0][:20].tolist(), 5, 77_777]:
        p, q = (sum(place in set(r.tolist()) for r, s in zip(rows, y, strict=True) if s == c) + 0.5 for c in (1, -1))
        assert abs(ratio[place] - np.log((p / ((y == 1).sum() + 1)) / (q / ((y == -1).sum() + 1)))) < 1e-12
    # the dual's optimum is the primal's: weights and bias (a feature that is always 1) leave no duality gap
    cost = np.full(len(rows), 0.7)
    w, b = nbsvm.hinge(rows, y, ratio, cost, rounds=3000)
    xs = [ratio[r] / (np.sqrt((ratio[r] ** 2).sum()) or 1.0) for r in rows]
    margins = np.array([w[r] @ x + b for r, x in zip(rows, xs, strict=True)])
    primal = 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - y * margins)).sum()
    better = min(0.5 * (v @ v + c * c) + (cost * np.maximum(0, 1 - y * np.array([v[r] @ x + c for r, x in zip(rows, xs, strict=True)]))).sum() for v, c in [(w * f, b * f + g) for f in (0.9, 0.99, 1.01, 1.1) for g in (-0.05, -0.01, 0, 0.01, 0.05)])
    assert primal <= better + 1e-3


def test_quality_scores_follow_the_model(spark, docs, labels):
    model = nbsvm.train(docs, labels, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in nbsvm.score(docs, model).collect()}
    for r in docs.limit(60).collect():
        x = np.array(slow_places(r["text"].encode()))
        m = sum(model.weights[i] for i in x) / np.sqrt(sum(model.ratio[i] ** 2 for i in x)) + model.bias
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-np.clip(model.a * m + model.b, -30, 30)))) < 1e-9


def test_forest_paths_and_threshold():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (300, 5)), rng.normal(6, 0.3, (20, 5))])
    good = np.arange(320) < 300
    f = isoforest.grow(x[good], (x.min(0), x.max(0)), trees=15, rows=64)
    for row, a in zip(x[::17], f.anomaly(x)[::17], strict=True):
        total = 0.0
        for t in range(15):
            at = 0
            while f.feature[t][at] >= 0:
                at = f.left[t][at] + (row[f.feature[t][at]] >= f.threshold[t][at])
            total += f.length[t][at]
        assert abs(a - 2.0 ** (-total / 15 / isoforest._mean_path(64))) < 1e-12
    least = isoforest.calibrate(f, x, good, 0.99)
    a = f.anomaly(x)
    kept = lambda c: ((a < c) & good).sum() / 300
    score = lambda c: ((a >= c) & ~good).sum() / 20 - ((a >= c) & good).sum() / 300
    assert kept(least) >= 0.99 and abs(score(least) - max(score(c) for c in np.unique(a) if kept(c) >= 0.99)) < 1e-12


def test_bytes_that_are_no_text():
    bad = b"ab \xff\xc3 \xe6\xbc\xa2 z"
    assert isoforest.statistics(bad)[:2] == (4, 6)
    assert langzip.Model({"a": b"x "}).predict(bad)[0] == "a" and len(crf.tokens(bad)) == 4


def test_field_gradient_is_exact():
    """Against sums over all paths, and differences of the likelihood."""
    import itertools

    rng = np.random.default_rng(6)
    lens, doc, y, weight = np.array([4, 3, 3, 1]), np.array([0, 1, 0, 2]), np.array([1, 0, 1]), np.array([0.5, 1.0, 0.7])
    live = np.array([(lens > j).sum() for j in range(4)])
    e, t, start = rng.normal(-1, 1, (4, 4)), rng.normal(0, 1, (2, 2)), -0.7

    def slow(e, t, start):
        clean = np.ones(3)
        for c in range(4):
            each = {s: np.exp(start * s[0] + sum(e[j, c] * s[j] for j in range(lens[c])) + sum(t[s[j - 1], s[j]] for j in range(1, lens[c]))) for s in itertools.product((0, 1), repeat=int(lens[c]))}
            clean[doc[c]] *= each[(0,) * int(lens[c])] / sum(each.values())
        return (weight * np.where(y == 1, np.log(1 - clean), np.log(clean))).sum()

    toxic, moves, first, value = crf.gradient(t, start, e, lens, live, doc, y, weight)
    assert abs(value - slow(e, t, start)) < 1e-9
    h = 1e-6
    for j in range(4):
        for c in range(4):
            up, down = e.copy(), e.copy()
            up[j, c] += h
            down[j, c] -= h
            want = (slow(up, t, start) - slow(down, t, start)) / 2 / h if j < lens[c] else 0.0
            assert abs(toxic[j, c] - want) < 1e-5
    for x in (0, 1):
        for k in (0, 1):
            up, down = t.copy(), t.copy()
            up[x, k] += h
            down[x, k] -= h
            assert abs(moves[x, k] - (slow(e, up, start) - slow(e, down, start)) / 2 / h) < 1e-5
    assert abs(first - (slow(e, t, start + h) - slow(e, t, start - h)) / 2 / h) < 1e-5


def test_toxicity_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    got = crf.toxicity(d, labels).join(labels, "doc_id").where("held_out and toxic is not null").toPandas()
    assert (got["predicted"] == got["toxic"]).mean() >= 0.9


def test_long_labelled_texts_are_learned_from(spark):
    """Every toxic text is over 150,000 bytes; a part of each is seen, none is left out."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = rnd.choices(base, k=40_000 if i % 2 else 200)
        w[::3] = [f"{rnd.choice('abcdefgh')}{rnd.randrange(3000)}" for _ in w[::3]]
        if i % 2:
            w[::300] = ["vile"] * len(w[::300])
        rows.append((i, " ".join(w), i % 2))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = crf.train(d.select("doc_id", "text"), d.select("doc_id", "toxic"), F.lit(True))
    (p,) = crf.Tagger(m).marginals([b"w1 w2 vile w3 w4"])
    assert p[2] > 10 * max(p[[0, 1, 3, 4]])
    assert max(len(s) for s in crf.segments([b"a"] * 100_000)) == crf.SEGMENT and sum(map(len, crf.segments([b"a"] * 100_000))) <= crf.MOST
