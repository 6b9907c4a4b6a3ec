import random
import re

import pytest
from pyspark.sql import functions as F

from catalune.llm import mixing, pseudonyms, urltree


def judged(url, rules=urltree.RULES):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, None
    m = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :], re.S)
    host = m[1].translate({c: c + 32 for c in range(65, 91)})
    best = max((r for r in rules if (host == r[0] or host.endswith("." + r[0])) and m[2].startswith(r[1])), key=lambda r: len(r[0] + r[1]), default=None)
    return host, m[2], best and best[0] + best[1], best and best[2]


URLS = ["http://A.Example.com/en/7?x", "https://example.com/en/", "x://example.comx/en/1", "http://net/de/8", "ftp://a.example.net/de/81#f", "//example.org/es/", "http://ÀB.org/es/1", "no url", "", None, "http://?q", "a://b://c.com/en/1", "http://b.org/es", "http://x.com/en/1/2/3/4"]


def test_hosts_paths_and_rules(spark):
    d = spark.createDataFrame(list(enumerate(URLS)), "page_id int, url string")
    got = {r["page_id"]: r for r in urltree.judge(d).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = judged(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule) and got[i]["verdict"] == (verdict or got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")


def test_pages(spark, labels):
    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in urltree.judge(p, labels, bad=F.col("quality") == 0).collect()}
    for r in p.collect():
        assert (got[r["page_id"]]["host"], got[r["page_id"]]["path"], got[r["page_id"]]["rule"]) == judged(r["url"])[:3]
    assert len(got) == p.count() and urltree.judge(p.limit(0)).count() == 0


def test_tree_blocks_what_is_bad(spark):
    rows = [(i, f"http://h.test/{'spam' if i % 2 else 'news'}/{i}") for i in range(400)] + [(900 + i, "http://h.test/spam/1") for i in range(3)]
    d = spark.createDataFrame(rows, "page_id int, url string").withColumn("host", F.lit("clash"))
    bad = spark.createDataFrame([(i, i % 2) for i in range(0, 200)] + [(None, 1), (7, None)], "doc_id int, b int")
    got = urltree.judge(d, bad, bad=F.col("b") == 1).collect()
    assert len(got) == 403 and all((r["verdict"] == "block") == r["path"].startswith("/spam") for r in got)
    assert {r["template"] for r in got} == {"h.test/spam/*", "h.test/news/*"} or len({r["template"] for r in got}) < 20


def luhn(d):
    return sum((c * 2 - 9 * (c > 4)) if i % 2 else c for i, c in enumerate(map(int, reversed(d)))) % 10 == 0


def test_pseudonyms(spark):
    card = "4539148803436467"
    t = [
        f"a {card} b 4539 1488 0343 6467, {card}", "1234567890123456 stays", "call +1 (017) 555-7713 or +44 20 7946 0958", "ip 10.0.0.1 not 999.1.1.1 nor 1.2.3.4.5",
        "born 1984-02-29 or 31.12.1999 or 12/31/1999, not 1984-02-30", "mail Me.x@Example.com me.x@example.com", "GB82 WEST 1234 5698 7654 32 DE89370400440532013000 DE89370400440532013001", None, "", "v4.0 3. text",
    ]
    d = spark.createDataFrame(list(enumerate(t)), "doc_id int, text string").withColumn("found", F.lit(1))
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymise(d, "k1").collect()}
    a, b, c = re.fullmatch(r"a (\d{16}) b (\d{4} \d{4} \d{4} \d{4}), (\d{16})", got[0]["text"]).groups()
    assert a == c == b.replace(" ", "") != card and luhn(a) and got[0]["n_card"] == 3
    assert got[1]["text"] == t[1] and got[9]["text"] == t[9] and got[7]["text"] is None and got[8]["text"] == ""
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} or \+44 \d{2} \d{4} \d{4}", got[2]["text"]) and got[2]["n_phone"] == 2 and "555-7713" not in got[2]["text"]
    assert got[3]["n_ip"] == 1 and "999.1.1.1 nor 1.2.3.4.5" in got[3]["text"] and "10.0.0.1" not in got[3]["text"]
    assert got[4]["n_date"] == 3 and got[4]["text"].endswith("not 1984-02-30")
    x, y = re.fullmatch(r"mail (\S+) (\S+)", got[5]["text"]).groups()
    assert x.split("@")[0] == y.split("@")[0] and got[5]["n_email"] == 2
    assert got[6]["n_iban"] == 2 and got[6]["text"].endswith("DE89370400440532013001") and "DE89370400440532013000" not in got[6]["text"]
    other = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(d, "k2").collect()}
    assert other[0] != got[0]["text"] and pseudonyms.pseudonymise(d.limit(0), "k").count() == 0


def test_feistel_permutes(spark):
    for n in (2, 3):
        d = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
        got = {r["x"] for r in d.select(pseudonyms.permuted_digits(F.col("d"), "k", "t").alias("x")).collect()}
        assert len(got) == 10**n and {len(x) for x in got} == {n}


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30, 120, 60])
    assert mixing.targets([0, 0], [5, 2]) == [0, 0] and mixing.targets([], []) == []
    assert mixing.targets([1, 1000, 1], [5, 2, 1]) == pytest.approx([3, 996, 3])


def test_flight_keeps_sums():
    import numpy as np

    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 900, 400), np.full(400, 0.37)
    q = mixing.flight(size, p, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-3


def test_mixture(spark, docs):
    got = mixing.mixture(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert len(got) == docs.count() and (got["taken"] <= 3 * got["size"]).all() and (got["taken"] % got["size"].where(got["size"] > 0, 1) == 0).all()
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= max(0.1 * g["target"].iloc[0], g["size"].max())
    again = mixing.mixture(docs.repartition(7)).toPandas()
    assert got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()


def test_odd_documents(spark, odd):
    rows = mixing.mixture(odd).collect()
    assert len(rows) == 13 and {r["size"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    out = mixing.repeat_documents(odd)
    assert out.columns == odd.columns and out.count() == sum(r["copies"] for r in rows)
    assert mixing.mixture(odd.limit(0)).count() == 0 and mixing.repeat_documents(odd.limit(0)).count() == 0


def test_blocks_and_levels(spark):
    rnd = random.Random(9)
    rows = [(i, "w " * rnd.choice([1, 5, 50, 400]), "hot" if i % 3 else f"s{i % 4}") for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = mixing.mix(d, block=5).toPandas()
    assert len(got) == 1500
    got["source"] = got["id"].map(dict((i, s) for i, _, s in rows))
    for _, g in got.groupby("source"):
        assert abs((g["size"] * g["copies"]).sum() - g["target"].iloc[0]) < 0.02 * g["target"].iloc[0] + 400


def test_rare_sections_with_labels_stay_apart(spark):
    # 24 sections of a host of 4.2 % each at most; one is all bad
    rows = [(i, f"http://h.test/s{i % 24}/{i}") for i in range(2400)]
    d = spark.createDataFrame(rows, "page_id int, url string")
    bad = spark.createDataFrame([(i, int(i % 24 == 5)) for i in range(2400)], "doc_id int, b int")
    got = urltree.judge(d, bad, bad=F.col("b") == 1).collect()
    assert all((r["verdict"] == "block") == r["path"].startswith("/s5/") for r in got)


def test_deep_branches_are_told_apart(spark):
    rows = [(i, f"http://h.test/a/b/c/d/{'spam' if i % 3 == 0 else 'news'}/{i}/{'x/' * (i % 2)}") for i in range(600)] + [(700, "http://h.test/a"), (701, "http://h.test/"), (702, "http://h.test/" + "z/" * 300)]
    d = spark.createDataFrame(rows, "page_id int, url string")
    bad = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id int, b int")
    got = {r["page_id"]: r for r in urltree.judge(d, bad, bad=F.col("b") == 1).collect()}
    assert len(got) == 603 and all((got[i]["verdict"] == "block") == (i % 3 == 0) for i in range(600))
    assert got[702]["template"] == "h.test" + "/z" * 300 or got[702]["template"].startswith("h.test/*")


def test_equal_rows_are_shared_out_evenly(spark):
    """Nine rows in ten are one and the same; no task sees them together, and the mix is as near as before."""
    rows = [(1, "w " * 7, "a")] * 2700 + [(i, "w " * (i % 50), "a" if i % 2 else "b") for i in range(10, 310)]
    d = spark.createDataFrame(rows, "doc_id int, text string, source string").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    got = mixing.mix(d.repartition(9), block=40).toPandas()
    same = got[got["id"] == 1]["copies"]
    assert len(got) == 3000 and len(same) == 2700 and same.max() - same.min() <= 1 and got["copies"].between(0, 3).all()
    for t, g in got.groupby("target"):
        assert abs((g["size"] * g["copies"]).sum() - t) <= 0.01 * t + 50
    again = mixing.mix(d, block=40).toPandas()
    assert sorted(map(tuple, got[["id", "h", "copies"]].to_numpy().tolist())) == sorted(map(tuple, again[["id", "h", "copies"]].to_numpy().tolist()))
    out = mixing.repeat_documents(d, block=40)
    assert out.columns == d.columns and out.count() == int(got["copies"].sum())


def test_numbered(spark):
    from catalune.llm.common import Scratch, numbered

    d = spark.range(1000).select((F.col("id") % 3).alias("a"), F.when(F.col("id") % 2 == 0, F.lit("x")).alias("b"), "id").repartition(7)
    got = numbered(d, ["a", "b"], Scratch(spark, "t"), "n").toPandas().fillna("")
    for _, g in got.groupby(["a", "b"]):
        assert sorted(g["i"]) == list(range(len(g)))


def test_a_small_source_with_one_long_document_meets_its_target(spark):
    """The other source has many blocks, this one a single one: it is landed on its own documents."""
    rows = [(i, "w " * (1 + i % 90), "a") for i in range(3000)] + [(10_000 + i, "w " * (30 + i % 40), "b") for i in range(60)] + [(20_000, "w " * 3000, "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id int, text string, source string"), block=100).toPandas()
    for t, g in got.groupby("target"):
        assert abs((g["size"] * g["copies"]).sum() - t) <= 0.01 * t + 20


def test_landing_against_every_outcome():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(20):
        size, p = rng.integers(1, 200, 8), rng.choice([0.0, 1.0, 0.3, 0.62], 8)
        free = [i for i in range(8) if 0 < p[i] < 1]
        off = lambda w: abs(sum(size[i] * (x - p[i]) for i, x in zip(free, w, strict=True))) + 0.02 * max(1.0, np.mean(size[free]) if free else 1.0) * abs(sum(x - p[i] for i, x in zip(free, w, strict=True)))
        out = mixing.landing(size, p)
        assert abs(off([out[i] for i in free]) - min(map(off, itertools.product((0, 1), repeat=len(free))))) < 1e-6 and all(out[i] == p[i] for i in range(8) if i not in free)
