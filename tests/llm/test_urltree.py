"""The template tree against a plain Python version, on given pages and made ones."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from catalune.llm import urltree as U
from tests.llm.test_urls_pii_mix import judged


def lit(s):
    return "\\" + s if s[:1] in ("*", "~", "\\") else s


def tree(pages, bad):
    """pages: (id, url); bad: id -> 0 or 1. id -> (template, purity)."""
    urls = defaultdict(lambda: [0, 0, 0.0])
    where = {}
    for i, url in pages:
        host, path, rule, said = judged(url)
        key = (host, tuple(x for x in path.split("/") if x))
        where[i] = key
        known = None if said else bad.get(i)
        urls[key][0] += 1
        if known is not None:
            urls[key][1] += 1
            urls[key][2] += known
    out = {}

    def walk(members, tmpl, purity):
        """members: [(key, rest)]"""
        rests = [r for _, r in members]
        lead = 0
        while all(len(r) > lead for r in rests) and len({r[lead] for r in rests}) == 1:
            lead += 1
        tmpl += "".join("/" + lit(x) for x in rests[0][:lead])
        kids = defaultdict(list)
        for key, r in members:
            kids[r[lead] if len(r) > lead else ""].append((key, r[lead + 1 :]))
        stat = {s: [sum(urls[k][j] for k, _ in m) for j in range(3)] for s, m in kids.items()}
        if len(kids) == 1:
            for key, _ in members:
                out[key] = (tmpl, purity)
            return
        pn = sum(x[0] for x in stat.values())
        units = defaultdict(list)
        for s, (n, l, _) in stat.items():
            units["" if s == "" else "*" if l < U.LABELS and (n < U.RARE * pn or len(kids) > U.VARIED * pn) else lit(s)].append(s)
        total = {u: [sum(stat[s][j] for s in ss) for j in range(3)] for u, ss in units.items()}
        cells = defaultdict(list)
        for u, (_, l, b) in total.items():
            if u and l >= U.LABELS:
                cells[int(b / l * U.CELLS + 0.5)].append(u)
        groups = [(c, us) for c, us in sorted(cells.items())]
        groups = [us for _, us in groups]
        lb = lambda us: (sum(total[u][1] for u in us), sum(total[u][2] for u in us))

        def z(x, y):
            (l1, b1), (l2, b2) = lb(x), lb(y)
            p = (b1 + b2) / (l1 + l2)
            e = (p * (1 - p) * (1 / l1 + 1 / l2)) ** 0.5
            return abs(b1 / l1 - b2 / l2) / e if e > 0 else 0.0

        while len(groups) > 1:
            zs = [z(x, y) for x, y in zip(groups, groups[1:])]
            if min(zs) > U.Z:
                break
            k = zs.index(min(zs))
            groups[k : k + 2] = [groups[k] + groups[k + 1]]
        name = {u: (u, [u]) for u in total}
        for g, us in enumerate(groups):
            if len(us) > 1:
                for u in us:
                    name[u] = ("*" if "*" in us else f"~{g}", us)
        for token, us in {t: us for t, us in name.values()}.items():
            l, b = lb(us)
            pure = (b + U.WEIGHT * purity) / (l + U.WEIGHT)
            inside = [m for u in us for s in units[u] for m in kids[s]]
            if token == "":
                for key, _ in inside:
                    out[key] = (tmpl, pure)
            elif len(inside) == 1:
                out[inside[0][0]] = (tmpl + "/" + token + "".join("/" + lit(x) for x in inside[0][1]), pure)
            else:
                walk(inside, tmpl + "/" + token, pure)

    hosts = defaultdict(list)
    for key in urls:
        hosts[key[0]].append((key, key[1]))
    for host, m in hosts.items():
        l, b = (sum(urls[k][j] for k, _ in m) for j in (1, 2))
        walk(m, host, (b + U.WEIGHT * U.PRIOR) / (l + U.WEIGHT))
    return {i: out[k] for i, k in where.items()}


def check(spark, pages, bad):
    p = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame(list(bad.items()), "doc_id long, q int")
    got = {r["page_id"]: r for r in U.judge(p, labels, bad=F.col("q") == 1).collect()}
    want = tree(pages, bad)
    assert len(got) == len(pages)
    for i, url in pages:
        tmpl, pure = want[i]
        said = judged(url)[3]
        assert (got[i]["template"], got[i]["verdict"]) == (tmpl, said or ("block" if pure >= U.REJECT else "allow")), (url, got[i], tmpl, pure)
        assert abs(got[i]["purity"] - pure) < 2e-6
    return got


def test_given_pages(spark):
    p = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    check(spark, p, {r["doc_id"]: 1 - r["quality"] for r in labels.collect() if r["quality"] is not None})


@pytest.mark.parametrize("seed", range(3))
def test_made_pages(spark, seed):
    rnd = random.Random(seed)
    share = {}
    pages, bad = [], {}
    for i in range(1500):
        parts = [rnd.choice(["blog", "shop", "spam", "*", "~1", f"u{rnd.randrange(300)}"]) for _ in range(rnd.randrange(5))]
        url = f"http://h{rnd.randrange(3)}.test/" + "/".join(parts) + rnd.choice(["", "/", f"/{i}"])
        pages.append((i, url))
        if rnd.random() < 0.6:
            s = share.setdefault(parts[0] if parts else "", rnd.choice([0.05, 0.1, 0.5, 0.95]))
            bad[i] = int(rnd.random() < s)
    got = check(spark, pages, bad)
    assert any("~" in r["template"] and "\\~" not in r["template"] for r in got.values()) or any("*" in r["template"] for r in got.values())


def test_alike_branches_merge_and_others_do_not(spark):
    """Two unusual sections alike are one branch, though neither is like the mean of all."""
    rate = {"good1": 0.02, "good2": 0.02, "good3": 0.03, "bad1": 0.9, "bad2": 0.92}
    pages = [(i, f"http://h.test/{list(rate)[i % 5]}/{i}") for i in range(4000)]
    rnd = random.Random(1)
    bad = {i: int(rnd.random() < list(rate.values())[i % 5]) for i in range(0, 4000)}
    got = check(spark, pages, bad)
    first = lambda name: {r["template"].split("/")[1] for r in got.values() if r["path"].startswith("/" + name)}
    assert first("bad1") == first("bad2") != first("good1") == first("good2") == first("good3")
    assert {r["verdict"] for r in got.values() if "/bad" in r["path"]} == {"block"} and {r["verdict"] for r in got.values() if "/good" in r["path"]} == {"allow"}


def test_few_numbers_are_one_template(spark):
    got = check(spark, [(i, f"http://h.test/item/{i}") for i in range(6)], {})
    assert {r["template"] for r in got.values()} == {"h.test/item/*"}


def test_long_paths_nulls_and_one_host_of_nearly_all(spark):
    pages = [(i, "http://hot.test/a/" + "b/" * (i % 9) + str(i % 7)) for i in range(900)] + [(1000, None), (1001, ""), (1002, "http://x.test/" + "y/" * 3000), (1003, "http://hot.test/a/" + "c" * 100_000)]
    check(spark, pages, {i: i % 2 for i in range(0, 900, 3)})
