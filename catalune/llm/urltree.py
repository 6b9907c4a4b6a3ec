"""URL filters: a path-template tree for each host, from DataFrame operations alone.

Branching by branching, to the end of every path, the values of a segment under one template are generalised. Values
with too few labels to be compared become ``*`` where they are rare, or where most urls have a value of their own.
What has enough labels (``*`` as one, too) is compared with each other: shares of bad labels are sorted into cells of
1/64, and the least different neighbours are merged by the two-proportion test until all differ; merged values are one
branch, ``~`` and its number. Each branch's share of bad labels is smoothed by its parent's; what lies under a template
whose smoothed share reaches REJECT is blocked. Explicit rules go first, the longest that fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalune.llm.common import Scratch

#: host and path of a rule, and its verdict; fixed by the contract
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
RARE = 0.05  #: share of a template's urls below which a value is rare
VARIED = 0.2  #: values to urls of a template above which the segment is variable
Z = 1.96  #: standard errors up to which neighbours are alike
CELLS = 64  #: cells of shares; what is in one cell is one for the comparison, so a node has at most 65
LABELS = 8  #: labels that a branch needs to be compared
PRIOR, WEIGHT = 0.2, 5.0  #: share of bad urls assumed without labels, and how many labels it counts for
REJECT = 0.5
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UP, _LOW)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule (host and path together) that fits, and its verdict; of equal ones the first given."""
    order = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)) for h, p, _ in order]
    pick = lambda values: F.coalesce(*(F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)), F.lit(None).cast("string"))
    return pick([h + p for h, p, _ in order]), pick([v for *_, v in order])


def _salted(many: DataFrame, few: DataFrame, keys: list[str], by: str, salts: int = 16) -> DataFrame:
    """An inner join whose left side may hold very many rows of one key: they are spread over salts, and the right
    side, which has one row a key, is there for each."""
    left = many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    right = few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [*keys, "salt"]).drop("salt")


def literal(s: Column) -> Column:
    """A segment as it stands in templates; one that looks like a wildcard gets a backslash."""
    return F.when(s.rlike(r"^[*~\\]"), F.concat(F.lit("\\"), s)).otherwise(s)


def agglomerated(cells: Column) -> Column:
    """Cells (lo, hi, l, b, k, wild, paths) in order of share, the least different neighbours joined again and again
    until all neighbours differ by the two-proportion test."""

    def z(x: Column, y: Column) -> Column:
        p = (x["b"] + y["b"]) / (x["l"] + y["l"])
        err = F.sqrt(p * (1 - p) * (1 / x["l"] + 1 / y["l"]))
        return F.when(err > 0, F.abs(x["b"] / x["l"] - y["b"] / y["l"]) / err).otherwise(0.0)

    def both(x: Column, y: Column) -> Column:
        return F.struct(x["lo"].alias("lo"), y["hi"].alias("hi"), *((x[c] + y[c]).alias(c) for c in ("l", "b", "k")), F.greatest(x["wild"], y["wild"]).alias("wild"), (x["paths"] + y["paths"]).alias("paths"))

    def joined(a: Column, zs: Column) -> Column:
        at = F.array_position(zs, F.array_min(zs)).cast("int")
        one = F.concat(F.slice(a, F.lit(1), at - 1), F.array(both(F.get(a, at - 1), F.get(a, at))), F.slice(a, at + 2, F.size(a)))
        return F.when(F.array_min(zs) <= Z, one).otherwise(a)

    def step(a: Column, _: Column) -> Column:
        zs = F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: z(F.get(a, i - 1), F.get(a, i)))
        return F.when(F.size(a) > 1, F.get(F.transform(F.array(zs), lambda x: joined(a, x)), F.lit(0))).otherwise(a)

    return F.when(F.size(cells) > 1, F.aggregate(F.sequence(F.lit(1), F.size(cells)), cells, step)).otherwise(cells)


def judge(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", bad: Column | None = None) -> DataFrame:
    """One row a page: id, host, path, rule, verdict, template, purity (the smoothed share of bad labels).

    Labelled are pages that no rule judges and whose id is in ``labels`` (``bad`` tells which are bad; null ids and
    verdicts are passed over, several of one id are averaged). Repeated pages count as often as they occur.
    Pages without host are a host of their own, "". Extra columns aren't read; an empty table gives an empty one.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict})
    if labels is not None:
        each = labels.select(F.col(label_id).alias("lid"), bad.cast("double").alias("bad")).where("lid is not null and bad is not null").groupBy("lid").agg(F.avg("bad").alias("bad"))
        rows = rows.join(each, F.col("id") == F.col("lid"), "left").drop("lid")
    else:
        rows = rows.withColumn("bad", F.lit(None).cast("double"))
    # a rule speaks for its own urls only: as labels, its verdicts would taint the sections beside them
    known = F.when(F.col("said").isNull(), F.col("bad"))
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = scratch.keep(rows.select("id", "host", "path", "rule", "said", known.alias("known"), segs.alias("segs")), "rows")
    urls = rows.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("known").alias("l"), F.coalesce(F.sum("known"), F.lit(0.0)).alias("b"))
    per_host = urls.groupBy("host").agg(F.sum("l").alias("hl"), F.sum("b").alias("hb"))
    share = (F.col("hb") + WEIGHT * PRIOR) / (F.col("hl") + WEIGHT)
    urls = _salted(urls, per_host.select("host", share.alias("purity")), ["host"], "segs")
    urls = scratch.keep(urls.withColumns({"tmpl": F.lit(""), "rest": F.col("segs")}), "urls0")
    done, i = [], 0
    while not urls.isEmpty():
        urls = _level(urls, scratch, i)
        done.append(urls.where("ended").select("host", "segs", "tmpl", "purity"))
        urls, i = urls.where("not ended").drop("ended"), i + 1
    ends = done[0] if done else urls.select("host", "segs", "tmpl", "purity")
    for d in done[1:]:
        ends = ends.unionByName(d)
    # a url that very many pages share is one row in urls
    out = _salted(rows, ends, ["host", "segs"], "id")
    final = F.coalesce("said", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", final.alias("verdict"), F.concat("host", "tmpl").alias("template"), F.round("purity", 6).alias("purity"))


def _level(urls: DataFrame, scratch: Scratch, i: int) -> DataFrame:
    """The urls (host, segs, n, l, b, purity, tmpl, rest) with the next branching of their node added to tmpl and taken
    from rest, the purity of the branch, and whether they end there."""
    node = ["host", "tmpl"]
    # what all of a node's urls have in common is no branching: the least and the greatest rest tell how much it is
    ends = urls.groupBy(*node).agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    same = F.zip_with("lo", "hi", lambda x, y: F.coalesce(x == y, F.lit(False)))
    lead = F.aggregate(same, start, lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")))["n"]
    urls = _salted(urls, ends.select(*node, lead.alias("lead")), node, "segs")
    common = F.when(F.col("lead") > 0, F.concat(F.lit("/"), F.array_join(F.transform(F.slice("rest", F.lit(1), F.col("lead")), literal), "/"))).otherwise("")
    urls = urls.withColumns({"s": F.coalesce(F.get("rest", F.col("lead")), F.lit("")), "common": common})
    child = urls.groupBy(*node, "s").agg(*(F.sum(c).alias(c) for c in "nlb"), F.max("purity").alias("purity"), F.count("*").alias("paths"))
    child = scratch.keep(child, f"values{i}")
    parent = child.groupBy(*node).agg(F.count("*").alias("kinds"), F.sum("n").alias("pn"))
    # rare values, and those of segments that nearly every url has its own of, are variable unless they can be compared
    variable = (F.col("l") < LABELS) & ((F.col("n") < RARE * F.col("pn")) | (F.col("kinds") > VARIED * F.col("pn")))
    unit = F.when(F.col("s") == "", "").when(variable, "*").otherwise(literal(F.col("s")))
    child = _salted(child, parent, node, "s").withColumn("unit", unit)
    units = child.groupBy(*node, "unit").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.sum("paths").alias("paths"), F.max("purity").alias("purity"), F.max("kinds").alias("kinds"))
    cell = F.when((F.col("unit") != "") & (F.col("l") >= LABELS), F.round(F.col("b") / F.col("l") * CELLS).cast("int"))
    units = scratch.keep(units.withColumn("cell", cell), f"units{i}")
    cells = units.groupBy(*node, "cell").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.count("*").alias("k"), F.max((F.col("unit") == "*").cast("int")).alias("wild"), F.sum("paths").alias("paths"))
    one = F.struct(F.col("cell").alias("lo"), F.col("cell").alias("hi"), "l", "b", "k", "wild", "paths")
    alike = cells.groupBy(*node).agg(F.array_sort(F.collect_list(F.when(F.col("cell").isNotNull(), one))).alias("cells"))
    units = _salted(units, alike.select(*node, agglomerated(F.col("cells")).alias("groups")), node, "unit")
    at = F.when(F.col("cell").isNotNull(), F.size(F.filter("groups", lambda g: g["hi"] < F.col("cell"))))
    units = units.withColumn("at", at).withColumn("g", F.get("groups", F.col("at")))
    merged = F.coalesce(F.col("g.k") > 1, F.lit(False))
    token = F.when(merged & (F.col("g.wild") == 1), "*").when(merged, F.concat(F.lit("~"), F.col("at").cast("string"))).otherwise(F.col("unit"))
    nl, nb = F.when(merged, F.col("g.l")).otherwise(F.col("l")), F.when(merged, F.col("g.b")).otherwise(F.col("b"))
    # a path that is all of its node has no branch to be judged apart
    pure = F.when(F.col("kinds") == 1, F.col("purity")).otherwise((nb + WEIGHT * F.col("purity")) / (nl + WEIGHT))
    units = units.select(*node, "unit", token.alias("token"), pure.alias("pure"), F.when(merged, F.col("g.paths")).otherwise(F.col("paths")).alias("paths"))
    step = _salted(child.select(*node, "s", "unit"), units, [*node, "unit"], "s").drop("unit")
    urls = _salted(urls, step, [*node, "s"], "segs")
    left = F.slice("rest", F.col("lead") + 2, F.greatest(F.size("rest"), F.lit(1)))
    alone = (F.col("token") == "") | (F.col("paths") == 1)
    tail = F.when(F.col("token") == "", "").otherwise(F.concat(F.lit("/"), F.array_join(F.concat(F.array("token"), F.when(alone, F.transform(left, literal)).otherwise(F.array().cast("array<string>"))), "/")))
    out = urls.select("host", "segs", "n", "l", "b", F.col("pure").alias("purity"), F.concat("tmpl", "common", tail).alias("tmpl"), left.alias("rest"), alone.alias("ended"))
    return scratch.keep(out, f"urls{i + 1}")
