"""Mixing sources to target weights by cube-method balanced sampling.

A source's documents are all taken floor(r) times and, with the fractional probability left, once more, where r is
the source's target over its size. The flight phase moves the probabilities of documents through the null space of
two constraints, the number of documents and of words, until they are 0 or 1: in blocks of each source first, then
among the at most two documents that each block leaves, and so on; what a whole source leaves, with a few documents of all sizes held back, is
the landing problem, solved by trying its outcomes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalune.llm.common import WORD, Scratch, numbered, packed

WEIGHTS = (5, 2, 1)
CEILING = 3  #: times a document or source at most
BLOCK = 2000  #: documents of a block
LAND = 14  #: documents kept for the landing problem of a source
MERGE = 500  #: blocks whose open documents meet in the next flight
MAX_SOURCES = 200_000  #: their totals, one row each, come to the driver; more are refused


def targets(sizes: list[int], weights: list[float], ceiling: float = CEILING) -> list[float]:
    """Shares of the sum of sizes by weight; what is above ``ceiling`` times a size is shared among the others."""
    s, w = np.array(sizes, float), np.array(weights, float)
    out, left = np.zeros(len(s)), np.ones(len(s), bool)
    rest = s.sum()
    while left.any():
        share = np.where(left, rest * w / w[left].sum(), 0)
        over = left & (share > ceiling * s)
        if not over.any():
            out[left] = share[left]
            break
        out[over] = ceiling * s[over]
        rest = max(0.0, rest - out[over].sum())
        left &= ~over
    return out.tolist()


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities moved to 0 or 1, all but two of them at most, their sum and their words kept."""
    p, eps = p.astype(float), 1e-9
    wait: list[int] = []
    for c in range(len(p)):
        if eps < p[c] < 1 - eps:
            wait.append(c)
        while len(wait) == 3:
            a, b, c3 = (float(size[k]) for k in wait)
            u = (b - c3, c3 - a, a - b) if not a == b == c3 else (1.0, -1.0, 0.0)
            q = [float(p[k]) for k in wait]
            up = min(((1 - x) / d if d > 0 else -x / d) for x, d in zip(q, u, strict=True) if d)
            down = min((x / d if d > 0 else (x - 1) / d) for x, d in zip(q, u, strict=True) if d)
            step = up if rng.random() * (up + down) < down else -down
            for k, x, d in zip(wait, q, u, strict=True):
                y = x + step * d
                p[k] = 0.0 if y < eps else 1.0 if y > 1 - eps else y
            wait = [k for k in wait if 0 < p[k] < 1]
    return p


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of all outcomes of what is left, LAND + 2 documents at most, that whose words and number are nearest to those
    expected; words count most."""
    out, left = p.copy(), np.flatnonzero((p > 0) & (p < 1))
    s, q = size[left].astype(float), p[left]
    ways = ((np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1).astype(float)
    off = np.abs(ways @ s - (s * q).sum()) + 0.02 * max(1.0, s.mean() if len(s) else 1.0) * np.abs(ways.sum(1) - q.sum())
    out[left] = ways[np.argmin(off)]
    return out


def hold_back(p: np.ndarray) -> np.ndarray:
    """Places of LAND open documents, spread evenly over the order given."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    return open_[np.unique(np.linspace(0, len(open_) - 1, LAND).round().astype(int))] if len(open_) else open_


def settle(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight of all but LAND documents spread over the sizes, then the landing of these and what the flight left.
    Documents are in order of size."""
    held = hold_back(p)
    keep = p[held].copy()
    q = p.astype(float).copy()
    q[held] = 0.0
    q = flight(size, q, rng)
    q[held] = keep
    return landing(size, q)


def _group(seed: int):
    """A block's flight; in the only block that a source has left, its landing. The first block of a source with more
    keeps some documents of all sizes out of the flight, for the landing."""

    def run(key, t):
        size, p, h = (t.column(c).to_numpy() for c in ("size", "p", "h"))
        order = np.lexsort((h, -size))  # like sizes meet, small ones last
        rng = np.random.default_rng([seed, *(k.as_py() & 0xFFFFFFFF for k in key)])
        size, q = size[order], p[order]
        if t.column("blocks")[0].as_py() <= 1:
            q = settle(size, q, rng)
        else:
            held = hold_back(q) if key[1].as_py() == 0 else np.empty(0, np.int64)
            kept = q[held]
            q = q.copy()
            q[held] = 0.0
            q = flight(size, q, rng)
            q[held] = kept
        done = np.empty(len(p))
        done[order] = q
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(done))

    return run


def plan_of(rows: DataFrame, weights: tuple, ceiling: int, block: int) -> DataFrame:
    """Of each source: its number in order, sizes, target, whole copies of each document, probability of one more, and
    blocks. One row a source comes to the driver and is broadcast."""
    per = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    got = per.limit(MAX_SOURCES + 1).collect()
    if len(got) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    got.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    want = targets([r["words"] for r in got], [weights[i % len(weights)] for i in range(len(got))], ceiling)
    plan = []
    for i, (r, t) in enumerate(zip(got, want, strict=True)):
        ratio = min(t / r["words"], ceiling) if r["words"] else 0.0
        base = int(np.floor(ratio))
        plan.append((i, r["source"], r["words"], t, base, ratio - base, -(-r["n"] // block)))
    kind = rows.schema["source"].dataType.simpleString()
    return rows.sparkSession.createDataFrame(plan, f"si long, name {kind}, source_size long, target double, base int, rate double, blocks long")


def chosen(docs: DataFrame, weights: tuple, ceiling: int, seed: int, block: int, id_col: str, text_col: str, source_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows (id, h, source, size), and of each unit, all rows that are equal: id, h, m (its rows), size, source_size,
    target, k (copies of all its rows together).

    Rows are equal if id, text and source are. A unit has a whole number of copies and the fraction left as its
    probability, so however many rows are equal, they are one row here.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), row_hash(id_col, text_col, source_col).alias("h"), F.col(source_col).alias("source"), size.alias("size"))
    rows = scratch.keep(rows, "sizes")
    sources = plan_of(rows, weights, ceiling, block)
    units = rows.groupBy("id", "h", "source", "size").agg(F.count("*").alias("m"))
    units = units.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name")))
    more = F.col("m") * F.col("rate")
    units = units.withColumns({"whole": F.col("m") * F.col("base") + F.floor(more), "p": more - F.floor(more), "block": F.pmod(F.xxhash64("h", "id"), "blocks")})
    open_ = units.select("si", "block", "blocks", "id", "h", "m", "size", "source_size", "target", "whole", "p")
    most, step, done = max((r["blocks"] for r in sources.collect()), default=1), 0, []
    while True:
        flown = scratch.keep(open_.groupBy("si", "block").applyInArrow(_group(seed + step), open_.schema), f"flight{step}")
        done.append(flown.where("p = 0 or p = 1"))
        if most <= 1:
            break
        most, step = -(-most // MERGE), step + 1
        open_ = flown.where("p > 0 and p < 1").withColumns({"block": F.floor(F.col("block") / MERGE).cast("long"), "blocks": F.ceil(F.col("blocks") / MERGE).cast("long")})
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return rows, out.select("id", "h", "m", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("k"))


def row_hash(id_col: str, text_col: str, source_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col), F.col(source_col))


def _each(rows: DataFrame, units: DataFrame, id_col: str, h_col: str, keys: list[str], scratch: Scratch) -> DataFrame:
    """rows with copies: those of their unit, shared out as evenly as can be among its equal rows.

    Rows cross the shuffle once; only where some are equal, these are looked up once more, to be numbered.
    """
    both = rows.join(units, F.col(id_col).eqNullSafe(F.col("uid")) & (F.col(h_col) == F.col("uh")))
    if units.where("m > 1").isEmpty():
        return both.withColumn("copies", F.col("k").cast("int"))
    alone = both.where("m = 1").withColumn("copies", F.col("k").cast("int"))
    many = numbered(both.where("m > 1"), keys, scratch, "repeated")
    many = many.withColumn("copies", (F.floor(F.col("k") / F.col("m")) + (F.col("i") < F.col("k") % F.col("m")).cast("int")).cast("int")).drop("i")
    return alone.unionByName(many)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, ceiling: int = CEILING, seed: int = 5, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: id, h (a hash of id, text and source), size, source_size, target, copies.

    Null and empty texts have size 0. A null source is a source, the last. Repeated rows are documents of their own,
    and which of them is taken doesn't matter. The order of the rows given doesn't count, so reruns agree. Extra
    columns, of whatever type, aren't read; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows, units = chosen(docs, weights, ceiling, seed, block, id_col, text_col, source_col, scratch)
    units = units.select(F.col("id").alias("uid"), F.col("h").alias("uh"), "m", "source_size", "target", "k")
    return _each(rows, units, "id", "h", ["id", "h"], scratch).select("id", "h", "size", "source_size", "target", "copies")


def mixture(docs: DataFrame) -> DataFrame:
    """The contract's query: doc_id, size, source_size, target, taken, copies."""
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def repeat_documents(docs: DataFrame, weights: tuple = WEIGHTS, ceiling: int = CEILING, seed: int = 5, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, all columns, each as many times as the mix takes it; nulls, repeated rows and empty tables are
    treated as ``mix`` does."""
    scratch = Scratch(docs.sparkSession, "mix")
    _, units = chosen(docs, weights, ceiling, seed, block, id_col, text_col, source_col, scratch)
    taken = units.where("k > 0").select(F.col("id").alias("uid"), F.col("h").alias("uh"), "m", "k")
    own = packed(docs, id_col, row_hash(id_col, text_col, source_col))
    out = _each(own, taken, "key", "hash", ["key", "hash"], scratch).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
