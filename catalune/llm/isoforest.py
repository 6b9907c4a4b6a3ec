"""Quality rules by an isolation forest: statistics of each document, and how few random splits set it apart."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalune.llm.common import Scratch, as_bytes, label_rows, per_batch

SYMBOLS = b"#*$%&|<>"  # fixed by the contract
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
TREES, ROWS = 128, 256  #: trees, and rows that each is grown from
KEEP = 0.995  #: share of the labelled good rows that the threshold keeps at least


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """Words inside windows of ``size`` that occur twice or more; exact, by numbering windows of 1, 2, 4, … words."""
    n = len(words)
    if n <= size:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, n)
    m = n - size + 1
    h = np.zeros(m, np.uint64)
    for k in range(size):  # a hash that differs for no equal windows: if none meets another, none repeats
        h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[k : k + m] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():
        return 0
    number, width = ids.astype(np.int64), 1
    while width < size:
        step = min(width, size - width)
        pair = number[: len(number) - step] * (n + 1) + number[step:]
        number = np.unique(pair, return_inverse=True)[1]
        width += step
    counts = np.bincount(number)
    starts = np.flatnonzero(counts[number] > 1)
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + size, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; of bytes that are no UTF-8, each that
    doesn't continue a code point counts as one."""
    words = text.split()
    solid = text.translate(None, SPACE)
    chars = len(solid) if solid.isascii() else int(((np.frombuffer(solid, np.uint8) & 0xC0) != 0x80).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def ratios(s: np.ndarray) -> np.ndarray:
    """What the trees split on, of rows of statistics."""
    words, chars, symbols, lines, again = s.astype(float).T
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    return np.stack([np.log1p(words), np.log1p(chars / w), np.log1p(1000 * symbols / c), np.log1p(lines), np.log1p(100 * again / w)], axis=1)


def _mean_path(n):
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Flat trees: feature (-1: leaf), threshold, left child (right is the next), path length of leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    length: np.ndarray
    rows: int
    least: float = 2.0  # anomaly from which a document goes

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """2^(-E[path]/c) of each row, in (0, 1); higher is odder."""
        total = np.zeros(len(x))
        each = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t][at]
                go = f >= 0
                if not go.any():
                    break
                right = x[each, np.maximum(f, 0)] >= self.threshold[t][at]
                at = np.where(go, self.left[t][at] + right, at)
            total += self.length[t][at]
        return np.power(2.0, -total / (len(self.feature) * max(float(_mean_path(self.rows)), 1e-9)))


def grow(x: np.ndarray, box: tuple[np.ndarray, np.ndarray] | None = None, trees: int = TREES, rows: int = ROWS, seed: int = 11, drawn: list[np.ndarray] | None = None) -> Forest:
    """Splits are uniform over a node's part of the box (the rows' own range unless given), whether rows lie there or
    not: what falls where no rows are soon ends in an empty leaf. ``drawn``: each tree's rows, else drawn from x."""
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x)) if drawn is None else len(drawn[0])
    depth = 2 * max(1, int(np.ceil(np.log2(max(rows, 2)))))
    low, high = box if box is not None else (x.min(0), x.max(0)) if len(x) else (np.zeros(x.shape[1]),) * 2
    made = []
    for t in range(trees):
        nodes: list[list[float]] = [[-1, 0, 0, 0]]
        own = drawn[t] if drawn is not None else x[rng.choice(len(x), rows, replace=False)] if len(x) else x
        todo = [(0, own, 0, low, high)]
        while todo:
            at, part, deep, lo, hi = todo.pop()
            able = np.flatnonzero(hi > lo)
            if deep >= depth or len(part) < 2 or not len(able):
                nodes[at][3] = deep + float(_mean_path(len(part)))
                continue
            f = int(rng.choice(able))
            cut = float(rng.uniform(lo[f], hi[f]))
            nodes[at][:3] = [f, cut, len(nodes)]
            nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
            right, lo2, hi2 = part[:, f] >= cut, lo.copy(), hi.copy()
            lo2[f] = hi2[f] = cut
            todo += [(len(nodes) - 2, part[~right], deep + 1, lo, hi2), (len(nodes) - 1, part[right], deep + 1, lo2, hi)]
        made.append(np.array(nodes, float))
    size = max(map(len, made), default=1)
    all_ = np.stack([np.concatenate([m, np.tile([-1.0, 0, 0, 0], (size - len(m), 1))]) for m in made])
    return Forest(all_[..., 0].astype(np.int64), all_[..., 1], all_[..., 2].astype(np.int64), all_[..., 3], rows)


def calibrate(forest: Forest, x: np.ndarray, good: np.ndarray, keep: float = KEEP) -> float:
    """The threshold with most balanced accuracy among those that keep the share ``keep`` of the good rows."""
    if not good.any() or good.all():
        return 2.0
    a = forest.anomaly(x)
    floor = np.quantile(a[good], keep, method="higher")
    cuts = np.unique(np.concatenate([[np.nextafter(floor, 2)], a[a > floor]]))
    bad = np.sort(a[~good])
    caught = len(bad) - np.searchsorted(bad, cuts)
    lost = good.sum() - np.searchsorted(np.sort(a[good]), cuts)
    return float(cuts[np.argmax(caught / len(bad) - lost / good.sum())])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the five statistics of each whole text."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        s = np.array([statistics(t) for t in as_bytes(b, "text")], np.int64).reshape(-1, 5)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, s.T)], names=["doc_id", *STATS])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(per_batch(one), f"doc_id {docs.schema[id_col].dataType.simpleString()}, {', '.join(f'{s} long' for s in STATS)}")


def _table(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(s).to_numpy(zero_copy_only=False) for s in STATS], axis=1)


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """measured with each row's anomaly."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.anomaly(ratios(_table(b))))], names=[*b.schema.names, "anomaly"])

    cols = ["doc_id", *STATS]
    return stats.select(*cols).mapInArrow(per_batch(one), ", ".join(f"{c} {stats.schema[c].dataType.simpleString()}" for c in cols) + ", anomaly double")


def labelled(rows: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """The rows whose id is labelled, with y; rows that are equal count once."""
    y = label_rows(labels, label_id, label_col, F.lit(True))
    return rows.join(y, rows["doc_id"] == y["id"]).drop("id").distinct()


def draws(rows: DataFrame, n: int, trees: int = TREES, size: int = ROWS) -> list[np.ndarray]:
    """For each tree the statistics of ``size`` of the n rows (all, if fewer): those least by a hash of the tree's own.
    What comes to the driver is bounded by trees and size, however many the rows are."""
    salts = np.random.default_rng(11).integers(0, 2**63, trees, np.uint64)
    size = min(size, n)
    share = (size + 8 * size**0.5) / max(n, 1)
    while True:
        limit = np.uint64(min(1.0, share) * (2**63 - 1024))

        def one(b: pa.RecordBatch, every=share >= 1, limit=limit) -> pa.RecordBatch:
            h, s, got = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64), _table(b), []
            for t, salt in enumerate(salts):
                k = h ^ salt
                for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                    k = (k ^ (k >> np.uint64(shift))) * np.uint64(times)
                k >>= np.uint64(1)
                at = np.arange(len(k)) if every else np.flatnonzero(k < limit)
                got.append((np.full(len(at), t), k[at].astype(np.int64), s[at]))
            t, k, s = map(np.concatenate, zip(*got, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(k), *map(pa.array, s.T)], names=["t", "k", *STATS])

        hashed = rows.select(F.xxhash64("doc_id", *STATS).alias("h"), *STATS)
        found = hashed.mapInArrow(per_batch(one), f"t int, k long, {', '.join(f'{s} long' for s in STATS)}").toArrow()
        f = np.stack([c.to_numpy() for c in found.columns], axis=1) if found.num_rows else np.zeros((0, 7), np.int64)
        f = f[np.lexsort(f.T[::-1])]
        each = [f[slice(*np.searchsorted(f[:, 0], [t, t + 1]))][:size, 2:] for t in range(trees)]
        if share >= 1 or min(map(len, each)) == size:
            return each
        share *= 2


def grown(rows: DataFrame) -> Forest:
    """Trees of labelled rows: each tree draws from all good ones (so that odd means unlike them), and splits within
    the range of all."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        x, y = ratios(_table(b)), b.column("y").to_numpy(zero_copy_only=False)
        ends = [*x.min(0), *x.max(0)] if len(x) else [None] * 10
        return pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([int((y == 1).sum())]), *(pa.array([e], pa.float64()) for e in ends)], names=names)

    low, high = [f"low{i}" for i in range(5)], [f"high{i}" for i in range(5)]
    names = ["n", "good", *low, *high]
    ends = rows.select("y", *STATS).mapInArrow(per_batch(one), "n long, good long, " + ", ".join(f"{c} double" for c in (*low, *high)))
    r = ends.agg(*(F.sum(c).alias(c) for c in ("n", "good")), *(F.min(c).alias(c) for c in low), *(F.max(c).alias(c) for c in high)).first()
    if not r["n"]:
        return grow(np.zeros((0, 5)))
    own = draws(rows.where("y = 1"), r["good"]) if r["good"] else draws(rows, r["n"])
    return grow(np.zeros((0, 5)), (np.array([r[c] for c in low]), np.array([r[c] for c in high])), drawn=[ratios(s) for s in own])


def threshold(rows: DataFrame, scratch: Scratch, keep: float = KEEP) -> float:
    """calibrate over all rows (anomaly, y), by ranges: no place holds them all."""
    v = rows.groupBy("anomaly").agg(F.sum((F.col("y") == 1).cast("long")).alias("good"), F.sum((F.col("y") != 1).cast("long")).alias("bad"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = scratch.keep(v.repartitionByRange(n, "anomaly").withColumn("pid", F.spark_partition_id()), "values")
    parts = sorted(v.groupBy("pid").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect())
    n_good, n_bad = sum(r["good"] for r in parts), sum(r["bad"] for r in parts)
    if not n_good or not n_bad:
        return 2.0
    before, good, bad = [], 0, 0
    for r in parts:
        before.append((r["pid"], good, bad))
        good, bad = good + r["good"], bad + r["bad"]
    w = W.partitionBy("pid").orderBy("anomaly").rowsBetween(W.unboundedPreceding, 0)
    upto = v.join(F.broadcast(rows.sparkSession.createDataFrame(before, "pid int, good0 long, bad0 long")), "pid").withColumns({f"{c}s": F.col(f"{c}0") + F.sum(c).over(w) for c in ("good", "bad")})
    score = lambda good, bad: (n_bad - F.col(bad)) / F.lit(float(n_bad)) - (n_good - F.col(good)) / F.lit(float(n_good))
    upto = upto.withColumns({"g": F.col("goods") - F.col("good"), "b": F.col("bads") - F.col("bad")})
    floor = upto.where(F.col("goods") > int(np.ceil((n_good - 1) * keep))).agg(F.min(F.struct("anomaly", score("goods", "bads").alias("score"))).alias("m")).first()["m"]
    best = upto.where(F.col("anomaly") > floor["anomaly"]).agg(F.max(F.struct(score("g", "b").alias("score"), (-F.col("anomaly")).alias("least"))).alias("m")).first()["m"]
    return float(-best["least"] if best and best["score"] > floor["score"] else np.nextafter(floor["anomaly"], 2))


def _verdicts(rows: DataFrame, least: float) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select("doc_id", *STATS, failed.alias("base_failed"), "anomaly", (~failed & (F.col("anomaly") < least)).alias("kept"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", keep: float = KEEP) -> Forest:
    """Trees, their range and the threshold from all labelled rows."""
    scratch = Scratch(docs.sparkSession, "isoforest")
    rows = scratch.keep(labelled(measured(docs, id_col, text_col), labels, label_id, label_col), "labelled")
    forest = grown(rows)
    forest.least = threshold(labelled(scored(rows, forest), labels, label_id, label_col), scratch, keep)
    return forest


def judge(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the five statistics, base_failed, anomaly, kept. Null and empty texts fail the base rules."""
    return _verdicts(scored(measured(docs, id_col, text_col), forest), forest.least)


def train_and_judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", keep: float = KEEP) -> DataFrame:
    """judge of train on the same documents; each text is measured once, and each row's anomaly taken once."""
    scratch = Scratch(docs.sparkSession, "isoforest")
    stats = scratch.keep(measured(docs, id_col, text_col), "stats")
    forest = grown(scratch.keep(labelled(stats, labels, label_id, label_col), "labelled"))
    rows = scratch.keep(scored(stats, forest), "scored")
    return _verdicts(rows, threshold(labelled(rows, labels, label_id, label_col), scratch, keep))
