"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams: of bytes (1 to 3), and of word shapes (1 to 3), where a word that repeats the one
before it is a shape of its own. Each is scaled by its log-count ratio between the classes, and a linear hinge-loss
model is fitted to the scaled rows by dual coordinate descent. Margins become probabilities by a logistic fit on
labelled rows that the margins' model hasn't seen.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalune.llm.common import as_bytes, fold, label_sample, per_batch, sampled_texts

DIM = 1 << 18
PER_CLASS = 1500  #: labelled rows of each class at most that the model is fitted to
PLACES = 60_000_000  #: features of all rows together that it is fitted to, at most (8 bytes each)
_SHAPE = np.full(256, 4, np.int64)  # other; digit 0, lower 1, upper 2, beyond ASCII 3
_SHAPE[48:58], _SHAPE[97:123], _SHAPE[65:91], _SHAPE[128:] = 0, 1, 2, 3


def _shapes(text: bytes) -> list[bytes]:
    words, last, out = text.split(), b"", []
    for w in words:
        if w == last:
            out.append(b"=")
        else:
            n = len(w)
            out.append(b"%d%d%d" % (_SHAPE[w[0]], _SHAPE[w[-1]], 0 if n == 1 else 1 if n < 4 else 2))
            last = w
    return out


def features(text: bytes, mark: np.ndarray) -> np.ndarray:
    """Sorted places of the n-grams that occur. mark: DIM zeros, zeros again afterwards."""
    a = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(a):
        mark[a] = 1
        two = a[:-1] * np.uint32(257) + a[1:]
        mark[(two * np.uint32(2654435761)) >> np.uint32(14)] = 1
        mark[((two[:-1] * np.uint32(263) + a[2:]) * np.uint32(2246822519) + np.uint32(77)) >> np.uint32(14)] = 1
        shapes = _shapes(text)
        for n in (1, 2, 3):
            for g in set(zip(*(shapes[i:] for i in range(n)), strict=False)):
                mark[zlib.crc32(b" ".join(g)) >> 14] = 1
    out = np.flatnonzero(mark)
    mark[out] = 0
    return out


@dataclass
class Model:
    """weights: the hinge-loss weight times the ratio; ratio: the log-count ratios; a, b: from margin to log odds."""

    weights: np.ndarray
    ratio: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0
    constant: float | None = None

    def margin(self, idx: np.ndarray) -> float:
        norm = float(np.sqrt((self.ratio[idx] ** 2).sum()))
        return float(self.weights[idx].sum()) / norm + self.bias if norm else self.bias

    def score(self, idx: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(idx) + self.b, -30, 30))))


def hinge(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, rounds: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of min ½|w|² + Σ cost·max(0, 1 - y(w·x)) over unit rows x, by dual coordinate descent."""
    w, bias, alpha, rng = np.zeros(DIM), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    xs = [(r := ratio[i]) / (np.sqrt((r * r).sum()) or 1.0) for i in rows]
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            grad = y[i] * (w[rows[i]] @ xs[i] + bias) - 1
            new = min(max(alpha[i] - grad / (xs[i] @ xs[i] + 1), 0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * xs[i]
                bias += step
                moved = max(moved, abs(step))
            alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def logistic(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of P(y = 1) = σ(a m + b), by Newton's steps with a slight pull towards a = 1, b = 0."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([(weight * (p - y) * m).sum() + 1e-2 * (a - 1), (weight * (p - y)).sum() + 1e-2 * b])
        v = weight * p * (1 - p)
        h = np.array([[(v * m * m).sum() + 1e-2, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        step *= min(1, 4 / (np.abs(step).max() + 1e-9))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, least: float = 0.05) -> np.ndarray:
    """Of each place: log of the share of class 1's rows that have it, over that of class -1's; half a row is added to
    each count and one to each class. Ratios nearer to 0 than ``least`` are 0."""
    count = {s: np.full(DIM, 0.5) for s in (1, -1)}
    for x, s in zip(rows, y.tolist(), strict=True):
        count[s][x] += 1
    n = {s: max(1, (y == s).sum()) for s in (1, -1)}
    ratio = np.log((count[1] / (n[1] + 1)) / (count[-1] / (n[-1] + 1)))
    ratio[np.abs(ratio) < least] = 0
    return ratio


def fit(rows: list[np.ndarray], labels: list[int], share: float | None = None, cost: float = 1.0) -> Model:
    """share: of label 1 among all labelled rows, where the rows given were drawn evenly from the classes."""
    y = np.array([1 if v else -1 for v in labels])
    if len(set(y.tolist())) < 2:  # nothing to tell apart
        return Model(np.zeros(DIM), np.zeros(DIM), 0.0, constant=0.5 if not len(y) else float(y[0] > 0))
    share = float((y > 0).mean()) if share is None else share
    prior = np.where(y > 0, share / max(1, (y > 0).sum()), (1 - share) / max(1, (y < 0).sum())) * len(y)

    def one(pick: np.ndarray) -> Model:
        ratio = log_count_ratio([rows[i] for i in pick], y[pick])
        n = {s: max(1, (y[pick] == s).sum()) for s in (1, -1)}
        each = np.array([cost * len(pick) / (2 * n[s]) for s in y[pick]])
        w, bias = hinge([rows[i] for i in pick], y[pick], ratio, each)
        return Model(w * ratio, ratio, bias)

    part = np.arange(len(y)) % 3
    if min((y[part != k] == s).sum() for k in range(3) for s in (1, -1)) > 1:
        margins = np.empty(len(y))
        for k in range(3):
            m = one(np.flatnonzero(part != k))
            margins[part == k] = [m.margin(rows[i]) for i in np.flatnonzero(part == k)]
    else:
        m = one(np.arange(len(y)))
        margins = np.array([m.margin(r) for r in rows])
    a, b = logistic(margins, (y > 0).astype(float), prior)
    out = one(np.arange(len(y)))
    out.a, out.b = a, b
    return out


def to_bitmap(places: np.ndarray) -> bytes:
    """DIM bits, compressed: 32 KB at most of whatever text."""
    bits = np.zeros(DIM, np.uint8)
    bits[places] = 1
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def from_bitmap(raw: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(raw), np.uint8)))


def train(docs: DataFrame, labels: DataFrame, train_rows, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", per_class: int = PER_CLASS, places: int = PLACES) -> Model:
    """Fitted to at most per_class whole texts of each class; their features, and nothing else, come to the driver:
    as bitmaps of 32 KB at most. Of these rows, in order of a hash of the id, so many are taken as have ``places``
    features together at most (a class always has one row), which bounds the driver's memory whatever the texts.

    Rows without id or label teach nothing, nor do ids whose labels disagree; null texts count as empty, of an id with
    several texts the least is taken. With one class, or none, the score is a constant.
    """
    sample = label_sample(labels, label_id, label_col, train_rows, per_class)
    kept = sample.collect()
    spark = docs.sparkSession
    texts = sampled_texts(docs, spark.createDataFrame(kept, sample.schema), id_col, text_col)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        mark = np.zeros(DIM, np.uint8)
        raw = pa.array([to_bitmap(features(t, mark)) for t in as_bytes(b, "text")], pa.binary())
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), raw], names=["id", "y", "x"])

    got = texts.mapInArrow(per_batch(one), f"id {sample.schema['id'].dataType.simpleString()}, y int, x binary").collect()
    got.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"]))
    n = labels.where(F.col(label_col).isin(0, 1) & train_rows).agg(F.avg(label_col)).first()[0]
    rows, y, left = [], [], places
    for r in got:
        x = from_bitmap(r["x"])
        left -= len(x)
        if left >= 0 or r["y"] not in y:
            rows.append(x)
            y.append(r["y"])
    return fit(rows, y, n)


def _scores(model, batch: pa.RecordBatch, text_col: str) -> list[float]:
    mark = np.zeros(DIM, np.uint8)
    return [model.score(features(t, mark)) for t in as_bytes(batch, text_col)]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row. A null text counts as empty; an empty one has no n-gram and gets the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_scores(shared.value, b, "text"), pa.float64())], names=["doc_id", "score"])

    return slim.mapInArrow(per_batch(one), f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that score at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array([s >= least for s in _scores(shared.value, b, text_col)], pa.bool_()))

    return docs.mapInArrow(per_batch(one), docs.schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's query: doc_id, held_out, score, predicted; the model sees no label of held-out rows."""
    model = train(docs, labels, fold("doc_id", 3) != 1)
    return score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
