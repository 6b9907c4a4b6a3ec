"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give scores and offsets.

The field has two states; a token's features are its word, its openings of 3 to 6 bytes and its ending of 3. Labels
are of documents, so the field is fitted to what they say of the tokens: all tokens of a document labelled 0 are clean,
and one token at least of a document labelled 1 is toxic. Both are probabilities of the chain (the clean path's share
of all paths, and the rest), so their likelihood has a gradient by forward and backward, and no token is labelled
beforehand. In each round a random part of the words can't be what makes a document toxic, so others must.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalune.llm.common import as_bytes, fold, label_sample, per_batch, sampled_texts
from catalune.llm.nbsvm import logistic
from catalune.llm.simhash import fingerprint

DIM = 1 << 17
PER_CLASS = 1500  #: labelled documents of each class at most that are learned from
MOST = 5000  #: tokens of such a document at most; of a longer one, segments spread evenly over it
SEGMENT = 48  #: tokens that are a chain of their own while learning
ROUNDS, PULL, DROP = 80, 3e-4, 0.5  #: the last two chosen by three folds within the training rows of sf0.1
CACHE = 600_000  #: words whose emission a worker keeps
#: A-Z lower-cased, other ASCII but 0-9 to blanks of the same length: places stay.
TOKEN_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256)).lower()


def tokens(text: bytes) -> list[bytes]:
    return text.translate(TOKEN_BYTES).split()


def features(word: bytes) -> list[int]:
    own = [b"=" + word] + [b"^" + word[:n] for n in (3, 4, 5, 6) if len(word) >= n]
    return [zlib.crc32(k) % DIM for k in (*own, b"$" + word[-3:], b"*")]


def segments(words: list[bytes], most: int = MOST) -> list[list[bytes]]:
    """Chains of SEGMENT tokens, evenly spread ones if there are more than ``most`` tokens."""
    cut = [words[i : i + SEGMENT] for i in range(0, len(words), SEGMENT)]
    n = max(1, most // SEGMENT)
    return cut if len(cut) <= n else [cut[j] for j in np.linspace(0, len(cut) - 1, n).astype(int)]


@dataclass
class Field:
    """Emission of the toxic state over the other by feature; moves: log odds [to toxic from other, from toxic], as
    potentials t[i, j]; start: log odds of the first token."""

    w: np.ndarray = field(default_factory=lambda: np.zeros(DIM))
    t: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    a: float = 1.0
    b: float = 0.0
    constant: float | None = None


def posterior(e: np.ndarray, first: np.ndarray, model: Field) -> np.ndarray:
    """P(toxic) of every token of sequences laid end to end; ``first`` marks where one starts.

    Forward and backward ratios are Möbius maps that forget where they came from. The tokens are cut into columns
    that are worked in step; each column starts early enough that what came before has died away below 1e-12.
    """
    n = len(e)
    if not n:
        return np.empty(0)
    m = np.exp(model.t)
    det, tr = m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0], m.sum()
    # a ratio's move shrinks by this factor at worst (Birkhoff), whatever the emissions
    root = np.sqrt(m[0, 0] * m[1, 1] / (m[0, 1] * m[1, 0]))
    shrink = abs((root - 1) / (root + 1)) if tr and det else 0.0
    warm = 1 if shrink < 1e-9 else int(np.ceil(-12 * np.log(10) / np.log(min(shrink, 0.98)))) + 1
    odds = np.exp(np.clip(e, -40, 40))
    width = max(512, 4 * warm)

    def sweep(odds: np.ndarray, fresh: np.ndarray, m: np.ndarray, begin: float, own: bool) -> np.ndarray:
        """r[i] = (own: odds[i] ×) move(r[i-1] (not own: × odds[i-1])), begin where fresh."""
        cols = -(-n // width)
        pad = cols * width - n
        take = lambda x, fill: np.concatenate([np.full(warm, fill, x.dtype), x, np.full(pad, fill, x.dtype)])
        o, f = take(odds, 1.0), take(fresh, False)
        at = np.arange(cols) * width
        r, out = np.full(cols, begin), np.empty((width, cols))
        prev = np.ones(cols)
        for s in range(warm + width):
            oi, fi = o[at + s], f[at + s]
            x = r if own else np.minimum(r * prev, 1e30)
            r = (m[0, 1] + m[1, 1] * x) / (m[0, 0] + m[1, 0] * x)
            r = np.where(fi, begin, r)
            if own:
                r = np.minimum(r * oi, 1e30)
            prev = oi
            if s >= warm:
                out[s - warm] = r
        return out.T.ravel()[:n]

    forward = sweep(odds, first, m, float(np.exp(model.start)), True)
    last = np.concatenate([first[1:], [True]])[::-1]
    backward = sweep(odds[::-1], last, m.T, 1.0, False)[::-1]
    x = np.minimum(forward * backward, 1e30)
    return x / (1 + x)


def _chains(t: np.ndarray, start: float, e: np.ndarray, lens: np.ndarray, live: np.ndarray):
    """Of chains in columns, longest first, with emissions e of the toxic state: log weights of all paths up to a token
    (clean, toxic), from it on, and of the whole. live: how many chains reach a token."""
    length, n = e.shape
    f, b = np.zeros((2, length, n)), np.zeros((2, length, n))
    f[1, 0] = start + e[0]
    for j in range(1, length):
        m = live[j]
        for k in (0, 1):
            f[k, j, :m] = np.logaddexp(f[0, j - 1, :m] + t[0, k], f[1, j - 1, :m] + t[1, k]) + (e[j, :m] if k else 0)
    last = lens - 1, np.arange(n)
    z = np.logaddexp(f[0][last], f[1][last])
    for j in range(length - 2, -1, -1):
        m = live[j + 1]
        for k in (0, 1):
            b[k, j, :m] = np.logaddexp(t[k, 0] + b[0, j + 1, :m], t[k, 1] + b[1, j + 1, :m] + e[j + 1, :m])
    return f, b, z


def gradient(t: np.ndarray, start: float, e: np.ndarray, lens: np.ndarray, live: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Of the weighted log likelihood of the documents' labels, by emission, move and start; and the likelihood.

    P(clean) of a document is the product over its chains. d log P(clean) = clean path's features - expected ones;
    d log(1 - P(clean)) is the same times -P/(1 - P).
    """
    f, b, z = _chains(t, start, e, lens, live)
    logp = np.minimum(np.bincount(doc, (lens - 1) * t[0, 0] - z, len(y)), -1e-9)
    p = np.exp(logp)
    push = np.where(y == 1, np.minimum(p / (1 - p), 50.0), -1.0) * weight
    r = push[doc]
    toxic = np.exp(np.minimum(f[1] + b[1] - z, 0)) * (np.arange(len(e))[:, None] < lens) * r
    moves = np.zeros((2, 2))
    for j in range(len(e) - 1):
        m = live[j + 1]
        for x in (0, 1):
            for k in (0, 1):
                moves[x, k] += (r[:m] * np.exp(f[x, j, :m] + t[x, k] + b[k, j + 1, :m] + (e[j + 1, :m] if k else 0) - z[:m])).sum()
    moves[0, 0] -= (r * (lens - 1)).sum()
    return toxic, moves, float(toxic[0].sum()), float((weight * np.where(y == 1, np.log1p(-p), logp)).sum())


def fit_field(docs: list[list[list[bytes]]], y: np.ndarray, rounds: int = ROUNDS, pull: float = PULL, drop: float = DROP, seed: int = 3) -> Field:
    """docs: segments of words. Maximum likelihood of the documents' labels, both classes of equal weight, by AdaGrad
    on the whole set; weights are pulled to their start by ``pull``."""
    order = sorted(((len(s), d, s) for d, segs in enumerate(docs) for s in segs if s), key=lambda x: (-x[0], x[1]))
    if not order:
        return Field()
    vocab: dict[bytes, int] = {}
    lens, doc = np.array([n for n, *_ in order]), np.array([d for _, d, _ in order])
    tok = np.zeros((int(lens[0]), len(order)), np.int64)
    for i, (n, _, s) in enumerate(order):
        tok[:n, i] = [vocab.setdefault(w, len(vocab)) for w in s]
    live = (lens[None] > np.arange(len(tok))[:, None]).sum(1)
    each = [features(w) for w in vocab]
    row = np.repeat(np.arange(len(each)), [len(x) for x in each])
    places, col = np.unique(np.concatenate(each), return_inverse=True)
    w, t, start = np.zeros(len(places)), np.array([[2.0, -2.0], [1.0, -1.0]]), -4.0
    # at first, about every second document would have a toxic token
    w[np.searchsorted(places, zlib.crc32(b"*") % DIM)] = np.log(35 * len(docs) / lens.sum())
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    begin, gw, gt, gs, rng = w.copy(), np.full(len(w), 1e-8), np.full((2, 2), 1e-8), 1e-8, np.random.default_rng(seed)
    for _ in range(rounds):
        e = np.bincount(row, w[col], len(each))[tok] - 20.0 * ((rng.random(len(each)) < drop)[tok] * (y[doc] == 1))
        toxic, g_t, g_s, _ = gradient(t, start, e, lens, live, doc, y, weight)
        by_word = np.bincount(tok.ravel(), toxic.ravel(), len(each))
        g = np.bincount(col, by_word[row], len(places)) - pull * (w - begin)
        gw += g * g
        gt += g_t * g_t
        gs += g_s * g_s
        w += 0.5 * g / np.sqrt(gw)
        t = np.clip(t + 0.1 * g_t / np.sqrt(gt), -4, 4)
        start += 0.1 * g_s / np.sqrt(gs)
    out = Field(t=t, start=float(start))
    out.w[places] = w
    return out


class Tagger:
    """Applies a field to texts; keeps the emissions of words it has met."""

    def __init__(self, model: Field):
        self.model, self.known = model, {}

    def emissions(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.known.__getitem__, words), float, len(words))
        except KeyError:
            new = [x for x in set(words) if x not in self.known]
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                new = list(set(words))
            w = self.model.w
            for x in new:
                self.known[x] = float(w[features(x)].sum())
            return np.fromiter(map(self.known.__getitem__, words), float, len(words))

    def marginals(self, texts: list[bytes]) -> list[np.ndarray]:
        e = [self.emissions(tokens(t)) for t in texts]
        lengths = np.array([len(x) for x in e], np.int64)
        ends = np.cumsum(lengths)
        first = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
        first[(ends - lengths)[lengths > 0]] = True
        p = posterior(np.concatenate(e) if e else np.empty(0), first, self.model)
        return np.split(p, ends[:-1]) if len(ends) else []

    def raw(self, p: np.ndarray) -> float:
        """One number a document: the log odds of its surest token, raised by how many toxic tokens to expect."""
        if not len(p):
            return -20.0
        top = min(float(p.max()), 1 - 1e-6)
        return float(np.clip(np.log((top + 1e-6) / (1 - top)) + 3 * np.log(p.sum() + 0.05), -20, 20))

    def score(self, p: np.ndarray) -> float:
        m = self.model
        if m.constant is not None:
            return m.constant
        return float(1 / (1 + np.exp(-np.clip(m.a * self.raw(p) + m.b, -30, 30))))

    @staticmethod
    def spans(text: bytes, p: np.ndarray, least: float = 0.5) -> list[dict]:
        """Offending spans in characters of the text: [first, end), neighbours joined."""
        out: list[dict] = []
        hot = np.flatnonzero(p >= least)
        if not len(hot):
            return out
        flat = np.frombuffer(text.translate(TOKEN_BYTES), np.uint8)
        solid = np.concatenate([[False], (flat != 32), [False]])
        a, z = np.flatnonzero(solid[1:] & ~solid[:-1]), np.flatnonzero(~solid[1:] & solid[:-1])
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        for i in hot.tolist():
            if out and out[-1]["last"] == i - 1:
                out[-1] |= {"end": int(chars[z[i]]), "last": i}
            else:
                out.append({"first": int(chars[a[i]]), "end": int(chars[z[i]]), "last": i})
        return [{"first": s["first"], "end": s["end"]} for s in out]


def train(docs: DataFrame, labels: DataFrame, train_rows, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", per_class: int = PER_CLASS, most: int = MOST) -> Field:
    """At most per_class documents of each class come to the driver, as at most ``most`` tokens each: all of a shorter
    text, segments spread evenly over a longer one. None is left out for its length.

    Rows without id or label teach nothing, nor do ids whose labels disagree; null texts count as empty, of an id with
    several texts the least is taken. With one class, or none, the score is a constant.
    """
    sample = label_sample(labels, label_id, label_col, train_rows, per_class)
    kept = docs.sparkSession.createDataFrame(sample.collect(), sample.schema)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_bytes(b, "text")
        cut = pa.array([b"\n".join(b" ".join(s) for s in segments(tokens(t), most)) for t in texts], pa.binary())
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), cut, pa.array([fingerprint(t) for t in texts], pa.uint64()).cast(pa.string())], names=["id", "y", "cut", "fp"])

    schema = f"id {sample.schema['id'].dataType.simpleString()}, y int, cut binary, fp string"
    got = sampled_texts(docs, kept, id_col, text_col).mapInArrow(per_batch(one), schema).collect()
    got.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"]))
    share = labels.where(F.col(label_col).isin(0, 1) & train_rows).agg(F.avg(label_col)).first()[0]
    return learn_cut([[s.split(b" ") for s in bytes(r["cut"]).split(b"\n") if s] for r in got], [int(r["fp"]) for r in got], [r["y"] for r in got], share)


def unlike(fps: list[int], within: int = 12) -> list[int]:
    """Places of texts that are no near copies of earlier ones, by 64-bit fingerprints of the (bounded) sample: the
    words of a text that was copied would else look common to many toxic documents."""
    f = np.array(fps, np.uint64)
    kept: list[int] = []
    for i in range(len(f)):
        if not len(kept) or int(np.bitwise_count(f[kept] ^ f[i]).min()) > within:
            kept.append(i)
    return kept


def learn(texts: list[bytes], y: list[int], share: float) -> Field:
    return learn_cut([segments(tokens(t)) for t in texts], [fingerprint(t) for t in texts], y, share)


def learn_cut(docs: list[list[list[bytes]]], fps: list[int], y: list[int], share: float | None) -> Field:
    """share: of label 1 among all labelled rows."""
    apart = unlike(fps)
    docs, y = [docs[i] for i in apart], [y[i] for i in apart]
    if len(set(y)) < 2:
        return Field(constant=0.5 if not y else float(y[0]))
    yy, part = np.array(y), np.arange(len(y)) % 2
    one = lambda pick: fit_field([docs[i] for i in pick], yy[pick])
    # scores are turned to probabilities on documents that the tagger has not learned from
    raw = np.full(len(y), -20.0)
    for k in (0, 1):
        tag, own = Tagger(one(np.flatnonzero(part != k))), np.flatnonzero(part == k)
        for i, p in zip(own, tag.marginals([b" ".join(w for s in docs[i] for w in s) for i in own]), strict=True):
            raw[i] = tag.raw(p)
    weight = np.where(yy > 0, share / max(1, yy.sum()), (1 - share) / max(1, (1 - yy).sum())) * len(yy)
    out = one(np.arange(len(y)))
    out.a, out.b = logistic(raw, yy.astype(float), weight)
    return out


def score(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans) of each row. Null, empty and wordless texts have the lowest score and no spans; repeated
    rows and null ids are rows like others."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        tag = Tagger(shared.value)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = as_bytes(b, "text")
            ps = tag.marginals(texts)
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([tag.score(p) for p in ps], pa.float64()), pa.array([tag.spans(t, p) for t, p in zip(texts, ps, strict=True)], span)], names=["doc_id", "score", "spans"])

        yield from per_batch(one)(batches)

    return slim.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, spans array<struct<first:long,end:long>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's query: doc_id, held_out, score, predicted, spans."""
    model = train(docs, labels, fold("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
