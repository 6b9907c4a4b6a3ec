"""Benchmark decontamination: an FM-index per shard of training text, searched for benchmark windows.

A shard is a batch of documents. Its words are numbered by the benchmark's vocabulary (others: 0), and the runs of
known words that are long enough for the shortest window are what is indexed: no window can occur elsewhere. Each
run ends in a separator that sorts by its place, so suffixes differ and sorting them ends. The Burrows-Wheeler
transform is a wavelet matrix; windows are searched backward through its ranks, and occurrences are located by
stepping to sampled suffix positions.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalune.llm.common import Scratch, as_bytes, open_at, slices

#: 0-9, a-z and all beyond ASCII stay; A-Z are lower-cased; the rest parts words.
WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256)).lower()
SAMPLE = 8  #: every so many positions of the text is sampled
SHARD = 1_000_000  #: symbols of an index, unless one document has more
SHARD_BYTES = 32 << 20  #: of text that is searched together, unless one document has more
BLOCK = 4 << 20  #: bytes of benchmark words that are searched for together
PIECE = 20_000  #: windows of a long item that stay together


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1
            zeros_before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(1 - ones, out=zeros_before[1:])
            self.levels.append((bit, zeros_before, int(zeros_before[-1])))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c is before place i."""
        first, at = np.zeros_like(i), i
        for bit, z, n0 in self.levels:
            one = (c >> bit) & 1 == 1
            at = np.where(one, n0 + at - z[at], z[at])
            first = np.where(one, n0 + first - z[first], z[first])
        return at - first

    def access(self, i: np.ndarray) -> np.ndarray:
        c, at = np.zeros_like(i), i
        for _, z, n0 in self.levels:
            one = z[at + 1] == z[at]
            c = c * 2 + one
            at = np.where(one, n0 + at - z[at], z[at])
        return c


class FMIndex:
    """Of runs of symbols from 1 on, given one after the other with a 0 behind each."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        sep = text == 0
        n_sep = int(sep.sum())
        rank = np.where(sep, np.cumsum(sep) - 1, text.astype(np.int64) + n_sep)
        k, order = 1, None
        while True:  # prefix doubling: ranks of the first k symbols, then of 2k
            key = rank * (n + n_sep + int(text.max(initial=0)) + 2)
            key[:-k or None] += rank[k:] + 1 if k < n else 0
            order = np.argsort(key, kind="stable")
            s = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
            rank, k = new, k * 2
            if n == 0 or rank.max() == n - 1 or k >= n:
                break
        before = np.where(order > 0, text[order - 1], 0).astype(np.int64)
        self.bwt = WaveletMatrix(before, int(text.max(initial=0)))
        counts = np.bincount(text, minlength=int(text.max(initial=0)) + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])[: len(counts)]  # rows of smaller symbols; separators come first
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.sampled, self.n_before, self.places = sampled, np.concatenate([[0], np.cumsum(sampled)]), order[sampled]
        self.n = n

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each window (a row of symbols, the rest of the row unused)."""
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        known = len(self.first) - 1
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            c = windows[live, lengths[live] - back].astype(np.int64)
            there = c < known
            lo[live[~there]] = hi[live[~there]] = 0
            live, c = live[there], c[there]
            if not len(live):
                break
            lo[live], hi[live] = self.first[c] + self.bwt.rank(c, lo[live]), self.first[c] + self.bwt.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            r = rows[todo]
            done = self.sampled[r]
            out[todo[done]] = self.places[self.n_before[r[done]]] + steps[todo[done]]
            todo, r = todo[~done], r[~done]
            c = self.bwt.access(r)
            rows[todo] = self.first[c] + self.bwt.rank(c, r)
            steps[todo] += 1
        return out


class Owners:
    """The items of each window, by its row."""

    def __init__(self, at: np.ndarray, items: np.ndarray, names: list):
        self.at, self.items, self.names = at, items, names

    def __getitem__(self, row: int) -> list:
        return [self.names[k] for k in self.items[self.at[row] : self.at[row + 1]].tolist()]


class Windows:
    """The windows of benchmark items: of ``size`` words each, or a whole shorter item. Arrays of word numbers, one row
    a window, so a block of items takes about a hundred bytes a word; picklable."""

    def __init__(self, items: Iterable[tuple[object, str | None]], size: int = 13):
        words = ((i, words_of((t or "").encode())) for i, t in items)
        self._build([(i, len(w) < size, w) for i, w in words if w], size)

    @classmethod
    def of_pieces(cls, pieces: list[tuple[object, bool, list[bytes]]], size: int) -> Windows:
        """pieces: item, whether all of it is shorter than ``size``, and words, ``size`` or more of a longer item."""
        out = cls.__new__(cls)
        out._build(pieces, size)
        return out

    def _build(self, pieces, size: int) -> None:
        self.groups = []  # long windows, then those of short items, each with a vocabulary of its own
        for short in (False, True):
            own = [(i, w) for i, s, w in pieces if s == short]
            if not own:
                continue
            vocab: dict[bytes, int] = {}
            names: dict[object, int] = {}
            rows, of = [], []
            width = max(len(w) for _, w in own) if short else size
            for item, w in own:
                ids = np.fromiter((vocab.setdefault(x, len(vocab) + 1) for x in w), np.int32, len(w))
                rows.append(np.pad(ids, (0, width - len(ids)))[None] if short else np.lib.stride_tricks.sliding_window_view(ids, size))
                of.append(np.full(len(rows[-1]), names.setdefault(item, len(names)), np.int64))
            table, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.concatenate(of)]), axis=1)  # window, item
            self.groups.append((vocab, table, (table > 0).sum(1), Owners(np.searchsorted(pairs[0], np.arange(len(table) + 1)), pairs[1], list(names))))

    def hits(self, texts: Iterable[bytes]) -> list[tuple[int, np.ndarray, set]]:
        """Of each document: number of words, the places of hit words, and the items with occurring windows.

        One document is split at a time, and of its words only runs that can hold a window are kept, as numbers, until
        a shard of them is full."""
        places: list[list[np.ndarray]] = []
        items: list[set] = []
        counts: list[int] = []
        shards = [_Shard(places, items, *g[1:]) for g in self.groups]
        known = [(g[0].get, int(g[2].min())) for g in self.groups]
        for d, text in enumerate(texts):
            w = words_of(text)
            counts.append(len(w))
            places.append([])
            items.append(set())
            for (get, least), shard in zip(known, shards, strict=True):
                ids = np.zeros(len(w) + 2, np.int32)
                ids[1:-1] = np.fromiter(map(get, w, repeat(0)), np.int32, len(w))
                edge = np.flatnonzero(np.diff(ids > 0))
                a, z = edge[::2], edge[1::2]
                long = z - a >= least
                if long.any():
                    shard.add(d, ids, a[long], z[long])
        for shard in shards:
            shard.search()
        return [(n, np.unique(np.concatenate(p)) if p else np.empty(0, np.int64), i) for n, p, i in zip(counts, places, items, strict=True)]


class _Shard:
    """Runs that wait to be indexed together: SHARD symbols at most, unless one run has more. What is found is added
    to the documents' places and items."""

    def __init__(self, places: list[list[np.ndarray]], items: list[set], table: np.ndarray, lengths: np.ndarray, of: Owners):
        self.places, self.items, self.table, self.lengths, self.of = places, items, table, lengths, of
        self.wait, self.n = [], 0

    def add(self, d: int, ids: np.ndarray, a: np.ndarray, z: np.ndarray) -> None:
        """Document d's runs of words [a, z); ids has a 0 before its words, behind them, and so behind each run."""
        upto, at = np.cumsum(z - a + 1), 0
        while at < len(a):
            before = int(upto[at - 1]) if at else 0
            to = int(np.searchsorted(upto, before + SHARD - self.n, side="right"))
            if to <= at and self.wait:
                self.search()
                continue
            to = max(to, at + 1)
            marks = np.zeros(len(ids) + 1, np.int8)
            marks[a[at:to] + 1] += 1
            marks[z[at:to] + 2] -= 1
            self.wait.append((d, a[at:to], z[at:to], ids[np.cumsum(marks[:-1], dtype=np.int8) > 0]))
            self.n += int(upto[to - 1]) - before
            at = to

    def search(self) -> None:
        if not self.wait:
            return
        docs, a, z, text = zip(*self.wait, strict=True)
        self.wait, self.n = [], 0
        doc = np.repeat(docs, [len(x) for x in a])
        start, ends, text = np.concatenate(a), np.cumsum(np.concatenate(z) - np.concatenate(a) + 1), np.concatenate(text)
        index = FMIndex(text)
        lo, hi = index.search(self.table, self.lengths)
        n = hi - lo
        upto, w = np.cumsum(n), 0
        marks = np.zeros(len(text) + 1, np.int64)
        while w < len(n):  # as many windows as occur SHARD times together, or one
            to = max(w + 1, int(np.searchsorted(upto, (upto[w - 1] if w else 0) + SHARD, side="right")))
            m = n[w:to]
            which = np.repeat(np.arange(w, to), m)
            at = index.locate(np.repeat(lo[w:to] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(int(m.sum())))
            np.add.at(marks, at, 1)
            np.add.at(marks, at + self.lengths[which], -1)
            for d, k in zip(*np.divmod(np.unique(doc[np.searchsorted(ends, at, side="right")] * len(n) + which), len(n)), strict=True):
                self.items[d].update(self.of[k])
            w = to
        hit = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        r = np.searchsorted(ends, hit, side="right")
        begins = np.concatenate([[0], ends[:-1]])
        where = hit - begins[r] + start[r]
        cut = np.flatnonzero(np.diff(doc[r])) + 1
        for d, p in zip(doc[r[np.concatenate([[0], cut])]] if len(r) else (), np.split(where, cut), strict=False):
            self.places[d].append(p)


def blocks_of(benchmark: DataFrame, size: int, id_col: str, text_col: str, block: int, scratch: Scratch) -> list[str]:
    """Writes the items' windows to files of the shared folder, each of about ``block`` bytes of words; their paths.

    Items are cut into overlapping pieces on executors and dealt out by hash, so neither a long item nor many of them
    meet in one task, and only the paths come to the driver.
    """
    kind, where = benchmark.schema[id_col].dataType.simpleString(), scratch.path

    def cut(batches):
        for b in batches:
            for part in slices(b):
                rows: list[tuple] = []
                for item, text in zip(part.column("item").to_pylist(), as_bytes(part, "text"), strict=True):
                    w = words_of(text)
                    for i in range(0, max(1, len(w) - size + 1) if w else 0, PIECE):
                        rows.append((item, len(w) < size, b" ".join(w[i : i + PIECE + size - 1])))
                item_, short, words = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(item_, part.schema.field("item").type), pa.array(short, pa.bool_()), pa.array(words, pa.binary())], names=["item", "short", "words"])

    def build(key, t):
        name = f"{where}/windows/{key[0].as_py():06d}"
        rows = sorted(zip(t.column("item").to_pylist(), t.column("short").to_pylist(), t.column("words").to_pylist(), strict=True), key=lambda r: (r[2], r[0] is not None, str(r[0])))
        system, path = open_at(name)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        tmp = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(tmp) as out:
            out.write(pickle.dumps(Windows.of_pieces([(i, s, w.split(b" ")) for i, s, w in rows], size)))
        system.move(tmp, path)  # a task that is run again writes the same
        return pa.table({"path": [name]})

    pieces = scratch.keep(benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).mapInArrow(cut, f"item {kind}, short boolean, words binary"), "pieces")
    total = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n = -(-total // block)
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(max(1, n))))
    made = dealt.groupBy("block").applyInArrow(build, "path string").collect() if n else []
    return sorted(r["path"] for r in made)


_LOADED: dict[str, Windows] = {}


def load(path: str) -> Windows:
    """The block of a path; the last one read is kept, so a worker reads a single block once."""
    if path not in _LOADED:
        _LOADED.clear()
        system, at = open_at(path)
        with system.open_input_stream(at) as f:
            _LOADED[path] = pickle.loads(f.read())
    return _LOADED[path]


def spans_of(places: np.ndarray) -> list[list[int]]:
    """Places in order, merged into spans [first word, word behind the last]."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return np.stack([places[np.concatenate([[0], cut + 1])], places[np.concatenate([cut, [len(places) - 1]])] + 1], axis=1).tolist()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row a document: id, n_words, n_hit, n_items, items_sha256, contaminated, spans (merged, in words).

    A document without words, or null, has zeros and isn't contaminated. Items without words have no window; a
    repeated item counts once, one without id hits but isn't counted. Benchmarks of more than ``block`` bytes of words
    are searched block by block, one in memory at a time, and the blocks' places and items are united per document.
    Repeated document rows stay apart; an empty table gives an empty one. Other columns are not used.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    paths = blocks_of(benchmark, size, item_col, item_text, block, Scratch(docs.sparkSession, "benchmark"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first:long,end:long>>"

    def run(batches):
        for b in batches:
            for part in slices(b, rows=10_000, size=SHARD_BYTES):
                cols: list[list] = [[] for _ in range(6)]
                for n, places, items in searched(paths, part, "text"):
                    for c, v in zip(cols, digest(n, places, items), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True))], names=_NAMES)

    return slim.mapInArrow(run, schema)


def searched(paths: list[str], part: pa.RecordBatch, text_col: str) -> list[tuple[int, np.ndarray, set]]:
    """Windows.hits of a shard's texts, united over the blocks. Texts are split anew for each block: kept, their words
    would take ten times the text."""

    def texts():
        return (t for few in slices(part, text_col, size=1 << 20) for t in as_bytes(few, text_col))

    if not paths:
        return [(len(words_of(t)), np.empty(0, np.int64), set()) for t in texts()]
    out = load(paths[0]).hits(texts())
    for path in paths[1:]:
        out = [(n, np.union1d(p, q) if len(p) else q, i | j) for (n, p, i), (_, q, j) in zip(out, load(path).hits(texts()), strict=True)]
    return out


def digest(n: int, places: np.ndarray, items: set) -> tuple:
    hit, names = len(places), sorted(str(x) for x in items if x is not None)
    return n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and 20 * hit >= n, [{"first": a, "end": z} for a, z in spans_of(places)]


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))]
_NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns, whose text isn't contaminated. Null texts and texts without words stay, as do all
    rows of a repeated one."""
    paths = blocks_of(benchmark, size, item_col, item_text, block, Scratch(docs.sparkSession, "benchmark"))

    def run(batches):
        for b in batches:
            for part in slices(b, text_col, rows=10_000, size=SHARD_BYTES):
                yield part.filter(pa.array([not (len(p) and 20 * len(p) >= n) for n, p, _ in searched(paths, part, text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
