"""SimHash near-duplicates: pigeonhole blocks of 64-bit fingerprints, joined on blocks, verified by Hamming distance.

Documents with equal fingerprints form a class, so copies are never paired. Fingerprints are cut into 2 + d blocks
of bits: two that differ in at most d bits agree in two blocks at least, so each class is dealt out by every choice
of two blocks. Where more than CAP classes share such a key, the key is refined: the bits not yet in it are cut into
d + 1 parts, one of which a close pair also shares. What shares a key is verified by distance, and of the links found
there a spanning forest is enough for the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalune.llm.common import Scratch, as_bytes, connected_components, packed, per_batch

CAP = 1024  #: classes under one key before it is refined
SALTS = 32  #: parts that the rows of such a key are split into while they are told from others
REFINE = 2  #: times at most; no more than 2 to the power of the bits left can then share a key
_OFFSETS = np.arange(8, dtype=np.int64) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned. Words are parted by ASCII white space, A-Z lower-cased; fewer words than a shingle are one; none: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -shingle] + 1]).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:z], seed) for a, z in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BITS).ravel()  # of each bit, lowest first
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, th, fp): th is a hash of the text, which with the id names a row; fp is the fingerprint's 64 bits, signed."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = pa.array([signed(fingerprint(t, shingle, seed)) for t in as_bytes(b, "text")], pa.int64())
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), fp], names=["id", "th", "fp"])

    return rows.mapInArrow(per_batch(one), f"id {docs.schema[id_col].dataType.simpleString()}, th long, fp long")


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _cut(bits: list[int], n: int) -> list[list[int]]:
    at = [len(bits) * k // n for k in range(n + 1)]
    return [bits[a:z] for a, z in zip(at, at[1:], strict=False)]


def _forest(fps: np.ndarray, d: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: breadth-first, each fingerprint reached once."""
    left = fps.view(np.uint64)
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= d
            if near.any():
                got = left[near]
                left = left[~near]
                front.extend(got)
                for y in got:
                    yield int(x.astype(np.int64)), int(y.astype(np.int64))


def _links(d: int):
    """For mapInArrow, over (k, v, fp) sorted by k, v: links a, b of the forest of each key's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64) for _ in range(3)]

        def work(k, v, fp, last: bool) -> tuple[pa.RecordBatch, list[np.ndarray]]:
            """Links of all groups but the last, which may go on in the next batch, unless this is the end; and what is
            left."""
            n = len(k)
            new = np.flatnonzero((k[1:] != k[:-1]) | (v[1:] != v[:-1])) + 1
            bounds = np.concatenate([[0], new, [n]]) if n else np.zeros(1, np.int64)
            done = len(bounds) - 1 if last else max(0, len(bounds) - 2)
            links = [x for g in np.flatnonzero(np.diff(bounds[: done + 1]) > 1).tolist() for x in _forest(np.unique(fp[bounds[g] : bounds[g + 1]]), d)]
            at = int(bounds[done])
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"]), [k[at:], v[at:], fp[at:]]

        for b in batches:
            cols = [np.concatenate([r, b.column(c).to_numpy(zero_copy_only=False)]) for r, c in zip(rest, ("k", "v", "fp"), strict=True)]
            out, rest = work(*cols, False)
            yield out
        yield work(*rest, True)[0]

    return run


def near_links(classes: DataFrame, scratch: Scratch, d: int = 2, cap: int = CAP) -> DataFrame:
    """(a, b): links of distinct fingerprints (column fp) that connect all within d bits of each other."""
    blocks = _cut(list(range(64)), d + 2)
    known = dict(enumerate(a + b for a, b in combinations(blocks, 2)))
    struct = lambda k: F.struct(F.lit(k).cast("long").alias("k"), F.col("fp").bitwiseAND(F.lit(signed(_mask(known[k])))).alias("v"))
    rows = classes.select("fp", F.explode(F.array(*map(struct, known))).alias("x")).select("x.k", "x.v", "fp")
    links = []
    for step in range(REFINE + 1):
        few, wide = rows, None
        if step < REFINE:
            # keys of too many classes are known before any of their rows are brought together
            hot = scratch.keep(rows.groupBy("k", "v").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("k", "v"), f"hot{step}")
            if not hot.isEmpty():
                rows = rows.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
                salted = hot.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
                few, wide = (rows.join(salted, ["k", "v", "salt"], how).drop("salt") for how in ("left_anti", "left_semi"))
        dealt = few.repartition("k", "v").sortWithinPartitions("k", "v", "fp")
        links.append(scratch.keep(dealt.mapInArrow(_links(d), "a long, b long"), f"links{step}"))
        if wide is None:
            break
        wide = wide.select("k", "fp")
        finer = {}
        for k, bits in known.items():
            for j, part in enumerate(_cut(sorted(set(range(64)) - set(bits)), d + 1)):
                finer[k * (d + 1) + j] = bits + part
        parent, known = known, finer
        masks = F.create_map(*(x for k in parent for x in (F.lit(k).cast("long"), F.array(*(F.lit(signed(_mask(known[k * (d + 1) + j]))) for j in range(d + 1))))))
        rows = wide.select("fp", "k", F.posexplode(masks[F.col("k")]).alias("j", "m")).select((F.col("k") * (d + 1) + F.col("j")).alias("k"), F.col("fp").bitwiseAND(F.col("m")).alias("v"), "fp")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, d: int = 2, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """Rows (id, th, fp) of all documents, and of each fingerprint (fp, comp, first, low, n).

    comp names the component, first is its smallest id, low the smallest id with this fingerprint, n its rows. Null
    and empty texts have fingerprint zero and are linked like any other. Repeated ids are rows like others; null ids
    are passed over by the minima (null if there is no other). Extra columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, id_col, text_col, shingle, seed), "rows")
    classes = scratch.keep(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "classes")
    comps = connected_components(near_links(classes, scratch, d, cap), scratch)
    named = classes.join(comps, classes["fp"] == comps["node"], "left").select("fp", F.coalesce("label", "fp").alias("comp"), "low", "n")
    named = scratch.keep(named, "named")
    least = named.groupBy("comp").agg(F.min("low").alias("first"))
    return rows, named.join(least, "comp").select("fp", "comp", "first", "low", "n")


def components(docs: DataFrame, **how) -> DataFrame:
    """One row a document: id, fingerprint (16 hex digits), component_id."""
    rows, classes = near_duplicates(docs, **how)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(classes, "fp").select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), F.col("first").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, with the smallest id of each component; one of them if that id is repeated."""
    rows, classes = near_duplicates(docs, id_col=id_col, text_col=text_col, **how)
    best = classes.where("low <=> first").groupBy("comp").agg(F.min("fp").alias("fp"))
    best = rows.join(best.join(classes.select("comp", "fp", "first"), ["comp", "fp"]), "fp").where("id <=> first")
    best = best.groupBy("fp", "id", "th").agg(F.count("*").alias("m")).groupBy("fp").agg(F.min(F.struct("id", "th", "m")).alias("x"))
    best = best.select("x.id", "x.th", "x.m")
    kept = packed(docs, id_col, F.xxhash64(F.col(text_col))).join(best, F.col("key").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("th")))
    # only rows that are repeated, id and text, are dealt out again to leave one of them
    one, more = kept.where("m = 1"), kept.where("m > 1").dropDuplicates(["id", "th"])
    return one.unionByName(more).select("row.*")
