"""Token-ID output: bit-plane shuffled id blocks, one zstandard frame a plane, with a chunk index.

File: 8 bytes ``BPLANES1``; the frames of all chunks; a footer (zstandard of JSON: mode, block, chunks as
``[offset, ids, crc32 of the raw ids, [bytes of each plane]]``, then the documents' ids and lengths); its length as
unsigned 64 bits; ``BPLANES1`` again. Ids are unsigned 32-bit. Byte mode has 4 planes, bit mode 32.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalune.llm.common import Scratch, as_bytes, open_at, slices

MAGIC = b"BPLANES1"
CACHE = 1_000_000  #: pieces of text whose ids a worker keeps; beyond it the cache starts anew


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """The planes of one block of unsigned 32-bit ids, lowest first."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [p.tobytes() for p in np.ascontiguousarray(rows.T)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        rows = np.ascontiguousarray(np.frombuffer(b"".join(planes), np.uint8).reshape(4, n).T)
    else:
        packed = np.frombuffer(b"".join(planes), np.uint8).reshape(32, -1)
        bits = np.unpackbits(packed, axis=1, count=n, bitorder="little")
        rows = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return rows.reshape(-1).view("<u4")


class Writer:
    """Streams ids into a file; memory holds one block."""

    def __init__(self, out, block: int, mode: str, level: int = 3):
        self.out, self.block, self.mode = out, block, mode
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at, self.chunks, self.docs, self.lengths, self.wait, self.n = len(MAGIC), [], [], [], [], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, raw: bytes) -> None:
        """raw: one document's ids, little-endian unsigned 32-bit."""
        self.docs.append(doc_id)
        self.lengths.append(len(raw) // 4)
        self.wait.append(raw)
        self.n += len(raw) // 4
        if self.n >= self.block:
            ids = np.frombuffer(b"".join(self.wait), "<u4")
            full = len(ids) // self.block * self.block
            for i in range(0, full, self.block):
                self._chunk(ids[i : i + self.block])
            self.wait, self.n = [ids[full:].tobytes()], len(ids) - full

    def _chunk(self, ids: np.ndarray) -> None:
        frames = [self.zip.compress(p) for p in to_planes(ids, self.mode)]
        self.chunks.append([self.at, len(ids), zlib.crc32(ids.tobytes()), [len(f) for f in frames]])
        for f in frames:
            self.out.write(f)
            self.at += len(f)

    def close(self) -> None:
        if self.n:
            self._chunk(np.frombuffer(b"".join(self.wait), "<u4"))
        foot = self.zip.compress(json.dumps({"mode": self.mode, "block": self.block, "chunks": self.chunks, "docs": self.docs, "lengths": self.lengths}).encode())
        self.out.write(foot + struct.pack("<Q", len(foot)) + MAGIC)


class Reader:
    """Reads a file's footer, then any chunk by its index."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        file.seek(size - 16)
        (n,), magic = struct.unpack("<Q", file.read(8)), file.read(8)
        if magic != MAGIC:
            raise ValueError("not a bit-plane token file, or cut off")
        file.seek(size - 16 - n)
        self.unzip = zstandard.ZstdDecompressor()
        foot = json.loads(self.unzip.decompress(file.read(n)))
        self.mode, self.chunks, self.docs, self.lengths = (foot[k] for k in ("mode", "chunks", "docs", "lengths"))

    def chunk(self, k: int) -> np.ndarray:
        at, n, crc, sizes = self.chunks[k]
        self.file.seek(at)
        ids = from_planes([self.unzip.decompress(self.file.read(s)) for s in sizes], n, self.mode)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        have, k = np.empty(0, "<u4"), 0
        for doc, n in zip(self.docs, self.lengths, strict=True):
            parts, got = [have], len(have)
            while got < n:
                parts.append(self.chunk(k))
                got += len(parts[-1])
                k += 1
            have = np.concatenate(parts) if len(parts) > 1 else parts[0]
            yield doc, have[:n]
            have = have[n:]


class PieceEncoder:
    """The tokenizer's ids of texts, piece by piece.

    Valid for tokenizers that drop white space, never join text across it, take each digit by itself and ignore the
    case of A-Z (word_bpe_49k.json does): a text's ids are then those of its pieces between ASCII white space.
    Repeated pieces are looked up; new ones are encoded together, a 0 between them, and parted at its id. Full stops
    and commas after an ASCII letter or digit are tokens of their own. A text with ``<|`` may hold a special token,
    whose case counts, and is encoded as it is. PROBES tell whether a tokenizer is like this when the encoder is made;
    with any other one, whole texts are encoded (``whole``).
    """

    PROBES = ["Hello WORLD hello", "a\tb\nc\x0bd\x0c e\r\n  f", "x1y22 333 4,567.89", "Na\u00efve CAF\u00c9 \u6f22\u5b57 \u4f60 word, and. end.", "don't stop... a,b (c) [d] _e_ f-g", "  lead and trail  ", "\U0001f600 ok \u00e9\u0301", "http://a.b/c?d=e#f 10% $5", "", " ", "ab.", "ab,,", "1.", "\u00e9."]

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok, self.known, self.whole = Tokenizer.from_file(path), {}, False
        zero = self._ids(["0"])[0]
        self.zero = zero[0] if len(zero) else np.uint32(0)
        try:
            by_piece = list(self.encode([p.encode() for p in self.PROBES], b""))
        except ValueError:  # the 0 between pieces is no token of its own
            by_piece = []
        self.whole = len(zero) != 1 or by_piece != [x.tobytes() for x in self._ids(self.PROBES)]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[bytes]) -> None:
        new = sorted(pieces.difference(self.known))
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = sorted(pieces)
        ends = [(p, c) for p in new if (c := p.rstrip(b".,")) != p and c and c[-1:].isalnum()]
        cut = {p for p, _ in ends}
        need = list(dict.fromkeys(q for q in [*(p for p in new if p not in cut), *(x for p, c in ends for x in (c, p[len(c) :]))] if q not in self.known))
        alone = [q for q in need if b"0" in q]
        for q, ids in zip(alone, self._ids([q.decode(errors="replace") for q in alone]), strict=True):
            self.known[q] = ids.tobytes()
        rest = [q for q in need if b"0" not in q]
        for i in range(0, len(rest), 200):
            part = rest[i : i + 200]
            (ids,) = self._ids([b" 0 ".join(part).decode(errors="replace")])
            raw, at = ids.tobytes(), 0
            for q, z in zip(part, [*(np.flatnonzero(ids == self.zero) * 4).tolist(), len(raw)], strict=True):
                self.known[q] = raw[at:z]
                at = z + 4
        for p, c in ends:
            self.known[p] = self.known[c] + self.known[p[len(c) :]]

    def encode(self, texts: list[bytes], end: bytes) -> Iterator[bytes]:
        """What is new in all the texts is learned first, so pass a few hundred at a time."""
        split = [None if self.whole or b"<|" in t else t.lower().split() for t in texts]
        words: set[bytes] = set()
        words.update(*filter(None, split))
        self._learn(words)
        for text, pieces in zip(texts, split, strict=True):
            yield (self._ids([text.decode(errors="replace")])[0].tobytes() if pieces is None else b"".join(map(self.known.__getitem__, pieces))) + end


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This process's encoder: what one task has learned serves the worker's next ones."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, tokenizer: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, block: int = 65_536, mode: str = "byte") -> list[dict]:
    """Writes the ids of all texts in ascending order of ids (nulls first; equal ids by text); what files there are.

    Texts are dealt into ranges of the id (and a hash of the text, so that a repeated id is split too), sorted, and
    each range is streamed into one file of the shared folder, renamed when whole: a lost task is simply run again.
    Null texts are empty. Only one short row a file comes to the driver: shard, path, docs, ids.
    """
    where, end = scratch.path, np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").drop("h")

    def run(batches):
        ctx = TaskContext.get()
        enc, w, n, docs_n = None, None, 0, 0
        name = f"{where}/shard-{ctx.partitionId():06d}.bps"
        for b in batches:
            if not b.num_rows:
                continue
            if w is None:
                system, path = open_at(name)
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                tmp = f"{path}.{ctx.taskAttemptId()}"
                out = system.open_output_stream(tmp)
                enc, w = encoder(tokenizer), Writer(out, block, mode)
            for part in slices(b, rows=500):
                for doc, raw in zip(part.column("id").to_pylist(), enc.encode(as_bytes(part, "text"), end), strict=True):
                    w.add(doc, raw)
                    n += len(raw) // 4
                    docs_n += 1
        if w is not None:
            w.close()
            out.close()
            system.move(tmp, path)
            yield pa.RecordBatch.from_pylist([{"shard": ctx.partitionId(), "path": name, "docs": docs_n, "ids": n}])

    got = rows.mapInArrow(run, "shard long, path string, docs long, ids long").collect()
    return [r.asDict() for r in sorted(got, key=lambda r: r["shard"])]


def read_tokens(spark, files: list[dict]) -> DataFrame:
    """One row a document of written files: doc_id, start, n_tokens, ids_crc32, shard, at (its place in the file)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, at long"
    starts = np.cumsum([0] + [f["ids"] for f in files]).tolist()
    plan = [(f["shard"], f["path"], s) for f, s in zip(files, starts, strict=False)]
    if not plan:
        return spark.createDataFrame([], schema)
    todo = spark.createDataFrame(plan, "shard long, path string, start long").repartition(len(plan))

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                system, path = open_at(row["path"])
                with system.open_input_file(path) as f:
                    r, at, out = Reader(_Seekable(f)), 0, []
                    for doc, ids in r.documents():
                        out.append({"doc_id": doc, "start": row["start"] + at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes()), "shard": row["shard"], "at": at})
                        at += len(ids)
                        if len(out) >= 5000:
                            yield pa.RecordBatch.from_pylist(out, schema=_OUT)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=_OUT)

    return todo.mapInArrow(run, schema)


_OUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32", "shard", "at")])


class _Seekable:
    """seek() that tells the place, over a pyarrow file."""

    def __init__(self, f):
        self.f, self.read = f, f.read

    def seek(self, at: int, whence: int = 0) -> int:
        self.f.seek(at, whence)
        return self.f.tell()


def token_output(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """write_tokens, then read_tokens of the files written."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, tokenizer, Scratch(spark, "tokens"), **how))
