"""Language ID by compression: the language whose zstandard raw-content dictionary makes the text smallest.

A dictionary is the words of whole training texts of one language, the most frequent last, where they are cheapest
to refer to. Texts are compressed in pieces with every dictionary and the sizes added up, so a long text keeps
depending on the dictionary. Narrow margins are rejected.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalune.llm.common import Scratch, as_bytes, fold, per_batch, slices

DICT_BYTES = 32 << 10  #: of a language's dictionary
TEXTS = 400  #: training texts of a language that are looked at, at most
PIECE = 2000  #: bytes that are compressed together
LEVEL = 12
MAX_LANGS = 2000  #: more are refused: the dictionaries, 32 KB each, are broadcast
MARGIN = 0.01  #: smaller shares of the second smallest size are rejected
_LETTER = re.compile(r"[^\W\d_]")


def folded(text: bytes) -> bytes:
    """Lower case of A-Z and single spaces: capitals and layout tell no language."""
    return b" ".join(text.lower().split())


class Model:
    """dicts: language -> dictionary bytes. Compressors are made where they are used."""

    def __init__(self, dicts: dict[str, bytes], piece: int = PIECE, level: int = LEVEL, margin: float = MARGIN):
        self.dicts, self.piece, self.level, self.margin, self._zips = dicts, piece, level, margin, None

    def __getstate__(self):
        return self.__dict__ | {"_zips": None}

    def sizes(self, text: bytes) -> dict[str, int]:
        if self._zips is None:
            self._zips = {}
            for lang, raw in sorted(self.dicts.items()):
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._zips[lang] = zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False, level=self.level)
        parts = [text[i : i + self.piece] for i in range(0, len(text), self.piece)]
        return {lang: sum(len(z.compress(p)) for p in parts) for lang, z in self._zips.items()}

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """Language, score (0 to 1), rejected. Ties go to the first name; ``und`` without text, letters or languages."""
        if text is None or not self.dicts or not _LETTER.search(text.decode(errors="replace")):
            return "und", 0.0, True
        got = self.sizes(folded(text))
        order = sorted(got, key=lambda k: (got[k], k))
        if len(order) == 1:
            return order[0], 1.0, False
        best, second = got[order[0]], got[order[1]]
        rel = np.array([got[k] for k in order], float) / best
        score = float(1 / np.exp(-40 * (rel - 1)).sum())
        return order[0], score, (second - best) < self.margin * second


def training_texts(docs: DataFrame, rows, lang_col: str, id_col: str, text_col: str, texts: int, scratch: Scratch) -> DataFrame:
    """(l, h, text): whole texts of at most ``texts`` rows of each language, those whose hash h of id and text is least.

    The languages' row counts tell below which hash a few times as many rows lie as are wanted; one scan gathers
    these, and only their hashes are ranked. So no task sees more than a bounded number of rows of a language, however
    many it has. Rows that are equal in id and text count once.
    """
    h = F.xxhash64(F.col(id_col), F.col(text_col))
    pool = docs.where(F.col(lang_col).isNotNull() & rows & (F.octet_length(text_col) > 0)).select(F.col(lang_col).alias("l"), h.alias("h"), F.col(text_col).alias("text"))
    counts = pool.groupBy("l").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    least, most = -(1 << 63), (1 << 63) - 1
    below = [(r["l"], most if r["n"] <= 4 * texts else least + int(2.0**64 * 3 * texts / r["n"])) for r in counts]
    few = docs.sparkSession.createDataFrame(below, "l string, below long")
    near = scratch.keep(pool.join(F.broadcast(few), "l").where(F.col("h") <= F.col("below")).groupBy("l", "h").agg(F.min("text").alias("text")), "near")
    rank = F.row_number().over(W.partitionBy("l").orderBy("h"))
    kept = near.select("l", "h").withColumn("i", rank).where(F.col("i") <= texts).drop("i")
    return near.join(kept, ["l", "h"], "left_semi")


def train(docs: DataFrame, rows, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", dict_bytes: int = DICT_BYTES, texts: int = TEXTS, **how) -> Model:
    """A dictionary of every language, from the whole texts of at most ``texts`` of its rows, the first by a hash of id
    and text.

    Words are counted on executors; a dictionary a language comes to the driver. Words in more of the texts come later,
    ties in order of bytes. Rows without language, without text or with an empty one teach nothing; an empty table
    gives a model without languages.
    """
    pool = training_texts(docs, rows, lang_col, id_col, text_col, texts, Scratch(docs.sparkSession, "languages"))

    def words(batches):
        for b in batches:
            for part in slices(b, rows=100):
                for lang, text in zip(part.column("l").to_pylist(), as_bytes(part, "text"), strict=True):
                    found = sorted(set(folded(text).split()))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.binary())], names=["l", "w"])

    # a word has a byte and the space after it at least
    order = W.partitionBy("l").orderBy(F.desc("n"), "w")
    top = pool.select("l", "text").mapInArrow(words, "l string, w binary").groupBy("l", "w").agg(F.count("*").alias("n")).withColumn("i", F.row_number().over(order)).where(F.col("i") <= dict_bytes // 2)
    found: dict[str, list] = {}
    for r in top.withColumn("upto", F.sum(F.octet_length("w") + 1).over(order.rowsBetween(W.unboundedPreceding, 0))).where(F.col("upto") <= dict_bytes).select("l", "i", "w").collect():
        found.setdefault(r["l"], []).append((r["i"], bytes(r["w"])))
    dicts = {lang: b" ".join(w for _, w in sorted(f, reverse=True)) + b" " for lang, f in found.items()}
    return Model({k: v for k, v in dicts.items() if v.strip()}, **how)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each row, from its text alone: repeated rows and null ids are rows like
    others, null texts and texts without a letter are ``und`` with score 0, ties go to the first name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        null = b.column("text").is_null().to_pylist()
        got = [shared.value.predict(None if n else t) for t, n in zip(as_bytes(b, "text"), null, strict=True)]
        cols = [pa.array(c, t) for c, t in zip(list(zip(*got, strict=True)) or [()] * 3, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "lang_pred", "score", "rejected"])

    return slim.mapInArrow(per_batch(one), f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def language(docs: DataFrame) -> DataFrame:
    """The contract's query: doc_id, held_out, lang_pred, score, and rejected (a narrow margin)."""
    model = train(docs, fold("doc_id", 3) != 1)
    return identify(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
