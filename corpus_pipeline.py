"""The corpus pipeline: quality, near duplicates, contamination, mixing, token output.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept, and returns a DataFrame; all but the
last return the columns of documents. Models are fitted to the labelled rows of docs itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalune.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more."""
    from catalune.llm.nbsvm import keep_good, train

    return keep_good(docs, train(docs, table(spark, sf_dir, "labels"), F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id."""
    from catalune.llm.simhash import keep_first

    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to be contaminated."""
    from catalune.llm.fmindex import drop_contaminated

    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    from catalune.llm.mixing import repeat_documents

    return repeat_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' documents: doc_id, start, n_tokens, ids_crc32, shard, at."""
    import public_tokenizers

    from catalune.llm.tokenstore import token_output

    return token_output(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("near-dedup", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token output", tokens)]
ORACLE_SQL = None  # no stage but the second and third could be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
