"""The registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalune.llm.common import table

PSEUDONYM_KEY = "catalune-demonstration-key"  #: for the query on synthetic data; pass a secret of your own


def op1_url_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from catalune.llm.urltree import judge

    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), bad=F.col("quality") == 0)


def op2_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catalune.llm.nbsvm import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catalune.llm.pseudonyms import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents"), key=PSEUDONYM_KEY)


def op4_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catalune.llm.simhash import components

    return components(table(spark, sf_dir, "documents"), d=2, shingle=3, seed=42)


def op5_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catalune.llm.mixing import mixture

    return mixture(table(spark, sf_dir, "documents"))


def op6_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catalune.llm.isoforest import train_and_judge

    return train_and_judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catalune.llm.langzip import language

    return language(table(spark, sf_dir, "documents"))


def op8_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catalune.llm.fmindex import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op9_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from catalune.llm.crf import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from catalune.llm.tokenstore import token_output

    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "at")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2].isdigit()}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op8_fm_index": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
       iw AS (SELECT item_id, least(len(w), 13) AS l, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0),
       k AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS key FROM iw), ls AS (SELECT DISTINCT l FROM k),
       x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
       y AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS a FROM x),
       z AS (SELECT doc_id, i, l, array_to_string(a[1:l], ' ') AS key FROM y, ls WHERE len(a) >= l),
       h AS (SELECT doc_id, i, l, item_id FROM z JOIN k USING (l, key)),
       p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS pos FROM h) GROUP BY doc_id),
       n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT cast(item_id AS VARCHAR), ',' ORDER BY cast(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
       SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
       FROM d LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    """Only the FM-index's result can be said in SQL; the others are tested against brute force."""
    return ORACLE
