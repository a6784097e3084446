"""The operators applied to whole tables with production parameters: op1 to op10, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import ann, bpe, common, html_extract, langid, lm, neardup, packing, quality_classifier, quality_rules, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held_out = common.id_fold("doc_id", 5) == 0
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(common.documents(spark, sf_dir))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(common.documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = common.id_fold("doc_id", 5) == 0
    model = toxicity.train(docs, labels.where(~held_out))
    return toxicity.classify(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "score", "predicted")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(common.documents(spark, sf_dir))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return lm.score(docs, lm.train(docs))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = common.id_fold("doc_id", 3) == 1
    model = quality_classifier.train(docs, labels.where(~held_out))
    return quality_classifier.classify(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "score", "predicted")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": op1_language_id,
        "op2_bpe_round_trip": op2_bpe_round_trip,
        "op3_html_extraction": op3_html_extraction,
        "op4_minhash_dedup": op4_minhash_dedup,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_toxicity": op6_toxicity,
        "op7_quality_rules": op7_quality_rules,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_nearest_neighbours": op10_nearest_neighbours,
    }


#: Exact links from the shingles' inverted lists, and their transitive closure.
NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
roots AS (SELECT doc_id, min(other) AS root FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(root, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(root, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN roots r ON r.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query on whole tables; the others are tested by brute force in tests/llm."""
    return {"op4_minhash_dedup": NEAR_DUPLICATES_SQL}
