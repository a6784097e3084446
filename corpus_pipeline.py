"""A training-data pipeline in four stages over ``documents``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next stage's ``docs``.  All but the last return the columns of
``documents``:

1. language_id: a text goes if no language is found in it (``und``, or a score under ``MIN_LANGUAGE``).
2. quality: a text goes if the quality classifier gives it less than ``MIN_QUALITY``.
3. near_dedup: of each group of near duplicates the document with the smallest id stays (of rows with
   the same id and text, one).
4. packing: the pieces of what is left, with their sequences (of tokens of the vocabulary of ``bpe``).

The classifiers are trained on the tables in ``sf_dir`` (the labelled rows they learn from elsewhere), not on
the stage's input, so each stage is the same function of a text whatever came before.

Defined cases: a null, empty or letterless text has no language and goes in stage 1 (a table without a labelled language
keeps every text with a letter).  A null id is judged like any other; it is no one's copy and stays in stage 3.  Rows that are
equal in id and text are one document: one stays.  Texts of any length are read whole.  Ties of copies go to the
smallest id.  Columns beside those of ``documents`` stay, whatever their names, until stage 4, which has its own.  Without a
label of quality every text scores 0.5 and stays.  Empty tables give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quern.llm import common, langid, neardup, packing, quality_classifier

MIN_LANGUAGE, MIN_QUALITY = 0.4, 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(common.documents(spark, sf_dir).where(common.id_fold("doc_id", 5) != 0))
    return langid.filter_documents(docs, model, MIN_LANGUAGE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(common.id_fold("doc_id", 3) != 1)
    model = quality_classifier.train(common.documents(spark, sf_dir), labels)
    return quality_classifier.filter_documents(docs, model, MIN_QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_representatives(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("quality", quality), ("near_dedup", near_dedup), ("packing", pack)]

#: The trained stages cannot be written as SQL; tests/llm holds the pipeline against its stages' brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns stands as Parquet in the shared checkpoint folder."""
    common.prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
