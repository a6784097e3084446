"""The pipeline against its stages' own brute force on the smallest tables."""

import pytest

from conftest import DATA, needs_data
from test_text_operators import brute_groups

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from quern.llm import common, langid, packing, quality_classifier  # noqa: E402


@needs_data
def test_stages_and_run(spark, tmp_path):
    sf = str(DATA)
    docs = common.documents(spark, sf)
    every = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = langid.train(docs.where(common.id_fold("doc_id", 5) != 0))
    spoken = {r["doc_id"] for r in langid.identify(docs, model).collect() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.MIN_LANGUAGE}
    good = {r["doc_id"] for r in quality_classifier.classify(docs, quality_classifier.train(docs, spark.read.parquet(f"{sf}/labels.parquet").where(common.id_fold("doc_id", 3) != 1))).collect() if r["score"] >= corpus_pipeline.MIN_QUALITY}
    groups, _ = brute_groups({i: t for i, t in every.items() if i in spoken & good})
    want = {i for i, g in groups.items() if i == g}
    left, kept = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, left, sf).write.parquet(str(tmp_path / str(k)))
        left = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r[0] for r in left.select("doc_id").collect()})
        assert name == "packing" or left.columns == docs.columns
    assert kept[0] == spoken and kept[1] == spoken & good and kept[2] == want and kept[3] == want
    assert 0 < len(want) < len(every)
    key = lambda r: (r["doc_id"], r["piece"], r["bin"], r["bin_offset"])
    assert sorted(map(key, corpus_pipeline.run(spark, sf).collect())) == sorted(map(key, left.collect()))
    assert sorted(map(key, packing.pack_documents(docs.where(docs.doc_id.isin(list(want)))).collect())) == sorted(map(key, left.collect()))


def test_repeated_rows_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "some words that are said more than once in this table of ours"
    docs = spark.createDataFrame([(2, text, "en", "a", 1), (2, text, "en", "a", 1), (3, text + " today", "en", "b", 1), (None, text, "en", "b", 1), (5, None, None, None, None)], schema)
    rows = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["2", "5", "None"]
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
