"""The pipeline against its stages' own rules."""

from pyspark.sql import functions as F

import corpus_pipeline
from millwright.llm import decontaminate, simhash

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("rank", F.lit("extra"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        if name != "mixing":
            assert out.columns == docs.columns
            assert out.join(docs, "doc_id", "left_anti").count() == 0
        seen[name], docs = out, out
    kept = seen["near_dedup"]
    groups = simhash.near_duplicates(seen["line_dedup"])
    assert kept.count() == groups.select("component_id").distinct().count()
    clean = decontaminate.contamination(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).where("NOT contaminated")
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in seen["decontamination"].collect()}
    assert docs.count() == seen["decontamination"].count()


def test_stages_on_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, "x y"), (3, "a\nb"), (3, "a\nb"), (4, "c\na\nb")]
    docs = spark.createDataFrame([(i, t, "en", None, 0, 1, 5, 6) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, bucket long, removed_lines long, "
                                 "__gone long")
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, SF)
            rows = out.count()
            assert rows <= d.count()
            d = out if name != "mixing" else d


def test_rows_without_an_id_are_judged(spark):
    """A benchmark passage goes with or without an id; a document with an id stays before one without."""
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    docs = spark.createDataFrame([(1, passage), (None, passage), (2, "clean words only"), (None, "other clean words")],
                                 "doc_id long, text string")
    kept = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert sorted(r.text for r in kept.collect()) == ["clean words only", "other clean words"]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "other clean words"), (1, passage), (2, "clean words only")]
