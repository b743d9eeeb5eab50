"""Five stages over ``documents``: toxicity, line dedup, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept and returns a DataFrame, which is
written as Parquet and reread for the next one. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from millwright.llm.common import load
from millwright.session import staged

#: Keys of rows without a doc_id start here.
_NO_ID = 1 << 62


def _key(docs: DataFrame) -> Column:
    """The doc_id of a row; where it is null, a number above all real ids from a hash of the text."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID) + F.pmod(F.xxhash64(docs["text"]), F.lit(_NO_ID)))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key(docs).alias("doc_id"), "text")


def _kept(docs: DataFrame, verdicts: DataFrame, keep: Column) -> DataFrame:
    """Rows of ``docs`` unless ``verdicts`` (doc_id, ...), of the keyed rows, rejects theirs."""
    rejected = staged(verdicts.where(~keep).select(F.col("doc_id").alias("__rejected")).distinct(), "rejected")
    return docs.join(rejected, _key(docs) == rejected["__rejected"], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go, also those without an id."""
    model = toxicity.train(docs, load(spark, sf_dir, "labels"))
    return _kept(docs, toxicity.score_documents(_keyed(docs), model), F.col("score") < 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of two or more lines, or of one line of 13 or more words, go from the texts.

    Every document stays, ``n_chars`` is counted anew. Texts of rows without an id stay as they are.
    """
    count = max(docs.columns, key=len) + "_removed"  # no column of docs
    kept = line_dedup.remove_repeated_lines(docs, count=count)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHashes of three-word shingles, at most three bits apart, the one with the smallest doc_id stays.

    A document without an id gives way to those with one; rows that repeat an id, or have none and the same text, are one document.
    """
    return _kept(docs, simhash.near_duplicates(_keyed(docs)), F.col("doc_id") == F.col("component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go, also those without an id."""
    return _kept(docs, decontaminate.contamination(_keyed(docs), load(spark, sf_dir, "benchmark")), ~F.col("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document with the words taken of it, repeats counted."""
    return mixing.mix_sources(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("mixing", mix)]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
