"""Exact dedup by skew-safe combining, with DataFrame functions only.

Texts meet in three steps, and each of them compares the whole normalised text beside its digest: a task first combines the
equal texts that it read itself (the partial aggregate before the shuffle), then what tasks of one salt found meets by digest,
salt and text, and at last the winners of all salts meet by digest and text. A text that a third of all rows share reaches the
last step as one row per salt.

Rows find their group again by digest alone, without shuffling texts a third time. That is exact because the groups tell
which digests stand for more than one text; should there be any, rows with these digests are joined by their whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.session import staged

_GROUP = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def normalised(text: Column) -> Column:
    """The text with each run of blanks as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def equal_texts(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, text, keep_id, group_size): one row per different text of ``rows`` (doc_id, text, digest)."""
    local = rows.withColumn("salt", F.spark_partition_id() % salts)  # one salt a task, so that tasks combine all they read
    salted = local.groupBy("digest", "salt", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return salted.groupBy("digest", "text").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _grouped(rows: DataFrame, salts: int) -> DataFrame:
    """``rows`` with group, keep_id and group_size; all three are null where no other row has the text."""
    kinds = staged(equal_texts(rows, salts).select("digest", "keep_id", "group_size", F.monotonically_increasing_id().alias("group")),
                   "kinds")
    shared = staged(kinds.groupBy("digest").count().where("count > 1").select("digest"), "shared")
    found = rows.drop("text").join(kinds.where("group_size > 1"), "digest", "left")
    if shared.isEmpty():
        return found
    clashing = staged(rows.join(shared, "digest", "left_semi"), "clashing")
    kinds = staged(equal_texts(clashing, salts).where("group_size > 1").withColumn("group", -1 - F.monotonically_increasing_id()), "kinds")
    return found.join(shared, "digest", "left_anti").unionByName(clashing.join(kinds, ["digest", "text"], "left").drop("text"))


def _verdicts(docs: DataFrame, salts: int, digest: Callable[[Column], Column], *more: Column) -> DataFrame:
    rows = docs.select("doc_id", normalised(F.col("text")).alias("text"), *more)
    rows = rows.select("*", digest(F.col("text")).alias("digest"))
    if digest is not sha256:
        rows = rows.withColumn("sha", sha256(F.col("text")))
    found = _grouped(rows, salts).select(
        "*", F.monotonically_increasing_id().alias("row"),
        (F.col("group").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("least"))
    found = staged(found, "verdicts")
    # Rows that repeat the smallest doc_id of a group: the first of them stays.
    first = (found.where("least AND group IS NOT NULL").groupBy("group").agg(F.min("row").alias("first"), F.count("*").alias("ties"))
             .where("ties > 1").select("group", "first"))
    sha = F.lower(F.hex("digest" if digest is sha256 else "sha"))
    grouped = found.where("group IS NOT NULL").join(first, "group", "left").select(
        *[F.col(c) for c in ("doc_id", "keep_id", "group_size")],
        (F.col("least") & (F.col("first").isNull() | (F.col("first") == F.col("row")))).alias("kept"), sha.alias("text_sha256"),
        *[c for c in found.columns if c == "whole"])
    # Rows whose text is their own need no partner, and would all meet under the null group.
    alone = found.where("group IS NULL").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        sha.alias("text_sha256"), *[c for c in found.columns if c == "whole"])
    return grouped.unionByName(alone)


def exact_duplicates(docs: DataFrame, salts: int = 64, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``, dropped ones too.

    Texts are equal when they are identical after replacing each run of blanks by one space; null is an empty text, so all
    null and empty texts are one group. Of a group exactly one row stays, one with the smallest doc_id, ``keep_id``; rows
    without an id stay only in groups without any id (``keep_id`` is null then). Of rows that repeat that id, one stays.
    Other columns of ``docs`` are left out, whatever their names. An empty table gives no rows. ``digest`` may be any
    function of the normalised text: a weak one costs time, never a wrong result.
    """
    return _verdicts(docs, salts, digest).select(*_GROUP)


def drop_exact_duplicates(docs: DataFrame, salts: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they were."""
    kept = _verdicts(docs, salts, sha256, F.struct(*[docs[c] for c in docs.columns]).alias("whole")).where("kept")
    return kept.select("whole.*")
