"""Repeated line runs by prefix doubling over line-ID sequences. DataFrame functions only.

Every line is an ID, every position of a document starts a suffix of IDs. Suffixes are ranked by their first line, then
by their first 2, 4, ... lines: the rank of a longer prefix orders pairs of ranks of shorter ones. Suffixes whose prefix
is unique leave, so only repeated text is carried on. Doubling ends as soon as prefixes of ``min_lines`` lines are
ranked: suffixes of equal rank then form the intervals whose longest common prefix has at least that many lines, which
is all that deciding about runs of ``min_lines`` or more needs. A run of one line counts when the line is a passage of its
own, of ``min_words`` words: for these the intervals of the first ranking are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.llm.common import WORD
from millwright.session import staged


def _ranked(keys: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``rank``, the place of each distinct key in sorted order: by range partitions, then their offsets."""
    parts = staged(keys.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offset = parts.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*by))
    return parts.withColumn("nr", inside).join(offset, "part").select(*by, (F.col("offset") + F.col("nr")).alias("rank"))


def _rank_repeated(rows: DataFrame, by: list[str], *more: str) -> DataFrame:
    """(doc_id, line, more..., rank) of the rows whose key repeats; counts are taken before any shuffle of rows."""
    repeated = rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by)
    return rows.join(_ranked(repeated, by), by).select("doc_id", "line", *more, "rank")


def _suffixes(docs: DataFrame, min_lines: int, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Repeated suffixes by their first line, if it has ``min_words`` words, and by their first ``min_lines`` lines."""
    lines = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("line", "value"))
    # Words and the blanks between them need 2 * min_words - 1 characters; shorter lines aren't counted.
    passage = (F.length("value") >= 2 * min_words - 1) & (F.regexp_count("value", F.lit(WORD)) >= min_words)
    lines = staged(lines.select("doc_id", "line", passage.alias("passage"), F.unhex(F.md5("value")).alias("id")), "lines")
    now = staged(_rank_repeated(lines, ["id"], "passage").distinct(), "ranks")
    single, now, length = now.where("passage").drop("passage"), now.drop("passage"), 1
    while length < min_lines:
        step = min(length, min_lines - length)
        after = now.select("doc_id", (F.col("line") - step).alias("line"), F.col("rank").alias("then"))
        pairs = staged(now.join(after, ["doc_id", "line"]).select("doc_id", "line", "rank", "then"), "pairs")
        pairs = pairs.withColumnRenamed("rank", "here")
        now = staged(_rank_repeated(pairs, ["here", "then"]), "ranks")
        length += step
    return single, now


def repeated_suffixes(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """(doc_id, line, rank) of all suffixes that share their first ``min_lines`` lines with another one.

    Ranks order suffixes by these lines (by line ID). Rows without a doc_id or text have no suffixes; rows that repeat a
    doc_id are one document.
    """
    return _suffixes(docs, min_lines, 1)[1]


def later_copies(suffixes: DataFrame) -> DataFrame:
    """(doc_id, line) of the suffixes of each interval but the first in document order; the first is a minimum."""
    first = staged(suffixes.groupBy("rank").agg(F.min(F.struct("doc_id", "line")).alias("first")), "first")
    return suffixes.join(first, "rank").where(F.struct("doc_id", "line") != F.col("first")).select("doc_id", "line")


def remove_repeated_lines(docs: DataFrame, min_lines: int = 2, min_words: int = 13,
                          count: str = "removed_lines") -> DataFrame:
    """``docs`` with later copies of repeated runs of at least ``min_lines`` lines deleted, and their number added as ``count``.

    A line goes when one of the ``min_lines`` runs it is in also starts earlier, in a smaller doc_id or higher up in the
    same document, or when it has ``min_words`` words or more and also stands earlier. Documents whose lines all go keep
    an empty text; null texts stay null, and rows without a doc_id stay as they are. All columns are kept, whatever their
    names; only ``text`` changes. A column of ``docs`` named like ``count`` gives way to it.
    """
    single, runs = _suffixes(docs, min_lines, min_words)
    later = later_copies(runs).select("doc_id", F.explode(F.sequence("line", F.col("line") + min_lines - 1)).alias("line"))
    gone = staged(later.unionByName(later_copies(single)).groupBy("doc_id").agg(F.collect_set("line").alias("gone")), "gone")
    # The list of deletions grows with the corpus, so it is joined by merging at every size and never broadcast.
    gone = gone.hint("merge")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # so that no name can clash
    rows = whole.join(gone, F.col("row.doc_id").cast("long") == gone["doc_id"], "left").select(
        "row", "gone", F.split("row.text", "\n", -1).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")
    text = F.when(F.col("gone").isNull() | F.col("row.text").isNull(), F.col("row.text")).otherwise(text)
    return rows.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != count],
                       F.coalesce(F.size("gone"), F.lit(0)).alias(count))
