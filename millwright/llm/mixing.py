"""Mixing sources to target weights with Efraimidis-Spirakis keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.llm.common import WORD
from millwright.session import staged

#: Characters that prose hardly uses; their share lowers a document's quality weight.
SYMBOLS = "#$%&*@^~|<>{}=+_"
MOST_EPOCHS = 3


def quality_weight(text: Column) -> Column:
    """Between 0.25 and 1: 1 without symbols, least from 7.5% symbols on."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.greatest(F.lit(0.25), F.lit(1.0) - F.lit(10.0) * symbols / F.greatest(F.length(text), F.lit(1)))


def exponential_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash of the id: the smallest keys are a weighted sample."""
    hashed = F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13),
                    16, 10).cast("double")
    return -F.log((hashed + 0.5) / float(1 << 52)) / weight


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target, full) from (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share all sizes; no target exceeds ``most`` times
    its source's size, and what is cut off goes to the others by weight until none exceeds it. Sources are few against
    documents, so they are ranked together. Sources of size 0 have target 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    # Filling up by ratio: sources reach their caps in the order of cap / weight, so one ordered pass finds the level.
    rise = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.sum("source_size").over(Window.partitionBy())
                               - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                     / (F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(
        Window.partitionBy())["level"]
    s = s.withColumn("share", level * F.col("weight")).withColumn(
        "full", F.col("share").isNull() | (F.col("share") >= F.col("cap")))
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double"))
                    .otherwise(F.col("share")).alias("target"), "full")


def mix_sources(docs: DataFrame, seed: int = 7, weight: Column | None = None, per_bucket: int = 2_000) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row per input row; ``taken`` counts words.

    Every document is taken for as many complete epochs as its source's target holds. The rest goes to documents in the
    order of their exponential keys until the budget is used up; the last of them gives only the words still needed, so
    a source misses its target by less than a word. Prefix sums run inside buckets of the key, then over the buckets,
    so a hot source is split. Keys depend on doc_id and ``seed`` alone, ties are ordered by size: reruns agree.
    Null texts have size 0 and take nothing; a null source is a source; an empty table gives no rows.
    """
    weight = quality_weight(F.col("text")) if weight is None else weight
    text = F.coalesce(F.col("text"), F.lit(""))
    key = exponential_key(F.col("doc_id"), weight, seed)
    sized = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source",
                               F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key")), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("members"))
    targets = staged(source_targets(totals.select("source", "source_size")), "targets")
    buckets = max(1, (sized.count() + per_bucket - 1) // per_bucket)
    bucket = F.floor(F.sqrt(F.exp(-F.col("key"))) * -buckets)  # the smallest keys first
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rows = rows.withColumn("bucket", bucket).withColumn("epochs", F.when(F.col("full"), F.lit(MOST_EPOCHS)).otherwise(
        F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))))).withColumn(
        "budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = staged(sums.select(F.col("source").alias("in_source"), F.col("bucket").alias("in_bucket"),
                              F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base")), "sums")
    inside = (Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("prefix", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("in_source")) & (F.col("bucket") == F.col("in_bucket")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("base") - F.col("prefix")))
    return rows.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))
