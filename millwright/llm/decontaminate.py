"""Benchmark decontamination with a positional inverted index. DataFrame functions only.

Each benchmark window (13 words, or a whole shorter item) is looked up by its rarest term in the training corpus. The
index holds the positions of these terms in all documents, each posting with the words around it; postings shifted by
the term's place in the window are intersected with the next rarest term, then with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.session import staged

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; empty for null."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(low, _GAP, -1), "")


def _blocks(terms: DataFrame, most: int) -> list[DataFrame]:
    """``terms`` (distinct) in parts of about ``most``, so that each may be broadcast whatever the benchmark's size."""
    n = max(1, -(-terms.count() // most))
    return [terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i) for i in range(n)]


def windows(items: DataFrame, size: int = 13) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (phrase, terms) of ``items`` (item_id, text), and who holds them (phrase, item_id)."""
    at = items.select("item_id", words(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("terms") - (size - 1)))
    all_ = at.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("terms", i, size))).alias("terms"))
    held = staged(all_.select(F.array_join("terms", " ").alias("phrase"), "terms", "item_id").distinct(), "held")
    return held.select("phrase", "terms").distinct(), held.select("phrase", "item_id")


def term_counts(docs: DataFrame, terms: DataFrame, most: int = 20_000) -> DataFrame:
    """(term, n): occurrences of ``terms`` in all whole texts; terms that never occur are absent."""
    split = docs.select(F.explode(words(F.col("text"))).alias("term"))
    parts = [split.join(F.broadcast(b), "term").groupBy("term").agg(F.count("*").alias("n")) for b in _blocks(terms, most)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def positional_index(docs: DataFrame, terms: DataFrame, reach: int = 12, most: int = 20_000) -> DataFrame:
    """(term, doc_id, pos, before, around): where ``terms`` stand in all whole texts, from word 0.

    ``around`` has up to ``reach`` words on either side, ``before`` of them in front of the term.
    """
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"))
    split = split.select("doc_id", "words", F.posexplode("words").alias("pos", "term"))
    before = F.least(F.col("pos"), F.lit(reach))
    parts = [split.join(F.broadcast(b), "term").select(
        "term", "doc_id", "pos", before.alias("before"),
        F.slice("words", F.col("pos") - before + 1, before + reach + 1).alias("around")) for b in _blocks(terms, most)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def phrase_matches(docs: DataFrame, phrases: DataFrame, size: int = 13) -> DataFrame:
    """(doc_id, phrase, start, length): every place in ``docs`` where the words of a phrase (phrase, terms) stand."""
    spread = staged(phrases.select("phrase", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term")),
                    "spread")
    counts = staged(term_counts(docs, spread.select("term").distinct()), "counts")
    # A phrase with a term that never occurs cannot occur; the others are ordered from the rarest term on.
    order = (spread.join(counts, "term").groupBy("phrase", "length")
             .agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("by_rarity"))
             .where(F.size("by_rarity") == F.col("length")))
    plan = staged(order.select("phrase", "length", F.col("by_rarity")[0]["term"].alias("term"),
                               F.col("by_rarity")[0]["offset"].alias("offset"),
                               F.get("by_rarity", F.lit(1)).alias("second")), "plan")
    index = staged(positional_index(docs, plan.select("term").distinct(), size - 1), "postings")
    hits = index.join(plan.join(phrases, "phrase"), "term")
    first = F.col("before") - F.col("offset")  # where the phrase would begin in ``around``
    second = F.col("second").isNull() | (
        F.get("around", first + F.col("second")["offset"]) == F.col("second")["term"])
    return hits.where((first >= 0) & second).where(F.slice("around", first + 1, F.col("length")) == F.col("terms")).select(
        "doc_id", "phrase", (F.col("pos") - F.col("offset")).alias("start"), "length")


def proximity_matches(docs: DataFrame, items: DataFrame, n_terms: int = 3, span: int = 20) -> DataFrame:
    """(doc_id, item_id) where the ``n_terms`` rarest distinct terms of an item stand within ``span`` words.

    Items with fewer distinct terms, or with one of these absent from the corpus, have no matches.
    """
    spread = staged(items.select("item_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).distinct(),
                    "spread")
    counts = term_counts(docs, spread.select("term").distinct())
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("n", F.lit(0)), "term"))
    rare = staged(spread.join(counts, "term", "left").withColumn("rank", rank).where(F.col("rank") <= n_terms)
                  .select("item_id", "term", "rank"), "rare")
    index = positional_index(docs, rare.select("term").distinct(), 0).select("term", "doc_id", "pos")
    near = Window.partitionBy("doc_id", "item_id").orderBy("pos").rangeBetween(-span + 1, 0)
    return (index.join(rare, "term").withColumn("seen", F.size(F.collect_set("rank").over(near)))
            .where(F.col("seen") >= n_terms).select("doc_id", "item_id").distinct())


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per input row.

    A word is hit when it lies in an occurrence of a window; ``n_items`` counts the items with such windows. A document
    is contaminated from one hit word in ``share`` on. Null and empty texts have no words and are clean, as are rows
    without a doc_id; items without words have no windows; an empty benchmark leaves every document clean. Rows that
    repeat a doc_id are taken for copies of one document.
    """
    phrases, held = windows(items, size)
    phrases = staged(phrases, "phrases")
    found = staged(phrase_matches(docs.where("doc_id IS NOT NULL"), phrases, size).distinct(), "found")
    ahead = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    spans = found.groupBy("doc_id", "start").agg(F.max("length").alias("length"))
    fresh = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(ahead), F.lit(0))))
    hit = spans.withColumn("fresh", fresh).groupBy("doc_id").agg(F.sum("fresh").alias("n_hit"))
    names = (found.select("doc_id", "phrase").distinct().join(held, "phrase").select("doc_id", "item_id").distinct()
             .groupBy("doc_id").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items")))
    hits = staged(hit.join(names, "doc_id").select(F.col("doc_id").alias("__doc"), "n_hit", "items"), "hits")
    total = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return total.join(hits, F.col("doc_id") == F.col("__doc"), "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))
