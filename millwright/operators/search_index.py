"""A stored search index that is kept up to date, and exact BM25 search that reads postings in order of their bounds.

The index is a set of sorted segments, one per refresh:

    <root>/postings/segment=<id>   (term, level, doc_id, scope, doc_len, tf), sorted by term and level
    <root>/levels/segment=<id>     (term, scope, level, n): how many postings a term has at each level
    documents, segments            keyed tables of a ``Store``: a document's newest segment, a segment's size

``level`` is a posting's impact (its share of a BM25 score before the term's weight) in steps of 1 / ``per_unit``, so the postings
of a term at one level are a block whose best score is known without reading it. A refresh tokenises only texts whose hash is new,
a deletion writes tombstones, and both are one commit; postings of replaced or deleted documents are told by their segment and
skipped. Segments of similar size, or all beyond a number, are merged, which drops what is dead.

A search never scores all pairs that share a term. First the best blocks of each query's terms give some documents, and the k-th
best of their full scores is a threshold. Blocks are then left unread, where most postings are saved per unit of bound first, as
long as a document that stands only in unread blocks cannot reach a share of the threshold. What is read is summed per (query,
document); with the bound of what was left out, few pairs can still reach the threshold, and only these are scored in full. The
result is exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from millwright.functions.exprs import exploded
from millwright.functions.text import tokens
from millwright.params import RankParams, TokenRules
from millwright.session import staged
from millwright.sources.store import Store, Table

_MARK = ""  # never a token: a posting with this term stands for the document itself

DOCUMENTS = StructType([StructField("doc_id", StringType()), StructField("scope", StringType()), StructField("segment", StringType()),
                        StructField("doc_len", LongType()), StructField("text_hash", StringType())])
SEGMENTS = StructType([StructField("segment", StringType()), StructField("n_docs", LongType()), StructField("avg_len", DoubleType())])


@dataclass(frozen=True)
class IndexParams:
    per_unit: int = 64  # levels
    seeds: int = 16  # documents per wanted hit that the threshold is taken from
    share: float = 0.5  # of the threshold that unread blocks may add up to
    fan: int = 4  # segments of one size that are merged
    buckets: int = 16  # of the keyed tables


class SearchIndex:
    """``docs`` everywhere have doc_id, doc_text and, if searches are scoped, scope; doc_id is text."""

    def __init__(self, spark: SparkSession, root: str, rank: RankParams = RankParams(), rules: TokenRules = TokenRules(),
                 params: IndexParams = IndexParams()):
        self.spark, self.root, self.rank, self.rules, self.params = spark, root.rstrip("/"), rank, rules, params
        self.store = Store(spark, self.root, [Table("documents", DOCUMENTS, ("doc_id",), params.buckets),
                                              Table("segments", SEGMENTS, ("segment",), 1)])

    # ------------------------------------------------------------ keeping it up to date
    def refresh(self, docs: DataFrame, label: str | None = None) -> int:
        """Index documents that are new or whose text or scope changed; returns how many were tokenised. Null texts are empty."""
        if label and self.store.has(label):
            return 0
        scope = F.col("scope") if "scope" in docs.columns else F.lit(None).cast("string")
        text = F.coalesce("doc_text", F.lit(""))
        hashed = F.md5(F.concat_ws("\x00", F.coalesce(scope, F.lit("\x01")), text))
        docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), scope.alias("scope"), text.alias("doc_text"), hashed.alias("text_hash"))
        new = docs
        if self.store.pieces("documents"):
            new = docs.join(self.store.read("documents").select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_anti")
        words = new.select("doc_id", "scope", "text_hash", tokens(F.col("doc_text"), self.rules).alias("tokens"))
        words = words.withColumn("doc_len", F.size("tokens").cast("long")).withColumn("tokens", F.array_append("tokens", F.lit(_MARK)))
        # A document's words are dealt as one row and counted where they land: a row per word and document is not shuffled.
        words = words.repartition("doc_id", "text_hash")
        counts = exploded(words, F.col("tokens"), ["doc_id", "scope", "text_hash", "doc_len"], "term").groupBy(
            "doc_id", "scope", "text_hash", "doc_len", "term").agg(F.count("*").alias("tf"))
        counts = staged(counts, "postings")
        marks = counts.where(F.col("term") == _MARK)
        batch = self.store.batch(label)
        segment = uuid.uuid4().hex[:16]
        n = batch.insert("documents", marks.select("doc_id", "scope", F.lit(segment).alias("segment"), "doc_len", "text_hash"))
        if n:
            self._write(segment, counts.where(F.col("term") != _MARK), n, marks.agg(F.avg("doc_len")).first()[0], batch)
        batch.commit()
        return n

    def delete(self, ids: DataFrame, label: str | None = None) -> int:
        """Forget documents (doc_id); returns how many ids were listed."""
        batch = self.store.batch(label)
        n = batch.delete("documents", ids.select(F.col("doc_id").cast("string").alias("doc_id")))
        batch.commit()
        return n

    def merge(self, most: int | None = None) -> int:
        """Merge segments of similar size where ``fan`` of them have gathered, or, with ``most``, the smallest segments of any size
        where there are more than so many; returns how many went."""
        tiers: dict[int, list] = {}
        rows = self.store.read("segments").collect()  # a row per segment
        for row in rows:
            tier, size = 0, row.n_docs
            while size >= self.params.fan:
                tier, size = tier + 1, size // self.params.fan
            tiers.setdefault(tier, []).append(row)
        gone = [row for same in tiers.values() if len(same) >= self.params.fan for row in same]
        if most is not None:
            gone = sorted(rows, key=lambda row: row.n_docs)[:len(rows) - most + 1] if len(rows) > most else []
        if not gone:
            return 0
        old = [row.segment for row in gone]
        live = staged(self.store.read("documents").where(F.col("segment").isin(old)), "live")
        n, mean = live.agg(F.count("*"), F.avg("doc_len")).first()
        batch, segment = self.store.batch(), uuid.uuid4().hex[:16]
        if n:
            rows = self._read("postings", old).join(live.select("doc_id", "segment"), ["doc_id", "segment"], "left_semi")
            self._write(segment, rows.drop("segment", "level"), n, mean, batch)
            batch.update("documents", live.select("doc_id", F.lit(segment).alias("segment")))
        batch.delete("segments", self.spark.createDataFrame([(s,) for s in old], "segment STRING"))
        batch.commit()
        return len(old)

    def _write(self, segment: str, counts: DataFrame, n_docs: int, mean: float, batch) -> None:
        level = F.floor(self._impact(F.lit(mean)) * self.params.per_unit).cast("int")
        rows = counts.select("term", level.alias("level"), "doc_id", "scope", "doc_len", "tf")
        order = ["term", "level", "doc_id"]
        path = f"{self.root}/postings/segment={segment}"
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
        stored = self.spark.read.schema(rows.schema).parquet(path)
        stored.groupBy("term", "scope", "level").agg(F.count("*").alias("n")).write.parquet(f"{self.root}/levels/segment={segment}")
        batch.insert("segments", self.spark.createDataFrame([(segment, n_docs, float(mean))], SEGMENTS))

    # ------------------------------------------------------------ reading
    def _impact(self, mean: Column) -> Column:
        p = self.rank
        norm = 1 - p.b + p.b * F.col("doc_len") / F.greatest(mean, F.lit(1e-9))
        return F.col("tf") * (p.k1 + 1) / (F.col("tf") + p.k1 * norm)

    def _read(self, kind: str, segments: Sequence[str]) -> DataFrame:
        ddl = {"postings": "term STRING, level INT, doc_id STRING, scope STRING, doc_len LONG, tf LONG, segment STRING",
               "levels": "term STRING, scope STRING, level INT, n LONG, segment STRING"}[kind]
        if not segments:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).option("basePath", f"{self.root}/{kind}").parquet(
            *[f"{self.root}/{kind}/segment={s}" for s in segments])

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", scoped: bool = False,
               figures: dict | None = None) -> DataFrame:
        """The ``k`` best documents per query, (query_id, doc_id, score, position from 0), as ``retrieval.bm25_topk`` gives them.

        ``queries`` have ``tokens`` and, if ``scoped``, ``scope``: such a query sees only documents of its scope, and all corpus
        figures are those of the scope. ``figures`` receives counts of the work done.
        """
        on, unit = ["scope"] if scoped else [], float(self.params.per_unit)
        live = staged(self.store.read("documents").select("doc_id", "scope", "segment", "doc_len"), "live")
        sizes = {r.segment: r for r in self.store.read("segments").collect()}
        alive = {r.segment: r["n"] for r in live.groupBy("segment").agg(F.count("*").alias("n")).collect()}  # a row per segment
        stale = [s for s, r in sizes.items() if alive.get(s, 0) < r.n_docs]
        fresh = [s for s in sizes if s not in stale]
        if scoped:
            totals = staged(live.where("scope IS NOT NULL").groupBy(*on).agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("mean")), "totals")
            with_totals = lambda rows: rows.join(totals, on)
        else:
            n_docs, mean = live.agg(F.count("*"), F.coalesce(F.avg("doc_len"), F.lit(0.0))).first()
            with_totals = lambda rows: rows.withColumns({"n_docs": F.lit(n_docs), "mean": F.lit(mean)})

        terms = staged(exploded(queries, F.col("tokens"), [F.col(query_id).alias("__q"), *on], "term").groupBy(
            "__q", *on, "term").agg(F.count("*").alias("q_tf")), "query_terms")
        vocabulary = staged(terms.select("term").distinct(), "vocabulary")
        of_query = lambda kind, segments: self._read(kind, segments).join(vocabulary, "term", "left_semi")
        postings = of_query("postings", fresh)
        if stale:
            postings = postings.unionByName(of_query("postings", stale).join(live.select("doc_id", "segment"), ["doc_id", "segment"], "left_semi"))
        means = self.spark.createDataFrame([(s, r.avg_len) for s, r in sizes.items()] or [("", 1.0)], "segment STRING, was DOUBLE")
        # A block's bound grows with the mean length since it was written: the score of no posting grows faster.
        block = F.ceil((F.col("level") + 1) * F.greatest(F.lit(1.0), F.col("mean") / F.greatest("was", F.lit(1e-9)))).cast("int")
        bounded = lambda rows: with_totals(rows.join(F.broadcast(means), "segment")).withColumn("block", block)
        postings = staged(bounded(postings).select(*on, "term", "block", "segment", "doc_id", self._impact(F.col("mean")).alias("impact")), "postings")
        counted = bounded(of_query("levels", fresh)).select(*on, "term", "block", "n")
        if stale:  # blocks of segments with dead postings are counted anew
            again = postings.where(F.col("segment").isin(stale)).select(*on, "term", "block", F.lit(1).cast("long").alias("n"))
            counted = counted.unionByName(again)
        blocks = staged(counted.groupBy(*on, "term", "block").agg(F.sum("n").alias("n")), "blocks")

        df = blocks.groupBy(*on, "term").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = with_totals(terms.join(df, [*on, "term"]))
        weights = staged(weights.select("__q", *on, "term", (F.col("q_tf") * idf).alias("w")), "weights")
        asked = staged(weights.join(blocks, [*on, "term"]), "asked")  # (query, term, block): no rows of documents

        seeds = self._seeds(asked, postings, on, k * self.params.seeds)
        scored = staged(self._scored(seeds, postings, weights, on), "seeds")
        best = Window.partitionBy("__q").orderBy(F.desc("score"))
        kth = scored.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k).select("__q", F.col("score").alias("threshold"))
        plan = staged(self._plan(asked, kth, on, unit), "plan")
        cuts = plan.select("__q", *on, "term", "w", "cut", "threshold", "left_out")
        reads = asked.select("__q", *on, "term", "block").join(cuts, ["__q", *on, "term"]).where("block > cut")
        part = F.col("w") * (F.col("impact") - F.col("cut") / unit)
        sums = postings.join(reads, [*on, "term", "block"]).groupBy("__q", "doc_id", "threshold", "left_out").agg(F.sum(part).alias("part"))
        sums = staged(sums, "sums") if figures is not None else sums
        able = staged(sums.where(F.col("part") + F.col("left_out") >= F.col("threshold") - 1e-6).select("__q", "doc_id"), "able")
        if figures is not None:
            n = lambda d: d.count()
            figures |= {"postings": n(postings.join(weights, [*on, "term"])), "read": n(postings.join(reads, [*on, "term", "block"])),
                        "pairs": n(sums), "scored": n(able), "seeds": n(scored)}
        scores = self._scored(able, postings, weights, on).where("score > 0")
        # Sums of doubles depend on their order in the last bits, so equal documents are compared on 9 decimals.
        order = Window.partitionBy("__q").orderBy(F.desc(F.round("score", 9)), "doc_id")
        # The filter is on the row number itself, so that Spark drops the others of a query before it deals the rows by query.
        return scores.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select(
            F.col("__q").alias(query_id), "doc_id", "score", (F.col("nth") - 1).alias("position"))

    @staticmethod
    def _seeds(asked: DataFrame, postings: DataFrame, on: list[str], wanted: int) -> DataFrame:
        """(query, document) of each query's best blocks; of a large block a part by hash, for the threshold needs no more."""
        order = Window.partitionBy("__q").orderBy(F.desc(F.col("w") * F.col("block")), "term").rowsBetween(Window.unboundedPreceding, -1)
        best = asked.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < wanted)
        best = best.select("__q", *on, "term", "block", F.ceil(F.col("n") / wanted).alias("one_in"))
        rows = postings.join(best, [*on, "term", "block"])
        return rows.where(F.pmod(F.xxhash64("doc_id"), F.col("one_in")) == 0).select("__q", "doc_id").distinct()

    @staticmethod
    def _scored(pairs: DataFrame, postings: DataFrame, weights: DataFrame, on: list[str]) -> DataFrame:
        """Full scores of (query, document) pairs, through the postings of their documents."""
        rows = postings.join(pairs, "doc_id").join(weights, ["__q", *on, "term"])
        return rows.groupBy("__q", "doc_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))

    def _plan(self, asked: DataFrame, kth: DataFrame, on: list[str], unit: float) -> DataFrame:
        """(query, term, w, cut, threshold, left_out): blocks up to ``cut`` stay unread; ``left_out`` is what all of them can add.

        A term offers two cuts: the one that saves most postings per unit of bound, and leaving all its blocks. Offers are taken in
        order of that rate until the share of the threshold is used up. Without a threshold everything is read.
        """
        per_term = Window.partitionBy("__q", *on, "term")
        below = asked.withColumn("saved", F.sum("n").over(per_term.orderBy("block")))
        rate = F.col("saved") / (F.col("w") * F.col("block"))
        terms = below.groupBy("__q", *on, "term", "w").agg(
            F.max_by(F.struct("block", "saved"), rate).alias("one"), F.max(F.struct("block", "saved")).alias("all"))
        step = lambda cut, cost, saved: F.struct(cut.alias("cut"), cost.alias("cost"), (saved / cost).alias("rate"))
        bound = lambda c: F.col("w") * F.col(c)["block"] / unit
        offers = F.array(step(F.col("one.block"), bound("one"), F.col("one.saved")),
                         F.when(F.col("all.block") > F.col("one.block"),
                                step(F.col("all.block"), bound("all") - bound("one"), F.col("all.saved") - F.col("one.saved"))))
        rows = terms.join(kth, "__q", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
        rows = rows.select("__q", *on, "term", "w", "threshold", F.explode(F.array_compact(offers)).alias("o"))
        order = Window.partitionBy("__q").orderBy(F.desc("o.rate"), "term", "o.cut").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("used", F.sum("o.cost").over(order))
        taken = F.when(F.col("used") <= self.params.share * F.col("threshold"), F.col("o.cut")).otherwise(0)
        cuts = rows.groupBy("__q", *on, "term", "w", "threshold").agg(F.max(taken).alias("cut"))
        return cuts.withColumn("left_out", F.sum(F.col("w") * F.col("cut") / unit).over(Window.partitionBy("__q")))
