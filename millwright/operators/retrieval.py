"""Batch search and ranking: many queries against many documents."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.exprs import exploded, micros
from millwright.functions.text import tokens
from millwright.operators.intervals import positions
from millwright.params import RankParams, TokenRules
from millwright.session import staged


def compile_filter(spec: dict | None) -> Column:
    """A nested ``@eq`` / ``@and`` / ``@or`` / ``@not`` filter as a condition; values compare as text."""
    if not spec:
        return F.lit(True)
    if len(spec) != 1:
        raise ValueError("a filter has exactly one operator")
    op, arg = next(iter(spec.items()))
    if op == "@eq":
        result = F.lit(True)
        for column, value in arg.items():
            same = (F.col(column).isNull() if value is None
                    else F.coalesce(F.col(column).cast("string") == str(value), F.lit(False)))
            result = result & same
        return result
    if op == "@not":
        return ~compile_filter(arg)
    if op in ("@and", "@or"):
        result = F.lit(op == "@and")
        for part in arg:
            result = result & compile_filter(part) if op == "@and" else result | compile_filter(part)
        return result
    raise ValueError(f"unsupported filter {op}")


def card_documents(cards: DataFrame) -> DataFrame:
    """Searchable text of a card: its search text and its failure mode in words."""
    mode = F.regexp_replace(F.coalesce("failure_mode", F.lit("")), "_", " ")
    return cards.select("*", F.concat(F.coalesce("search_text", F.lit("")), F.lit(" "), mode).alias("doc_text"))


def tokenised(df: DataFrame, text: str, rules: TokenRules = TokenRules()) -> DataFrame:
    return df.withColumn("tokens", tokens(F.col(text), rules))


def corpus_stats(docs: DataFrame, doc_id: str) -> DataFrame:
    """(term, df, n_docs, avg_len) of a tokenised corpus; the totals repeat on every row."""
    totals = docs.agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("avg_len"))
    terms = exploded(docs, F.array_distinct("tokens"), [], "term").groupBy("term").agg(
        F.count("*").alias("df"))
    n_docs, avg_len = totals.first()
    return terms.select("term", "df", F.lit(n_docs).alias("n_docs"), F.lit(avg_len).alias("avg_len"))


_LENGTH_MARK = ""  # never a token, so a posting with this term stands for the document itself


def _postings(docs: DataFrame, vocabulary: DataFrame, on: list[str]) -> DataFrame:
    """(__d, scope, doc_len, term, tf) of the vocabulary terms, plus one length mark per document.

    The marks keep every document in the corpus figures, so one pass over the texts is enough. Tokens meet the
    vocabulary before anything is shuffled when Spark finds it small enough to broadcast.
    """
    marked = docs.withColumn("tokens", F.array_append("tokens", F.lit(_LENGTH_MARK)))
    wanted = vocabulary.unionByName(vocabulary.sparkSession.sql(f"SELECT '{_LENGTH_MARK}' AS term"))
    tokens_only = exploded(marked, F.col("tokens"), ["__d", *on, "doc_len"], "term")
    return tokens_only.join(staged(wanted, "vocabulary"), "term", "left_semi").groupBy(
        "__d", *on, "doc_len", "term").agg(F.count("*").alias("tf"))


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id",
              scope: str | None = None, params: RankParams = RankParams()) -> DataFrame:
    """The ``k`` best documents per query: (query_id, doc_id, score, position from 0).

    Both inputs carry ``tokens``. With ``scope`` a query only sees documents with the same scope value, and N, mean
    length and document frequencies are those of that part of the corpus. A query term counts as often as it is
    repeated. Documents without a common term are left out; equal scores go to the smaller id.

    Documents are tokenised once and written as postings of the query vocabulary; corpus figures, document
    frequencies and scores all come from those. Scoring is exhaustive: its work is the number of postings hit by
    query terms. Pairs of a query and a document are summed in the task that meets them and only the best ``k`` of a
    cell leave it (see :func:`cells_topk`), so what is written and held does not grow with the pairs.
    """
    on = [scope] if scope else []
    terms = query_terms(queries, query_id, on)
    sized = docs.select(F.col(doc_id).alias("__d"), *on, F.size("tokens").alias("doc_len"), "tokens")
    written = staged(_postings(sized, terms.select("term").distinct(), on), "postings")
    return _best(terms, written, k, query_id, doc_id, on, params)


def bm25_named_and_free(named: DataFrame, free: DataFrame, docs: DataFrame, k: int, query_id: str, doc_id: str, scope: str,
                        params: RankParams = RankParams()) -> DataFrame:
    """:func:`bm25_topk` of ``named`` with ``scope``, among the documents that have one, and of ``free`` without, among all.

    The texts are tokenised once: the postings of both searches' terms are written by scope, and those of the second are their sums.
    """
    asked, others = query_terms(named, query_id, [scope]), query_terms(free, query_id, [])
    sized = docs.select(F.col(doc_id).alias("__d"), scope, F.size("tokens").alias("doc_len"), "tokens")
    both = staged(_postings(sized, asked.select("term").union(others.select("term")).distinct(), [scope]), "postings")

    def of(rows, terms, on):
        """Postings that some query asks for, and the marks."""
        wanted = staged(terms.select(*on, "term").distinct(), "vocabulary")
        marks = F.col("term") == _LENGTH_MARK
        return rows.filter(marks).unionByName(rows.filter(~marks).join(wanted, [*on, "term"], "left_semi").select(rows.columns))

    whole = both.groupBy("__d", "doc_len", "term").agg(F.sum("tf").alias("tf"))
    parts = [(asked, both.filter(F.col(scope).isNotNull()), [scope]), (others, whole, [])]
    return reduce(DataFrame.unionByName, [_best(terms, staged(of(rows, terms, on), "postings"), k, query_id, doc_id, on, params)
                                          for terms, rows, on in parts])


def query_terms(queries: DataFrame, query_id: str, on: list[str]) -> DataFrame:
    """(__q, scope, term, q_tf): how often a query has a term."""
    return staged(exploded(queries, F.col("tokens"), [F.col(query_id).alias("__q"), *on], "term").groupBy(
        "__q", *on, "term").agg(F.count("*").alias("q_tf")), "query_terms")


def _best(terms: DataFrame, written: DataFrame, k: int, query_id: str, doc_id: str, on: list[str], params: RankParams) -> DataFrame:
    """The ``k`` best documents of every query from stored postings with their marks."""
    marks = F.col("term") == _LENGTH_MARK
    postings = written.filter(~marks)
    totals = written.filter(marks).groupBy(*on).agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))
    df = postings.groupBy(*on, "term").agg(F.count("*").alias("df"))
    if on:
        weighted = df.join(totals, on)
    else:
        n_docs, avg_len = totals.first()
        weighted = df.select("*", F.lit(n_docs).alias("n_docs"), F.lit(avg_len).cast("double").alias("avg_len"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # A term of one scope is a list of its own, with a number.
    lists = staged(weighted.select(*on, "term", "avg_len", idf.alias("idf"), F.monotonically_increasing_id().alias("__t")), "lists")

    norm = 1 - params.b + params.b * F.col("doc_len") / F.col("avg_len")
    impact = F.col("tf") * (params.k1 + 1) / (F.col("tf") + params.k1 * norm)
    asked = terms.join(lists, [*on, "term"]).select("__q", "__t", (F.col("idf") * F.col("q_tf")).alias("weight"))
    hit = postings.join(lists, [*on, "term"]).select("__d", "__t", impact.alias("impact"))
    scores = cells_topk(asked, hit, k, terms.count(), postings.count())
    # Sums of doubles depend on their order in the last bits, so equal documents are compared on 9 decimals.
    best = Window.partitionBy("__q").orderBy(F.desc(F.round("score", 9)), "__d")
    return scores.withColumn("position", F.row_number().over(best) - 1).filter(F.col("position") < k).select(
        F.col("__q").alias(query_id), F.col("__d").alias(doc_id), "score", "position")


def _blocks(rows: int, most: int, cores: int) -> int:
    """How many blocks of ``most`` rows; of fewer rows, three per core, as cells are dealt by hash, if blocks are worth a task."""
    return max(1, -(-rows // most), min(3 * cores, rows // (most // 32)))


def cells_topk(asked: DataFrame, hit: DataFrame, k: int, n_asked: int, n_hit: int, most: int = 2_000_000) -> DataFrame:
    """The best ``k`` documents of every query in every block of documents: (__q, __d, score) of the scores above 0.

    ``asked`` has (__q, __t, weight), ``hit`` (__d, __t, impact); a score is the sum of weight times impact over equal ``__t``.
    Queries and documents are dealt to blocks of about ``most`` rows by hash, and each cell, a block of the one and a block of the
    other, is one task's work on arrays: its memory is bounded by the blocks, and its output by ``k`` rows per query.
    """
    cores = hit.sparkSession.sparkContext.defaultParallelism
    wide, high = _blocks(n_hit, most, cores), max(1, -(-n_asked // most))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    same = lambda *names: [F.col(c).alias(c) for c in names]  # both sides come from the same lists: columns of their own
    left = asked.select(block("__q", high).alias("__high"), every(wide).alias("__wide"), *same("__q", "__t", "weight"))
    right = hit.select(block("__d", wide).alias("__wide"), every(high).alias("__high"), *same("__d", "__t", "impact"))
    kinds = {c: f.schema[c].dataType.simpleString() for f, c in ((asked, "__q"), (hit, "__d"))}
    cells = left.groupBy("__high", "__wide").cogroup(right.groupBy("__high", "__wide"))
    return cells.applyInArrow(lambda x, y: _cell(x, y, k), f"__q {kinds['__q']}, __d {kinds['__d']}, score double")


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the values in ascending order, null first, and the values by number."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


_GROUP = 64  # documents whose best score is looked at first


def _cell(asked: pa.Table, hit: pa.Table, k: int) -> pa.Table:
    """Scores of a block of queries against a block of documents, the best ``k`` per query; ties go to the smaller document."""
    q, queries = _coded(asked["__q"])
    d, docs = _coded(hit["__d"])
    by_term = np.lexsort((d, hit["__t"].to_numpy()))
    term, doc, impact = hit["__t"].to_numpy()[by_term], d[by_term], hit["impact"].to_numpy()[by_term]
    new = (np.diff(term, prepend=term[:1]) != 0) | (np.diff(doc, prepend=-1) != 0)
    if not new.all():  # a document that is listed more than once, with different lengths
        at = np.flatnonzero(new)
        term, doc, impact = term[at], doc[at], np.add.reduceat(impact, at)
    by_query = np.lexsort((asked["__t"].to_numpy(), q))
    q, wanted, weight = q[by_query], asked["__t"].to_numpy()[by_query], asked["weight"].to_numpy()[by_query]
    start, end = np.searchsorted(term, wanted, "left"), np.searchsorted(term, wanted, "right")
    found = end > start
    q, weight, start, end = q[found], weight[found], start[found], end[found]
    edges = np.flatnonzero(np.diff(q, prepend=-1, append=-1)) if len(q) else []
    rows = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    high = -(-len(docs) // _GROUP)
    sums = np.zeros(_GROUP * high)  # of one query; its rows of ``high`` documents lie under each other in ``groups``
    groups = sums.reshape(_GROUP, high)
    for first, last in zip(edges[:-1], edges[1:]):
        own = range(first, last)
        if (end[first:last] - start[first:last]).sum() * _GROUP < len(docs):
            ids, at = np.unique(np.concatenate([doc[start[i]:end[i]] for i in own]), return_inverse=True)
            score = np.bincount(at, np.concatenate([impact[start[i]:end[i]] * weight[i] for i in own]))
            ids, score = ids[score > 0], score[score > 0]
        else:
            sums.fill(0)
            for i in own:  # a list has a document once
                sums[doc[start[i]:end[i]]] += impact[start[i]:end[i]] * weight[i]
            # k groups have a document of at least this score, so the best k have it, but for what rounding makes equal.
            peaks = groups.max(axis=0)
            least = np.partition(peaks, high - k)[high - k] if high > k else 0.0
            least = max(least - max(2e-9, least * 1e-12), 0.0)
            near = np.flatnonzero((peaks >= least) & (peaks > 0))
            some = groups[:, near]
            row, column = np.nonzero((some >= least) & (some > 0))
            ids, score = row * high + near[column], some[row, column]
        if len(ids) > k:
            steady = np.rint(score * 1e9)
            least = np.partition(steady, len(ids) - k)[len(ids) - k]
            over = np.flatnonzero(steady > least)
            kept = np.concatenate([over, np.flatnonzero(steady == least)[:k - len(over)]])
            ids, score = ids[kept], score[kept]
        rows.append((np.full(len(ids), q[first]), ids, score))
    qs, ds, scores = (np.concatenate(x) for x in zip(*rows))
    return pa.table({"__q": queries.take(pa.array(qs)), "__d": docs.take(pa.array(ds)), "score": scores})


def hydrate(hits: DataFrame, cards: DataFrame, doc_id: str = "card_id") -> DataFrame:
    """Hits with the columns of their cards; ``position`` keeps the search order."""
    return hits.join(cards, doc_id)


def baseline_retrieve(queries: DataFrame, sources: DataFrame, k: int = 3) -> DataFrame:
    """Plain keyword search over whole source texts."""
    docs = tokenised(sources, "source_text").select("source_id", "tokens")
    return bm25_topk(queries, docs, k, doc_id="source_id")


def rank_score(position: Column, mode: Column, prefer_warning: Column,
               params: RankParams = RankParams()) -> Column:
    """Type weight times confidence, demoted when recurred or stale, plus boni for warnings, mode and position."""
    recurred_fix = (F.col("card_type") == "FIX") & (F.col("outcome") == "RECURRED")
    recurred_fix = F.coalesce(recurred_fix, F.lit(False))
    warning = (F.col("card_type") == "GOTCHA") | recurred_fix
    weight = F.coalesce(*[F.when(F.col("card_type") == t, F.lit(float(w))) for t, w in params.type_weight.items()],
                        F.lit(params.default_weight))
    confidence = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(params.default_confidence))
    score = weight * confidence * F.when(recurred_fix, params.recurred_factor).otherwise(1.0)
    score = score * F.when(F.col("is_stale"), params.stale_factor).otherwise(1.0)
    score = score + F.when(prefer_warning & warning, params.warning_bonus).otherwise(0.0)
    score = score + F.when(mode.isNotNull() & (F.col("failure_mode") == mode), params.mode_bonus).otherwise(0.0)
    return score + F.lit(1.0) / (1 + position)


def rank_cards(hits: DataFrame, by: str = "query_id", mode: str | None = "mode", prefer_warning: str | None = None,
               params: RankParams = RankParams()) -> DataFrame:
    """Score hits; a card listed twice for a query counts once, at its last position.

    Ranking is by ``score`` descending, then ``card_id``; :func:`top` takes the first of them.
    """
    last = hits.groupBy(by, "card_id").agg(F.max("position").alias("position"))
    rows = hits.drop("position").dropDuplicates([by, "card_id"]).join(last, [by, "card_id"])
    want = F.coalesce(F.col(prefer_warning), F.lit(False)) if prefer_warning else F.lit(False)
    wanted_mode = F.col(mode) if mode else F.lit(None).cast("string")
    return rows.withColumn("score", rank_score(F.col("position"), wanted_mode, want, params))


def top(ranked: DataFrame, by: list[str], k: int, order: list[Column] | None = None) -> DataFrame:
    """First ``k`` rows per group with their ``rank`` from 1; Spark drops the others before the shuffle."""
    order = order or [F.desc(F.round("score", 9)), F.asc("card_id")]
    w = Window.partitionBy(*by).orderBy(*order)
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recall_queries(active: DataFrame) -> DataFrame:
    """Search text of every live anomaly: asset, channels and matched mode."""
    mode = F.lower(F.regexp_replace(F.coalesce("matched_failure_mode", F.lit("")), "_", " "))
    text = F.concat_ws(" ", F.col("asset_id"), F.col("sensors"), F.lit("rising"), mode, F.lit("fix what worked"))
    return active.select("anomaly_id", "asset_id", F.col("matched_failure_mode").alias("mode"), text.alias(
        "query_text"))


def recall(active: DataFrame, cards: DataFrame, params: RankParams = RankParams(),
           rules: TokenRules = TokenRules()) -> DataFrame:
    """Cards for every live anomaly: search hits on its asset plus all cards of its matched mode, scored.

    ``role`` says what a card is good for: fix, gotcha or symptom (NULL for conventions and unresolved fixes).
    """
    queries = staged(tokenised(recall_queries(active), "query_text", rules), "recall_queries")
    # A card of another asset is in no query's corpus, so its text is not tokenised.
    near = cards.join(staged(queries.select("asset_id").distinct(), "recall_assets"), "asset_id", "left_semi")
    docs = tokenised(card_documents(near), "doc_text", rules).select("card_id", "asset_id", "tokens")
    hits = bm25_topk(queries, docs, params.recall_limit, "anomaly_id", "card_id", "asset_id", params).select(
        "anomaly_id", "card_id", F.col("position").cast("bigint").alias("position"))
    counts = hits.groupBy("anomaly_id").agg(F.count("*").alias("n_hits"))
    asked = queries.select("anomaly_id", "asset_id", "mode")
    pool = asked.filter(F.col("mode").isNotNull()).join(
        cards.select("card_id", "asset_id", F.col("failure_mode").alias("mode"), "created_at"), ["asset_id", "mode"])
    numbered = positions(pool, ["anomaly_id"], micros(F.col("created_at")), [F.col("card_id")], "nth")
    neighbours = numbered.join(counts, "anomaly_id", "left").select(
        "anomaly_id", "card_id", (F.coalesce("n_hits", F.lit(0)) + F.col("nth") - 1).alias("position"))
    listed = hits.unionByName(neighbours).groupBy("anomaly_id", "card_id").agg(F.max("position").alias("position"))
    full = listed.join(cards, "card_id").join(asked.select("anomaly_id", "mode"), "anomaly_id")
    scored = full.withColumn("score", rank_score(F.col("position"), F.col("mode"), F.lit(False), params))
    fix = F.col("card_type") == "FIX"
    role = F.when(fix & (F.col("outcome") == "RESOLVED"), "fix").when(
        (F.col("card_type") == "GOTCHA") | (fix & (F.col("outcome") == "RECURRED")), "gotcha").when(
        F.col("card_type") == "SYMPTOM_PATTERN", "symptom")
    return scored.withColumn("role", role)
