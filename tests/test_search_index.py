"""The stored search index against exhaustive scoring of the documents it should hold."""

import random

import pytest
from pyspark.sql import functions as F

from millwright.functions import text as text_functions
from millwright.operators import search_index
from millwright.operators.retrieval import bm25_topk, tokenised
from millwright.operators.search_index import IndexParams, SearchIndex
from millwright.session import fresh_path

WORDS = [f"{c}{v}{d}" for c in "bdfgklmnprt" for v in "aeiou" for d in "kmnrx"]


def made(rng, n, first=0):
    """Texts of words of very different frequencies."""
    pick = lambda: WORDS[min(int(rng.paretovariate(0.6)), len(WORDS)) - 1]
    return {f"D{first + i:04d}": (" ".join(pick() for _ in range(rng.choice([0, 1, 5, 20, 60]))), f"s{rng.randrange(3)}") for i in range(n)}


def docs(spark, held):
    return spark.createDataFrame([(i, t, s) for i, (t, s) in held.items()], "doc_id STRING, doc_text STRING, scope STRING")


def searches(spark, rng, n=12):
    rows = [(i, " ".join(rng.choice(WORDS[:80] if i % 2 else WORDS) for _ in range(rng.choice([1, 3, 12, 30]))), f"s{i % 3}") for i in range(n)]
    return tokenised(spark.createDataFrame([*rows, (n, "nothing of this", "s0"), (n + 1, "", "s1")], "query_id INT, q STRING, scope STRING"), "q")


def hits(df):
    return sorted((r.query_id, r.position, r.doc_id, round(r.score, 7)) for r in df.collect())


def same_as_rebuilt(spark, index, held, queries, k=5):
    whole = tokenised(docs(spark, held), "doc_text")
    for scoped in (False, True):
        want = bm25_topk(queries, whole, k, scope="scope" if scoped else None)
        assert hits(index.search(queries, k, scoped=scoped)) == hits(want)


@pytest.mark.parametrize("seed", range(2))
def test_refreshes_deletions_and_merges_equal_a_rebuild(spark, seed):
    rng = random.Random(seed)
    index = SearchIndex(spark, fresh_path(spark, "index"), params=IndexParams(fan=3, buckets=3, share=(0.5, 0.9)[seed]))
    held = made(rng, 60)
    assert index.refresh(docs(spark, held)) == 60
    queries = searches(spark, rng)
    for step in range(4):
        change = made(rng, 10, 60 + 10 * step) | {i: (held[i][0] + " bak bak", held[i][1]) for i in rng.sample(sorted(held), 6)}
        change |= {i: (held[i][0], "s9") for i in rng.sample(sorted(held), 2)}  # another scope, the same text
        changed = {i for i, v in change.items() if held.get(i) != v}
        held |= change
        assert index.refresh(docs(spark, held)) == len(changed)
        gone = rng.sample(sorted(held), 7)
        index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id STRING"))
        held = {i: v for i, v in held.items() if i not in gone}
        if step % 2:
            same_as_rebuilt(spark, index, held, queries)
    assert index.merge() >= 3
    same_as_rebuilt(spark, index, held, queries)
    assert index.merge() == 0 or index.merge() == 0
    assert index.refresh(docs(spark, held)) == 0


def test_only_new_texts_are_tokenised(spark, monkeypatch):
    """A tokeniser that fails on the words of the first refresh."""
    index = SearchIndex(spark, fresh_path(spark, "index"))
    first = {f"D{i}": (f"old words {i}", "s") for i in range(5)}
    index.refresh(docs(spark, first), "one")

    def careful(c, rules):
        return F.when(c.contains("old"), F.raise_error(F.lit("tokenised again"))).otherwise(text_functions.tokens(c, rules))

    monkeypatch.setattr(search_index, "tokens", careful)
    more = first | {"E1": ("new words", "s"), "E2": ("", "s")}
    assert index.refresh(docs(spark, more), "two") == 2
    assert index.refresh(docs(spark, {"F": ("old", "s")}), "two") == 0  # this label was committed
    with pytest.raises(Exception, match="tokenised again"):
        index.refresh(docs(spark, {"F": ("old", "s")}))


def test_work_of_a_search(spark):
    """On texts with rare words few pairs are scored, and they don't grow with the corpus."""
    rng, seen = random.Random(7), []
    for n in (300, 1500):
        index = SearchIndex(spark, fresh_path(spark, "index"))
        held = {f"D{i:05d}": (" ".join([f"r{rng.randrange(n // 3)}x", *(rng.choice(WORDS[:40]) for _ in range(20))]), "s") for i in range(n)}
        index.refresh(docs(spark, held))
        queries = tokenised(spark.createDataFrame([(i, f"r{i}x r{i + 1}x " + " ".join(WORDS[i:i + 3])) for i in range(10)],
                                                  "query_id INT, q STRING"), "q")
        figures = {}
        got = hits(index.search(queries, 3, figures=figures))
        assert got == hits(bm25_topk(queries, tokenised(docs(spark, held), "doc_text"), 3))
        seen.append(figures)
    small, large = seen
    assert large["read"] < large["postings"] / 3 and large["scored"] < 3 * 10 * 3 + small["scored"]


def test_an_empty_index(spark):
    index = SearchIndex(spark, fresh_path(spark, "index"))
    queries = searches(spark, random.Random(1), 2)
    assert index.search(queries, 3).count() == 0 and index.merge() == 0
    assert index.refresh(docs(spark, {"D1": ("bak", "s0")}).limit(0)) == 0
    assert index.search(queries, 3, scoped=True).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_refresh_deals_documents_not_words(spark, monkeypatch):
    """Rows of one word and document are counted where the document's words lie; an empty index is not joined with."""
    plans, before = [], search_index.staged
    monkeypatch.setattr(search_index, "staged", lambda df, name="stage": (plans.append(_plan(df)), before(df, name))[1])
    index = SearchIndex(spark, fresh_path(spark, "index"))
    held = {"D1": ("alpha beta alpha", "s0"), "D2": ("beta gamma", "s1")}
    assert index.refresh(docs(spark, held)) == 2
    assert "Join" not in plans[0]
    held["D2"] = ("gamma gamma delta", "s1")
    assert index.refresh(docs(spark, held)) == 1
    dealt = [line for line in plans[1].splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("term" in line for line in dealt)
    same_as_rebuilt(spark, index, held, tokenised(spark.createDataFrame([(1, "alpha gamma", "s1")], "query_id INT, q STRING, scope STRING"), "q"))


def test_search_drops_what_cannot_be_among_the_best_before_dealing_by_query(spark):
    index = SearchIndex(spark, fresh_path(spark, "index"))
    index.refresh(docs(spark, {f"D{i}": ("alpha beta", "s0") for i in range(20)}))
    found = index.search(tokenised(spark.createDataFrame([(1, "alpha", "s0")], "query_id INT, q STRING, scope STRING"), "q"), 3)
    assert "WindowGroupLimit" in _plan(found)
    assert [(r.doc_id, r.position) for r in found.orderBy("position").collect()] == [("D0", 0), ("D1", 1), ("D10", 2)]


def test_merge_to_a_number_of_segments(spark):
    """Segments of any size are merged, the smallest first; what is dead is dropped, and searches find the same."""
    rng = random.Random(3)
    index, held = SearchIndex(spark, fresh_path(spark, "index")), {}
    for n in (40, 2, 9):
        more = made(rng, n, len(held))
        index.refresh(docs(spark, more))
        held |= more
    gone = sorted(held)[::5]
    index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id STRING"))
    held = {i: v for i, v in held.items() if i not in gone}
    assert index.merge() == 0 and index.merge(most=3) == 0
    queries = searches(spark, rng)
    for most, merged in ((2, 2), (1, 2), (1, 0)):
        assert index.merge(most=most) == merged and index.store.read("segments").count() == most
    assert index.store.read("segments").first().n_docs == len(held)
    same_as_rebuilt(spark, index, held, queries)


def test_search_refresh_searches_what_was_merged(spark, tmp_path, monkeypatch):
    """The query's three segments become one without dead postings before it searches."""
    from millwright.catalog import store_queries

    texts = [(i, f"valve w{i} pump w{i % 4} bearing", ("en", "de", "fr")[i % 3], "src1") for i in range(30)]
    spark.createDataFrame(texts, "doc_id LONG, text STRING, lang STRING, source STRING").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "valve w3 w7"), (2, "pump w9 w15")], "item_id LONG, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, search = [], SearchIndex.search

    def searched(self, *args, **kwargs):
        segments = self.store.read("segments").collect()
        seen.append((len(segments), sum(r.n_docs for r in segments), self.store.read("documents").count()))
        return search(self, *args, **kwargs)

    monkeypatch.setattr(SearchIndex, "search", searched)
    found = {r.doc_id for r in store_queries.search_refresh(spark, str(tmp_path)).where("query_id = 1 AND position < 1").collect()}
    assert seen == [(1, 27, 27)] and found <= {"HN-000000000003", "HN-000000000007"} and found
