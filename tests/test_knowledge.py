"""Extraction, cards, graph, search and ranking on hand-computed rows."""

import datetime as dt
import itertools
import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millwright.operators import cards as cd
from millwright.operators import extraction as ex
from millwright.operators import retrieval as rt
from millwright.params import Lexicon, RankParams
from millwright.plans.pipeline import CardPaths, refresh_cards

D0 = dt.datetime(2024, 1, 1, 12)
NOTE = ("Line ok. When P3 bearing noise starts creeping it will fail. Fix = swap bearing and grease. "
        "Bearing alone does not hold, it came back. Keep min 2 bearings.")


def day(n, minutes=0):
    return D0 + dt.timedelta(days=n, minutes=minutes)


def orders(table, *items):
    return table([dict(dict(asset_id="P1", wo_type="CORRECTIVE", failure_mode_code="M", status="CLOSED",
                            technician_id="T1", resolution_note="seal changed"), **i) for i in items], "work_orders")


def notes(table, *items):
    return table([dict(note_id=n, created_at=t, note_type="SHIFT", author_technician_id="T2", note_text=x)
                  for n, t, x in items], "handover_notes")


def extracted(table, wo=(), hn=()):
    sources = ex.card_sources(orders(table, *wo), notes(table, *hn))
    return sources, ex.number_cards(ex.with_cards(sources), "rules", "2024-01-01 00:00:00")


def test_note_rules_in_order(table):
    _, raw = extracted(table, hn=[("N1", day(0), NOTE)])
    got = [(r.card_seq, r.card_type, r.confidence, r.outcome, r.asset_id, r.failure_mode)
           for r in raw.orderBy("card_seq").collect()]
    assert got == [(1, "SYMPTOM_PATTERN", 0.8, "UNKNOWN", "P3", "BEARING_WEAR"),
                   (2, "FIX", 0.95, "RESOLVED", "P3", "BEARING_WEAR"),
                   (3, "GOTCHA", 0.85, "RECURRED", "P3", "BEARING_WEAR"),
                   (4, "CONVENTION", 0.8, "UNKNOWN", "P3", "BEARING_WEAR")]


def test_mode_is_not_carried_but_asset_is(table):
    _, raw = extracted(table, hn=[("N1", day(0), "cnc2 coolant was low. Filter changed. Valve changed today. On ac1: belt replaced.")])
    assert rows(raw, "asset_id", "failure_mode", "card_type") == [("AC1", "BELT_SLIP", "FIX"), ("CNC2", "VALVE_STICKING", "FIX")]


def test_work_order_rules(table):
    long = "P1 seal leak, kit replaced" + " x" * 400 + ". Dont reuse the ring, it came back."
    _, raw = extracted(table, wo=[dict(wo_id="W1", resolution_note="P1 seal leak, kit replaced", parts_used="A:1", closed_at=day(0)),
                                  dict(wo_id="W2", resolution_note=long, failure_mode_code=None, closed_at=day(1)),
                                  dict(wo_id="W3", resolution_note="Never skip it.", wo_type="PREVENTIVE", closed_at=day(1)),
                                  dict(wo_id="W4", resolution_note=None, closed_at=day(1)),
                                  dict(wo_id="W5", resolution_note="open one", status="OPEN")])
    got = {(r.source_id, r.card_seq): r for r in raw.collect()}
    assert sorted(got) == [("W1", 1), ("W2", 1), ("W2", 2), ("W3", 1)]
    w1, w2, warn = got["W1", 1], got["W2", 1], got["W2", 2]
    assert (w1.card_type, w1.confidence, w1.outcome, w1.symptom_summary, w1.parts, w1.failure_mode) == (
        "FIX", 0.9, "RESOLVED", "P1 seal leak", "A:1", "M")
    assert w2.failure_mode == "SEAL_LEAK" and len(w2.action_taken) == 300 and len(w2.source_excerpt) == 220
    assert (warn.card_type, warn.outcome, warn.parts, warn.source_excerpt) == (
        "GOTCHA", "RECURRED", None, "Dont reuse the ring, it came back.")
    assert got["W3", 1].card_type == "GOTCHA"


def test_long_note_is_read_to_its_end(table):
    text = "P2 check. " + "nothing here. " * 3000 + "Valve changed."
    _, raw = extracted(table, hn=[("N1", day(0), text)])
    assert rows(raw, "card_seq", "asset_id", "failure_mode") == [(1, "P2", "VALVE_STICKING")]


def test_flatten_responses_and_log(spark):
    df = spark.createDataFrame([
        ("WORK_ORDER", "W1", "h", "P1", "M", '{"cards":[{"card_type":"FIX","asset_id":"","failure_mode":"X","confidence":0.7},{"card_type":"GOTCHA","asset_id":"P9"}]}'),
        ("WORK_ORDER", "W2", "h", "P1", "M", None), ("WORK_ORDER", "W3", "h", "P1", "M", '{"cards":[]}'),
        ("WORK_ORDER", "W4", "h", "P1", "M", "{}")],
        "source_type STRING, source_id STRING, text_hash STRING, asset_id STRING, failure_mode_code STRING, resp STRING")
    done = ex.flatten_responses(df)
    raw = ex.number_cards(done, "m", "2024-01-01 00:00:00")
    assert rows(raw, "source_id", "card_seq", "asset_id", "failure_mode", "confidence") == [
        ("W1", 1, "P1", "X", 0.7), ("W1", 2, "P9", "M", None)]
    assert rows(ex.extract_log(done, "m", "2024-01-01 00:00:00"), "source_id", "n_cards") == [("W1", 2), ("W3", 0), ("W4", 0)]


def test_recurrence_bounds_and_separate_minima(table):
    w = orders(table, dict(wo_id="W1", reported_at=day(-1), closed_at=day(0)),
               dict(wo_id="W9", reported_at=day(3), closed_at=day(3, 60)), dict(wo_id="W2", reported_at=day(5), closed_at=day(30)),
               dict(wo_id="X1", asset_id="P2", reported_at=day(0), closed_at=day(0)),
               dict(wo_id="X2", asset_id="P2", reported_at=day(14), closed_at=day(20)),
               dict(wo_id="Y1", asset_id="P3", reported_at=day(0), closed_at=day(0)),
               dict(wo_id="Y2", asset_id="P3", reported_at=day(14, 1), closed_at=day(20)),
               dict(wo_id="Z1", failure_mode_code=None, asset_id="P4", reported_at=day(0), closed_at=day(0)),
               dict(wo_id="Z2", failure_mode_code=None, asset_id="P4", reported_at=day(1), closed_at=day(1)))
    got = {r.wo_id: (r.recurred_by_wo, r.recurred_after_days) for r in cd.recurrences(w).collect()}
    assert got == {"W1": ("W2", 3), "W9": ("W2", 2), "X1": ("X2", 14)}


def test_recurrences_equal_brute_force_on_a_hot_asset(spark):
    rng = random.Random(11)
    data = [(f"W{i:04d}", rng.choice(["hot"] * 5 + ["b"]), rng.choice(["M", "M", "N", None]), "CORRECTIVE",
             day(0, t := rng.randrange(60 * 24 * 60)), day(0, t + rng.randrange(1, 900))) for i in range(300)]
    df = spark.createDataFrame(data, "wo_id STRING, asset_id STRING, failure_mode_code STRING, wo_type STRING, "
                                     "reported_at TIMESTAMP_NTZ, closed_at TIMESTAMP_NTZ")
    want = {}
    for a, b in itertools.product(data, data):
        if a[1] == b[1] and a[2] is not None and a[2] == b[2] and a[5] < b[4] <= a[5] + dt.timedelta(days=14):
            d = (b[4].date() - a[5].date()).days
            old = want.get(a[0], (b[0], d))
            want[a[0]] = (min(old[0], b[0]), min(old[1], d))
    assert {r.wo_id: (r.recurred_by_wo, r.recurred_after_days) for r in cd.recurrences(df).collect()} == want


def card_world(table, changes=()):
    w = orders(table, dict(wo_id="W1", reported_at=day(0), closed_at=day(1)), dict(wo_id="W2", reported_at=day(5), closed_at=day(6)))
    n = notes(table, ("N3", day(9), "P1 noise. Fix = seal changed."), ("N4", day(10), "P1 rule: always wipe."))
    sources = ex.card_sources(w, n)
    raw = ex.number_cards(ex.with_cards(sources), "rules", "2024-01-01 00:00:00").withColumn(
        "failure_mode", F.when(F.col("source_id") == "N3", "M").otherwise(F.col("failure_mode")))
    ch = table([dict(change_id=f"C{i}", asset_id="P1", changed_at=t, change_type=k, description=f"d{i}")
                for i, (t, k) in enumerate(changes)], "asset_changes")
    tech = table([dict(technician_id="T1", full_name="Ann")], "technicians")
    stale = cd.stale_cards(raw, sources, ch, cd.fixing_changes(ch, w))
    return cd.cards(raw, sources, w, tech, cd.recurrences(w), stale)


def test_cards_and_edges(table):
    cards = card_world(table)
    by = {r.card_id: r for r in cards.collect()}
    assert by["CARD-W1-1"].outcome == "RECURRED" and by["CARD-W2-1"].outcome == "RESOLVED"
    assert by["CARD-W1-1"].outcome_basis == "recurrence rule: W2 re-opened the same failure after 4 days"
    assert (by["CARD-W1-1"].author_name, by["CARD-N3-1"].author_name) == ("Ann", None)
    got = rows(cd.edges(cards).filter("to_type = 'CARD'"), "from_id", "to_id", "relation")
    assert got == [("CARD-N3-1", "CARD-W1-1", "SUPERSEDES"), ("CARD-W2-1", "CARD-W1-1", "CONTRADICTS")]
    ids = cards.filter("card_id = 'CARD-W1-1'").select(F.col("card_id").alias("id"))
    assert rows(cd.edges_for(cd.edges(cards), ids), "relation") == [
        ("ABOUT_ASSET",), ("ABOUT_FAILURE_MODE",), ("AUTHORED_BY",), ("CONTRADICTS",), ("SUPERSEDES",)]


@pytest.mark.parametrize("at,kind,stale", [(day(20), "FIRMWARE_UPDATE", True), (day(20), "LUBRICANT_CHANGE", False),
                                           (day(6, 60), "PART_REPLACEMENT", False), (day(9), "FIRMWARE_UPDATE", False)])
def test_staleness(table, at, kind, stale):
    got = {r.card_id: r.is_stale for r in card_world(table, [(at, kind)]).collect()}
    assert got["CARD-N4-1"] is stale
    assert not any(v for k, v in got.items() if k != "CARD-N4-1")


def test_change_close_to_a_repair_is_the_repair(table):
    w = orders(table, dict(wo_id="W1", reported_at=day(0), closed_at=day(1)))
    ch = table([dict(change_id=i, asset_id="P1", changed_at=day(1, m)) for i, m in (("a", 60), ("b", -60), ("c", 61), ("d", -61))],
               "asset_changes")
    assert rows(cd.fixing_changes(ch, w), "change_id") == [("a",), ("b",)]


def test_supersession_expansion_equals_brute_force(spark):
    rng = random.Random(4)
    data = []
    for i in range(250):
        outcome = rng.choice(["RECURRED", "RESOLVED"])
        by = f"S{rng.randrange(250)}" if outcome == "RECURRED" else None
        data.append((f"C{i}", "FIX", rng.choice(["hot"] * 4 + ["b"]), rng.choice(["M", None]), outcome, by, f"S{i}",
                     day(0, rng.randrange(400))))
    cards = spark.createDataFrame(data, "card_id STRING, card_type STRING, asset_id STRING, failure_mode STRING, outcome STRING, "
                                        "recurred_by_wo STRING, source_id STRING, created_at TIMESTAMP_NTZ")
    want = sorted((n[0], o[0]) for o in data for n in data
                  if o[4] == "RECURRED" and n[4] == "RESOLVED" and o[3] == n[3] == "M" and o[2] == n[2] and n[7] > o[7] and n[6] != o[5])
    got = cd.expand_spans(cd.supersession_spans(cards), cd.resolved_fix_order(cards), block=7)
    assert rows(got, "from_id", "to_id") == sorted(want)


def test_supersession_edges_are_dealt_by_their_number(spark, tmp_path):
    """Spans are few bytes in one file; what they expand to is spread all the same."""
    ddl = "card_id STRING, asset_id STRING, failure_mode STRING, first_no LONG, last_no LONG, except_source STRING"
    made = [(f"O{i}", "press", "M", i % 50 + 1, 900, f"S{i}") for i in range(300)]
    spark.createDataFrame(made, ddl).coalesce(1).write.parquet(str(tmp_path / "spans"))
    order = spark.createDataFrame([("press", "M", f"F{n}", f"S{n}", n) for n in range(1, 901)],
                                  "asset_id STRING, failure_mode STRING, card_id STRING, source_id STRING, fix_no LONG")
    got = cd.expand_spans(spark.read.parquet(str(tmp_path / "spans")), order, block=64, most=20_000)
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    want = {(f"F{n}", o[0]) for o in made for n in range(o[3], 901) if f"S{n}" != o[5]}
    assert sum(tasks) == len(want) and len(tasks) > 6 and max(tasks) < len(want) / 4
    assert {(r.from_id, r.to_id) for r in got.collect()} == want


def test_refresh_is_idempotent_and_sees_edits(table, tmp_path):
    w = orders(table, dict(wo_id="W1", reported_at=day(0), closed_at=day(1)))
    ch, tech = table([], "asset_changes"), table([], "technicians")
    paths = CardPaths(str(tmp_path / "raw"), str(tmp_path / "log"), str(tmp_path / "search"))

    def run(text):
        r = refresh_cards(w, notes(table, ("N1", day(0), text)), ch, tech, paths, at="2024-01-01 00:00:00")
        return r["processed"].count(), rows(r["cards"], "card_id", "source_excerpt")
    n, first = run("P1 fix = seal changed.")
    assert n == 2 and len(first) == 2
    assert run("P1 fix = seal changed.") == (0, first)
    n, cards = run("P1 fix = valve changed.")
    assert n == 1 and [c[1] for c in cards] == ["P1 fix = valve changed.", "seal changed"]


# ---------------------------------------------------------------- search
def token_frame(spark, docs, key):
    return spark.createDataFrame([(k, t.split()) for k, t in docs], f"{key} STRING, tokens ARRAY<STRING>")


def test_bm25_by_hand(spark):
    docs = token_frame(spark, [("d1", "press bearing noise bearing"), ("d2", "belt slip noise"), ("d3", "valve stuck")], "doc_id")
    q = token_frame(spark, [("q", "bearing noise")], "query_id")
    got = [(r.doc_id, round(r.score, 4), r.position) for r in rt.bm25_topk(q, docs, 10).orderBy("position").collect()]
    assert got == [("d1", 1.6656, 0), ("d2", 0.47, 1)]
    stats = {r.term: (r.df, r.n_docs, r.avg_len) for r in rt.corpus_stats(docs, "doc_id").collect()}
    assert stats["noise"] == (2, 3, 3.0) and stats["bearing"] == (1, 3, 3.0)


def brute_bm25(queries, docs, k):
    n, avg = len(docs), sum(len(d.split()) for _, d in docs) / len(docs)
    out = {}
    for qid, q in queries:
        scored = []
        for d, text in docs:
            t, s = text.split(), 0.0
            for w in q.split():
                f, df = t.count(w), sum(w in x.split() for _, x in docs)
                if f:
                    s += math.log(1 + (n - df + .5) / (df + .5)) * f * 2.4 / (f + 1.4 * (.25 + .75 * len(t) / avg))
            if s > 0:
                scored.append((-round(s, 9), d))
        out[qid] = [d for _, d in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bm25_equals_brute_force(spark, seed):
    """Common and rare words, repeated query terms, copies of documents, documents without a hit."""
    rng = random.Random(seed)
    words = ["a"] * 30 + ["b"] * 15 + [f"w{i}" for i in range(40)]
    docs = [(f"d{i:03d}", " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(120)]
    docs += [(f"e{i:03d}", docs[i][1]) for i in range(30)] + [("z", "nohit")]
    queries = [(f"q{i}", " ".join(rng.choices(words, k=8))) for i in range(12)] + [("none", "zzz")]
    want = {q: d for q, d in brute_bm25(queries, docs, 7).items() if d}
    got = {}
    for r in rt.bm25_topk(token_frame(spark, queries, "query_id"), token_frame(spark, docs, "doc_id"), 7).orderBy("position").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == want


def test_scoped_search_has_its_own_corpus(spark):
    docs = spark.createDataFrame([("d1", "A", ["x", "y"]), ("d2", "A", ["y"]), ("d3", "B", ["x"])], "doc_id STRING, s STRING, tokens ARRAY<STRING>")
    q = spark.createDataFrame([("q", "A", ["x"])], "query_id STRING, s STRING, tokens ARRAY<STRING>")
    r = rt.bm25_topk(q, docs, 5, scope="s").collect()
    assert [x.doc_id for x in r] == ["d1"]
    assert r[0].score == pytest.approx(math.log(1 + 1.5 / 1.5) * 2.4 / (1 + 1.4 * (.25 + .75 * 2 / 1.5)))


def test_filter_spec(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n INT, t STRING")
    def keep(spec):
        return rows(df.filter(rt.compile_filter(spec)), "n")
    assert keep(None) == keep({}) == [(1,), (2,), (3,)]
    assert keep({"@eq": {"n": "1", "t": "a"}}) == [(1,)]
    assert keep({"@not": {"@eq": {"t": "a"}}}) == [(2,), (3,)]
    assert keep({"@or": [{"@eq": {"n": 1}}, {"@and": [{"@eq": {"n": 2}}, {"@eq": {"t": "b"}}]}]}) == [(1,), (2,)]
    with pytest.raises(ValueError):
        rt.compile_filter({"@gt": {"n": 1}})


def hit(card, kind, outcome, conf, stale, mode, pos):
    return ("q", card, kind, outcome, conf, stale, mode, pos, "M")


HIT_DDL = ("query_id STRING, card_id STRING, card_type STRING, outcome STRING, confidence DOUBLE, is_stale BOOLEAN, "
           "failure_mode STRING, position BIGINT, mode STRING")


def test_ranking_by_hand(spark):
    hits = spark.createDataFrame([hit("a", "FIX", "RESOLVED", .9, False, "M", 0), hit("b", "FIX", "RECURRED", .9, False, "M", 1),
                                  hit("c", "GOTCHA", "UNKNOWN", .85, True, "X", 2)], HIT_DDL)
    got = {r.card_id: round(r.score, 4) for r in rt.rank_cards(hits).collect()}
    assert got == {"a": 4.7, "b": 3.12, "c": 1.4383}
    warned = rt.rank_cards(hits.withColumn("w", F.lit(True)), prefer_warning="w")
    assert {r.card_id: round(r.score, 4) for r in warned.collect()}["c"] == 4.4383
    assert rows(rt.top(rt.rank_cards(hits), ["query_id"], 2), "card_id", "rank") == [("a", 1), ("b", 2)]


def test_duplicate_hit_counts_at_its_last_position(spark):
    hits = spark.createDataFrame([hit("a", "CONVENTION", "UNKNOWN", 0.0, False, None, 0), hit("a", "CONVENTION", "UNKNOWN", 0.0, False, None, 9)], HIT_DDL)
    r = rt.rank_cards(hits).collect()
    assert len(r) == 1 and r[0].score == pytest.approx(0.5 + 1 / 10)
    assert RankParams().type_weight["GOTCHA"] == 2.6


def test_sentences_take_the_last_asset_mentioned(spark):
    """Against a plain loop, with mentions anywhere, none at all, null and empty notes, and a note of 20,000 sentences."""
    rng = random.Random(8)
    kinds = {"Never skip it": "GOTCHA", "Always look": "CONVENTION", "Fix = new bearing": "FIX!", "All quiet": None}

    def note(n, share):
        return [(rng.choice(list(kinds)), rng.choice(("P1", "cv2", "AC1")) if rng.random() < share else "") for _ in range(n)]

    notes = [note(rng.randrange(12), share) for share in (0, 0.2, 0.5, 1) for _ in range(15)] + [note(20_000, 0.01)]
    texts = [" ".join(f"{said} {asset}".strip() + "." for said, asset in n) for n in notes] + [None, "", " "]
    want = []
    for n in notes + [[]] * 3:
        last, kept = None, []
        for said, asset in n:
            last = asset.upper() or last
            if last and kinds[said]:
                kept.append((last, kinds[said]))
        want.append(kept)
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, text STRING")
    got = df.select("i", ex.asset_context(F.col("text")).alias("c")).orderBy("i").collect()
    assert [[(f.asset, f.kind) for f in r.c] for r in got] == want


@pytest.mark.parametrize("most", [40, 2_000_000])
def test_scoring_in_cells_keeps_few_rows_and_equals_brute_force(spark, most):
    """Two queries out of three share the common term with every document: the pairs never leave the cells."""
    asked = [(q, t, 1.0 + t) for q in ("a", "b", None) for t in ((0, 1) if q else (2, 9))]
    hit = [(f"d{i:03d}", t, x) for i in range(300) for t, x in ((0, float(i % 7)), (1, float(i % 5)), (2, 1.0)) if t < 2 or i % 100 == 0]
    hit += [(None, 0, 6.0), ("d299", 0, 0.5)]  # a document without id, and a repeated posting
    want = []
    for query in ("a", "b", None):
        score = {}
        for d, t, x in hit:
            for q, wanted, weight in asked:
                if q == query and wanted == t:
                    score[d] = score.get(d, 0.0) + weight * x
        best = sorted(((-s, d is not None, d or "", d) for d, s in score.items() if s > 0))[:4]
        want += [(query, d, -s) for s, _, _, d in best]
    cells = rt.cells_topk(spark.createDataFrame(asked, "__q STRING, __t LONG, weight DOUBLE"),
                          spark.createDataFrame(hit, "__d STRING, __t LONG, impact DOUBLE"), 4, len(asked), len(hit), most)
    rows = [tuple(r) for r in cells.collect()]
    assert len(rows) <= 3 * 4 * rt._blocks(len(hit), most, spark.sparkContext.defaultParallelism)
    got = []
    for query in ("a", "b", None):
        own = sorted(((-s, d is not None, d or "", d) for q, d, s in rows if q == query))[:4]
        got += [(query, d, -s) for s, _, _, d in own]
    assert got == want


def test_texts_are_lowered_once_and_trimmed_only_where_needed(spark):
    """Keywords share one lower-cased text; a trimmed text is the same whichever end had white space."""
    from millwright.functions import text as tx
    lowered = str(tx.classify_lower(F.col("x"))).lower()
    assert "lower(" not in lowered and str(ex._facts(F.col("x"), Lexicon())).lower().count("lower(") <= 1
    texts = ["", " ", "a. b", " a. b", "a. b ", "\u2003a!\u2003b?\u2028", "a.\n\nb.\n", "a\u0085", "\u3000", "a .b! ", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    whole = F.regexp_replace(F.coalesce("t", F.lit("")), r"(?U)^\s+|\s+$", "")
    want = F.filter(F.split(whole, r"(?U)(?<=[.!?])\s+"), lambda s: s != "")
    for r in frame.select("i", want.alias("w"), tx.split_sentences(F.col("t")).alias("g")).collect():
        assert r.g == r.w, r.i


def test_cards_frame_parses_the_events_once_per_table(spark, tmp_path, monkeypatch):
    """Orders and changes are views of the events: the joins to cards read them stored, with the same cards as before."""
    from millwright.catalog import knowledge_queries as kq

    events = [(i, D0 + dt.timedelta(hours=i), i % 3, "press", v, '{"k": %d}' % i) for i, v in enumerate([160.0, 1.0, 170.0, 135.0, 2.0])]
    frames = {"events": (events, "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"),
              "documents": ([(1, "Ask the crew. It was not ok again.", "en", "src1", 34)], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"),
              "customer": ([(1, "Anna", "A")], "c_custkey LONG, c_name STRING, c_mktsegment STRING")}
    for name, (made, schema) in frames.items():
        spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    plans, before = {}, kq.staged
    monkeypatch.setattr(kq, "staged", lambda df, name="stage": (
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), before(df, name))[1])
    got = rows(kq.cards_frame(spark, str(tmp_path)), "source_id", "card_type", "outcome")
    assert "get_json_object" in plans["orders"] and "get_json_object" not in plans["cards"]
    fixes = [(s[-1], o) for s, t, o in got if t == "FIX" and s.startswith("WO")]
    assert ("2", "RESOLVED") in fixes and len([g for g in got if g[0].startswith("HN")]) == 1


def _exchanges_above(df, word):
    """How many exchanges the rows of the scans that hold ``word`` pass."""
    lines = [(len(x) - len(x.lstrip(" :+-")), x) for x in df._jdf.queryExecution().executedPlan().toString().split("\n")]
    most = 0
    for i, (depth, line) in enumerate(lines):
        if "Scan" in line and word in line:
            passed = 0
            for d, x in reversed(lines[:i]):
                if d < depth:
                    depth, passed = d, passed + x.lstrip(" :+-").startswith("Exchange")
            most = max(most, passed)
    return most


def test_texts_of_cards_are_shuffled_once_and_repeated_rows_pair_as_in_a_join(spark, table, tmp_path):
    """Sources, cards and orders that come twice: every pair counts, as in one join after the other."""
    w = orders(table, *[dict(wo_id=i, reported_at=day(0), closed_at=day(1)) for i in ("W1", "W2", "W2")])
    hn = notes(table, ("N1", day(0), "P1 fix = seal changed. P1 never run dry."), (None, day(0), "P1 fix = seal changed."))
    sources = ex.card_sources(w, hn)
    made = ex.number_cards(ex.with_cards(sources), "rules", "2024-01-01 00:00:00")
    made.union(made.filter("source_id = 'N1'")).write.parquet(f"{tmp_path}/raw")
    raw = spark.read.schema(made.schema).parquet(f"{tmp_path}/raw")  # stored, as in the queries: a read of the keys leaves the texts
    stale = spark.createDataFrame([("HANDOVER_NOTE", "N1", 2, D0, "new part")],
                                  "source_type STRING, source_id STRING, card_seq INT, first_change_at TIMESTAMP_NTZ, change_description STRING")
    tech = table([dict(technician_id="T1", full_name="Ann"), dict(technician_id="T2", full_name="Bo")], "technicians")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = cd.cards(raw, sources, w, tech, cd.recurrences(w), stale)
        assert _exchanges_above(got, "symptom_summary") == 1
        # W2: two cards, two sources, two orders; N1: two copies of each card, one source.
        assert rows(got, "card_id", "author_name", "is_stale") == sorted(
            [("CARD-W1-1", "Ann", False)] + [("CARD-W2-1", "Ann", False)] * 8
            + [("CARD-N1-1", "Bo", False)] * 2 + [("CARD-N1-2", "Bo", True)] * 2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_new_rows_move_only_what_repeats(spark, tmp_path):
    """Null keys repeat too; nothing stored yet is known when the join is planned, so no row moves for it."""
    from millwright.sources import tables as tb

    data = [("a", 1, "x"), ("a", 2, "x"), ("b", 1, "y"), ("b", 1, "y"), ("b", 2, "z"), (None, 1, "n"), (None, 1, "n"), (None, None, "m")]
    df = spark.createDataFrame(data, "id STRING, seq INT, body STRING")
    none = tb.read_table(spark, str(tmp_path / "nothing"), df.schema)
    assert none.schema == df.schema and none.count() == 0
    assert "Join" not in df.join(none, ["id"], "left_anti")._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(set(data), key=str)
    assert sorted((tuple(r) for r in tb.new_rows(df, none, ["id", "seq"], ["id"]).collect()), key=str) == want
    path = str(tmp_path / "t")
    tb.append_new(df.filter("id = 'a'"), path, ["id", "seq"], ["id"])
    assert sorted((tuple(r) for r in tb.append_new(df, path, ["id", "seq"], ["id"]).collect()), key=str) == want


def test_recall_reads_only_texts_of_the_assets_asked_for(spark, table, monkeypatch):
    found = card_world(table, [(day(3), "PART_REPLACEMENT")])
    asset = found.filter("asset_id IS NOT NULL").first().asset_id
    other = found.withColumns({"asset_id": F.lit("elsewhere"), "card_id": F.concat(F.lit("X"), "card_id")})
    active = spark.createDataFrame([("A-1", asset, "vibration", "M")], "anomaly_id STRING, asset_id STRING, sensors STRING, matched_failure_mode STRING")
    want, seen, search = rows(rt.recall(active, found), "card_id", "position"), [], rt.bm25_topk
    monkeypatch.setattr(rt, "bm25_topk", lambda q, docs, *args: (seen.append(docs), search(q, docs, *args))[1])
    assert rows(rt.recall(active, found.unionByName(other)), "card_id", "position") == want
    assert {r.asset_id for r in seen[0].collect()} == {asset}


def _whole_cell(asked, hit, k):
    """The best k of every query by sums over all pairs."""
    sums = {}
    for q, t, w in asked:
        for d, u, impact in hit:
            if t == u:
                sums[q, d] = sums.get((q, d), 0.0) + w * impact
    best = {}
    for (q, d), score in sums.items():
        best.setdefault(q, []).append((-round(score, 9), d))
    return {(q, d): -s for q, found in best.items() for s, d in sorted(found)[:k]}


def test_a_cell_looks_closely_at_few_of_its_documents(monkeypatch):
    """Equal scores, a document listed twice for a term, rare and frequent terms, against the sums over all pairs."""
    import numpy as np
    import pyarrow as pa
    rng = random.Random(5)
    docs = [f"D{i:04d}" for i in range(1500)]
    hit = [(d, t, rng.choice([0.5, 1.0, 1.5])) for t in range(12) for d in rng.sample(docs, 3 if t > 9 else 400 + 90 * t)]
    hit += [(d, t, 0.25) for d, t, _ in rng.sample(hit, 40)]
    rng.shuffle(hit)
    asked = [(q, t, rng.choice([1.0, 2.5])) for q in range(8) for t in rng.sample(range(10), 5)] + [(8, 10, 1.0), (9, 99, 1.0), (10, 11, 1.0), (10, 3, 2.0)]
    looked, rint = [], np.rint
    monkeypatch.setattr(rt.np, "rint", lambda x: (looked.append(len(x)), rint(x))[1])
    got = rt._cell(pa.table({"__q": [a[0] for a in asked], "__t": pa.array([a[1] for a in asked], pa.int64()), "weight": [a[2] for a in asked]}),
                   pa.table({"__d": [h[0] for h in hit], "__t": pa.array([h[1] for h in hit], pa.int64()), "impact": [h[2] for h in hit]}), 4)
    assert {(r["__q"], r["__d"]): round(r["score"], 9) for r in got.to_pylist()} == _whole_cell(asked, hit, 4)
    assert max(looked) < 700


def test_search_hits_tokenise_a_card_once(spark, monkeypatch):
    """Questions with and without an asset search the same postings; the hits are those of two searches."""
    from millwright.operators import questions
    rng = random.Random(9)
    words = ["valve", "pump", "belt", "motor", "gear", "seal", "fan", "weld"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    ddl = "card_id STRING, asset_id STRING, search_text STRING, failure_mode STRING, card_type STRING, outcome STRING, confidence DOUBLE, is_stale BOOLEAN"
    cards = spark.createDataFrame([(f"C{i}", rng.choice(["P1", "p2", None]), text(rng.randrange(9)), None, "FIX", "RESOLVED", 0.9, False) for i in range(60)]
                                  + [("C1", "P1", text(5), None, "FIX", "RESOLVED", 0.9, False)], ddl)
    asked = spark.createDataFrame([(f"Q{i}", text(3), rng.choice(["P1", "P2", "P9", None]), False, "search") for i in range(20)],
                                  "qid STRING, question STRING, asset_id STRING, wants_warning BOOLEAN, tool STRING")
    tokenising, before = [], rt.staged

    def seen(df, name="stage"):
        if name == "postings" and "regexp_extract_all" in df._jdf.queryExecution().executedPlan().toString():
            tokenising.append(name)
        return before(df, name)

    monkeypatch.setattr(rt, "staged", seen)
    got = rows(questions.search_hits(asked, cards), "qid", "card_id", "position")
    assert len(tokenising) == 1
    docs = rt.tokenised(rt.card_documents(cards), "doc_text").selectExpr("card_id", "upper(asset_id) AS scope", "tokens")
    queries = rt.tokenised(asked, "question").selectExpr("qid", "asset_id AS scope", "tokens")
    want = {}
    for part, scope in ((queries.where("scope IS NOT NULL"), "scope"), (queries.where("scope IS NULL").drop("scope"), None)):
        own = docs.where("scope IS NOT NULL") if scope else docs.drop("scope")
        want |= {(r.qid, r.card_id): r.position for r in rt.bm25_topk(part, own, 10, "qid", "card_id", scope).collect()}
    assert got and all(want[q, c] == p for q, c, p in got) and {q for q, _, _ in got} == {q for q, _ in want}
