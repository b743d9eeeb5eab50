"""Tables, drafting, workflow, metrics, questions, checks and streaming."""

import dataclasses
import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millwright.operators import quality, questions
from millwright.operators import workorders as wo
from millwright.params import WorkflowParams
from millwright.plans.metrics import PLANT_MODEL, answer, metric_query, resolve, store_aggregate
from millwright.plans.named_queries import NAMED_QUERIES
from millwright.schemas import SCHEMAS
from millwright.sources import tables as tb
from millwright.streaming import jobs

D0 = dt.datetime(2024, 1, 1)


# ---------------------------------------------------------------- tables
def test_csv_dialect(spark, tmp_path):
    (tmp_path / "handover_notes.csv").write_text(
        'note_id,created_at,shift_date,shift,note_type,line_id,author_technician_id,note_text\n'
        'N1,2024-01-01 06:00:00,2024-01-01,A,SHIFT,,T1,"say ""hi"",\nnext line"\n', encoding="utf-8")
    r = tb.load_csv(spark, str(tmp_path), "handover_notes").first()
    assert (r.line_id, r.note_text, r.created_at) == (None, 'say "hi",\nnext line', dt.datetime(2024, 1, 1, 6))
    (tmp_path / "spare_parts.csv").write_text("part_id,description,asset_types,stock_qty,reorder_point,lead_time_days,unit_cost_inr\n"
                                              "A,x,y,notanumber,1,1,1\n")
    with pytest.raises(Exception, match="(?i)malformed|notanumber|parse"):
        tb.load_csv(spark, str(tmp_path), "spare_parts").collect()


def test_append_update_delete(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", 3, "z")], "id STRING, n INT, t STRING")
    path = str(tmp_path / "t")
    assert tb.append_new(df.limit(2), path, ["id"]).count() == 2
    assert rows(tb.append_new(df.union(df), path, ["id"]), "id") == [("a",), ("b",), ("c",)]
    changes = spark.createDataFrame([("b", 20, None), ("q", 1, "w")], "id STRING, n INT, t STRING")
    assert rows(tb.update_by_key(df, changes, ["id"]), "id", "n", "t") == [("a", 1, "x"), ("b", 20, None), ("c", 3, "z")]
    assert rows(tb.delete_by_key(df, changes.select("id")), "id") == [("a",), ("c",)]
    assert rows(tb.delete_like(df, "t", "x%"), "id") == [("b",), ("c",)]
    assert rows(tb.row_counts({"t": df, "none": df.limit(0)}), "tbl", "n") == [("none", 0), ("t", 3)]
    assert rows(tb.by_id(df, "id", "b"), "n") == [(2,)]


def test_empty_table_reads_as_empty(spark, tmp_path):
    assert tb.read_table(spark, str(tmp_path / "nothing"), SCHEMAS["cards_raw"]).count() == 0


# ---------------------------------------------------------------- drafting
def ranked(spark, *cards):
    cols = ("card_id", "card_type", "outcome", "failure_mode", "source_type", "source_id", "confidence", "score", "parts",
            "author_technician_id", "created_at", "action_taken", "source_excerpt", "author_name", "outcome_basis")
    base = dict(outcome="UNKNOWN", failure_mode="M", source_type="WORK_ORDER", confidence=0.9, score=1.0, created_at=D0)
    data = [("E", "M") + tuple({**base, **c}.get(k) for k in cols) for c in cards]
    kinds = {"confidence": "DOUBLE", "score": "DOUBLE", "created_at": "TIMESTAMP_NTZ"}
    return spark.createDataFrame(data, "anomaly_id STRING, mode STRING, " + ", ".join(f"{c} {kinds.get(c, 'STRING')}" for c in cols))


def fix(i, **kw):
    return dict(card_id=f"C{i}", card_type="FIX", outcome="RESOLVED", source_id=f"W{i}", action_taken=f"act {i}", **kw)


def test_parts_and_technician(spark, table):
    ev = wo.select_evidence(ranked(spark, fix(1, parts="A:1;B:1", author_technician_id="T1"),
                                   fix(2, parts="A:2", author_technician_id="T2"), fix(3, parts="")))
    parts = wo.recommend_parts(ev)
    assert rows(parts, "part_id", "n_used") == [("A", 2), ("B", 1)]
    stock = table([dict(part_id="A", description="ring", stock_qty=1, reorder_point=2, lead_time_days=3)], "spare_parts")
    assert rows(wo.parts_risk(parts, stock), "part_id", "at_risk", "in_master") == [("A", True, True), ("B", False, False)]
    tech = table([dict(technician_id="T2", full_name="Bo", retiring_2027="true")], "technicians")
    r = wo.recommend_technician(ev, tech).first()
    assert (r.technician_id, r.n_fixes, r.full_name) == ("T2", 1, "Bo")


def test_evidence_roles_and_fix_order(spark):
    df = ranked(spark, fix(1), fix(2, source_type="HANDOVER_NOTE", confidence=0.5), fix(3, confidence=0.95),
                fix(4, created_at=D0 - dt.timedelta(days=1)), fix(5, failure_mode="X"), fix(6, created_at=D0 + dt.timedelta(days=1)),
                dict(card_id="G1", card_type="GOTCHA", failure_mode=None), dict(card_id="G2", card_type="GOTCHA", failure_mode="X"),
                dict(card_id="R1", card_type="FIX", outcome="RECURRED"), dict(card_id="S1", card_type="SYMPTOM_PATTERN", failure_mode="X"))
    first = wo.first_evidence(wo.select_evidence(df)).orderBy("use", "rank").collect()
    assert [(r.use, r.card_id) for r in first] == [("fix", "C2"), ("fix", "C3"), ("fix", "C4"), ("fix", "C1"), ("gotcha", "G1"),
                                                   ("recurred", "R1"), ("symptom", "S1")]


def test_draft_text(spark, table):
    active = spark.createDataFrame([("E", "P1", "PRESS", "L1", "vibration", 12.34, 3.0, 24, "RAMP", "M_X", 3, 23.6, 46.2),
                                    ("F", "P2", "PRESS", "L1", "current", None, None, 5, "N/A", None, None, None, None)],
                                   "anomaly_id STRING, asset_id STRING, asset_type STRING, line_id STRING, sensors STRING, vib_rise_pct DOUBLE, "
                                   "temp_rise_c DOUBLE, duration_h BIGINT, vib_shape STRING, matched_failure_mode STRING, n_matches BIGINT, "
                                   "eta_low_h DOUBLE, eta_high_h DOUBLE")
    windows = spark.createDataFrame([("E", "rule")], "anomaly_id STRING, threshold_rule STRING")
    cards = ranked(spark, fix(1, parts="A:1", author_technician_id="T2", source_type="HANDOVER_NOTE"),
                   fix(2, parts="A;B", author_technician_id="T2", author_name="Bo"),
                   dict(card_id="G1", card_type="GOTCHA", source_excerpt="dont"),
                   dict(card_id="R1", card_type="FIX", outcome="RECURRED", source_id="W9", outcome_basis="came back"),
                   dict(card_id="S1", card_type="SYMPTOM_PATTERN", source_excerpt="when")).withColumn("failure_mode", F.lit("M_X")).withColumn("mode", F.lit("M_X"))
    stock = table([dict(part_id="A", description="ring", stock_qty=1, reorder_point=2, lead_time_days=3)], "spare_parts")
    tech = table([dict(technician_id="T2", full_name="Bo", retiring_2027="true")], "technicians")
    existing = spark.createDataFrame([("E",)], "anomaly_id STRING")
    got = {r.anomaly_id: r for r in wo.draft_orders(active, windows, cards, stock, tech, F.lit(D0), existing).collect()}
    e = got["E"]
    assert (e.draft_id, e.title, e.status) == ("DRAFT-E-2", "P1: m x, planned repair", "PENDING_APPROVAL")
    assert (e.parts, e.parts_at_risk, e.recommended_technician_id, e.cited_card_ids) == ("A;B", "A", "T2", "C1,C2,G1,R1,S1")
    for line in ("**Asset:** P1 (PRESS, line L1)", "vibration +12.3% vs profile, temperature +3.0 °C, 24 h so far (RAMP)",
                 "**Suspected failure mode:** M_X, matching 3 past episode(s) on this asset",
                 "**Failure window (ESTIMATE):** 24–46 h to threshold (rule)", "1. act 1  [C1]",
                 "   - Same fix applied before: W2 by Bo  [C2]", "**Do NOT**\n- dont  [G1]\n- Repeat W9: came back  [R1]",
                 "**Known symptom pattern:** when  [S1]",
                 "- A (ring): 1 in stock, reorder point 2, lead time 3 d  ⚠ AT RISK: reorder now", "- B: not in the spare-parts master",
                 "**Suggested technician:** Bo (T2), authored 2 resolved fix(es) for this pattern; retiring 2027, pair with"):
        assert line in e.body, line
    f = got["F"]
    assert (f.draft_id, f.title, f.parts, f.recommended_technician_id) == ("DRAFT-F-1", "P2: anomaly, inspect", "", None)
    assert "1. No resolved fix on record" in f.body and "- none identified from past fixes" in f.body and "Do NOT" not in f.body


# ---------------------------------------------------------------- workflow
def drafts(table, *ids):
    return table([dict(draft_id=i, anomaly_id=i, asset_id="P1", failure_mode="M", status="PENDING_APPROVAL", body="old",
                       recommended_technician_id="T1", parts="A;B", created_at=D0, title="t") for i in ids], "drafts")


def events(table, *items):
    return table([dict(dict(event_id=n, event_ts=D0 + dt.timedelta(hours=n)), **i) for n, i in enumerate(items)], "workflow_events")


def test_workflow(table):
    ev = events(table, dict(kind="approve", draft_id="D1", actor="my bot"), dict(kind="edit", draft_id="D1", actor="Eve", body="new"),
                dict(kind="approve", draft_id="D1", actor="Anna"), dict(kind="reject", draft_id="D1", actor="Bea", reason="no"),
                dict(kind="edit", draft_id="D1", actor="Eve", body="late"), dict(kind="reject", draft_id="D2", actor="Bea", reason="why"),
                dict(kind="approve", draft_id="D9", actor="Anna"), dict(kind="edit", draft_id="D3", actor="  ", body="x"))
    state, refused = wo.fold_workflow(drafts(table, "D1", "D2", "D3"), ev)
    assert rows(state, "draft_id", "status", "body", "edited_by", "approved_by", "rejected_reason") == [
        ("D1", "APPROVED", "new", "Eve", "Anna", None), ("D2", "REJECTED", "old", None, "Bea", "why"),
        ("D3", "PENDING_APPROVAL", "old", None, None, None)]
    assert rows(refused, "event_id", "refused_because") == [
        (0, "not a named human"), (3, "not pending approval"), (4, "not pending approval"), (6, "not pending approval"),
        (7, "not a named human")]
    new = wo.approved_orders(state, "WO-2026-0144", WorkflowParams(order_prefix="WO-2026-")).drop("draft_id")
    o = new.first()
    assert (o.wo_id, o.status, o.parts_used, o.reported_at) == ("WO-2026-0145", "OPEN", "A:1;B:1", D0 + dt.timedelta(hours=2))
    orders = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS["work_orders"]])
    close = events(table, dict(kind="close", wo_id=o.wo_id, body="done", repair_h=5.0), dict(kind="close", wo_id=o.wo_id, body="again"))
    c = wo.close_orders(orders, close).first()
    assert (c.status, c.downtime_min, c.resolution_note, c.technician_id) == ("CLOSED", 300, "done", "T1")
    assert c.closed_at == o.reported_at + dt.timedelta(hours=5)
    again = wo.close_orders(wo.close_orders(orders, close), events(table, dict(kind="close", wo_id=o.wo_id, body="no"))).first()
    assert again.resolution_note == "done"


def test_order_numbers_follow_approval_time(spark, table):
    state = drafts(table, *[f"D{i}" for i in range(30)]).withColumn("status", F.lit("APPROVED")).withColumn(
        "approved_at", (F.lit(D0) + F.make_interval(hours=-F.substring("draft_id", 2, 3).cast("int"))).cast("timestamp_ntz"))
    got = {r.draft_id: r.wo_id for r in wo.approved_orders(state, None).collect()}
    assert got["D29"] == "WO-0001" and got["D0"] == "WO-0030"


def test_reset(table):
    made = drafts(table, "D1").withColumn("wo_id", F.lit("W1"))
    t = {"drafts": made, "work_orders": table([dict(wo_id="W1"), dict(wo_id="W2")], "work_orders"),
         "handover_notes": table([dict(note_id="HN-9001"), dict(note_id="HN-0001")], "handover_notes"),
         "cards_raw": table([dict(source_id=s) for s in ("W1", "W2", "HN-9001")], "cards_raw"),
         "card_extract_log": table([dict(source_id="W1")], "card_extract_log")}
    left = {n: df.count() for n, df in wo.reset(t).items()}
    assert left == {"drafts": 0, "work_orders": 1, "handover_notes": 1, "cards_raw": 1, "card_extract_log": 0}


# ---------------------------------------------------------------- metrics and questions
def plant(table):
    w = table([dict(wo_id=f"W{i}", asset_id=a, wo_type=k, failure_mode_code=m, reported_at=D0, closed_at=D0 + dt.timedelta(minutes=n),
                    downtime_min=n, technician_id=t) for i, (a, k, m, n, t) in enumerate([
                        ("P1", "CORRECTIVE", "M", 60, "T1"), ("P1", "CORRECTIVE", None, 120, "T2"), ("P2", "PREVENTIVE", "M", 600, "T1")])],
              "work_orders")
    oee = "asset_id STRING, line_id STRING, oee_date DATE, oee DOUBLE, availability DOUBLE, performance DOUBLE, quality DOUBLE, downtime_min BIGINT, scrap_count BIGINT"
    daily = table([("P1", "L1", "2024-01-10", .5, .9, .8, .7, 5, 1), ("P2", "L2", "2024-01-10", .7, .9, .8, .7, 5, 2),
                   ("P2", "L2", "2024-01-01", .1, .9, .8, .7, 5, 2)], oee)
    daily = daily.withColumns({c: F.lit(1) for c in ("planned_min", "run_min", "total_count", "good_count")})
    return {"work_orders": w, "oee_daily": daily, "line_oee": daily.drop("asset_id", "downtime_min", "scrap_count"),
            "technicians": table([dict(technician_id="T1", full_name="Al", retiring_2027="true"), dict(technician_id="T2", full_name="Bo", retiring_2027="false")], "technicians"),
            "spare_parts": table([dict(part_id="A", description="d", stock_qty=1, reorder_point=2, lead_time_days=9), dict(part_id="B", stock_qty=5, reorder_point=2)], "spare_parts"),
            "assets": table([dict(asset_id="P1", asset_type="PRESS"), dict(asset_id="P2", asset_type="MILL")], "assets")}


def test_named_queries(table):
    t = plant(table)
    got = {n: [tuple(r) for r in q.run(t).collect()] for n, q in NAMED_QUERIES.items()}
    assert len(got) == 10
    assert got["mttr_by_technician"] == [("Al", 1, 1.0), ("Bo", 1, 2.0)]
    assert got["top_downtime_causes_this_month"] == [("UNCLASSIFIED", 1, 120), ("M", 1, 60)]
    assert got["lowest_oee_assets_last_week"] == [("P1", "L1", .5, 5), ("P2", "L2", .7, 5)]
    assert got["weekly_plant_oee_trend"] == [(dt.date(2024, 1, 1), .1), (dt.date(2024, 1, 8), .6)]
    assert got["jobs_done_by_retiring_technicians"] == [("Al", "P1", 1)]
    assert got["parts_at_risk_of_stockout"] == [("A", "d", 1, 2, 9)]


def test_metric_query(table):
    t = plant(table)
    by = metric_query(PLANT_MODEL, t, ["work_orders.breakdowns", "work_orders.mttr_hours"], ["assets.asset_type"])
    assert rows(by, "asset_type", "breakdowns", "mttr_hours") == [("MILL", 1, 10.0), ("PRESS", 2, 1.5)]
    both = metric_query(PLANT_MODEL, t, ["work_orders.total_downtime_min", "oee_daily.avg_oee"], ["assets.asset_id"],)
    assert rows(both, "asset_id", "total_downtime_min", "avg_oee") == [("P1", 180, .5), ("P2", 600, pytest.approx(.4))]
    for bad in (["work_orders.nope"], []), (["spare_parts.parts_below_reorder"], ["assets.asset_id"]):
        with pytest.raises(ValueError):
            metric_query(PLANT_MODEL, t, *bad)


def test_names_are_resolved():
    known = {"Technician": "technicians.full_name", "production  line": "line_oee.line_id", "downtime cause": "work_orders.failure_mode_code",
             "equipment.asset type": "assets.asset_type", "wo_type": "work_orders.wo_type", "oee_daily.oee_date": "oee_daily.oee_date"}
    assert {n: resolve(PLANT_MODEL, n) for n in known} == known
    assert resolve(PLANT_MODEL, "jobs.MTTR hours", "metrics") == "work_orders.mttr_hours"
    twins = dataclasses.replace(PLANT_MODEL, synonyms={"work_orders.wo_type": ("kind",), "assets.asset_type": ("kind",)})
    for model, name in ((PLANT_MODEL, "colour"), (twins, "kind"), (PLANT_MODEL, "")):
        with pytest.raises(ValueError):
            resolve(model, name)


def test_stored_aggregates_answer_like_base_tables(spark, table):
    t = plant(table)
    names = ["breakdowns", "total_downtime_min", "mttr_hours"]
    fine = store_aggregate(PLANT_MODEL, t, "work_orders", names, ["failure mode", "technician", "wo_type", "assets.asset_type"])
    gone = {**t, "work_orders": t["work_orders"].where("raise_error('base table read') IS NULL")}
    coarse = store_aggregate(PLANT_MODEL, gone, "work_orders", names, ["failure mode"], [fine])
    total = store_aggregate(PLANT_MODEL, gone, "work_orders", names, [], [fine, coarse])
    assert (fine.rows, coarse.rows, total.rows) == (3, 2, 1)
    cases = [(["failure mode"], {}, coarse), ([], {}, total), (["technician"], {"failure mode": ["M"]}, fine),
             (["assets.asset_type", "failure mode"], {"wo_type": ["CORRECTIVE", "x"]}, fine), ([], {"wo_type": []}, fine)]
    for dims, equal, taken in cases:
        used: list = []
        got = answer(PLANT_MODEL, gone, [fine, coarse, total], [f"jobs.{n}" for n in names], dims, equal, used)
        base = answer(PLANT_MODEL, t, [], [f"work_orders.{n}" for n in names], dims, equal)
        assert used == [taken]
        assert got.schema.names == base.schema.names and rows(got, *got.columns) == rows(base, *base.columns)
    used = []
    both = answer(PLANT_MODEL, t, [fine, coarse, total], ["mttr_hours", "avg_oee"], ["assets.asset_id"], {"assets.asset_id": ["P1"]}, used)
    assert used == [None, None] and rows(both, "asset_id", "mttr_hours", "avg_oee") == [("P1", 1.5, .5)]
    empty = store_aggregate(PLANT_MODEL, {**t, "work_orders": t["work_orders"].limit(0)}, "work_orders", names, [])
    assert rows(answer(PLANT_MODEL, gone, [empty], names, []), *names) == [(0, None, None)]
    odd = dataclasses.replace(PLANT_MODEL, metrics={"work_orders": {"most": lambda: F.max("downtime_min")}})
    with pytest.raises(ValueError):
        store_aggregate(odd, t, "work_orders", ["most"], [])


def ask(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "qid STRING, question STRING")


@pytest.mark.parametrize("text,tool,query", [
    ("MTTR by technician?", "analyst", "mttr_by_technician"), ("technician list", "search", None),
    ("", "none", None), ("Who is the worst technician?", "guard", "lowest_oee_assets_last_week"),
    ("Predict OEE for next quarter", "guard", None), ("Please draft a work order for P3", "draft", None),
    ("What fixed the bearing on P3?", "search", None), ("What is the OEE of each line?", "analyst", "oee_by_line_last_week"),
    ("Why was scrap rejected?", "analyst", "scrap_by_asset_last_week")])
def test_routing(spark, text, tool, query):
    r = questions.decide_tool(ask(spark, text)).first()
    assert (r.tool, r.query_name) == (tool, query)


def test_table_answers_narrow_to_the_mention(spark, table):
    q = ask(spark, "How many times has each asset failed, and why, like P1?", "What was the OEE for line 2 last week?",
            "What was the OEE for line 3 last week?")
    got = {r.qid: r for r in questions.table_answers(questions.decide_tool(q), plant(table)).collect()}
    assert "| P1 | M | 1 | 60 |" in got["0"].answer and got["0"].citations == ["verified query: breakdowns_by_asset_and_failure_mode"]
    assert "L2 | 0.7000" in got["1"].answer and "| L1 |" not in got["1"].answer
    assert "| L1 |" in got["2"].answer and "| L2 |" in got["2"].answer


def test_search_and_draft_answers(spark, table):
    cards = spark.createDataFrame([
        ("C1", "P3", "BEARING_WEAR", "FIX", "RESOLVED", 0.9, False, "bearing swapped", "bearing swapped", "Al", "T1"),
        ("C2", "P3", "BEARING_WEAR", "GOTCHA", "UNKNOWN", 0.85, True, "bearing alone fails", "bearing alone fails", None, "T2"),
        ("C3", "P1", "BEARING_WEAR", "FIX", "RESOLVED", 0.9, False, "bearing greased", "bearing greased", None, None)],
        "card_id STRING, asset_id STRING, failure_mode STRING, card_type STRING, outcome STRING, confidence DOUBLE, is_stale BOOLEAN, "
        "search_text STRING, source_excerpt STRING, author_name STRING, author_technician_id STRING")
    active = spark.createDataFrame([("E", "P3", 1), ("F", "P1", 0)], "anomaly_id STRING, asset_id STRING, urgency INT")
    drafts = spark.createDataFrame([(f"D{a}", a, "t", "body", "C1,C2") for a in "EF"],
                                   "draft_id STRING, anomaly_id STRING, title STRING, body STRING, cited_card_ids STRING")
    q = ask(spark, "What fixed the bearing on P3?", "draft a work order for P3", "raise a work order", "draft a work order for CV1", "zzz qqq?",
            "what is the salary of Ravi")
    got = {r.qid: r for r in questions.answer_questions(q, plant(table), cards, active, drafts).collect()}
    assert got["0"].citations == ["C1", "C2"] and '**What fixed it** (P3, Al): "bearing swapped"  [C1]' in got["0"].answer
    assert "Possibly stale (asset changed since): C2" in got["0"].answer
    assert "**DE**" in got["1"].answer and "**DF**" in got["2"].answer and got["1"].citations == ["C1", "C2"]
    assert [got[i].refused for i in "345"] == [True, True, True] and got["5"].tool == "guard"


# ---------------------------------------------------------------- checks
def test_checks(spark):
    df = spark.createDataFrame([("P3", 0.62), ("CV2", 0.85)], "asset_id STRING, oee DOUBLE")
    want = spark.createDataFrame([("P3", 0.6204), ("CV2", 0.9), ("XX", 0.5)], "asset_id STRING, oee DOUBLE")
    suite = quality.run_suite([
        quality.check_expected(df, want, ["asset_id"], {"oee": ("rel", 0.005)}, F.concat(F.lit("OEE "), "asset_id")),
        quality.check_set(df, "asset_id", ["P3", "CV2"], "set"), quality.check_set(df, "asset_id", ["P3"], "set too small"),
        quality.check_unique(df, ["asset_id"]), quality.check_unique(df.union(df), ["asset_id"], "twice"),
        quality.check_counts({"t": df}, {"t": 2}), quality.check_phrase_once(df, "asset_id", "CV")])
    got = {r.check_name: r.result for r in suite.collect()}
    assert got == {"OEE P3": "PASS", "OEE CV2": "FAIL", "OEE XX": "FAIL", "set": "PASS", "set too small": "FAIL",
                   "unique asset_id": "PASS", "twice": "FAIL", "row counts": "PASS", "phrase appears once: CV": "PASS"}


def test_scores(spark):
    q = spark.createDataFrame([("1", "a", False, ["Ring"], None), ("2", "a", False, None, "12"), ("3", "b", True, None, None),
                               ("4", "b", False, ["x"], None)],
                              "qid STRING, category STRING, refuse BOOLEAN, expect_any ARRAY<STRING>, first_number STRING")
    a = spark.createDataFrame([("1", "the ring", ["C"], False), ("2", "it is 13", ["C"], False), ("3", "I cannot. ok", [], False),
                               ("4", "x", ["C"], True)], "qid STRING, answer STRING, citations ARRAY<STRING>, refused BOOLEAN")
    s = quality.score_answers(q, a, "I cannot.")
    assert rows(s, "qid", "correct", "cited", "refused") == [("1", True, True, False), ("2", False, True, False),
                                                             ("3", True, False, True), ("4", False, False, True)]
    assert rows(quality.rollup_scores(s), "grp", "n", "n_correct") == [("a", 2, 1), ("all", 4, 2), ("answerable", 3, 1), ("b", 2, 1)]


# ---------------------------------------------------------------- streaming
def test_stream_recurrences_over_many_batches(spark, tmp_path):
    from millwright.operators.cards import recurrences
    ddl = "wo_id STRING, asset_id STRING, failure_mode_code STRING, wo_type STRING, reported_at TIMESTAMP_NTZ, closed_at TIMESTAMP_NTZ"
    data = [(f"W{i:03d}", "hot" if i % 3 else "b", "M", "CORRECTIVE", D0 + dt.timedelta(hours=(i * 37) % 1500),
             D0 + dt.timedelta(hours=(i * 37) % 1500 + 5)) for i in range(90)]
    src = tmp_path / "in"
    for b in range(3):  # out of time order across batches
        spark.createDataFrame(data[b::3], ddl).coalesce(1).write.mode("append").parquet(str(src))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(src))
    jobs.stream_recurrences(stream, out)
    want = rows(recurrences(spark.createDataFrame(data, ddl)), "wo_id", "recurred_by_wo", "recurred_after_days")
    assert rows(jobs.stored_recurrences(spark, out), "wo_id", "recurred_by_wo", "recurred_after_days") == want and want
    assert len(list((tmp_path / "out" / "found").glob("batch=*"))) == 3


def test_stream_sessions_split_like_islands(spark, tmp_path):
    hours = spark.createDataFrame([("A", D0 + dt.timedelta(hours=h), float(h)) for h in (0, 1, 4, 8)],
                                  "asset_id STRING, hr TIMESTAMP_NTZ, vib_resid_pct DOUBLE")
    hours.write.parquet(str(tmp_path / "h"))
    s = jobs.stream_sessions(spark.readStream.schema(hours.schema).parquet(str(tmp_path / "h")))
    got = rows(jobs.run_available(s, "complete"), "start_hr", "end_hr", "n_hours")
    assert got == [(D0, D0 + dt.timedelta(hours=4), 3), (D0 + dt.timedelta(hours=8),) * 2 + (1,)]


def _episodes(spark, flagged):
    """(asset, first, last, hours, peak) of episodes by plain loops: neighbours at most 3 hours apart belong together."""
    out = []
    for asset in sorted({f[0] for f in flagged}):
        for _, h, v in sorted(f for f in flagged if f[0] == asset):
            if out and out[-1][0] == asset and h - out[-1][2] <= dt.timedelta(hours=3):
                out[-1] = (asset, out[-1][1], h, out[-1][3] + 1, max(out[-1][4], abs(v)))
            else:
                out.append((asset, h, h, 1, abs(v)))
    return sorted(out, key=str)


@pytest.mark.parametrize("days", [4, 40])
def test_streamed_episodes_keep_a_bounded_state(spark, tmp_path, days):
    """One file a day, hours of a file in any order; ten times the history leaves no more state."""
    import random
    rng, ddl, flagged = random.Random(days), "asset_id STRING, hr TIMESTAMP_NTZ, vib_resid_pct DOUBLE", []
    for d in range(days):
        day = sorted({(rng.choice("ABC"), D0 + dt.timedelta(days=d, hours=rng.randrange(24))) for _ in range(20)}, key=lambda _: rng.random())
        flagged += [(a, h, rng.uniform(-50, 50)) for a, h in day]
        spark.createDataFrame(flagged[-len(day):], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "h"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "h"))
    progress = []
    got = jobs.session_rows(jobs.run_updates(jobs.stream_episodes(stream, late="30 hours"), ["asset_id", "start_hr"], progress=progress))
    assert rows(got, "asset_id", "start_hr", "end_hr", "n_hours", "peak_vib_pct") == _episodes(spark, flagged)
    assert len(progress) >= days and max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 3
    assert got.where("closed").count() > got.count() // 2 - 6


def test_stream_recurrences_open_only_the_days_they_can_reach(spark, tmp_path):
    from millwright.operators.cards import recurrences
    ddl = "wo_id STRING, asset_id STRING, failure_mode_code STRING, wo_type STRING, reported_at TIMESTAMP_NTZ, closed_at TIMESTAMP_NTZ"
    made = [(f"W{i:03d}", "ab"[i % 2], "M", "CORRECTIVE", D0 + dt.timedelta(days=i), D0 + dt.timedelta(days=i, hours=30)) for i in range(80)]
    for at in range(0, 80, 10):
        spark.createDataFrame(made[at:at + 10], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    files = []
    jobs.stream_recurrences(stream, str(tmp_path / "out"), files=files)
    want = rows(recurrences(spark.createDataFrame(made, ddl)), "wo_id", "recurred_by_wo", "recurred_after_days")
    assert rows(jobs.stored_recurrences(spark, str(tmp_path / "out")), "wo_id", "recurred_by_wo", "recurred_after_days") == want and want
    assert len(files) == 8 and files[-1] == files[2] <= 2 * (14 + 2)  # 70 days are stored by then


def test_update_refuses_two_changes_of_a_key(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    twice = spark.createDataFrame([(2, "c"), (2, "d")], "k int, v string")
    with pytest.raises(Exception, match="several changes"):
        tb.update_by_key(stored, twice, ["k"]).collect()
    once = tb.update_by_key(stored, twice.limit(1), ["k"]).collect()
    assert sorted(map(tuple, once)) == [(1, "a"), (2, "c")]


def test_stream_updates_survive_a_restart(spark, tmp_path):
    """A second run on the same checkpoint reads only new files; hours it adds to are replaced, others stay."""
    src, out, check = (str(tmp_path / n) for n in ("readings", "out", "check"))
    ddl = "asset_id STRING, ts TIMESTAMP_NTZ, current_a DOUBLE"

    def land(*readings):
        spark.createDataFrame([(a, dt.datetime(2024, 1, 1, h, m), c) for a, h, m, c in readings], ddl).coalesce(1).write.mode(
            "append").parquet(src)

    def run():
        stream = jobs.with_event_time(spark.readStream.schema(ddl).parquet(src), "ts", "2 hours")
        hours = stream.groupBy("asset_id", F.window("event_time", "1 hour").alias("hr")).agg(
            F.count("*").alias("n"), F.sum("current_a").alias("total"))
        hours = hours.withColumn("hr", F.hour("hr.start"))
        return rows(jobs.run_updates(hours, ["asset_id", "hr"], checkpoint=check, path=out), "asset_id", "hr", "n", "total")

    land(("A", 8, 0, 1.0), ("A", 9, 0, 2.0))
    assert run() == [("A", 8, 1, 1.0), ("A", 9, 1, 2.0)]
    land(("A", 9, 30, 4.0), ("B", 9, 0, 8.0))
    want = [("A", 8, 1, 1.0), ("A", 9, 2, 6.0), ("B", 9, 1, 8.0)]
    assert run() == want
    assert run() == want  # nothing new
