"""The learning loop on a few rows, also when it dies between two writes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millwright.operators import cards as cd
from millwright.plans import closed_loop as cl
from millwright.schemas import SCHEMAS
from millwright.session import fresh_path
from millwright.sources import store as module

D0 = dt.datetime(2024, 1, 1, 12)
AT = "2024-02-01 00:00:00"


def at(h):
    return D0 + dt.timedelta(hours=h)


@pytest.fixture
def loop(spark, table):
    orders = table([dict(wo_id="WO-0007", asset_id="P1", wo_type="CORRECTIVE", failure_mode_code="SEAL", status="OPEN", reported_at=at(0),
                         technician_id="T1"),
                    dict(wo_id="WO-0006", asset_id="P1", wo_type="CORRECTIVE", failure_mode_code="SEAL", status="CLOSED", reported_at=at(-9),
                         closed_at=at(-8), technician_id="T2", resolution_note="seal changed")], "work_orders")
    drafts = table([dict(draft_id=f"D{i}", anomaly_id=f"A{i}", asset_id="P1", failure_mode="SEAL", status="PENDING_APPROVAL", body="b",
                         parts="X;Y", recommended_technician_id="T3") for i in range(4)], "drafts")
    store = cl.open_store(spark, fresh_path(spark, "loop"), 3)
    cl.load_history(store, {"work_orders": orders, "drafts": drafts}, "rules", AT, label="history")
    return store


def events(table, *items):
    return table([dict(event_id=i, event_ts=at(10 + i), **e) for i, e in enumerate(items)], "workflow_events")


def orders(store):
    return sorted((r.wo_id, r.status, r.technician_id, r.downtime_min) for r in store.read("work_orders").collect())


def drafts(store):
    return sorted((r.draft_id, r.status, r.wo_id, r.body) for r in store.read("drafts").collect())


def decide(table):
    return events(table, dict(kind="edit", draft_id="D1", actor="Ann", body="edited"), dict(kind="approve", draft_id="D1", actor="Ann"),
                  dict(kind="approve", draft_id="D2", actor="my bot"), dict(kind="reject", draft_id="D3", actor="Bob", reason="no"),
                  dict(kind="close", wo_id="WO-0008", body="seal replaced. Never run it dry.", repair_h=2.0),
                  dict(kind="close", wo_id="WO-0006", body="closed before"), dict(kind="approve", draft_id="D0", actor="Cy"))


AFTER = ([("D0", "APPROVED", "WO-0009", "b"), ("D1", "APPROVED", "WO-0008", "edited"), ("D2", "PENDING_APPROVAL", None, "b"),
          ("D3", "REJECTED", None, "b")],
         [("WO-0006", "CLOSED", "T2", None), ("WO-0007", "OPEN", "T1", None), ("WO-0008", "CLOSED", "T3", 120), ("WO-0009", "OPEN", "T3", None)])


def test_a_batch_goes_all_the_way(table, loop):
    refused = cl.close_loop(loop, decide(table), "rules", AT, "one")
    assert [(r.draft_id, r.refused_because) for r in refused.collect()] == [("D2", "not a named human")]
    assert (drafts(loop), orders(loop)) == AFTER
    assert cl.close_loop(loop, decide(table), "rules", AT, "one") is None  # applied before
    assert (drafts(loop), orders(loop)) == AFTER
    again = cl.close_loop(loop, decide(table), "rules", AT, "the same events as another batch")
    assert {r.refused_because for r in again.collect()} == {"not a named human", "not pending approval"}
    assert (drafts(loop), orders(loop)) == AFTER

    note = table([dict(note_id="N1", created_at=at(40), note_type="SHIFT", author_technician_id="T1", note_text="P1 seal leak. Seal changed.")],
                 "handover_notes")
    cl.close_loop(loop, events(table, dict(kind="close", wo_id="WO-0009", body="kit replaced", technician_id="T9")), "rules", AT, "two", note)
    assert orders(loop)[-1] == ("WO-0009", "CLOSED", "T9", 300)
    cards = cl.cards(loop, table([], "asset_changes"), table([dict(technician_id="T9", full_name="Nine")], "technicians"))
    ids = sorted(r.card_id for r in cards.collect())
    assert ids == ["CARD-N1-1", "CARD-WO-0006-1", "CARD-WO-0008-1", "CARD-WO-0008-2", "CARD-WO-0009-1"]
    assert loop.read("card_extract_log").count() == 4
    new = cards.where("source_id = 'WO-0009'").select(F.col("card_id").alias("id"))
    got = sorted(tuple(r) for r in cd.incident_edges(cards, new).collect())
    assert got == sorted(tuple(r) for r in cd.edges_for(cd.edges(cards), new).collect()) and any(e[-1] == "CONTRADICTS" for e in got)


@pytest.mark.parametrize("dies_at", [0, 2, 4, 5, "commit"])
def test_a_batch_that_dies_between_two_writes(table, loop, monkeypatch, dies_at):
    """Nothing of it shows; run again it gives what it would have given."""
    before = drafts(loop), orders(loop), loop.read("cards_raw").count()
    write, done = module.Batch._write, []

    def failing(self, *args):
        if len(done) == dies_at:
            raise RuntimeError("died")
        done.append(args)
        return write(self, *args)

    with monkeypatch.context() as patch:
        if dies_at == "commit":
            patch.setattr(module.Batch, "commit", lambda self: (_ for _ in ()).throw(RuntimeError("died")))
        else:
            patch.setattr(module.Batch, "_write", failing)
        with pytest.raises(RuntimeError):
            cl.close_loop(loop, decide(table), "rules", AT, "one")
    assert (drafts(loop), orders(loop), loop.read("cards_raw").count()) == before
    cl.close_loop(loop, decide(table), "rules", AT, "one")
    assert (drafts(loop), orders(loop)) == AFTER and loop.read("cards_raw").count() == 3


def test_incident_edges_equal_the_expanded_graph(spark):
    import random
    rng = random.Random(2)
    ddl = ("card_id STRING, card_type STRING, asset_id STRING, failure_mode STRING, outcome STRING, recurred_by_wo STRING, "
           "author_technician_id STRING, source_type STRING, source_id STRING, created_at TIMESTAMP_NTZ")
    rows = [(f"C{i}", rng.choice(["FIX", "FIX", "GOTCHA"]), rng.choice(["P1", "P2", None]), rng.choice(["M", "N", None]),
             rng.choice(["RECURRED", "RESOLVED"]), rng.choice([f"W{rng.randrange(80)}", None]), rng.choice(["T1", None]), "WORK_ORDER", f"W{i}",
             at(rng.randrange(60))) for i in range(80)]
    cards = spark.createDataFrame(rows, ddl)
    graph = cd.edges(cards)
    for ids in (["C1"], [f"C{i}" for i in range(0, 80, 3)], ["P1", "M"], ["T1", "none"], []):
        asked = spark.createDataFrame([(i,) for i in [*ids, *ids]], "id STRING")
        want = sorted(tuple(r) for r in cd.edges_for(graph, asked).collect())
        assert sorted(tuple(r) for r in cd.incident_edges(cards, asked, block=4).collect()) == want
    assert set(SCHEMAS["edges"].fieldNames()) == set(graph.columns)
