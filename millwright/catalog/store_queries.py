"""Stored tables that change: merge on read, the search index kept up to date, the closed loop."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from millwright.catalog import adapters as a
from millwright.catalog import knowledge_queries as kq
from millwright.catalog import operations_queries as oq
from millwright.catalog.sql import FRAGMENTS, compose, define
from millwright.functions.exprs import out
from millwright.operators import cards as cd
from millwright.operators import health
from millwright.operators import retrieval as rt
from millwright.operators.search_index import SearchIndex
from millwright.plans import closed_loop as cl
from millwright.session import fresh_path
from millwright.sources.days import DayTable
from millwright.sources.store import Store, Table


# ---------------------------------------------------------------- merge on read
def merge_on_read(spark, sf):
    """Orders after a close of the open ones, a deletion, a compaction and the return of some of the deleted."""
    orders = a.orders_wo(spark, sf).select("wo_id", "asset_id", "status", "downtime_min", "technician_id")
    store = Store(spark, fresh_path(spark, "store"), [Table("orders", orders.schema, ("wo_id",), 8)])
    batch = store.batch("load")
    batch.insert("orders", orders)
    batch.commit()
    batch = store.batch("close")
    batch.update("orders", orders.where("status = 'OPEN'").select(
        "wo_id", F.lit("CLOSED").alias("status"), (F.col("downtime_min") * 2).alias("downtime_min"),
        F.lit(None).cast("string").alias("technician_id")))
    batch.commit()
    batch = store.batch("delete")
    batch.delete("orders", orders.where("wo_id LIKE '%7'"))
    batch.commit()
    store.compact("orders", most=2)
    batch = store.batch("return")
    batch.insert("orders", orders.where("wo_id LIKE '%17'").withColumn("status", F.lit("BACK")))
    batch.update("orders", orders.where("wo_id LIKE '%37'").select("wo_id", F.lit("GONE").alias("status")))  # no longer stored
    batch.commit()
    return store.read("orders")


# ---------------------------------------------------------------- search index
def search_refresh(spark, sf):
    """Top hits of an index after three appends, one of them with changed texts, a deletion and a merge of segments."""
    index = SearchIndex(spark, fresh_path(spark, "index"))
    notes = a.notes(spark, sf).select(F.col("note_id").alias("doc_id"), F.col("note_text").alias("doc_text"), "note_type")
    english, german = F.col("note_type") == "en", F.col("note_type") == "de"
    index.refresh(notes.where(english).withColumn("doc_text", F.when(F.col("doc_id").endswith("5"), F.lit("an early text")).otherwise(F.col("doc_text"))), "en")
    index.refresh(notes.where(german), "de")
    index.refresh(notes.where(F.coalesce(~german, F.lit(True))), "rest")  # the English texts again, of which some have changed
    index.delete(notes.where("doc_id LIKE '%9'"), "delete")
    index.merge(most=1)  # three segments are too few for a merge by size
    hits = index.search(kq._searches(spark, sf), 10)
    return hits.withColumn("score", out(F.col("score")))


def search_index_scoped(spark, sf):
    """Searches of an index in which every card belongs to its asset: one query per asset and failure mode."""
    cards = kq.cards_frame(spark, sf).where("asset_id IS NOT NULL")
    index = SearchIndex(spark, fresh_path(spark, "index"))
    index.refresh(rt.card_documents(cards).select(F.col("card_id").alias("doc_id"), "doc_text", F.col("asset_id").alias("scope")))
    asked = cards.where("failure_mode IS NOT NULL").select(
        F.concat_ws("/", "asset_id", "failure_mode").alias("query_id"), F.col("asset_id").alias("scope"),
        F.concat_ws(" ", "asset_id", F.lit("part replaced trial run"), "failure_mode").alias("query_text")).distinct()
    hits = index.search(rt.tokenised(asked, "query_text", kq.RULES), 5, scoped=True)
    return hits.withColumn("score", out(F.col("score")))


# ---------------------------------------------------------------- closed loop
def _loop(spark, sf):
    """The loop over the test tables: history, one batch of decisions, one that closes every open order, and both again."""
    store = cl.open_store(spark, fresh_path(spark, "loop"))
    drafts = oq._workflow_drafts(spark, sf)
    cl.load_history(store, {"drafts": drafts, "work_orders": a.orders_wo(spark, sf), "handover_notes": a.notes(spark, sf)},
                    kq.BY, kq.STAMP, kq.LEX, "history")
    decisions = oq._workflow_events(spark, sf).where("kind <> 'view'")

    def closes():
        waiting = store.read("work_orders").where("status = 'OPEN'")
        null = F.lit(None).cast("string")
        return waiting.select(
            F.xxhash64("wo_id").alias("event_id"), F.col("reported_at").alias("event_ts"), F.lit("close").alias("kind"), null.alias("draft_id"),
            "wo_id", F.lit("Anna 1").alias("actor"), F.concat("asset_id", F.lit(" fixed by hand. Never skip the check.")).alias("body"),
            null.alias("reason"), F.when(F.col("wo_id").endswith("3"), "T9").alias("technician_id"), F.lit(2.5).alias("repair_h"))

    for _ in range(2):
        cl.close_loop(store, decisions, kq.BY, kq.STAMP, "decide", lexicon=kq.LEX, params=oq.WORKFLOW)
        cl.close_loop(store, closes(), kq.BY, kq.STAMP, "close", lexicon=kq.LEX, params=oq.WORKFLOW)
    return store


def close_loop(spark, sf):
    """Every order closed by the loop, the draft it came from, and the cards of its closing note."""
    store = _loop(spark, sf)
    note = F.col("resolution_note").endswith("fixed by hand. Never skip the check.")
    orders = store.read("work_orders").where(note).select(
        "wo_id", "asset_id", "wo_type", "failure_mode_code", "reported_at", "closed_at", "downtime_min", "technician_id", "parts_used", "status")
    drafts = store.read("drafts").where("wo_id IS NOT NULL").select("wo_id", "draft_id", F.col("status").alias("draft_status"), "approved_by", "body")
    cards = store.read("cards_raw").select(
        F.col("source_id").alias("wo_id"), "text_hash", "card_seq", "card_type", "failure_mode", "symptom_summary", "action_taken", "parts",
        "outcome", "confidence")
    return orders.join(drafts, "wo_id", "left").join(cards, "wo_id", "left")


def close_loop_edges(spark, sf):
    """Edges that the cards of the closing notes bring into the graph."""
    store = _loop(spark, sf)
    cards = cl.cards(store, a.changes(spark, sf), a.technicians(spark, sf), a.CARD)
    closed = store.read("work_orders").where(F.col("resolution_note").endswith("fixed by hand. Never skip the check.")).select(
        F.col("wo_id").alias("source_id"))
    ids = cards.where("source_type = 'WORK_ORDER'").join(closed, "source_id", "left_semi")
    return cd.incident_edges(cards, ids.select(F.col("card_id").alias("id")))


def trailing_stored(spark, sf):
    """The last days of every asset's readings, stored by day in two batches, the first of them twice."""
    readings = a.readings(spark, sf)
    table = DayTable(spark, fresh_path(spark, "readings"), readings.schema, "asset_id", "ts", slots=4)
    early = F.coalesce(F.dayofmonth("ts") <= 15, F.lit(False))
    for batch, rows in (("early", readings.where(early)), ("early", readings.where(early)), ("late", readings.where(~early))):
        table.append(rows, batch)
    return health.trailing_stored(table, 8)


# ---------------------------------------------------------------- SQL
_D = f"SELECT note_id AS d, {kq.token_list('note_text')} AS toks FROM notes_v WHERE note_id NOT LIKE '%9'"
kq.bm25_sql("refreshed", kq._Q, _D)
kq.bm25_sql("scopes", f"""
SELECT DISTINCT asset_id || '/' || failure_mode AS q, asset_id AS scope, {kq.token_list("asset_id || ' part replaced trial run ' || failure_mode")} AS toks
FROM cards_v WHERE asset_id IS NOT NULL AND failure_mode IS NOT NULL""",
            "SELECT card_id AS d, asset_id AS scope, " + kq.token_list("search_text || ' ' || replace(coalesce(failure_mode, ''), '_', ' ')")
            + " AS toks FROM cards_v WHERE asset_id IS NOT NULL", scoped=True)

define("loop_new_v", """
SELECT 'WO-' || CASE WHEN length(num) >= 4 THEN num ELSE lpad(num, 4, '0') END AS wo_id, 'asset ' || (user_id % 5) AS asset_id,
       'CORRECTIVE' AS wo_type, 'FM1' AS failure_mode_code, approved_at AS reported_at, 'T1' AS technician_id, 'A:1;B:1' AS parts_used,
       draft_id, approved_by, body
FROM (SELECT *, CAST((SELECT max(CAST(split_part(wo_id, '-', 2) AS BIGINT)) FROM orders_all_v)
                     + row_number() OVER (ORDER BY approved_at, draft_id) AS VARCHAR) AS num
      FROM state_v WHERE status = 'APPROVED')""")
define("loop_closed_v", """
SELECT wo_id, asset_id, wo_type, failure_mode_code, reported_at, reported_at + to_minutes(150) AS closed_at, CAST(150 AS BIGINT) AS downtime_min,
       CASE WHEN wo_id LIKE '%3' THEN 'T9' ELSE technician_id END AS technician_id, parts_used,
       asset_id || ' fixed by hand. Never skip the check.' AS resolution_note, 'CLOSED' AS status
FROM (SELECT wo_id, asset_id, wo_type, failure_mode_code, reported_at, technician_id, parts_used FROM loop_new_v
      UNION ALL SELECT wo_id, asset_id, wo_type, failure_mode_code, reported_at, technician_id, parts_used FROM orders_all_v
      WHERE status = 'OPEN')""")
define("loop_orders_all_v", """
SELECT wo_id, asset_id, wo_type, failure_mode_code, reported_at, closed_at, downtime_min, technician_id, parts_used, resolution_note, status
FROM orders_all_v WHERE status = 'CLOSED'
UNION ALL SELECT * FROM loop_closed_v""")
# The fragments from orders to edges once more, over the orders after the loop.
_AGAIN = ("orders_v", "sources_v", "wo_sentences_v", "wo_cards_v", "raw_v", "recur_v", "fixing_v", "stale_v", "cards_v", "about_v",
          "contradicts_v", "supersedes_v", "edges_v")
for _name in _AGAIN:
    define(f"loop_{_name}", re.sub(r"\b(" + "|".join((*_AGAIN, "orders_all_v")) + r")\b", r"loop_\1", FRAGMENTS[_name]))

define("loop_made_v", "SELECT card_id FROM loop_cards_v WHERE source_id IN (SELECT wo_id FROM loop_closed_v)")

QUERIES = {f.__name__: f for f in (merge_on_read, search_refresh, search_index_scoped, close_loop, close_loop_edges, trailing_stored)}
ORACLES = {
    "trailing_stored": compose("SELECT * FROM recent_v"),
    "merge_on_read": compose("""
SELECT wo_id, asset_id, CASE WHEN wo_id LIKE '%17' THEN 'BACK' ELSE 'CLOSED' END AS status,
       CASE WHEN wo_id NOT LIKE '%17' AND status = 'OPEN' THEN 2 ELSE 1 END * downtime_min AS downtime_min, technician_id
FROM orders_all_v WHERE wo_id NOT LIKE '%7' OR wo_id LIKE '%17'"""),
    "search_refresh": compose(f"""
SELECT q AS query_id, d AS doc_id, {kq.near("score")} AS score, position FROM refreshed_hit_v WHERE position < 10"""),
    "search_index_scoped": compose(f"""
SELECT q AS query_id, d AS doc_id, {kq.near("score")} AS score, position FROM scopes_hit_v WHERE position < 5"""),
    "close_loop": compose("""
SELECT o.wo_id, o.asset_id, o.wo_type, o.failure_mode_code, o.reported_at, o.closed_at, o.downtime_min, o.technician_id, o.parts_used, o.status,
       n.draft_id, CASE WHEN n.draft_id IS NOT NULL THEN 'APPROVED' END AS draft_status, n.approved_by, n.body, r.text_hash, r.card_seq,
       r.card_type, r.failure_mode, r.symptom_summary, r.action_taken, r.parts, r.outcome, r.confidence
FROM loop_closed_v o LEFT JOIN loop_new_v n USING (wo_id) LEFT JOIN loop_wo_cards_v r ON r.source_id = o.wo_id"""),
    "close_loop_edges": compose("""
SELECT from_type, from_id, to_type, to_id, relation FROM loop_edges_v
WHERE from_id IN (SELECT card_id FROM loop_made_v) OR to_id IN (SELECT card_id FROM loop_made_v)"""),
}
