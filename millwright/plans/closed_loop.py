"""The learning loop as one job: decide drafts, number their orders, close jobs, turn closing notes into cards.

All tables live in one ``Store``, and a batch of events is one commit over drafts, orders, notes, cards and the extraction log.
A run that dies between two writes leaves nothing visible; run again under its label, a batch counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.operators import cards as cd
from millwright.operators import extraction as ex
from millwright.operators.workorders import approved_orders, close_orders, fold_workflow
from millwright.params import CardParams, Lexicon, WorkflowParams
from millwright.schemas import SCHEMAS
from millwright.session import staged
from millwright.sources.store import Store, Table

KEYS = {"drafts": ("draft_id",), "work_orders": ("wo_id",), "handover_notes": ("note_id",),
        "cards_raw": (*ex.SOURCE_KEY, "card_seq"), "card_extract_log": tuple(ex.SOURCE_KEY)}
_DECIDED = ["draft_id", "status", "body", "edited_by", "approved_by", "approved_at", "rejected_reason"]


def open_store(spark: SparkSession, root: str, buckets: int = 16) -> Store:
    """The loop's tables under ``root``, empty or as left by earlier batches."""
    return Store(spark, root, [Table(name, SCHEMAS[name], keys, buckets) for name, keys in KEYS.items()])


def shaped(rows: DataFrame, name: str) -> DataFrame:
    """Rows with exactly the columns of a stored table; missing ones are null, others are left out."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])


def _extract(batch, sources: DataFrame, log: DataFrame, by: str, at: Column | str, lexicon: Lexicon) -> None:
    todo = staged(ex.with_cards(ex.pending(sources, log), lexicon).drop("source_text"), "extracted")
    batch.insert("cards_raw", shaped(ex.number_cards(todo, by, at), "cards_raw"))
    batch.insert("card_extract_log", shaped(ex.extract_log(todo, by, at), "card_extract_log"))


def load_history(store: Store, tables: dict[str, DataFrame], by: str, at: Column | str, lexicon: Lexicon = Lexicon(),
                 label: str | None = None) -> None:
    """First content of the store: drafts, orders and notes as they are, and the cards of all their texts."""
    batch = store.batch(label)
    if batch.done:
        return
    for name, rows in tables.items():
        batch.insert(name, shaped(rows, name))
    none = lambda name: store.spark.createDataFrame([], SCHEMAS[name])
    sources = ex.card_sources(tables.get("work_orders", none("work_orders")), tables.get("handover_notes", none("handover_notes")))
    _extract(batch, sources, store.read("card_extract_log"), by, at, lexicon)
    batch.commit()


def close_loop(store: Store, events: DataFrame, by: str, at: Column | str, label: str | None = None, notes: DataFrame | None = None,
               lexicon: Lexicon = Lexicon(), params: WorkflowParams = WorkflowParams()) -> DataFrame | None:
    """Apply one batch of workflow events and new notes; returns the events that were refused, None if ``label`` was applied before.

    Edits, approvals and rejections fold into the drafts that still wait. An approved draft gets the next order number, which is
    written back on it, and an OPEN order. Close events then close open orders, also those of this batch. Cards are taken from the
    notes of the orders closed here and from ``notes``. Only rows that change are written.
    """
    batch = store.batch(label)
    if batch.done:
        return None
    drafts = store.read("drafts")
    pending = drafts.where(F.col("status") == "PENDING_APPROVAL")
    state, refused = fold_workflow(pending, events, params)
    touched = events.where(F.col("kind").isin("edit", "approve", "reject")).select("draft_id").distinct()
    state = staged(state.join(touched, "draft_id", "left_semi"), "decided")
    orders = store.read("work_orders")
    new = staged(approved_orders(state, orders.agg(F.max("wo_id")).first()[0], params), "new_orders")
    batch.update("drafts", state.select(*_DECIDED).join(new.select("draft_id", "wo_id"), "draft_id", "left"))
    batch.insert("work_orders", shaped(new, "work_orders"))

    closes = events.where(F.col("kind") == "close")
    waiting = orders.unionByName(shaped(new, "work_orders")).where(F.col("status") == "OPEN").join(
        closes.select("wo_id").distinct(), "wo_id", "left_semi")
    closed = staged(close_orders(waiting, closes, params), "closed")
    batch.update("work_orders", closed.select("wo_id", "status", "closed_at", "downtime_min", "resolution_note", "technician_id"))

    notes = store.spark.createDataFrame([], SCHEMAS["handover_notes"]) if notes is None else shaped(notes, "handover_notes")
    batch.insert("handover_notes", notes)
    _extract(batch, ex.card_sources(closed, notes), store.read("card_extract_log"), by, at, lexicon)
    refused = staged(refused, "refused")
    batch.commit()
    return refused


def cards(store: Store, changes: DataFrame, technicians: DataFrame, params: CardParams = CardParams()) -> DataFrame:
    """The cards read model over the store as it is."""
    orders, notes = staged(store.read("work_orders"), "orders"), store.read("handover_notes")
    raw = staged(store.read("cards_raw"), "cards_raw")
    keys = staged(ex.card_sources(orders, notes).drop("source_text"), "sources")
    stale = cd.stale_cards(raw, keys, changes, cd.fixing_changes(changes, orders, params.fix_window_min), params)
    found = cd.cards(raw, keys, orders, technicians, cd.recurrences(orders, params.recur_days), stale)
    return cd.with_search_text(staged(found.drop("search_text"), "cards"))
