"""Cards read model: recurrence, staleness, derived outcome, and the graph between cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions.exprs import boundary_diff, from_micros, micros, unit_index
from millwright.operators.intervals import HOUR_US, count_until, interval_min, positions
from millwright.params import CardParams
from millwright.session import staged

DAY_US = 24 * HOUR_US
MINUTE_US = 60_000_000


def recurrences(work_orders: DataFrame, days: int = 14) -> DataFrame:
    """Corrective orders whose asset and failure mode were reported again within ``days`` days of closing.

    Smallest later order id and fewest days are separate minima. Orders without a failure mode never recur.
    """
    fixes = work_orders.filter(F.col("wo_type") == "CORRECTIVE").select(
        "wo_id", "asset_id", "failure_mode_code", "reported_at", "closed_at")
    again = interval_min(
        fixes, fixes, ["asset_id", "failure_mode_code"], "wo_id", lo=micros(F.col("closed_at")) + 1,
        at=micros(F.col("reported_at")),
        values={"recurred_by_wo": F.col("wo_id"), "first_again": micros(F.col("reported_at"))},
        length_us=days * DAY_US - 1)
    return again.join(fixes.select("wo_id", "closed_at"), "wo_id").select(
        "wo_id", "recurred_by_wo",
        boundary_diff("day", F.col("closed_at"), from_micros(F.col("first_again"))).alias("recurred_after_days"))


def fixing_changes(changes: DataFrame, work_orders: DataFrame, minutes: int = 60) -> DataFrame:
    """Asset changes recorded within ``minutes`` minutes of an order's close, that is, the repair itself."""
    def minute(ts):
        return unit_index("minute", F.col(ts)) * MINUTE_US

    near = interval_min(changes, work_orders, ["asset_id"], "change_id", lo=minute("changed_at") - minutes * MINUTE_US,
                        at=minute("closed_at"), values={"hit": F.lit(1)}, length_us=2 * minutes * MINUTE_US)
    return near.select("change_id")


def stale_cards(raw: DataFrame, sources: DataFrame, changes: DataFrame, fixing: DataFrame,
                params: CardParams = CardParams()) -> DataFrame:
    """Warnings and conventions whose asset got a new part or firmware after the text was written.

    Both inputs come out of joins and are read several times below, so their few key columns are written once.
    """
    relevant = changes.filter(F.col("change_type").isin(*params.stale_change_types)).join(
        fixing, "change_id", "left_anti").select("asset_id", "changed_at", "description")
    key = F.struct("source_type", "source_id", "card_seq")
    probes = raw.filter(F.col("card_type").isin(*params.stale_card_types)).select(
        "source_type", "source_id", "card_seq", "asset_id").join(
        sources.select("source_type", "source_id", "source_ts"), ["source_type", "source_id"]).select(
        key.alias("card"), "asset_id", "source_ts")
    found = interval_min(
        staged(probes, "stale_probes"), staged(relevant, "stale_changes"), ["asset_id"], "card", lo=micros(F.col("source_ts")) + 1, at=micros(F.col("changed_at")),
        values={"first_change_at": F.col("changed_at"), "change_description": F.col("description")}, length_us=None)
    return found.select("card.*", "first_change_at", "change_description")


def cards(raw: DataFrame, sources: DataFrame, work_orders: DataFrame, technicians: DataFrame, recur: DataFrame,
          stale: DataFrame) -> DataFrame:
    """Stored cards whose text is still current, with derived outcome, author and staleness.

    Order facts are joined on (source_type, source_id), so notes, which have no order, stay spread by their id. All
    facts meet as narrow rows, per source and then per card; the texts of the cards are joined once, by their key, and
    never dealt by author, of whom there are few.
    """
    current = sources.select("source_type", "source_id", "text_hash", "author_technician_id", "source_ts")
    order_facts = work_orders.select("wo_id", "failure_mode_code", "parts_used").join(recur, "wo_id", "left").select(
        F.lit("WORK_ORDER").alias("source_type"), F.col("wo_id").alias("source_id"), "failure_mode_code",
        F.col("parts_used").alias("order_parts"), "recurred_by_wo", "recurred_after_days")
    names = technicians.select(F.col("technician_id").alias("author_technician_id"),
                               F.col("full_name").alias("author_name"))
    by_source = current.join(order_facts, ["source_type", "source_id"], "left").join(names, "author_technician_id", "left")
    key = ["source_type", "source_id", "text_hash", "card_seq"]
    facts = raw.select(*key).distinct().join(by_source, key[:3]).join(stale, key[:2] + key[3:], "left").withColumnsRenamed(
        {c: f"__{c}" for c in key})
    df = raw.join(facts, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key])
    came_back = (F.col("card_type") == "FIX") & F.col("recurred_by_wo").isNotNull()
    return with_search_text(df.select(
        F.concat(F.lit("CARD-"), F.col("source_id"), F.lit("-"), F.col("card_seq").cast("string")).alias("card_id"),
        "card_type", "asset_id", F.coalesce("failure_mode", "failure_mode_code").alias("failure_mode"),
        "symptom_summary", "action_taken", F.coalesce("parts", "order_parts").alias("parts"),
        F.when(came_back, "RECURRED").otherwise(F.col("outcome")).alias("outcome"),
        F.when(came_back, F.concat(F.lit("recurrence rule: "), F.col("recurred_by_wo"),
                                   F.lit(" re-opened the same failure after "),
                                   F.col("recurred_after_days").cast("string"), F.lit(" days")))
        .otherwise("stated in source").alias("outcome_basis"),
        "recurred_by_wo", "author_technician_id", "author_name", "source_type", "source_id", "source_excerpt",
        "confidence", F.col("source_ts").alias("created_at"),
        F.col("first_change_at").isNotNull().alias("is_stale"), F.col("change_description").alias("stale_reason"),
        "extracted_by"))


def with_search_text(cards_df: DataFrame) -> DataFrame:
    """Cards with ``search_text``, which repeats three other columns: cards are stored without it, and it is made when they are read."""
    text = F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in ("symptom_summary", "action_taken", "source_excerpt")])
    others = [c for c in cards_df.columns if c not in ("search_text", "extracted_by")]
    return cards_df.select(*others, text.alias("search_text"), "extracted_by")


def cards_where(cards_df: DataFrame, predicate) -> DataFrame:
    """Cards that satisfy a condition, oldest first."""
    return cards_df.filter(predicate).orderBy("created_at", "card_id")


# ---------------------------------------------------------------- graph
def edges_about(cards_df: DataFrame) -> DataFrame:
    """Card to asset, failure mode and author, from one scan."""
    ends = [("ASSET", "asset_id", "ABOUT_ASSET"), ("FAILURE_MODE", "failure_mode", "ABOUT_FAILURE_MODE"),
            ("TECHNICIAN", "author_technician_id", "AUTHORED_BY")]
    targets = F.array(*[F.struct(F.lit(kind).alias("to_type"), F.col(c).cast("string").alias("to_id"),
                                 F.lit(relation).alias("relation")) for kind, c, relation in ends])
    return cards_df.select(F.lit("CARD").alias("from_type"), F.col("card_id").alias("from_id"),
                           F.explode(F.filter(targets, lambda t: t["to_id"].isNotNull())).alias("t")).select(
        "from_type", "from_id", "t.to_type", "t.to_id", "t.relation")


def _card_edge(df: DataFrame, relation: str) -> DataFrame:
    return df.select(F.lit("CARD").alias("from_type"), "from_id", F.lit("CARD").alias("to_type"), "to_id",
                     F.lit(relation).alias("relation"))


def edges_contradicts(cards_df: DataFrame) -> DataFrame:
    """The fix of the order that re-opened a failure contradicts the fix that did not hold."""
    older = cards_df.filter((F.col("outcome") == "RECURRED") & F.col("recurred_by_wo").isNotNull()).select(
        F.col("card_id").alias("to_id"), F.col("recurred_by_wo").alias("source_id"))
    newer = cards_df.filter((F.col("source_type") == "WORK_ORDER") & (F.col("card_type") == "FIX")).select(
        F.col("card_id").alias("from_id"), "source_id")
    return _card_edge(older.join(newer, "source_id"), "CONTRADICTS")


_PATTERN = ["asset_id", "failure_mode"]


def _resolved_fixes(cards_df: DataFrame) -> DataFrame:
    return cards_df.filter((F.col("card_type") == "FIX") & (F.col("outcome") == "RESOLVED")
                           & F.col("asset_id").isNotNull() & F.col("failure_mode").isNotNull()).select(
        *_PATTERN, "card_id", "source_id", "created_at")


def _recurred_fixes(cards_df: DataFrame) -> DataFrame:
    return cards_df.filter((F.col("outcome") == "RECURRED") & (F.col("card_type") == "FIX")
                           & F.col("recurred_by_wo").isNotNull() & F.col("asset_id").isNotNull()
                           & F.col("failure_mode").isNotNull()).select(
        *_PATTERN, "card_id", "recurred_by_wo", "created_at")


def resolved_fix_order(cards_df: DataFrame) -> DataFrame:
    """Resolved fixes numbered by time within asset and failure mode."""
    return positions(_resolved_fixes(cards_df), _PATTERN, micros(F.col("created_at")), [F.col("card_id")], "fix_no")


def supersession_spans(cards_df: DataFrame) -> DataFrame:
    """Which stretch of the numbered resolved fixes supersedes each fix that did not hold.

    The compact, linear-size form of the SUPERSEDES edges: fixes ``first_no`` to ``last_no`` of the same asset and
    failure mode, without the fix of the order ``except_source`` that re-opened it.
    """
    older = _recurred_fixes(cards_df)
    seen = count_until(older, _resolved_fixes(cards_df), _PATTERN, "card_id", micros(F.col("created_at")),
                       micros(F.col("created_at")))
    return older.join(seen, "card_id").filter(F.col("n_until") < F.col("n_total")).select(
        "card_id", *_PATTERN, (F.col("n_until") + 1).alias("first_no"), F.col("n_total").alias("last_no"),
        F.col("recurred_by_wo").alias("except_source"))


def expand_spans(spans: DataFrame, order: DataFrame, block: int = 1024, slices: int = 8, most: int = 2_000_000) -> DataFrame:
    """SUPERSEDES edges of the given spans, which should be stored, as they are read twice.

    A numbered block of fixes is one array, and a span meets the blocks it reaches. Blocks are met in ``slices`` parts of the spans
    and dealt to tasks of about ``most`` edges: spans are few bytes, and by their size alone they would be expanded in one task.
    """
    def block_of(c):
        return F.floor((c - 1) / block).cast("bigint")

    key = [*_PATTERN, "block", "slice"]
    edges = spans.agg(F.sum(F.col("last_no") - F.col("first_no") + 1)).first()[0] or 0
    tasks = min(max(1, -(-edges // most)), 10_000)
    wanted = spans.select(F.col("card_id").alias("to_id"), *_PATTERN, "first_no", "except_source", F.explode(
        F.sequence(block_of(F.col("first_no")), block_of(F.col("last_no")))).alias("block")).withColumn(
        "slice", F.pmod(F.xxhash64("to_id"), F.lit(slices)).cast("int"))
    fix = F.struct("fix_no", F.col("card_id").alias("from_id"), "source_id")
    blocks = order.groupBy(*_PATTERN, block_of(F.col("fix_no")).alias("block")).agg(F.collect_list(fix).alias("fixes")).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    met = wanted.repartition(tasks, *key).join(blocks.repartition(tasks, *key), key)
    hits = met.select("to_id", "first_no", "except_source", F.explode("fixes").alias("f")).filter(
        (F.col("f.fix_no") >= F.col("first_no")) & (F.col("f.source_id") != F.col("except_source")))
    return _card_edge(hits.select("to_id", F.col("f.from_id").alias("from_id")), "SUPERSEDES")


def edges_supersedes(cards_df: DataFrame) -> DataFrame:
    """Every later resolved fix supersedes a fix that did not hold; as many rows as there are such pairs."""
    return expand_spans(staged(supersession_spans(cards_df), "spans"), resolved_fix_order(cards_df))


def edges(cards_df: DataFrame) -> DataFrame:
    """The whole graph."""
    return edges_about(cards_df).unionByName(edges_contradicts(cards_df)).unionByName(edges_supersedes(cards_df))


def incident_edges(cards_df: DataFrame, ids: DataFrame, block: int = 1024) -> DataFrame:
    """Edges of the whole graph that touch one of the ids (column ``id``) at either end, each once, without expanding the graph.

    ABOUT and CONTRADICTS edges are linear in the cards and are filtered. Of the SUPERSEDES edges only the spans of the ids are
    expanded, and from the other end, for each resolved fix among the ids, the spans that reach it: those that start no later.
    Spans are met in blocks by their first number, so what is read beyond the result is at most a block per fix.
    """
    wanted = ids.select(F.col("id").cast("string").alias("id")).where("id IS NOT NULL").distinct()
    narrow = edges_about(cards_df).unionByName(edges_contradicts(cards_df))
    starts = narrow.join(wanted, narrow["from_id"] == wanted["id"], "left_semi")
    others = narrow.join(wanted, narrow["from_id"] == wanted["id"], "left_anti")
    found = starts.unionByName(others.join(wanted, others["to_id"] == wanted["id"], "left_semi"))
    spans = staged(supersession_spans(cards_df), "spans")
    order = staged(resolved_fix_order(cards_df), "fix_order")
    asked = staged(spans.join(wanted, spans["card_id"] == wanted["id"], "left_semi"), "asked_spans")
    older = expand_spans(asked, order, block)
    block_of = lambda c: F.floor((c - 1) / block).cast("bigint")
    fixes = order.join(wanted, order["card_id"] == wanted["id"], "left_semi").select(
        *_PATTERN, "fix_no", F.col("card_id").alias("from_id"), "source_id",
        F.explode(F.sequence(F.lit(0).cast("bigint"), block_of(F.col("fix_no")))).alias("block"))
    rest = spans.join(wanted, spans["card_id"] == wanted["id"], "left_anti").select(
        *_PATTERN, F.col("card_id").alias("to_id"), "first_no", "except_source", block_of(F.col("first_no")).alias("block"))
    newer = fixes.join(rest, [*_PATTERN, "block"]).where(
        (F.col("first_no") <= F.col("fix_no")) & (F.col("source_id") != F.col("except_source")))
    return found.unionByName(older).unionByName(_card_edge(newer, "SUPERSEDES"))


def edges_for(edge_df: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch one of the ids (column ``id``) at either end, each once."""
    wanted = ids.select("id").distinct()
    starts = edge_df.join(wanted, edge_df["from_id"] == wanted["id"], "left_semi")
    others = edge_df.join(wanted, edge_df["from_id"] == wanted["id"], "left_anti")
    return starts.unionByName(others.join(wanted, others["to_id"] == wanted["id"], "left_semi"))
