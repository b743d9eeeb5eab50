"""Draft work orders for live anomalies, and the approval workflow as a fold over an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.exprs import add_hours, exploded, micros, parse_parts, split_list
from millwright.operators.intervals import positions
from millwright.operators.retrieval import top
from millwright.params import WorkflowParams
from millwright.schemas import SCHEMAS
from millwright.sources.tables import delete_by_key, delete_like, update_by_key


# ---------------------------------------------------------------- evidence
def select_evidence(ranked: DataFrame) -> DataFrame:
    """Recalled cards that a draft may use, by what they are used for.

    A card must be about the anomaly's asset and, when a failure mode is suspected, about that mode; warnings
    without a mode are kept as well.
    """
    mode = F.col("mode")
    same_mode = mode.isNull() | F.coalesce(F.col("failure_mode") == mode, F.lit(False))
    fix = F.col("card_type") == "FIX"
    use = (F.when(fix & (F.col("outcome") == "RESOLVED") & same_mode, "fix")
           .when((F.col("card_type") == "GOTCHA") & (same_mode | F.col("failure_mode").isNull()), "gotcha")
           .when(fix & (F.col("outcome") == "RECURRED") & same_mode, "recurred")
           .when(F.col("card_type") == "SYMPTOM_PATTERN", "symptom"))
    return ranked.withColumn("use", use).filter(F.col("use").isNotNull())


def first_evidence(evidence: DataFrame, params: WorkflowParams = WorkflowParams()) -> DataFrame:
    """The few cards each draft cites.

    Fixes written in handover notes come first, then the more certain, then the older ones; everything else is in
    ranking order.
    """
    fix = F.col("use") == "fix"
    order = [F.when(fix, F.col("source_type") != "HANDOVER_NOTE"),
             F.when(fix, -F.coalesce(F.col("confidence"), F.lit(0.0))),
             F.when(fix, F.col("created_at")).asc_nulls_last(),
             F.desc(F.round("score", 9)), F.asc("card_id")]
    limits = {"fix": 1 + params.similar_fixes, "gotcha": params.warnings, "recurred": params.recurred,
              "symptom": params.symptoms}
    limit = F.coalesce(*[F.when(F.col("use") == u, n) for u, n in limits.items()])
    return top(evidence, ["anomaly_id", "use"], max(limits.values()), order).filter(F.col("rank") <= limit)


def recommend_parts(evidence: DataFrame) -> DataFrame:
    """How often each part was used by the resolved fixes of an anomaly."""
    used = exploded(evidence.filter(F.col("use") == "fix"), parse_parts(F.col("parts")), ["anomaly_id"], "p")
    return used.groupBy("anomaly_id", F.col("p.part").alias("part_id")).agg(F.count("*").alias("n_used"))


def parts_risk(parts: DataFrame, stock: DataFrame) -> DataFrame:
    """Stock of the recommended parts; at risk when at or below the reorder point."""
    master = stock.select("part_id", "description", "stock_qty", "reorder_point", "lead_time_days",
                          F.lit(True).alias("in_master"))
    return parts.join(master, "part_id", "left").withColumns({
        "in_master": F.coalesce("in_master", F.lit(False)),
        "at_risk": F.coalesce(F.col("stock_qty") <= F.col("reorder_point"), F.lit(False))})


def recommend_technician(evidence: DataFrame, technicians: DataFrame) -> DataFrame:
    """Author of the most resolved fixes per anomaly; ties go to the higher id."""
    counts = evidence.filter((F.col("use") == "fix") & F.col("author_technician_id").isNotNull()).groupBy(
        "anomaly_id", "author_technician_id").agg(F.count("*").alias("n_fixes"))
    best = counts.groupBy("anomaly_id").agg(F.max(F.struct("n_fixes", "author_technician_id")).alias("b")).select(
        "anomaly_id", F.col("b.author_technician_id").alias("technician_id"), F.col("b.n_fixes").alias("n_fixes"))
    return best.join(technicians.select("technician_id", "full_name", "retiring_2027"), "technician_id", "left")


# ---------------------------------------------------------------- draft text
def _lines(*parts: Column) -> Column:
    """Concatenate arrays of lines."""
    return F.concat(*parts)


def _one(text: Column) -> Column:
    return F.array(text)


def _when(cond: Column, lines: Column) -> Column:
    return F.when(cond, lines).otherwise(F.array().cast("array<string>"))


def _cited(column: str, text) -> Column:
    """One line per card of an evidence array, ending in the card id."""
    return F.transform(F.col(column), lambda c: F.concat(text(c), F.lit("  ["), c["card_id"], F.lit("]")))


def _body(params: WorkflowParams) -> Column:
    """Markdown of a draft. The labels are fixed values; readers and tests look for them."""
    has_mode, has_eta = F.col("failure_mode").isNotNull(), F.col("eta_low_h").isNotNull()
    header = F.array_join(F.array_compact(F.array(
        F.format_string("**Asset:** %s (%s, line %s)", F.col("asset_id").cast("string"),
                        F.coalesce("asset_type", F.lit("")), F.coalesce("line_id", F.lit(""))),
        F.format_string("**Trigger:** anomaly %s: %s; vibration %+.1f%% vs profile, temperature %+.1f °C, %d h so far (%s)",
                        "anomaly_id", F.coalesce("sensors", F.lit("")), F.coalesce("vib_rise_pct", F.lit(0.0)),
                        F.coalesce("temp_rise_c", F.lit(0.0)), "duration_h", "vib_shape"),
        F.when(has_mode, F.format_string("**Suspected failure mode:** %s, matching %d past episode(s) on this asset",
                                         "failure_mode", "n_matches")),
        F.when(has_eta, F.format_string("**Failure window (ESTIMATE):** %.0f–%.0f h to threshold (%s)", "eta_low_h",
                                        "eta_high_h", F.coalesce("threshold_rule", F.lit("failure-mode threshold")))))),
        "\n\n")
    best = F.col("fixes")[0]
    repeats = F.transform(
        F.slice("fixes", 2, params.similar_fixes),
        lambda c: F.concat(F.lit("   - Same fix applied before: "), c["source_id"], F.lit(" by "),
                           F.coalesce(c["author_name"], c["author_technician_id"], F.lit("unknown")), F.lit("  ["),
                           c["card_id"], F.lit("]")))
    any_fix = F.size("fixes") > 0
    action = F.when(any_fix, F.concat(
        _one(F.concat(F.lit("1. "), best["action_taken"], F.lit("  ["), best["card_id"], F.lit("]"))), repeats)
    ).otherwise(_one(F.lit("1. No resolved fix on record for this pattern. Inspect and diagnose; capture findings in "
                           "the closing note.")))
    gotchas = _cited("gotchas", lambda c: F.concat(F.lit("- "), c["source_excerpt"]))
    recurred = _cited("recurred", lambda c: F.concat(F.lit("- Repeat "), c["source_id"], F.lit(": "),
                                                     c["outcome_basis"]))
    symptom = _cited("symptoms", lambda c: F.concat(F.lit("**Known symptom pattern:** "), c["source_excerpt"]))
    technician = F.concat(
        F.lit("**Suggested technician:** "), F.coalesce("technician_name", "recommended_technician_id"), F.lit(" ("),
        F.col("recommended_technician_id"), F.lit("), authored "), F.col("n_fixes").cast("string"),
        F.lit(" resolved fix(es) for this pattern"),
        F.when(F.col("retiring_2027"), "; retiring 2027, pair with a junior to transfer knowledge").otherwise(""))
    empty = _one(F.lit(""))
    warned = (F.size("gotchas") > 0) | (F.size("recurred") > 0)
    return F.array_join(_lines(
        _one(header), empty, _one(F.lit("**Recommended action**")), action,
        _when(warned, F.concat(empty, _one(F.lit("**Do NOT**")), gotchas, recurred)),
        _when(F.size("symptoms") > 0, F.concat(empty, symptom)),
        empty, _one(F.lit("**Parts**")),
        F.when(F.size("part_lines") > 0, F.col("part_lines")).otherwise(_one(F.lit("- none identified from past fixes"))),
        empty, _when(F.col("recommended_technician_id").isNotNull(), _one(technician)), empty,
        _one(F.lit("_Drafted automatically. Status PENDING_APPROVAL: a human must approve before work starts._"))),
        "\n")


def _part_texts(risk: DataFrame) -> DataFrame:
    """Ordered part lists of each anomaly; bounded by the parts catalogue, one entry per distinct part."""
    known = F.concat(
        F.format_string("- %s (%s): %d in stock, reorder point %d, lead time %d d", "part_id", "description",
                        "stock_qty", "reorder_point", "lead_time_days"),
        F.when(F.col("at_risk"), "  ⚠ AT RISK: reorder now").otherwise(""))
    line = F.when(F.col("in_master"), known).otherwise(F.concat(F.lit("- "), "part_id",
                                                                F.lit(": not in the spare-parts master")))
    item = F.struct((-F.col("n_used")).alias("o"), "part_id", line.alias("line"), "at_risk")
    items = F.array_sort(F.collect_list(item))
    return risk.groupBy("anomaly_id").agg(items.alias("i")).select(
        "anomaly_id", F.transform("i", lambda x: x["line"]).alias("part_lines"),
        F.array_join(F.transform("i", lambda x: x["part_id"]), ";").alias("parts"),
        F.array_join(F.transform(F.filter("i", lambda x: x["at_risk"]), lambda x: x["part_id"]), ";")
        .alias("parts_at_risk"))


def draft_orders(active: DataFrame, windows: DataFrame, ranked: DataFrame, stock: DataFrame, technicians: DataFrame,
                 now: Column, existing: DataFrame | None = None,
                 params: WorkflowParams = WorkflowParams()) -> DataFrame:
    """One cited draft per live anomaly, waiting for approval.

    Text is assembled from the few top cards per anomaly; parts and technician come from counts over all of them.
    """
    evidence = select_evidence(ranked)
    kept = ("card_id", "source_id", "action_taken", "author_name", "author_technician_id", "source_excerpt",
            "outcome_basis")
    card = F.struct("rank", *kept)
    lists = first_evidence(evidence, params).groupBy("anomaly_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("use") == use, card))).alias(name)
        for use, name in (("fix", "fixes"), ("gotcha", "gotchas"), ("recurred", "recurred"), ("symptom", "symptoms"))])
    parts = _part_texts(parts_risk(recommend_parts(evidence), stock))
    people = recommend_technician(evidence, technicians).select(
        "anomaly_id", F.col("technician_id").alias("recommended_technician_id"),
        F.col("full_name").alias("technician_name"), "n_fixes", "retiring_2027")
    df = active.withColumnRenamed("matched_failure_mode", "failure_mode")
    df = df.join(windows.select("anomaly_id", "threshold_rule"), "anomaly_id", "left")
    for part in (lists, parts, people):
        df = df.join(part, "anomaly_id", "left")
    names = ("fixes", "gotchas", "recurred", "symptoms")
    kinds = {n: lists.schema[n].dataType.simpleString() for n in names}
    df = df.withColumns({n: F.coalesce(F.col(n), F.array().cast(kinds[n])) for n in names})
    df = df.withColumns({"part_lines": F.coalesce("part_lines", F.array().cast("array<string>")),
                         "parts": F.coalesce("parts", F.lit("")),
                         "parts_at_risk": F.coalesce("parts_at_risk", F.lit(""))})
    mode_words = F.lower(F.regexp_replace("failure_mode", "_", " "))
    title = F.concat(F.col("asset_id").cast("string"), F.lit(": "), F.coalesce(mode_words, F.lit("anomaly")),
                     F.lit(", "), F.when(F.size("fixes") > 0, "planned repair").otherwise("inspect"))
    cited = F.array_distinct(F.concat(*[F.transform(F.col(n), lambda c: c["card_id"]) for n in names]))
    blank = {c: F.lit(None).cast(SCHEMAS["drafts"][c].dataType)
             for c in ("edited_by", "approved_by", "approved_at", "rejected_reason", "wo_id")}
    drafts = df.select(
        "anomaly_id", "asset_id", "failure_mode", F.lit("PENDING_APPROVAL").alias("status"), title.alias("title"),
        _body(params).alias("body"), "recommended_technician_id", "parts", "parts_at_risk", "eta_low_h", "eta_high_h",
        F.array_join(cited, ",").alias("cited_card_ids"), now.alias("created_at"),
        F.lit(params.drafted_by).alias("created_by"), *[v.alias(c) for c, v in blank.items()])
    return assign_draft_ids(drafts, existing)


def assign_draft_ids(drafts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``DRAFT-<anomaly>-<n>`` with n one above the drafts that anomaly already has."""
    n = F.lit(0).cast("bigint")
    if existing is not None:
        counts = existing.groupBy("anomaly_id").agg(F.count("*").alias("__n"))
        drafts = drafts.join(counts, "anomaly_id", "left")
        n = F.coalesce("__n", n)
    new_id = F.concat(F.lit("DRAFT-"), "anomaly_id", F.lit("-"), (n + 1).cast("string"))
    return drafts.select(new_id.alias("draft_id"), *[c for c in drafts.columns if c != "__n"])


# ---------------------------------------------------------------- workflow
def human_ok(name: Column, params: WorkflowParams = WorkflowParams()) -> Column:
    """A named person: not blank, and no reserved word anywhere in the name."""
    return F.coalesce((F.trim(name) != "") & ~name.rlike("(?i)" + "|".join(params.reserved)), F.lit(False))


_WHEN = ("event_ts", "event_id")


def fold_workflow(drafts: DataFrame, events: DataFrame, params: WorkflowParams = WorkflowParams()
                  ) -> tuple[DataFrame, DataFrame]:
    """Final state of every draft and the events that were refused.

    The first approval or rejection by a person decides; edits count until then, the last one wins. Both are
    aggregates with partial results before the shuffle, so a draft with very many events stays cheap.
    """
    known = events.join(drafts.select("draft_id").distinct(), "draft_id", "left_semi")
    by_person = known.filter(human_ok(F.col("actor"), params))
    decisions = by_person.filter(F.col("kind").isin("approve", "reject")).groupBy("draft_id").agg(
        F.min(F.struct(*_WHEN, "kind", "actor", "reason")).alias("d"))
    edits = by_person.filter(F.col("kind") == "edit").join(decisions, "draft_id", "left").filter(
        F.col("d").isNull() | (F.struct(*_WHEN) < F.struct("d.event_ts", "d.event_id")))
    last_edit = edits.groupBy("draft_id").agg(F.max(F.struct(*_WHEN, "body", "actor")).alias("e"))
    new = drafts.join(decisions, "draft_id", "left").join(last_edit, "draft_id", "left")
    rejected = F.col("d.kind") == "reject"
    changed = {
        "status": F.coalesce(F.when(F.col("d.kind") == "approve", "APPROVED").when(rejected, "REJECTED"), "status"),
        "body": F.coalesce("e.body", "body"), "edited_by": F.coalesce("e.actor", "edited_by"),
        "approved_by": F.coalesce("d.actor", "approved_by"), "approved_at": F.coalesce("d.event_ts", "approved_at"),
        "rejected_reason": F.coalesce(F.when(rejected, F.col("d.reason")), "rejected_reason")}
    state = new.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in drafts.columns])

    asked = events.filter(F.col("kind").isin("edit", "approve", "reject"))
    judged = asked.join(drafts.select("draft_id", F.lit(True).alias("known")).distinct(), "draft_id", "left").join(
        decisions, "draft_id", "left")
    late = F.struct(*_WHEN) > F.struct("d.event_ts", "d.event_id")
    why = F.when(~human_ok(F.col("actor"), params), "not a named human").when(
        F.col("known").isNull() | F.coalesce(late, F.lit(False)), "not pending approval")
    refused = judged.select(*[c for c in events.columns], why.alias("refused_because")).filter(
        F.col("refused_because").isNotNull())
    return state, refused


def number_orders(approved: DataFrame, last_wo_id: str | None, params: WorkflowParams = WorkflowParams()) -> DataFrame:
    """Consecutive order ids after ``last_wo_id`` in order of approval, without sorting everything in one task."""
    start = int(last_wo_id.rsplit("-", 1)[1]) if last_wo_id else 0
    rows = positions(approved.withColumn("__all", F.lit(1)), ["__all"], micros(F.col("approved_at")),
                     [F.col("draft_id")], "__nth")
    number = (F.col("__nth") + start).cast("string")
    padded = F.when(F.length(number) >= params.order_digits, number).otherwise(
        F.lpad(number, params.order_digits, "0"))
    return rows.withColumn("wo_id", F.concat(F.lit(params.order_prefix), padded)).drop("__all", "__nth")


def approved_orders(state: DataFrame, last_wo_id: str | None, params: WorkflowParams = WorkflowParams()) -> DataFrame:
    """New OPEN work orders of approved drafts that have none yet, with ``draft_id`` for writing the id back."""
    fresh = number_orders(state.filter((F.col("status") == "APPROVED") & F.col("wo_id").isNull()), last_wo_id, params)
    parts = F.array_join(F.transform(split_list(F.col("parts"), ";"), lambda p: F.concat(p, F.lit(":1"))), ";")
    none = {c: F.lit(None).cast(SCHEMAS["work_orders"][c].dataType)
            for c in ("closed_at", "downtime_min", "resolution_note")}
    return fresh.select(
        "draft_id", "wo_id", "asset_id", F.lit("CORRECTIVE").alias("wo_type"), F.lit("HIGH").alias("priority"),
        F.col("failure_mode").alias("failure_mode_code"), F.col("approved_at").alias("reported_at"),
        F.col("approved_at").alias("started_at"), none["closed_at"].alias("closed_at"),
        none["downtime_min"].alias("downtime_min"), F.col("recommended_technician_id").alias("technician_id"),
        parts.alias("parts_used"), none["resolution_note"].alias("resolution_note"), F.lit("OPEN").alias("status"))


def close_orders(work_orders: DataFrame, closes: DataFrame, params: WorkflowParams = WorkflowParams()) -> DataFrame:
    """Work orders after the first close event of each; only OPEN orders close."""
    first = closes.filter(F.col("kind") == "close").groupBy("wo_id").agg(
        F.min(F.struct(*_WHEN, "body", "technician_id", "repair_h")).alias("c"))
    hours = F.coalesce("c.repair_h", F.lit(params.repair_h))
    opened = work_orders.filter(F.col("status") == "OPEN").select("wo_id", "reported_at")
    changes = opened.join(first, "wo_id").select(
        "wo_id", F.lit("CLOSED").alias("status"), add_hours(F.col("reported_at"), hours).alias("closed_at"),
        F.floor(hours * 60).cast("bigint").alias("downtime_min"), F.col("c.body").alias("resolution_note"),
        F.col("c.technician_id").alias("technician_id"))
    return update_by_key(work_orders, changes, ["wo_id"])


def open_orders(work_orders: DataFrame, drafts: DataFrame) -> DataFrame:
    titles = drafts.filter(F.col("wo_id").isNotNull()).select("wo_id", "draft_id", "title")
    return work_orders.filter(F.col("status") == "OPEN").join(titles, "wo_id", "left").orderBy(F.desc("wo_id"))


def drafts_by_status(drafts: DataFrame, status: str | None = None) -> DataFrame:
    """Drafts, newest first."""
    chosen = drafts if status is None else drafts.filter(F.col("status") == status)
    return chosen.orderBy(F.desc("created_at"), F.desc("draft_id"))


def data_now(hourly: DataFrame) -> DataFrame:
    """One row: the hour after the last data hour."""
    return hourly.agg(add_hours(F.max("hr"), 1).alias("now"))


def reset(tables: dict[str, DataFrame], params: WorkflowParams = WorkflowParams()) -> dict[str, DataFrame]:
    """Tables without drafts, without the orders made from them and without demo notes, and the cards of both."""
    made = tables["drafts"].filter(F.col("wo_id").isNotNull()).select("wo_id").distinct()
    kept = {"drafts": tables["drafts"].limit(0), "work_orders": delete_by_key(tables["work_orders"], made),
            "handover_notes": delete_like(tables["handover_notes"], "note_id", params.demo_note_pattern)}
    for name in ("cards_raw", "card_extract_log"):
        rows = delete_by_key(tables[name], made.withColumnRenamed("wo_id", "source_id"))
        kept[name] = delete_like(rows, "source_id", params.demo_note_pattern)
    return {**tables, **kept}
