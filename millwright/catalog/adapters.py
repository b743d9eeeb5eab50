"""Views of the test tables in the shape of the plant tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.functions.exprs import add_hours, from_micros, micros
from millwright.params import CardParams, EpisodeParams, Lexicon, QuestionRules, SensorParams
from millwright.sources.tables import load

# Thresholds that leave episodes in the test events; the defaults leave almost none.
SENSOR = SensorParams(min_readings=1, z_limit=1.5)
EPISODE = EpisodeParams(linear_mode="FM1", match_at=0.5)
CARD = CardParams()

# Words of the invented corpus stand in for shop-floor words.
NOTE_LEXICON = Lexicon(
    asset_pattern=r"\b(the|und|les|una)\b",
    failure_modes=(("FM0", ("tion", "ung ")), ("FM1", ("ment", "sch ", "trial")), ("FM2", ("thor", "que "))),
    convention=("always ", "for and", "des le"), gotcha=("not ", "wh the", "nicht", "dans ", "dont ", "never "),
    symptom=("when ", "with ", " mit ", "avec "), fix=("on the", "der ", "est "), explicit_fix=("is on the",),
    recurred=("again", "re ", "ver", "came back"))
QUESTION_RULES = QuestionRules(
    asset_pattern=r"\b(the|und|les|una)\b", line_pattern=r"\b(?:is |de )([a-f])",
    refuse=(r"\b(ich|nous)\b", r"\b(with|avec)\b.*\b(the|les)\b", r"\bthat\b"),
    warning_hint=r"\b(not|nicht|pas)\b", draft_hint=r"\b(on|das)\b.*\bwas\b",
    analytic_hint=r"\b(for|and|des|der|el)\b",
    keywords=(
        ("oee_by_line_last_week", ("!for ", "is", "on ")),
        ("top_downtime_causes_this_month", ("!der ", "die", "en ")),
        ("mttr_by_technician", ("!des ", "les", "ment")),
        ("parts_at_risk_of_stockout", ("!el ", "los", "cion", "en ")),
        ("lowest_oee_assets_last_week", ("!and ", "th", "er")),
    ))


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Events as sensor readings: the type is the asset; two types have a pressure channel."""
    e = load(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("asset_id"), "ts", F.col("value").alias("vibration_rms"),
        F.get_json_object("props", "$.k").cast("double").alias("temperature_c"),
        F.when(F.col("event_type").isin("click", "error"), 100.0 + F.col("user_id") % 20).alias("pressure_bar"),
        F.col("value").alias("current_a"))


def event_assets(spark: SparkSession, sf: str) -> DataFrame:
    names = load(spark, sf, "events").select(F.col("event_type").alias("asset_id")).distinct()
    line = F.concat(F.lit("L"), (F.length("asset_id") % 3 + 1).cast("string"))
    return names.select("asset_id", F.concat(F.lit("Asset "), "asset_id").alias("asset_name"),
                        F.upper("asset_id").alias("asset_type"), line.alias("line_id"),
                        F.lit("A").alias("criticality"))


def production(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as production shifts."""
    q = F.col("l_quantity")
    return load(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("asset_id"), F.col("l_returnflag").alias("line_id"),
        F.col("l_shipdate").cast("date").alias("shift_date"), (10 * q).alias("planned_time_min"),
        (10 * q * (1 - F.col("l_discount"))).alias("run_time_min"),
        (10 * q * F.col("l_discount")).alias("downtime_min"), F.lit(1.5).alias("ideal_cycle_time_s"),
        (6 * q).alias("total_count"), (6 * q * (1 - F.col("l_tax"))).alias("good_count"))


def assets(spark: SparkSession, sf: str) -> DataFrame:
    s, n = load(spark, sf, "supplier"), load(spark, sf, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("s_suppkey").alias("asset_id"), F.col("s_name").alias("asset_name"),
        F.col("n_name").alias("asset_type"))


def _events_k(spark, sf):
    return load(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def _wo_id(c):
    return F.concat(F.lit("WO-"), F.lpad(c.cast("string"), 12, "0"))


def orders_wo(spark: SparkSession, sf: str) -> DataFrame:
    """Large event values as corrective work orders, the next band as preventive ones."""
    e = _events_k(spark, sf).filter(F.col("value") >= 130)
    k, text = F.col("k"), F.col("event_type")
    note = F.concat(
        text, F.lit(" stopped; part "), k.cast("string"), F.lit(" replaced. "),
        F.when(k % 3 == 0, F.concat(F.lit("Dont reuse part "), k.cast("string"), F.lit(", it came back. ")))
        .when(k % 3 == 1, F.lit("Never skip the check. ")).otherwise(F.lit("")), F.lit("Trial run ok."))
    return e.select(
        _wo_id(F.col("event_id")).alias("wo_id"), text.alias("asset_id"),
        F.when(F.col("value") >= 150, "CORRECTIVE").otherwise("PREVENTIVE").alias("wo_type"),
        F.lit("HIGH").alias("priority"),
        F.when(k % 8 != 0, F.concat(F.lit("FM"), (k % 4).cast("string"))).alias("failure_mode_code"),
        F.col("ts").alias("reported_at"), F.col("ts").alias("started_at"),
        from_micros(micros(F.col("ts")) + (30 + k) * 60_000_000).alias("closed_at"),
        (30 + k).alias("downtime_min"), F.concat(F.lit("T"), (F.col("user_id") % 8).cast("string"))
        .alias("technician_id"),
        F.concat((F.col("user_id") % 50).cast("string"), F.lit(":2;"), k.cast("string")).alias("parts_used"),
        note.alias("resolution_note"), F.when(k % 20 == 0, "OPEN").otherwise("CLOSED").alias("status"))


def corrective(spark: SparkSession, sf: str) -> DataFrame:
    return orders_wo(spark, sf).filter(F.col("wo_type") == "CORRECTIVE")


def technicians(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as technicians."""
    c = load(spark, sf, "customer")
    return c.select(F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("technician_id"),
                    F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("seniority"),
                    (F.col("c_custkey") % 4 == 0).alias("retiring_2027"))


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """Small event values as asset changes."""
    e = _events_k(spark, sf).filter(F.col("value") < 5)
    k = F.col("k")
    return e.select(
        F.concat(F.lit("CH-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("change_id"),
        F.col("event_type").alias("asset_id"), F.col("ts").alias("changed_at"),
        F.when(k % 3 == 0, "LUBRICANT_CHANGE").when(k % 3 == 1, "FIRMWARE_UPDATE").otherwise("PART_REPLACEMENT")
        .alias("change_type"),
        F.concat(F.lit("change "), F.col("event_id").cast("string")).alias("description"))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return load(spark, sf, "part").select(
        key.cast("string").alias("part_id"), F.col("p_name").alias("description"),
        F.col("p_size").cast("bigint").alias("stock_qty"), (key % 25).alias("reorder_point"),
        (key % 45).alias("lead_time_days"))


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as handover notes, one every minute from 2024-01-01."""
    d = load(spark, sf, "documents")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return d.select(
        F.concat(F.lit("HN-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("note_id"),
        from_micros(micros(start) + F.col("doc_id") * 60_000_000).alias("created_at"),
        F.col("lang").alias("note_type"), F.concat(F.lit("T"), F.substring("source", 4, 9))
        .alias("author_technician_id"), F.col("text").alias("note_text"))


def search_queries(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations").filter(F.col("role") == "user")
    return c.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("qid"),
                    F.col("text").alias("question"))
