"""Past failures that look like a live anomaly, and the failure window they suggest."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.exprs import add_hours, boundary_diff, micros, ratio_or_null
from millwright.operators.episodes import BITS, _bits
from millwright.operators.intervals import HOUR_US, interval_min
from millwright.params import EpisodeParams


def prefailure(anomalies: DataFrame, work_orders: DataFrame, within_h: int = 12) -> DataFrame:
    """Ended episodes with the first corrective order reported up to ``within_h`` hours after the end.

    A forward as-of join: the earliest (time, id) in an interval, found without pairing episodes and orders.
    """
    ended = anomalies.filter(~F.col("is_active"))
    orders = work_orders.filter(F.col("wo_type") == "CORRECTIVE")
    first = interval_min(
        ended, orders, ["asset_id"], "anomaly_id", lo=micros(F.col("end_hr")), at=micros(F.col("reported_at")),
        values={"first_order": F.struct("reported_at", "wo_id", F.col("failure_mode_code").alias("failure_mode"),
                                        "technician_id")},
        length_us=within_h * HOUR_US)
    return ended.select("anomaly_id", "asset_id", "start_hr", "end_hr").join(first, "anomaly_id").select(
        "anomaly_id", "asset_id", "start_hr", "end_hr", "first_order.wo_id", "first_order.failure_mode",
        "first_order.reported_at", "first_order.technician_id",
        boundary_diff("hour", F.col("start_hr"), F.col("first_order.reported_at")).alias("hours_start_to_failure"))


def signature_at_age(live: DataFrame, history: DataFrame, hours: DataFrame) -> DataFrame:
    """Signature of each past episode over its first hours only, as many as the live episode is old.

    An asset has at most one live episode, so the result has one row per past episode.
    """
    pairs = live.select(F.col("anomaly_id").alias("live_id"), "asset_id", F.col("duration_h").alias("live_age_h")).join(
        history.select("asset_id", F.col("anomaly_id").alias("hist_id"), "wo_id", "failure_mode",
                       "hours_start_to_failure", "technician_id", "start_hr"), "asset_id")
    rows = hours.join(pairs, ["asset_id", "start_hr"]).filter(F.col("age_h") < F.col("live_age_h"))
    keys = ["live_id", "live_age_h", "hist_id", "wo_id", "failure_mode", "hours_start_to_failure", "technician_id"]
    age, vib = F.col("age_h"), F.col("vib_resid_pct")
    return rows.groupBy(*keys).agg(
        *_bits(),
        (F.min(F.when(F.col("f_temp_up"), age)) - F.min(F.when(F.col("f_vib_up"), age))).alias("temp_lag_h"),
        ((F.avg(F.when(age > F.col("live_age_h") - 4, vib)) - F.avg(F.when(age <= 2, vib)))
         / F.greatest(F.col("live_age_h") - 2, F.lit(1))).alias("vib_slope_pct_h"))


def similarity(signatures: DataFrame, live: DataFrame, params: EpisodeParams = EpisodeParams()) -> DataFrame:
    """Channel overlap, slope similarity and temperature-lag similarity, each between 0 and 1."""
    mine = [*BITS, "temp_lag_h", "vib_slope_pct_h"]
    other = live.select(F.col("anomaly_id").alias("live_id"), *[F.col(c).alias(f"l_{c}") for c in mine])
    df = signatures.join(other, "live_id")
    shared = reduce(add, [F.least(F.col(b), F.col(f"l_{b}")) for b in BITS])
    either = reduce(add, [F.greatest(F.col(b), F.col(f"l_{b}")) for b in BITS])
    a, b = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("vib_slope_pct_h", "l_vib_slope_pct_h"))
    slope_gap = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(params.slope_floor))
    lag, live_lag = F.col("temp_lag_h"), F.col("l_temp_lag_h")
    return df.select(
        *signatures.columns, ratio_or_null(shared, either).alias("channel_sim"),
        F.when((F.col("s_vib_up") == 0) & (F.col("l_s_vib_up") == 0), 1.0).otherwise(
            1 - F.least(F.lit(1.0), slope_gap)).alias("slope_sim"),
        F.when(lag.isNull() & live_lag.isNull(), 1.0).when(lag.isNull() | live_lag.isNull(), 0.0).otherwise(
            1 - F.least(F.lit(1.0), F.abs(lag - live_lag) / params.lag_scale_h)).alias("lag_sim"))


def match_score(df: DataFrame, params: EpisodeParams = EpisodeParams()) -> DataFrame:
    w_channel, w_slope, w_lag = params.weights
    score = (w_channel * F.coalesce(F.col("channel_sim"), F.lit(0.0)) + w_slope * F.col("slope_sim")
             + w_lag * F.col("lag_sim"))
    return df.withColumn("score", score).withColumn("is_match", F.col("score") >= params.match_at)


def anomaly_matches(anomalies: DataFrame, history: DataFrame, hours: DataFrame,
                    params: EpisodeParams = EpisodeParams()) -> DataFrame:
    """Every live anomaly against the pre-failure episodes of its asset, with scores."""
    live = anomalies.filter("is_active")
    scored = match_score(similarity(signature_at_age(live, history, hours), live, params), params)
    return scored.select(F.col("live_id").alias("anomaly_id"), "hist_id", "wo_id", "failure_mode", "technician_id",
                         "hours_start_to_failure", "live_age_h", "channel_sim", "slope_sim", "lag_sim", "score",
                         "is_match")


def best_mode(matches: DataFrame) -> DataFrame:
    """Failure mode with the most matches per anomaly, then the best mean score, then by name."""
    per_mode = matches.filter("is_match").groupBy("anomaly_id", "failure_mode").agg(
        F.count("*").alias("n_matches"), F.avg("score").alias("avg_score"),
        F.median("hours_start_to_failure").alias("median_start_to_failure_h"))
    order = Window.partitionBy("anomaly_id").orderBy(
        F.desc("n_matches"), F.desc(F.round("avg_score", 9)), F.asc_nulls_last("failure_mode"))
    return per_mode.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


# Fixed value: the note that goes with every window.
WINDOW_NOTE = ("ESTIMATE: one bound = median time-to-failure of matched past episodes, the other = linear trend to "
               "threshold")


def failure_windows(anomalies: DataFrame, best: DataFrame, params: EpisodeParams = EpisodeParams()) -> DataFrame:
    """Low and high hours to failure of live anomalies that have a matched mode."""
    df = anomalies.filter("is_active").join(best, "anomaly_id")
    wears = F.col("failure_mode") == params.linear_mode
    linear = F.when(wears & (F.col("vib_slope_pct_h") > params.linear_min_slope),
                    ratio_or_null(params.linear_rise_pct - F.col("vib_rise_pct"), F.col("vib_slope_pct_h")))
    analog = F.col("median_start_to_failure_h") - F.col("duration_h")
    est = df.withColumn("linear_eta_h", linear).withColumn("analog_eta_h", analog)
    bounds = [F.coalesce(F.col("linear_eta_h"), F.col("analog_eta_h")), F.col("analog_eta_h")]
    return est.select(
        "anomaly_id", "asset_id", "failure_mode", "n_matches", "avg_score",
        F.when(wears, F.lit(params.linear_rule)).alias("threshold_rule"), "vib_rise_pct", "vib_slope_pct_h",
        "linear_eta_h", "analog_eta_h", F.least(*bounds).alias("eta_low_h"), F.greatest(*bounds).alias("eta_high_h"),
        F.lit(WINDOW_NOTE).alias("note"))


def active_anomalies(anomalies: DataFrame, windows: DataFrame, params: EpisodeParams = EpisodeParams()) -> DataFrame:
    """Live anomalies with the matched mode and a priority, most urgent first."""
    w = windows.select("anomaly_id", F.col("failure_mode").alias("matched_failure_mode"), "n_matches", "eta_low_h",
                       "eta_high_h")
    df = anomalies.filter("is_active").join(w, "anomaly_id", "left")
    urgent = F.coalesce(F.col("eta_low_h") <= params.critical_within_h, F.lit(False))
    df = df.withColumn("priority", F.when(urgent, "CRITICAL").otherwise(F.col("severity")))
    return df.withColumn("urgency", F.when(urgent, 0).when(F.col("severity") == "HIGH", 1).when(
        F.col("severity") == "MEDIUM", 2).otherwise(3)).orderBy("urgency", "asset_id")


def match_details(matches: DataFrame, work_orders: DataFrame, technicians: DataFrame) -> DataFrame:
    """Matches with the order and technician behind them, best score first."""
    orders = work_orders.select("wo_id", "reported_at", "closed_at", "resolution_note")
    names = technicians.select("technician_id", F.col("full_name").alias("technician"))
    return matches.join(orders, "wo_id").join(names, "technician_id", "left").orderBy(
        "anomaly_id", F.desc("score"), "hist_id")


def aligned_traces(scores: DataFrame, anomalies: DataFrame, matches: DataFrame, before_h: int = 12,
                   after_h: int = 48) -> DataFrame:
    """Residuals of live anomalies and of their matched episodes on hours since the start, for all anomalies at once.

    Intervals are cut into days, so the range join has (asset, day) as its equality key.
    """
    live = anomalies.filter("is_active").select(
        "anomaly_id", "asset_id", F.concat(F.lit("LIVE "), F.date_format("start_hr", "dd MMM")).alias("series"),
        F.lit(True).alias("live"), F.col("start_hr").alias("origin"), F.col("end_hr").alias("until"))
    stop = F.least(F.lit(after_h), F.coalesce(F.nullif(F.col("hours_start_to_failure"), F.lit(0)), F.lit(after_h)))
    starts = anomalies.select(F.col("anomaly_id").alias("hist_id"), "asset_id", F.col("start_hr").alias("origin"))
    past = matches.filter("is_match").select("anomaly_id", "hist_id", "wo_id", "hours_start_to_failure").join(
        starts, "hist_id").select(
        "anomaly_id", "asset_id",
        F.concat(F.col("wo_id").cast("string"), F.lit(" ("), F.date_format("origin", "dd MMM"), F.lit(")")
                 ).alias("series"),
        F.lit(False).alias("live"), "origin", add_hours(F.col("origin"), stop.cast("double")).alias("until"))
    series = live.unionByName(past).withColumn("since", add_hours(F.col("origin"), -before_h))
    per_day = series.withColumn("day", F.explode(F.expr(
        "sequence(cast(since as date), cast(until as date), interval 1 day)")))
    hours = scores.select("asset_id", "hr", F.col("hr").cast("date").alias("day"), "vib_resid_pct", "temp_resid_c")
    return hours.join(per_day, ["asset_id", "day"]).filter(
        (F.col("hr") >= F.col("since")) & (F.col("hr") <= F.col("until"))).select(
        "anomaly_id", "series", "live",
        ((micros(F.col("hr")) - micros(F.col("origin"))) / HOUR_US).alias("hours_since_start"),
        "vib_resid_pct", "temp_resid_c")
