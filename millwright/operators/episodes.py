"""Flagged hours to anomaly episodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.exprs import add_hours, boundary_diff, stamp
from millwright.operators.scoring import FLAGS, RESIDUAL_NAMES
from millwright.params import EpisodeParams

BITS = tuple("s" + f[1:] for f in FLAGS)
_SENSOR_WORDS = dict(zip(BITS, ("vibration", "temperature", "pressure-drop", "current", "current-noise",
                                "pressure-noise")))


def islands(df: DataFrame, key: str, ts: str, max_gap: int) -> DataFrame:
    """Number runs of hours per key; a run ends when the next hour is more than ``max_gap`` hours away.

    Expects at most one row per key and hour, which bounds a window partition by the history in hours.
    """
    w = Window.partitionBy(key).orderBy(ts)
    before = F.lag(ts).over(w)
    starts = before.isNull() | (boundary_diff("hour", before, F.col(ts)) > max_gap)
    marked = df.withColumn("__start", starts.cast("bigint"))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("island", F.sum("__start").over(running)).drop("__start")


def with_age(df: DataFrame) -> DataFrame:
    """Start of the island and hours since then."""
    start = F.min("hr").over(Window.partitionBy("asset_id", "island"))
    return df.withColumn("start_hr", start).withColumn("age_h", boundary_diff("hour", F.col("start_hr"), F.col("hr")))


def anomaly_hours(scores: DataFrame, params: EpisodeParams = EpisodeParams()) -> DataFrame:
    """Hours with any flag set, numbered and aged. A NULL flag counts as not set unless another one is true."""
    any_flag = reduce(lambda a, b: a | b, [F.col(f) for f in FLAGS])
    flagged = scores.filter(any_flag)
    return with_age(islands(flagged, "asset_id", "hr", params.max_gap_h)).select(
        "asset_id", "island", "hr", "start_hr", "age_h", *RESIDUAL_NAMES.values(), *FLAGS)


def _bits(columns=FLAGS):
    return [F.max(F.when(F.col(f), 1).otherwise(0)).alias(b) for f, b in zip(columns, BITS)]


def _episode_stats(hours: DataFrame) -> DataFrame:
    """Everything an episode needs, in one aggregate behind one exchange."""
    end = F.max("hr").over(Window.partitionBy("asset_id", "island"))
    rows = hours.withColumn("__end", end)
    first, last = F.col("age_h") <= 2, F.col("hr") > add_hours(F.col("__end"), -3)
    return rows.groupBy("asset_id", "island").agg(
        F.min("hr").alias("start_hr"), F.max("hr").alias("end_hr"),
        (boundary_diff("hour", F.min("hr"), F.max("hr")) + 1).alias("duration_h"),
        *_bits(),
        F.min(F.when(F.col("f_vib_up"), F.col("age_h"))).alias("first_vib_h"),
        F.min(F.when(F.col("f_temp_up"), F.col("age_h"))).alias("first_temp_h"),
        F.max(F.abs("vib_resid_pct")).alias("peak_vib_pct"), F.max(F.abs("temp_resid_c")).alias("peak_temp_c"),
        F.max(F.abs("pres_resid_pct")).alias("peak_pres_pct"),
        F.avg(F.when(first, F.col("vib_resid_pct"))).alias("vib_first"),
        F.avg(F.when(first, F.col("temp_resid_c"))).alias("temp_first"),
        F.avg(F.when(last, F.col("vib_resid_pct"))).alias("vib_last"),
        F.avg(F.when(last, F.col("temp_resid_c"))).alias("temp_last"),
        F.avg(F.when(last, F.col("pres_resid_pct"))).alias("pres_last"))


def episodes(hours: DataFrame) -> DataFrame:
    """Span, channels involved, first hits and absolute peaks per island."""
    return _episode_stats(hours).select(
        "asset_id", "island", "start_hr", "end_hr", "duration_h", *BITS, "first_vib_h", "first_temp_h",
        "peak_vib_pct", "peak_temp_c", "peak_pres_pct")


def edge_means(hours: DataFrame) -> DataFrame:
    """Mean residuals of the first three and the last three clock hours of each island."""
    return _episode_stats(hours).select("asset_id", "island", "vib_first", "temp_first", "vib_last", "temp_last",
                                        "pres_last")


def last_hour(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("asset_id").agg(F.max("hr").alias("last_hr"))


def anomalies(hours: DataFrame, hourly: DataFrame, assets: DataFrame, params: EpisodeParams = EpisodeParams(),
              live: str = "recent") -> DataFrame:
    """One record per episode that lasted long enough.

    ``live="recent"`` marks episodes that reach the end of the asset's data; ``live="last"`` marks the last episode
    of every asset.
    """
    ep = _episode_stats(hours).filter(F.col("duration_h") >= params.min_duration_h)
    joined = ep.join(assets.select("asset_id", "asset_type", "line_id"), "asset_id").join(
        last_hour(hourly), "asset_id")
    if live == "last":
        active = F.col("start_hr") == F.max("start_hr").over(Window.partitionBy("asset_id"))
    elif live == "recent":
        active = F.col("end_hr") >= add_hours(F.col("last_hr"), -params.active_within_h)
    else:
        raise ValueError(f"unknown live rule {live}")
    words = F.concat_ws(" ", *[F.when(F.col(b) == 1, F.lit(word)) for b, word in _SENSOR_WORDS.items()])

    def reaches(limits):
        return ((F.col("peak_vib_pct") >= limits["vib"]) | (F.col("peak_temp_c") >= limits["temp"])
                | (F.col("peak_pres_pct") >= limits["pres"]))

    vibrating = F.col("s_vib_up") == 1
    return joined.select(
        F.concat(F.lit("A-"), F.col("asset_id").cast("string"), F.lit("-"), stamp(F.col("start_hr"))
                 ).alias("anomaly_id"),
        "asset_id", "asset_type", "line_id", "start_hr", "end_hr", "duration_h", active.alias("is_active"), *BITS,
        words.alias("sensors"), F.col("vib_last").alias("vib_rise_pct"), F.col("temp_last").alias("temp_rise_c"),
        F.col("pres_last").alias("pres_change_pct"),
        ((F.col("vib_last") - F.col("vib_first")) / F.greatest(F.col("duration_h") - 2, F.lit(1))
         ).alias("vib_slope_pct_h"),
        F.when(vibrating & (F.col("vib_first") >= params.step_share * F.col("vib_last")), "STEP").when(
            vibrating, "RAMP").otherwise("N/A").alias("vib_shape"),
        (F.col("first_temp_h") - F.col("first_vib_h")).alias("temp_lag_h"),
        F.when(reaches(params.high), "HIGH").when(reaches(params.medium), "MEDIUM").otherwise("LOW")
        .alias("severity"))
