"""Asset health: latest reading, trailing slice, seasonal trend and a triage status.

Per-asset figures (newest time, mean load) are written as small staged tables, so the readings are joined without
moving them as long as Spark's own size check allows a broadcast; beyond it the join is a shuffle that AQE splits
on hot assets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions.exprs import add_days, boundary_diff, ratio_or_null
from millwright.params import HealthParams
from millwright.session import staged
from millwright.sources.days import DayTable

# Column stem of each sensor channel.
CHANNELS = {"vib": "vibration_rms", "temp": "temperature_c", "pres": "pressure_bar", "curr": "current_a"}


def latest_per_key(df: DataFrame, key: str, ts: str) -> DataFrame:
    """The newest row of every key, as an aggregate: no sort, and partial results before the shuffle."""
    rest = [c for c in df.columns if c not in (key, ts)]
    return df.groupBy(key).agg(F.max(ts).alias(ts), *[F.max_by(c, ts).alias(c) for c in rest])


def trailing_slice(df: DataFrame, key: str, ts: str, days: int) -> DataFrame:
    """Rows newer than ``days`` days before their key's newest row, with ``max_ts`` and the age in minutes."""
    newest = staged(df.groupBy(key).agg(F.max(ts).alias("max_ts")), "newest")
    oldest = newest.agg(add_days(F.min("max_ts"), -days)).first()[0]
    if oldest is None:
        return df.join(newest, key).withColumn("age_min", F.lit(0).cast("bigint"))
    # One bound for all keys reaches the scan; the exact bound per key follows after the join.
    return _aged(df.filter(F.col(ts) > F.lit(oldest).cast("timestamp_ntz")), newest, key, ts, days)


def _aged(df: DataFrame, newest: DataFrame, key: str, ts: str, days: int) -> DataFrame:
    return df.join(newest, key).filter(F.col(ts) > add_days(F.col("max_ts"), -days)).withColumn(
        "age_min", boundary_diff("minute", F.col(ts), F.col("max_ts")))


def trailing_stored(table: DayTable, days: int) -> DataFrame:
    """:func:`trailing_slice` of a stored table, of which only the folders of each key's own last days are opened.

    A key that fell silent long ago costs the few folders of its last days, not a scan back to them.
    """
    rows, newest = table.trailing(days)
    return _aged(rows, newest, table.key, table.ts, days)


def running_only(df: DataFrame, key: str, load: str, share: float) -> DataFrame:
    """Rows whose load is at least ``share`` of the key's mean load."""
    means = staged(df.groupBy(key).agg(F.avg(load).alias("__mean_load")), "mean_load")
    return df.join(means, key).filter(F.col(load) >= share * F.col("__mean_load")).drop("__mean_load")


def seasonal_trend(df: DataFrame, params: HealthParams = HealthParams()) -> DataFrame:
    """Means of the last hours and of the same clock hours on earlier days, for all channels in one pass."""
    age = F.col("age_min")
    base = age.between(params.day_min, params.base_until_min)
    windows = {"6h": age < params.recent_min, "base_6h": base & (age % params.day_min < params.recent_min),
               "24h": age < params.day_min, "base_7d": base}
    aggs = [F.avg(F.when(cond, F.col(source))).alias(f"{stem}_{w}")
            for stem, source in CHANNELS.items() for w, cond in windows.items()]
    return df.groupBy("asset_id").agg(*aggs)


def trend_deltas(trend: DataFrame) -> DataFrame:
    """Relative change per channel, an absolute one for temperature."""
    def change(stem, now, before):
        if stem == "temp":
            return F.col(f"temp_{now}") - F.col(f"temp_{before}")
        return 100 * (ratio_or_null(F.col(f"{stem}_{now}"), F.col(f"{stem}_{before}")) - 1)

    return trend.select(
        "asset_id", *[change(s, "6h", "base_6h").alias(f"{s}_6h_delta_c" if s == "temp" else f"{s}_6h_pct")
                      for s in CHANNELS],
        change("vib", "24h", "base_7d").alias("vib_24h_pct"),
        change("temp", "24h", "base_7d").alias("temp_24h_delta_c"))


def health_status(df: DataFrame, params: HealthParams = HealthParams()) -> DataFrame:
    def breach(limit):
        return ((F.col("vib_6h_pct") >= limit["vib"]) | (F.col("temp_6h_delta_c") >= limit["temp"])
                | (F.col("pres_6h_pct") <= limit["pres"]) | (F.abs("curr_6h_pct") >= limit["curr"]))

    return df.withColumn("health_status", F.when(breach(params.alert), "ALERT").when(
        breach(params.watch), "WATCH").otherwise("OK"))


def asset_health(readings: DataFrame, assets: DataFrame, params: HealthParams = HealthParams()) -> DataFrame:
    """Latest values, trend and status of every asset that has readings."""
    newest = latest_per_key(readings, "asset_id", "ts").withColumnRenamed("ts", "latest_ts")
    recent = trailing_slice(readings, "asset_id", "ts", params.slice_days)
    running = running_only(recent, "asset_id", "current_a", params.running_share)
    deltas = trend_deltas(seasonal_trend(running, params))
    named = assets.select("asset_id", "asset_name", "asset_type", "line_id", "criticality")
    return health_status(named.join(newest, "asset_id").join(deltas, "asset_id"), params).orderBy(
        "line_id", "asset_id")
