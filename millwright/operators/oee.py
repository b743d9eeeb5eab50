"""Equipment effectiveness: availability, performance, quality and their product."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions.exprs import safe_ratio

_SUMS = {"planned_min": "planned_time_min", "run_min": "run_time_min", "downtime_min": "downtime_min",
         "total_count": "total_count", "good_count": "good_count"}


def _sums():
    ideal = F.sum(F.col("ideal_cycle_time_s").cast("double") * F.col("total_count")).alias("ideal_output_s")
    return [F.sum(src).alias(name) for name, src in _SUMS.items()] + [ideal]


def _with_factors(agg: DataFrame) -> DataFrame:
    availability = safe_ratio(F.col("run_min"), F.col("planned_min"))
    performance = safe_ratio(F.col("ideal_output_s"), F.col("run_min") * 60)
    quality = safe_ratio(F.col("good_count"), F.col("total_count"))
    return agg.select(*[c for c in agg.columns if c != "ideal_output_s"], availability.alias("availability"),
                      performance.alias("performance"), quality.alias("quality"),
                      (availability * performance * quality).alias("oee"))


def oee_daily(production: DataFrame, assets: DataFrame) -> DataFrame:
    """One row per asset and day. Production of unknown assets is left out.

    Production is summed per (asset, line, day) first, so the join with the asset names moves grouped rows only.
    """
    per_day = production.groupBy("asset_id", "line_id", F.col("shift_date").alias("oee_date")).agg(
        F.count("*").alias("shifts"), *_sums())
    named = per_day.join(assets.select("asset_id", "asset_name", "asset_type"), "asset_id")
    return _with_factors(named).withColumn("scrap_count", F.col("total_count") - F.col("good_count"))


def oee_line_daily(production: DataFrame) -> DataFrame:
    """One row per line and day over all its production assets."""
    return _with_factors(production.groupBy("line_id", F.col("shift_date").alias("oee_date")).agg(*_sums()))


def latest(df: DataFrame, column: str):
    """The single latest value of a column, as a literal that can be pushed into scans."""
    return df.agg(F.max(column)).first()[0]


def last_days(df: DataFrame, date_col: str, days: int, newest: dt.date | None = None) -> DataFrame:
    """Rows of the last ``days`` days, counted from the newest date in the data (not from today).

    ``newest`` spares a pass when the caller knows the date. As a literal the bound passes through grouping down to
    the scan.
    """
    newest = newest or latest(df, date_col)
    if newest is None:
        return df.limit(0)
    if isinstance(newest, dt.datetime):
        newest = newest.date()
    return df.filter(F.col(date_col) > F.lit(newest - dt.timedelta(days=days)))


def _known(production: DataFrame, assets: DataFrame) -> DataFrame:
    return production.join(assets.select("asset_id"), "asset_id", "left_semi")


def oee_line_last_days(production: DataFrame, days: int = 30) -> DataFrame:
    recent = last_days(production, "shift_date", days)
    return oee_line_daily(recent).select("line_id", "oee_date", "availability", "performance", "quality", "oee"
                                         ).orderBy("oee_date", "line_id")


def oee_last_days(production: DataFrame, assets: DataFrame, days: int) -> DataFrame:
    """Daily asset figures of the trailing days; the slice is taken before grouping."""
    newest = latest(_known(production, assets), "shift_date")
    return oee_daily(last_days(production, "shift_date", days, newest), assets)


def oee_asset_summary(production: DataFrame, assets: DataFrame, days: int = 7) -> DataFrame:
    """Mean daily factors and total downtime per asset over the trailing days."""
    daily = oee_last_days(production, assets, days)
    means = [F.avg(c).alias(c) for c in ("availability", "performance", "quality", "oee")]
    return daily.groupBy("asset_id", "line_id").agg(*means, F.sum("downtime_min").alias("downtime_min")).orderBy(
        "line_id", "asset_id")


def plant_kpis(lines: DataFrame, asset_summary: DataFrame, active: DataFrame) -> DataFrame:
    """One row: mean line OEE of the last day, mean asset OEE, active and critical anomalies."""
    per_day = lines.groupBy("oee_date").agg(F.avg("oee").alias("oee"))
    last_day = per_day.agg(F.max_by("oee", "oee_date").alias("oee_last_day"))
    week = asset_summary.agg(F.avg("oee").alias("oee_7_days"))
    counts = active.agg(F.count("*").alias("active_anomalies"),
                        F.count_if(F.col("priority") == "CRITICAL").alias("critical_anomalies"))
    rows = last_day.unionByName(week, True).unionByName(counts, True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def oee_for(production: DataFrame, asset_id, day: dt.date) -> DataFrame:
    """Recompute one asset and day straight from the production log."""
    rows = production.filter((F.col("asset_id") == F.lit(asset_id)) & (F.col("shift_date") == F.lit(day)))
    return _with_factors(rows.groupBy("asset_id", F.col("shift_date").alias("oee_date")).agg(*_sums())).select(
        "asset_id", "oee_date", "availability", "performance", "quality", "oee")
