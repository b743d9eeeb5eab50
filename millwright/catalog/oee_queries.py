"""Effectiveness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.catalog import adapters as a
from millwright.catalog.sensor_queries import active_frame
from millwright.catalog.sql import compose, define, near, rounded
from millwright.functions.exprs import out
from millwright.operators import oee

FACTORS = ("availability", "performance", "quality", "oee")

_SUMS = """sum(planned_time_min) AS planned_min, sum(run_time_min) AS run_min, sum(downtime_min) AS downtime_min,
       sum(total_count) AS total_count, sum(good_count) AS good_count,
       sum(ideal_cycle_time_s * total_count) AS ideal_s"""
_FACTORS = """CASE WHEN planned_min = 0 THEN 0 ELSE run_min / planned_min END AS availability,
       CASE WHEN run_min = 0 THEN 0 ELSE ideal_s / (run_min * 60) END AS performance,
       CASE WHEN total_count = 0 THEN 0 ELSE good_count / total_count END AS quality"""

define("asset_day_v", f"""
SELECT *, availability * performance * quality AS oee FROM (
  SELECT *, {_FACTORS} FROM (
    SELECT p.asset_id, a.asset_name, a.asset_type, p.line_id, p.shift_date AS oee_date, count(*) AS shifts, {_SUMS}
    FROM production_v p JOIN assets_v a USING (asset_id) GROUP BY ALL))""")
define("line_day_v", f"""
SELECT *, availability * performance * quality AS oee FROM (
  SELECT *, {_FACTORS} FROM (
    SELECT line_id, shift_date AS oee_date, {_SUMS} FROM production_v GROUP BY ALL))""")


def _rounded(df, *cols):
    return df.withColumns({c: out(F.col(c)) for c in cols})


def oee_daily(spark, sf):
    df = oee.oee_daily(a.production(spark, sf), a.assets(spark, sf))
    amounts = ("planned_min", "run_min", "downtime_min", "total_count", "good_count", "scrap_count")
    return _rounded(df, *amounts, *FACTORS)


def oee_line_daily(spark, sf):
    df = oee.oee_line_daily(a.production(spark, sf))
    return _rounded(df.select("line_id", "oee_date", "planned_min", "total_count", *FACTORS),
                    "planned_min", "total_count", *FACTORS)


def oee_line_last_days(spark, sf):
    return _rounded(oee.oee_line_last_days(a.production(spark, sf), 30), *FACTORS)


def oee_asset_summary(spark, sf):
    return _rounded(oee.oee_asset_summary(a.production(spark, sf), a.assets(spark, sf), 7), *FACTORS, "downtime_min")


def plant_kpis(spark, sf):
    production = a.production(spark, sf)
    lines = oee.oee_line_last_days(production, 30)
    summary = oee.oee_asset_summary(production, a.assets(spark, sf), 7)
    return _rounded(oee.plant_kpis(lines, summary, active_frame(spark, sf)), "oee_last_day", "oee_7_days")


def oee_recompute(spark, sf):
    production = a.production(spark, sf)
    newest = oee.latest(production.filter("asset_id = 7"), "shift_date")
    return _rounded(oee.oee_for(production, 7, newest), *FACTORS)


QUERIES = {
    "oee_daily": oee_daily, "oee_line_daily": oee_line_daily, "oee_line_last_days": oee_line_last_days,
    "oee_asset_summary": oee_asset_summary, "plant_kpis": plant_kpis, "oee_recompute": oee_recompute,
}

ORACLES = {
    "oee_daily": compose(f"""
SELECT asset_id, asset_name, asset_type, line_id, oee_date, shifts,
       {near("total_count - good_count")} AS scrap_count,
       {rounded("planned_min", "run_min", "downtime_min", "total_count", "good_count", *FACTORS)}
FROM asset_day_v"""),
    "oee_line_daily": compose(f"""
SELECT line_id, oee_date, {rounded("planned_min", "total_count", *FACTORS)} FROM line_day_v"""),
    "oee_line_last_days": compose(f"""
SELECT line_id, oee_date, {rounded(*FACTORS)} FROM line_day_v
WHERE oee_date > (SELECT max(oee_date) FROM line_day_v) - 30"""),
    "oee_asset_summary": compose(f"""
SELECT asset_id, line_id, {", ".join(near(f"avg({c})") + f" AS {c}" for c in FACTORS)},
       {near("sum(downtime_min)")} AS downtime_min
FROM asset_day_v WHERE oee_date > (SELECT max(oee_date) FROM asset_day_v) - 7 GROUP BY asset_id, line_id"""),
    "plant_kpis": compose(f"""
SELECT (SELECT {near("avg(oee)")} FROM line_day_v
        WHERE oee_date = (SELECT max(oee_date) FROM line_day_v)) AS oee_last_day,
       (SELECT {near("avg(m)")} FROM (SELECT avg(oee) AS m FROM asset_day_v
          WHERE oee_date > (SELECT max(oee_date) FROM asset_day_v) - 7 GROUP BY asset_id, line_id)) AS oee_7_days,
       (SELECT count(*) FROM active_v) AS active_anomalies,
       (SELECT count(*) FROM active_v WHERE priority = 'CRITICAL') AS critical_anomalies"""),
    "oee_recompute": compose(f"""
SELECT asset_id, oee_date, {rounded(*FACTORS)} FROM (
  SELECT *, availability * performance * quality AS oee FROM (
    SELECT *, {_FACTORS} FROM (
      SELECT asset_id, shift_date AS oee_date, {_SUMS} FROM production_v
      WHERE asset_id = 7 AND shift_date = (SELECT max(shift_date) FROM production_v WHERE asset_id = 7)
      GROUP BY ALL)))"""),
}
