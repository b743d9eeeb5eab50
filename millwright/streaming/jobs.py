"""Streaming forms of hourly figures, residuals, anomaly sessions, recurrences, first failures and cards.

Watermarks need zoned timestamps, so wall-clock times are cast under UTC on the way in and back on the way out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DateType, LongType, StructField, StructType

from millwright.functions.exprs import boundary_diff, from_micros, micros
from millwright.operators import scoring
from millwright.operators.cards import DAY_US
from millwright.operators.intervals import interval_min
from millwright.params import Lexicon, SensorParams
from millwright.plans.pipeline import CardPaths, extract_new
from millwright.session import fresh_path, staged


def with_event_time(df: DataFrame, ts: str, late: str, name: str = "event_time") -> DataFrame:
    return df.withColumn(name, F.col(ts).cast("timestamp")).withWatermark(name, late)


def stream_hourly(readings: DataFrame, mean_load: DataFrame, params: SensorParams = SensorParams(),
                  late: str = "2 hours") -> DataFrame:
    """Tumbling hourly figures of running readings; ``mean_load`` (asset_id, mean_load) is a stored table."""
    running = with_event_time(readings, "ts", late).join(mean_load, "asset_id").filter(
        F.col("current_a") >= params.running_share * F.col("mean_load"))
    hours = scoring.hourly_means(running, F.window("event_time", "1 hour"), params.min_readings)
    return hours.withColumn("hr", F.col("hr.start").cast("timestamp_ntz"))


def stream_residuals(hourly: DataFrame, profile: DataFrame) -> DataFrame:
    """Residuals of streamed hours against a stored profile."""
    return scoring.residuals(hourly, profile)


def stream_sessions(flagged: DataFrame, max_gap_h: int = 3, late: str = "1 hour") -> DataFrame:
    """Episodes of flagged hours as session windows: a gap of ``max_gap_h`` hours merges, a longer one splits.

    In complete mode, which keeps every session; :func:`stream_episodes` keeps only open ones.
    """
    s = with_event_time(flagged, "hr", late)
    w = F.session_window("event_time", f"{max_gap_h} hours")
    return s.groupBy("asset_id", w).agg(F.count("*").alias("n_hours"),
                                        F.max(F.abs("vib_resid_pct")).alias("peak_vib_pct")).select(
        "asset_id", F.col("session_window.start").cast("timestamp_ntz").alias("start_hr"),
        (F.col("session_window.end") - F.expr(f"INTERVAL {max_gap_h} HOURS")).cast("timestamp_ntz").alias("end_hr"),
        "n_hours", "peak_vib_pct")


def _merged(sessions: list[list], at: int, peak: float | None, gap: int) -> list[list]:
    """Sessions (start, last, hours, peak) after one more flagged hour; neighbours that it joins become one."""
    near = [x for x in sessions if x[0] - gap <= at <= x[1] + gap]
    peaks = [p for p in (peak, *[x[3] for x in near]) if p is not None]
    one = [min([at, *[x[0] for x in near]]), max([at, *[x[1] for x in near]]), 1 + sum(x[2] for x in near), max(peaks, default=None)]
    return sorted([x for x in sessions if x not in near] + [one], key=lambda x: x[0])


def _sessions(gap: int):
    columns = ["asset_id", "start_us", "end_us", "n_hours", "peak_vib_pct", "closed"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = json.loads(state.get[0]) if state.exists else []
        sessions = before
        for part in parts:
            for at, peak in zip(part["at_us"], part["peak"]):
                sessions = _merged(sessions, int(at), None if pd.isna(peak) else float(peak), gap)
        mark = state.getCurrentWatermarkMs() * 1000
        closed = [x for x in sessions if x[1] + gap < mark]  # nothing that may still arrive can join them
        rest = [x for x in sessions if x not in closed]
        if rest:
            state.update((json.dumps(rest),))
            state.setTimeoutTimestamp(max(mark // 1000 + 1, (rest[0][1] + gap) // 1000 + 1))
        elif state.exists:
            state.remove()
        changed = [[*x, x in closed] for x in sessions if x not in before or x in closed]
        gone = {x[0] for x in before} - {x[0] for x in sessions}  # joined to an earlier start
        rows = [(key[0], *x) for x in changed] + [(key[0], start, start, 0, None, True) for start in gone]
        yield pd.DataFrame(rows, columns=columns).astype({"peak_vib_pct": "float64"})

    return run


def stream_episodes(flagged: DataFrame, max_gap_h: int = 3, late: str = "1 hour") -> DataFrame:
    """Episodes of flagged hours, keyed by asset and first hour: a gap of ``max_gap_h`` hours merges, a longer one splits.

    For update mode (``run_updates`` with ``session_rows``): a batch gives the episodes it opened or changed, and again, as closed,
    those that the watermark has passed. Only open episodes stay in the state, a few numbers each, whatever the length of the history.
    An episode that an earlier hour has joined to another one is taken back as a row of no hours.
    """
    rows = with_event_time(flagged, "hr", late).select("asset_id", "event_time", micros(F.col("hr")).alias("at_us"),
                                                       F.abs("vib_resid_pct").cast("double").alias("peak"))
    kind = dict((f.name, f.dataType.simpleString()) for f in flagged.schema)["asset_id"]
    found = rows.groupBy("asset_id").applyInPandasWithState(
        _sessions(max_gap_h * 3_600_000_000),
        f"asset_id {kind}, start_us LONG, end_us LONG, n_hours LONG, peak_vib_pct DOUBLE, closed BOOLEAN", "sessions STRING", "update",
        GroupStateTimeout.EventTimeTimeout)
    return found.select("asset_id", from_micros(F.col("start_us")).alias("start_hr"), from_micros(F.col("end_us")).alias("end_hr"),
                        "n_hours", "peak_vib_pct", "closed")


def session_rows(updates: DataFrame) -> DataFrame:
    """The episodes among the newest rows of ``stream_episodes``."""
    return updates.where("n_hours > 0")


def stream_failures(episodes: DataFrame, orders: DataFrame, within_h: int = 12, late: str = "1 hour") -> DataFrame:
    """Ended episodes joined with the corrective orders of the following hours.

    Episodes of one asset lie hours apart, so an order meets only a few of them. :func:`first_failure` keeps the
    first order per episode.
    """
    e = with_event_time(episodes, "end_hr", late, "end_time").select(
        "anomaly_id", F.col("asset_id").alias("e_asset"), "start_hr", "end_hr", "end_time")
    o = with_event_time(orders, "reported_at", late, "order_time").filter(F.col("wo_type") == "CORRECTIVE").select(
        "asset_id", "wo_id", "failure_mode_code", "technician_id", "reported_at", "order_time")
    near = (F.col("asset_id") == F.col("e_asset")) & (F.col("order_time") >= F.col("end_time")) & (
        F.col("order_time") <= F.col("end_time") + F.expr(f"INTERVAL {within_h} HOURS"))
    return e.join(o, near).select(
        "anomaly_id", "asset_id", "start_hr", "end_hr", "wo_id", F.col("failure_mode_code").alias("failure_mode"),
        "reported_at", "technician_id",
        boundary_diff("hour", F.col("start_hr"), F.col("reported_at")).alias("hours_start_to_failure"))


def first_failure(joined: DataFrame) -> DataFrame:
    w = Window.partitionBy("anomaly_id").orderBy("reported_at", "wo_id")
    return joined.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def run_available(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Process everything that is there now, stop, and return the sink as a table.

    Append mode goes to a parquet sink. Complete mode rewrites its result per batch, so the last batch counts.
    """
    spark = stream.sparkSession
    path, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_updates(stream: DataFrame, keys: list[str], name: str = "stream", checkpoint: str | None = None,
                path: str | None = None, progress: list | None = None) -> DataFrame:
    """Process everything that is there now in update mode, and return the newest row of every key.

    Groups that are still open are included, each batch writes only the rows it changed, and the watermark still bounds
    the state. A batch that is run again overwrites its own folder. With the ``checkpoint`` and ``path`` of an earlier
    run only what has arrived since is read. ``progress`` receives Spark's progress report of every batch.
    """
    spark = stream.sparkSession
    path, checkpoint = path or fresh_path(spark, name), checkpoint or fresh_path(spark, f"{name}-checkpoint")
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")
    query = (stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
             .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")).start())
    query.awaitTermination()
    if progress is not None:
        progress.extend(query.recentProgress)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(path)
    rest = F.struct(*[c for c in stream.columns if c not in keys])
    newest = rows.groupBy(*keys).agg(F.max_by(rest, "batch").alias("newest"))
    return newest.select(*keys, "newest.*").select(*stream.columns)


# ---------------------------------------------------------------- incremental jobs
def stream_cards(sources: DataFrame, paths: CardPaths, by: str, at, lexicon: Lexicon = Lexicon(),
                 checkpoint: str | None = None):
    """Extract cards of streamed sources into the stored tables; returns the finished query.

    A source that arrives twice with the same text adds nothing. A job that is given the ``checkpoint`` of an earlier
    run reads only what has arrived since; without one it reads the whole source.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        extract_new(batch, paths, by, at, lexicon)

    checkpoint = checkpoint or fresh_path(sources.sparkSession, "cards-checkpoint")
    query = sources.writeStream.option("checkpointLocation", checkpoint).trigger(
        availableNow=True).foreachBatch(step).start()
    query.awaitTermination()
    return query


def _again(fixes: DataFrame, later: DataFrame, days: int) -> DataFrame:
    return interval_min(fixes, later, ["asset_id", "failure_mode_code"], "wo_id", lo=micros(F.col("closed_at")) + 1,
                        at=micros(F.col("reported_at")),
                        values={"recurred_by_wo": F.col("wo_id"), "first_again": micros(F.col("reported_at"))},
                        length_us=days * DAY_US - 1)


_ORDER = ["wo_id", "asset_id", "failure_mode_code", "reported_at", "closed_at"]


def _days(spark: SparkSession, path: str, schema: StructType, lo, hi) -> DataFrame:
    """Stored orders of the day folders from ``lo`` to ``hi``; no other folder is opened."""
    layout = StructType([*schema.fields, StructField("day", DateType()), StructField("batch", LongType())])
    try:
        rows = spark.read.schema(layout).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], layout)
    return rows.where(F.col("day").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))


def stream_recurrences(orders: DataFrame, path: str, days: int = 14, files: list | None = None):
    """Recurrences of streamed corrective orders, kept as minima per batch under ``path``.

    A stream-stream join would emit every pair of orders of an asset. Each batch instead compares its new orders with the stored ones
    that can still matter, both ways, through the linear interval operator. Orders are stored twice, by the day they were closed and
    by the day they were reported, and a batch opens only the days that its own times reach by ``days``. Minima combine in any order,
    and a repeated batch overwrites its own folders. ``files`` receives, per batch, how many stored files were read.
    """
    spark = orders.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        new = staged(batch.filter(F.col("wo_type") == "CORRECTIVE").select(*_ORDER), "orders")
        first_report, last_report, first_close, last_close = new.agg(
            F.min("reported_at"), F.max("reported_at"), F.min("closed_at"), F.max("closed_at")).first()
        found = _again(new, new, days)
        if first_report is not None:
            reach = F.expr(f"INTERVAL {days} DAYS")
            since = F.lit(first_report).cast("timestamp_ntz") - reach
            # Folders of this batch and of later, failed ones may exist; only those before count.
            fixes = _days(spark, f"{path}/closed", new.schema, since, last_report).where(F.col("batch") < batch_id)
            found = found.unionByName(_again(fixes.where(F.col("closed_at") >= since).select(*_ORDER), new, days))
            if first_close is not None:
                until = F.lit(last_close).cast("timestamp_ntz") + reach
                later = _days(spark, f"{path}/reported", new.schema, first_close, until).where(F.col("batch") < batch_id)
                found = found.unionByName(_again(new, later.where(F.col("reported_at") > F.lit(first_close).cast("timestamp_ntz")).select(*_ORDER), days))
                if files is not None:
                    files.append(sum(r.select(F.input_file_name()).distinct().count() for r in (fixes, later)))
        found.write.mode("overwrite").parquet(f"{path}/found/batch={batch_id}")
        for kind, at in (("closed", "closed_at"), ("reported", "reported_at")):
            dated = new.where(F.col(at).isNotNull()).withColumns({"day": F.col(at).cast("date"), "batch": F.lit(batch_id)})
            (dated.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch")
             .parquet(f"{path}/{kind}"))
        new.write.mode("overwrite").parquet(f"{path}/orders/batch={batch_id}")

    query = orders.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(
        availableNow=True).foreachBatch(step).start()
    query.awaitTermination()
    return query


def stored_recurrences(spark: SparkSession, path: str) -> DataFrame:
    """The recurrences found so far, in the shape of the batch operator."""
    fixes = spark.read.parquet(f"{path}/orders").select("wo_id", "closed_at")
    mins = spark.read.parquet(f"{path}/found").groupBy("wo_id").agg(
        F.min("recurred_by_wo").alias("recurred_by_wo"), F.min("first_again").alias("first_again"))
    return mins.join(fixes, "wo_id").select(
        "wo_id", "recurred_by_wo",
        boundary_diff("day", F.col("closed_at"), from_micros(F.col("first_again"))).alias("recurred_after_days"))
