"""Multi-step jobs over stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.operators import cards as cd
from millwright.operators import extraction as ex
from millwright.operators import matching, scoring
from millwright.operators import episodes as ep
from millwright.operators.oee import oee_daily, oee_line_daily
from millwright.params import CardParams, EpisodeParams, Lexicon, SensorParams
from millwright.schemas import RAW_TABLES, SCHEMAS
from millwright.session import staged
from millwright.sources.tables import append_new, read_table, refresh_raw, refresh_search_docs, write_table

CARD_KEY = [*ex.SOURCE_KEY, "card_seq"]


def run_anomaly_pipeline(readings: DataFrame, assets: DataFrame, work_orders: DataFrame, out: str,
                         sensor: SensorParams = SensorParams(), episode: EpisodeParams = EpisodeParams(),
                         live: str = "recent") -> dict[str, DataFrame]:
    """Readings to failure windows; every stage that feeds two or more others is a stored table."""
    t = {}
    t["sensor_hourly"] = write_table(scoring.hourly(readings, sensor), f"{out}/sensor_hourly", ["asset_id", "hr"])
    t["sensor_scores"] = write_table(scoring.sensor_scores(t["sensor_hourly"], sensor), f"{out}/sensor_scores",
                                     ["asset_id", "hr"])
    t["anomaly_hours"] = write_table(ep.anomaly_hours(t["sensor_scores"], episode), f"{out}/anomaly_hours",
                                     ["asset_id", "hr"])
    t["anomalies"] = write_table(ep.anomalies(t["anomaly_hours"], t["sensor_hourly"], assets, episode, live),
                                 f"{out}/anomalies")
    t["prefailure_episodes"] = write_table(
        matching.prefailure(t["anomalies"], work_orders, episode.failure_within_h), f"{out}/prefailure_episodes")
    t["anomaly_matches"] = write_table(
        matching.anomaly_matches(t["anomalies"], t["prefailure_episodes"], t["anomaly_hours"], episode),
        f"{out}/anomaly_matches")
    t["failure_windows"] = write_table(
        matching.failure_windows(t["anomalies"], matching.best_mode(t["anomaly_matches"]), episode),
        f"{out}/failure_windows")
    return t


@dataclass(frozen=True)
class CardPaths:
    raw: str
    log: str
    search: str | None = None


def extract_new(sources: DataFrame, paths: CardPaths, by: str, at: Column | str, lexicon: Lexicon = Lexicon(),
                max_rows: int | None = None) -> DataFrame:
    """Extract cards of unseen texts and append them with their log rows; returns the processed sources.

    Cards are appended before the log and only when their key is new, so a run that died in between can simply be
    repeated.
    """
    spark = sources.sparkSession
    log = read_table(spark, paths.log, SCHEMAS["card_extract_log"])
    todo = staged(ex.with_cards(ex.pending(sources, log, max_rows), lexicon).drop("source_text"), "extracted")
    append_new(ex.number_cards(todo, by, at), paths.raw, CARD_KEY, ex.SOURCE_KEY)
    append_new(ex.extract_log(todo, by, at), paths.log, ex.SOURCE_KEY)
    return todo


def card_view(spark: SparkSession, paths: CardPaths, sources: DataFrame, work_orders: DataFrame, changes: DataFrame,
              technicians: DataFrame, params: CardParams = CardParams()) -> DataFrame:
    """Cards read model over the stored extraction."""
    raw = read_table(spark, paths.raw, SCHEMAS["cards_raw"])
    keys = staged(sources.drop("source_text"), "card_sources")  # texts are read and hashed once
    fixing = cd.fixing_changes(changes, work_orders, params.fix_window_min)
    stale = cd.stale_cards(raw, keys, changes, fixing, params)
    return cd.cards(raw, keys, work_orders, technicians, cd.recurrences(work_orders, params.recur_days), stale)


def refresh_cards(work_orders: DataFrame, notes: DataFrame, changes: DataFrame, technicians: DataFrame,
                  paths: CardPaths, by: str = "rules", at: Column | str | None = None, lexicon: Lexicon = Lexicon(),
                  params: CardParams = CardParams(), max_rows: int | None = None) -> dict[str, DataFrame]:
    """Incremental refresh: extract what is new, then cards and edges. A second run on the same sources adds nothing."""
    spark = work_orders.sparkSession
    sources = ex.card_sources(work_orders, notes)
    done = extract_new(sources, paths, by, F.current_timestamp() if at is None else at, lexicon, max_rows)
    found = card_view(spark, paths, sources, work_orders, changes, technicians, params)
    found = cd.with_search_text(staged(found.drop("search_text"), "cards"))
    result = {"processed": done, "cards": found, "edges": cd.edges(found)}
    if paths.search:
        result["search_docs"] = refresh_search_docs(found, paths.search)
    return result


def build(spark: SparkSession, src: str, out: str) -> dict[str, DataFrame]:
    """Everything from landing CSV files: landing tables, effectiveness, anomalies, cards."""
    refresh_raw(spark, src, f"{out}/raw")
    raw = {n: spark.read.schema(SCHEMAS[n]).parquet(f"{out}/raw/{n}") for n in RAW_TABLES}
    tables = {"oee_daily": write_table(oee_daily(raw["production_log"], raw["assets"]), f"{out}/oee_daily"),
              "oee_line_daily": write_table(oee_line_daily(raw["production_log"]), f"{out}/oee_line_daily")}
    tables.update(run_anomaly_pipeline(raw["sensor_readings"], raw["assets"], raw["work_orders"], out))
    paths = CardPaths(f"{out}/cards_raw", f"{out}/card_extract_log", f"{out}/search_docs")
    tables.update(refresh_cards(raw["work_orders"], raw["handover_notes"], raw["asset_changes"], raw["technicians"],
                                paths))
    return {**raw, **tables}
