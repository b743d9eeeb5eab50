"""Hourly sensor means, residuals against the daily profile, and scores against a lagged rolling baseline.

After :func:`hourly` an asset has at most one row per clock hour however many readings it sends, so windows
partitioned by asset are bounded by the length of the history in hours, not by the size of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.exprs import ratio_or_null, trunc_ntz
from millwright.operators.health import CHANNELS, running_only
from millwright.params import SensorParams

LEVELS = ("vib", "temp", "pres", "curr")
NOISE = ("curr_noise", "pres_noise")
# Public names of the smoothed residuals.
RESIDUAL_NAMES = {"vib": "vib_resid_pct", "temp": "temp_resid_c", "pres": "pres_resid_pct", "curr": "curr_resid_pct",
                  "curr_noise": "curr_noise_x", "pres_noise": "pres_noise_x"}
FLAGS = ("f_vib_up", "f_temp_up", "f_pres_down", "f_curr_up", "f_curr_noisy", "f_pres_noisy")


def hourly_means(running: DataFrame, hour, min_readings: int) -> DataFrame:
    """Means and coefficients of variation per asset and hour, for hours with enough readings."""
    def variation(c):
        return ratio_or_null(F.stddev_samp(c), F.avg(c))

    return running.groupBy("asset_id", hour.alias("hr")).agg(
        *[F.avg(source).alias(stem) for stem, source in CHANNELS.items()],
        variation("current_a").alias("curr_cv"), variation("pressure_bar").alias("pres_cv"),
        F.count("*").alias("n_readings")).filter(F.col("n_readings") >= min_readings)


def hourly(readings: DataFrame, params: SensorParams = SensorParams()) -> DataFrame:
    """Hourly figures of the readings taken while the asset was running."""
    running = running_only(readings, "asset_id", "current_a", params.running_share)
    return hourly_means(running, trunc_ntz("hour", F.col("ts")), params.min_readings)


def hod_profile(hours: DataFrame) -> DataFrame:
    """Mean of every channel per asset and hour of day (at most 24 rows per asset)."""
    cols = [*LEVELS, "curr_cv", "pres_cv"]
    return hours.groupBy("asset_id", F.hour("hr").alias("hod")).agg(*[F.avg(c).alias(f"p_{c}") for c in cols])


def residuals(hours: DataFrame, profile: DataFrame) -> DataFrame:
    """Distance of every hour from the asset's profile: percent, degrees for temperature, a factor for noise."""
    joined = hours.withColumn("hod", F.hour("hr")).join(profile, ["asset_id", "hod"])

    def level(c):
        if c == "temp":
            return F.col(c) - F.col(f"p_{c}")
        return 100 * (ratio_or_null(F.col(c), F.col(f"p_{c}")) - 1)

    return joined.select(
        "asset_id", "hr", *LEVELS, *[level(c).alias(f"r_{c}") for c in LEVELS],
        ratio_or_null(F.col("curr_cv"), F.col("p_curr_cv")).alias("r_curr_noise"),
        ratio_or_null(F.col("pres_cv"), F.col("p_pres_cv")).alias("r_pres_noise"))


def _by_asset(*extra: str):
    return Window.partitionBy("asset_id", *extra).orderBy("hr")


def smooth(df: DataFrame, n: int = 3) -> DataFrame:
    """Moving average of the residuals over the last ``n`` rows."""
    w = _by_asset().rowsBetween(-(n - 1), 0)
    keep = [c for c in df.columns if not c.startswith("r_")]
    return df.select(*keep, *[F.avg(f"r_{c}").over(w).alias(f"s_{c}") for c in (*LEVELS, *NOISE)])


def rolling_baseline(df: DataFrame, lo: int = 192, hi: int = 24, method: str = "blocks",
                     block_rows: int = 4096) -> DataFrame:
    """Mean, standard deviation and row count over the rows ``lo`` to ``hi`` before each row (rows, not hours).

    ``blocks`` does constant work per row: a frame is the tail of one block of rows as long as the frame and the head of
    the next, whose counts, means and squared deviations are merged. A value counts only in frames that hold it, so a
    spike, a NaN or an infinity leaves no trace afterwards. ``direct`` re-reads the frame for every row. ``chunked``
    does so on blocks of rows that carry the preceding ``lo`` rows along.
    """
    if method == "direct":
        return _direct(df, _by_asset(), lo, hi)
    if method == "chunked":
        return _chunked(df, lo, hi, block_rows)
    if method != "blocks":
        raise ValueError(f"unknown method {method}")
    size = lo - hi + 1
    rows = df.withColumn("__rn", F.row_number().over(_by_asset()))
    rows = rows.withColumn("__block", F.floor((F.col("__rn") - 1) / size))
    block = Window.partitionBy("asset_id", "__block")
    ends = {"head": block.orderBy("hr"), "tail": block.orderBy(F.col("hr").desc())}

    def moments(c, end):
        w = ends[end].rowsBetween(Window.unboundedPreceding, Window.currentRow)
        x = F.col(f"s_{c}")
        return F.struct(F.count(x).over(w).alias("n"), F.avg(x).over(w).alias("mean"),
                        F.var_pop(x).over(w).alias("var")).alias(f"__{end}_{c}")

    parts = rows.select("*", *[moments(c, end) for end in ends for c in LEVELS])
    # The tail begins where the frame begins; one that begins with a block is the whole block, which the head has.
    starts_inside = (F.col("__rn") > lo) & ((F.col("__rn") - lo - 1) % size != 0)
    parts = parts.select(*df.columns, "__rn", *[
        F.lag(f"__head_{c}", hi).over(_by_asset()).alias(f"__head_{c}") for c in LEVELS], *[
        F.when(starts_inside, F.lag(f"__tail_{c}", lo).over(_by_asset())).alias(f"__tail_{c}") for c in LEVELS])
    cols = []
    for c in LEVELS:
        head, tail = F.col(f"__head_{c}"), F.col(f"__tail_{c}")
        n_head, n_tail = (F.coalesce(p["n"], F.lit(0)) for p in (head, tail))
        n = n_head + n_tail
        both = (n_head > 0) & (n_tail > 0)
        apart = head["mean"] - tail["mean"]
        mean = F.when(both, (head["mean"] * n_head + tail["mean"] * n_tail) / n).otherwise(
            F.coalesce(head["mean"], tail["mean"]))
        squares = (F.when(n_head > 0, head["var"] * n_head).otherwise(0.0)
                   + F.when(n_tail > 0, tail["var"] * n_tail).otherwise(0.0)
                   + F.when(both, apart * apart * n_head * n_tail / n).otherwise(0.0))
        cols.append(F.when(n > 0, mean).alias(f"m_{c}"))
        squares = F.when(F.abs(mean) == float("inf"), float("nan")).otherwise(squares)
        cols.append(F.when(n > 1, F.sqrt(squares / (n - 1))).alias(f"sd_{c}"))
    n_base = F.greatest(F.least(F.col("__rn") - hi, F.lit(size)), F.lit(0)).cast("bigint")
    return parts.select(*df.columns, *cols, n_base.alias("n_base"))


def _direct(df: DataFrame, window, lo: int, hi: int) -> DataFrame:
    w = window.rowsBetween(-lo, -hi)
    return df.select("*", *[f(f"s_{c}").over(w).alias(f"{name}_{c}") for c in LEVELS
                            for name, f in (("m", F.avg), ("sd", F.stddev_samp))],
                     F.count("*").over(w).alias("n_base"))


def _chunked(df: DataFrame, lo: int, hi: int, block_rows: int) -> DataFrame:
    if block_rows < lo:
        raise ValueError("a block must hold the whole frame")
    rn = F.row_number().over(_by_asset()) - 1
    rows = df.withColumn("__rn", rn).withColumn("__own", F.floor(F.col("__rn") / block_rows))
    near_end = F.col("__rn") % block_rows >= block_rows - lo
    blocks = F.when(near_end, F.array(F.col("__own"), F.col("__own") + 1)).otherwise(F.array(F.col("__own")))
    copies = rows.withColumn("__block", F.explode(blocks))
    scored = _direct(copies, _by_asset("__block"), lo, hi)
    return scored.filter(F.col("__block") == F.col("__own")).drop("__rn", "__own", "__block")


def zscores(df: DataFrame, params: SensorParams = SensorParams()) -> DataFrame:
    """Distance from the baseline in standard deviations, which have a floor per channel."""
    def z(c):
        spread = F.greatest(F.coalesce(F.col(f"sd_{c}"), F.lit(0.0)), F.lit(float(params.sd_floor[c])))
        return (F.col(f"s_{c}") - F.col(f"m_{c}")) / spread

    return df.withColumns({f"z_{c}": z(c) for c in LEVELS})


def flags(df: DataFrame, params: SensorParams = SensorParams()) -> DataFrame:
    """Directional flags. A channel without readings gives NULL, not false, once the baseline is warm."""
    warm = F.col("n_base") >= params.warmup_rows
    rules = {
        "f_vib_up": F.col("z_vib") >= params.z_limit,
        "f_temp_up": F.col("z_temp") >= params.z_limit,
        "f_pres_down": F.col("z_pres") <= -params.z_limit,
        "f_curr_up": F.col("z_curr") >= params.z_limit,
        "f_curr_noisy": F.coalesce(F.col("s_curr_noise"), F.lit(0.0)) >= params.noise_limit,
        "f_pres_noisy": F.coalesce(F.col("s_pres_noise"), F.lit(0.0)) >= params.noise_limit,
    }
    return df.select(
        "asset_id", "hr", *LEVELS, *[F.col(f"s_{c}").alias(n) for c, n in RESIDUAL_NAMES.items()],
        *[f"z_{c}" for c in LEVELS], *[(warm & rule).alias(name) for name, rule in rules.items()])


def sensor_scores(hours: DataFrame, params: SensorParams = SensorParams(), profile: DataFrame | None = None,
                  method: str = "blocks") -> DataFrame:
    """Hourly figures to flags. A stored ``profile`` replaces the one taken from these hours."""
    r = residuals(hours, hod_profile(hours) if profile is None else profile)
    base = rolling_baseline(smooth(r, params.smooth_rows), params.baseline_from, params.baseline_to, method)
    return flags(zscores(base, params), params)
