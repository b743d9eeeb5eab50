"""Tunable thresholds and word lists. The defaults are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SensorParams:
    """Hourly aggregation, scoring and flags."""

    running_share: float = 0.5      # a reading counts as running from this share of the asset's mean load
    min_readings: int = 6           # per hour
    smooth_rows: int = 3
    baseline_from: int = 192        # rows back
    baseline_to: int = 24           # rows back
    warmup_rows: int = 72
    sd_floor: dict = field(default_factory=lambda: {"vib": 0.6, "temp": 0.25, "pres": 0.4, "curr": 0.6})
    z_limit: float = 3.0
    noise_limit: float = 2.5


@dataclass(frozen=True)
class EpisodeParams:
    """Episode building, severity, matching and the failure window."""

    max_gap_h: int = 3
    min_duration_h: int = 3
    active_within_h: int = 1
    step_share: float = 0.6
    high: dict = field(default_factory=lambda: {"vib": 15, "temp": 6, "pres": 6})
    medium: dict = field(default_factory=lambda: {"vib": 8, "temp": 3, "pres": 3})
    failure_within_h: int = 12
    lag_scale_h: float = 12.0
    slope_floor: float = 0.1
    weights: tuple = (0.5, 0.3, 0.2)  # channels, slope, lag
    match_at: float = 0.75
    linear_mode: str = "BEARING_WEAR"
    linear_rise_pct: float = 35
    linear_min_slope: float = 0.05
    linear_rule: str = "vibration_rms >= 1.35 x baseline"
    critical_within_h: float = 48


@dataclass(frozen=True)
class HealthParams:
    """Trend windows in minutes and the alert thresholds."""

    slice_days: int = 8
    running_share: float = 0.5
    recent_min: int = 360
    day_min: int = 1440
    base_until_min: int = 11519
    alert: dict = field(default_factory=lambda: {"vib": 8, "temp": 3, "pres": -5, "curr": 8})
    watch: dict = field(default_factory=lambda: {"vib": 4, "temp": 1.5, "pres": -2.5, "curr": 4})


@dataclass(frozen=True)
class CardParams:
    """Recurrence and staleness rules."""

    recur_days: int = 14
    fix_window_min: int = 60
    stale_change_types: tuple = ("PART_REPLACEMENT", "FIRMWARE_UPDATE")
    stale_card_types: tuple = ("GOTCHA", "CONVENTION")


@dataclass(frozen=True)
class RankParams:
    """Card ranking and search."""

    type_weight: dict = field(default_factory=lambda: {
        "FIX": 3.0, "GOTCHA": 2.6, "SYMPTOM_PATTERN": 2.0, "CONVENTION": 1.0})
    default_weight: float = 1.0
    default_confidence: float = 0.5
    recurred_factor: float = 0.6
    stale_factor: float = 0.5
    warning_bonus: float = 3.0
    mode_bonus: float = 1.0
    k1: float = 1.4
    b: float = 0.75
    recall_limit: int = 15
    question_limit: int = 10
    answer_cards: int = 4


# Extraction lexicon. Cues are substrings of the lower-cased sentence, spaces included; the first
# failure mode with a hit wins.
@dataclass(frozen=True)
class Lexicon:
    asset_pattern: str = r"\b(CNC[1-4]|P[1-3]|AC[12]|CV[1-3])\b"
    failure_modes: tuple = (
        ("MOTOR_OVERHEAT", ("motor trip", "overload", "motor hot", "motor tripping")),
        ("BEARING_WEAR", ("bearing", "brg", "grease", "lube")),
        ("SEAL_LEAK", ("seal", "leak")),
        ("BELT_SLIP", ("belt", "slipping", "jerking")),
        ("VALVE_STICKING", ("valve",)),
        ("COOLANT_BLOCKAGE", ("coolant",)),
        ("SPINDLE_MISALIGNMENT", ("spindle vib", "misalign", "realign", "chatter")),
        ("AIR_FILTER_CLOG", ("air filter", "intake filter", "filter choked", "low discharge",
                             "discharge pressure low")),
        ("TOOL_WEAR", ("tool", "insert", "holder", "finish")),
        ("OIL_CONTAMINATION", ("milky", "contaminat", "oil temp")),
    )
    convention: tuple = ("mandatory", "ref return", "keep min", "always ")
    gotcha: tuple = ("not hold", "dont ", "don't", "do not", "otherwise", "warna", "fails in", "never ", "sirf",
                     "only bearing", "wapas aaya", " mat ")
    symptom: tuple = ("when ", "creeping", "starts rising", "root cause looks like", "then temp")
    fix: tuple = ("fix =", "fix=", "replace", "repl", "changed", "chngd", "change kiya", "badla", "done", "fitted",
                  "aligned", "align kiya")
    explicit_fix: tuple = ("fix =", "fix=")
    recurred: tuple = ("came back", "wapas", "phir se", "recur", "again")
    excerpt_chars: int = 220
    summary_chars: int = 300


# Search tokens.
@dataclass(frozen=True)
class TokenRules:
    synonyms: dict = field(default_factory=lambda: {
        "brg": "bearing", "bearings": "bearing", "vib": "vibration", "temp": "temperature", "chngd": "changed",
        "repl": "replaced", "lube": "grease", "greased": "grease", "ht3": "ht-3", "prodn": "production",
        "pls": "please", "wapas": "again", "phir": "again"})
    suffixes: tuple = ("ing", "ed", "es", "s")
    stop: tuple = tuple(
        "the a an and or of to in on for is it was with by at as be this that what how why which who did do does "
        "from p3 cnc1 cnc2 cnc3 cnc4 p1 p2 ac1 ac2 cv1 cv2 cv3".split())


# Question routing.
@dataclass(frozen=True)
class QuestionRules:
    cannot: str = "I can't establish that from the available data."
    asset_pattern: str = r"\b(CNC[1-4]|P[1-3]|AC[12]|CV[1-3])\b"
    line_pattern: str = r"\b(?:line\s*|L)([1-3])\b"
    refuse: tuple = (
        r"\b(quit|resign|fire|fired|salary|salaries|pay|personal|phone number|address|religion|caste|health of)\b",
        r"\b(next (quarter|year|month)|forecast|predict)\b.*\b(oee|revenue|profit|sales)\b",
        r"\b(oee|revenue|profit|sales)\b.*\b(next (quarter|year|month)|in 20[3-9]\d)\b",
        r"\b(revenue|profit|share price|stock price|competitor|customer name)\b",
        r"\b(approve|approval)\b.*\b(yourself|for me|automatically)\b",
        r"\bwho is (the )?(best|worst|laziest)\b",
    )
    warning_hint: str = (r"\b(not do|avoid|don't|dont|mistake|gotcha|warning|didn't work|did not work|careful)\b")
    draft_hint: str = r"\b(draft|create|raise|open)\b.*\bwork order\b"
    analytic_hint: str = (r"\b(oee|mttr|downtime|stock|stockout|parts?|scrap|quality|availability|trend|how many|"
                          r"retiring|breakdowns?)\b")
    min_score: float = 2.0
    table_rows: int = 12
    # Keywords per named query, in priority order; "!" marks a strong keyword (2 points, others 1).
    keywords: tuple = (
        ("oee_by_line_last_week", ("!line", "oee", "week", "each line")),
        ("top_downtime_causes_this_month", ("!cause", "!reason", "downtime", "month", "top")),
        ("mttr_by_technician", ("!mttr", "!mean time to repair", "repair time", "technician")),
        ("parts_at_risk_of_stockout", ("!stockout", "!stock", "!reorder", "parts", "spare", "inventory")),
        ("lowest_oee_assets_last_week", ("!lowest", "!worst", "oee", "asset", "machine")),
        ("downtime_by_asset", ("!breakdown downtime", "!downtime by asset", "downtime", "each asset")),
        ("breakdowns_by_asset_and_failure_mode", ("!how many times", "!failed", "failures", "breakdowns", "why")),
        ("weekly_plant_oee_trend", ("!trend", "weekly", "plant", "oee")),
        ("jobs_done_by_retiring_technicians", ("!retiring", "!retire", "2027", "repairs")),
        ("scrap_by_asset_last_week", ("!scrap", "!reject", "!defect", "quality")),
    )


@dataclass(frozen=True)
class WorkflowParams:
    """Drafting and approval. ``reserved`` names automated accounts that may never approve."""

    reserved: tuple = ("agent", "bot", "system")
    order_prefix: str = "WO-"
    order_digits: int = 4
    drafted_by: str = "drafting job"
    repair_h: float = 5.0
    similar_fixes: int = 3
    warnings: int = 3
    recurred: int = 2
    symptoms: int = 1
    demo_note_pattern: str = "HN-9%"
