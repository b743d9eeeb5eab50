"""Text sources, rule-based card extraction and structured-response flattening.

Extraction is a projection over the source rows: a note's sentences are classified and folded inside the row, so no
text is shuffled and a long note never becomes a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.exprs import any_contains, empty_to_null, exploded, first_match, let, response_cards
from millwright.functions.text import classify, classify_lower, split_sentences
from millwright.params import Lexicon

CARD_DDL = ("card_type STRING, asset_id STRING, failure_mode STRING, symptom_summary STRING, action_taken STRING, "
            "parts STRING, outcome STRING, source_excerpt STRING, confidence DOUBLE")
CARD_FIELDS = tuple(c.split(" ")[0] for c in CARD_DDL.split(", "))
SOURCE_KEY = ["source_type", "source_id", "text_hash"]


def card_sources(work_orders: DataFrame, notes: DataFrame) -> DataFrame:
    """Closed orders with a note, and handover notes, in one shape with a hash of the text.

    ``parts_used`` rides along, so extraction needs no join back to the orders.
    """
    orders = work_orders.filter((F.col("status") == "CLOSED") & F.col("resolution_note").isNotNull()).select(
        F.lit("WORK_ORDER").alias("source_type"), F.col("wo_id").alias("source_id"), "asset_id", "failure_mode_code",
        F.col("wo_type").alias("source_subtype"), F.col("technician_id").alias("author_technician_id"),
        F.col("closed_at").alias("source_ts"), F.col("resolution_note").alias("source_text"),
        F.md5("resolution_note").alias("text_hash"), "parts_used")
    handover = notes.filter(F.col("note_text").isNotNull()).select(
        F.lit("HANDOVER_NOTE").alias("source_type"), F.col("note_id").alias("source_id"),
        F.col("note_type").alias("source_subtype"), "author_technician_id", F.col("created_at").alias("source_ts"),
        F.col("note_text").alias("source_text"), F.md5("note_text").alias("text_hash"))
    return orders.unionByName(handover, allowMissingColumns=True)


def pending(sources: DataFrame, log: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Sources whose text is not in the log; ``max_rows`` takes the oldest of them."""
    todo = sources.join(log.select(*SOURCE_KEY), SOURCE_KEY, "left_anti")
    return todo if max_rows is None else todo.orderBy("source_ts", "source_id").limit(max_rows)


def sentences(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per sentence with its position from 0."""
    return exploded(df, split_sentences(F.col(text)), [*keep], "sentence", "pos")


def _facts(sentence: Column, lexicon: Lexicon) -> Column:
    """What one sentence says on its own: asset mention (or ''), failure mode and card type."""
    def with_mode(f):
        low, mode = f["low"], f["mode"]
        explicit = any_contains(low, lexicon.explicit_fix)
        kind = (F.when(any_contains(low, lexicon.convention), "CONVENTION")
                .when(any_contains(low, lexicon.gotcha), "GOTCHA")
                .when(any_contains(low, lexicon.symptom) & mode.isNotNull(), "SYMPTOM_PATTERN")
                .when(any_contains(low, lexicon.fix) & mode.isNotNull(), F.when(explicit, "FIX!").otherwise("FIX")))
        return F.struct(sentence.alias("sentence"), F.upper(first_match(sentence, lexicon.asset_pattern)).alias("asset"),
                        mode.alias("mode"), kind.alias("kind"))

    return let(F.lower(sentence), lambda low: let(
        F.struct(low.alias("low"), classify_lower(low, lexicon).alias("mode")), with_mode))


def asset_context(text: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Card-worthy sentences of a note with the last asset mentioned so far; none before the first mention."""
    facts = F.transform(split_sentences(text), lambda s: _facts(s, lexicon))
    useful = F.filter(facts, lambda f: (f["asset"] != "") | f["kind"].isNotNull())

    def spread(facts):
        """From each mention to the next one, the sentences in between share its asset: work is linear in the sentences."""
        def runs(starts):
            def run(p, j):
                asset = F.get(facts, p - 1)["asset"]
                until = F.coalesce(F.get(starts, j + 1), F.size(facts) + 1)
                kept = F.filter(F.slice(facts, p, until - p), lambda f: f["kind"].isNotNull())
                return F.transform(kept, lambda f: F.struct(
                    f["sentence"].alias("sentence"), asset.alias("asset"), f["mode"].alias("mode"), f["kind"].alias("kind")))

            return F.flatten(F.transform(starts, run))

        return let(F.array_compact(F.transform(facts, lambda f, i: F.when(f["asset"] != "", i + 1))), runs)

    return let(useful, spread)


def _card(kind, asset, mode, text, outcome, confidence, lexicon, parts=None, symptom=None) -> Column:
    values = {
        "card_type": kind, "asset_id": asset, "failure_mode": mode,
        "symptom_summary": F.substring(text if symptom is None else symptom, 1, lexicon.summary_chars),
        "action_taken": F.substring(text, 1, lexicon.summary_chars), "parts": parts, "outcome": outcome,
        "source_excerpt": F.substring(text, 1, lexicon.excerpt_chars), "confidence": confidence}
    return F.struct(*[(F.lit(None) if values[f] is None else values[f]).cast(
        "double" if f == "confidence" else "string").alias(f) for f in CARD_FIELDS])


def note_cards(text: Column, lexicon: Lexicon = Lexicon()) -> Column:
    """Cards of a handover note. The first matching rule of a sentence decides its card type."""
    def card(f):
        kind = f["kind"]
        recurred = let(F.lower(f["sentence"]), lambda low: any_contains(low, lexicon.recurred))
        outcome = F.when(kind == "FIX!", "RESOLVED").when((kind == "GOTCHA") & recurred, "RECURRED").otherwise("UNKNOWN")
        confidence = F.when(kind == "FIX!", 0.95).when(kind == "FIX", 0.5).when(kind == "GOTCHA", 0.85).otherwise(0.8)
        return _card(F.regexp_replace(kind, "!", ""), f["asset"], f["mode"], f["sentence"], outcome, confidence,
                     lexicon)

    return F.transform(asset_context(text, lexicon), card)


def wo_cards(text: Column, subtype: Column, asset: Column, mode: Column, parts: Column,
             lexicon: Lexicon = Lexicon()) -> Column:
    """Cards of a work order: one FIX per corrective order and one GOTCHA per warning sentence of any order."""
    known = empty_to_null(mode)
    first = F.coalesce(empty_to_null(F.regexp_extract(text, r"^[^.,;]*", 0)), text)
    fix = _card(F.lit("FIX"), asset, F.coalesce(known, classify(text, lexicon)), text, F.lit("RESOLVED"), F.lit(0.9),
                lexicon, parts, first)

    def warning(s):
        outcome = F.when(any_contains(F.lower(s), lexicon.recurred), "RECURRED").otherwise("UNKNOWN")
        return _card(F.lit("GOTCHA"), asset, F.coalesce(known, classify(s, lexicon)), s, outcome, F.lit(0.85), lexicon)

    warned = F.filter(split_sentences(text), lambda s: any_contains(F.lower(s), lexicon.gotcha))
    fixes = F.filter(F.array(fix), lambda _: F.coalesce(subtype == "CORRECTIVE", F.lit(False)))
    return F.concat(fixes, F.transform(warned, warning))


def with_cards(sources: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """Sources plus the array of their cards."""
    text = F.col("source_text")
    orders = wo_cards(text, F.col("source_subtype"), F.col("asset_id"), F.col("failure_mode_code"),
                      F.col("parts_used"), lexicon)
    return sources.withColumn("cards", F.when(F.col("source_type") == "WORK_ORDER", orders).otherwise(
        note_cards(text, lexicon)))


def _time(at: Column | str) -> Column:
    return (F.lit(at) if isinstance(at, str) else at).cast("timestamp_ntz")


def number_cards(extracted: DataFrame, by: str, at: Column | str) -> DataFrame:
    """Card rows numbered from 1 within their source, in the stored shape."""
    rows = exploded(extracted, F.col("cards"), SOURCE_KEY, "card", "__pos")
    return rows.select(*SOURCE_KEY, (F.col("__pos") + 1).alias("card_seq"), *[f"card.{f}" for f in CARD_FIELDS],
                       F.lit(by).alias("extracted_by"), _time(at).alias("extracted_at"))


def extract_log(extracted: DataFrame, by: str, at: Column | str) -> DataFrame:
    """One row per processed source with its card count. A NULL card array is a failed call and stays unlogged."""
    done = extracted.filter(F.col("cards").isNotNull())
    return done.select(*SOURCE_KEY, F.size("cards").cast("int").alias("n_cards"), F.lit(by).alias("extracted_by"),
                       _time(at).alias("extracted_at"))


def flatten_responses(df: DataFrame, response: str = "resp") -> DataFrame:
    """Sources with a JSON response to sources with a card array.

    Empty asset and failure-mode texts become the source's own; a NULL response stays NULL, a response without
    cards becomes an empty array.
    """
    def defaults(card):
        own = {"asset_id": F.coalesce(empty_to_null(card["asset_id"]), F.col("asset_id")),
               "failure_mode": F.coalesce(empty_to_null(card["failure_mode"]), F.col("failure_mode_code"))}
        return F.struct(*[own.get(f, card[f]).alias(f) for f in CARD_FIELDS])

    cards = F.coalesce(F.transform(response_cards(F.col(response)), defaults),
                       F.array().cast("ARRAY<STRUCT<" + CARD_DDL.replace(" STRING", ": STRING").replace(
                           " DOUBLE", ": DOUBLE") + ">>"))
    return df.withColumn("cards", F.when(F.col(response).isNotNull(), cards))
