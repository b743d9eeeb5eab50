"""Checks that yield (check_name, result, detail) rows, and scoring of answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.exprs import add_hours
from millwright.operators.retrieval import top


def _verdict(name, passed: Column, detail: Column) -> list[Column]:
    label = F.lit(name) if isinstance(name, str) else name
    return [label.alias("check_name"), F.when(F.coalesce(passed, F.lit(False)), "PASS").otherwise("FAIL").alias("result"),
            F.coalesce(detail.cast("string"), F.lit("")).alias("detail")]


def run_suite(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks).orderBy("check_name")


def check_expected(df: DataFrame, expected: DataFrame, keys: list[str], tolerance: dict[str, tuple[str, float]],
                   label: Column) -> DataFrame:
    """One row per expectation; ``tolerance`` maps a column to ("abs" or "rel", limit). A missing row fails."""
    got = df.select(*keys, *[F.col(c).alias(f"got_{c}") for c in tolerance])
    joined = expected.join(got, keys, "left")

    def close(c):
        kind, limit = tolerance[c]
        gap = F.abs(F.col(f"got_{c}") - F.col(c))
        return (gap / F.abs(F.nullif(F.col(c), F.lit(0.0))) if kind == "rel" else gap) <= limit

    passed = reduce(lambda a, b: a & b, [close(c) for c in tolerance])
    last = list(tolerance)[0]
    detail = F.concat(F.lit("got "), F.coalesce(F.round(f"got_{last}", 4).cast("string"), F.lit("nothing")),
                      F.lit(" expected "), F.col(last).cast("string"))
    return joined.select(*_verdict(label, passed, detail))


def check_counts(tables: dict[str, DataFrame], expected: dict[str, int], name: str = "row counts") -> DataFrame:
    counts = reduce(DataFrame.unionByName, [
        tables[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("tbl"), "n", F.lit(n).alias("want"))
        for t, n in expected.items()])
    return counts.agg(F.min(F.col("n") == F.col("want")).alias("ok"), F.array_sort(F.collect_list(
        F.concat("tbl", F.lit("="), F.col("n").cast("string")))).alias("seen")).select(
        *_verdict(name, F.col("ok"), F.array_join("seen", " ")))


def check_set(df: DataFrame, column: str, expected: list, name: str) -> DataFrame:
    """Exactly these values, one row each."""
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(column).isin(*expected)).alias("hits")).select(
        *_verdict(name, (F.col("n") == len(expected)) & (F.col("hits") == len(expected)),
                  F.concat(F.col("n").cast("string"), F.lit(" row(s)"))))


def check_count_where(df: DataFrame, condition: Column, name: str, at_least: int | None = None,
                      exactly: int | None = None) -> DataFrame:
    """Number of rows that satisfy a condition."""
    n = F.col("n")
    passed = F.lit(True)
    if at_least is not None:
        passed = passed & (n >= at_least)
    if exactly is not None:
        passed = passed & (n == exactly)
    return df.agg(F.count_if(condition).alias("n")).select(*_verdict(name, passed, n))


def check_contains(df: DataFrame, column: str, phrase: str, name: str, exactly: int = 1) -> DataFrame:
    return check_count_where(df, F.contains(F.col(column), F.lit(phrase)), name, exactly=exactly)


def check_phrase_once(df: DataFrame, column: str, phrase: str) -> DataFrame:
    return check_contains(df, column, phrase, f"phrase appears once: {phrase}")


def check_cards(cards: DataFrame, expected: DataFrame) -> DataFrame:
    """Each expected card (ref, source_id, card_type, asset_id, outcome or NULL, excerpt_like) exists."""
    c = cards.select("source_id", "card_type", "asset_id", "card_id", F.col("outcome").alias("__outcome"),
                     "source_excerpt")
    on = [expected[k] == c[k] for k in ("source_id", "card_type", "asset_id")]
    on += [expected["outcome"].isNull() | (expected["outcome"] == c["__outcome"]),
           F.like(c["source_excerpt"], expected["excerpt_like"])]
    counts = expected.join(c, on, "left").groupBy(expected["ref"], expected["card_type"], expected["source_id"]).agg(
        F.count("card_id").alias("n"))
    return counts.select(*_verdict(F.concat_ws(" ", F.lit("card"), "ref", "card_type", "source_id"), F.col("n") > 0,
                                   F.concat(F.col("n").cast("string"), F.lit(" matching card(s)"))))


def check_window_contains(windows: DataFrame, condition: Column, hours: float, name: str) -> DataFrame:
    """The failure window of the chosen anomalies covers a remaining time."""
    return windows.filter(condition).agg(F.min("eta_low_h").alias("lo"), F.max("eta_high_h").alias("hi")).select(
        *_verdict(name, (F.col("lo") <= hours) & (F.col("hi") >= hours), F.concat_ws(
            " - ", F.round("lo", 1).cast("string"), F.concat(F.round("hi", 1).cast("string"), F.lit(" h")))))


def check_windows_contain(windows: DataFrame, expected: DataFrame) -> DataFrame:
    """Per expected row (asset_id, hours): the failure windows of the asset cover that remaining time."""
    spans = windows.groupBy("asset_id").agg(F.min("eta_low_h").alias("lo"), F.max("eta_high_h").alias("hi"))
    df = expected.join(spans, "asset_id", "left")
    passed = F.coalesce((F.col("lo") <= F.col("hours")) & (F.col("hi") >= F.col("hours")), F.lit(False))
    return df.select(*_verdict(F.concat(F.col("asset_id"), F.lit(" window holds "), F.col("hours").cast("string"), F.lit(" h")), passed,
                               F.concat_ws(" - ", F.round("lo", 1).cast("string"), F.concat(F.round("hi", 1).cast("string"), F.lit(" h")))))


def check_edges(edges: DataFrame, expected: DataFrame) -> DataFrame:
    """Per expected row (relation, from_source, to_source): an edge leads from a card of the one source to a card of the other."""
    def source(end: str) -> Column:
        return F.regexp_extract(end, r"^CARD-(.*)-\d+$", 1)

    found = edges.select("relation", source("from_id").alias("from_source"), source("to_id").alias("to_source"), F.lit(1).alias("hit"))
    keys = ["relation", "from_source", "to_source"]
    counts = expected.join(found, keys, "left").groupBy(*keys).agg(F.count("hit").alias("n"))
    return counts.select(*_verdict(F.concat_ws(" ", F.lit("edge"), "from_source", "relation", "to_source"), F.col("n") > 0,
                                   F.concat(F.col("n").cast("string"), F.lit(" edge(s)"))))


def check_matches(matches: DataFrame, anomalies: DataFrame, expected: DataFrame) -> DataFrame:
    """Per expected row (asset_id, failure_mode, is_match): a live anomaly of the asset matches an episode of that mode, or none does."""
    found = matches.where("is_match").join(anomalies.select("anomaly_id", "asset_id"), "anomaly_id").select(
        "asset_id", "failure_mode", F.lit(1).alias("hit"))
    keys = ["asset_id", "failure_mode"]
    counts = expected.join(found, keys, "left").groupBy(*keys, "is_match").agg(F.count("hit").alias("n"))
    kind = F.when(F.col("is_match"), "matches").otherwise("matches no")
    return counts.select(*_verdict(F.concat_ws(" ", kind, "asset_id", "failure_mode"), (F.col("n") > 0) == F.col("is_match"),
                                   F.concat(F.col("n").cast("string"), F.lit(" match(es)"))))


def check_phrases_once(df: DataFrame, column: str, phrases: list[str]) -> DataFrame:
    """Each phrase stands in exactly one row; one scan for all of them."""
    counts = df.agg(*[F.count_if(F.contains(F.col(column), F.lit(p))).alias(f"n{i}") for i, p in enumerate(phrases)])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(f"n{i}").alias("n")) for i, p in enumerate(phrases)])).alias("r"))
    return rows.select("r.*").select(*_verdict(F.concat(F.lit("phrase appears once: "), F.col("phrase")), F.col("n") == 1, F.col("n")))


def check_unique(df: DataFrame, keys: list[str], name: str | None = None) -> DataFrame:
    """No key occurs twice. Counting is partial before the shuffle; only key counts move."""
    dup = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    return dup.select(*_verdict(name or "unique " + ", ".join(keys), F.col("n") == 0,
                                F.concat(F.col("n").cast("string"), F.lit(" duplicate key(s)"))))


def check_window_shift(readings: DataFrame, asset, channel: str, start: str, hours: float, earlier_h: float,
                       low: float, high: float, name: str, relative: bool = True) -> DataFrame:
    """Mean of a window against the same clock time earlier: their ratio, or difference, lies in [low, high]."""
    begin = F.lit(start).cast("timestamp_ntz")
    now = (F.col("ts") >= begin) & (F.col("ts") < add_hours(begin, hours))
    then = (F.col("ts") >= add_hours(begin, -earlier_h)) & (F.col("ts") < add_hours(begin, hours - earlier_h))
    means = readings.filter((F.col("asset_id") == F.lit(asset)) & (now | then)).agg(
        F.avg(F.when(now, F.col(channel))).alias("a"), F.avg(F.when(then, F.col(channel))).alias("b"))
    value = F.try_divide(F.col("a"), F.col("b")) if relative else F.col("a") - F.col("b")
    return means.select(*_verdict(name, value.between(low, high), F.round(value, 4)))


# ---------------------------------------------------------------- answer scoring
def score_answers(questions: DataFrame, answers: DataFrame, cannot: str) -> DataFrame:
    """Correct, cited and refused per question.

    ``questions``: qid, category, refuse, expect_any (array or NULL), first_number (text or NULL).
    ``answers``: qid, answer, citations, refused.
    """
    text = F.coalesce("answer", F.lit(""))
    df = questions.join(answers.select("qid", "answer", "citations", F.col("refused").alias("__refused")), "qid", "left")
    refused = F.coalesce("__refused", F.lit(False)) | F.contains(text, F.lit(cannot))
    low = F.lower(text)
    any_ok = F.col("expect_any").isNull() | (F.size("expect_any") == 0) | F.exists(
        "expect_any", lambda e: F.contains(low, F.lower(e)))
    number_ok = F.col("first_number").isNull() | F.contains(text, F.col("first_number"))
    correct = F.when(F.coalesce("refuse", F.lit(False)), refused).otherwise(~refused & any_ok & number_ok)
    cited = (F.coalesce(F.size("citations"), F.lit(0)) > 0) & ~refused
    return df.select("qid", "category", F.coalesce("refuse", F.lit(False)).alias("refuse"), correct.alias("correct"),
                     cited.alias("cited"), refused.alias("refused"))


def hit_at_k(ranked: DataFrame, expected: DataFrame, by: str, item: str, k: int = 3,
             order: list[Column] | None = None) -> DataFrame:
    """Is the expected item among the first ``k`` of its group?"""
    best = top(ranked, [by], k, order).select(by, item).distinct().withColumn("hit", F.lit(True))
    return expected.join(best, [by, item], "left").select(by, item, F.coalesce("hit", F.lit(False)).alias("hit"))


def rollup_scores(scores: DataFrame, by: str = "category") -> DataFrame:
    """Counts per category, for everything ("all") and for the questions that have an answer ("answerable")."""
    kinds = F.array_compact(F.array(F.col(by), F.lit("all"), F.when(~F.col("refuse"), "answerable")))
    rows = scores.withColumn("grp", F.explode(kinds))
    return rows.groupBy("grp").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"),
                                   F.count_if("cited").alias("n_cited"), F.count_if("refused").alias("n_refused"))
