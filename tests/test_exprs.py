import datetime as dt

import pytest
from pyspark.sql import functions as F

from millwright.functions import exprs as e
from millwright.functions.text import classify, split_sentences, tokens
from millwright.session import work_dir


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()[0]


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize("unit,a,b,want", [
    ("day", "2024-01-01 23:00:00", "2024-01-02 01:00:00", 1), ("hour", "2024-01-01 23:00:00", "2024-01-02 01:00:00", 2),
    ("hour", "2024-01-01 00:30:00", "2024-01-01 01:15:00", 1), ("minute", "2024-01-01 00:30:00", "2024-01-01 01:15:00", 45),
    ("minute", "2024-01-01 00:00:59", "2024-01-01 00:01:00", 1), ("hour", "1969-12-31 23:30:00", "1970-01-01 00:10:00", 1)])
def test_boundary_diff_counts_boundaries_both_ways(spark, unit, a, b, want):
    assert one(spark, e.boundary_diff(unit, ts(a), ts(b))) == want
    assert one(spark, e.boundary_diff(unit, ts(b), ts(a))) == -want


def test_safe_ratio(spark):
    assert one(spark, e.safe_ratio(F.lit(3), F.lit(7))) == pytest.approx(3 / 7, abs=1e-15)
    assert one(spark, e.safe_ratio(F.lit(3), F.lit(0))) == 0.0
    assert one(spark, e.safe_ratio(F.lit(3), F.lit(None).cast("int"))) is None
    assert one(spark, e.ratio_or_null(F.lit(3), F.lit(0))) is None


def test_time_helpers(spark):
    t = ts("2024-03-13 10:45:30")
    assert one(spark, e.trunc_ntz("hour", t)) == dt.datetime(2024, 3, 13, 10)
    assert one(spark, e.week_start(t.cast("date"))) == dt.date(2024, 3, 11)
    assert one(spark, e.add_hours(t, 1.5)) == dt.datetime(2024, 3, 13, 12, 15, 30)
    assert one(spark, e.add_days(t, -13)) == dt.datetime(2024, 2, 29, 10, 45, 30)
    assert one(spark, e.stamp(t)) == "2024031310"


def test_parse_parts(spark):
    got = one(spark, e.parse_parts(F.lit(" 16:2; B ;;C:x;71:")))
    assert [(r.part, r.qty) for r in got] == [("16", 2), ("B", 1), ("C", 1), ("71", 1)]
    assert one(spark, e.parse_parts(F.lit(None).cast("string"))) == []
    assert one(spark, e.split_list(F.lit("16|71 | CNC"), "|")) == ["16", "71", "CNC"]


def test_sentences(spark):
    text = "  Line ok. When P3 starts!  Fix = swap? no.end \n"
    assert one(spark, split_sentences(F.lit(text))) == ["Line ok.", "When P3 starts!", "Fix = swap?", "no.end"]
    assert one(spark, split_sentences(F.lit(" \n "))) == []


def test_tokens(spark):
    assert one(spark, tokens(F.lit("Brg vib; bearings changed, HT3"))) == ["bear", "vibration", "bear", "chang", "ht-3"]
    assert one(spark, tokens(F.lit("The P3 a x is"))) == []


def test_classify_takes_the_first_mode(spark):
    assert one(spark, classify(F.lit("Motor trip and bearing noise"))) == "MOTOR_OVERHEAT"
    assert one(spark, classify(F.lit("nothing"))) is None


def test_find_and_like(spark):
    assert one(spark, e.find(F.lit("see p3 now"), r"\b(P[1-3])\b")) == "p3"
    assert one(spark, e.find(F.lit("xp3y"), r"\b(P[1-3])\b")) is None
    assert one(spark, e.like(F.lit("abc"), F.lit("a%"))) is True
    assert one(spark, e.let(F.lit(3), lambda x: x * x + x)) == 12


def test_work_dir_follows_the_session(spark):
    assert work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
