"""The linear interval operators against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from millwright.operators.intervals import HOUR_US, count_until, interval_min, positions


def make(spark, seed, n, with_null=True):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b"] + ([None] if with_null else [])
    step = HOUR_US // 4
    rows = [(i, rng.choice(keys), rng.randrange(0, 400) * step, f"v{rng.randrange(1000):04d}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "id BIGINT, k STRING, t BIGINT, v STRING")


@pytest.mark.parametrize("hours,seed", [(1, 1), (2, 2), (12, 3), (30, 4), (None, 5)])
def test_interval_min_equals_brute_force(spark, hours, seed):
    prow, probes = make(spark, seed, 120)
    erow, events = make(spark, seed + 100, 150)
    length = None if hours is None else hours * HOUR_US
    got = interval_min(probes, events, ["k"], "id", F.col("t"), F.col("t"),
                       {"first_v": F.col("v"), "first_t": F.col("t")}, length)
    want = {}
    for i, k, lo, _ in prow:
        hit = [(v, t) for _, ek, t, v in erow if k is not None and ek == k and lo <= t
               and (length is None or t <= lo + length)]
        if hit:
            want[i] = (min(v for v, _ in hit), min(t for _, t in hit))
    assert {r.id: (r.first_v, r.first_t) for r in got.collect()} == want


def test_interval_shorter_than_a_bucket_is_refused(spark):
    _, df = make(spark, 1, 5)
    with pytest.raises(ValueError):
        interval_min(df, df, ["k"], "id", F.col("t"), F.col("t"), {"v": F.col("v")}, HOUR_US - 1)


def test_positions_and_counts_equal_brute_force(spark):
    rows, df = make(spark, 7, 200, with_null=False)
    got = {r.id: r.pos for r in positions(df, ["k"], F.col("t"), [F.col("id")]).collect()}
    want = {}
    for key in {r[1] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])), 1):
            want[r[0]] = n
    assert got == want
    prow, probes = make(spark, 8, 60, with_null=False)
    counted = {r.id: (r.n_until, r.n_total) for r in count_until(probes, df, ["k"], "id", F.col("t"), F.col("t")).collect()}
    for i, k, t, _ in prow:
        same = [r for r in rows if r[1] == k]
        assert counted[i] == (sum(r[2] <= t for r in same), len(same))
