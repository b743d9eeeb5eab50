"""Time-interval operators that stay linear on hot keys.

A join of every order with every later order of the same asset produces all pairs of a group. The results needed
here are minima over an interval, or positions in an order, so they are computed from two levels instead: ordered
scans inside one (key, time bucket), plus one row per (key, bucket) for everything in between. A key that holds a
third of all rows is spread over its buckets, and the bucket level has at most one row per key and bucket.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
_T, _B, _KIND, _ID = "__t", "__b", "__kind", "__id"


def _bucket(t: Column, grain_us: int) -> Column:
    return F.floor(t / F.lit(grain_us)).cast("bigint")


def interval_min(probes: DataFrame, events: DataFrame, keys: list[str], probe_id: str, lo: Column, at: Column,
                 values: dict[str, Column], length_us: int | None, grain_us: int = HOUR_US) -> DataFrame:
    """Minimum of each value over the events with ``lo <= at <= lo + length`` and equal keys, per probe.

    ``lo`` and ``at`` are microsecond columns of ``probes`` and ``events``; no ``length_us`` means no upper end.
    Returns (probe_id, values...) for probes with at least one event. The two ends of an interval lie in different
    buckets, hence ``length_us >= grain_us``.
    """
    if length_us is not None and length_us < grain_us:
        raise ValueError("the interval must not be shorter than one bucket")
    names = list(values)
    known = [F.col(k).isNotNull() for k in keys]

    ev = events.filter(at.isNotNull())
    pr = probes.filter(lo.isNotNull())
    for cond in known:
        ev, pr = ev.filter(cond), pr.filter(cond)
    ev = ev.select(*keys, at.alias(_T), *[v.alias(n) for n, v in values.items()]).withColumn(
        _B, _bucket(F.col(_T), grain_us))
    pr = pr.select(*keys, F.col(probe_id).alias(_ID), lo.alias(_T)).withColumn(_B, _bucket(F.col(_T), grain_us))

    types = {n: ev.schema[n].dataType for n in names}
    empty = [F.lit(None).cast(types[n]).alias(n) for n in names]
    id_type = pr.schema[_ID].dataType

    # One row per event, one per end of an interval.
    def end(t: Column, kind: int) -> Column:
        return F.struct(_bucket(t, grain_us).alias(_B), t.alias(_T), F.lit(kind).alias(_KIND))

    both = [end(F.col(_T), 1)] + ([] if length_us is None else [end(F.col(_T) + F.lit(length_us), 2)])
    pr = pr.select(*keys, _ID, F.explode(F.array(*both)).alias("e")).select(*keys, f"e.{_B}", f"e.{_T}", f"e.{_KIND}", _ID, *empty)
    rows = ev.select(*keys, _B, _T, F.lit(0).alias(_KIND), F.lit(None).cast(id_type).alias(_ID), *names).unionByName(pr)

    # Inside the first bucket: from lo on. Inside the last: up to lo + length. Events come first at equal times.
    part = Window.partitionBy(*keys, _B)
    span = (Window.unboundedPreceding, Window.currentRow)
    after = part.orderBy(F.col(_T).desc(), F.col(_KIND)).rowsBetween(*span)
    before = part.orderBy(F.col(_T).asc(), F.col(_KIND)).rowsBetween(*span)
    ends = rows.select(
        *keys, _B, _T, _KIND, _ID,
        *[F.min(n).over(after).alias(f"__a_{n}") for n in names],
        *([F.min(n).over(before).alias(f"__p_{n}") for n in names] if length_us is not None else [])).filter(F.col(_KIND) > 0)

    # Whole buckets in between, from one row per key and bucket that has an event or an end.
    level = rows.groupBy(*keys, _B).agg(*[F.min(n).alias(n) for n in names])
    order = Window.partitionBy(*keys).orderBy(_B)
    if length_us is None:
        rest = order.rangeBetween(1, Window.unboundedFollowing)
        inner = level.select(*keys, _B, *[F.min(n).over(rest).alias(f"__l_{n}") for n in names])
        value = lambda n: F.least(f"__a_{n}", f"__l_{n}")
    else:
        whole = length_us // grain_us
        longer = order.rangeBetween(1, whole)
        frames = [F.min(n).over(longer).alias(f"__l_{n}") for n in names]
        if whole > 1:
            shorter = order.rangeBetween(1, whole - 1)
            frames += [F.min(n).over(shorter).alias(f"__s_{n}") for n in names]
        else:
            frames += [F.lit(None).cast(types[n]).alias(f"__s_{n}") for n in names]
        inner = level.select(*keys, _B, *frames)
        last = _bucket(F.col(_T) + F.lit(length_us), grain_us)
        middle = lambda n: F.when(last - F.col(_B) > whole, F.col(f"__l_{n}")).otherwise(F.col(f"__s_{n}"))
        value = lambda n: F.when(F.col(_KIND) == 1, F.least(F.col(f"__a_{n}"), middle(n))).otherwise(F.col(f"__p_{n}"))

    # The ends are dealt by key and bucket already; only the bucket level moves.
    found = ends.join(inner, [*keys, _B]).select(_ID, *[value(n).alias(n) for n in names]).groupBy(_ID).agg(
        *[F.min(n).alias(n) for n in names])
    keep = reduce(or_, [F.col(n).isNotNull() for n in names])
    return found.filter(keep).select(F.col(_ID).alias(probe_id), *names)


def positions(events: DataFrame, keys: list[str], at: Column, order: list[Column], name: str = "pos",
              grain_us: int = HOUR_US) -> DataFrame:
    """Row number of every event inside its key, ordered by ``at`` and then ``order``.

    Numbers rows inside (key, bucket) and adds the count of all earlier buckets of the key.
    """
    rows = events.withColumn(_B, _bucket(at, grain_us))
    local = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, _B).orderBy(at, *order)))
    return local.join(_offsets(rows, keys), [*keys, _B]).withColumn(
        name, (F.col("__off") + F.col("__rn")).cast("bigint")).drop(_B, "__off", "__rn")


def _offsets(rows: DataFrame, keys: list[str]) -> DataFrame:
    per_bucket = rows.groupBy(*keys, _B).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    return per_bucket.select(*keys, _B, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"))


def count_until(probes: DataFrame, events: DataFrame, keys: list[str], probe_id: str, until: Column, at: Column,
                grain_us: int = HOUR_US) -> DataFrame:
    """(probe_id, n_until, n_total): events of the same key with ``at <= until``, and all events of the key."""
    ev = events.select(*keys, at.alias(_T)).withColumn(_B, _bucket(F.col(_T), grain_us))
    pr = probes.select(*keys, F.col(probe_id).alias(_ID), until.alias(_T)).withColumn(
        _B, _bucket(F.col(_T), grain_us))
    id_type = pr.schema[_ID].dataType
    rows = ev.select(*keys, _B, _T, F.lit(0).alias(_KIND), F.lit(None).cast(id_type).alias(_ID)).unionByName(
        pr.select(*keys, _B, _T, F.lit(1).alias(_KIND), _ID))
    seen = Window.partitionBy(*keys, _B).orderBy(_T, _KIND).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("__rn", F.sum(F.when(F.col(_KIND) == 0, 1).otherwise(0)).over(seen)).filter(
        F.col(_KIND) == 1)

    per_bucket = ev.groupBy(*keys, _B).agg(F.count("*").alias("__n"))
    marks = pr.select(*keys, _B).distinct().withColumn("__n", F.lit(0).cast("bigint"))
    level = per_bucket.unionByName(marks).groupBy(*keys, _B).agg(F.sum("__n").alias("__n"))
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    level = level.select(*keys, _B, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"),
                         F.sum("__n").over(by_key).alias("n_total"))
    return local.join(level, [*keys, _B]).select(
        F.col(_ID).alias(probe_id), (F.col("__off") + F.col("__rn")).cast("bigint").alias("n_until"),
        F.col("n_total").cast("bigint").alias("n_total"))
