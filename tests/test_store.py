"""The keyed store against plain dictionaries: merge on read, compaction, commits over several tables."""

import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millwright.session import fresh_path
from millwright.sources.store import Store, Table

T = Table("t", StructType([StructField(c, k) for c, k in (("k", LongType()), ("g", StringType()), ("x", LongType()), ("s", StringType()))]),
          ("k", "g"), 5)
U = Table("u", StructType([StructField("id", LongType()), StructField("v", StringType())]), ("id",), 3)


@pytest.fixture
def store(spark):
    return Store(spark, fresh_path(spark, "store"), [T, U])


def frame(spark, rows, ddl="k LONG, g STRING, x LONG, s STRING"):
    return spark.createDataFrame(rows, ddl)


def state(store, name="t", upto=None):
    return sorted((tuple(r) for r in store.read(name, upto).collect()), key=repr)


def test_random_changes_equal_a_dictionary(spark, store):
    rng, held, versions = random.Random(3), {}, []
    for step in range(6):
        batch = store.batch()
        keys = [(rng.randrange(40), rng.choice(["a", None])) for _ in range(12)]
        new = {k: (*k, rng.randrange(9), rng.choice(["p", None])) for k in keys[:6]}
        changes = {k: (*k, rng.choice([None, 100 + step]), rng.choice([None, f"s{step}"])) for k in keys[4:10]}
        gone = {(rng.randrange(40), "a") for _ in range(5)}
        assert batch.insert("t", frame(spark, list(new.values()))) == len(new)
        batch.update("t", frame(spark, list(changes.values())))
        batch.delete("t", frame(spark, [*gone, *gone], "k LONG, g STRING"))
        before = state(store)
        assert before == (versions[-1][1] if versions else [])  # nothing of an open batch shows
        held.update(new)
        for k, c in changes.items():
            if k in held:
                held[k] = (*k, *[n if n is not None else o for n, o in zip(c[2:], held[k][2:])])
        held = {k: v for k, v in held.items() if k not in gone}
        versions.append((batch.commit(), sorted(held.values(), key=repr)))
        assert state(store) == versions[-1][1]
        if step == 3:
            assert store.compact("t") and state(store) == versions[-1][1]
    for seq, rows in versions:
        assert state(store, upto=seq) == rows


def test_compaction_leaves_unchanged_buckets(spark, store):
    batch = store.batch()
    batch.insert("t", frame(spark, [(i, "a", i, "s") for i in range(100)]))
    batch.commit()
    first = {p.bucket: p.piece for p in store.pieces("t")}
    assert len(first) == 5
    assert "Exchange" not in store.read("t")._jdf.queryExecution().executedPlan().toString()  # plain pieces: no shuffle
    batch = store.batch()
    batch.update("t", frame(spark, [(7, "a", 70, None)]))
    batch.commit()
    rewritten = store.compact("t")
    assert len(rewritten) == 1
    now = store.pieces("t")
    assert {p.bucket: p.piece for p in now if p.bucket not in rewritten} == {b: p for b, p in first.items() if b not in rewritten}
    assert len(now) == 5 and not any(p.merges for p in now) and store.compact("t") == []
    assert state(store) == sorted([(i, "a", 70 if i == 7 else i, "s") for i in range(100)], key=repr)


def test_a_batch_that_dies_is_not_seen_and_can_be_repeated(spark, store):
    first = store.batch("one")
    first.insert("t", frame(spark, [(1, "a", 1, "s")]))
    first.insert("u", frame(spark, [(1, "v")], "id LONG, v STRING"))
    first.commit()
    dying = store.batch("two")
    dying.update("t", frame(spark, [(1, "a", 2, None)]))  # and then nothing more: no commit
    assert state(store) == [(1, "a", 1, "s")] and not store.has("two")
    for _ in range(2):  # the second time it finds its own commit
        again = store.batch("two")
        again.update("t", frame(spark, [(1, "a", 2, None)]))
        again.delete("u", frame(spark, [(1,)], "id LONG"))
        again.commit()
    assert state(store) == [(1, "a", 2, "s")] and state(store, "u") == []
    assert sum(r.label == "two" for r in store.log()) == 2


def test_refusals(spark, store):
    batch = store.batch()
    with pytest.raises(Exception, match="several rows of one key"):
        batch.insert("t", frame(spark, [(1, "a", 1, "s"), (1, "a", 2, "s")]))
    with pytest.raises(ValueError):
        batch.insert("t", frame(spark, [(1, "a")], "k LONG, g STRING"))
    with pytest.raises(ValueError):
        batch.update("t", frame(spark, [(1, "a", 3)], "k LONG, g STRING, other LONG"))
    batch.commit()
    assert state(store) == [] and store.read("t").columns == ["k", "g", "x", "s"]
    batch = store.batch()
    batch.update("t", frame(spark, [(1, "a", 1, "s")]))  # of a key that is not stored
    batch.commit()
    assert state(store) == []
    store.compact("t")
    assert state(store) == []
