"""Exact dedup, the conversation trie and conversation repair against brute force, and on awkward input."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
import xxhash
from pyspark.sql import functions as F

from millwright.llm import exact_dedup, prefix_trie, repair

SMALL = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string, source string, mark string, depth string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# exact dedup

DOCS = [(1, "a b"), (2, "a \n\tb"), (3, "a  b "), (None, "a b"), (4, None), (5, ""), (6, " "), (None, "only"), (None, "none"), (None, "none"),
        (7, "x" * 200_000), (8, "x" * 200_000), (9, "same id"), (9, "same id"), (9, "same id"), (10, "a\xa0b"), (11, "A b")]


def groups_of(docs):
    by = defaultdict(list)
    for i, t in docs:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out, kept = [], set()
    for text, ids in by.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        for i in ids:
            stays = i == keep and text not in kept
            kept |= {text} if stays else set()
            out.append((i, keep, len(ids), stays, sha(text)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.encode(F.substring(t, 1, 1), "utf-8")])
def test_exact_dedup_equals_brute_force(spark, digest):
    docs = spark.createDataFrame([(i, t, "g", 1, "k", "r") for i, t in DOCS],
                                 "doc_id long, text string, `group` string, digest int, kept string, whole string")
    got = exact_dedup.exact_duplicates(docs.repartition(5), salts=3, digest=digest)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == groups_of(DOCS)
    assert exact_dedup.exact_duplicates(docs.limit(0), digest=digest).count() == 0


def test_a_hot_text_and_whole_rows(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("t"), F.col("id") % 700)).alias("text"), F.lit(1).alias("keep_id")).repartition(16)
    kept = exact_dedup.drop_exact_duplicates(docs, salts=4)
    assert kept.columns == docs.columns
    want = {}
    for r in docs.collect():
        want[r.text] = min(want.get(r.text, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want.values())


# trie

def u64(n):
    return n - (1 << 64) if n >> 63 else n


def turns_of(rows):
    """Turns by conversation; ties go by the hash of role and text that the operator sorts by."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(role.encode(), 42))
            by[c].append((turn is not None, turn or 0, u64(key), role, text))
    return {c: [(t[3], t[4]) for t in sorted(ts)] for c, ts in by.items()}


def trie_of(rows):
    own = turns_of(rows)
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, out = defaultdict(set), []
    for p in members:
        if p:
            children[p[:-1]].add(p)

    def below(p):
        stack = [p]
        while stack:
            x = stack.pop()
            yield x
            stack.extend(children[x])

    for p, cs in members.items():
        under = list(below(p))
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]), sum(not children[x] for x in under),
                    sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x), sha(ends)))
    return sorted(out, key=repr)


def awkward(seed, convs=60, most=14):
    rng, rows = random.Random(seed), []
    for c in [*range(-7, convs), 10_007, 10_005, 8190, 8195]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9, most])):
            rows.append((c, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", "assistant", "system", None, "", "tool"]),
                         rng.choice(["é", "", None, "b.", "c d", "  ", "long " * 30])))
    return rows + [(None, 1, "user", "nobody"), (2, 0, "user", "é"), (2, 0, "user", "é")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "m", "d") for r in rows], CONV)


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_brute_force(spark, seed):
    rows = awkward(seed)
    got = prefix_trie.prefix_trie(frame(spark, rows).repartition(7))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == trie_of(rows)


def test_trie_of_one_hot_conversation_and_many_equal_ones(spark):
    rows = [(5, t, "user", f"t{t % 7}") for t in range(700)] + [(7, t, "user", f"t{t % 7}") for t in range(650)]
    rows += [(c, t, "user", "same") for c in range(10_000, 10_400) for t in range(2)]
    got = prefix_trie.prefix_trie(frame(spark, rows).repartition(6))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == trie_of(rows)


def test_trie_notices_colliding_fingerprints(spark):
    rows = awkward(9, 30)
    with pytest.raises(ValueError):
        prefix_trie.prefix_trie(frame(spark, rows), moduli=(3,))
    got = prefix_trie.prefix_trie(frame(spark, rows), moduli=(3, prefix_trie.PRIME))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == trie_of(rows)


def test_trie_over_the_table(spark):
    convs = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in convs.collect()]
    assert sorted((tuple(r) for r in prefix_trie.prefix_trie(convs).collect()), key=repr) == trie_of(rows)
    assert prefix_trie.prefix_trie(convs.limit(0)).count() == 0


# repair

def cheapest(rows):
    """(cost, edits) by recursion over (role, must go, cut off)."""
    nxt = {"": [("s", "s"), ("u", "u")], "s": [("u", "u")], "u": [("a", "a")], "a": [("u", "u")]}

    @lru_cache(maxsize=None)
    def best(i, place, inserted):
        options = [] if inserted > 3 else [(c + 5, "I" + e) for r, to in nxt[place] if r != "s" for c, e in [best(i, to, inserted + 1)]]
        if i == len(rows):
            return min([*options, *([(0, "")] if place in ("", "a") else [])], default=(10**9, ""))
        role, gone, cut = rows[i]
        c, e = best(i + 1, place, 0)
        options.append((c + 2, "D" + e))
        if not gone:
            for r, to in nxt[place]:
                c, e = best(i + 1, to, 0)
                if r == role[:1]:
                    options.append((c + 5 * cut, "K" + e))
                if r != "s":
                    options.append((c + 1 + 5 * cut, "R" + e))
        return min(options)

    return best(0, "", 0)


def audits_of(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        by[c].append(((turn is not None, turn or 0, role, mark), turn, role, text))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda t: t[0])
        seen, symbols, counts = set(), [], [0, 0, 0]
        for _, _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            symbols.append((role, fault < 2, fault == 2))
        known = [t for _, t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, edits = cheapest(tuple(symbols))
        out[c] = (gaps, *counts, illegal, cost, edits, [(r, t) for _, _, r, t in turns])
    return out


def repaired_text(edits, turns):
    out, place, rest = [], "", list(turns)
    for e in edits:
        want = {"": "u", "s": "u", "u": "a", "a": "u"}[place]
        full = {"u": "user", "a": "assistant"}
        if e == "I":
            out.append(f"{full[want]}:")
            place = want
            continue
        role, text = rest.pop(0)
        if e == "D":
            continue
        if e == "K":
            place = role[:1]
        else:
            role, place = full[want], want
        out.append(f"{role}:{text}")
    assert not rest and re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in out))
    return "\n".join(out)


def test_edits_equal_recursion():
    rng = random.Random(4)
    for _ in range(1500):
        rows = tuple((rng.choice(["s", "u", "a", "u", "a", "t"]), rng.random() < 0.15, rng.random() < 0.25) for _ in range(rng.randint(0, 9)))
        rows = tuple((r, gone, cut and not gone) for r, gone, cut in rows)
        symbols = "".join("X" if gone else (r if r in "sua" else "o").upper() if cut else r if r in "sua" else "o" for r, gone, cut in rows)
        assert repair.cheapest_edits(symbols) == cheapest(rows), symbols
    single, blocks, _ = repair.tables()
    assert len(blocks) == len({v for v, _ in single}) * 9 ** 3 and all(min(v) == 0 for v, _ in single)


def check_repair(spark, rows):
    frame_ = frame(spark, rows).repartition(5)
    audits = repair.audit_conversations(frame_).cache()
    want = audits_of(rows)
    got = {r.conv_id: tuple(r)[1:] for r in audits.collect()}
    assert got == {c: v[:-1] for c, v in want.items()}
    digests = {r.conv_id: r.repaired_sha256 for r in repair.digests(repair.repaired_turns(frame_, audits)).collect()}
    for c, v in want.items():
        assert digests.get(c, sha("")) == sha(repaired_text(v[-2], v[-1])), c


def test_repair_equals_brute_force(spark):
    check_repair(spark, [(None, 0, "user", "a."), (None, 1, "assistant", "b."), *[r for s in range(2) for r in awkward(s, 50, 9)]])


def test_repair_of_a_hot_conversation(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant"]), rng.choice(["x.", f"y{t}.", f"z{t}", " "])) for t in range(150)]
    check_repair(spark, [*rows, (2, None, "user", "a?"), (2, None, "user", "a?"), (2, 4, "user", "a?"), (3, 0, "system", "s.")])


def test_repair_of_the_damaged_table(spark):
    convs = spark.read.parquet(f"{SMALL}/conversations.parquet").union(
        spark.createDataFrame([(None, None, None, None), (77_000, 19, "user", "gone or not")], "a long, b long, c string, d string"))
    damaged = []
    for c, turn, role, text in convs.collect():
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged += [(c, turn, "user" if kind == 4 else role, text)] * (kind != 0) * (2 if kind == 3 else 1)
    want = audits_of(damaged)
    got = repair.repair_damaged(convs).collect()
    assert len(got) == convs.select("conv_id").distinct().count()
    for r in got:
        v = want.get(r.conv_id, (0, 0, 0, 0, 0, 0, "", []))
        assert tuple(r)[1:-1] == v[:-1] and r.repaired_sha256 == sha(repaired_text(v[-2], v[-1]))
    assert repair.repair_damaged(convs.limit(0)).count() == 0
