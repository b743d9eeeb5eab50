"""Training-data operators against brute force, round trips and held-out labels, and on awkward input."""

import base64
import hashlib
import math
import random
import re

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from millwright.llm import (decontaminate, graph, line_dedup, mixing, quality, secret_scan, simhash, sketches,
                            substring_dedup, toxicity, warc)

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(20))
#: Nulls, empty and long texts, ties and repeated rows; extra columns whose names the operators use themselves.
ROWS = [(1, "a b c"), (2, None), (3, ""), (None, "token = abcdefghijkl1234"), (4, LONG), (5, LONG), (6, "a b c"), (6, "a b c"),
        (7, f"x {PASSAGE} y"), (8, f"z {PASSAGE} q\nr"), (9, "   \n\t "), (10, "ÄÖ ñandú éé\n\nÄÖ"), (11, "a b c\nd e f\ng"),
        (12, "h\na b c\nd e f\ng")]
SCHEMA = "doc_id long, text string, source string, lang string, rank string, bucket string, n string, term string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if k % 3 else f"s{k % 2}", "en", "r", "b", "n", "t")
                                  for k, (i, t) in enumerate(ROWS)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_id(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# secrets

def test_trigram_queries():
    code = lambda s: int.from_bytes(s.encode(), "big")
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == [[sorted([code("aki"), code("kia")])]]
    assert secret_scan.trigram_query("[0-9a-f]+") == []
    assert secret_scan.trigram_query("(abc|xyz)+q*") == [[[code("abc")], [code("xyz")]]]
    assert len(secret_scan.trigram_query(secret_scan.BASE[0].pattern)[0]) == 6  # api_?key has two spellings
    with pytest.raises(ValueError):
        secret_scan.trigram_query("(?i)token")


def test_secrets_equal_a_scan_without_index(spark, documents, odd):
    planted = [(10**6, "Password: 'abcdefgh1234' AKIA" + "B" * 16 + " " + "0a" * 10),
               (10**6 + 1, "token: secret: aaaaaaaaaaaaaaaaaa"), (10**6 + 2, "é api_key=\"x.y/z+12345678\" ghp_" + "a1" * 16)]
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(
        spark.createDataFrame(planted, "doc_id long, text string"))
    rules = secret_scan.BASE + secret_scan.MORE
    want = []
    for i, text in docs.collect():
        found = sorted((m.start(), nr, m.end()) for nr, r in enumerate(rules) for m in re.finditer(r.pattern, text or "")
                       if len(m.group(r.group)) >= r.least)
        want.append((i, ",".join(f"{rules[nr].kind}:{a}:{b}" for a, nr, b in found)))
    got = secret_scan.digest_spans(secret_scan.find_secrets(docs))
    assert by_id(got, "doc_id", "spans") == sorted(want, key=repr)
    assert sum(bool(s) for _, s in want) >= 4
    none = got.where("doc_id = 3").first()
    assert none.base_sha256 == hashlib.sha256(b"").hexdigest() and none.n_hex == 0


# archives

PAGES = "page_id long, url string, html string, type string, file string"


def test_archives_round_trip(spark):
    fake = ("<p>WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
            "WARC/1.1\r\nContent-Length: 40\r\n\r\n</p>")
    pages = [(1, "http://a", fake), (2, "http://b\r\nContent-Length: 9", "é" * 50_000), (3, None, None), (4, "u", ""),
             (5, "u", fake), (6, "u", "x\r\n\r\ny"), (7, "u", "é" * 50_000), (7, "u", "é" * 50_000), (None, "u", "one")]
    df = spark.createDataFrame([(*p, "t", "f") for p in pages], PAGES)
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html in pages:
        raw = (html or "").encode()
        to = first.get(html or "")
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                     "response" if to in (i, None) else "revisit", None if to in (i, None) else to))
    got = warc.round_trip(df)
    assert by_id(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_reachable_follows_only_the_chain(spark):
    chain = [("f", 0, 10), ("f", 4, 10), ("f", 10, 25), ("f", 12, 14), ("f", 14, 25), ("f", 25, None), ("f", 30, 12),
             ("g", 0, 7), ("g", 5, 9), ("g", 9, None)]
    got = warc.reachable(spark.createDataFrame(chain, "file string, offset long, next long"))
    assert by_id(got, "file", "offset") == [("f", 0), ("f", 10), ("f", 25), ("g", 0)]


# toxicity

def test_marginals_equal_enumeration():
    import itertools

    import numpy as np
    rng = np.random.default_rng(1)
    chain = np.array([0.3, -0.5, 0.7, 0.4])
    sizes = [1, 4, 0, 3]
    row = np.repeat(np.arange(4), sizes)
    e = rng.normal(size=len(row))
    p, pairs = toxicity.marginals(e, row, 4, chain)
    trans = {(0, 0): 0, (0, 1): chain[1], (1, 0): chain[2], (1, 1): chain[3]}
    want, seen = [], np.zeros(3)
    for r, n in enumerate(sizes):
        mine = e[row == r]
        paths = list(itertools.product((0, 1), repeat=n))
        w = np.array([np.exp(sum(m for m, y in zip(mine, ys) if y) + sum(trans[q] for q in zip(ys, ys[1:]))) for ys in paths])
        w = w / w.sum()
        want += [sum(x for x, ys in zip(w, paths) if ys[t]) for t in range(n)]
        for x, ys in zip(w, paths):
            for q in zip(ys, ys[1:]):
                if q != (0, 0):
                    seen[[(0, 1), (1, 0), (1, 1)].index(q)] += x
    assert np.allclose(p, want) and np.allclose(pairs, seen)


def test_toxicity_on_held_out_documents(spark, odd, empty):
    rng = random.Random(5)
    plain = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(1500):
        text = rng.choices(plain, k=60)
        if i % 6 == 0:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(["grobian", "Grobians", "wretch"]) + rng.choice(["", "ly", "ness"])
        rows.append((i, " ".join(text), int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic long")
    labels = docs.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic long"))
    model = toxicity.train(docs, labels, max_docs=800)
    scored = toxicity.score_documents(docs, model).withColumn("out", toxicity.held_out(F.col("doc_id")))
    wrong = [r for r in scored.where("out").collect() if (r.score >= 0.5) != (r.doc_id % 6 == 0)]
    assert not wrong
    text = rows[0][1]
    assert {text[s.start:s.end].lower()[:6] for s in scored.where("doc_id = 0").first().spans} <= {"grobia", "wretch"}
    out = toxicity.score_documents(odd, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score < 0.5 for r in out)
    assert toxicity.score_documents(empty, model).count() == 0
    blank = toxicity.train(empty, labels.limit(0))
    assert all(r.score <= 0.5 for r in toxicity.score_documents(odd, blank).collect())


# mixing

def test_targets_and_taken_words(spark, odd, empty):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 90), ("d", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    weight, target, capped = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {}, set()
    size = {"a": 10, "b": 1000, "c": 1000, None: 90, "d": 0}
    while True:
        left = 2100 - sum(3 * size[s] for s in capped)
        target = {s: 3 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in size if x not in capped) for s in size}
        over = {s for s in size if target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx(target)
    for docs in (odd, odd.unionByName(odd)):
        rows = mixing.mix_sources(docs, per_bucket=3).collect()
        assert len(rows) == docs.count()
        for source in {r.source for r in rows}:
            mine = [r for r in rows if r.source == source]
            assert sum(r.size for r in mine) == mine[0].source_size
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
            assert all(0 <= r.taken <= 3 * r.size for r in mine)
        assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix_sources(docs, per_bucket=100).collect()))
    assert mixing.mix_sources(empty).count() == 0


# near-duplicates

def fingerprint(text, k=3):
    low = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(low[i:i + k]) for i in range(len(low) - k + 1)] or ([" ".join(low)] if low else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def grouped(prints, radius=3):
    low = {i: i for i in prints}
    for _ in prints:
        old = dict(low)
        for a in prints:
            low[a] = min(low[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= radius)
        if low == old:
            return low


def test_near_duplicates_equal_brute_force(spark, documents, odd, empty):
    docs = documents.select((F.col("doc_id") + 100).alias("doc_id"), "text").unionByName(odd.select("doc_id", "text"))
    rows = docs.collect()
    prints = {r.doc_id: fingerprint(r.text) for r in rows if r.doc_id is not None}
    low = grouped(prints)
    want = [(r.doc_id, f"{fingerprint(r.text):016x}", low.get(r.doc_id)) for r in rows]
    assert by_id(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    assert simhash.near_duplicates(empty).count() == 0


def test_links_within_crowded_cells(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 60:
        x = rng.choice(sorted(prints))
        for _ in range(rng.choice((1, 2, 3, 3, 9))):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = dict(enumerate(sorted(prints)))
    reps = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in prints.items()], "print long, node long")
    want = {i: c for i, c in grouped(prints).items() if i != c}
    for crowd in (2, 1000):
        got = graph.components(simhash.links(reps, crowd=crowd))
        assert {r.node: r.component for r in got.collect()} == want


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i * 7 % 101, (i + 1) * 7 % 101) for i in range(100)] + [(5, 5), (500, 501), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in graph.components(path).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, 501: 500}


# decontamination

def test_contamination_equals_brute_force(spark, documents, odd, empty):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").unionByName(spark.createDataFrame(
        [(900, PASSAGE.upper()), (901, "A"), (902, None), (903, "... !"), (904, "b c"), (900, "x " + PASSAGE)], "item_id long, text string"))
    docs = documents.select((F.col("doc_id") + 100).alias("doc_id"), "text").unionByName(odd.select("doc_id", "text"))
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    spots = {}
    for i, t in items.collect():
        w = terms(t)
        for k in range(max(1, len(w) - 12)) if w else []:
            spots.setdefault(tuple(w[k:k + 13]), set()).add(i)
    want = []
    for i, t in docs.collect():
        w, hit, seen = terms(t), set(), set()
        for n in {len(s) for s in spots} if i is not None else ():
            for k in range(len(w) - n + 1):
                if (found := spots.get(tuple(w[k:k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    seen |= found
        names = ",".join(sorted(map(str, seen)))
        want.append((i, len(w), len(hit), len(seen), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    got = by_id(decontaminate.contamination(docs, items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(want, key=repr)
    assert not decontaminate.contamination(docs, items.limit(0)).where("n_hit > 0").count()
    assert decontaminate.contamination(empty, items).count() == 0


def test_terms_in_blocks_and_proximity(spark):
    docs = spark.createDataFrame([(1, "the rare a b unusual c odd"), (2, "rare" + " the" * 40 + " unusual odd"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "The odd, unusual: rare the"), (2, "the absent")], "item_id long, text string")
    got = decontaminate.proximity_matches(docs, items, n_terms=3, span=10)
    assert by_id(got, "doc_id", "item_id") == [(1, 1)]
    terms = spark.createDataFrame([("the",), ("odd",), ("rare",), ("nowhere",)], "term string")
    assert by_id(decontaminate.term_counts(docs, terms, most=1), "term", "n") == [("odd", 2), ("rare", 2), ("the", 41)]


# lines

@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_repeated_lines_equal_brute_force(spark, odd, empty, m):
    rng = random.Random(m)
    made = [(100 + i, "\n".join(rng.choice("abcde") for _ in range(rng.randrange(1, 14)))) for i in range(40)]
    made += [(200 + i, f"{i}\n{PASSAGE} {PASSAGE} {PASSAGE[:n]}\n-{i}") for i, n in enumerate((40, 40, 20, 20, 26, 26))]
    docs = odd.unionByName(spark.createDataFrame([(i, t, *"slrbnt") for i, t in made], SCHEMA))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    first, first_line = {}, {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t is not None}):
        lines = t.split("\n")
        for k, line in enumerate(lines):
            first_line.setdefault(line, (i, k))
        for k in range(len(lines) - m + 1):
            first.setdefault(tuple(lines[k:k + m]), (i, k))
    want = []
    for i, t in rows:
        if i is not None and t is not None:
            lines = t.split("\n")
            gone = {k for k, line in enumerate(lines) if len(words(line)) >= 13 and first_line[line] < (i, k)}
            for k in range(len(lines) - m + 1):
                if first[tuple(lines[k:k + m])] < (i, k):
                    gone |= set(range(k, k + m))
            t = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        want.append((i, t))
    got = line_dedup.remove_repeated_lines(docs, m)
    assert got.columns == [*docs.columns, "removed_lines"]
    assert by_id(got, "doc_id", "text") == sorted(want, key=repr)
    clash = docs.select("doc_id", "text", *[F.lit(7).alias(c) for c in ("gone", "lines", "row", "removed_lines", "__gone", "__lines")])
    odd_names = line_dedup.remove_repeated_lines(clash, m, count="n")
    assert odd_names.columns == [*clash.columns, "n"] and odd_names.where("removed_lines = 7").count() == docs.count()
    assert by_id(odd_names, "doc_id", "text", "n") == by_id(got, "doc_id", "text", "removed_lines")
    assert line_dedup.remove_repeated_lines(empty, m).count() == 0


def test_suffix_ranks_sort_prefixes(spark):
    docs = spark.createDataFrame([(1, "a\nb\na\nb"), (2, "a\nb\nc")], "doc_id long, text string")
    got = {(r.doc_id, r.line): r.rank for r in line_dedup.repeated_suffixes(docs, 2).collect()}
    assert set(got) == {(1, 0), (1, 2), (2, 0)} and len(set(got.values())) == 1


# passages

@pytest.mark.parametrize("buckets", [1, 16])
def test_duplicate_passages_equal_brute_force(spark, documents, odd, empty, buckets):
    docs = documents.select((F.col("doc_id") + 100).alias("doc_id"), "text").unionByName(odd.select("doc_id", "text")).repartition(7)
    rows = docs.collect()
    first = {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), i)
    want = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - 12) if i is not None else []:
            if first[tuple(w[k:k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = substring_dedup.remove_duplicate_passages(docs, buckets=buckets)
    assert by_id(got, "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text") == sorted(want, key=repr)
    assert substring_dedup.remove_duplicate_passages(empty).count() == 0


def test_factors_name_their_reference(spark):
    docs = spark.createDataFrame([(1, f"q {PASSAGE}"), (2, f"r s {PASSAGE} t")], "doc_id long, text string")
    got = substring_dedup.factors(docs).collect()
    assert {(r.ref_doc_id, r.ref_start - r.start) for r in got} == {(1, -1)} and sum(r.n_windows for r in got) == 8


# quality

def test_resampling(spark, odd, empty):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["good", "prose", "reads", "well"], k=30) if i % 2 else rng.choices(["junk%%", "***", "zz"], k=30)), i % 2)
            for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality long")
    ratio = quality.log_ratio(docs, docs.select("doc_id", "quality"), max_docs=50)
    got = quality.resample(docs, ratio, fraction=0.3).collect()
    assert sum(r.selected for r in got) == 60 and all(r.doc_id % 2 for r in got if r.selected)
    assert by_id(quality.resample(docs.repartition(5), ratio, fraction=0.3), "doc_id", "gumbel_key") == sorted(((r.doc_id, r.gumbel_key) for r in got), key=repr)
    more = quality.resample(odd, ratio)
    assert more.count() == len(ROWS) and more.where("doc_id = 3").first().log_weight == 0
    assert quality.resample(empty, ratio).count() == 0


def test_target_counts_all_good_documents(spark):
    docs = spark.range(10_400).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), "id").alias("text"), F.lit(1).alias("quality"))
    assert abs(quality.log_ratio(docs, docs.select("doc_id", "quality"))).max() < 1e-12  # target and raw text are the same


def test_top_k_equals_sorting(spark):
    rng = random.Random(4)
    rows = [(round(rng.gauss(0, 1), 2), i % 150) for i in range(300)] + [(0.5, 7)] * 5
    df = spark.createDataFrame(rows, "key double, doc_id long")
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    for k in (1, 17, 150, 304):
        assert quality.top_k(df, k, bins=4, small=3 if k != 150 else 1000) == order[k - 1]
    assert quality.top_k(df, 305) is None
    same = spark.range(500).select(F.lit(2.5).alias("key"), (F.col("id") % 40).alias("doc_id"))  # all of one key, ids repeated
    for k in (1, 13, 14, 499):
        assert quality.top_k(same, k, bins=4, small=5) == (2.5, sorted(i % 40 for i in range(500))[k - 1])


def test_weights_equal_plain_counts(spark, documents):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    texts = {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}

    def grams(text):
        tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", text.encode())
        tokens = [bytes(c + 32 if 65 <= c <= 90 else c for c in t) for t in tokens]
        return [*tokens, *zip(tokens, tokens[1:])]

    def bucket(gram):
        one = gram if isinstance(gram, bytes) else b" ".join(gram)
        return int(quality._grams(pa.array([one], pa.binary()).cast(pa.string(), safe=False))[0][-1])

    of = {g: bucket(g) for g in {g for t in texts.values() for g in grams(t)}}
    raw, target = [1] * quality.BUCKETS, [1] * quality.BUCKETS
    for i, t in texts.items():
        for g in grams(t):
            raw[of[g]] += 1
            target[of[g]] += i in good
    n_raw, n_target = sum(raw), sum(target)
    got = quality.resample(documents, quality.log_ratio(documents, labels)).collect()
    for r in got[:150]:
        own = [math.log(target[of[g]] / n_target) - math.log(raw[of[g]] / n_raw) for g in grams(texts[r.doc_id])]
        assert r.n_grams == len(own) and r.log_weight == pytest.approx(100 * sum(own) / max(1, len(own)), abs=1e-9)


# sketches

@pytest.mark.parametrize("buckets", [1, 5])
def test_versions(spark, odd, empty, buckets):
    rows = sorted(ROWS, key=lambda r: (-(r[0] if r[0] is not None else -10**9), r[1] or ""))
    got = by_id(sketches.compare_versions(odd, buckets=buckets), "doc_id", "n_chars", "edited_sha256")
    want = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        edited = t[:len(t) - len(t) // 2] + u[:len(t) // 2]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    full = sketches.compare_versions(odd, buckets=buckets).collect()
    prints = {}
    for r in full:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(r.doc_id, r.fingerprint)
    assert prints[4] == prints[5] and prints[2] == prints[3] and prints[1] == prints[6]
    assert [r.near_next for r in full if r.doc_id == 5] == [1.0]
    assert sketches.compare_versions(empty).count() == 0


def test_peeling_gives_the_exact_difference():
    import numpy as np
    import pyarrow as pa
    a = [" ".join(f"t{i}" for i in range(k)) for k in (0, 5, 400, 3000)]
    b = [" ".join(f"t{i + s}" for i in range(k)) for k, s in ((0, 0), (5, 50), (400, 30), (3000, 1000))]
    x, y = sketches.digests(pa.array(a)), sketches.digests(pa.array(b))
    want = []
    for r in range(4):
        p, q = set(x[0][x[1] == r].tolist()), set(y[0][y[1] == r].tolist())
        want.append(len(p & q) / len(p | q) if p | q else 1.0)
    assert np.allclose(sketches.likeness(x, y, 4, 2), want)
