"""The operators over the test tables, each with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm import (decontaminate, exact_dedup, line_dedup, mixing, prefix_trie, quality, repair, secret_scan, simhash,
                            sketches, substring_dedup, toxicity, warc)
from millwright.llm.common import load


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest_spans(secret_scan.find_secrets(load(spark, sf_dir, "documents")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(load(spark, sf_dir, "documents")).drop("source").withColumn("target", F.round("target", 6))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return line_dedup.remove_repeated_lines(docs.select("doc_id", "text")).select(
        "doc_id", F.coalesce(F.size(F.split(F.col("text"), "\n", -1)), F.lit(0)).cast("long").alias("kept_lines"),
        F.col("removed_lines").cast("long").alias("removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_duplicate_passages(load(spark, sf_dir, "documents")).drop("kept_text")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality.resample(docs, quality.log_ratio(docs, load(spark, sf_dir, "labels")))


def op10_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compare_versions(load(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal normalised texts of ``documents``, every row with the one that stays for it."""
    return exact_dedup.exact_duplicates(load(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of the rebuilt ``conversations``."""
    return prefix_trie.prefix_trie(load(spark, sf_dir, "conversations"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage, faults, cheapest edits and repaired text of each of ``conversations``."""
    return repair.repair_damaged(load(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_warc, op3_toxicity, op4_mixing, op5_simhash, op6_decontaminate,
                                   op7_line_dedup, op8_substring_dedup, op9_quality, op10_sketches, op11_exact_dedup,
                                   op12_prefix_trie, op13_repair)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans_sql(kind: int, rule: secret_scan.Rule) -> str:
    """Spans of one rule: matches alternate with the parts between them, so lengths add up to positions."""
    pattern = _quoted(rule.pattern)
    group = f"regexp_extract_all(t, {pattern}, {rule.group})"
    return f"""
SELECT doc_id, {kind} AS nr, '{rule.kind}' AS kind,
       list_sum([length(x) FOR x IN parts[1:i]]) + coalesce(list_sum([length(x) FOR x IN hits[1:i - 1]]), 0) AS lo,
       length(hits[i]) AS n
FROM (SELECT doc_id, hits, parts, wanted, unnest(range(1, len(hits) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(t, {pattern}) AS hits, {group} AS wanted,
                   string_split_regex(t, {pattern}) AS parts FROM texts))
WHERE length(wanted[i]) >= {rule.least}"""


_RULES = secret_scan.BASE + secret_scan.MORE
_BASE_KINDS = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE)
_JOINED = "coalesce(string_agg(kind || ':' || lo || ':' || lo + n, ',' ORDER BY lo, nr){}, '')"
_SECRETS = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_spans_sql(i, r) for i, r in enumerate(_RULES))}),
per AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE)},
               {_JOINED.format(f" FILTER (kind IN ({_BASE_KINDS}))")} AS base, {_JOINED.format("")} AS spans
        FROM found GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN per USING (doc_id)"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {at}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)"
    for at in range(1, 41, 5) for s in (15, 10, 5, 0))
_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, strlen(body) AS payload_bytes, {_BASE32} AS payload_digest,
             min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM q"""

_WORDS_RE = r"[^\x20\x09-\x0D]+"
_MIX = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS_RE}')) AS size,
         greatest(0.25::DOUBLE, 1.0::DOUBLE - 10.0::DOUBLE * (length(coalesce(text, ''))
           - length(translate(coalesce(text, ''), '{mixing.SYMBOLS}', ''))) / greatest(length(coalesce(text, '')), 1)) AS w,
         (('0x' || substr(md5(doc_id::VARCHAR || ':7'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size,
             [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::DOUBLE AS weight
      FROM d GROUP BY source),
r AS (
  SELECT 0 AS turn, source, source_size, weight, false AS capped, (SELECT sum(source_size) FROM s) AS total FROM s
  UNION ALL
  SELECT turn + 1, source, source_size, weight,
         capped OR weight * (total - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0))
                   / sum(weight) FILTER (NOT capped) OVER () > 3 * source_size, total
  FROM r WHERE turn < (SELECT count(*) FROM s)),
t AS (SELECT source, source_size, CASE WHEN capped THEN 3 * source_size
             ELSE weight * (total - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0))
                  / sum(weight) FILTER (NOT capped) OVER () END AS target
      FROM r WHERE turn = (SELECT count(*) FROM s)),
k AS (SELECT doc_id, size, source_size::BIGINT AS source_size, target,
             CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS epochs,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / w, doc_id, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
       (epochs * size + greatest(0, least(size, round(target - epochs * source_size) - prefix)))::BIGINT AS taken
FROM k"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
b AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS phrase
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, win.n, item_id FROM spot JOIN win ON spot.phrase = win.phrase AND spot.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

_LINES = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
           FROM documents),
p AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM l),
m AS (SELECT *, min((doc_id, i)) OVER (PARTITION BY line, after) AS first_at,
             min((doc_id, i)) OVER (PARTITION BY line) AS first_single FROM p),
c AS (SELECT *, after IS NOT NULL AND first_at < (doc_id, i) AS copy,
             first_single < (doc_id, i) AND len(regexp_extract_all(line, '{_WORDS_RE}')) >= 13 AS passage FROM m),
g AS (SELECT *, copy OR passage OR coalesce(lag(copy) OVER (PARTITION BY doc_id ORDER BY i), false) AS gone FROM c),
o AS (SELECT doc_id, count(*) FILTER (gone) AS removed_lines, count(*) FILTER (NOT gone) AS kept,
             string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS text FROM g GROUP BY doc_id)
SELECT doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE greatest(1, coalesce(kept, 0)) END AS kept_lines,
       coalesce(removed_lines, 0) AS removed_lines, sha256(coalesce(o.text, '')) AS kept_sha256
FROM documents d LEFT JOIN o USING (doc_id)"""

_PASSAGES = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS_RE}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS phrase
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
dup AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY phrase) AS first_id FROM win)
        WHERE first_id < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM dup),
l AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
o AS (SELECT l.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY l.i) FILTER (gone.i IS NULL) AS kept
      FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)"""

_EXACT = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d"""

ORACLES = {"op1_secret_scan": _SECRETS, "op2_warc": _WARC, "op4_mixing": _MIX, "op6_decontaminate": _CONTAMINATION,
           "op7_line_dedup": _LINES, "op8_substring_dedup": _PASSAGES,
           "op11_exact_dedup": _EXACT}
