"""Card sources, extraction, recurrence, staleness, the card graph, search and recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.catalog import adapters as a
from millwright.catalog.sensor_queries import active_frame
from millwright.catalog.sql import compose, define, near
from millwright.functions.exprs import exploded, out
from millwright.functions.text import tokens as token_column
from millwright.operators import cards as cd
from millwright.operators import extraction as ex
from millwright.operators import retrieval as rt
from millwright.params import TokenRules
from millwright.session import staged

LEX = a.NOTE_LEXICON
RULES = TokenRules()
STAMP = "2026-01-01 00:00:00"
BY = "rules"


# ---------------------------------------------------------------- frames
def sources_frame(spark, sf):
    return ex.card_sources(a.orders_wo(spark, sf), a.notes(spark, sf))


def raw_frame(spark, sf, sources=None):
    sources = sources_frame(spark, sf) if sources is None else sources
    return ex.number_cards(ex.with_cards(sources, LEX), BY, STAMP)


def cards_frame(spark, sf):
    # Orders and changes are parsed from the events once; they are read five times below.
    orders, changes = staged(a.orders_wo(spark, sf), "orders"), staged(a.changes(spark, sf), "changes")
    sources = ex.card_sources(orders, a.notes(spark, sf))
    extracted = staged(ex.with_cards(sources, LEX).drop("source_text"), "extracted")  # texts are read and hashed once
    raw, keys = staged(ex.number_cards(extracted, BY, STAMP), "cards_raw"), extracted.drop("cards")
    fixing = cd.fixing_changes(changes, orders, a.CARD.fix_window_min)
    stale = cd.stale_cards(raw, keys, changes, fixing, a.CARD)
    recur = cd.recurrences(orders, a.CARD.recur_days)
    found = cd.cards(raw, keys, orders, a.technicians(spark, sf), recur, stale)
    return cd.with_search_text(staged(found.drop("search_text"), "cards"))


# ---------------------------------------------------------------- queries
def card_sources(spark, sf):
    return sources_frame(spark, sf)


def pending_sources(spark, sf):
    """Sources missing from a log that knows every third text."""
    sources = sources_frame(spark, sf)
    known = sources.filter(F.conv(F.substring("text_hash", 1, 4), 16, 10).cast("int") % 3 == 0)
    return ex.pending(sources, known).select("source_type", "source_id", "source_ts")


def pending_oldest(spark, sf):
    sources = sources_frame(spark, sf)
    known = sources.filter(F.conv(F.substring("text_hash", 1, 4), 16, 10).cast("int") % 3 == 0)
    return ex.pending(sources, known, 25).select("source_type", "source_id", "source_ts")


def sentences(spark, sf):
    return ex.sentences(a.notes(spark, sf), "note_text", "note_id")


def _card_rows(df):
    return df.drop("extracted_by", "extracted_at")


def note_cards(spark, sf):
    return _card_rows(raw_frame(spark, sf).filter(F.col("source_type") == "HANDOVER_NOTE"))


def wo_cards(spark, sf):
    return _card_rows(raw_frame(spark, sf).filter(F.col("source_type") == "WORK_ORDER"))


def extract_log(spark, sf):
    return ex.extract_log(ex.with_cards(sources_frame(spark, sf), LEX), BY, STAMP)


def _responses(spark, sf):
    """Orders and notes with the structured response a model could give; some are missing, some empty."""
    orders = a.orders_wo(spark, sf).select(
        F.lit("WORK_ORDER").alias("source_type"), F.col("wo_id").alias("source_id"), F.col("resolution_note").alias("body"),
        "asset_id", "failure_mode_code", "parts_used", F.col("downtime_min").cast("long").alias("n"))
    notes = a.notes(spark, sf).select(
        F.lit("HANDOVER_NOTE").alias("source_type"), F.col("note_id").alias("source_id"), F.col("note_text").alias("body"),
        F.length("note_text").cast("long").alias("n"))
    o = orders.unionByName(notes, allowMissingColumns=True)
    n = F.col("n")
    first = F.struct(F.lit("FIX").alias("card_type"), F.lit("").alias("asset_id"),
                     F.when(n % 2 == 0, "").otherwise("FMX").alias("failure_mode"),
                     F.col("body").alias("symptom_summary"), F.lit("swap").alias("action_taken"),
                     F.col("parts_used").alias("parts"), F.lit("RESOLVED").alias("outcome"),
                     F.substring("body", 1, 20).alias("source_excerpt"), F.lit(0.9).alias("confidence"))
    second = first.withField("card_type", F.lit("GOTCHA")).withField("asset_id", F.lit("press")).withField(
        "confidence", F.lit(0.5))
    some = F.when(n % 5 == 0, F.array(first, second)).when(n % 5 == 1, F.array(first).cast(
        "array<struct<card_type:string,asset_id:string,failure_mode:string,symptom_summary:string,"
        "action_taken:string,parts:string,outcome:string,source_excerpt:string,confidence:double>>")).otherwise(
        F.slice(F.array(first), 1, 0))
    return o.select("source_type", "source_id", F.md5("body").alias("text_hash"), "asset_id", "failure_mode_code",
                    F.when(n % 7 != 0, F.to_json(F.struct(some.alias("cards")))).alias("resp"))


def flatten_json(spark, sf):
    return _card_rows(ex.number_cards(ex.flatten_responses(_responses(spark, sf)), BY, STAMP))


def flatten_log(spark, sf):
    return ex.extract_log(ex.flatten_responses(_responses(spark, sf)), BY, STAMP).select(
        "source_type", "source_id", "text_hash", "n_cards")


def recurrences(spark, sf):
    return cd.recurrences(a.orders_wo(spark, sf), a.CARD.recur_days)


def fixing_changes(spark, sf):
    return cd.fixing_changes(a.changes(spark, sf), a.orders_wo(spark, sf), a.CARD.fix_window_min)


def stale_cards(spark, sf):
    sources = sources_frame(spark, sf)
    raw = raw_frame(spark, sf, sources)
    return cd.stale_cards(raw, sources, a.changes(spark, sf), fixing_changes(spark, sf), a.CARD)


def cards(spark, sf):
    return cards_frame(spark, sf)


def cards_where(spark, sf):
    return cd.cards_where(cards_frame(spark, sf), F.col("is_stale") & (F.col("card_type") == "GOTCHA")).select(
        "card_id", "asset_id", "created_at", "stale_reason")


def edges_about(spark, sf):
    return cd.edges_about(cards_frame(spark, sf))


def edges_contradicts(spark, sf):
    return cd.edges_contradicts(cards_frame(spark, sf))


def supersession_spans(spark, sf):
    return cd.supersession_spans(cards_frame(spark, sf))


def edges_supersedes(spark, sf):
    return cd.edges_supersedes(cards_frame(spark, sf))


def edges(spark, sf):
    return cd.edges(cards_frame(spark, sf))


def edges_for(spark, sf):
    """Edges of every recurred fix."""
    found = cards_frame(spark, sf)
    ids = found.filter(F.col("outcome") == "RECURRED").select(F.col("card_id").alias("id"))
    return cd.incident_edges(found, ids)


def tokens(spark, sf):
    return exploded(a.notes(spark, sf), token_column(F.col("note_text"), RULES), ["note_id"], "token", "pos")


def _docs(spark, sf):
    return rt.tokenised(a.notes(spark, sf), "note_text", RULES).select(F.col("note_id").alias("doc_id"), "note_type",
                                                                       "tokens")


def corpus_stats(spark, sf):
    df = rt.corpus_stats(_docs(spark, sf), "doc_id")
    return df.withColumn("avg_len", out(F.col("avg_len")))


def _searches(spark, sf):
    return rt.tokenised(a.search_queries(spark, sf), "query_text", RULES).select("query_id", "tokens")


def bm25_topk(spark, sf):
    hits = rt.bm25_topk(_searches(spark, sf), _docs(spark, sf), 10)
    return hits.withColumn("score", out(F.col("score")))


def search_filtered(spark, sf):
    """Search inside the documents that pass a nested filter; the corpus figures are those of the filtered part."""
    spec = {"@and": [{"@or": [{"@eq": {"note_type": "en"}}, {"@eq": {"note_type": "de"}}]},
                     {"@not": {"@eq": {"doc_id": "HN-000000000001"}}}]}
    docs = _docs(spark, sf).filter(rt.compile_filter(spec))
    return rt.bm25_topk(_searches(spark, sf), docs, 5).withColumn("score", out(F.col("score")))


def search_hydrated(spark, sf):
    hits = rt.bm25_topk(_searches(spark, sf), _docs(spark, sf), 3)
    named = a.notes(spark, sf).select(F.col("note_id").alias("doc_id"), "created_at", "author_technician_id")
    return rt.hydrate(hits, named, "doc_id").withColumn("score", out(F.col("score")))


def baseline_retrieve(spark, sf):
    hits = rt.baseline_retrieve(_searches(spark, sf), sources_frame(spark, sf), 3)
    return hits.withColumn("score", out(F.col("score")))


def _ranked(spark, sf):
    """All cards as hits of one query per asset (or none), in the order of a hash; every fourth card is listed twice."""
    hits = cards_frame(spark, sf).withColumn("query_id", F.coalesce("asset_id", F.lit("-"))).withColumn("mode", F.lit("FM1")).withColumn(
        "warn", F.length("asset_id") % 2 == 0)
    place = F.conv(F.substring(F.md5("card_id"), 1, 6), 16, 10).cast("bigint")
    once = hits.withColumn("position", place)
    again = hits.filter(place % 4 == 0).withColumn("position", place + 100)
    return rt.rank_cards(once.unionByName(again), "query_id", "mode", "warn")


def rank_cards(spark, sf):
    return _ranked(spark, sf).select("query_id", "card_id", "position", out(F.col("score")).alias("score"))


def top_cards(spark, sf):
    return rt.top(_ranked(spark, sf), ["query_id"], 20).select("query_id", "card_id", "rank")


def recall_frame(spark, sf):
    return rt.recall(active_frame(spark, sf), cards_frame(spark, sf))


def recall(spark, sf):
    return recall_frame(spark, sf).select("anomaly_id", "card_id", "role", "position",
                                          out(F.col("score")).alias("score"))


# ---------------------------------------------------------------- SQL
WS = r"[\s\p{Z}]"


def word(pattern: str) -> str:
    """A whole-word alternation for a regex engine whose own boundary is ASCII-only; the word is group 2."""
    return rf"(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_])({pattern})([^\p{{L}}\p{{M}}\p{{N}}_]|$)"


def any_of(expr: str, needles) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{n}')" for n in needles) + ")"


def mode_sql(expr: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(expr, ws)} THEN '{m}'" for m, ws in LEX.failure_modes) + " END"


def sentence_list(text: str) -> str:
    return (rf"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1)),"
            rf" lambda s: regexp_replace(s, '^{WS}+|{WS}+$', '', 'g')), lambda s: s <> '')")


define("sources_v", """
SELECT 'WORK_ORDER' AS source_type, wo_id AS source_id, asset_id, failure_mode_code, wo_type AS source_subtype,
       technician_id AS author_technician_id, closed_at AS source_ts, resolution_note AS source_text,
       md5(resolution_note) AS text_hash, parts_used
FROM orders_all_v WHERE status = 'CLOSED'
UNION ALL
SELECT 'HANDOVER_NOTE', note_id, NULL, NULL, note_type, author_technician_id, created_at, note_text, md5(note_text), NULL
FROM notes_v WHERE note_text IS NOT NULL""")
define("pending_v", """
SELECT source_type, source_id, source_ts FROM sources_v
WHERE CAST('0x' || substr(text_hash, 1, 4) AS INTEGER) % 3 <> 0""")
define("sentences_v", f"""
SELECT note_id, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS pos, unnest(ss) AS sentence
FROM (SELECT note_id, {sentence_list("note_text")} AS ss FROM notes_v)""")
_PATTERN_WORDS = "the|und|les|una"
define("note_sentences_v", f"""
SELECT *, last_value(mention IGNORE NULLS) OVER (PARTITION BY note_id ORDER BY pos) AS asset FROM (
  SELECT note_id, pos, sentence, lower(sentence) AS low,
         nullif(upper(regexp_extract(sentence, '{word(_PATTERN_WORDS)}', 2)), '') AS mention
  FROM sentences_v)""")
define("note_kinds_v", f"""
SELECT *, CASE WHEN {any_of("low", LEX.convention)} THEN 'CONVENTION' WHEN {any_of("low", LEX.gotcha)} THEN 'GOTCHA'
               WHEN {any_of("low", LEX.symptom)} AND mode IS NOT NULL THEN 'SYMPTOM_PATTERN'
               WHEN {any_of("low", LEX.fix)} AND mode IS NOT NULL THEN 'FIX' END AS card_type,
       {any_of("low", LEX.explicit_fix)} AS explicit, {any_of("low", LEX.recurred)} AS back
FROM (SELECT *, {mode_sql("low")} AS mode FROM note_sentences_v WHERE asset IS NOT NULL)""")
define("note_cards_v", """
SELECT 'HANDOVER_NOTE' AS source_type, k.note_id AS source_id, md5(n.note_text) AS text_hash,
       CAST(row_number() OVER (PARTITION BY k.note_id ORDER BY k.pos) AS INTEGER) AS card_seq, k.card_type,
       k.asset AS asset_id, k.mode AS failure_mode, substr(k.sentence, 1, 300) AS symptom_summary,
       substr(k.sentence, 1, 300) AS action_taken, NULL::VARCHAR AS parts,
       CASE WHEN k.card_type = 'FIX' AND k.explicit THEN 'RESOLVED' WHEN k.card_type = 'GOTCHA' AND k.back THEN 'RECURRED'
            ELSE 'UNKNOWN' END AS outcome,
       substr(k.sentence, 1, 220) AS source_excerpt,
       CAST(CASE k.card_type WHEN 'FIX' THEN CASE WHEN k.explicit THEN 0.95 ELSE 0.5 END WHEN 'GOTCHA' THEN 0.85
            ELSE 0.8 END AS DOUBLE) AS confidence
FROM note_kinds_v k JOIN notes_v n USING (note_id) WHERE k.card_type IS NOT NULL""")
define("wo_sentences_v", f"""
SELECT source_id, generate_subscripts(ss, 1) AS pos, unnest(ss) AS sentence
FROM (SELECT source_id, {sentence_list("source_text")} AS ss FROM sources_v WHERE source_type = 'WORK_ORDER')""")
define("wo_cards_v", f"""
SELECT 'WORK_ORDER' AS source_type, source_id, text_hash,
       CAST(row_number() OVER (PARTITION BY source_id ORDER BY pos) AS INTEGER) AS card_seq, card_type, asset_id, failure_mode,
       substr(symptom, 1, 300) AS symptom_summary, substr(body, 1, 300) AS action_taken, parts, outcome,
       substr(body, 1, 220) AS source_excerpt, confidence
FROM (
  SELECT source_id, text_hash, 0 AS pos, 'FIX' AS card_type, asset_id,
         coalesce(failure_mode_code, {mode_sql("lower(source_text)")}) AS failure_mode,
         coalesce(nullif(regexp_extract(source_text, '^[^.,;]*'), ''), source_text) AS symptom, source_text AS body,
         parts_used AS parts, 'RESOLVED' AS outcome, 0.9::DOUBLE AS confidence
  FROM sources_v WHERE source_type = 'WORK_ORDER' AND source_subtype = 'CORRECTIVE'
  UNION ALL
  SELECT s.source_id, o.text_hash, s.pos, 'GOTCHA', o.asset_id,
         coalesce(o.failure_mode_code, {mode_sql("lower(s.sentence)")}), s.sentence, s.sentence, NULL,
         CASE WHEN {any_of("lower(s.sentence)", LEX.recurred)} THEN 'RECURRED' ELSE 'UNKNOWN' END, 0.85
  FROM wo_sentences_v s JOIN sources_v o ON o.source_id = s.source_id AND o.source_type = 'WORK_ORDER'
  WHERE {any_of("lower(s.sentence)", LEX.gotcha)})""")
define("raw_v", "SELECT * FROM note_cards_v UNION ALL SELECT * FROM wo_cards_v")
define("recur_v", """
SELECT f.wo_id, min(g.wo_id) AS recurred_by_wo, min(date_diff('day', f.closed_at, g.reported_at)) AS recurred_after_days
FROM orders_v f JOIN orders_v g ON g.asset_id = f.asset_id AND g.failure_mode_code = f.failure_mode_code
 AND g.reported_at > f.closed_at AND g.reported_at <= f.closed_at + INTERVAL 14 DAY
GROUP BY f.wo_id""")
define("fixing_v", """
SELECT DISTINCT c.change_id FROM changes_v c JOIN orders_all_v o ON o.asset_id = c.asset_id
 AND abs(date_diff('minute', o.closed_at, c.changed_at)) <= 60""")
define("stale_v", """
SELECT r.source_type, r.source_id, r.card_seq, min(c.changed_at) AS first_change_at,
       min(c.description) AS change_description
FROM raw_v r JOIN sources_v s ON s.source_type = r.source_type AND s.source_id = r.source_id
JOIN changes_v c ON c.asset_id = r.asset_id AND c.changed_at > s.source_ts
WHERE r.card_type IN ('GOTCHA', 'CONVENTION') AND c.change_type IN ('PART_REPLACEMENT', 'FIRMWARE_UPDATE')
  AND NOT EXISTS (SELECT 1 FROM fixing_v f WHERE f.change_id = c.change_id)
GROUP BY ALL""")
define("cards_v", """
SELECT 'CARD-' || r.source_id || '-' || r.card_seq AS card_id, r.card_type, r.asset_id,
       coalesce(r.failure_mode, o.failure_mode_code) AS failure_mode, r.symptom_summary, r.action_taken,
       coalesce(r.parts, o.parts_used) AS parts,
       CASE WHEN r.card_type = 'FIX' AND q.wo_id IS NOT NULL THEN 'RECURRED' ELSE r.outcome END AS outcome,
       CASE WHEN r.card_type = 'FIX' AND q.wo_id IS NOT NULL
            THEN 'recurrence rule: ' || q.recurred_by_wo || ' re-opened the same failure after ' || q.recurred_after_days || ' days'
            ELSE 'stated in source' END AS outcome_basis,
       q.recurred_by_wo, s.author_technician_id, t.full_name AS author_name, r.source_type, r.source_id, r.source_excerpt,
       r.confidence, s.source_ts AS created_at, x.first_change_at IS NOT NULL AS is_stale,
       x.change_description AS stale_reason,
       coalesce(r.symptom_summary, '') || ' | ' || coalesce(r.action_taken, '') || ' | ' || coalesce(r.source_excerpt, '')
         AS search_text, 'rules' AS extracted_by
FROM raw_v r JOIN sources_v s ON s.source_type = r.source_type AND s.source_id = r.source_id AND s.text_hash = r.text_hash
LEFT JOIN orders_all_v o ON r.source_type = 'WORK_ORDER' AND o.wo_id = r.source_id
LEFT JOIN recur_v q ON r.source_type = 'WORK_ORDER' AND q.wo_id = r.source_id
LEFT JOIN technicians_v t ON t.technician_id = s.author_technician_id
LEFT JOIN stale_v x ON x.source_type = r.source_type AND x.source_id = r.source_id AND x.card_seq = r.card_seq""")
define("about_v", """
SELECT 'CARD' AS from_type, card_id AS from_id, 'ASSET' AS to_type, asset_id AS to_id, 'ABOUT_ASSET' AS relation
FROM cards_v WHERE asset_id IS NOT NULL
UNION ALL SELECT 'CARD', card_id, 'FAILURE_MODE', failure_mode, 'ABOUT_FAILURE_MODE' FROM cards_v WHERE failure_mode IS NOT NULL
UNION ALL SELECT 'CARD', card_id, 'TECHNICIAN', author_technician_id, 'AUTHORED_BY' FROM cards_v
WHERE author_technician_id IS NOT NULL""")
define("contradicts_v", """
SELECT 'CARD' AS from_type, n.card_id AS from_id, 'CARD' AS to_type, f.card_id AS to_id, 'CONTRADICTS' AS relation
FROM cards_v f JOIN cards_v n ON n.source_id = f.recurred_by_wo AND n.source_type = 'WORK_ORDER' AND n.card_type = 'FIX'
WHERE f.outcome = 'RECURRED' AND f.recurred_by_wo IS NOT NULL""")
define("supersedes_v", """
SELECT 'CARD' AS from_type, n.card_id AS from_id, 'CARD' AS to_type, f.card_id AS to_id, 'SUPERSEDES' AS relation
FROM cards_v f JOIN cards_v n ON n.asset_id = f.asset_id AND n.failure_mode = f.failure_mode AND n.created_at > f.created_at
WHERE f.outcome = 'RECURRED' AND f.card_type = 'FIX' AND f.recurred_by_wo IS NOT NULL
  AND n.card_type = 'FIX' AND n.outcome = 'RESOLVED' AND n.source_id <> f.recurred_by_wo""")
define("edges_v", "SELECT * FROM about_v UNION ALL SELECT * FROM contradicts_v UNION ALL SELECT * FROM supersedes_v")


def token_list(text: str) -> str:
    syn = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RULES.synonyms.items()) + " ELSE t END"
    cut = "CASE " + " ".join(f"WHEN ends_with(t, '{s}') AND length(t) > {len(s) + 3} THEN substr(t, 1, length(t) - {len(s)})"
                             for s in RULES.suffixes) + " ELSE t END"
    stop = ", ".join(f"'{w}'" for w in RULES.stop)
    return (rf"list_filter(list_transform(list_transform(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9][a-z0-9\-]*'),"
            f" lambda t: {syn}), lambda t: {cut}), lambda t: length(t) > 1 AND t NOT IN ({stop}))")


def bm25_sql(prefix: str, queries: str, docs: str, scoped: bool = False) -> str:
    """Define the fragments of one search; ``queries`` is (q, toks[, scope]), ``docs`` is (d, toks[, scope])."""
    on = ", scope" if scoped else ""
    join = " AND p.scope = w.scope" if scoped else ""
    define(f"{prefix}_q_v", queries)
    define(f"{prefix}_d_v", docs)
    define(f"{prefix}_tot_v", f"SELECT count(*) AS n_docs, avg(len(toks)) AS avg_len{on} FROM {prefix}_d_v GROUP BY ALL"
           if scoped else f"SELECT count(*) AS n_docs, avg(len(toks)) AS avg_len FROM {prefix}_d_v")
    define(f"{prefix}_post_v", f"""
SELECT d, dl, term, count(*) AS tf{on} FROM (SELECT d, len(toks) AS dl, unnest(toks) AS term{on} FROM {prefix}_d_v) GROUP BY ALL""")
    define(f"{prefix}_df_v", f"SELECT term, count(*) AS df{on} FROM {prefix}_post_v GROUP BY ALL")
    define(f"{prefix}_term_v", f"SELECT q, term, count(*) AS q_tf{on} FROM (SELECT q, unnest(toks) AS term{on} FROM {prefix}_q_v) GROUP BY ALL")
    tot = f"JOIN {prefix}_tot_v n ON n.scope = w.scope" if scoped else f"CROSS JOIN {prefix}_tot_v n"
    df = f"JOIN {prefix}_df_v f ON f.term = w.term" + (" AND f.scope = w.scope" if scoped else "")
    define(f"{prefix}_score_v", f"""
SELECT w.q, p.d, sum(w.q_tf * ln(1 + (n.n_docs - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) * p.tf * (1.4::DOUBLE + 1)
         / (p.tf + 1.4::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * p.dl / n.avg_len))) AS score
FROM {prefix}_term_v w {tot} {df} JOIN {prefix}_post_v p ON p.term = w.term{join} GROUP BY ALL""")
    define(f"{prefix}_hit_v", f"""
SELECT q, d, score, CAST(row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, d) - 1 AS INTEGER) AS position
FROM {prefix}_score_v WHERE score > 0""")
    return f"{prefix}_hit_v"


_Q = f"SELECT item_id AS q, {token_list('text')} AS toks FROM benchmark"
_D = f"SELECT note_id AS d, {token_list('note_text')} AS toks FROM notes_v"
bm25_sql("search", _Q, _D)
bm25_sql("filtered", _Q, _D + " WHERE note_type IN ('en', 'de') AND note_id <> 'HN-000000000001'")
bm25_sql("plain", _Q, f"SELECT source_id AS d, {token_list('source_text')} AS toks FROM sources_v")
bm25_sql(
    "recall",
    "SELECT anomaly_id AS q, asset_id AS scope, " + token_list(
        "asset_id || ' ' || sensors || ' rising ' || lower(replace(coalesce(matched_failure_mode, ''), '_', ' ')) || ' fix what worked'")
    + " AS toks FROM active_v",
    "SELECT card_id AS d, asset_id AS scope, " + token_list(
        "search_text || ' ' || replace(coalesce(failure_mode, ''), '_', ' ')") + " AS toks FROM cards_v WHERE asset_id IS NOT NULL",
    scoped=True)


def score_sql(mode: str, warn: str, position: str) -> str:
    return f"""(CASE card_type WHEN 'FIX' THEN 3.0 WHEN 'GOTCHA' THEN 2.6 WHEN 'SYMPTOM_PATTERN' THEN 2.0 ELSE 1.0 END)::DOUBLE
         * coalesce(nullif(confidence, 0), 0.5)
         * CASE WHEN card_type = 'FIX' AND outcome = 'RECURRED' THEN 0.6 ELSE 1 END::DOUBLE * CASE WHEN is_stale THEN 0.5 ELSE 1 END::DOUBLE
         + CASE WHEN {warn} AND (card_type = 'GOTCHA' OR card_type = 'FIX' AND outcome = 'RECURRED') THEN 3 ELSE 0 END
         + CASE WHEN failure_mode = {mode} THEN 1 ELSE 0 END + 1.0::DOUBLE / (1 + {position})"""


define("ranked_v", f"""
SELECT *, {score_sql("'FM1'", "length(asset_id) % 2 = 0", "position")} AS score FROM (
  SELECT *, coalesce(asset_id, '-') AS query_id, place + CASE WHEN place % 4 = 0 THEN 100 ELSE 0 END AS position FROM (
    SELECT *, CAST('0x' || substr(md5(card_id), 1, 6) AS BIGINT) AS place FROM cards_v))""")
define("recall_list_v", """
SELECT anomaly_id, card_id, max(position) AS position FROM (
  SELECT q AS anomaly_id, d AS card_id, position FROM recall_hit_v WHERE position < 15
  UNION ALL
  SELECT n.anomaly_id, n.card_id, n.nth - 1 + coalesce(h.n_hits, 0) FROM (
    SELECT a.anomaly_id, c.card_id, row_number() OVER (PARTITION BY a.anomaly_id ORDER BY c.created_at, c.card_id) AS nth
    FROM active_v a JOIN cards_v c ON c.asset_id = a.asset_id AND c.failure_mode = a.matched_failure_mode) n
  LEFT JOIN (SELECT q, count(*) AS n_hits FROM recall_hit_v WHERE position < 15 GROUP BY q) h ON h.q = n.anomaly_id)
GROUP BY ALL""")
define("recall_all_v", f"""
SELECT *, {score_sql("matched", "false", "position")} AS score,
       CASE WHEN card_type = 'FIX' AND outcome = 'RESOLVED' THEN 'fix'
            WHEN card_type = 'GOTCHA' OR card_type = 'FIX' AND outcome = 'RECURRED' THEN 'gotcha'
            WHEN card_type = 'SYMPTOM_PATTERN' THEN 'symptom' END AS role
FROM (SELECT r.anomaly_id, r.position, a.matched_failure_mode AS matched, c.* FROM recall_list_v r JOIN cards_v c USING (card_id)
      JOIN active_v a ON a.anomaly_id = r.anomaly_id)""")

QUERIES = {f.__name__: f for f in (
    card_sources, pending_sources, pending_oldest, sentences, note_cards, wo_cards, extract_log, flatten_json, flatten_log,
    recurrences, fixing_changes, stale_cards, cards, cards_where, edges_about, edges_contradicts, supersession_spans,
    edges_supersedes, edges, edges_for, tokens, corpus_stats, bm25_topk, search_filtered, search_hydrated,
    baseline_retrieve, rank_cards, top_cards, recall)}

_RESP = """
SELECT 'WORK_ORDER' AS source_type, wo_id AS source_id, md5(resolution_note) AS text_hash, asset_id, failure_mode_code,
       resolution_note AS body, parts_used, downtime_min AS n FROM orders_all_v WHERE downtime_min % 7 <> 0
UNION ALL
SELECT 'HANDOVER_NOTE', note_id, md5(note_text), NULL, NULL, note_text, NULL, length(note_text)
FROM notes_v WHERE length(note_text) % 7 <> 0"""
_FLAT = f"""
SELECT source_type, source_id, text_hash, card_seq, CASE card_seq WHEN 1 THEN 'FIX' ELSE 'GOTCHA' END AS card_type,
       CASE card_seq WHEN 1 THEN asset_id ELSE 'press' END AS asset_id,
       CASE WHEN n % 2 = 0 THEN failure_mode_code ELSE 'FMX' END AS failure_mode, body AS symptom_summary,
       'swap' AS action_taken, parts_used AS parts, 'RESOLVED' AS outcome, substr(body, 1, 20) AS source_excerpt,
       CASE card_seq WHEN 1 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence
FROM ({_RESP}), (VALUES (1), (2)) AS v(card_seq) WHERE (n % 5 = 0) OR (n % 5 = 1 AND card_seq = 1)"""
ORACLES = {
    "card_sources": compose("SELECT * FROM sources_v"),
    "pending_sources": compose("SELECT * FROM pending_v"),
    "pending_oldest": compose("SELECT * FROM pending_v ORDER BY source_ts, source_id LIMIT 25"),
    "sentences": compose("SELECT * FROM sentences_v"),
    "note_cards": compose("SELECT * FROM note_cards_v"),
    "wo_cards": compose("SELECT * FROM wo_cards_v"),
    "extract_log": compose("""
SELECT s.source_type, s.source_id, s.text_hash, CAST(count(r.card_seq) AS INTEGER) AS n_cards, 'rules' AS extracted_by,
       TIMESTAMP '2026-01-01 00:00:00' AS extracted_at
FROM sources_v s LEFT JOIN raw_v r ON r.source_type = s.source_type AND r.source_id = s.source_id GROUP BY ALL"""),
    "flatten_json": compose(_FLAT),
    "flatten_log": compose(f"""
SELECT source_type, source_id, text_hash,
       CAST(CASE n % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS n_cards FROM ({_RESP})"""),
    "recurrences": compose("SELECT * FROM recur_v"),
    "fixing_changes": compose("SELECT * FROM fixing_v"),
    "stale_cards": compose("SELECT * FROM stale_v"),
    "cards": compose("SELECT * FROM cards_v"),
    "cards_where": compose("""
SELECT card_id, asset_id, created_at, stale_reason FROM cards_v WHERE is_stale AND card_type = 'GOTCHA'"""),
    "edges_about": compose("SELECT * FROM about_v"),
    "edges_contradicts": compose("SELECT * FROM contradicts_v"),
    "supersession_spans": compose("""
SELECT * FROM (
  SELECT f.card_id, f.asset_id, f.failure_mode, count(*) FILTER (WHERE n.created_at <= f.created_at) + 1 AS first_no,
         count(*) AS last_no, f.recurred_by_wo AS except_source
  FROM cards_v f JOIN cards_v n ON n.asset_id = f.asset_id AND n.failure_mode = f.failure_mode
  WHERE f.outcome = 'RECURRED' AND f.card_type = 'FIX' AND f.recurred_by_wo IS NOT NULL
    AND n.card_type = 'FIX' AND n.outcome = 'RESOLVED'
  GROUP BY ALL) WHERE first_no <= last_no"""),
    "edges_supersedes": compose("SELECT * FROM supersedes_v"),
    "edges": compose("SELECT * FROM edges_v"),
    "edges_for": compose("""
SELECT * FROM (SELECT * FROM about_v UNION ALL SELECT * FROM contradicts_v UNION ALL SELECT * FROM supersedes_v)
WHERE from_id IN (SELECT card_id FROM cards_v WHERE outcome = 'RECURRED')
   OR to_id IN (SELECT card_id FROM cards_v WHERE outcome = 'RECURRED')"""),
    "tokens": compose(f"""
SELECT note_id, CAST(generate_subscripts(ts, 1) - 1 AS INTEGER) AS pos, unnest(ts) AS token
FROM (SELECT note_id, {token_list('note_text')} AS ts FROM notes_v)"""),
    "corpus_stats": compose(f"""
SELECT f.term, f.df, n.n_docs, {near('n.avg_len')} AS avg_len FROM search_df_v f CROSS JOIN search_tot_v n"""),
    "bm25_topk": compose(f"""
SELECT q AS query_id, d AS doc_id, {near('score')} AS score, position FROM search_hit_v WHERE position < 10"""),
    "search_filtered": compose(f"""
SELECT q AS query_id, d AS doc_id, {near('score')} AS score, position FROM filtered_hit_v WHERE position < 5"""),
    "search_hydrated": compose(f"""
SELECT q AS query_id, d AS doc_id, {near('score')} AS score, position, created_at, author_technician_id
FROM search_hit_v JOIN notes_v ON note_id = d WHERE position < 3"""),
    "baseline_retrieve": compose(f"""
SELECT q AS query_id, d AS source_id, {near('score')} AS score, position FROM plain_hit_v WHERE position < 3"""),
    "rank_cards": compose(f"SELECT query_id, card_id, position, {near('score')} AS score FROM ranked_v"),
    "top_cards": compose("""
SELECT query_id, card_id, CAST(nth AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, card_id) AS nth FROM ranked_v)
WHERE nth <= 20"""),
    "recall": compose(f"SELECT anomaly_id, card_id, role, position, {near('score')} AS score FROM recall_all_v"),
}
