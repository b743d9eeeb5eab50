"""SQL for whole texts: drafted orders and answers to questions. The labels are fixed values, as in the operators."""

from __future__ import annotations

from millwright.catalog import adapters as a
from millwright.catalog.operations_queries import ORACLES as OPERATIONS
from millwright.catalog.operations_queries import WORKFLOW
from millwright.catalog.sql import compose, define, near
from millwright.operators.questions import _TAGS
from millwright.plans.named_queries import NAMED_QUERIES

RULES = a.QUESTION_RULES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _half_up(expr: str, scale: int = 1) -> str:
    """Rounded half away from zero, as the formatter of the operators does."""
    return f"(sign({expr}) * floor(abs({expr}) * {scale} + 0.5) / {scale})"


# ---------------------------------------------------------------- drafts
_SIGNED = lambda c: f"printf('%+.1f', {_half_up(f'coalesce({c}, 0)', 10)})"
_WHOLE = lambda c: f"printf('%.0f', {_half_up(c)})"
define("draft_head_v", f"""
SELECT n.*, w.threshold_rule, concat_ws(chr(10) || chr(10),
    '**Asset:** ' || n.asset_id || ' (' || coalesce(n.asset_type, '') || ', line ' || coalesce(n.line_id, '') || ')',
    '**Trigger:** anomaly ' || n.anomaly_id || ': ' || coalesce(sensors, '') || '; vibration ' || {_SIGNED("n.vib_rise_pct")}
      || '% vs profile, temperature ' || {_SIGNED("n.temp_rise_c")} || ' °C, ' || duration_h || ' h so far (' || vib_shape || ')',
    '**Suspected failure mode:** ' || matched_failure_mode || ', matching ' || n.n_matches || ' past episode(s) on this asset',
    '**Failure window (ESTIMATE):** ' || {_WHOLE("n.eta_low_h")} || '–' || {_WHOLE("n.eta_high_h")} || ' h to threshold ('
      || coalesce(w.threshold_rule, 'failure-mode threshold') || ')') AS header
FROM active_v n LEFT JOIN windows_v w USING (anomaly_id)""")
define("draft_lines_v", f"""
SELECT anomaly_id, 0 AS block, 0::BIGINT AS nth, header AS line FROM draft_head_v
UNION ALL SELECT anomaly_id, 1, nth, line FROM active_v, (VALUES (0, ''), (1, '**Recommended action**')) t(nth, line)
UNION ALL SELECT anomaly_id, 2, 1, '1. ' || action_taken || '  [' || card_id || ']' FROM cited_v WHERE use = 'fix' AND rank = 1
UNION ALL SELECT anomaly_id, 2, rank, '   - Same fix applied before: ' || source_id || ' by '
  || coalesce(author_name, author_technician_id, 'unknown') || '  [' || card_id || ']'
FROM cited_v WHERE use = 'fix' AND rank BETWEEN 2 AND 1 + {WORKFLOW.similar_fixes}
UNION ALL SELECT anomaly_id, 2, 1, '1. No resolved fix on record for this pattern. Inspect and diagnose; capture findings in the closing note.'
FROM active_v WHERE anomaly_id NOT IN (SELECT anomaly_id FROM cited_v WHERE use = 'fix')
UNION ALL SELECT anomaly_id, 3, nth, line FROM (SELECT DISTINCT anomaly_id FROM cited_v WHERE use IN ('gotcha', 'recurred')),
  (VALUES (-2, ''), (-1, '**Do NOT**')) t(nth, line)
UNION ALL SELECT anomaly_id, 3, rank, '- ' || source_excerpt || '  [' || card_id || ']' FROM cited_v WHERE use = 'gotcha'
UNION ALL SELECT anomaly_id, 3, 100 + rank, '- Repeat ' || source_id || ': ' || outcome_basis || '  [' || card_id || ']' FROM cited_v WHERE use = 'recurred'
UNION ALL SELECT DISTINCT anomaly_id, 4, 0, '' FROM cited_v WHERE use = 'symptom'
UNION ALL SELECT anomaly_id, 4, rank, '**Known symptom pattern:** ' || source_excerpt || '  [' || card_id || ']' FROM cited_v WHERE use = 'symptom'
UNION ALL SELECT anomaly_id, 5, nth, line FROM active_v, (VALUES (0, ''), (1, '**Parts**')) t(nth, line)
UNION ALL SELECT anomaly_id, 6, row_number() OVER (PARTITION BY anomaly_id ORDER BY n_used DESC, part_id),
  CASE WHEN in_master THEN '- ' || part_id || ' (' || description || '): ' || stock_qty || ' in stock, reorder point ' || reorder_point
         || ', lead time ' || lead_time_days || ' d' || CASE WHEN at_risk THEN '  ⚠ AT RISK: reorder now' ELSE '' END
       ELSE '- ' || part_id || ': not in the spare-parts master' END
FROM risk_v WHERE anomaly_id IN (SELECT anomaly_id FROM active_v)
UNION ALL SELECT anomaly_id, 6, 1, '- none identified from past fixes' FROM active_v WHERE anomaly_id NOT IN (SELECT anomaly_id FROM risk_v)
UNION ALL SELECT anomaly_id, 7, 0, '' FROM active_v
UNION ALL SELECT anomaly_id, 8, 0, '**Suggested technician:** ' || coalesce(full_name, technician_id) || ' (' || technician_id || '), authored '
  || n_fixes || ' resolved fix(es) for this pattern'
  || CASE WHEN retiring_2027 THEN '; retiring 2027, pair with a junior to transfer knowledge' ELSE '' END
FROM author_v WHERE anomaly_id IN (SELECT anomaly_id FROM active_v)
UNION ALL SELECT anomaly_id, 9, nth, line FROM active_v, (VALUES (0, ''),
  (1, '_Drafted automatically. Status PENDING_APPROVAL: a human must approve before work starts._')) t(nth, line)""")
define("drafted_v", f"""
SELECT 'DRAFT-' || n.anomaly_id || '-1' AS draft_id, n.anomaly_id, n.asset_id, n.matched_failure_mode AS failure_mode, 'PENDING_APPROVAL' AS status,
       n.asset_id || ': ' || coalesce(lower(replace(n.matched_failure_mode, '_', ' ')), 'anomaly') || ', '
         || CASE WHEN n.anomaly_id IN (SELECT anomaly_id FROM cited_v WHERE use = 'fix') THEN 'planned repair' ELSE 'inspect' END AS title,
       b.body, t.technician_id AS recommended_technician_id, coalesce(p.parts, '') AS parts, coalesce(p.parts_at_risk, '') AS parts_at_risk,
       n.eta_low_h, n.eta_high_h, coalesce(c.ids, '') AS cited_card_ids, TIMESTAMP '2024-02-01 00:00:00' AS created_at,
       {_quoted(WORKFLOW.drafted_by)} AS created_by
FROM active_v n JOIN (SELECT anomaly_id, string_agg(line, chr(10) ORDER BY block, nth) AS body FROM draft_lines_v GROUP BY anomaly_id) b USING (anomaly_id)
LEFT JOIN author_v t USING (anomaly_id)
LEFT JOIN (SELECT anomaly_id, string_agg(part_id, ';' ORDER BY n_used DESC, part_id) AS parts,
                  string_agg(part_id, ';' ORDER BY n_used DESC, part_id) FILTER (WHERE at_risk) AS parts_at_risk
           FROM risk_v GROUP BY anomaly_id) p USING (anomaly_id)
LEFT JOIN (SELECT anomaly_id, string_agg(card_id, ',' ORDER BY CASE use WHEN 'fix' THEN 1 WHEN 'gotcha' THEN 2 WHEN 'recurred' THEN 3 ELSE 4 END, rank) AS ids
           FROM cited_v GROUP BY anomaly_id) c USING (anomaly_id)""")


# ---------------------------------------------------------------- answers from tables
#: Columns of the reports that questions can reach; those with a trailing ~ are printed with four decimals.
_REPORTS = {
    "oee_by_line_last_week": ("line_id avg_oee~ avg_availability~ avg_performance~ avg_quality~", "line_id", "line_id", None),
    "top_downtime_causes_this_month": ("failure_mode breakdowns downtime_min", "downtime_min DESC, failure_mode", None, None),
    "mttr_by_technician": ("technician corrective_jobs mttr_hours~", "mttr_hours, technician", None, None),
    "parts_at_risk_of_stockout": ("part_id description stock_qty reorder_point lead_time_days",
                                  "stock_qty - reorder_point, lead_time_days DESC, part_id", None, None),
    "lowest_oee_assets_last_week": ("asset_id line_id avg_oee~ downtime_min~", "avg_oee, asset_id, line_id", "line_id", "asset_id"),
}


def _report(name: str) -> str:
    columns, order, line, asset = _REPORTS[name]
    cells = " || ' | ' || ".join(
        f"coalesce({f'printf({_quoted('%.4f')}, {c[:-1]})' if c.endswith('~') else f'CAST({c} AS VARCHAR)'}, 'None')" for c in columns.split())
    names = columns.replace("~", "").split()
    head = f"**{NAMED_QUERIES[name].question}** (verified query `{name}`)\n\n| " + " | ".join(names) + " |\n|" + "---|" * len(names) + "\n"
    grains = [("NULL", "NULL")] + [(line, "NULL")] * bool(line) + [("NULL", asset)] * bool(asset) + [(line, asset)] * bool(line and asset)
    parts = " UNION ALL ".join(f"SELECT CAST({x} AS VARCHAR) AS line_id, CAST({y} AS VARCHAR) AS asset_id, row_number() OVER (PARTITION BY {x}, {y} ORDER BY {order}) AS nth, "
                               f"'| ' || {cells} || ' |' AS cells FROM report" for x, y in grains)
    return f"""
SELECT '{name}' AS query_name, line_id, asset_id, {_quoted(head)} || string_agg(cells, chr(10) ORDER BY nth) AS answer
FROM (WITH report AS ({OPERATIONS["vq_" + name]}) {parts}) WHERE nth <= {RULES.table_rows} GROUP BY line_id, asset_id"""


define("reports_v", " UNION ALL ".join(_report(name) for name, _ in RULES.keywords))
_LOOK = "LEFT JOIN reports_v {t} ON {t}.query_name = q.query_name AND {t}.line_id IS NOT DISTINCT FROM {line} AND {t}.asset_id IS NOT DISTINCT FROM {asset}"
_BY_LINE = "CASE WHEN l.answer IS NOT NULL THEN q.line_id END"
define("table_answer_v", f"""
SELECT qid, tool, coalesce(answer, {_quoted(RULES.cannot)}) AS answer, 'verified query: ' || query_name AS citations, answer IS NULL AS refused
FROM (SELECT q.*, coalesce(s.answer, l.answer, e.answer) AS answer FROM tools_v q
      {_LOOK.format(t="l", line="q.line_id", asset="NULL")} {_LOOK.format(t="s", line=_BY_LINE, asset="q.asset_id")}
      {_LOOK.format(t="e", line="NULL", asset="NULL")} WHERE q.tool = 'analyst')""")

# ---------------------------------------------------------------- answers from drafts and cards
define("draft_answer_v", f"""
SELECT q.qid, q.tool, coalesce('Drafted **' || d.draft_id || '** (' || d.title || '). It is PENDING_APPROVAL: a human must approve it.'
         || chr(10) || chr(10) || d.body, {_quoted(RULES.cannot + " There is no active anomaly to draft a work order for.")}) AS answer,
       coalesce(d.cited_card_ids, '') AS citations, d.draft_id IS NULL AS refused
FROM tools_v q LEFT JOIN (
  SELECT grain, arg_min(anomaly_id, (urgency, asset_id, anomaly_id)) AS anomaly_id
  FROM (SELECT NULL AS grain, * FROM active_v UNION ALL SELECT upper(asset_id), * FROM active_v) GROUP BY grain) g
  ON g.grain IS NOT DISTINCT FROM q.asset_id
LEFT JOIN drafted_v d ON d.anomaly_id = g.anomaly_id WHERE q.tool = 'draft'""")
_TAG = " ".join(f"WHEN card_type = '{kind}' THEN '{label}'" for kind, label in _TAGS.items())
define("card_answer_v", f"""
SELECT q.qid, q.tool, coalesce(f.answer, {_quoted(RULES.cannot)}) AS answer, coalesce(f.citations, '') AS citations, f.qid IS NULL AS refused
FROM tools_v q LEFT JOIN (
  SELECT qid, 'From the plant''s knowledge cards:' || chr(10) || chr(10) || string_agg('- **' || tag || '** (' || coalesce(asset_id, '-') || ', '
           || coalesce(author_name, author_technician_id, 'unknown') || '): "' || source_excerpt || '"  [' || card_id || ']', chr(10) ORDER BY nth)
         || coalesce(chr(10) || chr(10) || '⚠ Possibly stale (asset changed since): ' || string_agg(card_id, ', ' ORDER BY nth) FILTER (is_stale), '') AS answer,
         string_agg(card_id, ',' ORDER BY nth) AS citations
  FROM (SELECT *, CASE WHEN card_type = 'FIX' AND outcome = 'RECURRED' THEN 'Did NOT hold' {_TAG} ELSE card_type END AS tag,
               row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, card_id) AS nth FROM asked_v)
  WHERE nth <= 4 GROUP BY qid) f USING (qid)
WHERE q.tool = 'search'""")
_WHY = " Only maintenance, sensor and production data can be asked about; there are no judgements about people and no approvals here."

QUERIES: dict = {}
ORACLES = {
    "draft_orders": compose(f"""
SELECT * REPLACE ({near("eta_low_h")} AS eta_low_h, {near("eta_high_h")} AS eta_high_h), NULL::VARCHAR AS edited_by, NULL::VARCHAR AS approved_by,
       NULL::TIMESTAMP AS approved_at, NULL::VARCHAR AS rejected_reason, NULL::VARCHAR AS wo_id FROM drafted_v"""),
    "table_answers": compose("SELECT * FROM table_answer_v"),
    "answer_questions": compose(f"""
SELECT qid, tool, CASE tool WHEN 'guard' THEN {_quoted(RULES.cannot + _WHY)} ELSE {_quoted(RULES.cannot)} END AS answer, '' AS citations, true AS refused
FROM tools_v WHERE tool IN ('none', 'guard')
UNION ALL SELECT * FROM table_answer_v UNION ALL SELECT * FROM draft_answer_v UNION ALL SELECT * FROM card_answer_v"""),
}
