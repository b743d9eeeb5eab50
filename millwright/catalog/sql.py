"""Named SQL fragments for the equivalent queries, and their assembly into one WITH statement."""

from __future__ import annotations

import re

FRAGMENTS: dict[str, str] = {}


def define(name: str, sql: str) -> None:
    FRAGMENTS[name] = sql.strip()


def compose(select: str) -> str:
    """Prefix a SELECT with every fragment it mentions, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"\bf_?[a-z_]*|\b[a-z][a-z_0-9]*", text):
            if word in FRAGMENTS and word not in order:
                visit(FRAGMENTS[word])
                if word not in order:
                    order.append(word)

    visit(select)
    if not order:
        return select.strip()
    return "WITH " + ",\n".join(f"{n} AS (\n{FRAGMENTS[n]}\n)" for n in order) + "\n" + select.strip()


def rounded(*names: str, digits: int = 4) -> str:
    return ", ".join(f"{near(n, digits)} AS {n}" for n in names)


def near(expr: str, digits: int = 4) -> str:
    """The same two-step rounding as functions.exprs.out."""
    return f"round(round({expr}, 9), {digits})"


# Adapter frames. Names end in _v so that they never collide with columns.
define("readings_v", """
SELECT event_type AS asset_id, ts, value AS vibration_rms,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS temperature_c,
       CASE WHEN event_type IN ('click', 'error') THEN 100.0::DOUBLE + user_id % 20 END AS pressure_bar,
       value AS current_a
FROM events""")
define("event_assets_v", """
SELECT DISTINCT event_type AS asset_id, 'Asset ' || event_type AS asset_name, upper(event_type) AS asset_type,
       'L' || CAST(length(event_type) % 3 + 1 AS VARCHAR) AS line_id, 'A' AS criticality
FROM events""")
define("production_v", """
SELECT l_suppkey AS asset_id, l_returnflag AS line_id, CAST(l_shipdate AS DATE) AS shift_date,
       10 * l_quantity AS planned_time_min, 10 * l_quantity * (1 - l_discount) AS run_time_min,
       10 * l_quantity * l_discount AS downtime_min, 1.5::DOUBLE AS ideal_cycle_time_s,
       6 * l_quantity AS total_count, 6 * l_quantity * (1 - l_tax) AS good_count
FROM lineitem""")
define("assets_v", """
SELECT s_suppkey AS asset_id, s_name AS asset_name, n_name AS asset_type
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
define("events_k_v", """
SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
define("orders_all_v", """
SELECT 'WO-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS wo_id, event_type AS asset_id,
       CASE WHEN value >= 150 THEN 'CORRECTIVE' ELSE 'PREVENTIVE' END AS wo_type,
       CASE WHEN k % 8 <> 0 THEN 'FM' || CAST(k % 4 AS VARCHAR) END AS failure_mode_code,
       ts AS reported_at, ts + to_minutes(30 + k) AS closed_at, 30 + k AS downtime_min,
       'T' || CAST(user_id % 8 AS VARCHAR) AS technician_id,
       CAST(user_id % 50 AS VARCHAR) || ':2;' || CAST(k AS VARCHAR) AS parts_used,
       event_type || ' stopped; part ' || CAST(k AS VARCHAR) || ' replaced. '
         || CASE WHEN k % 3 = 0 THEN 'Dont reuse part ' || CAST(k AS VARCHAR) || ', it came back. '
                 WHEN k % 3 = 1 THEN 'Never skip the check. ' ELSE '' END || 'Trial run ok.' AS resolution_note,
       CASE WHEN k % 20 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS status
FROM events_k_v WHERE value >= 130""")
define("orders_v", "SELECT * FROM orders_all_v WHERE wo_type = 'CORRECTIVE'")
define("technicians_v", """
SELECT 'T' || CAST(c_custkey AS VARCHAR) AS technician_id, c_name AS full_name, c_mktsegment AS seniority,
       c_custkey % 4 = 0 AS retiring_2027
FROM customer""")
define("changes_v", """
SELECT 'CH-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS change_id, event_type AS asset_id, ts AS changed_at,
       CASE k % 3 WHEN 0 THEN 'LUBRICANT_CHANGE' WHEN 1 THEN 'FIRMWARE_UPDATE'
            ELSE 'PART_REPLACEMENT' END AS change_type,
       'change ' || CAST(event_id AS VARCHAR) AS description
FROM events_k_v WHERE value < 5""")
define("parts_v", """
SELECT CAST(p_partkey AS VARCHAR) AS part_id, p_name AS description, CAST(p_size AS BIGINT) AS stock_qty,
       p_partkey % 25 AS reorder_point, p_partkey % 45 AS lead_time_days
FROM part""")
define("notes_v", """
SELECT 'HN-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS note_id,
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at, lang AS note_type,
       'T' || substr(source, 4, 9) AS author_technician_id, text AS note_text
FROM documents""")
