"""Fixed schemas of the landing tables and of the stored derived tables, as Spark DDL."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"STRING": T.StringType(), "BIGINT": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(),
          "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP_NTZ": T.TimestampNTZType(),
          "DECIMAL(6,1)": T.DecimalType(6, 1)}

_DDL = {
    # Landing tables.
    "assets": "asset_id STRING, asset_name STRING, asset_type STRING, line_id STRING, install_date DATE, "
              "firmware_version STRING, model STRING, ideal_cycle_time_s DECIMAL(6,1), criticality STRING",
    "failure_modes": "failure_mode_id STRING, code STRING, name STRING, applicable_asset_types STRING, "
                     "primary_sensors STRING, signature_description STRING, threshold_rule STRING, "
                     "typical_precursor_h BIGINT",
    "technicians": "technician_id STRING, full_name STRING, seniority STRING, years_experience BIGINT, "
                   "skills STRING, shift_pattern STRING, retiring_2027 BOOLEAN",
    "spare_parts": "part_id STRING, description STRING, asset_types STRING, stock_qty BIGINT, "
                   "reorder_point BIGINT, lead_time_days BIGINT, unit_cost_inr BIGINT",
    "asset_changes": "change_id STRING, asset_id STRING, changed_at TIMESTAMP_NTZ, change_type STRING, "
                     "description STRING",
    "work_orders": "wo_id STRING, asset_id STRING, wo_type STRING, priority STRING, failure_mode_code STRING, "
                   "reported_at TIMESTAMP_NTZ, started_at TIMESTAMP_NTZ, closed_at TIMESTAMP_NTZ, "
                   "downtime_min BIGINT, technician_id STRING, parts_used STRING, resolution_note STRING, "
                   "status STRING",
    "handover_notes": "note_id STRING, created_at TIMESTAMP_NTZ, shift_date DATE, shift STRING, note_type STRING, "
                      "line_id STRING, author_technician_id STRING, note_text STRING",
    "production_log": "asset_id STRING, line_id STRING, shift_date DATE, shift STRING, planned_time_min BIGINT, "
                      "run_time_min BIGINT, downtime_min BIGINT, ideal_cycle_time_s DECIMAL(6,1), "
                      "total_count BIGINT, good_count BIGINT",
    "sensor_readings": "asset_id STRING, ts TIMESTAMP_NTZ, vibration_rms DOUBLE, temperature_c DOUBLE, "
                       "pressure_bar DOUBLE, current_a DOUBLE",
    # Stored derived tables.
    "sensor_hourly": "asset_id STRING, hr TIMESTAMP_NTZ, vib DOUBLE, temp DOUBLE, pres DOUBLE, curr DOUBLE, "
                     "curr_cv DOUBLE, pres_cv DOUBLE, n_readings BIGINT",
    "anomaly_hours": "asset_id STRING, island BIGINT, hr TIMESTAMP_NTZ, start_hr TIMESTAMP_NTZ, age_h BIGINT, "
                     "vib_resid_pct DOUBLE, temp_resid_c DOUBLE, pres_resid_pct DOUBLE, curr_resid_pct DOUBLE, "
                     "curr_noise_x DOUBLE, pres_noise_x DOUBLE, f_vib_up BOOLEAN, f_temp_up BOOLEAN, "
                     "f_pres_down BOOLEAN, f_curr_up BOOLEAN, f_curr_noisy BOOLEAN, f_pres_noisy BOOLEAN",
    "card_sources": "source_type STRING, source_id STRING, asset_id STRING, failure_mode_code STRING, "
                    "source_subtype STRING, author_technician_id STRING, source_ts TIMESTAMP_NTZ, "
                    "source_text STRING, text_hash STRING",
    "cards_raw": "source_type STRING, source_id STRING, text_hash STRING, card_seq INT, card_type STRING, "
                 "asset_id STRING, failure_mode STRING, symptom_summary STRING, action_taken STRING, "
                 "parts STRING, outcome STRING, source_excerpt STRING, confidence DOUBLE, extracted_by STRING, "
                 "extracted_at TIMESTAMP_NTZ",
    "card_extract_log": "source_type STRING, source_id STRING, text_hash STRING, n_cards INT, "
                        "extracted_by STRING, extracted_at TIMESTAMP_NTZ",
    "drafts": "draft_id STRING, anomaly_id STRING, asset_id STRING, failure_mode STRING, status STRING, "
              "title STRING, body STRING, recommended_technician_id STRING, parts STRING, parts_at_risk STRING, "
              "eta_low_h DOUBLE, eta_high_h DOUBLE, cited_card_ids STRING, created_at TIMESTAMP_NTZ, "
              "created_by STRING, edited_by STRING, approved_by STRING, approved_at TIMESTAMP_NTZ, "
              "rejected_reason STRING, wo_id STRING",
    "workflow_events": "event_id BIGINT, event_ts TIMESTAMP_NTZ, kind STRING, draft_id STRING, wo_id STRING, "
                       "actor STRING, body STRING, reason STRING, technician_id STRING, repair_h DOUBLE",
    "edges": "from_type STRING, from_id STRING, to_type STRING, to_id STRING, relation STRING",
}



def _struct(columns: str) -> T.StructType:
    pairs = [c.split(" ") for c in columns.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SCHEMAS: dict[str, T.StructType] = {name: _struct(ddl) for name, ddl in _DDL.items()}

RAW_TABLES = ("assets", "failure_modes", "technicians", "spare_parts", "asset_changes", "work_orders",
              "handover_notes", "production_log", "sensor_readings")

PRIMARY_KEYS = {
    "assets": ["asset_id"],
    "failure_modes": ["failure_mode_id"],
    "technicians": ["technician_id"],
    "spare_parts": ["part_id"],
    "asset_changes": ["change_id"],
    "work_orders": ["wo_id"],
    "handover_notes": ["note_id"],
    "production_log": ["asset_id", "shift_date", "shift"],
}

# Shape of a structured extraction response: {"cards": [...]}.
RESPONSE_DDL = ("cards ARRAY<STRUCT<card_type: STRING, asset_id: STRING, failure_mode: STRING, "
                "symptom_summary: STRING, action_taken: STRING, parts: STRING, outcome: STRING, "
                "source_excerpt: STRING, confidence: DOUBLE>>")
