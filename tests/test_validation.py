"""Rules that a plausible simplification would get wrong."""

import pytest

from millrace.operators.contracts import CONTRACTS
from millrace.operators.validation import ROW, drift_of, reason_rows, typed, validate, validate_batch

NOW = "2024-02-01 00:00:00"
FACTORY = {"factory_id": "FAC-001", "factory_name": "One", "country_code": "HU", "timezone": "Europe/Budapest", "opened_on": "2020-01-01", "status": "active", "updated_at": "2024-01-01T00:00:00Z"}
LINE = {"production_line_id": "LINE-001", "factory_id": "FAC-001", "line_name": "L", "product_family": "pump", "nominal_capacity_per_hour": "10", "status": "active", "updated_at": "2024-01-01T00:00:00+01:00"}
EVENT = {"downtime_event_id": "DWN-001", "machine_id": "MCH-001", "started_at": "2024-01-01T10:00:00Z", "ended_at": "2024-01-01T11:00:00Z", "downtime_type": "planned", "reason_code": "breakdown", "updated_at": "2024-01-01T12:00:00Z"}


def frame(spark, base, *changes, drop=()):
    rows = [{k: v for k, v in (base | c).items() if k not in drop} | {ROW: i + 2} for i, c in enumerate(changes)]
    columns = [*dict.fromkeys(k for r in rows for k in r if k != ROW), ROW]
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ", ".join(f"{c} {'long' if c == ROW else 'string'}" for c in columns))


def found(spark, source, base, *changes, drop=()):
    rows = reason_rows(validate(frame(spark, base, *changes, drop=drop), CONTRACTS[source], NOW)).collect()
    return sorted((r[ROW], r["code"], r["column_name"]) for r in rows)


def test_clean_rows_have_no_reason(spark):
    assert found(spark, "factories", FACTORY, {}, {"factory_id": "FAC-002"}) == []


def test_first_row_claims_its_key_even_if_rejected(spark):
    got = found(spark, "factories", FACTORY, {"status": "odd"}, {}, {"factory_id": None}, {"factory_id": None})
    assert got == [(2, "invalid_enum", "status"), (3, "duplicate_identifier", "factory_id"), (4, "required_value_missing", "factory_id"), (5, "required_value_missing", "factory_id")]


def test_stages_gate_but_keep_all_reasons_within(spark):
    got = found(spark, "factories", FACTORY, {"factory_id": "  ", "status": "odd"}, {"factory_name": None, "status": "odd"})
    assert got == [(2, "blank_value", "factory_id"), (2, "invalid_enum", "status"), (2, "invalid_identifier", "factory_id"), (3, "required_value_missing", "factory_name")]


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({"opened_on": "2024-02-30"}, "invalid_date"),
        ({"opened_on": "2024-02-02"}, "future_timestamp"),
        ({"opened_on": "2024-02-01"}, None),
        ({"updated_at": "2024-01-01T00:00:00"}, "invalid_timestamp"),
        ({"updated_at": "2024-02-01T00:05:00Z"}, None),
        ({"updated_at": "2024-02-01T00:05:01Z"}, "future_timestamp"),
        ({"updated_at": "2024-02-01T01:04:00+01:00"}, None),
        ({"factory_name": "a\0b"}, "invalid_text_encoding"),
        ({"factory_id": "fac-1"}, "invalid_identifier"),
    ],
)
def test_column_rules(spark, change, code):
    assert [c for _, c, _ in found(spark, "factories", FACTORY, change)] == ([code] if code else [])


def test_numbers(spark):
    got = found(spark, "production_lines", LINE, {"nominal_capacity_per_hour": "x"}, {"production_line_id": "LINE-002", "nominal_capacity_per_hour": "0"}, {"production_line_id": "LINE-003", "nominal_capacity_per_hour": "12.0"})
    assert [(r, c) for r, c, _ in got] == [(2, "invalid_type"), (3, "out_of_range"), (4, "invalid_type")]


def test_row_rules_skip_missing_and_unreadable_sides(spark):
    got = found(spark, "downtime_events", EVENT, {"ended_at": "2024-01-01T10:00:00Z"}, {"downtime_event_id": "DWN-002", "ended_at": None}, {"downtime_event_id": "DWN-003", "updated_at": "2024-01-01T09:00:00Z"})
    assert got == [(2, "invalid_timestamp_order", "started_at,ended_at"), (4, "invalid_timestamp_order", "started_at,updated_at")]


def test_missing_columns_and_drift(spark):
    df = frame(spark, EVENT, {}, drop=("ended_at",))
    header = [c for c in df.columns if c != ROW]
    assert drift_of(CONTRACTS["downtime_events"], header).kind == "breaking"
    assert reason_rows(validate(df, CONTRACTS["downtime_events"], NOW)).collect() == []
    assert drift_of(CONTRACTS["downtime_events"], [*EVENT, "extra"]).kind == "additive"
    got = found(spark, "downtime_events", EVENT, {}, {"downtime_event_id": "DWN-002"}, drop=("reason_code",))
    assert got == [(2, "missing_required_column", "reason_code"), (3, "missing_required_column", "reason_code")]


def test_rejected_parents_reject_children_and_absent_sources_all(spark):
    batch = {"factories": frame(spark, FACTORY, {"status": "odd"}, {"factory_id": "FAC-002"}), "production_lines": frame(spark, LINE, {}, {"production_line_id": "LINE-002", "factory_id": "FAC-002"})}
    batch["downtime_events"] = frame(spark, EVENT, {})
    out = validate_batch(batch, NOW)
    assert [r["code"] for r in reason_rows(out["production_lines"].rows).collect()] == ["referential_integrity_violation"]
    assert [r["code"] for r in reason_rows(out["downtime_events"].rows).collect()] == ["missing_parent_source"]
    assert out["factories"].quarantined.select("raw_payload").first()[0]["status"] == "odd"


def test_typed_values(spark):
    row = typed(validate(frame(spark, LINE, {}), CONTRACTS["production_lines"], NOW), CONTRACTS["production_lines"]).first()
    assert row["nominal_capacity_per_hour"] == 10 and str(row["updated_at"]) == "2023-12-31 23:00:00"
