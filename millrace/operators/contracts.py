"""Source contracts: what kind each column is of, and named predicates over columns that say what may be wrong with a row.

A predicate sees a row's cells as text and as values, and the clock; `validation` evaluates those of one stage together. Nullability,
bounds and orders of times are predicates like any others, so a contract takes further ones as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the format of identifiers.
IDENTIFIER = r"^[A-Z][A-Z0-9-]{2,63}$"
#: How far a timestamp may lie ahead of the clock; dates may not at all.
TOLERANCE_MINUTES = 5
#: Stages of predicates: a row that fails in one isn't asked those of the next.
PRESENCE, CELL, ROW = range(3)


class Cells(Protocol):
    """A row as predicates see it: a value is null where the text can't be read as the column's kind."""

    now: Column

    def text(self, name: str) -> Column: ...

    def value(self, name: str) -> Column: ...


@dataclass(frozen=True)
class Predicate:
    """Something wrong with a row: `broken` says of its cells whether it is (null: it isn't). Predicates of stage CELL are only asked of
    cells that are given."""

    stage: int
    code: str
    check: str
    columns: tuple[str, ...]
    message: str
    broken: Callable[[Cells], Column]


#: What makes a predicate for the column of a name.
Test = Callable[[str], Predicate]


def cell(code: str, check: str, message: str, broken: Callable[[Cells, str], Column], stage: int = CELL) -> Test:
    """A test of one column; `{}` in the message is its name."""
    return lambda name: Predicate(stage, code, check, (name,), message.format(name), lambda cells: broken(cells, name))


def across(code: str, columns: tuple[str, ...], message: str, broken: Callable[[Cells], Column]) -> Predicate:
    """Something wrong between columns of a row."""
    return Predicate(ROW, code, "row_rule", columns, message, broken)


given = cell("required_value_missing", "not_null", "{} is required", lambda c, n: c.text(n).isNull(), PRESENCE)
_not_blank = cell("blank_value", "not_blank", "{} must not be blank", lambda c, n: F.trim(F.regexp_replace(c.text(n), r"\s", " ")) == "")
_no_nul = cell("invalid_text_encoding", "no_nul", "{} must not hold a NUL character", lambda c, n: F.instr(c.text(n), "\0") > 0)


def _unreadable(code: str, check: str, message: str) -> Test:
    return cell(code, check, message, lambda c, n: c.value(n).isNull())


#: What every column of a kind is asked.
KINDS: dict[str, tuple[Test, ...]] = {
    "string": (_not_blank, _no_nul),
    "integer": (_unreadable("invalid_type", "type", "{} must be of type integer"),),
    "number": (_unreadable("invalid_type", "type", "{} must be of type number"),),
    "date": (_not_blank, _no_nul, _unreadable("invalid_date", "iso_date", "{} must be an ISO 8601 date")),
    "timestamp": (_not_blank, _no_nul, _unreadable("invalid_timestamp", "iso_timestamp", "{} must be an ISO 8601 timestamp with an offset")),
}


def among(*values: str) -> Test:
    return cell("invalid_enum", "accepted_values", f"{{}} must be one of {', '.join(values)}", lambda c, n: ~c.text(n).isin(*values))


def between(low: float, high: float) -> Test:
    return cell("out_of_range", "accepted_range", f"{{}} must lie from {low:g} to {high:g}", lambda c, n: ~c.value(n).between(low, high))


def _future(latest: Callable[[Column], Column]) -> Test:
    return cell("future_timestamp", "not_in_future", "{} must not lie in the future", lambda c, n: c.value(n) > latest(c.now))


identifier = cell("invalid_identifier", "identifier_format", "{} must be an upper-case identifier", lambda c, n: ~c.text(n).rlike(IDENTIFIER))
past_day = _future(lambda now: now.cast("date"))
past_moment = _future(lambda now: now + F.expr(f"INTERVAL '{TOLERANCE_MINUTES}' MINUTE"))

#: A column: its kind and its tests beside those of the kind.
Declared = tuple[str, tuple[Test, ...]]
ID: Declared = ("string", (given, identifier))
TEXT: Declared = ("string", (given,))
PAST: Declared = ("timestamp", (given, past_moment))
OPTIONAL_PAST: Declared = ("timestamp", (past_moment,))
ANY_TIME: Declared = ("timestamp", (given,))
DAY: Declared = ("date", (given, past_day))


def one_of(*values: str) -> Declared:
    return "string", (given, among(*values))


def whole(low: int, high: int) -> Declared:
    return "integer", (given, between(low, high))


def number(low: float, high: float) -> Declared:
    return "number", (given, between(low, high))


class Contract:
    """A source's columns, the first of them its key, the predicates of its rows, and the columns that name accepted rows of a parent."""

    version = "1.0.0"

    def __init__(self, source: str, columns: dict[str, Declared], parents: dict[str, str] | None = None, *more: Predicate) -> None:
        self.source, self.parents = source, parents or {}
        self.kinds = {name: kind for name, (kind, _) in columns.items()}
        self.columns = tuple(columns)
        self.key = self.columns[0]
        self.predicates = (*(test(name) for name, (kind, tests) in columns.items() for test in (*KINDS[kind], *tests)), *more)
        self.required = tuple(p.columns[0] for p in self.predicates if p.stage == PRESENCE)


def in_order(earlier: str, later: str, strict: bool = False) -> Predicate:
    """`later` must not precede (strict: must follow) `earlier`; a missing or unreadable side breaks nothing."""
    relation = "must be after" if strict else "must not precede"
    late = lambda c: c.value(later) <= c.value(earlier) if strict else c.value(later) < c.value(earlier)
    return across("invalid_timestamp_order", (earlier, later), f"{later} {relation} {earlier}", late)


BOTH_OR_NEITHER = across(
    "incomplete_timestamp_pair",
    ("actual_start_at", "actual_end_at"),
    "actual_start_at and actual_end_at must be given together",
    lambda c: c.text("actual_start_at").isNull() != c.text("actual_end_at").isNull(),
)
TOTALS = across(
    "inspection_total_mismatch",
    ("sample_size", "passed_units", "failed_units"),
    "passed_units and failed_units must add up to sample_size",
    lambda c: c.value("passed_units") + c.value("failed_units") != c.value("sample_size"),
)
RESULT = across(
    "inspection_result_mismatch",
    ("result", "failed_units"),
    "result must be pass if no unit failed, else fail",
    lambda c: c.text("result") != F.when(c.value("failed_units") == 0, "pass").when(c.value("failed_units").isNotNull(), "fail"),
)

_ALL = [
    Contract(
        "factories",
        {
            "factory_id": ID,
            "factory_name": TEXT,
            "country_code": one_of("HU", "DE", "CZ"),
            "timezone": one_of("Europe/Budapest", "Europe/Berlin", "Europe/Prague"),
            "opened_on": DAY,
            "status": one_of("active", "inactive"),
            "updated_at": PAST,
        },
    ),
    Contract(
        "production_lines",
        {
            "production_line_id": ID,
            "factory_id": ID,
            "line_name": TEXT,
            "product_family": one_of("motor", "pump", "gearbox"),
            "nominal_capacity_per_hour": whole(1, 10_000),
            "status": one_of("active", "inactive"),
            "updated_at": PAST,
        },
        {"factory_id": "factories"},
    ),
    Contract(
        "machines",
        {
            "machine_id": ID,
            "production_line_id": ID,
            "machine_name": TEXT,
            "machine_type": one_of("cnc", "press", "robot", "welder", "inspection"),
            "manufacturer": TEXT,
            "model": TEXT,
            "installed_on": DAY,
            "status": one_of("active", "maintenance", "retired"),
            "updated_at": PAST,
        },
        {"production_line_id": "production_lines"},
    ),
    Contract(
        "shifts",
        {
            "shift_id": ID,
            "factory_id": ID,
            "shift_name": one_of("morning", "afternoon", "night"),
            "started_at": PAST,
            "ended_at": PAST,
            "operator_id": ID,
            "updated_at": PAST,
        },
        {"factory_id": "factories"},
        in_order("started_at", "ended_at", strict=True), in_order("ended_at", "updated_at"),
    ),
    Contract(
        "production_orders",
        {
            "production_order_id": ID,
            "production_line_id": ID,
            "product_code": ID,
            "planned_start_at": ANY_TIME,
            "planned_end_at": ANY_TIME,
            "actual_start_at": OPTIONAL_PAST,
            "actual_end_at": OPTIONAL_PAST,
            "planned_quantity": whole(1, 1_000_000),
            "actual_quantity": whole(0, 1_000_000),
            "status": one_of("planned", "in_progress", "completed", "cancelled"),
            "updated_at": PAST,
        },
        {"production_line_id": "production_lines"},
        in_order("planned_start_at", "planned_end_at", strict=True), BOTH_OR_NEITHER, in_order("actual_start_at", "actual_end_at"),
    ),
    Contract(
        "machine_telemetry",
        {
            "telemetry_id": ID,
            "machine_id": ID,
            "event_timestamp": PAST,
            "temperature_c": number(-40, 180),
            "vibration_mm_s": number(0, 50),
            "pressure_bar": number(0, 500),
            "energy_kwh": number(0, 100_000),
            "operating_state": one_of("running", "idle", "stopped"),
            "updated_at": PAST,
        },
        {"machine_id": "machines"},
        in_order("event_timestamp", "updated_at"),
    ),
    Contract(
        "downtime_events",
        {
            "downtime_event_id": ID,
            "machine_id": ID,
            "started_at": PAST,
            "ended_at": OPTIONAL_PAST,
            "downtime_type": one_of("planned", "unplanned"),
            "reason_code": one_of("maintenance", "breakdown", "changeover", "material_shortage"),
            "updated_at": PAST,
        },
        {"machine_id": "machines"},
        in_order("started_at", "ended_at", strict=True), in_order("started_at", "updated_at"),
    ),
    Contract(
        "maintenance_work_orders",
        {
            "maintenance_work_order_id": ID,
            "machine_id": ID,
            "created_at": PAST,
            "scheduled_for": ANY_TIME,
            "completed_at": OPTIONAL_PAST,
            "maintenance_type": one_of("preventive", "corrective", "inspection"),
            "priority": one_of("low", "medium", "high", "critical"),
            "status": one_of("open", "in_progress", "completed", "cancelled"),
            "technician_id": ID,
            "updated_at": PAST,
        },
        {"machine_id": "machines"},
        in_order("created_at", "completed_at"), in_order("created_at", "updated_at"),
    ),
    Contract(
        "quality_inspections",
        {
            "quality_inspection_id": ID,
            "production_order_id": ID,
            "inspected_at": PAST,
            "sample_size": whole(1, 1_000_000),
            "passed_units": whole(0, 1_000_000),
            "failed_units": whole(0, 1_000_000),
            "result": one_of("pass", "fail"),
            "inspector_id": ID,
            "updated_at": PAST,
        },
        {"production_order_id": "production_orders"},
        TOTALS, RESULT, in_order("inspected_at", "updated_at"),
    ),
    Contract(
        "product_defects",
        {
            "product_defect_id": ID,
            "quality_inspection_id": ID,
            "detected_at": PAST,
            "defect_type": one_of("dimensional", "surface", "assembly", "material", "functional"),
            "severity": one_of("minor", "major", "critical"),
            "defect_count": whole(1, 1_000_000),
            "updated_at": PAST,
        },
        {"quality_inspection_id": "quality_inspections"},
        in_order("detected_at", "updated_at"),
    ),
]

#: All contracts by source, parents before children.
CONTRACTS = {c.source: c for c in _ALL}
