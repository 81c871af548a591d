"""The model graph: which model reads which, and the tests declared on each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.checks import Rule
from .models import STAGING

#: Model, its kind of storage, and what it reads.
GRAPH = {f"stg_{s}": ("view", [f"source:raw.{s}"]) for s in STAGING} | {
    "int_machine_context": ("view", ["stg_machines", "stg_production_lines", "stg_factories"]),
    "int_downtime_durations": ("view", ["stg_downtime_events", "int_machine_context"]),
    "int_machine_failure_intervals": ("view", ["int_downtime_durations"]),
    "int_inspection_defects": ("view", ["stg_quality_inspections", "stg_production_orders", "stg_production_lines", "stg_product_defects"]),
    "int_order_performance": ("view", ["stg_production_orders", "stg_production_lines", "stg_factories"]),
    "int_machine_telemetry": ("incremental", ["stg_machine_telemetry", "int_machine_context"]),
    "dim_factory": ("table", ["stg_factories"]),
    "dim_production_line": ("table", ["stg_production_lines", "stg_factories"]),
    "dim_machine": ("table", ["int_machine_context"]),
    "fct_downtime": ("table", ["int_downtime_durations"]),
    "fct_production_output": ("table", ["int_order_performance"]),
    "fct_quality_inspections": ("table", ["int_inspection_defects"]),
    "fct_machine_telemetry_daily": ("table", ["int_machine_telemetry"]),
    "factory_performance": ("table", ["dim_factory", "fct_production_output", "fct_quality_inspections", "fct_downtime"]),
    "machine_reliability": ("table", ["dim_machine", "int_machine_failure_intervals", "fct_downtime", "fct_machine_telemetry_daily"]),
    "maintenance_backlog": ("table", ["stg_maintenance_work_orders", "int_machine_context"]),
    "downtime_by_reason": ("table", ["fct_downtime"]),
    "inspection_outcomes": ("table", ["fct_quality_inspections", "dim_factory"]),
    "data_freshness": ("table", [f"stg_{s}" for s in STAGING]),
    "data_quality_trends": ("table", ["source:observability.quality_results"]),
    "machine_history": ("snapshot", ["stg_machines"]),
}
KEYS = {s: next(iter(c)) for s, c in STAGING.items()}
PARENTS = {
    "production_lines": ("factory_id", "factories"),
    "machines": ("production_line_id", "production_lines"),
    "shifts": ("factory_id", "factories"),
    "production_orders": ("production_line_id", "production_lines"),
    "machine_telemetry": ("machine_id", "machines"),
    "downtime_events": ("machine_id", "machines"),
    "maintenance_work_orders": ("machine_id", "machines"),
    "quality_inspections": ("production_order_id", "production_orders"),
    "product_defects": ("quality_inspection_id", "quality_inspections"),
}


LINEAGE = ("_batch_id", "_source_file_id", "_source_row_number", "_ingested_at", "_record_checksum")
#: Tests of models beside their keys (each not null and unique): columns that are not null, those never below zero, and references.
TESTED = {
    "int_machine_context": ("machine_id", ["factory_id"], [], {}),
    "int_machine_telemetry": ("telemetry_id", [], [], {}),
    "int_order_performance": ("production_order_id", [], [], {}),
    "int_downtime_durations": ("downtime_event_id", [], ["downtime_minutes"], {}),
    "int_machine_failure_intervals": ("downtime_event_id", [], [], {}),
    "int_inspection_defects": ("quality_inspection_id", [], [], {}),
    "dim_factory": ("factory_id", [], [], {}),
    "dim_production_line": ("production_line_id", [], [], {"factory_id": "dim_factory"}),
    "dim_machine": ("machine_id", [], [], {"production_line_id": "dim_production_line"}),
    "fct_production_output": ("production_order_id", ["_source_file_id"], ["planned_quantity", "actual_quantity"], {}),
    "fct_downtime": ("downtime_event_id", [], ["downtime_minutes"], {}),
    "fct_quality_inspections": ("quality_inspection_id", [], [], {}),
    "fct_machine_telemetry_daily": (None, [], [], {"machine_id": "dim_machine"}),
    "factory_performance": ("factory_id", [], ["unplanned_downtime_hours"], {}),
    "machine_reliability": ("machine_id", [], ["resolved_breakdown_count"], {}),
    "maintenance_backlog": ("maintenance_work_order_id", [], ["backlog_age_days"], {}),
    "downtime_by_reason": (None, [], ["downtime_hours"], {}),
    "data_freshness": ("source_name", [], [], {}),
    "data_quality_trends": (None, [], ["failed_check_count", "error_check_count"], {}),
    "machine_history": (None, ["machine_id", "valid_from"], [], {}),
}
#: Of raw and staged tables beside keys and parents.
RAW_NOT_NULL = {"factories": ["factory_name"], "machines": ["updated_at"], "machine_telemetry": ["event_timestamp"]}
STAGED_NOT_NULL = {"factories": ["_source_file_id"], "machines": ["updated_at"], "machine_telemetry": ["event_timestamp"]}
STAGED_NOT_NEGATIVE = {"production_orders": ["planned_quantity", "actual_quantity"], "quality_inspections": ["failed_units"], "product_defects": ["defect_count"]}


def rules() -> list[Rule]:
    """The declared tests: 91 of raw tables, 31 of staged ones, 14 of intermediate models, 34 of dimensions, facts and marts, 2 of the
    history, and 2 of single statements."""
    out = []

    def add(model: str, key: str | None, filled: list[str], positive: list[str], parents: dict[str, tuple[str, str]]) -> None:
        out.extend(Rule("not_null", model, c) for c in [*([key] if key else []), *filled])
        out.extend(Rule("unique", model, c) for c in [key] if c)
        out.extend(Rule("non_negative", model, c) for c in positive)
        out.extend(Rule("relationships", model, c, parent=p) for c, p in parents.items())

    for s, key in KEYS.items():
        c, parent = PARENTS.get(s, (None, None))
        add(f"raw_{s}", key, [*LINEAGE, *RAW_NOT_NULL.get(s, []), *([c] if c else [])], [], {c: (f"raw_{parent}", KEYS[parent])} if c else {})
        above = {c: (f"stg_{parent}", KEYS[parent])} if s in ("production_lines", "machines") else {}
        add(f"stg_{s}", key, STAGED_NOT_NULL.get(s, []), STAGED_NOT_NEGATIVE.get(s, []), above)
    for model, (key, filled, positive, parents) in TESTED.items():
        add(model, key, filled, positive, {c: (p, c) for c, p in parents.items()})
    return out + [
        Rule("end_after_start", "stg_shifts", "ended_at", other="started_at"),
        Rule("end_after_start", "stg_downtime_events", "ended_at", other="started_at"),
        Rule("accepted_values", "data_freshness", "freshness_status", values=("missing", "fresh", "warning", "stale")),
        Rule("plan_overrun", "fct_production_output", "actual_quantity", other="planned_quantity"),
        Rule("counts_reconcile", "fct_quality_inspections", "sample_size"),
    ]


def edges(spark: SparkSession) -> DataFrame:
    """(parent, child) of the model graph."""
    return spark.createDataFrame([(p, m) for m, (_, parents) in GRAPH.items() for p in parents], "parent string, child string")


def ancestors() -> dict[str, list[str]]:
    """What each model reads, directly or over others, sources by the names of their raw tables; made once from the graph."""
    out: dict[str, set[str]] = {}
    for model, (_, parents) in GRAPH.items():  # parents come first
        names = [p.replace("source:raw.", "raw_") for p in parents]
        out[model] = {*names, *(a for p in names for a in out.get(p, ()))}
    return {m: sorted(a) for m, a in out.items()}


#: What people and services read, by the models each depends on.
EXPOSURES = {
    "operations_dashboard": ["factory_performance", "machine_reliability", "data_freshness", "data_quality_trends"],
    "operational_api": ["fct_production_output", "factory_performance", "machine_reliability", "maintenance_backlog", "downtime_by_reason", "inspection_outcomes", "data_freshness"],
    "context_surface": ["fct_production_output", "factory_performance", "machine_reliability", "data_quality_trends"],
}


def edges_with_exposures(spark: SparkSession) -> DataFrame:
    """(parent, child) of the graph and of what is exposed, for the question of what a failure affects."""
    return edges(spark).unionByName(spark.createDataFrame([(p, e) for e, parents in EXPOSURES.items() for p in parents], "parent string, child string"))


def catalogue(spark: SparkSession) -> DataFrame:
    """(model_name, materialization, depends_on) of every model."""
    return spark.createDataFrame([(m, kind, p) for m, (kind, p) in GRAPH.items()], "model_name string, materialization string, depends_on array<string>")


def to_rebuild(spark: SparkSession, names: list[str]) -> list[str]:
    """The models named and all below them, parents first."""
    from ..operators.observability import downstream

    below = {r[0] for r in downstream(edges(spark), spark.createDataFrame([(n,) for n in names], "node string")).collect()}
    return [m for m in GRAPH if m in below or m in names]


def model_columns(spark: SparkSession, models: dict[str, DataFrame]) -> DataFrame:
    """(model_name, column_name, data_type, ordinal_position, tests) of built models, from their schemas and the declared tests."""
    tests: dict[tuple[str, str], list[str]] = {}
    for r in rules():
        tests.setdefault((r.model, r.column), []).append(r.kind)
    rows = [(m, c, t, i + 1, sorted(tests.get((m, c), []))) for m, df in models.items() for i, (c, t) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "model_name string, column_name string, data_type string, ordinal_position int, tests array<string>")
