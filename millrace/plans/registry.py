"""All registered queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.domain import AS_OF, raw_tables
from . import oracles
from .models import STAGING, Models

Query = Callable[[SparkSession, str], DataFrame]


def models(spark: SparkSession, sf_dir: str) -> Models:
    return Models(raw_tables(spark, sf_dir), AS_OF)


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that results compare with other engines."""
    return df.select(*(F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes))


#: Query name to the model it returns.
MODEL_QUERIES = {
    "machine_context": "int_machine_context",
    "downtime_durations": "int_downtime_durations",
    "failure_intervals": "int_machine_failure_intervals",
    "inspection_defects": "int_inspection_defects",
    "order_performance": "int_order_performance",
    "telemetry_enriched": "int_machine_telemetry",
    "dim_factory": "dim_factory",
    "dim_production_line": "dim_production_line",
    "dim_machine": "dim_machine",
    "telemetry_daily": "fct_machine_telemetry_daily",
    "factory_performance": "factory_performance",
    "machine_reliability": "machine_reliability",
    "maintenance_backlog": "maintenance_backlog",
    "downtime_by_reason": "downtime_by_reason",
    "inspection_outcomes": "inspection_outcomes",
    "data_freshness": "data_freshness",
}


#: Sums and means of doubles, whose last digits depend on the order of rows: queries round them.
ROUNDED = {
    "telemetry_daily": ("average_temperature_c", "average_vibration_mm_s", "p95_vibration_mm_s", "average_pressure_bar"),
    "factory_performance": ("downtime_hours", "unplanned_downtime_hours"),
    "machine_reliability": ("mean_time_to_repair_hours", "mean_time_between_failures_hours", "total_downtime_hours", "unplanned_downtime_hours"),
    "downtime_by_reason": ("downtime_hours", "average_event_hours"),
}


def _model(name: str, attribute: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = plain(getattr(models(spark, sf_dir), attribute))
        return df.withColumns({c: F.round(c, 6) for c in ROUNDED.get(name, ())}) if name in ROUNDED else df

    return run


def _staged(source: str) -> Query:
    return lambda spark, sf_dir: plain(models(spark, sf_dir).stg(source))


def queries() -> dict[str, Query]:
    from . import registry_tables

    return {k: _model(k, v) for k, v in MODEL_QUERIES.items()} | {f"stg_{s}": _staged(s) for s in STAGING} | registry_tables.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import registry_tables

    rounded = lambda k: f"REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in ROUNDED[k])})" if k in ROUNDED else ""
    out = {k: oracles.sql(f"SELECT * {rounded(k)} FROM {k}") for k in MODEL_QUERIES}
    for s, columns in STAGING.items():
        doubles = ", ".join(f"{c}::DOUBLE AS {c}" for c, t in columns.items() if t.startswith("decimal"))
        out[f"stg_{s}"] = oracles.sql(f"SELECT * {f'REPLACE ({doubles})' if doubles else ''} FROM {s}")
    return out | {k: oracles.sql(v) for k, v in registry_tables.SQL.items()}
