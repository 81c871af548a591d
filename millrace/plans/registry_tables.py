"""Queries of contracts, checks, table maintenance and observability, over tables that Spark derives from the driver's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import at, record_checksum
from ..operators import checks as C
from ..operators import ledger as L
from ..operators import observability as O
from ..operators import tables as T
from ..operators.contracts import CONTRACTS
from ..operators.validation import ROW, reason_rows, typed, validate, validate_batch, with_parents
from ..sources.domain import AS_OF, raw_tables
from .graph import KEYS, PARENTS
from .models import Models
from .oracles import AS_OF as SQL_AS_OF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return raw_tables(spark, sf_dir)[name]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# --- contracts, on source files with planted faults -------------------------------------------------------------------------------


def dirty_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as a file's text, with a fault in every row whose key a certain number divides."""
    e = F.col("event_id")
    text = lambda c: c.cast("string")
    ident = F.concat(F.lit("TEL-"), F.lpad(text(F.when(e % 107 == 0, F.greatest(e - 1, F.lit(0))).otherwise(e)), 9, "0"))
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return _events(spark, sf_dir).select(
        (e + 2).alias(ROW),
        F.when(e % 101 == 0, F.lit(None)).when(e % 103 == 0, "bad id").otherwise(ident).alias("telemetry_id"),
        F.when(e % 109 == 0, "MCH-999999").otherwise(F.concat(F.lit("MCH-"), F.lpad(text(F.col("user_id")), 6, "0"))).alias("machine_id"),
        F.when(e % 113 == 0, time).when(e % 127 == 0, "2100-01-01T00:00:00Z").otherwise(F.concat(time, F.lit("Z"))).alias("event_timestamp"),
        F.when(e % 131 == 0, "abc").when(e % 137 == 0, "999").otherwise(text(e % 180)).alias("temperature_c"),
        text(e % 50).alias("vibration_mm_s"),
        text(e % 500).alias("pressure_bar"),
        text(e % 1000).alias("energy_kwh"),
        F.when(e % 139 == 0, "broken").when(e % 149 == 0, "  ").otherwise("running").alias("operating_state"),
        F.when(e % 151 == 0, "2023-01-01T00:00:00+01:00").otherwise(F.date_format(F.col("ts") + F.expr("INTERVAL '1' HOUR"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("updated_at"),
    )


_DIRTY = """dirty AS (SELECT event_id + 2 AS r, event_id AS e, CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 103 = 0 THEN 'bad id'
    WHEN event_id % 107 = 0 THEN greatest(event_id - 1, 0)::VARCHAR ELSE event_id::VARCHAR END AS k, user_id FROM events),
  a AS (SELECT *, k IS NULL AS missing, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY r) > 1 AS again FROM dirty),
  b AS (SELECT *, NOT missing AND NOT again AS go FROM a),
  reasons AS (
    SELECT r, 'required_value_missing' AS code, 'telemetry_id' AS column_name FROM b WHERE missing
    UNION ALL SELECT r, 'duplicate_identifier', 'telemetry_id' FROM b WHERE again
    UNION ALL SELECT r, 'invalid_identifier', 'telemetry_id' FROM b WHERE go AND k = 'bad id'
    UNION ALL SELECT r, 'invalid_timestamp', 'event_timestamp' FROM b WHERE go AND e % 113 = 0
    UNION ALL SELECT r, 'future_timestamp', 'event_timestamp' FROM b WHERE go AND e % 127 = 0 AND e % 113 <> 0
    UNION ALL SELECT r, 'invalid_type', 'temperature_c' FROM b WHERE go AND e % 131 = 0
    UNION ALL SELECT r, 'out_of_range', 'temperature_c' FROM b WHERE go AND e % 137 = 0 AND e % 131 <> 0
    UNION ALL SELECT r, 'invalid_enum', 'operating_state' FROM b WHERE go AND (e % 139 = 0 OR e % 149 = 0)
    UNION ALL SELECT r, 'blank_value', 'operating_state' FROM b WHERE go AND e % 149 = 0 AND e % 139 <> 0),
  ordered AS (SELECT * FROM reasons UNION ALL SELECT r, 'invalid_timestamp_order', 'event_timestamp,updated_at' FROM b
    WHERE go AND e % 151 = 0 AND NOT EXISTS (SELECT 1 FROM reasons WHERE reasons.r = b.r)),
  parented AS (SELECT * FROM ordered UNION ALL SELECT r, 'referential_integrity_violation', 'machine_id' FROM b
    WHERE go AND (e % 109 = 0 OR user_id NOT IN (SELECT c_custkey FROM customer)) AND NOT EXISTS (SELECT 1 FROM ordered WHERE ordered.r = b.r))"""


def _validated_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = CONTRACTS["machine_telemetry"]
    rows = validate(dirty_telemetry(spark, sf_dir), contract, AS_OF)
    return with_parents(rows, contract, {"machines": _raw(spark, sf_dir, "machines").select("machine_id")})


def _with_dirty(select: str) -> str:
    """A query over the planted faults; they come as further common table expressions."""
    return f"SELECT * FROM (WITH {_DIRTY} {select})"


@query(_with_dirty("SELECT r AS _source_row_number, code, column_name FROM parented"))
def validate_telemetry(spark, sf_dir):
    return reason_rows(_validated_telemetry(spark, sf_dir))


@query(_with_dirty("SELECT code, count(*) AS n FROM parented GROUP BY code"))
def contract_reason_counts(spark, sf_dir):
    return C.reason_counts(_validated_telemetry(spark, sf_dir))


@query(_with_dirty("SELECT r AS _source_row_number, 'TEL-' || lpad(k, 9, '0') AS telemetry_id, (e % 180)::DOUBLE AS temperature_c FROM b WHERE go AND NOT EXISTS (SELECT 1 FROM parented WHERE parented.r = b.r)"))
def accepted_telemetry(spark, sf_dir):
    ok = _validated_telemetry(spark, sf_dir).filter(F.size("reasons") == 0).drop("reasons")
    return typed(ok, CONTRACTS["machine_telemetry"]).select(ROW, "telemetry_id", "temperature_c")


@query("""SELECT 'contract:machine_telemetry' || coalesce(':' || code, '') AS check_id, CASE WHEN n > 0 THEN 'warning' ELSE 'passed' END AS status, n::VARCHAR AS observed_value
  FROM (WITH """ + _DIRTY + """ SELECT NULL AS code, count(DISTINCT r) AS n FROM parented UNION ALL SELECT code, count(*) FROM parented GROUP BY code)""")
def contract_check_rows(spark, sf_dir):
    return C.contract_checks(_validated_telemetry(spark, sf_dir), "machine_telemetry", "run-1", AS_OF).select("check_id", "status", "observed_value")


def _quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated_telemetry(spark, sf_dir).filter(F.size("reasons") > 0).select(F.lit("machine_telemetry").alias("source_name"), ROW, "reasons")


@query(_with_dirty("SELECT 'machine_telemetry' AS source_name, code, count(DISTINCT r) AS row_count FROM parented GROUP BY code"))
def quarantine_summary(spark, sf_dir):
    return O.quarantine_summary(_quarantine(spark, sf_dir))


@query(_with_dirty("SELECT 'machine_telemetry' AS source_name, r AS _source_row_number, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM parented GROUP BY r ORDER BY r LIMIT 50"))
def quarantine_page(spark, sf_dir):
    return O.quarantine_page(_quarantine(spark, sf_dir))


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text: some end before they start, some have half a pair, some lack all parents or exceed a bound."""
    o = _raw(spark, sf_dir, "production_orders")
    k = F.col(ROW)
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return o.select(
        ROW,
        "production_order_id",
        "production_line_id",
        "product_code",
        time("planned_start_at").alias("planned_start_at"),
        F.when(k % 17 == 0, time("planned_start_at")).otherwise(time("planned_end_at")).alias("planned_end_at"),
        time("actual_start_at").alias("actual_start_at"),
        time("actual_end_at").alias("actual_end_at"),
        (F.col("planned_quantity") + 1).cast("string").alias("planned_quantity"),
        F.when(k % 19 == 0, "1000001").otherwise(F.col("actual_quantity").cast("string")).alias("actual_quantity"),
        "status",
        time("updated_at").alias("updated_at"),
    )


@query("""SELECT r AS _source_row_number, code, column_name FROM (WITH o AS (SELECT *, _source_row_number AS r FROM production_orders),
    b AS (SELECT r, 'out_of_range' AS code, 'actual_quantity' AS column_name FROM o WHERE r % 19 = 0
      UNION ALL SELECT r, 'invalid_identifier', 'product_code' FROM o WHERE NOT regexp_matches(product_code, '^[A-Z][A-Z0-9-]{2,63}$'))
  SELECT * FROM b
  UNION ALL SELECT r, 'invalid_timestamp_order', 'planned_start_at,planned_end_at' FROM o WHERE r % 17 = 0 AND r NOT IN (SELECT r FROM b)
  UNION ALL SELECT r, 'incomplete_timestamp_pair', 'actual_start_at,actual_end_at' FROM o WHERE (actual_start_at IS NULL) <> (actual_end_at IS NULL) AND r NOT IN (SELECT r FROM b)
  UNION ALL SELECT r, 'invalid_timestamp_order', 'actual_start_at,actual_end_at' FROM o WHERE actual_end_at < actual_start_at AND r NOT IN (SELECT r FROM b))""")
def validate_orders(spark, sf_dir):
    return reason_rows(validate(dirty_orders(spark, sf_dir), CONTRACTS["production_orders"], AS_OF))


def dirty_inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = _raw(spark, sf_dir, "quality_inspections"), F.col(ROW)
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return i.select(
        ROW,
        "quality_inspection_id",
        "production_order_id",
        time("inspected_at").alias("inspected_at"),
        F.col("sample_size").cast("string").alias("sample_size"),
        (F.col("passed_units") + (k % 23 == 0).cast("long")).cast("string").alias("passed_units"),
        F.col("failed_units").cast("string").alias("failed_units"),
        F.when(k % 29 == 0, "pass").otherwise(F.col("result")).alias("result"),
        "inspector_id",
        time("updated_at").alias("updated_at"),
    )


@query("""SELECT _source_row_number, 'inspection_total_mismatch' AS code, 'sample_size,passed_units,failed_units' AS column_name FROM quality_inspections WHERE _source_row_number % 23 = 0
  UNION ALL SELECT _source_row_number, 'inspection_result_mismatch', 'result,failed_units' FROM quality_inspections WHERE _source_row_number % 29 = 0 AND failed_units > 0""")
def validate_inspections(spark, sf_dir):
    return reason_rows(validate(dirty_inspections(spark, sf_dir), CONTRACTS["quality_inspections"], AS_OF))


def _text(df: DataFrame, contract: str) -> DataFrame:
    """A raw table's declared columns as a file's text."""
    def cell(c: str):
        kind = CONTRACTS[contract].kinds[c]
        return (F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'") if kind == "timestamp" else F.col(c).cast("string")).alias(c)

    return df.select(ROW, *(cell(c) for c in CONTRACTS[contract].columns if c in df.columns))


@query("""SELECT _source_row_number, 'missing_required_column' AS code, 'technician_id' AS column_name FROM maintenance_work_orders""")
def validate_missing_column(spark, sf_dir):
    """Work orders whose file lacks a required column: every row is rejected for it."""
    return reason_rows(validate(_text(_raw(spark, sf_dir, "maintenance_work_orders"), "maintenance_work_orders").drop("technician_id"), CONTRACTS["maintenance_work_orders"], AS_OF))


def _sound_batch(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Factories, lines and machines as text that the contracts accept, but for every seventh factory's date."""
    raw = raw_tables(spark, sf_dir)
    out = {s: _text(raw[s], s) for s in ("factories", "production_lines", "machines")}
    out["factories"] = out["factories"].withColumn("country_code", F.lit("HU")).withColumn("opened_on", F.when(F.col(ROW) % 7 == 0, "2024-02-30").otherwise(F.col("opened_on")))
    out["machines"] = out["machines"].withColumn("machine_type", F.lit("robot"))
    return out


@query("""SELECT * FROM (WITH f AS (SELECT factory_id FROM factories WHERE _source_row_number % 7 <> 0), l AS (SELECT production_line_id FROM production_lines WHERE factory_id IN (FROM f))
  SELECT 'factories' AS source_name, (SELECT count(*) FROM f) AS accepted, (SELECT count(*) FROM factories WHERE _source_row_number % 7 = 0) AS quarantined
  UNION ALL SELECT 'production_lines', (SELECT count(*) FROM l), (SELECT count(*) FROM production_lines) - (SELECT count(*) FROM l)
  UNION ALL SELECT 'machines', count(*) FILTER (production_line_id IN (FROM l)), count(*) FILTER (production_line_id NOT IN (FROM l)) FROM machines)""")
def validate_cascade(spark, sf_dir):
    """A rejected factory rejects its lines and their machines."""
    parts = [v.rows.agg(C.count_where(F.size("reasons") == 0).alias("accepted"), C.count_where(F.size("reasons") > 0).alias("quarantined")).select(F.lit(s).alias("source_name"), "*") for s, v in validate_batch(_sound_batch(spark, sf_dir), AS_OF).items()]
    return C._union(parts)


@query("""SELECT _source_row_number, 'missing_parent_source' AS code, 'machine_id' AS column_name FROM downtime_events
  WHERE (ended_at IS NULL OR date_trunc('second', ended_at) > date_trunc('second', started_at))
  UNION ALL SELECT _source_row_number, 'invalid_timestamp_order', 'started_at,ended_at' FROM downtime_events WHERE date_trunc('second', ended_at) <= date_trunc('second', started_at)""")
def validate_absent_parent(spark, sf_dir):
    batch = {"downtime_events": _text(_raw(spark, sf_dir, "downtime_events"), "downtime_events")}
    return reason_rows(validate_batch(batch, AS_OF)["downtime_events"].rows)


@query("SELECT production_order_id FROM production_orders WHERE production_order_id NOT IN (SELECT production_order_id FROM quality_inspections)")
def fk_orphans(spark, sf_dir):
    """Orders that no inspection refers to."""
    raw = raw_tables(spark, sf_dir)
    return raw["production_orders"].select("production_order_id").join(raw["quality_inspections"].select("production_order_id"), "production_order_id", "left_anti")


@query("SELECT production_order_id FROM production_orders WHERE production_order_id IN (SELECT production_order_id FROM quality_inspections WHERE result = 'fail')")
def accepted_parents(spark, sf_dir):
    raw = raw_tables(spark, sf_dir)
    return raw["production_orders"].select("production_order_id").join(raw["quality_inspections"].filter("result = 'fail'").select("production_order_id"), "production_order_id", "left_semi")


# --- checks -----------------------------------------------------------------------------------------------------------------------


@query("SELECT production_order_id, planned_quantity, actual_quantity FROM order_performance WHERE actual_quantity > 1.5 * planned_quantity")
def plan_overrun(spark, sf_dir):
    m = Models(raw_tables(spark, sf_dir), AS_OF)
    return C.failing(C.Rule("plan_overrun", "o", "actual_quantity", other="planned_quantity"), {"o": m.fct_production_output}).select("production_order_id", "planned_quantity", "actual_quantity")


@query("SELECT quality_inspection_id FROM quality_inspections WHERE passed_units + failed_units + (_source_row_number % 23 = 0)::INTEGER > sample_size")
def count_reconcile(spark, sf_dir):
    i = _raw(spark, sf_dir, "quality_inspections").withColumn("passed_units", F.col("passed_units") + (F.col(ROW) % 23 == 0).cast("long"))
    return C.failing(C.Rule("counts_reconcile", "i", "sample_size"), {"i": i}).select("quality_inspection_id")


RULES = [
    C.Rule("not_null", "downtime_events", "ended_at", severity="warning"),
    C.Rule("not_null", "machines", "machine_id"),
    C.Rule("unique", "product_defects", "product_defect_id"),
    C.Rule("unique", "machines", "machine_id"),
    C.Rule("relationships", "quality_inspections", "production_order_id", parent=("production_orders", "production_order_id")),
    C.Rule("relationships", "factories", "factory_id", parent=("production_lines", "factory_id"), severity="warning"),
    C.Rule("accepted_values", "production_orders", "status", values=("planned", "in_progress", "completed")),
    C.Rule("non_negative", "product_defects", "defect_count"),
    C.Rule("end_after_start", "downtime_events", "ended_at", other="started_at"),
    C.Rule("plan_overrun", "production_orders", "actual_quantity", other="planned_quantity"),
    C.Rule("counts_reconcile", "quality_inspections", "sample_size"),
]
_COUNTS = """counts(check_id, kind, scope, n, severity) AS (
    SELECT 'not_null:downtime_events.ended_at', 'not_null', 'downtime_events', (SELECT count(*) FROM downtime_events WHERE ended_at IS NULL), 'warning'
    UNION ALL SELECT 'not_null:machines.machine_id', 'not_null', 'machines', (SELECT count(*) FROM machines WHERE machine_id IS NULL), 'error'
    UNION ALL SELECT 'unique:product_defects.product_defect_id', 'unique', 'product_defects', (SELECT count(*) FROM (SELECT 1 FROM product_defects GROUP BY product_defect_id HAVING count(*) > 1)), 'error'
    UNION ALL SELECT 'unique:machines.machine_id', 'unique', 'machines', (SELECT count(*) FROM (SELECT 1 FROM machines GROUP BY machine_id HAVING count(*) > 1)), 'error'
    UNION ALL SELECT 'relationships:quality_inspections.production_order_id', 'relationships', 'quality_inspections', (SELECT count(*) FROM quality_inspections WHERE production_order_id NOT IN (SELECT production_order_id FROM production_orders)), 'error'
    UNION ALL SELECT 'relationships:factories.factory_id', 'relationships', 'factories', (SELECT count(*) FROM factories WHERE factory_id NOT IN (SELECT factory_id FROM production_lines)), 'warning'
    UNION ALL SELECT 'accepted_values:production_orders.status', 'accepted_values', 'production_orders', (SELECT count(*) FROM production_orders WHERE status NOT IN ('planned', 'in_progress', 'completed')), 'error'
    UNION ALL SELECT 'non_negative:product_defects.defect_count', 'non_negative', 'product_defects', (SELECT count(*) FROM product_defects WHERE defect_count < 0), 'error'
    UNION ALL SELECT 'end_after_start:downtime_events.ended_at', 'end_after_start', 'downtime_events', (SELECT count(*) FROM downtime_events WHERE ended_at < started_at), 'error'
    UNION ALL SELECT 'plan_overrun:production_orders.actual_quantity', 'plan_overrun', 'production_orders', (SELECT count(*) FROM production_orders WHERE actual_quantity > 1.5 * planned_quantity), 'error'
    UNION ALL SELECT 'counts_reconcile:quality_inspections.sample_size', 'counts_reconcile', 'quality_inspections', (SELECT count(*) FROM quality_inspections WHERE passed_units + failed_units > sample_size), 'error'),
  judged AS (SELECT check_id, 'model_test' AS check_type, scope, n, kind, CASE WHEN n = 0 THEN 'passed' WHEN severity = 'warning' THEN 'warning' ELSE 'failed' END AS status,
    CASE WHEN n = 0 THEN 'info' ELSE severity END AS severity FROM counts)"""


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.run_checks(RULES, raw_tables(spark, sf_dir), "run-1", AS_OF)


@query(f"SELECT * FROM (WITH {_COUNTS} SELECT check_id, kind AS check_name, scope, status, severity, n::VARCHAR AS observed_value FROM judged)")
def quality_checks(spark, sf_dir):
    return _checks(spark, sf_dir).select("check_id", "check_name", "scope", "status", "severity", "observed_value")


MODEL_RULES = [
    C.Rule("plan_overrun", "fct_production_output", "actual_quantity", other="planned_quantity"),
    C.Rule("not_null", "factory_performance", "factory_id"),
    C.Rule("non_negative", "factory_performance", "unplanned_downtime_hours"),
    C.Rule("not_null", "dim_factory", "factory_id"),
    C.Rule("unique", "fct_production_output", "production_order_id"),
    C.Rule("not_null", "fct_downtime", "ended_at", severity="warning"),
]


@query("""SELECT * FROM (WITH counts(check_id, scope, n, severity) AS (
    SELECT 'plan_overrun:fct_production_output.actual_quantity', 'fct_production_output', (SELECT count(*) FROM order_performance WHERE actual_quantity > 1.5 * planned_quantity), 'error'
    UNION ALL SELECT 'not_null:factory_performance.factory_id', 'factory_performance', (SELECT count(*) FROM factory_performance WHERE factory_id IS NULL), 'error'
    UNION ALL SELECT 'non_negative:factory_performance.unplanned_downtime_hours', 'factory_performance', (SELECT count(*) FROM factory_performance WHERE unplanned_downtime_hours < 0), 'error'
    UNION ALL SELECT 'not_null:dim_factory.factory_id', 'dim_factory', (SELECT count(*) FROM dim_factory WHERE factory_id IS NULL), 'error'
    UNION ALL SELECT 'unique:fct_production_output.production_order_id', 'fct_production_output', (SELECT count(*) FROM (SELECT 1 FROM order_performance GROUP BY production_order_id HAVING count(*) > 1)), 'error'
    UNION ALL SELECT 'not_null:fct_downtime.ended_at', 'fct_downtime', (SELECT count(*) FROM downtime_durations WHERE ended_at IS NULL), 'warning'),
  judged AS (SELECT *, scope = 'factory_performance' AND (SELECT bool_or(n > 0 AND severity = 'error') FROM counts WHERE scope IN ('fct_production_output', 'dim_factory')) AS skipped FROM counts)
  SELECT check_id, scope, CASE WHEN skipped THEN 'failed' WHEN n = 0 THEN 'passed' WHEN severity = 'warning' THEN 'warning' ELSE 'failed' END AS status,
    CASE WHEN skipped THEN 'error' WHEN n = 0 THEN 'info' ELSE severity END AS severity, CASE WHEN skipped THEN 'skipped' ELSE n::VARCHAR END AS observed_value FROM judged)""")
def skipped_tests(spark, sf_dir):
    """Tests of models below one whose test failed have no outcome of their own."""
    from . import graph

    m = Models(raw_tables(spark, sf_dir), AS_OF)
    models = {r.model: getattr(m, r.model) for r in MODEL_RULES}
    return C.skip_below(C.run_checks(MODEL_RULES, models, "run-1", AS_OF), graph.ancestors()).select("check_id", "scope", "status", "severity", "observed_value")


@query(f"""SELECT * FROM (WITH {_COUNTS} SELECT DATE '2024-02-01' AS quality_date, check_type, scope, count(*) AS check_count, count(*) FILTER (status = 'passed') AS passed_check_count,
  count(*) FILTER (status = 'failed') AS failed_check_count, count(*) FILTER (status = 'warning') AS warning_check_count, count(*) FILTER (status = 'failed' AND severity = 'error') AS error_check_count FROM judged GROUP BY check_type, scope)""")
def quality_trends(spark, sf_dir):
    return Models({}, AS_OF, _checks(spark, sf_dir)).data_quality_trends


@query(f"SELECT * FROM (WITH {_COUNTS} SELECT 'run-1' AS run_id, check_type, status, severity, count(*) AS check_count FROM judged GROUP BY ALL)")
def quality_summary(spark, sf_dir):
    return O.quality_summary(_checks(spark, sf_dir))


@query(f"SELECT * FROM (WITH {_COUNTS} SELECT check_id, status, severity FROM judged WHERE status <> 'passed' ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, check_id LIMIT 5)")
def failed_checks_page(spark, sf_dir):
    return O.failed_checks(_checks(spark, sf_dir), limit=5).select("check_id", "status", "severity")


@query(f"""SELECT * FROM (WITH {_COUNTS}, everything AS (SELECT status, severity, NULL AS f FROM judged UNION ALL
    SELECT CASE freshness_status WHEN 'fresh' THEN 'passed' WHEN 'warning' THEN 'warning' ELSE 'failed' END, CASE freshness_status WHEN 'fresh' THEN 'info' WHEN 'warning' THEN 'warning' ELSE 'error' END,
    CASE freshness_status WHEN 'fresh' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END FROM data_freshness)
  SELECT 'run-1' AS run_id, count(*) FILTER (status = 'passed') AS passed_checks, count(*) FILTER (status = 'failed') AS failed_checks, count(*) FILTER (status = 'warning') AS warning_checks,
    CASE WHEN bool_or(status = 'failed' AND severity = 'error') THEN 'failed' WHEN bool_or(status = 'warning') THEN 'degraded' ELSE 'healthy' END AS run_status, ['fresh', 'warning', 'stale'][max(f)] AS freshness_status FROM everything)""")
def run_status(spark, sf_dir):
    fresh = C.freshness_checks(Models(raw_tables(spark, sf_dir), AS_OF).data_freshness, "run-1", AS_OF)
    return C.run_status(_checks(spark, sf_dir).unionByName(fresh))


@query("""SELECT 'freshness:' || source_name AS check_id, CASE freshness_status WHEN 'fresh' THEN 'passed' WHEN 'warning' THEN 'warning' ELSE 'failed' END AS status, source_name AS scope FROM data_freshness""")
def freshness_checks(spark, sf_dir):
    return C.freshness_checks(Models(raw_tables(spark, sf_dir), AS_OF).data_freshness, "run-1", AS_OF).select("check_id", "status", "scope")


@query("""SELECT count(*) FILTER (late)::VARCHAR AS observed_value, CASE WHEN bool_or(late) THEN 'warning' ELSE 'passed' END AS status,
  (SELECT string_agg(telemetry_id, ',' ORDER BY _source_row_number) FROM (SELECT telemetry_id, _source_row_number FROM machine_telemetry WHERE epoch_us(updated_at) - epoch_us(event_timestamp) > 86400000000 ORDER BY _source_row_number LIMIT 5)) AS evidence
  FROM (SELECT epoch_us(updated_at) - epoch_us(event_timestamp) > 86400000000 AS late FROM machine_telemetry)""")
def late_arrivals(spark, sf_dir):
    return C.late_arrivals(_raw(spark, sf_dir, "machine_telemetry"), "run-1", AS_OF).select("observed_value", "status", "evidence")


def _daily_volumes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each event type's rows of the last day, and its history: the days before, newest first."""
    daily = _events(spark, sf_dir).groupBy(F.col("event_type").alias("source_name"), F.to_date("ts").alias("day")).agg(F.count("*").alias("row_count"))
    from pyspark.sql import Window as W

    ranked = daily.withColumn("rank", F.row_number().over(W.partitionBy("source_name").orderBy(F.desc("day"))) - 1)
    return ranked.filter("rank = 0").select("source_name", F.col("row_count").alias("observed_rows")), ranked.filter("rank between 1 and 7").select("source_name", "row_count", "rank")


@query("""SELECT source_name, observed_rows, samples, samples >= 3 AS evaluated, CASE WHEN samples >= 3 THEN base END AS baseline, CASE WHEN samples >= 3 THEN mad END AS mad, CASE WHEN samples >= 3 THEN round(lo, 6) END AS lower_bound,
  CASE WHEN samples >= 3 THEN round(hi, 6) END AS upper_bound, CASE WHEN samples >= 3 AND NOT observed_rows BETWEEN lo AND hi THEN 'warning' ELSE 'passed' END AS status
  FROM (SELECT *, greatest(0.0, base - tol) AS lo, base + tol AS hi FROM (SELECT *, greatest(1.0, base * 0.2, mad * (3.0 * 1.4826)) AS tol FROM (
    SELECT o.event_type AS source_name, o.n AS observed_rows, coalesce(len(h), 0) AS samples, list_aggregate(h, 'median') AS base, list_aggregate(list_transform(h, lambda x: abs(x - list_aggregate(h, 'median'))), 'median') AS mad FROM (
      SELECT event_type, max(n) FILTER (k = 0) AS n, list(n::DOUBLE) FILTER (k BETWEEN 1 AND 7) AS h FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) - 1 AS k FROM (
        SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)) GROUP BY 1) o)))""")
def volume_anomaly(spark, sf_dir):
    return C.volume_anomaly(*_daily_volumes(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("lower_bound", "upper_bound")})


# --- table maintenance ------------------------------------------------------------------------------------------------------------


def _state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Machines as stored, and a later delivery: some changed and newer, some changed but older, some as before, some new."""
    m = _raw(spark, sf_dir, "machines").select("machine_id", "status", "updated_at", "_batch_id", F.col("_record_checksum"), (F.col(ROW) - 2).alias("k"))
    stored = m.filter("k % 5 <> 0").drop("k")
    later = m.filter("k % 2 = 0").withColumns(
        {
            "_batch_id": F.lit("batch-2"),
            "status": F.when(F.col("k") % 3 != 0, "retired").otherwise(F.col("status")),
            "_record_checksum": F.when(F.col("k") % 3 != 0, F.sha2("_record_checksum", 256)).otherwise(F.col("_record_checksum")),
            "updated_at": F.when(F.col("k") % 7 == 0, F.col("updated_at") - F.expr("INTERVAL '1' DAY")).otherwise(F.col("updated_at")),
        }
    )
    return stored, later.drop("k")


@query("""SELECT machine_id, CASE WHEN take THEN ns ELSE status END AS status, CASE WHEN take THEN nu ELSE updated_at END AS updated_at, CASE WHEN take THEN 'batch-2' ELSE _batch_id END AS _batch_id,
    CASE WHEN take THEN nc ELSE _record_checksum END AS _record_checksum
  FROM (SELECT *, k % 2 = 0 AND (k % 5 = 0 OR (k % 3 <> 0 AND k % 7 <> 0)) AS take FROM (SELECT *, _source_row_number - 2 AS k, CASE WHEN k % 3 <> 0 THEN 'retired' ELSE status END AS ns,
    CASE WHEN k % 7 = 0 THEN updated_at - INTERVAL 1 DAY ELSE updated_at END AS nu, CASE WHEN k % 3 <> 0 THEN sha256(_record_checksum) ELSE _record_checksum END AS nc FROM machines))
  WHERE k % 5 <> 0 OR k % 2 = 0""")
def upsert_current_state(spark, sf_dir):
    return T.upsert_current(*_state(spark, sf_dir), "machine_id")


@query("SELECT user_id, sha256('{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}') AS checksum FROM events")
def record_checksums(spark, sf_dir):
    return _events(spark, sf_dir).select("user_id", record_checksum(["user_id", "event_type", "event_id"]).alias("checksum"))


_LATE = "TIMESTAMP '2024-01-20 00:00:00'"


@query(f"SELECT telemetry_id, event_timestamp, arrival_lag_hours FROM telemetry_enriched WHERE event_timestamp >= (SELECT max(event_timestamp) FROM machine_telemetry WHERE event_timestamp < {_LATE}) - INTERVAL 48 HOURS")
def incremental_lookback(spark, sf_dir):
    """What a run reads after a stored table that ends on 20 January."""
    m = Models(raw_tables(spark, sf_dir), AS_OF)
    stored = m.stg("machine_telemetry").filter(F.col("event_timestamp") < at("2024-01-20 00:00:00"))
    rows = T.incremental_slice(m.stg("machine_telemetry"), "event_timestamp", stored)
    return m.telemetry_rows(rows).select("telemetry_id", "event_timestamp", "arrival_lag_hours")


@query("SELECT telemetry_id, event_timestamp, arrival_lag_hours FROM telemetry_enriched WHERE event_timestamp >= TIMESTAMP '2024-01-05' AND event_timestamp < TIMESTAMP '2024-01-08'")
def backfill_window(spark, sf_dir):
    m = Models(raw_tables(spark, sf_dir), AS_OF)
    rows = T.incremental_slice(m.stg("machine_telemetry"), "event_timestamp", start="2024-01-05 00:00:00", end="2024-01-08 00:00:00")
    return m.telemetry_rows(rows).select("telemetry_id", "event_timestamp", "arrival_lag_hours")


@query(f"SELECT telemetry_id, CASE WHEN event_timestamp >= {_LATE} - INTERVAL 48 HOURS THEN 'new' ELSE 'old' END AS version FROM machine_telemetry")
def delete_insert(spark, sf_dir):
    """A stored table up to 20 January, rebuilt from two days before on."""
    t = _raw(spark, sf_dir, "machine_telemetry").select("telemetry_id", "event_timestamp")
    stored = t.filter(F.col("event_timestamp") < at("2024-01-20 00:00:00")).withColumn("version", F.lit("old"))
    rows = t.filter(F.col("event_timestamp") >= at("2024-01-18 00:00:00")).withColumn("version", F.lit("new"))
    return T.delete_insert(stored, rows, "telemetry_id").select("telemetry_id", "version")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = _raw(spark, sf_dir, "machines").select("machine_id", "status", "updated_at", (F.col(ROW) - 2).alias("k"))
    day = F.expr("INTERVAL '1' DAY")
    later = m.filter("k % 11 <> 0").withColumns({"status": F.when(F.col("k") % 3 == 0, "retired").otherwise(F.col("status")), "updated_at": F.when(F.col("k") % 3 == 0, F.col("updated_at") + day).otherwise(F.col("updated_at"))})
    return m.filter("k % 13 <> 0").drop("k"), later.drop("k")


@query(f"""SELECT machine_id, status, updated_at, updated_at AS valid_from, CASE WHEN k % 11 = 0 THEN {SQL_AS_OF} WHEN k % 3 = 0 THEN updated_at + INTERVAL 1 DAY END AS valid_to
    FROM (SELECT *, _source_row_number - 2 AS k FROM machines) WHERE k % 13 <> 0
  UNION ALL SELECT machine_id, CASE WHEN k % 3 = 0 THEN 'retired' ELSE status END, u, u, NULL FROM (SELECT *, _source_row_number - 2 AS k, CASE WHEN k % 3 = 0 THEN updated_at + INTERVAL 1 DAY ELSE updated_at END AS u FROM machines)
    WHERE k % 11 <> 0 AND (k % 13 = 0 OR k % 3 = 0)""")
def scd2_history(spark, sf_dir):
    """Machines' history after a second snapshot with changed, vanished and new ones."""
    first, second = _versions(spark, sf_dir)
    return T.scd2(T.scd2(None, first, "machine_id", "updated_at", AS_OF), second, "machine_id", "updated_at", AS_OF)


@query("""SELECT machine_id, column_name, left_value, right_value FROM (SELECT *, _source_row_number - 2 AS k FROM machines), LATERAL (
    SELECT '*' AS column_name, CASE WHEN k % 13 <> 0 THEN 'present' END AS left_value, CASE WHEN k % 11 <> 0 THEN 'present' END AS right_value WHERE (k % 13 = 0) <> (k % 11 = 0)
    UNION ALL SELECT 'status', status, 'retired' WHERE k % 13 <> 0 AND k % 11 <> 0 AND k % 3 = 0 AND status <> 'retired'
    UNION ALL SELECT 'updated_at', updated_at::VARCHAR, (updated_at + INTERVAL 1 DAY)::VARCHAR WHERE k % 13 <> 0 AND k % 11 <> 0 AND k % 3 = 0)""")
def table_diff(spark, sf_dir):
    first, second = _versions(spark, sf_dir)
    return T.table_diff(first, second, "machine_id")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS model_name, (SELECT count(*) FROM {s}) AS row_count" for s in KEYS) + ")")
def relation_row_counts(spark, sf_dir):
    return T.row_counts(raw_tables(spark, sf_dir))


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files as events of users: a known ledger, and deliveries that partly repeat it."""
    e = _events(spark, sf_dir)
    k = F.col("event_id")
    base = e.select(F.col("event_type").alias("source_name"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("logical_key"), F.sha2(F.concat_ws("/", "event_type", "user_id", (k % 3).cast("string")), 256).alias("checksum"), "ts", k.alias("k"))
    known = base.filter("k % 2 = 0").select("source_name", "logical_key", "checksum", F.concat(F.lit("file-"), F.lpad(F.col("k").cast("string"), 12, "0")).alias("file_id"), F.when(F.col("k") % 5 == 0, "failed").otherwise("loaded").alias("status"), F.col("ts").alias("created_at"))
    return base.filter("k % 2 = 1").select("source_name", "logical_key", "checksum", "k"), known


@query("""SELECT source_name, logical_key, i.checksum, i.k, CASE WHEN l.file_id IS NULL THEN 'new' WHEN l.status = 'loaded' THEN 'duplicate' ELSE 'retry' END AS decision, l.file_id AS known_file_id,
    c.checksum IS NOT NULL AND c.checksum <> i.checksum AS changed_logical_file
  FROM (SELECT event_type AS source_name, 'user-' || user_id AS logical_key, sha256(event_type || '/' || user_id || '/' || (event_id % 3)) AS checksum, event_id AS k FROM events WHERE event_id % 2 = 1) i
  LEFT JOIN (SELECT source_name, checksum, file_id, status FROM known_files QUALIFY row_number() OVER (PARTITION BY source_name, checksum ORDER BY created_at DESC, file_id DESC) = 1) l USING (source_name, checksum)
  LEFT JOIN (SELECT source_name, logical_key, checksum FROM known_files QUALIFY row_number() OVER (PARTITION BY source_name, logical_key ORDER BY created_at DESC, file_id DESC) = 1) c USING (source_name, logical_key)""".replace(
    "known_files", "(SELECT event_type AS source_name, 'user-' || user_id AS logical_key, sha256(event_type || '/' || user_id || '/' || (event_id % 3)) AS checksum, 'file-' || lpad(event_id::VARCHAR, 12, '0') AS file_id, CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'loaded' END AS status, ts AS created_at FROM events WHERE event_id % 2 = 0)"
).replace("SELECT source_name, logical_key, i.checksum", "SELECT i.source_name, i.logical_key, i.checksum"))
def ledger_decision(spark, sf_dir):
    return L.ledger_decision(*_files(spark, sf_dir))


# --- observability ----------------------------------------------------------------------------------------------------------------


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's events as a run: its rows by type, and a status by its share of errors."""
    per = _events(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("t"))
    runs = per.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("model_row_counts"), F.sum("n").alias("accepted_row_count"), F.min("t").alias("started_at"), F.sum(F.when(F.col("event_type") == "error", F.col("n"))).alias("errors"))
    status = F.when(F.coalesce("errors", F.lit(0)) * 5 > F.col("accepted_row_count"), "failed").otherwise("healthy")
    return runs.select(F.concat(F.lit("run-"), F.col("day").cast("string")).alias("run_id"), status.alias("status"), "started_at", "accepted_row_count", "model_row_counts")


_RUNS = """(SELECT 'run-' || day AS run_id, CASE WHEN count(*) FILTER (event_type = 'error') * 5 > count(*) THEN 'failed' ELSE 'healthy' END AS status, min(ts) AS started_at, count(*) AS accepted_row_count
    FROM (SELECT *, ts::DATE AS day FROM events) GROUP BY day)"""


@query(f"SELECT run_id, status, started_at, accepted_row_count FROM {_RUNS} ORDER BY started_at DESC, run_id DESC LIMIT 10 OFFSET 5")
def list_runs(spark, sf_dir):
    return O.list_runs(_runs(spark, sf_dir), limit=10, offset=5).drop("model_row_counts")


@query(f"SELECT run_id, status, started_at, accepted_row_count FROM {_RUNS} WHERE status = 'healthy' AND started_at < TIMESTAMP '2024-01-25 00:00:00' ORDER BY started_at DESC LIMIT 1")
def latest_healthy_run(spark, sf_dir):
    return O.latest_healthy_before(_runs(spark, sf_dir), at("2024-01-25 00:00:00")).drop("model_row_counts")


@query("""SELECT coalesce(a.event_type, b.event_type) AS model_name, a.n AS left_rows, b.n AS right_rows, b.n - a.n AS delta, a.n IS NULL OR b.n IS NULL AS unavailable
  FROM (SELECT event_type, count(*) AS n FROM events WHERE ts::DATE = DATE '2024-01-02' GROUP BY 1) a FULL JOIN (SELECT event_type, count(*) AS n FROM events WHERE ts::DATE = DATE '2024-01-03' GROUP BY 1) b ON a.event_type = b.event_type""")
def run_compare(spark, sf_dir):
    return O.compare_runs(_runs(spark, sf_dir), "run-2024-01-02", "run-2024-01-03")


@query("SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_version(spark, sf_dir):
    return O.latest_by(_events(spark, sf_dir).select("user_id", "event_id", "ts", "event_type"), ["user_id"], "ts", "event_id")


@query("SELECT event_type AS source_name, event_id, rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 7")
def source_volume_history(spark, sf_dir):
    """The latest seven deliveries of each source among healthy runs: here events, each a delivery of its own run."""
    e = _events(spark, sf_dir).select(F.col("event_type").alias("source_name"), F.format_string("%012d", "event_id").alias("run_id"), F.col("event_id").alias("row_count"), F.col("ts").alias("started_at"), F.lit("loaded").alias("status"))
    runs = e.select("run_id", "started_at", F.lit("healthy").alias("status"), F.lit("2024-incremental-clean").alias("batch_id"))
    return L.healthy_volumes(e.drop("started_at"), runs, kind="incremental").select("source_name", F.col("row_count").alias("event_id"), "rank")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hangs on what: factories, lines, machines and their work orders."""
    raw = raw_tables(spark, sf_dir)
    return C._union([raw[s].select(F.col(c).alias("parent"), F.col(KEYS[s]).alias("child")) for s, (c, _) in PARENTS.items() if s in ("production_lines", "machines", "maintenance_work_orders")])


_EDGES = "edges AS (SELECT factory_id AS parent, production_line_id AS child FROM production_lines UNION ALL SELECT production_line_id, machine_id FROM machines UNION ALL SELECT machine_id, maintenance_work_order_id FROM maintenance_work_orders)"


@query(f"""SELECT * FROM (WITH RECURSIVE {_EDGES}, walk(node, depth) AS (SELECT child, 1 FROM edges WHERE parent IN ('FAC-003', 'LINE-000004') UNION SELECT e.child, w.depth + 1 FROM walk w JOIN edges e ON e.parent = w.node WHERE w.depth < 20)
  SELECT node, min(depth)::INTEGER AS depth FROM walk GROUP BY node)""")
def downstream_impact(spark, sf_dir):
    roots = spark.createDataFrame([("FAC-003",), ("LINE-000004",)], "node string")
    return O.downstream(_edges(spark, sf_dir), roots)


@query(f"SELECT * FROM (WITH {_EDGES} SELECT DISTINCT 'parent' AS direction, parent AS node FROM edges WHERE child = 'LINE-000004' UNION ALL SELECT DISTINCT 'child', child FROM edges WHERE parent = 'LINE-000004')")
def lineage_direct(spark, sf_dir):
    return O.direct_lineage(_edges(spark, sf_dir), "LINE-000004")


@query(f"""SELECT * FROM (WITH {_DIRTY}, {_COUNTS}
  SELECT 'check' AS section, check_id AS name, status AS value FROM judged WHERE status <> 'passed'
  UNION ALL SELECT 'reason', 'machine_telemetry:' || code, count(DISTINCT r)::VARCHAR FROM parented GROUP BY code
  UNION ALL SELECT 'delta', a.event_type, (b.n - a.n)::VARCHAR FROM (SELECT event_type, count(*) AS n FROM events WHERE ts::DATE = DATE '2024-01-02' GROUP BY 1) a JOIN (SELECT event_type, count(*) AS n FROM events WHERE ts::DATE = DATE '2024-01-03' GROUP BY 1) b USING (event_type))""")
def incident_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir).drop("kind")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    drifts = spark.createDataFrame([], "source_name string, change_type string")
    return O.incident_evidence(_checks(spark, sf_dir), quarantine_summary(spark, sf_dir), drifts, run_compare(spark, sf_dir))


_CLUES = ", ".join("(" + ", ".join([str(i), *("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in c)]) + ")" for i, c in enumerate(O.CLUES))


@query(f"""SELECT * FROM (WITH {_DIRTY}, {_COUNTS}, e(section, kind, name, value) AS (
    SELECT 'check', check_type, check_id, status FROM judged WHERE status <> 'passed'
    UNION ALL SELECT 'reason', code, 'machine_telemetry:' || code, count(DISTINCT r)::VARCHAR FROM parented GROUP BY code
    UNION ALL SELECT 'delta', 'rows', a.event_type, (b.n - a.n)::VARCHAR FROM (SELECT event_type, count(*) AS n FROM events WHERE ts::DATE = DATE '2024-01-02' GROUP BY 1) a JOIN (SELECT event_type, count(*) AS n FROM events WHERE ts::DATE = DATE '2024-01-03' GROUP BY 1) b USING (event_type)),
  clues(o, part, clue, guess, step) AS (VALUES {_CLUES}),
  met AS (SELECT * FROM e JOIN clues ON part = section AND (clue = '*' OR clue = kind)),
  rows AS (SELECT 'fact' AS section, list_position(['check', 'reason', 'schema', 'delta', 'lineage'], section) AS o, name, upper(section[1]) || section[2:] || ' ' || name || ' recorded ' || value || '.' AS text FROM e
    UNION ALL SELECT 'hypothesis', o, name, guess FROM met WHERE guess IS NOT NULL UNION ALL SELECT 'next_step', o, name, replace(step, '{{}}', name) FROM met),
  firsts AS (SELECT section, text, min(row(o, name)) AS f FROM rows GROUP BY ALL)
  SELECT section, ordinal, text FROM (SELECT section, text, row_number() OVER (PARTITION BY section ORDER BY f, text)::INTEGER AS ordinal FROM firsts) WHERE ordinal <= CASE section WHEN 'fact' THEN 30 ELSE 20 END)""")
def incident_report(spark, sf_dir):
    return O.incident_report(_evidence(spark, sf_dir))


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's events as a run, their types as its stages."""
    per = _events(spark, sf_dir).groupBy(F.concat(F.lit("run-"), F.to_date("ts").cast("string")).alias("run_id"), F.col("event_type").alias("stage_name"))
    rows = per.agg(F.lit("succeeded").alias("status"), F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"))
    return L.upsert_stages(rows.limit(0).withColumn("duration_seconds", F.lit(0.0)), rows)


@query("""SELECT 'run-2024-01-03' AS run_id, event_type AS stage_name, 'succeeded' AS status, min(ts) AS started_at, max(ts) AS finished_at, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_seconds
  FROM events WHERE ts::DATE = DATE '2024-01-03' GROUP BY event_type ORDER BY started_at, stage_name""")
def run_stages(spark, sf_dir):
    return O.run_stages(_stages(spark, sf_dir), "run-2024-01-03")


def _counted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    per = _events(spark, sf_dir).groupBy(F.concat(F.lit("run-"), F.to_date("ts").cast("string")).alias("run_id")).agg(
        F.countDistinct("event_type").alias("source_file_count"), F.count("*").alias("source_row_count"), C.count_where(e != "error").alias("accepted_row_count"), C.count_where(e == "error").alias("quarantined_row_count"),
        C.count_where(e == "view").alias("passed_checks"), C.count_where(e == "click").alias("failed_checks"),
    )
    return per.withColumn("status", F.when(F.col("quarantined_row_count") * 5 > F.col("source_row_count"), "failed").otherwise("healthy"))


_COUNTED = """(SELECT 'run-' || ts::DATE AS run_id, CASE WHEN count(*) FILTER (event_type = 'error') * 5 > count(*) THEN 'failed' ELSE 'healthy' END AS status, count(DISTINCT event_type) AS f, count(*) AS n, count(*) FILTER (event_type <> 'error') AS a,
    count(*) FILTER (event_type = 'error') AS q, count(*) FILTER (event_type = 'view') AS p, count(*) FILTER (event_type = 'click') AS x FROM events GROUP BY 1, ts::DATE)"""


@query(f"""SELECT a.run_id AS left_run_id, b.run_id AS right_run_id, a.status AS status_from, b.status AS status_to, b.f - a.f AS source_file_count_delta, b.n - a.n AS source_row_count_delta, b.a - a.a AS accepted_row_count_delta,
  b.q - a.q AS quarantined_row_count_delta, b.p - a.p AS passed_checks_delta, b.x - a.x AS failed_checks_delta FROM {_COUNTED} a, {_COUNTED} b WHERE a.run_id = 'run-2024-01-02' AND b.run_id = 'run-2024-01-03'""")
def run_count_deltas(spark, sf_dir):
    return O.compare_run_counts(_counted_runs(spark, sf_dir), "run-2024-01-02", "run-2024-01-03")


@query(f"SELECT run_id, status, n AS source_row_count FROM {_COUNTED} WHERE run_id = 'run-2024-01-05'")
def run_by_id(spark, sf_dir):
    return O.run_by_id(_counted_runs(spark, sf_dir), "run-2024-01-05").select("run_id", "status", "source_row_count")


def _catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users as models that each event describes anew; a version's columns are its event's fields."""
    e = _events(spark, sf_dir)
    mark = [F.format_string("run-%012d", "event_id").alias("run_id"), F.col("ts").alias("discovered_at"), F.format_string("model_%06d", "user_id").alias("model_name")]
    columns = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("content"), F.lit(i + 1).alias("ordinal_position")) for i, c in enumerate(("event_type", "event_id")))))
    return e.select(*mark, F.col("event_type").alias("materialization")), e.select(*mark, columns.alias("c")).select("run_id", "model_name", "c.*")


_NEWEST = "(SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"


@query(f"SELECT 'run-' || lpad(event_id::VARCHAR, 12, '0') AS run_id, ts AS discovered_at, 'model_' || lpad(user_id::VARCHAR, 6, '0') AS model_name, event_type AS materialization FROM {_NEWEST} ORDER BY model_name LIMIT 20 OFFSET 10")
def model_catalogue_page(spark, sf_dir):
    return O.latest_models(_catalogue(spark, sf_dir)[0], limit=20, offset=10)


@query(f"""SELECT * FROM (WITH m AS (SELECT * FROM {_NEWEST} WHERE user_id = (SELECT min(user_id) FROM events WHERE user_id < 100)) SELECT 'run-' || lpad(event_id::VARCHAR, 12, '0') AS run_id, 'model_' || lpad(user_id::VARCHAR, 6, '0') AS model_name, 'event_type' AS column_name,
    event_type AS content, 1 AS ordinal_position FROM m UNION ALL SELECT 'run-' || lpad(event_id::VARCHAR, 12, '0'), 'model_' || lpad(user_id::VARCHAR, 6, '0'), 'event_id', event_id::VARCHAR, 2 FROM m)""")
def model_columns_latest(spark, sf_dir):
    """The newest version's columns of the model of the smallest user."""
    models, columns = _catalogue(spark, sf_dir)
    least = _events(spark, sf_dir).filter("user_id < 100").agg(F.min("user_id")).first()[0]
    return O.model_columns(models, columns, f"model_{least or 0:06d}")


@query("""SELECT ts::DATE AS quality_date, event_type AS check_type, 'events' AS scope, count(*) AS check_count FROM events GROUP BY ALL ORDER BY quality_date DESC, check_type, scope LIMIT 12""")
def quality_trend_page(spark, sf_dir):
    """Newest days first."""
    trends = _events(spark, sf_dir).groupBy(F.to_date("ts").alias("quality_date"), F.col("event_type").alias("check_type"), F.lit("events").alias("scope")).agg(F.count("*").alias("check_count"))
    return O.quality_trend_by_run(trends, limit=12)


@query(f"""SELECT * FROM (WITH RECURSIVE {_EDGES}, roots AS (SELECT DISTINCT production_line_id AS node FROM production_orders WHERE actual_quantity > 1.5 * planned_quantity),
    walk(node, depth) AS (SELECT child, 1 FROM edges WHERE parent IN (FROM roots) UNION SELECT e.child, w.depth + 1 FROM walk w JOIN edges e ON e.parent = w.node WHERE w.depth < 20)
  SELECT node, min(depth)::INTEGER AS depth FROM walk GROUP BY node)""")
def affected_downstream(spark, sf_dir):
    """What hangs on the lines whose orders exceed their plan: those lines as scopes of failed checks."""
    over = _raw(spark, sf_dir, "production_orders").filter("actual_quantity > 1.5 * planned_quantity").select(F.col("production_line_id").alias("scope")).distinct()
    return O.affected_downstream(_edges(spark, sf_dir), over.withColumn("status", F.lit("failed")))


@query(f"SELECT * FROM (WITH {_COUNTS} SELECT run_id, 'Run run-1 ended ' || s || ' with ' || f || ' failed and ' || w || ' warning checks.' AS fact, CASE WHEN f + w > 0 THEN 'Inspect failed checks, quarantine reasons and the parents of the models concerned.' ELSE 'Nothing to do; keep the run as a baseline.' END AS next_step FROM (SELECT 'run-1' AS run_id, CASE WHEN bool_or(status = 'failed' AND severity = 'error') THEN 'failed' WHEN bool_or(status = 'warning') THEN 'degraded' ELSE 'healthy' END AS s, count(*) FILTER (status = 'failed') AS f, count(*) FILTER (status = 'warning') AS w FROM judged))")
def run_facts(spark, sf_dir):
    return C.run_facts(C.run_status(_checks(spark, sf_dir)))


@query("SELECT production_line_id, factory_id, line_name, product_family, nominal_capacity_per_hour::VARCHAR AS nominal_capacity_per_hour, status, row_number() OVER (ORDER BY production_line_id) + 1 AS _source_row_number FROM production_lines")
def csv_round_trip(spark, sf_dir):
    """Lines exported as sorted csv files in the shared folder and read back, with their row numbers."""
    import uuid

    from ..sources.csv_batch import read_source

    sc = spark.sparkContext
    home = (spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    path = f"{home}/csv-{uuid.uuid4().hex}"
    lines = _raw(spark, sf_dir, "production_lines").select("production_line_id", "factory_id", "line_name", "product_family", "nominal_capacity_per_hour", "status")
    lines.repartitionByRange("production_line_id").sortWithinPartitions("production_line_id").write.option("header", True).option("escape", '"').csv(path)
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return read_source(spark, path, most_rows=None)
