"""DuckDB twins of the registered queries: the domain views, the models over them, and each query's own SQL."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"


def _lineage(source: str, key: str, ingested: str) -> str:
    return f"'batch-1' AS _batch_id, 'file-{source}' AS _source_file_id, ({key} + 2)::BIGINT AS _source_row_number, {ingested} AS _ingested_at, sha256('{source}|' || ({key})::VARCHAR) AS _record_checksum"


def _id(prefix: str, key: str, width: int) -> str:
    return f"'{prefix}' || lpad(({key})::VARCHAR, {width}, '0')"


def _hours(n: str) -> str:
    return f"to_hours(({n})::INTEGER)"


_SHIFT_KEY = "(n_nationkey * 90 + day * 3 + slot)"
_SHIFT_START = f"(TIMESTAMP '2024-01-01 06:00:00' + {_hours('day * 24 + slot * 8')})"

DOMAIN = {
    "factories": f"""SELECT {_id('FAC-', 'n_nationkey', 3)} AS factory_id, n_name AS factory_name, n_regionkey::VARCHAR AS country_code,
        ['Europe/Budapest', 'Europe/Berlin', 'Europe/Prague'][n_nationkey % 3 + 1] AS timezone, (DATE '2000-01-01' + n_nationkey::INTEGER)::DATE AS opened_on,
        ['inactive', 'active', 'active', 'active'][n_nationkey % 4 + 1] AS status, TIMESTAMP '2024-01-20 00:00:00' + {_hours('n_nationkey')} AS updated_at,
        {_lineage('factories', 'n_nationkey', "TIMESTAMP '2024-01-31 12:00:00'")} FROM nation""",
    "production_lines": f"""SELECT {_id('LINE-', 's_suppkey', 6)} AS production_line_id, {_id('FAC-', 's_nationkey', 3)} AS factory_id, s_name AS line_name,
        ['motor', 'pump', 'gearbox'][s_suppkey % 3 + 1] AS product_family, (s_suppkey % 50 + 100)::INTEGER AS nominal_capacity_per_hour,
        ['active', 'active', 'inactive'][s_suppkey % 3 + 1] AS status, TIMESTAMP '2024-01-21 00:00:00' + {_hours('s_suppkey % 48')} AS updated_at,
        {_lineage('production_lines', 's_suppkey', "TIMESTAMP '2024-01-31 12:00:00'")} FROM supplier""",
    "machines": f"""SELECT {_id('MCH-', 'c_custkey', 6)} AS machine_id, {_id('LINE-', 'c_custkey % 10', 6)} AS production_line_id, c_name AS machine_name,
        lower(c_mktsegment) AS machine_type, 'MAKER-' || (c_custkey % 4)::VARCHAR AS manufacturer, 'MODEL-' || (c_custkey % 7)::VARCHAR AS model,
        (DATE '2015-01-01' + (c_custkey % 2000)::INTEGER)::DATE AS installed_on, ['active', 'maintenance', 'active', 'retired', 'active'][c_custkey % 5 + 1] AS status,
        TIMESTAMP '2024-01-01 00:00:00' + {_hours('c_custkey % 700')} AS updated_at, {_lineage('machines', 'c_custkey', "TIMESTAMP '2024-01-30 12:00:00'")} FROM customer""",
    "shifts": f"""SELECT {_id('SHF-', _SHIFT_KEY, 6)} AS shift_id, {_id('FAC-', 'n_nationkey', 3)} AS factory_id, ['morning', 'afternoon', 'night'][slot + 1] AS shift_name,
        {_SHIFT_START} AS started_at, {_SHIFT_START} + to_hours(8) AS ended_at, {_id('OPR-', _SHIFT_KEY + ' % 40', 3)} AS operator_id, {_SHIFT_START} + to_hours(9) AS updated_at,
        {_lineage('shifts', _SHIFT_KEY, _SHIFT_START + ' + to_hours(10)')} FROM nation, range(0, 30) AS d(day), range(0, 3) AS s(slot)""",
    "production_orders": f"""SELECT {_id('ORD-', 'o_orderkey', 8)} AS production_order_id, {_id('LINE-', 'o_custkey % 10', 6)} AS production_line_id, 'PROD-' || (o_orderkey % 25)::VARCHAR AS product_code,
        o_orderdate AS planned_start_at, o_orderdate + to_hours(48) AS planned_end_at, CASE WHEN st IN ('completed', 'in_progress') THEN o_orderdate + to_hours(1) END AS actual_start_at,
        CASE WHEN st = 'completed' THEN o_orderdate + {_hours('o_orderkey % 72 + 2')} END AS actual_end_at, coalesce(open_qty, 0)::BIGINT AS planned_quantity,
        coalesce(done_qty, 0)::BIGINT AS actual_quantity, st AS status, o_orderdate + to_hours(80) AS updated_at, {_lineage('production_orders', 'o_orderkey', 'o_orderdate + to_hours(96)')}
        FROM (SELECT *, CASE WHEN o_orderpriority = '5-LOW' THEN 'cancelled' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'in_progress' ELSE 'planned' END AS st FROM orders)
        LEFT JOIN (SELECT l_orderkey, sum(l_quantity) FILTER (l_linestatus = 'O') AS open_qty, sum(l_quantity) FILTER (l_linestatus = 'F') AS done_qty FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "quality_inspections": f"""SELECT {_id('QIN-', 'l_orderkey', 8)} AS quality_inspection_id, {_id('ORD-', 'l_orderkey', 8)} AS production_order_id, first AS inspected_at, sample AS sample_size,
        sample - failed AS passed_units, failed AS failed_units, CASE WHEN failed = 0 THEN 'pass' ELSE 'fail' END AS result, {_id('INS-', 'l_orderkey % 30', 3)} AS inspector_id,
        first + to_hours(1) AS updated_at, {_lineage('quality_inspections', 'l_orderkey', 'first + to_hours(6)')}
        FROM (SELECT l_orderkey, sum(l_quantity)::BIGINT AS sample, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0)::BIGINT AS failed, min(l_shipdate) AS first FROM lineitem GROUP BY 1)""",
    "product_defects": f"""SELECT {_id('DEF-', 'l_orderkey * 10 + l_linenumber', 9)} AS product_defect_id, {_id('QIN-', 'l_orderkey', 8)} AS quality_inspection_id, l_shipdate AS detected_at,
        CASE WHEN l_quantity < 20 THEN 'surface' WHEN l_quantity < 40 THEN 'assembly' ELSE 'functional' END AS defect_type, CASE WHEN l_linestatus = 'F' THEN 'critical' ELSE 'minor' END AS severity,
        l_quantity::BIGINT AS defect_count, l_shipdate + to_hours(2) AS updated_at, {_lineage('product_defects', '(l_orderkey * 10 + l_linenumber)', 'l_shipdate + to_hours(8)')}
        FROM lineitem WHERE l_returnflag = 'R'""",
    "downtime_events": f"""SELECT {_id('DWN-', 'event_id', 9)} AS downtime_event_id, {_id('MCH-', 'user_id', 6)} AS machine_id, ts AS started_at,
        CASE WHEN event_id % 13 <> 0 THEN ts + to_minutes(floor(value)::INTEGER) END AS ended_at, CASE WHEN event_id % 3 = 0 THEN 'planned' ELSE 'unplanned' END AS downtime_type,
        CASE WHEN event_id % 2 = 0 THEN 'breakdown' ELSE 'maintenance' END AS reason_code, ts + to_hours(3) AS updated_at, {_lineage('downtime_events', 'event_id', 'ts + to_hours(4)')}
        FROM events WHERE event_type = 'error'""",
    "machine_telemetry": f"""SELECT {_id('TEL-', 'event_id', 9)} AS telemetry_id, {_id('MCH-', 'user_id', 6)} AS machine_id, ts AS event_timestamp, value::DECIMAL(8, 3) AS temperature_c, value::DECIMAL(8, 3) AS vibration_mm_s,
        (event_id % 500)::DECIMAL(9, 3) AS pressure_bar, (event_id % 1000)::DECIMAL(12, 3) AS energy_kwh,
        CASE WHEN event_type IN ('purchase', 'view') THEN 'running' WHEN event_type = 'error' THEN 'stopped' ELSE 'idle' END AS operating_state, ts + {_hours('event_id % 30')} AS updated_at,
        {_lineage('machine_telemetry', 'event_id', 'ts + ' + _hours('event_id % 50'))} FROM events""",
    "maintenance_work_orders": f"""SELECT {_id('MWO-', 'o_orderkey', 8)} AS maintenance_work_order_id, {_id('MCH-', 'o_custkey', 6)} AS machine_id, o_orderdate AS created_at, o_orderdate + to_hours(720) AS scheduled_for,
        CASE WHEN o_orderstatus NOT IN ('O', 'P') THEN o_orderdate + {_hours('o_orderkey % 900')} END AS completed_at, ['preventive', 'corrective', 'inspection'][o_orderkey % 3 + 1] AS maintenance_type,
        lower(substring(o_orderpriority, 3, 20)) AS priority, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE 'completed' END AS status,
        {_id('TEC-', 'o_orderkey % 20', 3)} AS technician_id, o_orderdate + to_hours(900) AS updated_at, {_lineage('maintenance_work_orders', 'o_orderkey', 'o_orderdate + to_hours(901)')} FROM orders""",
}


def _elapsed(a: str, b: str, unit: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / {unit})"


KEPT = "_batch_id, _source_file_id, _record_checksum"
CONTEXT = "machine_name, machine_type, production_line_id, line_name, factory_id, factory_name"

#: Models by name, in order of their dependence.
MODELS = {
    "machine_context": """SELECT machine_id, m.production_line_id, machine_name, machine_type, manufacturer, model, installed_on, m.status AS machine_status, m.updated_at AS machine_updated_at,
        l.factory_id, line_name, product_family, nominal_capacity_per_hour::DOUBLE AS nominal_capacity_per_hour, l.status AS production_line_status, factory_name, country_code, timezone, f.status AS factory_status
        FROM machines m JOIN production_lines l ON m.production_line_id = l.production_line_id JOIN factories f ON l.factory_id = f.factory_id""",
    "downtime_durations": f"""SELECT d.machine_id, downtime_event_id, started_at, ended_at, downtime_type, reason_code, {KEPT}, {CONTEXT},
        {_elapsed('started_at', f'coalesce(ended_at, {AS_OF})', '6e7')} AS downtime_minutes, downtime_type = 'unplanned' AND reason_code = 'breakdown' AS is_failure, ended_at IS NULL AS is_open
        FROM downtime_events d JOIN machine_context USING (machine_id)""",
    "failure_intervals": f"""SELECT downtime_event_id, machine_id, factory_id, production_line_id, started_at, ended_at, downtime_minutes AS repair_minutes,
        CASE WHEN prior IS NOT NULL THEN greatest(0.0, {_elapsed('prior', 'started_at', '3.6e9')}) END AS hours_since_previous_failure
        FROM (SELECT *, lag(ended_at) OVER (PARTITION BY machine_id ORDER BY started_at, downtime_event_id) AS prior FROM downtime_durations WHERE is_failure)""",
    "inspection_defects": f"""SELECT i.quality_inspection_id, i.production_order_id, inspected_at, sample_size, passed_units, failed_units, result, i._batch_id, i._source_file_id, i._record_checksum,
        o.production_line_id, l.factory_id, coalesce(n, 0)::BIGINT AS defect_occurrences, coalesce(crit, 0)::BIGINT AS critical_defect_occurrences, coalesce(cats, 0)::BIGINT AS defect_categories,
        CASE WHEN sample_size <> 0 THEN failed_units::DOUBLE / sample_size END AS sampled_defect_rate
        FROM quality_inspections i JOIN production_orders o ON i.production_order_id = o.production_order_id JOIN production_lines l ON o.production_line_id = l.production_line_id
        LEFT JOIN (SELECT quality_inspection_id, sum(defect_count) AS n, sum(defect_count) FILTER (severity = 'critical') AS crit, count(DISTINCT defect_type) AS cats FROM product_defects GROUP BY 1) d
        ON i.quality_inspection_id = d.quality_inspection_id""",
    "order_performance": f"""SELECT o.* EXCLUDE (updated_at, _source_row_number, _ingested_at), line_name, l.factory_id, factory_name, actual_quantity - planned_quantity AS quantity_variance,
        CASE WHEN planned_quantity <> 0 THEN actual_quantity::DOUBLE / planned_quantity END AS target_attainment_ratio, {_elapsed('actual_start_at', 'actual_end_at', '3.6e9')} AS actual_duration_hours
        FROM production_orders o JOIN production_lines l ON o.production_line_id = l.production_line_id JOIN factories f ON l.factory_id = f.factory_id""",
    "telemetry_enriched": f"""SELECT t.* EXCLUDE (temperature_c, vibration_mm_s, pressure_bar, energy_kwh), temperature_c::DOUBLE AS temperature_c, vibration_mm_s::DOUBLE AS vibration_mm_s, pressure_bar::DOUBLE AS pressure_bar,
        energy_kwh::DOUBLE AS energy_kwh, {CONTEXT}, {_elapsed('event_timestamp', '_ingested_at', '3.6e9')} AS arrival_lag_hours, event_timestamp < _ingested_at - INTERVAL 24 HOURS AS is_late_arrival
        FROM machine_telemetry t JOIN machine_context USING (machine_id)""",
    "dim_factory": "SELECT factory_id, factory_name, country_code, timezone, opened_on, status, updated_at FROM factories",
    "dim_production_line": """SELECT l.factory_id, production_line_id, line_name, product_family, nominal_capacity_per_hour::DOUBLE AS nominal_capacity_per_hour, l.status, l.updated_at, factory_name
        FROM production_lines l JOIN factories f ON l.factory_id = f.factory_id""",
    "dim_machine": """SELECT machine_id, machine_name, machine_type, manufacturer, model, installed_on, machine_status AS status, machine_updated_at AS updated_at, production_line_id, line_name, product_family,
        factory_id, factory_name, country_code, timezone FROM machine_context""",
    "telemetry_daily": f"""SELECT machine_id, {CONTEXT}, event_timestamp::DATE AS telemetry_date, count(*) AS sample_count, avg(temperature_c) AS average_temperature_c, max(temperature_c) AS maximum_temperature_c,
        avg(vibration_mm_s) AS average_vibration_mm_s, quantile_cont(vibration_mm_s, 0.95) AS p95_vibration_mm_s, avg(pressure_bar) AS average_pressure_bar, max(energy_kwh) - min(energy_kwh) AS observed_energy_delta_kwh,
        count(*) FILTER (operating_state = 'running') AS running_sample_count, count(*) FILTER (is_late_arrival) AS late_arrival_count, max(event_timestamp) AS latest_event_at, max(_ingested_at) AS latest_ingested_at
        FROM telemetry_enriched GROUP BY ALL""",
    "factory_performance": """SELECT f.factory_id, f.factory_name, f.country_code, coalesce(planned, 0)::BIGINT AS planned_units, coalesce(actual, 0)::BIGINT AS actual_units, coalesce(completed, 0) AS completed_orders,
        coalesce(active, 0) AS active_or_completed_orders, CASE WHEN coalesce(planned, 0) <> 0 THEN actual::DOUBLE / planned END AS target_attainment_ratio, coalesce(inspected, 0)::BIGINT AS inspected_units,
        coalesce(failed, 0)::BIGINT AS failed_inspected_units, coalesce(defects, 0)::BIGINT AS defect_occurrences, coalesce(critical, 0)::BIGINT AS critical_defect_occurrences,
        CASE WHEN coalesce(inspected, 0) <> 0 THEN failed::DOUBLE / inspected END AS sampled_defect_rate, coalesce(down, 0) AS downtime_hours, coalesce(unplanned, 0) AS unplanned_downtime_hours
        FROM factories f
        LEFT JOIN (SELECT factory_id, sum(planned_quantity) FILTER (status <> 'cancelled') AS planned, coalesce(sum(actual_quantity) FILTER (status <> 'cancelled'), 0) AS actual,
          count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status <> 'cancelled') AS active FROM order_performance GROUP BY 1) o ON f.factory_id = o.factory_id
        LEFT JOIN (SELECT factory_id, sum(sample_size) AS inspected, sum(failed_units) AS failed, sum(defect_occurrences) AS defects, sum(critical_defect_occurrences) AS critical FROM inspection_defects GROUP BY 1) q
          ON f.factory_id = q.factory_id
        LEFT JOIN (SELECT factory_id, sum(downtime_minutes) / 60.0 AS down, sum(downtime_minutes) FILTER (downtime_type = 'unplanned') / 60.0 AS unplanned FROM downtime_durations GROUP BY 1) d ON f.factory_id = d.factory_id""",
    "machine_reliability": f"""SELECT m.machine_id, machine_name, machine_type, machine_status, production_line_id, line_name, factory_id, factory_name, coalesce(breakdowns, 0) AS breakdown_count, coalesce(resolved, 0) AS resolved_breakdown_count,
        mttr AS mean_time_to_repair_hours, mtbf AS mean_time_between_failures_hours, coalesce(down, 0) AS total_downtime_hours, coalesce(unplanned, 0) AS unplanned_downtime_hours, coalesce(opened, 0) AS open_downtime_events,
        coalesce(samples, 0)::BIGINT AS telemetry_sample_count, coalesce(late, 0)::BIGINT AS late_arrival_count, latest AS latest_telemetry_at, ingested AS latest_telemetry_ingested_at,
        {_elapsed('latest', AS_OF, '3.6e9')} AS telemetry_age_hours, latest IS NULL OR latest < {AS_OF} - INTERVAL 6 HOURS AS has_stale_telemetry
        FROM machine_context m
        LEFT JOIN (SELECT machine_id, count(*) AS breakdowns, count(ended_at) AS resolved, avg(repair_minutes) FILTER (ended_at IS NOT NULL) / 60.0 AS mttr, avg(hours_since_previous_failure) AS mtbf FROM failure_intervals GROUP BY 1) f USING (machine_id)
        LEFT JOIN (SELECT machine_id, sum(downtime_minutes) / 60.0 AS down, sum(downtime_minutes) FILTER (downtime_type = 'unplanned') / 60.0 AS unplanned, count(*) FILTER (is_open) AS opened FROM downtime_durations GROUP BY 1) d USING (machine_id)
        LEFT JOIN (SELECT machine_id, count(*) AS samples, count(*) FILTER (is_late_arrival) AS late, max(event_timestamp) AS latest, max(_ingested_at) AS ingested FROM telemetry_enriched GROUP BY 1) t USING (machine_id)""",
    "maintenance_backlog": f"""SELECT machine_id, maintenance_work_order_id, maintenance_type, priority, status, created_at, scheduled_for, technician_id, {CONTEXT}, {_elapsed('created_at', AS_OF, '8.64e10')} AS backlog_age_days,
        scheduled_for < {AS_OF} AS is_overdue FROM maintenance_work_orders JOIN machine_context USING (machine_id) WHERE status IN ('open', 'in_progress')""",
    "downtime_by_reason": """SELECT factory_id, factory_name, production_line_id, line_name, downtime_type, reason_code, count(*) AS downtime_event_count, sum(downtime_minutes) / 60.0 AS downtime_hours,
        avg(downtime_minutes) / 60.0 AS average_event_hours, count(*) FILTER (is_open) AS open_event_count FROM downtime_durations GROUP BY ALL""",
    "inspection_outcomes": """SELECT factory_id, factory_name, inspected_at::DATE AS inspection_date, count(*) AS inspection_count, sum(sample_size)::BIGINT AS inspected_units, sum(passed_units)::BIGINT AS passed_units,
        sum(failed_units)::BIGINT AS failed_units, sum(defect_occurrences)::BIGINT AS defect_occurrences, sum(critical_defect_occurrences)::BIGINT AS critical_defect_occurrences,
        CASE WHEN sum(sample_size) <> 0 THEN sum(failed_units)::DOUBLE / sum(sample_size) END AS sampled_defect_rate FROM inspection_defects JOIN factories USING (factory_id) GROUP BY factory_id, factory_name, inspected_at::DATE""",
}
_WATERMARKS = {
    "production_orders": "coalesce(actual_end_at, planned_start_at)",
    "shifts": "ended_at",
    "machine_telemetry": "event_timestamp",
    "downtime_events": "coalesce(ended_at, started_at)",
    "quality_inspections": "inspected_at",
    "product_defects": "detected_at",
}
MODELS["data_freshness"] = f"""SELECT source_name, i AS latest_ingested_at, e AS latest_event_at, coalesce(e, i) AS latest_recorded_at, {_elapsed('i', AS_OF, '3.6e9')} AS ingestion_age_hours, {_elapsed('e', AS_OF, '3.6e9')} AS event_age_hours,
    CASE WHEN i IS NULL THEN 'missing' WHEN i >= {AS_OF} - INTERVAL 24 HOURS THEN 'fresh' WHEN i >= {AS_OF} - INTERVAL 72 HOURS THEN 'warning' ELSE 'stale' END AS freshness_status
    FROM ({' UNION ALL '.join(f"SELECT '{s}' AS source_name, max(_ingested_at) AS i, max({_WATERMARKS.get(s, 'updated_at')}) AS e FROM {s}" for s in DOMAIN)})"""


def sql(body: str) -> str:
    """body with all domain views and models before it; those unused cost nothing."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in (DOMAIN | MODELS).items()) + "\n" + body
