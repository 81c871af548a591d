"""The layered models: staging, intermediate, dimensions, facts and marts, each one DataFrame function.

A model is a method that takes its inputs from the others, and is built once. The clock is an argument. Facts are aggregated before
they meet a dimension, so that no join multiplies them; small dimensions are left to the planner to broadcast by their size.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import at, count_where, days_between, freshness_class, hours, hours_between, is_stale, minutes_between, ratio, sum_where

LINEAGE_TYPES = {"_batch_id": "string", "_source_file_id": "string", "_source_row_number": "long", "_ingested_at": "timestamp_ntz", "_record_checksum": "string"}

#: The typed columns of each source; the first is its key.
STAGING = {
    "factories": "factory_id string, factory_name string, country_code string, timezone string, opened_on date, status string, updated_at timestamp_ntz",
    "production_lines": "production_line_id string, factory_id string, line_name string, product_family string, nominal_capacity_per_hour decimal(12,3), status string, updated_at timestamp_ntz",
    "machines": "machine_id string, production_line_id string, machine_name string, machine_type string, manufacturer string, model string, installed_on date, status string, updated_at timestamp_ntz",
    "shifts": "shift_id string, factory_id string, shift_name string, started_at timestamp_ntz, ended_at timestamp_ntz, operator_id string, updated_at timestamp_ntz",
    "production_orders": "production_order_id string, production_line_id string, product_code string, planned_start_at timestamp_ntz, planned_end_at timestamp_ntz, actual_start_at timestamp_ntz, actual_end_at timestamp_ntz, planned_quantity long, actual_quantity long, status string, updated_at timestamp_ntz",
    "machine_telemetry": "telemetry_id string, machine_id string, event_timestamp timestamp_ntz, temperature_c decimal(8,3), vibration_mm_s decimal(8,3), pressure_bar decimal(9,3), energy_kwh decimal(12,3), operating_state string, updated_at timestamp_ntz",
    "downtime_events": "downtime_event_id string, machine_id string, started_at timestamp_ntz, ended_at timestamp_ntz, downtime_type string, reason_code string, updated_at timestamp_ntz",
    "maintenance_work_orders": "maintenance_work_order_id string, machine_id string, created_at timestamp_ntz, scheduled_for timestamp_ntz, completed_at timestamp_ntz, maintenance_type string, priority string, status string, technician_id string, updated_at timestamp_ntz",
    "quality_inspections": "quality_inspection_id string, production_order_id string, inspected_at timestamp_ntz, sample_size long, passed_units long, failed_units long, result string, inspector_id string, updated_at timestamp_ntz",
    "product_defects": "product_defect_id string, quality_inspection_id string, detected_at timestamp_ntz, defect_type string, severity string, defect_count long, updated_at timestamp_ntz",
}
STAGING = {k: dict(x.split(" ") for x in v.split(", ")) for k, v in STAGING.items()}

#: What counts as a source's latest event.
WATERMARKS = {
    "factories": "updated_at",
    "production_lines": "updated_at",
    "machines": "updated_at",
    "shifts": "ended_at",
    "production_orders": "coalesce(actual_end_at, planned_start_at)",
    "machine_telemetry": "event_timestamp",
    "downtime_events": "coalesce(ended_at, started_at)",
    "maintenance_work_orders": "updated_at",
    "quality_inspections": "inspected_at",
    "product_defects": "detected_at",
}
KEPT = ("_batch_id", "_source_file_id", "_record_checksum")
CONTEXT = ("machine_name", "machine_type", "production_line_id", "line_name", "factory_id", "factory_name")


def stage(source: str, raw: DataFrame) -> DataFrame:
    """A source's declared columns and lineage, cast to their types."""
    return raw.select(*(F.col(c).cast(t).alias(c) for c, t in (STAGING[source] | LINEAGE_TYPES).items()))


class Models:
    def __init__(self, raw: Mapping[str, DataFrame], as_of: str, checks: DataFrame | None = None) -> None:
        self.raw, self.as_of, self.checks = raw, at(as_of), checks
        self._staged: dict[str, DataFrame] = {}
        self.stored: set[str] = set()

    def store(self, name: str, table: DataFrame) -> None:
        """A model's stored table, which the models below read from now on."""
        self.__dict__[name] = table
        self.stored.add(name)

    def stg(self, source: str) -> DataFrame:
        if source not in self._staged:
            self._staged[source] = stage(source, self.raw[source])
        return self._staged[source]

    @cached_property
    def int_machine_context(self) -> DataFrame:
        m = self.stg("machines").select("machine_id", "production_line_id", "machine_name", "machine_type", "manufacturer", "model", "installed_on", F.col("status").alias("machine_status"), F.col("updated_at").alias("machine_updated_at"))
        line = self.stg("production_lines").select("production_line_id", "factory_id", "line_name", "product_family", "nominal_capacity_per_hour", F.col("status").alias("production_line_status"))
        f = self.stg("factories").select("factory_id", "factory_name", "country_code", "timezone", F.col("status").alias("factory_status"))
        return m.join(line, "production_line_id").join(f, "factory_id")

    def _downtime(self, events: DataFrame) -> DataFrame:
        return events.select(
            "*",
            minutes_between(F.col("started_at"), F.coalesce("ended_at", self.as_of)).alias("downtime_minutes"),
            ((F.col("downtime_type") == "unplanned") & (F.col("reason_code") == "breakdown")).alias("is_failure"),
            F.col("ended_at").isNull().alias("is_open"),
        )

    @cached_property
    def int_downtime_durations(self) -> DataFrame:
        d = self.stg("downtime_events").select("downtime_event_id", "machine_id", "started_at", "ended_at", "downtime_type", "reason_code", *KEPT)
        return self._downtime(d.join(self.int_machine_context.select("machine_id", *CONTEXT), "machine_id"))

    @cached_property
    def int_machine_failure_intervals(self) -> DataFrame:
        return self._failures(self.int_downtime_durations, "factory_id", "production_line_id")

    def _failures(self, downtime: DataFrame, *more: str) -> DataFrame:
        before = F.lag("ended_at").over(W.partitionBy("machine_id").orderBy("started_at", "downtime_event_id"))
        gap = F.when(F.col("_before").isNotNull(), F.greatest(F.lit(0.0), hours_between(F.col("_before"), F.col("started_at"))))
        return (
            downtime.filter("is_failure")
            .select("downtime_event_id", "machine_id", *more, "started_at", "ended_at", F.col("downtime_minutes").alias("repair_minutes"), before.alias("_before"))
            .withColumn("hours_since_previous_failure", gap)
            .drop("_before")
        )

    @cached_property
    def int_inspection_defects(self) -> DataFrame:
        defects = self.stg("product_defects").groupBy("quality_inspection_id").agg(
            F.sum("defect_count").alias("occurrences"), sum_where(F.col("defect_count"), F.col("severity") == "critical").alias("critical"), F.countDistinct("defect_type").alias("categories")
        )
        i = self.stg("quality_inspections").select("quality_inspection_id", "production_order_id", "inspected_at", "sample_size", "passed_units", "failed_units", "result", *KEPT)
        o = self.stg("production_orders").select("production_order_id", "production_line_id")
        line = self.stg("production_lines").select("production_line_id", "factory_id")
        return (
            i.join(o, "production_order_id")
            .join(line, "production_line_id")
            .join(defects, "quality_inspection_id", "left")
            .select(
                *(c for c in i.columns),
                "production_line_id",
                "factory_id",
                F.coalesce("occurrences", F.lit(0)).alias("defect_occurrences"),
                F.coalesce("critical", F.lit(0)).alias("critical_defect_occurrences"),
                F.coalesce("categories", F.lit(0)).alias("defect_categories"),
                ratio(F.col("failed_units"), F.col("sample_size")).alias("sampled_defect_rate"),
            )
        )

    @cached_property
    def int_order_performance(self) -> DataFrame:
        o = self.stg("production_orders").drop("updated_at", "_source_row_number", "_ingested_at")
        line = self.stg("production_lines").select("production_line_id", "line_name", "factory_id")
        f = self.stg("factories").select("factory_id", "factory_name")
        return (
            o.join(line, "production_line_id")
            .join(f, "factory_id")
            .select(
                "*",
                (F.col("actual_quantity") - F.col("planned_quantity")).alias("quantity_variance"),
                ratio(F.col("actual_quantity"), F.col("planned_quantity")).alias("target_attainment_ratio"),
                hours_between(F.col("actual_start_at"), F.col("actual_end_at")).alias("actual_duration_hours"),
            )
        )

    def telemetry_rows(self, telemetry: DataFrame) -> DataFrame:
        """Staged telemetry, all or a slice, with its machine's context and its lag."""
        return telemetry.join(self.int_machine_context.select("machine_id", *CONTEXT), "machine_id").select(
            "*", hours_between(F.col("event_timestamp"), F.col("_ingested_at")).alias("arrival_lag_hours"), self._is_late().alias("is_late_arrival")
        )

    def _is_late(self) -> Column:
        return F.col("event_timestamp") < F.col("_ingested_at") - hours(24)

    @cached_property
    def int_machine_telemetry(self) -> DataFrame:
        return self.telemetry_rows(self.stg("machine_telemetry"))

    @cached_property
    def dim_factory(self) -> DataFrame:
        return self.stg("factories").select("factory_id", "factory_name", "country_code", "timezone", "opened_on", "status", "updated_at")

    @cached_property
    def dim_production_line(self) -> DataFrame:
        line = self.stg("production_lines").select("production_line_id", "line_name", "factory_id", "product_family", "nominal_capacity_per_hour", "status", "updated_at")
        return line.join(self.stg("factories").select("factory_id", "factory_name"), "factory_id")

    @cached_property
    def dim_machine(self) -> DataFrame:
        return self.int_machine_context.withColumnsRenamed({"machine_status": "status", "machine_updated_at": "updated_at"}).select(
            "machine_id", "machine_name", "machine_type", "manufacturer", "model", "installed_on", "status", "updated_at", "production_line_id", "line_name", "product_family", "factory_id", "factory_name", "country_code", "timezone"
        )

    @cached_property
    def fct_downtime(self) -> DataFrame:
        return self.int_downtime_durations

    @cached_property
    def fct_production_output(self) -> DataFrame:
        return self.int_order_performance

    @cached_property
    def fct_quality_inspections(self) -> DataFrame:
        return self.int_inspection_defects

    @cached_property
    def fct_machine_telemetry_daily(self) -> DataFrame:
        return self.int_machine_telemetry.groupBy("machine_id", *CONTEXT, F.to_date("event_timestamp").alias("telemetry_date")).agg(
            F.count("*").alias("sample_count"),
            F.avg(F.col("temperature_c").cast("double")).alias("average_temperature_c"),
            F.max("temperature_c").alias("maximum_temperature_c"),
            F.avg(F.col("vibration_mm_s").cast("double")).alias("average_vibration_mm_s"),
            F.percentile(F.col("vibration_mm_s").cast("double"), F.lit(0.95)).alias("p95_vibration_mm_s"),
            F.avg(F.col("pressure_bar").cast("double")).alias("average_pressure_bar"),
            (F.max("energy_kwh") - F.min("energy_kwh")).alias("observed_energy_delta_kwh"),
            count_where(F.col("operating_state") == "running").alias("running_sample_count"),
            count_where(F.col("is_late_arrival")).alias("late_arrival_count"),
            F.max("event_timestamp").alias("latest_event_at"),
            F.max("_ingested_at").alias("latest_ingested_at"),
        )

    @cached_property
    def factory_performance(self) -> DataFrame:
        going = F.col("status") != "cancelled"
        output = self.fct_production_output.groupBy("factory_id").agg(
            sum_where(F.col("planned_quantity"), going).alias("planned"),
            F.coalesce(sum_where(F.col("actual_quantity"), going), F.lit(0)).alias("actual"),
            count_where(F.col("status") == "completed").alias("completed"),
            count_where(going).alias("active"),
        )
        quality = self.fct_quality_inspections.groupBy("factory_id").agg(
            F.sum("sample_size").alias("inspected"), F.sum("failed_units").alias("failed"), F.sum("defect_occurrences").alias("defects"), F.sum("critical_defect_occurrences").alias("critical")
        )
        downtime = self.fct_downtime.groupBy("factory_id").agg(
            (F.sum("downtime_minutes") / 60.0).alias("down"), (sum_where(F.col("downtime_minutes"), F.col("downtime_type") == "unplanned") / 60.0).alias("unplanned")
        )
        zero = lambda c, name, none=0: F.coalesce(F.col(c), F.lit(none)).alias(name)
        return (
            self.dim_factory.select("factory_id", "factory_name", "country_code")
            .join(output, "factory_id", "left")
            .join(quality, "factory_id", "left")
            .join(downtime, "factory_id", "left")
            .select(
                "factory_id",
                "factory_name",
                "country_code",
                zero("planned", "planned_units"),
                zero("actual", "actual_units"),
                zero("completed", "completed_orders"),
                zero("active", "active_or_completed_orders"),
                ratio(F.col("actual"), F.coalesce("planned", F.lit(0))).alias("target_attainment_ratio"),
                zero("inspected", "inspected_units"),
                zero("failed", "failed_inspected_units"),
                zero("defects", "defect_occurrences"),
                zero("critical", "critical_defect_occurrences"),
                ratio(F.col("failed"), F.coalesce("inspected", F.lit(0))).alias("sampled_defect_rate"),
                zero("down", "downtime_hours", 0.0),
                zero("unplanned", "unplanned_downtime_hours", 0.0),
            )
        )

    @cached_property
    def machine_reliability(self) -> DataFrame:
        # facts are aggregated by machine before they meet the dimension, which alone decides on machines: where the facts aren't
        # stored tables, their context isn't joined for it
        closed = F.col("ended_at").isNotNull()
        events = self.fct_downtime if "fct_downtime" in self.stored else self._downtime(self.stg("downtime_events"))
        failures = self._failures(events).groupBy("machine_id").agg(
            F.count("*").alias("breakdowns"),
            count_where(closed).alias("resolved"),
            (F.avg(F.when(closed, F.col("repair_minutes"))) / 60.0).alias("mean_time_to_repair_hours"),
            F.avg("hours_since_previous_failure").alias("mean_time_between_failures_hours"),
        )
        downtime = events.groupBy("machine_id").agg(
            (F.sum("downtime_minutes") / 60.0).alias("down"),
            (sum_where(F.col("downtime_minutes"), F.col("downtime_type") == "unplanned") / 60.0).alias("unplanned"),
            count_where(F.col("is_open")).alias("open_events"),
        )
        if "fct_machine_telemetry_daily" in self.stored:
            daily = self.fct_machine_telemetry_daily
        else:
            daily = self.stg("machine_telemetry").select("machine_id", F.lit(1).alias("sample_count"), self._is_late().cast("int").alias("late_arrival_count"), F.col("event_timestamp").alias("latest_event_at"), F.col("_ingested_at").alias("latest_ingested_at"))
        telemetry = daily.groupBy("machine_id").agg(
            F.sum("sample_count").alias("samples"), F.sum("late_arrival_count").alias("late"), F.max("latest_event_at").alias("latest_telemetry_at"), F.max("latest_ingested_at").alias("latest_telemetry_ingested_at")
        )
        zero = lambda c, name, none=0: F.coalesce(F.col(c), F.lit(none)).alias(name)
        return (
            self.dim_machine.select("machine_id", "machine_name", "machine_type", F.col("status").alias("machine_status"), "production_line_id", "line_name", "factory_id", "factory_name")
            .join(failures, "machine_id", "left")
            .join(downtime, "machine_id", "left")
            .join(telemetry, "machine_id", "left")
            .select(
                "machine_id",
                "machine_name",
                "machine_type",
                "machine_status",
                "production_line_id",
                "line_name",
                "factory_id",
                "factory_name",
                zero("breakdowns", "breakdown_count"),
                zero("resolved", "resolved_breakdown_count"),
                "mean_time_to_repair_hours",
                "mean_time_between_failures_hours",
                zero("down", "total_downtime_hours", 0.0),
                zero("unplanned", "unplanned_downtime_hours", 0.0),
                zero("open_events", "open_downtime_events"),
                zero("samples", "telemetry_sample_count"),
                zero("late", "late_arrival_count"),
                "latest_telemetry_at",
                "latest_telemetry_ingested_at",
                hours_between(F.col("latest_telemetry_at"), self.as_of).alias("telemetry_age_hours"),
                is_stale(F.col("latest_telemetry_at"), self.as_of).alias("has_stale_telemetry"),
            )
        )

    @cached_property
    def maintenance_backlog(self) -> DataFrame:
        w = self.stg("maintenance_work_orders").filter(F.col("status").isin("open", "in_progress"))
        w = w.select("maintenance_work_order_id", "machine_id", "maintenance_type", "priority", "status", "created_at", "scheduled_for", "technician_id")
        return w.join(self.int_machine_context.select("machine_id", *CONTEXT), "machine_id").select(
            "*", days_between(F.col("created_at"), self.as_of).alias("backlog_age_days"), (F.col("scheduled_for") < self.as_of).alias("is_overdue")
        )

    @cached_property
    def downtime_by_reason(self) -> DataFrame:
        return self.fct_downtime.groupBy("factory_id", "factory_name", "production_line_id", "line_name", "downtime_type", "reason_code").agg(
            F.count("*").alias("downtime_event_count"),
            (F.sum("downtime_minutes") / 60.0).alias("downtime_hours"),
            (F.avg("downtime_minutes") / 60.0).alias("average_event_hours"),
            count_where(F.col("is_open")).alias("open_event_count"),
        )

    @cached_property
    def inspection_outcomes(self) -> DataFrame:
        sums = {c: F.sum(s).alias(c) for c, s in (("inspected_units", "sample_size"), ("passed_units", "passed_units"), ("failed_units", "failed_units"), ("defect_occurrences", "defect_occurrences"), ("critical_defect_occurrences", "critical_defect_occurrences"))}
        return (
            self.fct_quality_inspections.join(self.dim_factory.select("factory_id", "factory_name"), "factory_id")
            .groupBy("factory_id", "factory_name", F.to_date("inspected_at").alias("inspection_date"))
            .agg(F.count("*").alias("inspection_count"), *sums.values())
            .withColumn("sampled_defect_rate", ratio(F.col("failed_units"), F.col("inspected_units")))
        )

    @cached_property
    def data_freshness(self) -> DataFrame:
        parts = [
            self.stg(s).agg(F.max("_ingested_at").alias("latest_ingested_at"), F.max(F.expr(e)).alias("latest_event_at")).select(F.lit(s).alias("source_name"), "*")
            for s, e in WATERMARKS.items()
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select(
            "*",
            F.coalesce("latest_event_at", "latest_ingested_at").alias("latest_recorded_at"),
            hours_between(F.col("latest_ingested_at"), self.as_of).alias("ingestion_age_hours"),
            hours_between(F.col("latest_event_at"), self.as_of).alias("event_age_hours"),
            freshness_class(F.col("latest_ingested_at"), self.as_of).alias("freshness_status"),
        )

    @cached_property
    def data_quality_trends(self) -> DataFrame:
        status = F.col("status")
        return self.checks.groupBy(F.to_date("occurred_at").alias("quality_date"), "check_type", "scope").agg(
            F.count("*").alias("check_count"),
            count_where(status == "passed").alias("passed_check_count"),
            count_where(status == "failed").alias("failed_check_count"),
            count_where(status == "warning").alias("warning_check_count"),
            count_where((F.col("severity") == "error") & (status == "failed")).alias("error_check_count"),
        )
