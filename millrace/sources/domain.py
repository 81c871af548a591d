"""The ten industrial sources as views over the driver's star schema, with lineage columns, as raw tables hold them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One clock for every query over these tables.
AS_OF = "2024-02-01 00:00:00"


def _id(prefix: str, key: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), width, "0"))


def _time(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def _lineage(source: str, key: Column, ingested: Column) -> list[Column]:
    return [
        F.lit("batch-1").alias("_batch_id"),
        F.lit(f"file-{source}").alias("_source_file_id"),
        (key + 2).cast("long").alias("_source_row_number"),
        ingested.alias("_ingested_at"),
        F.sha2(F.concat_ws("|", F.lit(source), key.cast("string")), 256).alias("_record_checksum"),
    ]


def _pick(index: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def factories(t: Callable[[str], DataFrame]) -> DataFrame:
    k = F.col("n_nationkey")
    return t("nation").select(
        _id("FAC-", k, 3).alias("factory_id"),
        F.col("n_name").alias("factory_name"),
        F.col("n_regionkey").cast("string").alias("country_code"),
        _pick(k, "Europe/Budapest", "Europe/Berlin", "Europe/Prague").alias("timezone"),
        F.date_add(F.lit("2000-01-01").cast("date"), k).alias("opened_on"),
        _pick(k, "inactive", "active", "active", "active").alias("status"),
        (_time("2024-01-20 00:00:00") + _hours(k)).alias("updated_at"),
        *_lineage("factories", k, _time("2024-01-31 12:00:00")),
    )


def production_lines(t: Callable[[str], DataFrame]) -> DataFrame:
    k = F.col("s_suppkey")
    return t("supplier").select(
        _id("LINE-", k, 6).alias("production_line_id"),
        _id("FAC-", F.col("s_nationkey"), 3).alias("factory_id"),
        F.col("s_name").alias("line_name"),
        _pick(k, "motor", "pump", "gearbox").alias("product_family"),
        (k % 50 + 100).cast("int").alias("nominal_capacity_per_hour"),
        _pick(k, "active", "active", "inactive").alias("status"),
        (_time("2024-01-21 00:00:00") + _hours(k % 48)).alias("updated_at"),
        *_lineage("production_lines", k, _time("2024-01-31 12:00:00")),
    )


def machines(t: Callable[[str], DataFrame]) -> DataFrame:
    k = F.col("c_custkey")
    return t("customer").select(
        _id("MCH-", k, 6).alias("machine_id"),
        _id("LINE-", k % 10, 6).alias("production_line_id"),
        F.col("c_name").alias("machine_name"),
        F.lower("c_mktsegment").alias("machine_type"),
        F.concat(F.lit("MAKER-"), (k % 4).cast("string")).alias("manufacturer"),
        F.concat(F.lit("MODEL-"), (k % 7).cast("string")).alias("model"),
        F.date_add(F.lit("2015-01-01").cast("date"), (k % 2000).cast("int")).alias("installed_on"),
        _pick(k, "active", "maintenance", "active", "retired", "active").alias("status"),
        (_time("2024-01-01 00:00:00") + _hours(k % 700)).alias("updated_at"),
        *_lineage("machines", k, _time("2024-01-30 12:00:00")),
    )


def shifts(t: Callable[[str], DataFrame]) -> DataFrame:
    days = t("nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("day")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("slot"))
    k = F.col("n_nationkey") * 90 + F.col("day") * 3 + F.col("slot")
    start = _time("2024-01-01 06:00:00") + _hours(F.col("day") * 24 + F.col("slot") * 8)
    return days.select(
        _id("SHF-", k, 6).alias("shift_id"),
        _id("FAC-", F.col("n_nationkey"), 3).alias("factory_id"),
        _pick(F.col("slot"), "morning", "afternoon", "night").alias("shift_name"),
        start.alias("started_at"),
        (start + _hours(F.lit(8))).alias("ended_at"),
        _id("OPR-", k % 40, 3).alias("operator_id"),
        (start + _hours(F.lit(9))).alias("updated_at"),
        *_lineage("shifts", k, start + _hours(F.lit(10))),
    )


def production_orders(t: Callable[[str], DataFrame]) -> DataFrame:
    sums = t("lineitem").groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("open_qty"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("done_qty")
    )
    k, start = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    status = F.when(F.col("o_orderpriority") == "5-LOW", "cancelled").when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("planned")
    begun = status.isin("completed", "in_progress")
    return (
        t("orders")
        .join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            _id("ORD-", k, 8).alias("production_order_id"),
            _id("LINE-", F.col("o_custkey") % 10, 6).alias("production_line_id"),
            F.concat(F.lit("PROD-"), (k % 25).cast("string")).alias("product_code"),
            start.alias("planned_start_at"),
            (start + _hours(F.lit(48))).alias("planned_end_at"),
            F.when(begun, start + _hours(F.lit(1))).alias("actual_start_at"),
            F.when(status == "completed", start + _hours(k % 72 + 2)).alias("actual_end_at"),
            F.coalesce("open_qty", F.lit(0.0)).cast("long").alias("planned_quantity"),
            F.coalesce("done_qty", F.lit(0.0)).cast("long").alias("actual_quantity"),
            status.alias("status"),
            (start + _hours(F.lit(80))).alias("updated_at"),
            *_lineage("production_orders", k, start + _hours(F.lit(96))),
        )
    )


def quality_inspections(t: Callable[[str], DataFrame]) -> DataFrame:
    k = F.col("l_orderkey")
    per = t("lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").cast("long").alias("sample"), F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), F.lit(0.0)).cast("long").alias("failed"), F.min("l_shipdate").cast("timestamp_ntz").alias("first")
    )
    return per.select(
        _id("QIN-", k, 8).alias("quality_inspection_id"),
        _id("ORD-", k, 8).alias("production_order_id"),
        F.col("first").alias("inspected_at"),
        F.col("sample").alias("sample_size"),
        (F.col("sample") - F.col("failed")).alias("passed_units"),
        F.col("failed").alias("failed_units"),
        F.when(F.col("failed") == 0, "pass").otherwise("fail").alias("result"),
        _id("INS-", k % 30, 3).alias("inspector_id"),
        (F.col("first") + _hours(F.lit(1))).alias("updated_at"),
        *_lineage("quality_inspections", k, F.col("first") + _hours(F.lit(6))),
    )


def product_defects(t: Callable[[str], DataFrame]) -> DataFrame:
    qty, at = F.col("l_quantity"), F.col("l_shipdate").cast("timestamp_ntz")
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return t("lineitem").filter("l_returnflag = 'R'").select(
        _id("DEF-", k, 9).alias("product_defect_id"),
        _id("QIN-", F.col("l_orderkey"), 8).alias("quality_inspection_id"),
        at.alias("detected_at"),
        F.when(qty < 20, "surface").when(qty < 40, "assembly").otherwise("functional").alias("defect_type"),
        F.when(F.col("l_linestatus") == "F", "critical").otherwise("minor").alias("severity"),
        qty.cast("long").alias("defect_count"),
        (at + _hours(F.lit(2))).alias("updated_at"),
        *_lineage("product_defects", k, at + _hours(F.lit(8))),
    )


def downtime_events(t: Callable[[str], DataFrame]) -> DataFrame:
    k, start = F.col("event_id"), F.col("ts").cast("timestamp_ntz")
    end = start + F.make_dt_interval(F.lit(0), F.lit(0), F.floor("value").cast("int"))
    return t("events").filter("event_type = 'error'").select(
        _id("DWN-", k, 9).alias("downtime_event_id"),
        _id("MCH-", F.col("user_id"), 6).alias("machine_id"),
        start.alias("started_at"),
        F.when(k % 13 != 0, end).alias("ended_at"),
        F.when(k % 3 == 0, "planned").otherwise("unplanned").alias("downtime_type"),
        F.when(k % 2 == 0, "breakdown").otherwise("maintenance").alias("reason_code"),
        (start + _hours(F.lit(3))).alias("updated_at"),
        *_lineage("downtime_events", k, start + _hours(F.lit(4))),
    )


def machine_telemetry(t: Callable[[str], DataFrame]) -> DataFrame:
    k, at, v = F.col("event_id"), F.col("ts").cast("timestamp_ntz"), F.col("value")
    return t("events").select(
        _id("TEL-", k, 9).alias("telemetry_id"),
        _id("MCH-", F.col("user_id"), 6).alias("machine_id"),
        at.alias("event_timestamp"),
        v.cast("decimal(8,3)").alias("temperature_c"),
        v.cast("decimal(8,3)").alias("vibration_mm_s"),
        (k % 500).cast("decimal(9,3)").alias("pressure_bar"),
        (k % 1000).cast("decimal(12,3)").alias("energy_kwh"),
        F.when(F.col("event_type").isin("purchase", "view"), "running").when(F.col("event_type") == "error", "stopped").otherwise("idle").alias("operating_state"),
        (at + _hours(k % 30)).alias("updated_at"),
        *_lineage("machine_telemetry", k, at + _hours(k % 50)),
    )


def maintenance_work_orders(t: Callable[[str], DataFrame]) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("completed")
    return t("orders").select(
        _id("MWO-", k, 8).alias("maintenance_work_order_id"),
        _id("MCH-", F.col("o_custkey"), 6).alias("machine_id"),
        at.alias("created_at"),
        (at + _hours(F.lit(720))).alias("scheduled_for"),
        F.when(status == "completed", at + _hours(k % 900)).alias("completed_at"),
        _pick(k, "preventive", "corrective", "inspection").alias("maintenance_type"),
        F.lower(F.substring("o_orderpriority", 3, 20)).alias("priority"),
        status.alias("status"),
        _id("TEC-", k % 20, 3).alias("technician_id"),
        (at + _hours(F.lit(900))).alias("updated_at"),
        *_lineage("maintenance_work_orders", k, at + _hours(F.lit(901))),
    )


SOURCES = (factories, production_lines, machines, shifts, production_orders, machine_telemetry, downtime_events, maintenance_work_orders, quality_inspections, product_defects)


class Sources(Mapping[str, DataFrame]):
    """Every source by name, made when it is first asked for; a query pays for those it reads. A table's schema is read once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._home = spark, sf_dir
        self._made = {f.__name__: f for f in SOURCES}
        self._tables: dict[str, DataFrame] = {}
        self._found: dict[str, DataFrame] = {}

    def _table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._spark.read.parquet(f"{self._home}/{name}.parquet")
        return self._tables[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._found:
            self._found[name] = self._made[name](self._table)
        return self._found[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._made)

    def __len__(self) -> int:
        return len(self._made)


def raw_tables(spark: SparkSession, sf_dir: str) -> Sources:
    """The sources over the tables of a folder; each is lazy and reads only the columns it needs."""
    return Sources(spark, sf_dir)
