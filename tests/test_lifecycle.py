"""Files to tables: healthy, replay, incident, recovery; and files that aren't a batch."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import checks
from millrace.operators.ledger import create_incident, resolve_incident
from millrace.operators.tables import upsert_checks
from millrace.operators.versions import Store
from millrace.plans import graph, lifecycle
from millrace.plans.lifecycle import backfill, run_batch
from millrace.sources import csv_batch

HEADERS = {
    "factories": "factory_id,factory_name,country_code,timezone,opened_on,status,updated_at",
    "production_lines": "production_line_id,factory_id,line_name,product_family,nominal_capacity_per_hour,status,updated_at",
    "machines": "machine_id,production_line_id,machine_name,machine_type,manufacturer,model,installed_on,status,updated_at",
    "shifts": "shift_id,factory_id,shift_name,started_at,ended_at,operator_id,updated_at",
    "production_orders": "production_order_id,production_line_id,product_code,planned_start_at,planned_end_at,actual_start_at,actual_end_at,planned_quantity,actual_quantity,status,updated_at",
    "machine_telemetry": "telemetry_id,machine_id,event_timestamp,temperature_c,vibration_mm_s,pressure_bar,energy_kwh,operating_state,updated_at",
    "downtime_events": "downtime_event_id,machine_id,started_at,ended_at,downtime_type,reason_code,updated_at",
    "maintenance_work_orders": "maintenance_work_order_id,machine_id,created_at,scheduled_for,completed_at,maintenance_type,priority,status,technician_id,updated_at",
    "quality_inspections": "quality_inspection_id,production_order_id,inspected_at,sample_size,passed_units,failed_units,result,inspector_id,updated_at",
    "product_defects": "product_defect_id,quality_inspection_id,detected_at,defect_type,severity,defect_count,updated_at",
}
T = "2024-01-31T10:00:00Z"
ROWS = {
    "factories": [f"FAC-001,One,HU,Europe/Budapest,2020-01-01,active,{T}"],
    "production_lines": [f"LINE-001,FAC-001,L,pump,10,active,{T}"],
    "machines": [f'MCH-001,LINE-001,"A ""big"", one",cnc,M,X,2021-01-01,active,{T}'],
    "shifts": [f"SHF-001,FAC-001,morning,2024-01-31T06:00:00Z,2024-01-31T09:00:00Z,OPR-001,{T}"],
    "production_orders": [f"ORD-001,LINE-001,PRD-001,2024-01-30T00:00:00Z,2024-01-31T00:00:00Z,,,100,90,completed,{T}"],
    "machine_telemetry": [f"TEL-00{i},MCH-001,2024-01-31T0{i}:00:00Z,20.5,1.25,3,{i},running,{T}" for i in range(1, 4)],
    "downtime_events": [f"DWN-001,MCH-001,2024-01-31T01:00:00Z,2024-01-31T02:00:00Z,unplanned,breakdown,{T}"],
    "maintenance_work_orders": [f"MWO-001,MCH-001,2024-01-30T00:00:00Z,2024-02-10T00:00:00Z,,preventive,low,open,TEC-001,{T}"],
    "quality_inspections": [f"QIN-001,ORD-001,2024-01-31T05:00:00Z,10,9,1,fail,INS-001,{T}"],
    "product_defects": [f"DEF-001,QIN-001,2024-01-31T06:00:00Z,surface,critical,2,{T}"],
}
NOW = "2024-01-31 12:00:00"


def write(folder, rows, headers=HEADERS):
    folder.mkdir()
    for source, lines in rows.items():
        (folder / f"{source}.csv").write_text("\n".join([headers[source], *lines]) + "\n")
    return f"file://{folder}"


def test_lifecycle(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    good = write(tmp_path / "good", ROWS)
    first = run_batch(spark, store, good, "2024-01-31-historical-clean", "run-1", NOW)
    assert (first.status, first.accepted, first.quarantined, first.skipped, first.failed_checks, first.freshness) == ("healthy", 12, 0, 0, 0, "fresh")
    replay = run_batch(spark, store, good, "2024-01-31-historical-clean", "run-2", NOW)
    assert (replay.status, replay.accepted, replay.skipped) == ("healthy", 0, 10)
    bad = ROWS | {
        "machine_telemetry": [*ROWS["machine_telemetry"], ROWS["machine_telemetry"][0], f"TEL-009,MCH-001,2024-01-31T09:00:00Z,999,1,3,1,running,{T}"],
        "production_orders": [ROWS["production_orders"][0].replace(",90,", ",175,")],
        "maintenance_work_orders": [ROWS["maintenance_work_orders"][0].replace(",TEC-001", "")],
    }
    headers = HEADERS | {"maintenance_work_orders": HEADERS["maintenance_work_orders"].replace(",technician_id", "")}
    worse = run_batch(spark, store, write(tmp_path / "bad", bad, headers), "2024-02-01-incremental-incident", "run-3", NOW)
    assert (worse.status, worse.accepted, worse.quarantined, worse.skipped) == ("failed", 4, 3, 7)
    failed = {r[0] for r in store.read("quality_results").filter("run_id = 'run-3' and status = 'failed'").select("check_id").collect()}
    below = {"not_null:factory_performance.factory_id", "unique:factory_performance.factory_id", "non_negative:factory_performance.unplanned_downtime_hours"}
    assert failed == {"schema:maintenance_work_orders", "plan_overrun:fct_production_output.actual_quantity"} | below  # those below are skipped
    assert {r["observed_value"] for r in store.read("quality_results").filter("run_id = 'run-3' and scope = 'factory_performance'").collect()} == {"skipped"}
    assert store.read("raw_maintenance_work_orders").count() == 1  # as before
    codes = {r[0] for r in store.read("quarantine").selectExpr("explode(reasons.code)").collect()}
    assert codes == {"duplicate_identifier", "out_of_range", "missing_required_column"}
    fixed = ROWS | {"production_orders": [ROWS["production_orders"][0].replace(",90,", ",95,").replace(T, "2024-01-31T11:00:00Z")]}
    last = run_batch(spark, store, write(tmp_path / "fixed", fixed), "2024-02-01-incremental-recovery", "run-4", NOW)
    assert (last.status, last.accepted, last.skipped) == ("healthy", 1, 9)
    assert store.read("raw_production_orders").first()["actual_quantity"] == 95
    assert store.read("factory_performance").first()["actual_units"] == 95
    assert [r[0] for r in store.read("pipeline_runs").orderBy("run_id").select("status").collect()] == ["healthy", "healthy", "failed", "healthy"]
    # every check of every run is there; the run's own row is final
    ended = {r["run_id"]: r for r in store.read("pipeline_runs").collect()}
    assert ended["run-3"]["source_row_count"] == 7 and ended["run-3"]["finished_at"] is not None and ended["run-3"]["failed_checks"] == 5
    kinds = {r[0]: r[1] for r in store.read("quality_results").filter("run_id = 'run-4'").groupBy("check_type").count().collect()}
    assert kinds["model_test"] == 174 and kinds["freshness"] == 10 and kinds["volume"] == 1
    assert {r[0] for r in store.read("pipeline_stages").filter("run_id = 'run-4' and duration_seconds >= 0").select("stage_name").collect()} == {"register", "load", "build", "check"}
    # the catalogue and its lineage are stored once a run
    assert store.read("models").filter("run_id = 'run-4'").count() == 31 and store.read("lineage_edges").filter("run_id = 'run-4'").count() == graph.edges(spark).count()
    assert "not_null" in store.read("model_columns").filter("run_id = 'run-4' and model_name = 'dim_machine' and column_name = 'machine_id'").first()["tests"]
    for model in ("dim_factory", "fct_production_output", "fct_machine_telemetry_daily", "machine_history", "data_quality_trends", "int_machine_telemetry"):
        assert store.read(model).count() > 0
    assert store.read("fct_production_output").first()["actual_quantity"] == 95


def test_two_batches_keep_history_and_increments(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    run_batch(spark, store, write(tmp_path / "one", ROWS), "2024-01-31-historical-clean", "run-1", NOW)
    before = store.manifest()
    later = "2024-02-01T10:00:00Z"
    telemetry = [f"TEL-101,MCH-001,2024-02-01T08:00:00Z,21,1,3,9,running,{later}", f"TEL-001,MCH-001,2024-01-31T01:00:00Z,33,1.25,3,1,running,{later}", f"TEL-102,MCH-001,2023-12-01T08:00:00Z,21,1,3,9,running,{later}"]
    rows = ROWS | {"machine_telemetry": telemetry, "machines": [ROWS["machines"][0].replace("active", "retired").replace(T, later)]}
    out = run_batch(spark, store, write(tmp_path / "two", rows), "2024-02-01-incremental-clean", "run-2", "2024-02-01 12:00:00")
    assert (out.accepted, out.skipped) == (4, 8)
    after = store.manifest()
    # a batch of three readings writes three rows; sources that were skipped are as before
    added = after["raw_machine_telemetry"]["deltas"][len(before["raw_machine_telemetry"]["deltas"]) :]
    assert [d["rows"] for d in added] == [3] and after["raw_shifts"] == before["raw_shifts"] and after["raw_factories"] == before["raw_factories"]
    # only the days that changed are made again, and only the versions that changed are added
    days = lambda m, t: {k for k in m[t]["parts"] if m[t]["parts"][k] != before[t]["parts"].get(k)}
    assert days(after, "int_machine_telemetry") == {"2024-01-31", "2024-02-01"} == days(after, "fct_machine_telemetry_daily")
    assert after["machine_history"]["deltas"][-1]["rows"] == 2
    assert store.read("raw_machine_telemetry").count() == 5
    # the lookback takes the corrected reading and the new one, not the one of December
    built = {r["telemetry_id"]: float(r["temperature_c"]) for r in store.read("int_machine_telemetry").collect()}
    assert built == {"TEL-001": 33.0, "TEL-002": 20.5, "TEL-003": 20.5, "TEL-101": 21.0}
    versions = sorted((r["status"], r["valid_to"] is None) for r in store.read("machine_history").collect())
    assert versions == [("active", False), ("retired", True)]
    # a reading that moves to another day, in a run that builds nothing, leaves its old day with the next run that does
    moved = ["TEL-101,MCH-001,2024-01-31T20:00:00Z,21,1,3,9,running,2024-02-01T11:00:00Z"]
    run_batch(spark, store, write(tmp_path / "moved", {"machine_telemetry": moved, **{k: v for k, v in rows.items() if k != "machine_telemetry"}}), "2024-02-01-incremental-late", "run-3", "2024-02-01 13:00:00", build=False)
    more = ["TEL-103,MCH-001,2024-01-31T21:00:00Z,21,1,3,9,running,2024-02-01T11:00:00Z"]
    run_batch(spark, store, write(tmp_path / "more", {"machine_telemetry": more, **{k: v for k, v in rows.items() if k != "machine_telemetry"}}), "2024-02-01-incremental-more", "run-4", "2024-02-01 14:00:00")
    built = sorted((r["telemetry_id"], str(r["event_timestamp"])[:10]) for r in store.read("int_machine_telemetry").collect())
    assert built == [("TEL-001", "2024-01-31"), ("TEL-002", "2024-01-31"), ("TEL-003", "2024-01-31"), ("TEL-101", "2024-01-31"), ("TEL-103", "2024-01-31")]
    assert set(store.manifest()["fct_machine_telemetry_daily"]["parts"]) == {"2024-01-31"} and store.read("fct_machine_telemetry_daily").first()["sample_count"] == 5
    # a backfill brings it in, day by day
    assert [d for d, _ in backfill(store, "2023-12-01", "2023-12-01", "2024-02-01 12:00:00")] == ["2023-12-01"]
    assert store.read("int_machine_telemetry").filter("telemetry_id = 'TEL-102'").count() == 1
    stops = iter(["healthy", "degraded"])
    monkeypatch.setattr(lifecycle, "rebuild_day", lambda *a: next(stops))
    assert backfill(store, "2024-01-01", "2024-01-09", NOW, force=True) == [("2024-01-01", "healthy"), ("2024-01-02", "degraded")]
    for days, force in ((("2024-01-01", "2024-01-09"), False), (("2024-01-01", "2024-02-15"), True), (("2024-01-02", "2024-01-01"), False)):
        with pytest.raises(ValueError):
            backfill(store, *days, NOW, force)


def test_a_broken_run_is_told_and_its_files_come_again(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    folder = write(tmp_path / "good", ROWS)
    with monkeypatch.context() as m:
        m.setattr(lifecycle, "validate_batch", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            run_batch(spark, store, folder, "2024-01-31-historical-clean", "run-1", NOW, build=False)
    assert [r["status"] for r in store.read("pipeline_runs").collect()] == ["running"] and {r["status"] for r in store.read("source_files").collect()} == {"landed"}
    out = run_batch(spark, store, folder, "2024-01-31-historical-clean", "run-2", NOW, build=False)
    assert out.accepted == 12 and {r["run_id"]: r["status"] for r in store.read("pipeline_runs").collect()} == {"run-1": "failed", "run-2": "degraded"}
    files = store.read("source_files").collect()
    assert len(files) == 10 and {r["status"] for r in files} == {"loaded"} and {r["file_id"].split("-")[1] for r in files} == {"1"}  # under their old ids


def test_a_run_that_was_overtaken_is_made_again(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    folder = write(tmp_path / "good", ROWS)
    real, other = Store.publish, []

    def publish(self, staged):
        if "data_quality_trends" in staged and not other:  # another run ends first, with rows of its own
            other.append(1)
            row = self.read("pipeline_runs").withColumn("run_id", F.lit("run-0")).withColumn("status", F.lit("healthy"))
            real(self, self.stage({"data_quality_trends": spark.range(1)}) | self.stage_rows("pipeline_runs", row, ["run_id"]))
        return real(self, staged)

    monkeypatch.setattr(Store, "publish", publish)
    out = run_batch(spark, store, folder, "2024-01-31-historical-clean", "run-1", NOW, build=False)
    assert out.accepted == 12 and other == [1]
    assert {r["run_id"]: r["status"] for r in store.read("pipeline_runs").collect()} == {"run-0": "healthy", "run-1": "degraded"}
    assert store.read("raw_machine_telemetry").count() == 3 and "quality_date" in store.read("data_quality_trends").columns
    assert {r["status"] for r in store.read("source_files").collect()} == {"loaded"} and store.read("source_files").count() == 10


def test_checks_keep_their_names_and_outcomes_are_mapped(spark):
    columns = "check_id string, run_id string, check_name string, check_type string, scope string, status string, severity string, observed_value string, expected string, evidence string, occurred_at timestamp_ntz"
    old = spark.createDataFrame([("c", "r", "name", "kind", "s", "failed", "error", "3", "0", None, None)], columns)
    new = spark.createDataFrame([("c", "r", "other", "other", "o", "passed", "info", "0", "1", "e", None)], columns)
    got = upsert_checks(old, new).first()
    assert (got["check_name"], got["severity"], got["status"], got["observed_value"]) == ("name", "error", "passed", "0")
    tests = spark.createDataFrame([("t1", "a", "pass", 0, ["m2", "m1"]), ("t2", "b", "warn", 2, ["m1"]), ("t3", "c", "skipped", None, []), ("t4", "d", "Fail", 1, None)], "test_id string, test_name string, outcome string, failures int, depends_on array<string>")
    got = {r["check_id"]: (r["status"], r["severity"], r["scope"]) for r in checks.outcome_checks(tests, "r", NOW).collect()}
    assert got == {"t1": ("passed", "info", "m1"), "t2": ("warning", "warning", "m1"), "t3": ("failed", "error", "project"), "t4": ("failed", "error", "project")}


def test_rows_are_numbered_over_many_blocks(spark, tmp_path):
    folder = tmp_path / "split"
    folder.mkdir()
    for name, k in (("a.csv", 0), ("b.csv", 500)):
        (folder / name).write_text("n,t\n" + "".join(f"{i},{'x' * (i % 37)}\n" for i in range(k, k + 500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = csv_batch.read_source(spark, f"file://{folder}").select("_source_row_number", "n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r[0], int(r[1])) for r in got) == [(i + 2, i) for i in range(1000)]


def test_incidents(spark):
    schema = "incident_id string, title string, status string, failed_run_id string, recovery_run_id string, explanation string, created_at timestamp_ntz, resolved_at timestamp_ntz"
    one = spark.createDataFrame([("i1", "late", "r1")], "incident_id string, title string, failed_run_id string")
    open_ = create_incident(spark.createDataFrame([], schema), one, F.lit(NOW).cast("timestamp_ntz"))
    assert open_.first()["status"] == "open" and resolve_incident(open_, "i1", "r2", F.lit(NOW).cast("timestamp_ntz")).first()["recovery_run_id"] == "r2"
    with pytest.raises(ValueError):
        create_incident(open_, one, F.lit(NOW).cast("timestamp_ntz"))


def test_a_failed_run_leaves_nothing_and_can_be_repeated(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    folder = write(tmp_path / "good", ROWS)
    with monkeypatch.context() as m:
        m.setattr(Store, "publish", lambda self, staged: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            run_batch(spark, store, folder, "b-historical-x", "run-1", NOW, build=False)
    assert store.version() == 0
    out = run_batch(spark, store, folder, "b-historical-x", "run-1", NOW, build=False)
    assert (out.accepted, out.status) == (12, "degraded")  # a run without models is never healthy


def test_odd_files(spark, tmp_path):
    folder = tmp_path / "odd"
    folder.mkdir()
    with pytest.raises(csv_batch.BatchError):
        csv_batch.read_batch(spark, f"file://{folder}")
    (folder / "other.csv").write_text("a\n1\n")
    with pytest.raises(csv_batch.BatchError):
        csv_batch.read_batch(spark, f"file://{folder}")
    (folder / "more.txt").write_text("a,b\n1\n2,3,4\n")
    with pytest.raises(csv_batch.BatchError):
        csv_batch.read_source(spark, f"file://{folder}/more.txt")
    (folder / "twice.txt").write_text("a,a\n1,2\n")
    with pytest.raises(csv_batch.BatchError):
        csv_batch.read_source(spark, f"file://{folder}/twice.txt")
    (folder / "short.txt").write_text('a,b\n1\n"",x\n')
    assert sorted(tuple(r) for r in csv_batch.read_source(spark, f"file://{folder}/short.txt").select("_source_row_number", "a", "b").collect()) == [(2, "1", None), (3, None, "x")]


def test_landing_and_export(spark, tmp_path):
    folder = write(tmp_path / "good", ROWS)
    landing = f"file://{tmp_path}/landing"
    a = csv_batch.land(spark, folder, "b1", landing)
    csv_batch.land(spark, folder, "b1", landing)
    assert spark.read.parquet(landing).count() == a.count() == 10
    counts = csv_batch.export_csv({"t": spark.range(5).selectExpr("id", "'a\"b' as s")}, f"file://{tmp_path}/out")
    assert counts.first()["row_count"] == 5
    assert spark.read.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/out/t").filter("s = 'a\"b'").count() == 5


def test_stream(spark, tmp_path):
    """Late rows are kept; rejected ones go to quarantine; files are read by their own headers; keys meet across micro-batches; a repeated
    micro-batch or file changes nothing."""
    from millrace.streaming import landing

    folder = tmp_path / "in"
    folder.mkdir()
    store = Store(spark, f"file://{tmp_path}/store")
    header, names = HEADERS["machine_telemetry"], HEADERS["machine_telemetry"].split(",")

    def feed(name, lines, header=header):
        (folder / name).write_text("\n".join([header, *lines]) + "\n")
        landing.land_stream(spark, "machine_telemetry", str(folder), store, f"{tmp_path}/checkpoint", NOW).awaitTermination()

    feed("1.csv", ROWS["machine_telemetry"])
    late = f"TEL-100,MCH-001,2023-06-01T00:00:00Z,20,1,3,1,running,{T}"
    feed("2.csv", [late, "TEL-101,MCH-001,bad,20,1,3,1,running," + T, ROWS["machine_telemetry"][0], late])
    read = lambda: {r["telemetry_id"]: (r["_batch_id"], float(r["temperature_c"])) for r in store.read("raw_machine_telemetry").collect()}
    assert read() == {"TEL-001": ("stream-0", 20.5), "TEL-002": ("stream-0", 20.5), "TEL-003": ("stream-0", 20.5), "TEL-100": ("stream-1", 20.0)}
    bad = {r["_source_row_number"]: (r["reasons"][0]["code"], r["raw_payload"]["telemetry_id"]) for r in store.read("quarantine").collect()}
    assert bad == {3: ("invalid_timestamp", "TEL-101"), 5: ("duplicate_identifier", "TEL-100")}
    # columns in another order, one more and a newer version of a known key
    turned = ",".join([names[1], names[0], *names[2:], "colour"])
    newer = "2024-01-31T11:00:00Z"
    feed("3.csv", [f"MCH-001,TEL-001,2024-01-31T01:00:00Z,99.5,1.25,3,1,running,{newer},red"], turned)
    assert read()["TEL-001"] == ("stream-2", 99.5) and "MCH-001" not in read()
    drift = store.read("schema_changes").collect()
    assert [(r["change_type"], r["unexpected_columns"]) for r in drift] == [("additive", ["colour"])]
    # an older version in a later file is left alone; a file without a header fails, others go on
    (folder / "4.csv").write_text("a,a\n1,2\n")
    feed("5.csv", [f"TEL-001,MCH-001,2024-01-31T01:00:00Z,1.5,1.25,3,1,running,{T}"])
    assert read()["TEL-001"] == ("stream-2", 99.5)
    files = {r["logical_key"].rsplit("/", 1)[1]: (r["status"], r["accepted_count"], r["quarantined_count"]) for r in store.read("source_files").collect()}
    assert files == {"1.csv": ("loaded", 3, 0), "2.csv": ("loaded", 2, 2), "3.csv": ("loaded", 1, 0), "4.csv": ("failed", 0, 0), "5.csv": ("loaded", 1, 0)}
    # the last micro-batch again, as after a failure between its commit and the checkpoint's; and known bytes under a new name
    before = store.version()
    os.remove(f"{tmp_path}/checkpoint/commits/3")
    crc = f"{tmp_path}/checkpoint/commits/.3.crc"
    if os.path.exists(crc):
        os.remove(crc)
    landing.land_stream(spark, "machine_telemetry", str(folder), store, f"{tmp_path}/checkpoint", NOW).awaitTermination()
    assert store.version() == before
    feed("6.csv", ROWS["machine_telemetry"])
    assert store.read("source_files").count() == 5 and len(read()) == 4


def test_identity_of_large_files(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        with open(tmp_path / name / "machines.csv", "wb") as f:
            f.truncate(3 << 30)  # sparse
            f.seek(1 << 30)
            f.write(b"x")
    with open(tmp_path / "two" / "shifts.csv", "wb") as f:
        f.truncate(3 << 30)
    small = write(tmp_path / "small", {"factories": ROWS["factories"]})
    get = lambda d, **more: {r["source_name"]: (r["checksum"], r["size_bytes"], r["object_key"]) for r in csv_batch.file_identity(spark, d, "b", **more).collect()}
    one, two = get(f"file://{tmp_path}/one"), get(f"file://{tmp_path}/two")
    assert one["machines"] == two["machines"] and one["machines"][0] != two["shifts"][0] and one["machines"][1] == 3 << 30
    whole, blocks = get(small)["factories"], get(small, most=10)["factories"]
    data = (tmp_path / "small" / "factories.csv").read_bytes()
    assert whole[0] == hashlib.sha256(data).hexdigest() and blocks[0] == "blocks-" + hashlib.sha256(hashlib.sha256(data).hexdigest().encode()).hexdigest()
    landing = f"file://{tmp_path}/kept"
    csv_batch.land(spark, small, "b", landing, most=10)
    csv_batch.land(spark, small, "b", landing)
    assert sorted((r["content"] is None, r["kept_at"] is None) for r in spark.read.parquet(landing).collect()) == [(False, True), (True, False)]


def test_files_of_a_folder_have_their_own_headers(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_text("k,v\n1,x\n2,y\n")
    (folder / "b.csv").write_text("v,k,more\nz,3,m\n")
    (folder / "c.csv").write_text("k,v\n4,w\n")
    got = csv_batch.read_source(spark, f"file://{folder}").select("_source_row_number", "k", "v", "more").collect()
    assert sorted(map(tuple, got)) == [(2, "1", "x", None), (3, "2", "y", None), (4, "3", "z", "m"), (5, "4", "w", None)]
    assert csv_batch.header_of(spark, f"file://{folder}/b.csv") == ["v", "k", "more"]


def test_a_run_that_gives_signs_of_life_is_left_alone(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    folder = write(tmp_path / "good", ROWS)
    files = csv_batch.file_identity(spark, folder, "b1")
    status = lambda: {r["run_id"]: r["status"] for r in store.read("pipeline_runs").collect()}
    with store.lease("run-1"):
        lifecycle.begin(store, files, "b1", "run-1", NOW)
        lifecycle.begin(store, files, "b1", "run-2", NOW)
        assert status() == {"run-1": "running", "run-2": "running"}
    lifecycle.begin(store, files, "b1", "run-3", NOW)
    assert status() == {"run-1": "failed", "run-2": "failed", "run-3": "running"}
