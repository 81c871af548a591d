import re

import pytest
from pyspark.sql import functions as F

from millrace.functions.expressions import at, bounded_names, bounded_number, bounded_reasons, bounded_text, freshness_class, is_stale, ratio
from millrace.operators import checks as C
from millrace.operators import ledger as L
from millrace.operators import observability as O
from millrace.operators import tables as T
from millrace.operators.versions import Store
from millrace.plans import graph


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


STATE = "k string, v string, updated_at timestamp_ntz, _record_checksum string, _batch_id string"


def state(spark, *values):
    return spark.createDataFrame([(k, v, t, s, b) for k, v, t, s, b in values], STATE.replace("timestamp_ntz", "string")).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


def test_upsert_keeps_newer_and_equal_rows(spark):
    old = state(spark, ("a", "1", "2024-01-02", "x", "b1"), ("b", "1", "2024-01-02", "x", "b1"), ("c", "1", "2024-01-02", "x", "b1"), ("d", "1", "2024-01-02", "x", "b1"))
    new = state(spark, ("a", "2", "2024-01-01", "y", "b2"), ("b", "2", "2024-01-02", "y", "b2"), ("c", "1", "2024-01-03", "x", "b2"), ("e", "9", "2024-01-01", "z", "b2"))
    got = rows(T.upsert_current(old, new, "k"), "k", "v", "_batch_id")
    assert got == [("a", "1", "b1"), ("b", "2", "b2"), ("c", "1", "b1"), ("d", "1", "b1"), ("e", "9", "b2")]
    once = T.upsert_current(old, new, "k")
    assert rows(T.upsert_current(once, new, "k"), "k", "v", "_batch_id") == got


def test_incremental_slices(spark):
    source = spark.createDataFrame([(i, f"2024-01-{i:02d}") for i in range(1, 11)], "k int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    stored = source.filter("k <= 6")
    keys = lambda df: [r[0] for r in df.orderBy("k").collect()]
    assert keys(T.incremental_slice(source, "t", stored)) == [4, 5, 6, 7, 8, 9, 10]
    assert keys(T.incremental_slice(source, "t", stored.limit(0))) == list(range(1, 11))
    assert keys(T.incremental_slice(source, "t", stored, start="2024-01-02 00:00:00", end="2024-01-04 00:00:00")) == [2, 3]
    assert keys(T.incremental_slice(source, "t", None, end="2024-01-04 00:00:00")) == list(range(1, 11))
    plan = T.incremental_slice(source, "t", stored)._jdf.queryExecution().toString()
    assert "2024-01-04" in plan  # a literal


def test_scd2_is_idempotent_and_closes_vanished_keys(spark):
    one = spark.createDataFrame([("a", "x", "2024-01-01"), ("b", "x", "2024-01-01")], "k string, v string, u string").withColumn("u", F.col("u").cast("timestamp_ntz"))
    two = spark.createDataFrame([("a", "y", "2024-01-05"), ("c", "x", "2024-01-02")], "k string, v string, u string").withColumn("u", F.col("u").cast("timestamp_ntz"))
    first = T.scd2(None, one, "k", "u", "2024-01-03 00:00:00")
    second = T.scd2(first, two, "k", "u", "2024-01-06 00:00:00")
    got = sorted((r.k, r.v, str(r.valid_from)[:10], str(r.valid_to)[:10]) for r in second.collect())
    assert got == [("a", "x", "2024-01-01", "2024-01-05"), ("a", "y", "2024-01-05", "None"), ("b", "x", "2024-01-01", "2024-01-06"), ("c", "x", "2024-01-02", "None")]
    third = T.scd2(second, two, "k", "u", "2024-01-09 00:00:00")
    assert sorted((r.k, r.v, str(r.valid_from)[:10], str(r.valid_to)[:10]) for r in third.collect()) == got


def test_check_sink_keeps_names(spark):
    a = spark.createDataFrame([("c", "r", "n", "t", "s", "passed", "info", "0", "e", None, None)], "check_id string, run_id string, check_name string, check_type string, scope string, status string, severity string, observed_value string, expected string, evidence string, occurred_at timestamp_ntz")
    b = a.withColumns({"status": F.lit("failed"), "severity": F.lit("error"), "check_name": F.lit("other")})
    assert rows(T.upsert_checks(a, b), "check_name", "severity", "status") == [("n", "info", "failed")]


def test_store_publishes_all_or_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    assert store.read("t") is None
    assert store.commit({"t": spark.range(3)}) == 1
    staged = store.stage({"t": spark.range(5), "u": spark.range(1)})
    assert store.read("t").count() == 3 and store.read("u") is None  # a broken-off commit
    assert store.publish(staged) == 2
    assert store.read("t").count() == 5 and store.read("t", 1).count() == 3


FILES = "source_name string, logical_key string, checksum string, file_id string, status string, created_at string"


def test_ledger(spark):
    known = spark.createDataFrame([("s", "k1", "c1", "f1", "loaded", "1"), ("s", "k2", "c2", "f2", "failed", "1"), ("s", "k3", "c3", "f3", "loaded", "1")], FILES)
    files = spark.createDataFrame([("s", "k1", "c1"), ("s", "k2", "c2"), ("s", "k3", "c9"), ("s", "k4", "c4")], "source_name string, logical_key string, checksum string")
    got = rows(L.ledger_decision(files, known), "logical_key", "decision", "known_file_id", "changed_logical_file")
    assert sorted(got, key=str) == sorted([("k1", "duplicate", "f1", False), ("k2", "retry", "f2", False), ("k3", "new", None, True), ("k4", "new", None, False)], key=str)
    status = lambda *x: spark.range(1).select(L.file_status(*map(F.lit, x))).first()[0]
    assert [status(0, 0, True), status(0, 0, False), status(0, 2, False), status(1, 2, True)] == ["quarantined", "loaded", "quarantined", "loaded"]
    open_ = spark.createDataFrame([("run", "landed", None, 3, 1), ("run", "loaded", "t", 3, 1)], "run_id string, status string, processed_at string, accepted_count long, quarantined_count long")
    assert rows(L.mark_interrupted(open_, "run"), "status", "accepted_count") == [("failed", 0), ("loaded", 3)]


def test_incidents(spark):
    i = spark.createDataFrame([("i1", "open", None, None, "old")], "incident_id string, status string, recovery_run_id string, resolved_at timestamp_ntz, explanation string")
    done = L.resolve_incident(i, "i1", "r2", at("2024-01-01 00:00:00"))
    assert rows(done, "status", "recovery_run_id") == [("resolved", "r2")]
    with pytest.raises(LookupError):
        L.resolve_incident(done, "i1", "r3", at("2024-01-01 00:00:00"))
    assert rows(L.explain_incident(i, "i1", F.lit("new")), "explanation") == [("new",)]
    with pytest.raises(LookupError):
        L.explain_incident(i, "i9", F.lit("new"))


@pytest.mark.parametrize(
    ("observed", "history", "status", "evaluated"),
    [
        (102, [100, 101, 99, 100, 100, 10000, 98, 97], "passed", True),
        (20, [100, 101, 99, 100, 100], "warning", True),
        (5, [3, 3], "passed", False),
        (0, [1, 1, 1], "passed", True),
    ],
)
def test_volume_anomaly(spark, observed, history, status, evaluated):
    h = spark.createDataFrame([("s", n, i + 1) for i, n in enumerate(history)], "source_name string, row_count long, rank int")
    o = spark.createDataFrame([("s", observed)], "source_name string, observed_rows long")
    assert rows(C.volume_anomaly(o, h), "status", "evaluated") == [(status, evaluated)]


def test_run_status(spark):
    def verdict(*kinds, quarantined=False):
        c = spark.createDataFrame([("r", t, s, v) for t, s, v in kinds], "run_id string, check_type string, status string, severity string")
        return tuple(C.run_status(c, F.lit(quarantined)).select("run_status", "freshness_status").first())

    assert verdict(("model_test", "passed", "info")) == ("healthy", None)
    assert verdict(("model_test", "passed", "info"), quarantined=True) == ("degraded", None)
    assert verdict(("contract", "warning", "warning"), ("freshness", "warning", "warning")) == ("degraded", "warning")
    assert verdict(("model_test", "failed", "error"), ("freshness", "passed", "info")) == ("failed", "fresh")
    outcome = lambda x: spark.range(1).select(C.outcome_status(F.lit(x))).first()[0]
    assert [outcome(x) for x in ("pass", "warn", "error", "skipped")] == ["passed", "warning", "failed", "failed"]


def test_downstream_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "parent string, child string")
    root = spark.createDataFrame([("a",)], "node string")
    assert rows(O.downstream(edges, root), "node", "depth") == [("a", 3), ("b", 1), ("c", 2), ("d", 3)]
    assert rows(O.downstream(edges, root, 1), "node", "depth") == [("b", 1)]
    assert graph.to_rebuild(spark, ["stg_machine_telemetry"]) == ["stg_machine_telemetry", "int_machine_telemetry", "fct_machine_telemetry_daily", "machine_reliability", "data_freshness"]


def test_pages_are_bounded(spark):
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": 10_001}):
        with pytest.raises(ValueError):
            O.page(spark.range(3), F.col("id"), **bad)
    with pytest.raises(ValueError):
        O.checked_name("a b")


def test_latest_edges(spark):
    e = spark.createDataFrame([("r1", "a", "b", 1), ("r2", "a", "c", 2)], "run_id string, parent string, child string, discovered_at int")
    assert rows(O.latest_edges(e), "child") == [("c",)]


def test_report_has_facts_hypotheses_and_steps(spark):
    schema = "section string, kind string, name string, value string"
    e = spark.createDataFrame([("reason", "duplicate_identifier", "s:duplicate_identifier", "2"), ("reason", "out_of_range", "s:out_of_range", "1"), ("schema", "breaking", "s", "breaking"), ("delta", "rows", "m", "-3"), ("lineage", "model", "m2", "downstream")], schema)
    got = rows(O.incident_report(e), "section", "ordinal", "text")
    assert [x[:2] for x in got] == [*(("fact", i) for i in range(1, 6)), *(("hypothesis", i) for i in range(1, 4)), *(("next_step", i) for i in range(1, 6))]
    assert not any(O.NO_FACT == x[2] or O.NO_STEP == x[2] for x in got)
    assert rows(O.incident_report(e.limit(0)), "section", "text") == [("fact", O.NO_FACT), ("next_step", O.NO_STEP)]


def test_evidence_takes_lineage(spark):
    checks = spark.createDataFrame([("c", "kind", "failed", "error", None, "m")], "check_id string, check_type string, status string, severity string, occurred_at timestamp_ntz, scope string")
    none = spark.createDataFrame([], "source_name string, code string, row_count long, change_type string, model_name string, delta long, unavailable boolean")
    edges = graph.edges_with_exposures(spark)
    below = O.affected_downstream(edges, checks.withColumn("scope", F.lit("fct_downtime")))
    assert {"operations_dashboard", "factory_performance", "downtime_by_reason"} <= {r["node"] for r in below.collect()}
    got = O.incident_evidence(checks, none, none, none, below)
    assert {r["section"] for r in got.collect()} == {"check", "lineage"} and got.columns == ["section", "kind", "name", "value"]


def test_downstream_shuffles_no_edge_list(spark):
    """Repeated edges and cycles need no distinct edges, which each step would make anew; nodes come once, at their least depth."""
    edges = spark.range(6).selectExpr("cast(id % 3 as string) as parent", "cast((id + 1) % 3 as string) as child")
    edges = edges.unionByName(spark.createDataFrame([("0", "2"), ("2", "x")], "parent string, child string"))
    got = O.downstream(edges, spark.createDataFrame([("0",), ("0",)], "node string"))
    assert sorted(map(tuple, got.collect())) == [("0", 2), ("1", 1), ("2", 1), ("x", 2)]
    assert not re.search(r"keys=\[parent#\d+, child#\d+", got._jdf.queryExecution().toString())


def test_catalogue_reads(spark):
    models = spark.createDataFrame([("r1", "a", "view", 1), ("r2", "a", "table", 2), ("r1", "b", "view", 1)], "run_id string, model_name string, materialization string, discovered_at int")
    columns = spark.createDataFrame([("r1", "a", "x", 1), ("r2", "a", "z", 2), ("r2", "a", "y", 1)], "run_id string, model_name string, column_name string, ordinal_position int")
    assert rows(O.latest_models(models), "model_name", "materialization") == [("a", "table"), ("b", "view")]
    assert rows(O.model_by_name(models, "a"), "run_id") == [("r2",)]
    assert [r["column_name"] for r in O.model_columns(models, columns, "a").collect()] == ["y", "z"]
    runs = spark.createDataFrame([("r1", "failed", 3, None), ("r2", "healthy", 5, 2)], "run_id string, status string, accepted_row_count int, failed_checks int")
    assert tuple(O.compare_run_counts(runs, "r1", "r2").first()) == ("r1", "r2", "failed", "healthy", 2, 2)
    assert O.compare_run_counts(runs, "r1", "none").count() == 0
    assert O.single_check(spark.createDataFrame([("c", "r1", 1), ("c", "r2", 2), ("d", "r2", 3)], "check_id string, run_id string, occurred_at int"), "c").first()["run_id"] == "r2"
    incidents = spark.createDataFrame([("i1", "t", "open", "r1", None, "why")], "incident_id string, title string, status string, failed_run_id string, recovery_run_id string, explanation string")
    assert O.handoff(incidents, "i1").first()["explanation"] == "why" and O.total(incidents).first()[0] == 1


def test_expressions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    now = at("2024-02-01 00:00:00")
    times = [None, "2024-01-31 00:00:00", "2024-01-29 00:00:00", "2024-01-28 23:59:59"]
    assert [value(freshness_class(F.lit(t).cast("timestamp_ntz"), now)) for t in times] == ["missing", "fresh", "warning", "stale"]
    assert [value(is_stale(F.lit(t).cast("timestamp_ntz"), now)) for t in (None, "2024-01-31 18:00:00", "2024-01-31 17:59:59")] == [True, False, True]
    assert value(ratio(F.lit(1), F.lit(0))) is None and value(ratio(F.lit(1), F.lit(4))) == 0.25
    assert value(bounded_text(F.lit("x" * 201))).startswith("<redacted") and value(bounded_text(F.lit("a\0"))) == "a<NUL>"
    assert value(bounded_number(F.lit(float("inf")))) == "<non-finite numeric value>" and value(bounded_number(F.lit(1.5))) == "1.5"
    assert value(bounded_names(F.array(F.lit("a"), F.lit("a"), F.lit("b" * 129)))) == ["a", "<redacted: name>"]
    assert value(bounded_reasons(F.array(*map(F.lit, "abcdefghijkl"))))[-1] == "... 2 more"
