"""A batch from files to published tables, models, checks and ledgers.

A run begins with a first commit: its row says running, its files are landed, and files of runs that broke off (they say running, but
give no sign of life any more) have failed and come again as retries. All else it changes is staged and published by a second commit, so
that readers see a whole run or none. Raw tables, quarantine, ledgers and the machines' history are logs: a run writes its own rows.
Telemetry with its context is kept by days, from the lookback on; daily facts are made again for the days that changed.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import at, record_checksum
from ..operators import checks as C
from ..operators.contracts import CONTRACTS
from ..operators.ledger import file_status, finalise_run, healthy_volumes, ledger_decision, mark_interrupted, upsert_stages
from ..operators.tables import delete_insert, incremental_slice, row_counts, scd2_changes
from ..operators.validation import ROW, Validated, drift_frame, typed, validate_batch
from ..operators.versions import Conflict, Staged, Store, day
from ..sources.csv_batch import land, read_batch
from . import graph
from .models import STAGING, Models

FILES = "file_id string, run_id string, batch_id string, source_name string, logical_key string, checksum string, object_key string, size_bytes long, row_count long, accepted_count long, quarantined_count long, status string, created_at timestamp_ntz, processed_at timestamp_ntz"
RUNS = "run_id string, batch_id string, status string, started_at timestamp_ntz, finished_at timestamp_ntz, duration_seconds double, source_file_count long, source_row_count long, accepted_row_count long, quarantined_row_count long, skipped_file_count long, passed_checks long, failed_checks long, freshness_status string, summary string"
STAGES = "run_id string, stage_name string, status string, started_at timestamp_ntz, finished_at timestamp_ntz, duration_seconds double"
QUARANTINE = "file_id string, source_name string, _source_row_number long, raw_payload map<string,string>, reasons array<struct<code:string,column:string,check:string,message:string,value:string>>"
CHECKS = "check_id string, run_id string, check_name string, check_type string, scope string, status string, severity string, observed_value string, expected string, evidence string, occurred_at timestamp_ntz"
DRIFTS = "run_id string, source_name string, change_type string, expected_columns array<string>, actual_columns array<string>, missing_columns array<string>, unexpected_columns array<string>"
DAILY = "fct_machine_telemetry_daily"
#: How often a run that another one overtook is made again.
REPEATS = 2
#: Rows up to which a raw table with deltas is kept folded during a run.
FOLDED_ONCE = 5_000_000
#: Models stored whole; telemetry and its daily facts are stored by days, the history as a log.
STORED = [m for m, (kind, _) in graph.GRAPH.items() if kind == "table" and m not in ("data_quality_trends", DAILY)]


@dataclass
class Outcome:
    run_id: str
    status: str
    accepted: int
    quarantined: int
    skipped: int
    failed_checks: int
    freshness: str
    version: int


def _stored(store: Store, name: str, schema: str) -> DataFrame:
    found = store.read(name)
    return store.spark.createDataFrame([], schema) if found is None else found


def _loadable(v: Validated, source: str, batch_id: str, file_id: str, as_of: str) -> DataFrame:
    """Accepted rows as the raw table holds them."""
    contract = CONTRACTS[source]
    rows = typed(v.accepted, contract)
    declared = STAGING[source]
    return rows.select(
        *(F.col(c).cast(t).alias(c) for c, t in declared.items()),
        F.lit(batch_id).alias("_batch_id"),
        F.lit(file_id).alias("_source_file_id"),
        F.col(ROW).alias("_source_row_number"),
        at(as_of).alias("_ingested_at"),
        record_checksum(list(declared)).alias("_record_checksum"),
    )


class Stages:
    """What a run's stages took, as rows of the stage ledger."""

    def __init__(self, run_id: str, clock: Callable[[], float]) -> None:
        self.run_id, self.clock = run_id, clock
        self.rows: list[tuple[str, str, str, float, float]] = []

    def __call__(self, name: str, began: float) -> float:
        now = self.clock()
        self.rows.append((self.run_id, name, "succeeded", began, now))
        return now

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = spark.createDataFrame(self.rows, "run_id string, stage_name string, status string, s double, f double")
        moment = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
        return rows.select("run_id", "stage_name", "status", moment("s").alias("started_at"), moment("f").alias("finished_at"))


def begin(store: Store, files: DataFrame, batch_id: str, run_id: str, as_of: str) -> DataFrame:
    """Publishes the running run and its landed files; gives the ledger's decisions, with the file_id of each.

    Runs that still say running but give no sign of life broke off: they and the files they landed have failed."""
    spark = store.spark
    out: list[DataFrame] = []

    def work() -> Staged:
        ledger, runs = _stored(store, "source_files", FILES), _stored(store, "pipeline_runs", RUNS)
        open_ = [r[0] for r in runs.filter("status = 'running'").select("run_id").collect()]  # runs at work, few
        dead = [r for r in open_ if r != run_id and not store.alive(r)]
        decisions = ledger_decision(files, ledger).withColumn("file_id", F.coalesce("known_file_id", F.concat_ws("-", F.lit(run_id), "source_name")))
        decisions = spark.createDataFrame(decisions.collect(), decisions.schema)  # one row a source
        out[:] = [decisions]
        landed = decisions.filter("decision <> 'duplicate'").select("file_id", F.lit(run_id).alias("run_id"), F.lit(batch_id).alias("batch_id"), "source_name", "logical_key", "checksum", "object_key", "size_bytes", F.lit("landed").alias("status"), at(as_of).alias("created_at"))
        rows = landed.select(*((F.col(c) if c in landed.columns else F.lit(None)).cast(t).alias(c) for c, t in ledger.dtypes))
        stuck = ledger.filter((F.col("status") == "landed") & F.col("processed_at").isNull() & F.col("run_id").isin([*dead, run_id]))
        broken = mark_interrupted(stuck).join(rows.select("file_id"), "file_id", "left_anti")
        staged = store.stage_rows("source_files", rows.unionByName(broken), ["file_id"])
        own = spark.range(1).select(*((F.lit(run_id) if c == "run_id" else F.lit(batch_id) if c == "batch_id" else F.lit("running") if c == "status" else at(as_of) if c == "started_at" else F.lit(None)).cast(t).alias(c) for c, t in runs.dtypes))
        lost = runs.filter(F.col("run_id").isin(dead)).withColumn("status", F.lit("failed")).withColumn("summary", F.lit("The run broke off."))
        return staged | store.stage_rows("pipeline_runs", own.unionByName(lost), ["run_id"])

    store.retried(work)
    return out[0]


def stage_telemetry(store: Store, m: Models, lookback_hours: int, start: str | None, end: str | None) -> Staged:
    """Telemetry from the lookback (or of [start, end)) in place of its days, and the daily facts of the days that changed.

    The lookback's bound comes from the store's zones. A reading that is new to its day, or another version of what is stored there, may
    replace one of another day: such are looked for by their ids in the days that aren't merged anyway."""
    entry = store.manifest().get("int_machine_telemetry")
    known = store.bounds(entry, "event_timestamp")
    rows = m.telemetry_rows(incremental_slice(m.stg("machine_telemetry"), "event_timestamp", None, lookback_hours, start, end, known and known[1])).persist()
    also: set[str] = set()
    if entry:
        own = {r[0] for r in rows.select(day("event_timestamp")).distinct().collect()}  # days
        others = [k for k in entry["parts"] if k not in own]
        if others:
            same = store.open_parts(entry, own).select("telemetry_id", "_record_checksum")
            fresh = rows.join(same, ["telemetry_id", "_record_checksum"], "left_anti")
            moved = store.find(entry, others, "telemetry_id", fresh)
            also = {r[0] for r in moved.select(day("event_timestamp")).distinct().collect()}
    staged = store.stage_merge("int_machine_telemetry", rows, day("event_timestamp"), lambda old, new: delete_insert(old, new, "telemetry_id"), also, ["telemetry_id"])
    rows.unpersist()
    changed = staged["int_machine_telemetry"]
    m.store("int_machine_telemetry", store.open_parts(changed, changed["touched"]))
    staged |= store.stage_merge(DAILY, m.fct_machine_telemetry_daily, day("telemetry_date"), lambda old, new: new, changed["touched"])
    m.store("int_machine_telemetry", store.open(changed))
    m.store(DAILY, store.open(staged[DAILY]))
    return staged


def build_models(store: Store, staged: Staged, raw: dict[str, DataFrame], as_of: str, lookback_hours: int = 48, start: str | None = None, end: str | None = None) -> tuple[dict[str, DataFrame], Staged]:
    """All models by name, and what was staged of them: telemetry and its daily facts by days, the versions of machines that the run
    adds or ends, and every table model whole."""
    m = Models(raw, as_of, _stored(store, "quality_results", CHECKS))
    staged = staged | stage_telemetry(store, m, lookback_hours, start, end)
    changes = scd2_changes(store.read("machine_history"), m.stg("machines").select(*STAGING["machines"]), "machine_id", "updated_at", as_of)
    staged |= store.stage_rows("machine_history", changes, ["machine_id", "valid_from"])
    models = {f"raw_{s}": raw[s] for s in STAGING} | {f"stg_{s}": m.stg(s) for s in STAGING} | {"machine_history": store.open(staged["machine_history"])}
    for name in graph.GRAPH:
        if name in STORED:
            staged |= store.stage({name: getattr(m, name)})
            m.store(name, store.open(staged[name]))
        if name not in models:
            models[name] = getattr(m, name)
    return models, staged


def stored_counts(store: Store, staged: Staged, models: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """(model_name, row_count): from the manifest where it tells, else counted."""
    told = {n: k for n in names if (k := store.rows(staged.get(n))) is not None}
    out = store.spark.createDataFrame(sorted(told.items()), "model_name string, row_count long")
    rest = {n: models[n] for n in names if n not in told}
    return out.unionByName(row_counts(rest)) if rest else out


def current_sources(store: Store, staged: Staged, held: list[DataFrame]) -> dict[str, DataFrame | None]:
    """The raw tables as they will be. What is folded from deltas, and small by the manifest's count, is folded once for all models."""
    out, entries = {}, {n: e for n, e in store.manifest().items()} | {n: c["entry"] for n, c in staged.items()}
    for s in STAGING:
        entry = entries.get(f"raw_{s}")
        out[s] = store.open(entry) if entry else None
        if entry and entry["deltas"] and sum(p["rows"] for p in (*entry["parts"].values(), *entry["deltas"])) <= FOLDED_ONCE:
            held.append(out[s].persist())
    return out


def stage_metadata(store: Store, models: dict[str, DataFrame], run_id: str, as_of: str) -> Staged:
    """The catalogue, columns and lineage of a run's models: models and columns are upserted, edges inserted if absent."""
    spark = store.spark
    mark = [F.lit(run_id).alias("run_id"), at(as_of).alias("discovered_at")]
    own = {k: df for k, df in models.items() if k in graph.GRAPH}
    out = store.stage_rows("models", graph.catalogue(spark).select(*mark, "*"), ["run_id", "model_name"])
    out |= store.stage_rows("model_columns", graph.model_columns(spark, own).select(*mark, "*"), ["run_id", "model_name", "column_name"])
    return out | store.stage_rows("lineage_edges", graph.edges(spark).select(*mark, "*"), ["run_id", "parent", "child"], "first")


def batch_kind(batch_id: str) -> str | None:
    """The kind in ids like 2024-01-31-historical-clean: volumes are compared within a kind."""
    found = re.match(r"\d{4}-\d{2}-\d{2}-([a-z]+)-", batch_id)
    return found[1] if found else None


def run_batch(spark: SparkSession, store: Store, folder: str, batch_id: str, run_id: str, as_of: str, build: bool = True, clock: Callable[[], float] = time.time) -> Outcome:
    """Loads a folder of source files into the store. Every source is validated with the whole batch as its parents; files that are
    known and done are skipped. Rows offered count as accepted, changed or not. `clock` only times the stages.

    A run that another one overtook is made again on top of it, up to REPEATS times; its files keep their ids."""
    with store.lease(run_id):
        for left in range(REPEATS, -1, -1):
            try:
                out = _run(spark, store, folder, batch_id, run_id, as_of, build, clock)
                break
            except Conflict:  # another run replaced models that this one was made beside
                if not left:
                    raise
    store.compact()
    return out


def _run(spark: SparkSession, store: Store, folder: str, batch_id: str, run_id: str, as_of: str, build: bool, clock: Callable[[], float]) -> Outcome:
    stages, began = Stages(run_id, clock), clock()
    start = began
    held: list[DataFrame] = []
    identity = land(spark, folder, batch_id, f"{store.home}/landing")
    sources = read_batch(spark, folder, most_bytes=None, most_rows=None)
    decisions = begin(store, identity, batch_id, run_id, as_of)
    plan = {r["source_name"]: r for r in decisions.collect()}  # one row a source
    start = stages("register", start)
    valid = validate_batch(sources, as_of)
    staged: dict = {}
    ledger_rows, quarantine, checks, accepted, quarantined, skipped = [], [], [], 0, 0, 0
    for source, v in valid.items():
        file = plan[source]
        if file["decision"] == "duplicate":
            skipped += 1
            continue
        rows = v.rows.persist()
        held.append(rows)
        v = Validated(rows, v.drift)
        ok, bad = rows.agg(C.count_where(F.size("reasons") == 0), C.count_where(F.size("reasons") > 0)).first()
        accepted, quarantined = accepted + ok, quarantined + bad
        key = next(iter(STAGING[source]))
        staged |= store.stage_rows(f"raw_{source}", _loadable(v, source, batch_id, file["file_id"], as_of), [key], "current")
        quarantine.append(v.quarantined.select(F.lit(file["file_id"]).alias("file_id"), "source_name", ROW, "raw_payload", "reasons"))
        checks.append(C.contract_checks(rows, source, run_id, as_of))
        ledger_rows.append((file["file_id"], run_id, batch_id, source, file["logical_key"], file["checksum"], file["object_key"], file["size_bytes"], ok + bad, ok, bad, v.drift.kind == "breaking"))
    start = stages("load", start)
    drifts = drift_frame(spark, [valid[s].drift for s in valid if plan[s]["decision"] != "duplicate"]).select(F.lit(run_id).alias("run_id"), "*")
    checks += [C.file_checks(decisions, run_id, as_of), C.drift_checks(drifts, run_id, as_of)]
    if ledger_rows:
        new = spark.createDataFrame(ledger_rows, FILES.split(", status")[0] + ", breaking boolean")
        status = file_status(F.col("accepted_count"), F.col("quarantined_count"), F.col("breaking")).alias("status")
        new = new.select("*", status, at(as_of).alias("created_at"), at(as_of).alias("processed_at")).drop("breaking")
        history = healthy_volumes(_stored(store, "source_files", FILES), _stored(store, "pipeline_runs", RUNS), at(as_of), batch_kind(batch_id))
        checks.append(C.volume_checks(C.volume_anomaly(new.select("source_name", F.col("row_count").alias("observed_rows")), history), run_id, as_of))
        staged |= store.stage_rows("source_files", new, ["file_id"])
        staged |= store.stage_rows("quarantine", C._union(quarantine), ["file_id", ROW])
        staged |= store.stage_rows("schema_changes", drifts, [])
    raw = current_sources(store, staged, held)
    if build and all(df is not None for df in raw.values()):
        models, staged = build_models(store, staged, raw, as_of)
        start = stages("build", start)
        checks += [C.skip_below(C.run_checks(graph.rules(), models, run_id, as_of), graph.ancestors()), C.freshness_checks(models["data_freshness"], run_id, as_of)]
        if "raw_machine_telemetry" in staged:
            checks.append(C.late_arrivals(raw["machine_telemetry"].filter(F.col("_batch_id") == batch_id), run_id, as_of))
        counts = stored_counts(store, staged, models, [*STORED, DAILY, "int_machine_telemetry", "machine_history"])
        staged |= store.stage_rows("model_row_counts", counts.select(F.lit(run_id).alias("run_id"), "*"), ["run_id", "model_name"])
        staged |= stage_metadata(store, models, run_id, as_of)
    else:
        checks.append(C.build_skipped(spark, run_id, as_of))
    rows = C._union([c.select(*C.CHECK_COLUMNS) for c in checks])
    staged |= store.stage_rows("quality_results", rows, ["run_id", "check_id"], "outcome")
    results = store.open(staged["quality_results"])
    verdict = C.run_status(results.filter(F.col("run_id") == run_id), F.lit(quarantined > 0))
    facts = verdict.join(C.run_facts(verdict), "run_id").first()
    staged |= store.stage({"data_quality_trends": Models({}, as_of, results).data_quality_trends})
    stages("check", start)
    final = [(run_id, facts["run_status"], float(clock() - began), len(valid), accepted + quarantined, accepted, quarantined, skipped, facts["passed_checks"], facts["failed_checks"], facts["freshness_status"] or "unknown", facts["fact"])]
    fields = "run_id string, status string, duration_seconds double, source_file_count long, source_row_count long, accepted_row_count long, quarantined_row_count long, skipped_file_count long, passed_checks long, failed_checks long, freshness_status string, summary string"
    new = spark.createDataFrame(final, fields).withColumn("finished_at", at(as_of))
    staged |= store.stage_rows("pipeline_runs", finalise_run(store.read("pipeline_runs").filter(F.col("run_id") == run_id), new), ["run_id"])
    took = stages.frame(spark).withColumn("duration_seconds", F.lit(None).cast("double"))
    nothing = spark.createDataFrame([], STAGES)
    staged |= store.stage_rows("pipeline_stages", upsert_stages(nothing, took), ["run_id", "stage_name"])
    version = store.publish(staged)
    for rows in held:
        rows.unpersist()
    return Outcome(run_id, facts["run_status"], accepted, quarantined, skipped, facts["failed_checks"], facts["freshness_status"] or "unknown", version)


def rebuild_day(store: Store, start: str, as_of: str) -> str:
    """Builds and tests all models again, with the telemetry of one day read anew, and publishes them; gives the status of its checks."""
    held: list[DataFrame] = []
    raw = current_sources(store, {}, held)
    if any(df is None for df in raw.values()):
        raise LookupError("raw tables are missing")
    run_id = f"backfill-{start}"
    end = (date.fromisoformat(start) + timedelta(days=1)).isoformat()
    models, staged = build_models(store, {}, raw, as_of, start=f"{start} 00:00:00", end=f"{end} 00:00:00")
    rows = C.skip_below(C.run_checks(graph.rules(), models, run_id, as_of), graph.ancestors()).select(*C.CHECK_COLUMNS)
    staged |= store.stage_rows("quality_results", rows, ["run_id", "check_id"], "outcome")
    status = C.run_status(store.open(staged["quality_results"]).filter(F.col("run_id") == run_id)).first()["run_status"]
    store.publish(staged)
    for rows in held:
        rows.unpersist()
    return status


def backfill(store: Store, start: str, end: str, as_of: str, force: bool = False) -> list[tuple[str, str]]:
    """(day, status) of the days from start to end, both included, each rebuilt in turn; it stops at the first that isn't healthy.

    At most 31 days; more than 7 only by force."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    days = (last - first).days + 1
    if not 1 <= days <= 31:
        raise ValueError("a backfill takes 1 to 31 days")
    if days > 7 and not force:
        raise ValueError("a backfill of more than 7 days needs force")
    done: list[tuple[str, str]] = []
    for k in range(days):
        own = (first + timedelta(days=k)).isoformat()
        done.append((own, rebuild_day(store, own, as_of)))
        if done[-1][1] != "healthy":
            break
    return done
