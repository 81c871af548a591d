"""Ledgers of runs, stages, files and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import latest, upsert

#: A file in one of these states need not be loaded again.
DONE = ("loaded", "quarantined", "skipped")
RUN_FIELDS = ("status", "finished_at", "duration_seconds", "source_file_count", "source_row_count", "accepted_row_count", "quarantined_row_count", "skipped_file_count", "passed_checks", "failed_checks", "freshness_status", "summary")


def ledger_decision(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Incoming files (source_name, logical_key, checksum) with what to do.

    decision: duplicate if the same source and checksum is done; retry if it is known but not done, under its old file_id; else new.
    changed_logical_file: the latest known checksum of the same logical key is another one."""
    known = latest(ledger, ["source_name", "checksum"], F.desc("created_at"), F.desc("file_id")).select("source_name", "checksum", F.col("file_id").alias("known_file_id"), F.col("status").alias("known_status"))
    last = latest(ledger, ["source_name", "logical_key"], F.desc("created_at"), F.desc("file_id")).select("source_name", "logical_key", F.col("checksum").alias("last_checksum"))
    both = files.join(known, ["source_name", "checksum"], "left").join(last, ["source_name", "logical_key"], "left")
    decision = F.when(F.col("known_file_id").isNull(), "new").when(F.col("known_status").isin(*DONE), "duplicate").otherwise("retry")
    changed = F.col("last_checksum").isNotNull() & (F.col("last_checksum") != F.col("checksum"))
    return both.select(*files.columns, decision.alias("decision"), "known_file_id", changed.alias("changed_logical_file"))


def file_status(loaded: Column, quarantined: Column, breaking: Column) -> Column:
    """A processed file's final state."""
    return F.when((loaded == 0) & ((quarantined > 0) | breaking), "quarantined").otherwise("loaded")


def mark_interrupted(ledger: DataFrame, run_id: str | None = None) -> DataFrame:
    """Files that the run (or any, if none is named) landed but never processed become failed, to be retried."""
    own = F.lit(True) if run_id is None else F.col("run_id") == run_id
    stuck = own & (F.col("status") == "landed") & F.col("processed_at").isNull()
    zero = F.when(stuck, F.lit(0))
    return ledger.select(
        *(
            F.when(stuck, "failed").otherwise(F.col(c)).alias(c) if c == "status" else F.coalesce(zero, F.col(c)).cast(t).alias(c) if c in ("accepted_count", "quarantined_count") else F.col(c)
            for c, t in ledger.dtypes
        )
    )


def upsert_stages(stages: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stages by run and name; the duration follows from the times."""
    took = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("finished_at")).cast("double") / 1e6
    return upsert(stages, incoming.withColumn("duration_seconds", took).select(stages.columns), ["run_id", "stage_name"])


def finalise_run(runs: DataFrame, final: DataFrame) -> DataFrame:
    """A running run's final fields (those of RUN_FIELDS that `final` has, by run_id) put in its row; other columns stay."""
    fields = [c for c in RUN_FIELDS if c in final.columns]
    new = final.select("run_id", F.struct(*fields).alias("_final"))
    return runs.join(new, "run_id", "left").select(*(F.when(F.col("_final").isNotNull(), F.col(f"_final.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in runs.columns))


def create_incident(incidents: DataFrame, incident: DataFrame, now: Column) -> DataFrame:
    """incidents with one more, open; incident: (incident_id, title, failed_run_id). An id that is known already is an error."""
    if not incidents.join(incident, "incident_id", "left_semi").isEmpty():
        raise ValueError("an incident of this id exists")
    given = {c: F.col(c) for c in incident.columns} | {"status": F.lit("open"), "created_at": now}
    return incidents.unionByName(incident.select(*(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in incidents.dtypes)))


def resolve_incident(incidents: DataFrame, incident_id: str, recovery_run_id: str, now: Column) -> DataFrame:
    """An open incident becomes resolved by a recovery run; it is an error if there is no such open incident."""
    hit = (F.col("incident_id") == incident_id) & (F.col("status") == "open")
    if incidents.filter(hit).isEmpty():
        raise LookupError(f"no open incident {incident_id}")
    new = {"status": F.lit("resolved"), "recovery_run_id": F.lit(recovery_run_id), "resolved_at": now}
    return incidents.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in incidents.columns))


def explain_incident(incidents: DataFrame, incident_id: str, explanation: Column) -> DataFrame:
    """Only the explanation is replaced; it is an error if there is no such incident."""
    hit = F.col("incident_id") == incident_id
    if incidents.filter(hit).isEmpty():
        raise LookupError(f"no incident {incident_id}")
    return incidents.withColumn("explanation", F.when(hit, explanation).otherwise(F.col("explanation")))


def healthy_volumes(files: DataFrame, runs: DataFrame, before: Column | None = None, kind: str | None = None, k: int = 7) -> DataFrame:
    """The latest k row counts of each source in healthy runs, newest first (rank 1): files loaded or quarantined, of one batch kind."""
    ok = runs.filter("status = 'healthy'")
    if kind is not None:
        ok = ok.filter(F.col("batch_id").contains(f"-{kind}-"))
    if before is not None:
        ok = ok.filter(F.col("started_at") < before)
    rows = files.filter(F.col("status").isin("loaded", "quarantined")).join(ok.select("run_id", "started_at"), "run_id")
    nth = F.row_number().over(W.partitionBy("source_name").orderBy(F.desc("started_at"), F.desc("run_id")))
    return rows.withColumn("rank", nth).filter(F.col("rank") <= min(k, 30)).select("source_name", "run_id", "row_count", "rank")
