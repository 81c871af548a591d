"""Questions about runs, checks, quarantine, models and lineage, each a DataFrame query with bounded output."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import latest

MOST_ROWS, MOST_OFFSET = 100, 10_000
SEVERITY = {"error": 0, "warning": 1, "info": 2}


def checked_name(value: str) -> str:
    """An identifier that a query may take, else an error."""
    if not re.fullmatch(r"[A-Za-z0-9_:.\-]{1,200}", value):
        raise ValueError("not a safe identifier")
    return value


def page(df: DataFrame, *order: Column, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest-first pages and the like: the order must end in a tie-break."""
    if not (1 <= limit <= MOST_ROWS and 0 <= offset <= MOST_OFFSET):
        raise ValueError(f"limit from 1 to {MOST_ROWS}, offset from 0 to {MOST_OFFSET}")
    return df.orderBy(*order).offset(offset).limit(limit)


def list_runs(runs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return page(runs, F.desc("started_at"), F.desc("run_id"), limit=limit, offset=offset)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.filter(F.col("run_id") == checked_name(run_id))


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)


def latest_healthy_before(runs: DataFrame, before: Column) -> DataFrame:
    return latest_run(runs.filter((F.col("status") == "healthy") & (F.col("started_at") < before)))


def run_stages(stages: DataFrame, run_id: str) -> DataFrame:
    return stages.filter(F.col("run_id") == checked_name(run_id)).orderBy("started_at", "stage_name")


def quality_summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("run_id", "check_type", "status", "severity").agg(F.count("*").alias("check_count"))


def severity_rank(column: str = "severity") -> Column:
    out = F.lit(len(SEVERITY))
    for name, k in SEVERITY.items():
        out = F.when(F.col(column) == name, k).otherwise(out)
    return out


def failed_checks(checks: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Failed and warning checks, the gravest first, then the newest."""
    return page(checks.filter(F.col("status").isin("failed", "warning")), severity_rank(), F.desc("occurred_at"), F.asc("check_id"), limit=limit, offset=offset)


def single_check(checks: DataFrame, check_id: str) -> DataFrame:
    return latest_by(checks.filter(F.col("check_id") == checked_name(check_id)), ["check_id"], "occurred_at", "run_id")


def latest_by(df: DataFrame, key: list[str], clock: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    return latest(df, key, F.desc(clock), F.desc(tie))


def quarantine_summary(quarantine: DataFrame) -> DataFrame:
    """Rejected rows by source and reason; a row counts once for each of its codes."""
    codes = quarantine.select("source_name", F.explode(F.array_distinct("reasons.code")).alias("code"))
    return codes.groupBy("source_name", "code").agg(F.count("*").alias("row_count"))


def quarantine_page(quarantine: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Rejected rows without their payload."""
    shown = quarantine.select("source_name", "_source_row_number", F.array_join(F.array_sort(F.array_distinct("reasons.code")), ",").alias("codes"))
    return page(shown, F.col("source_name"), F.col("_source_row_number"), limit=limit, offset=offset)


def quality_trend_by_run(trends: DataFrame, limit: int = 100) -> DataFrame:
    return trends.orderBy(F.desc("quality_date"), "check_type", "scope").limit(limit)


#: Counts of a run whose differences a comparison tells.
RUN_COUNTS = ("source_file_count", "source_row_count", "accepted_row_count", "quarantined_row_count", "passed_checks", "failed_checks")


def compare_runs(counts: DataFrame, left: str, right: str) -> DataFrame:
    """(run_id, model_row_counts map) of two runs: each model's counts and their difference; a model that one run lacks has no
    difference and is marked unavailable."""
    side = lambda run, name: counts.filter(F.col("run_id") == run).select(F.explode("model_row_counts").alias("model_name", name))
    both = side(left, "left_rows").join(side(right, "right_rows"), "model_name", "full_outer")
    return both.select(
        "model_name", "left_rows", "right_rows", (F.col("right_rows") - F.col("left_rows")).alias("delta"), (F.col("left_rows").isNull() | F.col("right_rows").isNull()).alias("unavailable")
    )


def compare_run_counts(runs: DataFrame, left: str, right: str) -> DataFrame:
    """One row: the runs' statuses and, for each of RUN_COUNTS that runs has, right less left, nulls as 0. No row if a run is missing."""
    names = [c for c in RUN_COUNTS if c in runs.columns]
    one = lambda run, side: runs.filter(F.col("run_id") == checked_name(run)).select(F.struct("run_id", "status", *names).alias(side))
    delta = lambda c: F.coalesce(F.col(f"b.{c}"), F.lit(0)) - F.coalesce(F.col(f"a.{c}"), F.lit(0))
    return one(left, "a").crossJoin(one(right, "b")).select(  # one row each
        F.col("a.run_id").alias("left_run_id"), F.col("b.run_id").alias("right_run_id"), F.col("a.status").alias("status_from"), F.col("b.status").alias("status_to"), *(delta(c).alias(f"{c}_delta") for c in names)
    )


def latest_models(models: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the catalogue: the newest row of each model, by name."""
    return page(latest_by(models, ["model_name"], "discovered_at", "run_id"), F.col("model_name"), limit=limit, offset=offset)


def model_by_name(models: DataFrame, name: str) -> DataFrame:
    return latest_by(models.filter(F.col("model_name") == checked_name(name)), ["model_name"], "discovered_at", "run_id")


def model_columns(models: DataFrame, columns: DataFrame, name: str) -> DataFrame:
    """The columns of a model's newest version, in order."""
    newest = model_by_name(models, name).select("run_id", "model_name")
    return columns.join(newest, ["run_id", "model_name"], "left_semi").orderBy(F.asc_nulls_last("ordinal_position"))


def direct_lineage(edges: DataFrame, name: str) -> DataFrame:
    """(direction, node): parents and children in one."""
    own = F.lit(checked_name(name))
    parents = edges.filter(F.col("child") == own).select(F.lit("parent").alias("direction"), F.col("parent").alias("node"))
    return parents.unionByName(edges.filter(F.col("parent") == own).select(F.lit("child").alias("direction"), F.col("child").alias("node"))).distinct()


def latest_edges(edges: DataFrame) -> DataFrame:
    """The edges of the newest run."""
    last = edges.agg(F.max_by("run_id", F.struct("discovered_at", "run_id")).alias("_last"))
    return edges.join(F.broadcast(last), F.col("run_id") == F.col("_last"), "left_semi")  # one row


def downstream(edges: DataFrame, roots: DataFrame, most_depth: int = 20) -> DataFrame:
    """(node, depth): everything reachable from roots (node) over edges (parent, child) in at most `most_depth` steps, at its least
    depth. A root is in the result only if it is reached. Each step visits new nodes only, so cycles end."""
    links = edges.select("parent", "child")  # repeated edges end in the distinct nodes of a step
    found: list[DataFrame] = []
    frontier = roots.select(F.col("node")).distinct()
    for depth in range(1, most_depth + 1):
        fresh = frontier.join(links, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct()
        if found:
            fresh = fresh.join(_all(found).select("node"), "node", "left_anti")
        fresh = fresh.select("node", F.lit(depth).alias("depth")).persist()
        if fresh.isEmpty():
            fresh.unpersist()
            return _all(found) if found else fresh
        found.append(fresh)  # each step's nodes are kept once
        frontier = fresh.select("node")
    return _all(found)


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def affected_downstream(edges: DataFrame, checks: DataFrame) -> DataFrame:
    """What lies below the scopes of failed and warning checks."""
    roots = checks.filter(F.col("status").isin("failed", "warning")).select(F.col("scope").alias("node"))
    return downstream(edges, roots).select("node", "depth")


def incident_evidence(checks: DataFrame, reasons: DataFrame, drifts: DataFrame, deltas: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    """(section, kind, name, value): up to 100 failed or warning checks (kind: their type), reason counts as source:code (kind: the
    code), up to 50 drifts, the row-count differences of models that both runs have, and up to 20 models (node) that lineage marks."""
    row = lambda df, section, kind, name, value: df.select(F.lit(section).alias("section"), kind.alias("kind"), name.alias("name"), value.cast("string").alias("value"))
    parts = [
        row(failed_checks(checks, limit=MOST_ROWS), "check", F.col("check_type"), F.col("check_id"), F.col("status")),
        row(reasons, "reason", F.col("code"), F.concat_ws(":", "source_name", "code"), F.col("row_count")),
        row(drifts.orderBy("source_name").limit(50), "schema", F.col("change_type"), F.col("source_name"), F.col("change_type")),
        row(deltas.filter("not unavailable"), "delta", F.lit("rows"), F.col("model_name"), F.col("delta")),
    ]
    if affected is not None:
        parts.append(row(affected.select("node").distinct().orderBy("node").limit(20), "lineage", F.lit("model"), F.col("node"), F.lit("downstream")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: By section and kind of a piece of evidence ("*": any kind): what may lie behind it, and where to look; `{}` is the evidence's name.
CLUES = (
    ("check", "freshness", "Deliveries may have paused or be running late.", "See when {} last delivered."),
    ("check", "timeliness", "Readings may be held back before they are sent.", "See how long readings wait in {}."),
    ("check", "volume", "A delivery may be partial, doubled or of another scope.", "Hold the row count behind {} against the days before."),
    ("check", "model_test", "Accepted rows may break a rule that spans columns or tables.", "Read the rows that {} counts."),
    ("reason", "duplicate_identifier", "A delivery may contain the same record more than once.", "List the row numbers that share a key in {}."),
    ("reason", "out_of_range", "A unit or a scale may have changed at the origin.", "Hold the rejected numbers of {} against the contract's limits."),
    ("reason", "invalid_enum", "The origin may use a value that the contract doesn't know.", "List the new values in {}."),
    ("reason", "invalid_type", "A column may have moved or changed its format.", "Look at the rejected cells of {}."),
    ("reason", "referential_integrity_violation", "A parent record may be missing or rejected.", "Look for the parents that {} refers to."),
    ("schema", "*", "An export may have changed ahead of its contract.", "Hold the header of {} against the contract."),
    ("delta", "*", None, "Decide whether the change of {} fits what the batch was to cover."),
    ("lineage", "*", None, "Once the cause is mended, rebuild and test {}."),
)
NO_FACT = "Nothing was recorded: no check, reason, schema change or row count speaks of this run."
NO_STEP = "Begin with what the run recorded, check by check."


def incident_report(evidence: DataFrame) -> DataFrame:
    """(section, ordinal, text): facts from evidence, hypotheses and next steps by CLUES, each once, in order; at most 30, 20 and 20.
    Without evidence one fact says so, and one step says where to begin.

    Hypotheses never become facts."""
    sections = ("check", "reason", "schema", "delta", "lineage")
    order = F.array_position(F.array(*map(F.lit, sections)), F.col("section")).cast("int")
    clues = evidence.sparkSession.createDataFrame([(i, *c) for i, c in enumerate(CLUES)], "_rank int, of string, clue string, guess string, step string")
    met = evidence.join(F.broadcast(clues), (F.col("section") == F.col("of")) & ((F.col("clue") == "*") | (F.col("clue") == F.col("kind"))), "left")  # CLUES, a fixed list
    line = lambda section, o, text: F.when(text.isNotNull(), F.struct(F.lit(section).alias("section"), o.alias("o"), F.col("name"), text.alias("text")))
    fact = F.concat(F.initcap("section"), F.lit(" "), "name", F.lit(" recorded "), F.col("value"), F.lit("."))
    said = F.array_compact(F.array(line("fact", order, fact), line("hypothesis", F.col("_rank"), F.col("guess")), line("next_step", F.col("_rank"), F.replace("step", F.lit("{}"), F.col("name")))))
    lines = met.select(F.explode(said).alias("x")).select("x.*")  # evidence is made once
    last = evidence.sparkSession.createDataFrame([("fact", 99, "", NO_FACT), ("next_step", 99, "", NO_STEP)], "section string, o int, name string, text string")
    once = lines.unionByName(last).groupBy("section", "text").agg(F.min(F.struct("o", "name")).alias("first"))
    # evidence is bounded, and so is what one section holds
    nth = F.row_number().over(W.partitionBy("section").orderBy("first", "text"))
    most = F.when(F.col("section") == "fact", 30).otherwise(20)
    spare = (F.col("first.o") == 99) & (F.col("ordinal") > 1)
    return once.withColumn("ordinal", nth).filter((F.col("ordinal") <= most) & ~spare).select("section", "ordinal", "text")


def incident_by_id(incidents: DataFrame, incident_id: str) -> DataFrame:
    return incidents.filter(F.col("incident_id") == checked_name(incident_id))


def handoff(incidents: DataFrame, incident_id: str) -> DataFrame:
    """What to hand over with an incident."""
    return incident_by_id(incidents, incident_id).select("incident_id", "title", "status", "failed_run_id", "recovery_run_id", "explanation")
