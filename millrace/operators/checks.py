"""Data checks: each gives rows of one schema, so that they add up to one table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import at, bounded_text, count_where, hours_between
from .validation import ROW

CHECK_COLUMNS = ("check_id", "run_id", "check_name", "check_type", "scope", "status", "severity", "observed_value", "expected", "evidence", "occurred_at")


@dataclass(frozen=True)
class Rule:
    """A test of a model: its failing rows are counted. `parent`: (model, column) for relationships."""

    kind: str
    model: str
    column: str
    values: tuple[str, ...] = ()
    parent: tuple[str, str] | None = None
    other: str | None = None
    severity: str = "error"

    @property
    def check_id(self) -> str:
        return f"{self.kind}:{self.model}.{self.column}"


def failing(rule: Rule, models: dict[str, DataFrame]) -> DataFrame:
    """The rows (or keys) that break a rule."""
    df, c = models[rule.model], F.col(rule.column)
    if rule.kind == "not_null":
        return df.filter(c.isNull())
    if rule.kind == "unique":
        return df.filter(c.isNotNull()).groupBy(rule.column).count().filter("count > 1")
    if rule.kind == "relationships":
        model, column = rule.parent
        return df.filter(c.isNotNull()).join(models[model].select(F.col(column).alias("_parent")), c == F.col("_parent"), "left_anti")
    if rule.kind == "accepted_values":
        return df.filter(c.isNotNull() & ~c.isin(*rule.values))
    if rule.kind == "non_negative":
        return df.filter(c < 0)
    if rule.kind == "end_after_start":
        return df.filter(c.isNotNull() & (c < F.col(rule.other)))
    if rule.kind == "plan_overrun":
        return df.filter(c.isNotNull() & (c > 1.5 * F.col(rule.other)))
    if rule.kind == "counts_reconcile":
        return df.filter(F.col("passed_units") + F.col("failed_units") > c)
    raise ValueError(f"unknown rule {rule.kind}")


def check_row(check_id: Column | str, name: Column | str, kind: str, scope: Column | str, status: Column, severity: Column, observed: Column, expected: Column | str, run_id: str, now: Column, evidence: Column | None = None) -> list[Column]:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return [
        text(check_id).alias("check_id"),
        F.lit(run_id).alias("run_id"),
        text(name).alias("check_name"),
        F.lit(kind).alias("check_type"),
        text(scope).alias("scope"),
        status.alias("status"),
        severity.alias("severity"),
        observed.cast("string").alias("observed_value"),
        text(expected).alias("expected"),
        (evidence if evidence is not None else F.lit(None)).cast("string").alias("evidence"),
        now.alias("occurred_at"),
    ]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_checks(rules: list[Rule], models: dict[str, DataFrame], run_id: str, as_of: str) -> DataFrame:
    """One row a rule: failed or warning (by its severity) if any row breaks it. Rules that are row conditions of one model share a
    single pass over it, and so does that of its unique key: rows are counted by the key, partial counts first."""
    by_model: dict[str, list[Rule]] = {}
    for r in rules:
        by_model.setdefault(r.model, []).append(r)
    counted = []
    for model, own in by_model.items():
        plain = [r for r in own if r.kind in PLAIN]
        keys = [r for r in own if r.kind == "unique"]
        if plain and keys:
            key = F.col(keys[0].column)
            by_key = models[model].groupBy(key.alias("_key")).agg(F.count("*").alias("_rows"), *(count_where(_condition(r)).alias(f"_c{i}") for i, r in enumerate(plain)))
            repeated = count_where(F.col("_key").isNotNull() & (F.col("_rows") > 1))
            sums = [(keys[0], repeated), *((r, F.coalesce(F.sum(f"_c{i}"), F.lit(0))) for i, r in enumerate(plain))]
            counted.append(_listed(by_key, sums))
            keys = keys[1:]
        elif plain:
            counted.append(_listed(models[model], [(r, count_where(_condition(r))) for r in plain]))
        rest = [*keys, *(r for r in own if r.kind not in PLAIN and r.kind != "unique")]
        counted += [failing(r, models).agg(F.count("*").alias("n")).select(F.lit(r.check_id).alias("check_id"), "n") for r in rest]
    about = models[rules[0].model].sparkSession.createDataFrame([(r.check_id, r.kind, r.model, r.severity) for r in rules], "check_id string, kind string, model string, severity string")
    bad = F.col("n") > 0
    status = F.when(~bad, "passed").when(F.col("severity") == "warning", "warning").otherwise("failed")
    severity = F.when(~bad, "info").otherwise(F.col("severity"))
    return _union(counted).join(about, "check_id").select(*check_row(F.col("check_id"), F.col("kind"), "model_test", F.col("model"), status, severity, F.col("n"), "0 failing rows", run_id, at(as_of)))


#: Kinds of rules that are conditions of a row.
PLAIN = ("not_null", "accepted_values", "non_negative", "end_after_start", "plan_overrun", "counts_reconcile")


def _listed(df: DataFrame, counts: list[tuple[Rule, Column]]) -> DataFrame:
    """(check_id, n) of one pass over df."""
    pairs = F.array(*(F.struct(F.lit(r.check_id).alias("check_id"), n.cast("long").alias("n")) for r, n in counts))
    return df.agg(pairs.alias("p")).select(F.explode("p").alias("p")).select("p.*")


def _condition(rule: Rule) -> Column:
    c = F.col(rule.column)
    return {
        "not_null": lambda: c.isNull(),
        "accepted_values": lambda: c.isNotNull() & ~c.isin(*rule.values),
        "non_negative": lambda: c < 0,
        "end_after_start": lambda: c.isNotNull() & (c < F.col(rule.other)),
        "plan_overrun": lambda: c.isNotNull() & (c > 1.5 * F.col(rule.other)),
        "counts_reconcile": lambda: F.col("passed_units") + F.col("failed_units") > c,
    }[rule.kind]()


def freshness_checks(freshness: DataFrame, run_id: str, as_of: str) -> DataFrame:
    """From the freshness mart: beyond 24 hours a warning, beyond 72 or without rows failed."""
    cls = F.col("freshness_status")
    status = F.when(cls == "fresh", "passed").when(cls == "warning", "warning").otherwise("failed")
    severity = F.when(cls == "fresh", "info").when(cls == "warning", "warning").otherwise("error")
    return freshness.select(
        *check_row(F.concat(F.lit("freshness:"), "source_name"), "source freshness", "freshness", F.col("source_name"), status, severity, F.col("latest_ingested_at"), "ingested within 24 hours (error beyond 72)", run_id, at(as_of))
    )


def contract_checks(rows: DataFrame, source: str, run_id: str, as_of: str) -> DataFrame:
    """Of validated rows (with reasons): one row on validity, a warning if any row was rejected, and one warning a reason code."""
    now = at(as_of)
    rejected = rows.agg(count_where(F.size("reasons") > 0).alias("n"))
    valid = rejected.select(
        *check_row(f"contract:{source}", "contract validity", "contract", source, F.when(F.col("n") > 0, "warning").otherwise("passed"), F.when(F.col("n") > 0, "warning").otherwise("info"), F.col("n"), "0 rejected rows", run_id, now)
    )
    codes = reason_counts(rows)
    per = codes.select(*check_row(F.concat(F.lit(f"contract:{source}:"), "code"), "contract reason", "contract", source, F.lit("warning"), F.lit("warning"), F.col("n"), "0 rows", run_id, now))
    return valid.unionByName(per)


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("reasons.code").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def drift_checks(drifts: DataFrame, run_id: str, as_of: str) -> DataFrame:
    """Of drift rows: a breaking change fails, an additive one warns."""
    breaking = F.col("change_type") == "breaking"
    names = F.concat(F.lit("missing: "), F.array_join("missing_columns", ","), F.lit("; unexpected: "), F.array_join("unexpected_columns", ","))
    return drifts.select(
        *check_row(
            F.concat(F.lit("schema:"), "source_name"), "schema drift", "schema", F.col("source_name"), F.when(breaking, "failed").otherwise("warning"), F.when(breaking, "error").otherwise("warning"), names, "the declared columns", run_id, at(as_of)
        )
    )


def late_arrivals(telemetry: DataFrame, run_id: str, as_of: str, limit_seconds: int = 86_400) -> DataFrame:
    """A warning if any accepted reading was updated more than a day after its event; evidence: the first five ids in file order."""
    late = telemetry.filter(F.timestamp_diff("MICROSECOND", F.col("event_timestamp"), F.col("updated_at")) > limit_seconds * 1_000_000)
    # the five smallest are kept by a top-k on the side, never the whole list
    first = late.select(ROW, "telemetry_id").orderBy(ROW).limit(5).agg(F.sort_array(F.collect_list(F.struct(ROW, "telemetry_id"))).alias("x")).select(F.array_join(F.col("x.telemetry_id"), ",").alias("ids"))
    n = late.agg(F.count("*").alias("n"))
    status = F.when(F.col("n") > 0, "warning").otherwise("passed")
    return n.crossJoin(first).select(  # one row each
        *check_row("late:machine_telemetry", "late arrivals", "timeliness", "machine_telemetry", status, F.when(F.col("n") > 0, "warning").otherwise("info"), F.col("n"), "no reading later than 24 hours", run_id, at(as_of), F.col("ids"))
    )


def volume_bounds(history: DataFrame) -> DataFrame:
    """(source_name, row_count, rank) of earlier healthy runs to each source's bounds: median +- max(1, a fifth of it, 3 * 1.4826 * MAD),
    not below 0. Only the seven latest count; `samples` says how many there are."""
    own = history.filter("rank <= 7").groupBy("source_name").agg(F.collect_list(F.greatest(F.col("row_count").cast("double"), F.lit(0.0))).alias("h"))  # seven at most
    med = lambda a: F.aggregate(F.slice(F.sort_array(a), F.floor((F.size(a) + 1) / 2).cast("int"), F.when(F.size(a) % 2 == 0, 2).otherwise(1)), F.lit(0.0), lambda s, x: s + x) / F.when(F.size(a) % 2 == 0, 2.0).otherwise(1.0)
    own = own.withColumn("baseline", med(F.col("h")))
    own = own.withColumn("mad", med(F.transform("h", lambda x: F.abs(x - F.col("baseline")))))
    tolerance = F.greatest(F.lit(1.0), F.col("baseline") * 0.2, F.col("mad") * (3.0 * 1.4826))
    return own.select("source_name", F.size("h").alias("samples"), "baseline", "mad", F.greatest(F.lit(0.0), F.col("baseline") - tolerance).alias("lower_bound"), (F.col("baseline") + tolerance).alias("upper_bound"))


def volume_anomaly(observed: DataFrame, history: DataFrame) -> DataFrame:
    """(source_name, observed_rows) judged by its history: passed and not evaluated below three samples, else a warning out of bounds."""
    both = observed.join(volume_bounds(history), "source_name", "left")
    evaluated = F.coalesce("samples", F.lit(0)) >= 3
    out = ~F.col("observed_rows").between(F.col("lower_bound"), F.col("upper_bound"))
    status = F.when(evaluated & out, "warning").otherwise("passed")
    bound = lambda c: F.when(evaluated, F.col(c)).alias(c)
    return both.select("source_name", "observed_rows", F.coalesce("samples", F.lit(0)).alias("samples"), evaluated.alias("evaluated"), *map(bound, ("baseline", "mad", "lower_bound", "upper_bound")), status.alias("status"))


def volume_checks(judged: DataFrame, run_id: str, as_of: str) -> DataFrame:
    """Of `volume_anomaly` rows: a warning for a source whose rows are out of the bounds of its history."""
    odd = F.col("status") == "warning"
    bounds = F.when(F.col("evaluated"), F.concat(F.lit("from "), F.format_number("lower_bound", 1), F.lit(" to "), F.format_number("upper_bound", 1), F.lit(" rows"))).otherwise(F.lit("three healthy runs at least"))
    evidence = F.concat(F.col("samples").cast("string"), F.lit(" earlier runs"))
    return judged.select(
        *check_row(F.concat(F.lit("volume:"), "source_name"), "row volume", "volume", F.col("source_name"), F.col("status"), F.when(odd, "warning").otherwise("info"), F.col("observed_rows"), bounds, run_id, at(as_of), evidence)
    )


def file_checks(decisions: DataFrame, run_id: str, as_of: str) -> DataFrame:
    """Of ledger decisions: duplicates pass as skipped; a changed logical file warns."""
    now = at(as_of)
    again = decisions.filter("decision = 'duplicate'").select(
        *check_row(F.concat(F.lit("duplicate_file:"), "source_name"), "duplicate file", "file", F.col("source_name"), F.lit("passed"), F.lit("info"), F.lit("skipped"), "each content once", run_id, now)
    )
    changed = decisions.filter("changed_logical_file").select(
        *check_row(F.concat(F.lit("changed_file:"), "source_name"), "changed logical file", "file", F.col("source_name"), F.lit("warning"), F.lit("warning"), F.col("checksum"), "one content a logical file", run_id, now)
    )
    return again.unionByName(changed)


def build_skipped(spark, run_id: str, as_of: str) -> DataFrame:
    """A run that builds no models never counts as healthy."""
    return spark.range(1).select(*check_row("build_skipped", "model build", "build", "models", F.lit("warning"), F.lit("warning"), F.lit("skipped"), "models are built", run_id, at(as_of)))


def outcome_status(outcome: Column) -> Column:
    """How a test runner's outcome counts: what is neither passed nor warned failed, skipped tests included."""
    return F.when(outcome.isin("pass", "success"), "passed").when(outcome == "warn", "warning").otherwise("failed")


def outcome_checks(outcomes: DataFrame, run_id: str, as_of: str) -> DataFrame:
    """Outcomes of a test runner (test_id, test_name, outcome, failures, depends_on array) as check rows: errors unless they passed or
    warned; the scope is the first of the test's dependencies, or the project."""
    status = outcome_status(F.lower("outcome"))
    severity = F.when(status == "passed", "info").when(status == "warning", "warning").otherwise("error")
    scope = F.coalesce(F.array_min("depends_on"), F.lit("project"))
    return outcomes.select(*check_row(F.col("test_id"), F.col("test_name"), "model_test", scope, status, severity, F.col("failures"), "0 failing rows", run_id, at(as_of), F.array_join(F.array_sort("depends_on"), ",")))


def skip_below(results: DataFrame, ancestors: dict[str, list[str]]) -> DataFrame:
    """Results of a run's tests where those of models below a failed one count as skipped: a failed test of severity error on a model
    leaves the tests of all models that read it, directly or not, without an outcome, and so failed.

    `ancestors` names what each scope reads, over any number of steps; a model's own tests don't skip each other. One pass: the failed
    scopes of a run, as many as it has rules at most, are gathered beside its rows."""
    failed = F.collect_set(F.when((F.col("status") == "failed") & (F.col("severity") == "error"), F.col("scope"))).over(W.partitionBy("run_id"))
    above = F.create_map(*(x for k, v in ancestors.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    skipped = F.coalesce(F.arrays_overlap("_failed", above[F.col("scope")]), F.lit(False))
    marked = results.withColumn("_failed", failed).withColumn("_skipped", skipped)
    new = {"status": outcome_status(F.lit("skipped")), "severity": F.lit("error"), "observed_value": F.lit("skipped")}
    return marked.select(*(F.when(F.col("_skipped"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in results.columns))


def run_status(checks: DataFrame, quarantined: Column | None = None) -> DataFrame:
    """One row a run: failed with any failed check of severity error; else degraded with a warning or a quarantined row (column
    `quarantined`, if given by run); else healthy. freshness_status: the worst of its freshness checks."""
    failed, warned = F.col("status") == "failed", F.col("status") == "warning"
    fresh = F.col("check_type") == "freshness"
    rank = F.max(F.when(fresh & failed, 3).when(fresh & warned, 2).when(fresh, 1))
    per = checks.groupBy("run_id").agg(
        count_where(F.col("status") == "passed").alias("passed_checks"),
        count_where(failed).alias("failed_checks"),
        count_where(warned).alias("warning_checks"),
        count_where(failed & (F.col("severity") == "error")).alias("errors"),
        rank.alias("f"),
    )
    status = F.when(F.col("errors") > 0, "failed").when((F.col("warning_checks") > 0) | (quarantined if quarantined is not None else F.lit(False)), "degraded").otherwise("healthy")
    return per.select("run_id", "passed_checks", "failed_checks", "warning_checks", status.alias("run_status"), F.when(F.col("f") == 1, "fresh").when(F.col("f") == 2, "warning").when(F.col("f") == 3, "stale").alias("freshness_status"))


def run_facts(runs: DataFrame) -> DataFrame:
    """Of runs with run_status and counts: what was recorded, and the next step."""
    bad = (F.col("failed_checks") > 0) | (F.col("warning_checks") > 0)
    step = F.when(bad, "Inspect failed checks, quarantine reasons and the parents of the models concerned.").otherwise("Nothing to do; keep the run as a baseline.")
    fact = F.concat(F.lit("Run "), "run_id", F.lit(" ended "), "run_status", F.lit(" with "), F.col("failed_checks").cast("string"), F.lit(" failed and "), F.col("warning_checks").cast("string"), F.lit(" warning checks."))
    return runs.select("run_id", bounded_text(fact, 500).alias("fact"), step.alias("next_step"))
