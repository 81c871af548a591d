"""Maintenance of keyed tables: every operator takes the stored rows and the incoming ones and gives the next version, as a plan."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import at, hours


def _all(columns: Iterable[str]) -> Column:
    return F.struct(*columns)


def upsert(target: DataFrame, incoming: DataFrame, key: list[str], replaces: Column | None = None) -> DataFrame:
    """target with incoming rows put in: new keys always, known ones where `replaces` (of columns old.* and new.*) holds, or always.

    One full outer join on the key; each side has one row a key."""
    old = target.select(*key, _all(target.columns).alias("old"))
    new = incoming.select(*key, _all(target.columns).alias("new"))
    take = F.col("old").isNull() | (F.col("new").isNotNull() & (F.lit(True) if replaces is None else F.coalesce(replaces, F.lit(False))))
    return old.join(new, key, "full_outer").select(F.when(take, F.col("new")).otherwise(F.col("old")).alias("r")).select("r.*")


def upsert_current(target: DataFrame, incoming: DataFrame, key: str, checksum: str = "_record_checksum", clock: str = "updated_at") -> DataFrame:
    """The current state of a source: a known row changes only if its checksum differs and the incoming one isn't older; a tie goes
    to the incoming row. An unchanged row keeps its lineage columns, so that a replay refreshes nothing."""
    changed = ~F.col(f"old.{checksum}").eqNullSafe(F.col(f"new.{checksum}"))
    return upsert(target, incoming, [key], changed & (F.col(f"new.{clock}") >= F.col(f"old.{clock}")))


def upsert_checks(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Check results by run and check: status, observed value, evidence and time are replaced; name, type, scope and severity stay."""
    fixed = ("check_name", "check_type", "scope", "severity", "expected")
    known = target.select("run_id", "check_id", F.struct(*fixed).alias("_fixed"))
    both = incoming.join(known, ["run_id", "check_id"], "left")
    kept = both.select(*(F.coalesce(f"_fixed.{c}", c).alias(c) if c in fixed else F.col(c) for c in target.columns))
    return upsert(target, kept, ["run_id", "check_id"])


def insert_absent(target: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    return target.unionByName(incoming.dropDuplicates(key).join(target, key, "left_anti").select(target.columns))


def latest(df: DataFrame, key: list[str], *order: Column, k: int = 1) -> DataFrame:
    """The first k rows of each key in an order; the order should end in a tie-break."""
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("_nth") <= k).drop("_nth")


def lookback_start(target: DataFrame, clock: str, lookback_hours: int = 48):
    """The time from which an incremental run reads again: the latest stored event less the lookback; None for an empty table.

    A literal, so that the filter reaches the scan of the source."""
    return target.agg((F.max(clock) - hours(lookback_hours)).alias("t")).first()[0]


def incremental_slice(source: DataFrame, clock: str, target: DataFrame | None = None, lookback_hours: int = 48, start: str | None = None, end: str | None = None, latest: str | None = None) -> DataFrame:
    """What a run reads: [start, end) if a start is given (else the end is ignored), the lookback of a stored table, or everything.

    `latest`, where it is known (from a store's zones), saves the look for the latest stored event."""
    if start is not None:
        part = source.filter(F.col(clock) >= at(start))
        return part if end is None else part.filter(F.col(clock) < at(end))
    if latest is not None:
        since = datetime.fromisoformat(latest) - timedelta(hours=lookback_hours)
    else:
        since = lookback_start(target, clock, lookback_hours) if target is not None else None
    return source if since is None else source.filter(F.col(clock) >= F.lit(since))


def delete_insert(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """target with the rows of the slice in place of those of the same keys."""
    return target.join(rows.select(key), key, "left_anti").select(target.columns).unionByName(rows.select(target.columns))


def scd2(history: DataFrame | None, source: DataFrame, key: str, clock: str, as_of: str) -> DataFrame:
    """History with valid_from (inclusive) and valid_to (exclusive, null: current).

    A key whose clock is later than its current version's start gets a new version, and the old one ends there; a vanished key's
    version ends at `as_of`; all else stays."""
    if history is None:
        return scd2_changes(None, source, key, clock, as_of)
    current, closed = history.filter("valid_to is null"), history.filter("valid_to is not null")
    opened = _versions(current, source, key, clock, as_of, F.lit(True))
    return closed.select(opened.columns).unionByName(opened)


def scd2_changes(history: DataFrame | None, source: DataFrame, key: str, clock: str, as_of: str) -> DataFrame:
    """Only the versions that `scd2` adds or ends, by (key, valid_from): what is put on top of a stored history."""
    if history is None:
        return source.select("*", F.col(clock).alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return _versions(history.filter("valid_to is null"), source, key, clock, as_of, F.lit(False))


def _versions(current: DataFrame, source: DataFrame, key: str, clock: str, as_of: str, unchanged: Column) -> DataFrame:
    """The current versions as they end or, where `unchanged` holds, go on, and the new ones."""
    columns = source.columns
    old = current.select(key, F.struct(*current.columns).alias("old"))
    new = source.select(key, F.struct(*columns).alias("new"))
    both = old.join(new, key, "full_outer")
    newer = F.col("old").isNotNull() & (F.col(f"new.{clock}") > F.col("old.valid_from"))
    end = F.when(F.col("new").isNull(), at(as_of)).when(newer, F.col(f"new.{clock}"))
    versions = F.array_compact(
        F.array(
            F.when(F.col("old").isNotNull() & (unchanged | end.isNotNull()), F.struct(*(F.col(f"old.{c}").alias(c) for c in columns), F.col("old.valid_from").alias("valid_from"), end.cast("timestamp_ntz").alias("valid_to"))),
            F.when(
                F.coalesce(F.col("old").isNull() | newer, F.lit(False)),
                F.struct(*(F.col(f"new.{c}").alias(c) for c in columns), F.col(f"new.{clock}").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to")),
            ),
        )
    )
    return both.select(F.explode(versions).alias("v")).select("v.*")


def table_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, column_name, left_value, right_value) of every cell that differs; a row that one side lacks differs in the column "*"."""
    columns = [c for c in left.columns if c != key]
    a = left.select(F.col(key), F.struct(*columns).alias("a"))
    b = right.select(F.col(key), F.struct(*(F.col(c) for c in columns)).alias("b"))
    both = a.join(b, key, "full_outer")
    cell = lambda c: F.when(
        ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.struct(F.lit(c).alias("column_name"), F.col(f"a.{c}").cast("string").alias("left_value"), F.col(f"b.{c}").cast("string").alias("right_value"))
    )
    whole = F.struct(F.lit("*").alias("column_name"), F.when(F.col("a").isNotNull(), "present").alias("left_value"), F.when(F.col("b").isNotNull(), "present").alias("right_value"))
    cells = F.when(F.col("a").isNull() | F.col("b").isNull(), F.array(whole)).otherwise(F.array_compact(F.array(*map(cell, columns))))
    return both.select(key, F.explode(cells).alias("x")).select(key, "x.*")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(model_name, row_count) of up to 100 tables, more are an error; parquet counts come from footers."""
    if len(tables) > 100:
        raise ValueError(f"{len(tables)} tables, more than 100")
    out = None
    for name, df in sorted(tables.items()):
        part = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("model_name"), "row_count")
        out = part if out is None else out.unionByName(part)
    return out
