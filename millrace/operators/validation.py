"""Staged validation of source rows against contracts, all in column expressions.

Stages: (a) presence, nulls and repeated keys; (b) columns, for rows without a reason so far; (c) rows, likewise; (d) parents, for
rows that (a) to (c) accept. Within a stage all reasons are kept. Sources hold text; `_source_row_number` gives the file's order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import at, bounded_text
from .contracts import CELL, CONTRACTS, PRESENCE, Contract, Predicate
from .contracts import ROW as ROWS

REASON = "array<struct<code:string,column:string,check:string,message:string,value:string>>"
ROW = "_source_row_number"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"
ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"


def parsed(name: str, kind: str) -> Column:
    """The typed value of a text column, null where it can't be read."""
    c = F.col(name).cast("string")
    if kind == "integer":
        return F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast("long"))
    if kind == "number":
        n = F.trim(c).try_cast("double")
        return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)
    if kind == "date":
        return F.when(c.rlike(ISO_DAY), c.try_cast("date"))
    if kind == "timestamp":
        text = F.regexp_replace(F.regexp_replace(c, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")
        utc = F.when(c.rlike(ISO_TIME), text.try_cast("timestamp"))
        return F.to_utc_timestamp(utc, F.current_timezone()).cast("timestamp_ntz")
    return c


def _reason(code: str, column: str, check: str, message: str, broken: Column, value: Column | None = None) -> Column:
    return F.when(
        F.coalesce(broken, F.lit(False)),
        F.struct(
            F.lit(code).alias("code"),
            F.lit(column).alias("column"),
            F.lit(check).alias("check"),
            F.lit(message).alias("message"),
            (bounded_text(value.cast("string")) if value is not None else F.lit(None).cast("string")).alias("value"),
        ),
    )


def _kept(*reasons: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*reasons))) if reasons else F.array().cast(REASON)


class _Cells:
    """A source's rows as predicates see them."""

    def __init__(self, contract: Contract, now: Column) -> None:
        self.kinds, self.now = contract.kinds, now

    def text(self, name: str) -> Column:
        return F.col(name).cast("string")

    def value(self, name: str) -> Column:
        return parsed(name, self.kinds[name])


def _presence(contract: Contract, header: list[str], cells: _Cells) -> Column:
    out = []
    for p in (p for p in contract.predicates if p.stage == PRESENCE):
        if p.columns[0] in header:
            out.append(_asked(p, cells))
        else:
            out.append(_reason("missing_required_column", p.columns[0], "column_present", f"{p.columns[0]} is not in the file", F.lit(True)))
    if contract.key in header:
        out.append(_reason("duplicate_identifier", contract.key, "unique", f"{contract.key} repeats an earlier row of the file", F.col(ROW) > F.col("_first"), F.col(contract.key)))
    return _kept(*out)


def _asked(p: Predicate, cells: _Cells) -> Column:
    """A predicate's reason, with the cell as evidence if it is about one that is given."""
    if p.stage != CELL:
        return _reason(p.code, ",".join(p.columns), p.check, p.message, p.broken(cells))
    text = cells.text(p.columns[0])
    return _reason(p.code, p.columns[0], p.check, p.message, text.isNotNull() & p.broken(cells), text)


def _stage(contract: Contract, stage: int, header: list[str], cells: _Cells) -> Column:
    """All reasons of a stage; cells of columns that the file lacks aren't asked."""
    return _kept(*(_asked(p, cells) for p in contract.predicates if p.stage == stage and (stage != CELL or p.columns[0] in header)))


def validate(df: DataFrame, contract: Contract, as_of: str, header: list[str] | None = None) -> DataFrame:
    """The contract's columns (absent ones null, others dropped) and row number, with `reasons`, empty for accepted rows.

    A key counts as used from its first row on, even if that row is rejected; null keys use none. Rows meet only the first rows of
    keys that repeat, so that a key of any number of rows is no task of its own."""
    header = [c for c in df.columns if c != ROW] if header is None else header
    present, cells = [c for c in contract.columns if c in header], _Cells(contract, at(as_of))
    out = df.select(ROW, *(F.col(c).cast("string").alias(c) if c in present else F.lit(None).cast("string").alias(c) for c in contract.columns))
    # the first row of keys that repeat; partial minima are made before the shuffle, so that no key is gathered
    firsts = out.filter(F.col(contract.key).isNotNull()).groupBy(F.col(contract.key).alias("_key")).agg(F.min(ROW).alias("_first"), F.max(ROW).alias("_last"))
    out = out.join(firsts.filter("_last > _first").drop("_last"), F.col(contract.key) == F.col("_key"), "left").drop("_key").withColumn("reasons", _presence(contract, header, cells))
    clean = F.size("reasons") == 0
    out = out.withColumn("reasons", F.when(clean, _stage(contract, CELL, header, cells)).otherwise(F.col("reasons")))
    out = out.withColumn("reasons", F.when(clean, _stage(contract, ROWS, header, cells)).otherwise(F.col("reasons")))
    return out.drop("_first")


def with_parents(df: DataFrame, contract: Contract, accepted: dict[str, DataFrame]) -> DataFrame:
    """Stage (d): rows without a reason whose parent isn't accepted in the same batch get one."""
    for column, parent in contract.parents.items():
        clean = F.size("reasons") == 0
        if parent not in accepted:
            reason = _reason("missing_parent_source", column, "foreign_key", f"{parent} is not in the batch", F.lit(True), F.col(column))
            df = df.withColumn("reasons", F.when(clean, F.array(reason)).otherwise(F.col("reasons")))
            continue
        parents = accepted[parent].select(F.col(CONTRACTS[parent].key).alias("_parent"))
        reason = _reason("referential_integrity_violation", column, "foreign_key", f"{column} has no accepted row in {parent}", F.lit(True), F.col(column))
        # a rejected row needs no parent; without its key it doesn't crowd the join
        df = df.withColumn("_child", F.when(clean, F.col(column))).join(parents, F.col("_child") == F.col("_parent"), "left")
        df = df.withColumn("reasons", F.when(clean & F.col("_parent").isNull(), F.array(reason)).otherwise(F.col("reasons"))).drop("_child", "_parent")
    return df


@dataclass
class Drift:
    """What a header lacks or adds; kind: breaking if any declared column is missing, nullable ones included; additive; or none."""

    source: str
    expected: list[str]
    actual: list[str]
    missing: list[str]
    unexpected: list[str]
    kind: str | None


def drift_of(contract: Contract, header: list[str]) -> Drift:
    missing, unexpected = [c for c in contract.columns if c not in header], sorted(c for c in header if c not in contract.columns)
    return Drift(contract.source, list(contract.columns), list(header), missing, unexpected, "breaking" if missing else "additive" if unexpected else None)


@dataclass
class Validated:
    rows: DataFrame
    drift: Drift

    @property
    def accepted(self) -> DataFrame:
        return self.rows.filter(F.size("reasons") == 0).drop("reasons")

    @property
    def quarantined(self) -> DataFrame:
        return self.quarantined_with()

    def quarantined_with(self, *more: str) -> DataFrame:
        """Rejected rows with their payload and reasons, and more of their columns."""
        payload = F.create_map(*(x for c in self.drift.expected for x in (F.lit(c), F.col(c))))
        return self.rows.filter(F.size("reasons") > 0).select(F.lit(self.drift.source).alias("source_name"), ROW, payload.alias("raw_payload"), "reasons", *more)


def validate_batch(batch: dict[str, DataFrame], as_of: str) -> dict[str, Validated]:
    """All sources of a batch, parents first, so that a rejected parent rejects its children."""
    out: dict[str, Validated] = {}
    for source, contract in CONTRACTS.items():
        if source in batch:
            header = [c for c in batch[source].columns if c != ROW]
            rows = with_parents(validate(batch[source], contract, as_of, header), contract, {s: v.accepted for s, v in out.items()})
            out[source] = Validated(rows, drift_of(contract, header))
    return out


def typed(df: DataFrame, contract: Contract, *more: str) -> DataFrame:
    """Accepted rows with their columns parsed, and more columns as they are."""
    return df.select(ROW, *more, *(parsed(c, kind).alias(c) for c, kind in contract.kinds.items()))


def reason_rows(df: DataFrame) -> DataFrame:
    """One row a reason: row number, code and column."""
    return df.select(ROW, F.explode("reasons").alias("r")).select(ROW, F.col("r.code").alias("code"), F.col("r.column").alias("column_name"))


def drift_frame(spark, drifts: list[Drift]) -> DataFrame:
    """Drift records as rows, only of sources that have any."""
    rows = [(d.source, d.kind, d.expected, d.actual, d.missing, d.unexpected) for d in drifts if d.kind]
    return spark.createDataFrame(rows, "source_name string, change_type string, expected_columns array<string>, actual_columns array<string>, missing_columns array<string>, unexpected_columns array<string>")
