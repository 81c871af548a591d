"""Column expressions shared by models, contracts and checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED_VALUE = "<redacted: value exceeds evidence limit>"


def _elapsed(start: Column, end: Column, unit_micros: float) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end).cast("double") / F.lit(unit_micros)


def minutes_between(start: Column, end: Column) -> Column:
    return _elapsed(start, end, 6e7)


def hours_between(start: Column, end: Column) -> Column:
    return _elapsed(start, end, 3.6e9)


def days_between(start: Column, end: Column) -> Column:
    return _elapsed(start, end, 8.64e10)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is null or 0."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def hours(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n))


def at(as_of: str) -> Column:
    """The clock: a timestamp without zone, given by the caller."""
    return F.lit(as_of).cast("timestamp_ntz")


def freshness_class(latest: Column, as_of: Column, warn_hours: int = 24, error_hours: int = 72) -> Column:
    """missing, fresh, warning or stale; a bound belongs to the better class."""
    return (
        F.when(latest.isNull(), "missing")
        .when(latest >= as_of - hours(warn_hours), "fresh")
        .when(latest >= as_of - hours(error_hours), "warning")
        .otherwise("stale")
    )


def is_stale(latest: Column, as_of: Column, limit_hours: int = 6) -> Column:
    return latest.isNull() | (latest < as_of - hours(limit_hours))


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def sum_where(value: Column, condition: Column) -> Column:
    """The sum of matching rows, null if there are none."""
    return F.sum(F.when(condition, value))


def bounded_text(value: Column, most: int = 200) -> Column:
    """Evidence text: NUL characters are spelt out, and longer values are replaced by a marker."""
    shown = F.replace(value, F.lit("\0"), F.lit("<NUL>"))
    return F.when(F.length(value) > most, REDACTED_VALUE).otherwise(shown)


def bounded_number(value: Column) -> Column:
    """Evidence of a number as text; such as are not finite become a marker."""
    odd = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(odd, "<non-finite numeric value>").otherwise(value.cast("string"))


def bounded_names(names: Column, most: int = 100, length: int = 128) -> Column:
    """Evidence lists: each name once, long ones replaced, the first `most` of them."""
    return F.slice(F.array_distinct(F.transform(names, lambda x: F.when(F.length(x) > length, "<redacted: name>").otherwise(x))), 1, most)


def bounded_reasons(reasons: Column, most: int = 10) -> Column:
    """At most `most` reason codes, then how many were left out."""
    rest = F.concat(F.lit("... "), (F.size(reasons) - most).cast("string"), F.lit(" more"))
    return F.when(F.size(reasons) > most, F.concat(F.slice(reasons, 1, most), F.array(rest))).otherwise(reasons)


def safe_identifier(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9_:.\-]{1,200}$")


def schema_fingerprint(names: list[str]) -> Column:
    """SHA-256 of a header in its order."""
    return F.sha2(F.concat_ws("\x1f", *(F.lit(n) for n in names)), 256)


def record_checksum(columns: list[str]) -> Column:
    """SHA-256 of the declared columns as JSON, keys in order, nulls written."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
