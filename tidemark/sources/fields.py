"""Field rules of the market-data archive as Column expressions over text: a bad field is NULL, never a failed job."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Stamps from here up are microseconds; stamps at or above the ceiling are not dates.
MICROSECOND_FLOOR, STAMP_CEILING = 100_000_000_000_000, 100_000_000_000_000_000
# At most 18 digits are an integer; decimals may carry an exponent; stamps have one exact shape,
# and milliseconds past the last year nanoseconds hold do not scale.
LAST_MILLI = 9_223_372_036_854
INTEGER = r"[+-]?[0-9]{1,18}"
DECIMAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
DIGITS = r"[0-9]{1,18}"
BOOLEAN = r"(?:true|True|false|False)"
DATETIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2} (?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"


def row(*patterns: str, rest: bool = False, optional: int = 0, then: str = "") -> str:
    """The pattern of a whole row: one pass of one expression judges every field's shape.

    optional more fields of pattern then may be blank or missing at the end;
    rest allows any further fields after all of these.
    """
    tail = f"(?:,(?:{then})?" * optional + ("(?:,.*)?" if rest else "") + ")?" * optional
    return "^" + ",".join(patterns) + tail + "$"


def matched(field: Column, pattern: str, kind: str) -> Column:
    return F.when(F.rlike(field, F.lit(f"^{pattern}$")), field).try_cast(kind)


def integer(field: Column) -> Column:
    return matched(field, INTEGER, "bigint")


def decimal(field: Column) -> Column:
    return matched(field, DECIMAL, "double")


def boolean(field: Column) -> Column:
    return F.when(field.isin("true", "True"), True).when(field.isin("false", "False"), False)


def stamp_ok(raw: Column) -> Column:
    return (raw > 0) & (raw < STAMP_CEILING) & ((raw >= MICROSECOND_FLOOR) | (raw <= LAST_MILLI))


def scaled(raw: Column) -> Column:
    """A millisecond or microsecond stamp, told apart by size, as nanoseconds."""
    return raw * F.when(raw >= MICROSECOND_FLOOR, F.lit(1_000)).otherwise(F.lit(1_000_000))


def epoch_ns(field: Column) -> Column:
    raw = matched(field, DIGITS, "bigint")
    return F.when(stamp_ok(raw), scaled(raw))


def read_datetime(field: Column) -> Column:
    """A field of the one datetime shape, UTC, as nanoseconds; NULL for a day no calendar has."""
    return F.unix_micros(F.try_to_timestamp(field, F.lit("yyyy-MM-dd HH:mm:ss"))) * F.lit(1000)


def datetime_ns(field: Column) -> Column:
    """Exactly YYYY-MM-DD HH:MM:SS, UTC, as nanoseconds."""
    return read_datetime(F.when(F.rlike(field, F.lit(f"^{DATETIME}$")), field))


def stamp(ns: Column) -> Column:
    return F.timestamp_micros((ns / F.lit(1000)).cast("bigint"))
