"""Scalar coercions that every operator shares, as Column expressions.

A field's value has three readings: its text, its number and its moment (milliseconds
since the epoch, UTC). All stay in the JVM. Null means missing or blank JSON null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a number must look like, the least epoch seconds and milliseconds
# that count as moments, and the length of a day.
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
PLAIN_NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"
EPOCH_SECONDS_FLOOR, EPOCH_MS_FLOOR = 1e9, 1e11
DAY_MS = 86_400_000
NOT_SET = "(not set)"
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body names it. For values that are
    costly; a plain column needs no name."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(text: Column) -> Column:
    """Without white space at either end, line ends and tabs included."""
    return F.regexp_replace(text, r"^[\s\u00A0\uFEFF]+|[\s\u00A0\uFEFF]+$", "")


def number_text(d: Column) -> Column:
    """A double in its shortest plain form: 10, 100.5, 1e+21, 1e-7."""
    size = F.abs(d)
    java = d.cast("string")
    plain = F.regexp_replace(java.try_cast("decimal(38,22)").cast("string"), r"\.?0+$", "")
    exponent = F.regexp_replace(F.regexp_replace(F.regexp_replace(java, r"\.0E", "E"), "E-", "e-"), "E", "e+")
    whole = F.when(size < 1e15, d.try_cast("long").cast("string")).otherwise(java.try_cast("decimal(38,0)").cast("string"))
    return F.when(size >= 1e21, exponent).when((size >= 1e15) | (d == F.floor(d)), whole).when(size < 1e-6, exponent).otherwise(plain)


def to_number(text: Column) -> Column:
    """Finite number that a text spells (decimal, or 0x, 0o and 0b integers), else null."""
    s = trimmed(text)
    d = s.try_cast("double")
    decimal = F.when(s.rlike(NUMBER) & (F.abs(d) < float("inf")), d)
    based = lambda prefix, digits, base: F.when(s.rlike(f"^0[{prefix}][{digits}]+$"), F.conv(F.substring(s, 3, 64), base, 10).cast("double"))
    return F.coalesce(decimal, F.when(s.rlike("^0[xXoObB]"), F.coalesce(based("xX", "0-9a-fA-F", 16), based("oO", "0-7", 8), based("bB", "01", 2))))


def epoch_ms(number: Column) -> Column:
    """Milliseconds of a number that is an epoch in milliseconds or seconds, else null."""
    return F.when(number >= EPOCH_MS_FLOOR, number).when(number >= EPOCH_SECONDS_FLOOR, number * 1000).try_cast("long")


def to_ms(text: Column) -> Column:
    """Moment that a text names: an epoch number or an ISO date or time (UTC where it has no zone), else null."""
    s = trimmed(text)
    zoned = F.regexp_replace(s, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    iso = F.when(s.rlike(_ISO), F.unix_millis(F.when(s.rlike(r"[+-][0-9]{4}$") & s.contains(":"), zoned).otherwise(s).try_cast("timestamp")))
    return F.when(s.rlike(PLAIN_NUMBER), epoch_ms(s.try_cast("double"))).otherwise(iso)


def iso_ms(ms: Column) -> Column:
    """2026-07-21T14:23:45.000Z"""
    return F.date_format(F.timestamp_millis(ms.cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def round6(n: Column) -> Column:
    """Six decimals, halves towards plus infinity; numbers too large to have six are left alone."""
    return F.when(F.abs(n) < 9e12, F.floor(n * 1e6 + 0.5) / 1e6).otherwise(n)


def group_label(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", NOT_SET).otherwise(text)


def bucket_key(ms: Column, unit: str) -> Column:
    """The name of a moment's year, quarter, month, ISO week or day."""
    at = F.timestamp_millis(ms)
    if unit == "year":
        return F.date_format(at, "yyyy")
    if unit == "month":
        return F.date_format(at, "yyyy-MM")
    if unit == "quarter":
        return F.concat(F.date_format(at, "yyyy"), F.lit("-Q"), F.quarter(at).cast("string"))
    if unit == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), at).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"))
    return F.date_format(at, "yyyy-MM-dd")
