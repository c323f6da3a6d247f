"""Casts and arithmetic that answer null, or wrap, where the platform's ANSI mode raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_to_boolean(c: Column) -> Column:
    """True for every non-empty string."""
    return F.length(c) > 0


def number_to_boolean(c: Column) -> Column:
    return c != 0


def number_to_timestamp(c: Column) -> Column:
    """Every number counts seconds; widened first so that small types do not overflow."""
    return F.timestamp_seconds(c.cast("bigint"))


def string_to_int(c: Column, kind: str = "int") -> Column:
    """Integral part of a decimal text, null for text that is no number."""
    return c.try_cast("decimal(38,10)").try_cast(kind)


def safe_divide(a: Column, b: Column) -> Column:
    """Fractional division, null for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wrapping_add(a: Column, b: Column) -> Column:
    """64-bit addition modulo 2^64."""
    wide = a.cast("decimal(20,0)") + b.cast("decimal(20,0)")
    top = F.lit("18446744073709551616").cast("decimal(21,0)")
    half = F.lit("9223372036854775808").cast("decimal(20,0)")
    return (F.pmod(wide + half, top) - half).cast("bigint")


def trimmed_timestamp_text(c: Column) -> Column:
    """Timestamp as text without trailing zeros of the fraction."""
    return F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.0+$|(\.\d*[1-9])0+$", "$1")
