"""Column expressions that type and canonicalise single values. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shapes that count as numbers, identifiers and dates.
INT = r"^[+-]?[0-9]+\z"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
NOT_FINITE = r"(?i)^[+-]?(nan|infinity)\z"
OPAQUE_ID = r"^[A-Za-z0-9_\-]{6,64}\z"
RECORD_ID = r"^([A-Za-z0-9]{15}|[A-Za-z0-9]{18})\z"
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
ISO_DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?\z"
#: Texts longer than any identifier travel as digests: only their equality and their length matter.
LONG = 64


def as_int(value: Column) -> Column:
    """The 64-bit integer that a text spells, without blanks; else null."""
    return F.when(value.rlike(INT), value.try_cast("bigint"))


def as_float(value: Column) -> Column:
    return F.when(value.rlike(FLOAT) | value.rlike(NOT_FINITE), value.try_cast("double"))


def as_bool(value: Column) -> Column:
    return F.when(F.lower(value).isin("true", "false"), F.lower(value) == "true")


def kind_of_text(value: Column) -> Column:
    return F.when(as_int(value).isNotNull(), "int").when(as_float(value).isNotNull(), "float").when(as_bool(value).isNotNull(), "bool").otherwise("str")


def canonical(kind: Column, value: Column) -> Column:
    """The text by which typed values are equal: 7, 07 and 7.0, true and TRUE, 2.5 and 2.50."""
    number = as_float(value)
    whole = (number == F.floor(number)) & (F.abs(number) < 9.2e18)
    return (
        F.when(kind == "int", as_int(value).cast("string"))
        .when(kind == "float", F.when(whole, number.try_cast("bigint").cast("string")).otherwise(number.cast("string")))
        .when(kind == "bool", F.when(F.lower(value) == "true", "True").otherwise("False"))
        .otherwise(value)
    )


def compact(value: Column) -> Column:
    """A value, or for a long text that is no number the digest that stands for it."""
    long = (F.length(value) > LONG) & ~value.rlike(r"^[0-9eE+.\-]+\z")
    return F.when(long, F.concat(F.lit("\x02"), F.sha2(value, 256))).otherwise(value)


def record_token(value: Column) -> Column:
    """The type prefix of a 15 or 18 character record id; else null."""
    return F.when(value.rlike(RECORD_ID), F.substring(value, 1, 3))
