"""Lenient casts: a bad value becomes NULL, never an error (also under ANSI)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def parse_date(value: Column) -> Column:
    """ISO dates, also without leading zeros; anything else is NULL."""
    return F.try_to_timestamp(value.cast("string"), F.lit("yyyy-M-d")).cast("date")


def parse_number(value: Column) -> Column:
    """Decimal or scientific notation to double; Java type suffixes and NaN are NULL."""
    plain = F.trim(value.cast("string"))
    number = plain.try_cast("double")
    return F.when(~plain.rlike("[dDfF]$") & ~F.isnan(number), number)


def year_of(date: Column) -> Column:
    return F.year(date)


def decade_of(date: Column) -> Column:
    return F.year(date) - F.pmod(F.year(date), F.lit(10))


def date_column(df: DataFrame, name: str = "date") -> Column:
    """A column as dates: parsed if it is text, cast if it is a time already."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return parse_date(F.col(name))
    return F.col(name).cast("date")


def number_column(df: DataFrame, name: str) -> Column:
    """A column as doubles: parsed if it is text, cast if it is a number already."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
    return parse_number(F.col(name))
