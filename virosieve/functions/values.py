"""Cleaning of raw text cells, as column expressions. A cell that cannot be read becomes null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def bool_from_text(value: Column) -> Column:
    """``true`` in any letter case is true, other text false, missing stays null."""
    return F.lower(blank_to_null(value)) == "true"


def whole_from_decimal_text(value: Column) -> Column:
    """``12`` and ``12.0`` give 12; a value with a fraction is not a position and gives null."""
    number = blank_to_null(value).try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def all_present(*columns: str) -> Column:
    """True when every required cell has a value."""
    out = F.lit(True)
    for name in columns:
        out = out & F.col(name).isNotNull()
    return out


def null_count(*columns: str) -> Column:
    out = F.lit(0)
    for name in columns:
        out = out + F.col(name).isNull().cast("int")
    return out
