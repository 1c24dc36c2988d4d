"""Fiscal quarters: "2023Q1" at the edges, year * 4 + quarter - 1 as the join key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^(\d{4})Q([1-4])$"


def to_int(quarter: Column) -> Column:
    """Null where the string is no quarter."""
    year = F.regexp_extract(quarter, PATTERN, 1)
    n = F.regexp_extract(quarter, PATTERN, 2)
    return F.when(year != "", year.try_cast("int") * 4 + n.try_cast("int") - 1)


def to_string(q_int: Column) -> Column:
    return F.concat(F.floor(q_int / 4).cast("string"), F.lit("Q"), (F.pmod(q_int, F.lit(4)) + 1).cast("string"))


def of_date(date: Column) -> Column:
    """The calendar quarter's key."""
    return (F.year(date) * 4 + F.quarter(date) - 1).cast("long")


def clean(quarter: Column, date: Column) -> Column:
    """The stated quarter if it is one (any case, any blanks), else the calendar quarter of the date."""
    stated = F.upper(F.trim(quarter))
    return F.when(F.regexp_like(stated, F.lit(PATTERN)), stated).otherwise(to_string(of_date(date)))


def lagged(quarter: Column, lag: int) -> Column:
    return F.lit(None).cast("string") if lag < 1 else to_string(to_int(quarter) - lag)


def prior(quarter: Column, n: int) -> Column:
    """The n quarters before, oldest first; empty where the string is no quarter."""
    none = F.array().cast("array<string>")
    if n < 1:
        return none
    q = to_int(quarter)
    return F.when(q.isNotNull(), F.transform(F.sequence(q - n, q - 1), to_string)).otherwise(none)
