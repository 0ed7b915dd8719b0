"""Tolerant parsing of text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters stripped around header names and values: blanks of the single-byte code page.
BLANKS = " \t\n\x0b\f\r\xa0"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def missing_if_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def leading_int(c: Column) -> Column:
    """The integer a text starts with: '3abc' and '3.9' give 3, 'x' and '' give NULL."""
    digits = F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def _two_wide(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def iso_from_day_first(c: Column) -> Column:
    """'D/M/YY' or 'D/M/YYYY' -> 'YYYY-MM-DDT15:00:00Z', NULL when it is not such a date.

    Two-digit years above 50 are of the last century and, like every year before 2000, rejected.
    The day is checked against 1-31 only, so '31/02/2020' stays as written.
    """
    parts = F.split(c, "/")
    day = _two_wide(parts.getItem(0))
    month = _two_wide(F.try_element_at(parts, F.lit(2)))
    raw_year = F.try_element_at(parts, F.lit(3))
    year = (
        F.when((F.length(raw_year) == 2) & (leading_int(raw_year) > 50), F.concat(F.lit("19"), raw_year))
        .when(F.length(raw_year) == 2, F.concat(F.lit("20"), raw_year))
        .otherwise(raw_year)
    )
    ok = (
        (F.size(parts) == 3)
        & leading_int(day).between(1, 31)
        & leading_int(month).between(1, 12)
        & (leading_int(year) >= 2000)
    )
    return F.when(ok, F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit("T15:00:00Z")))


def instant(date: Column) -> Column:
    """The instant of an ISO text; a day past the month's end rolls over into the next month."""
    first_of_month = F.try_to_timestamp(
        F.concat(F.substring(date, 1, 8), F.lit("01"), F.substring(date, 11, 40)))
    day = F.substring(date, 9, 2).try_cast("int")
    return first_of_month + F.make_dt_interval(day - F.lit(1))


def day_of(date: Column) -> Column:
    return F.substring(date, 1, 10)


def season_from_code(code: Column) -> Column:
    """'1516' -> '2015-2016'."""
    return F.concat(F.lit("20"), F.substring(code, 1, 2), F.lit("-20"), F.substring(code, 3, 2))


def season_from_year(year: Column) -> Column:
    """2023 -> '2023-2024'."""
    return F.concat_ws("-", year.cast("string"), (year + F.lit(1)).cast("string"))


def half_up(c: Column) -> Column:
    """Round halves toward plus infinity."""
    return F.floor(c + F.lit(0.5)).cast("long")
