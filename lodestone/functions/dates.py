"""Dates of varying precision, kept as text: YYYY or YYYY-MM-DD, never padded (D-01 to D-08, P-06, P-07)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_year(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}$"), F.lit(False))


def day_of(text: Column, year_ends: bool) -> Column:
    """The day that a date stands for: a bare year is its last day (events) or its first (a record's age)."""
    whole = F.concat(text, F.lit("-12-31" if year_ends else "-01-01"))
    return F.when(is_year(text), whole).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).try_cast("date")


def earliest_event(dates: Column, origin_year: Column) -> Column:
    """The earliest of an array of dates and the origin year, each bare year read as 31 December (D-02)."""
    years = F.transform(F.concat(F.coalesce(dates, F.array().cast("array<string>")), F.array(origin_year.cast("string"))), lambda x: day_of(x, True))
    return F.array_min(F.filter(years, lambda x: x.isNotNull()))


def days_since(day: Column, now: Column) -> Column:
    """Fractional days up to `now`; a day that can't be read is infinitely long ago (D-01)."""
    return F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(day.cast("timestamp"))) / 86400.0, F.lit(float("inf")))


def started_year(registry: Column, origin: Column, founded: Column) -> Column:
    """The register's year, else the earlier of what sources say (P-06, P-07)."""
    return F.coalesce(registry, F.least(origin, founded))


def min_origin_year(now: Column, years: int = 5) -> Column:
    """The oldest year that passes the age gate (D-03)."""
    return F.year(now) - years


def plausible_year(year: Column, now: Column) -> Column:
    """The year if it lies between 1900 and now (D-04)."""
    return F.when(year.between(F.lit(1900), F.year(now)), year)


def refine(first_seen: Column, event: Column) -> Column:
    """A missing date takes the event's; a bare year takes a full date of that year; anything else stays (U-07)."""
    fuller = is_year(first_seen) & (F.length(event) == 10) & (F.substring(event, 1, 4) == first_seen)
    return F.when(first_seen.isNull() | F.coalesce(fuller, F.lit(False)), F.coalesce(event, first_seen)).otherwise(first_seen)


def prose_date(text: Column) -> Column:
    """The first date written out in a text, day first or month first, as YYYY-MM-DD (D-05)."""
    months = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
    day_first = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({months})[a-z]*\.?,?\s+(\d{{4}})\b"
    month_first = rf"(?i)\b({months})[a-z]*\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b"

    def made(pattern: str, d: int, m: int) -> Column:
        month = (F.instr(F.lit(months.replace("|", "").lower()), F.lower(F.regexp_extract(text, pattern, m))) + 2) / 3
        made_of = F.concat_ws("-", F.regexp_extract(text, pattern, 3), F.lpad(month.cast("int").cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, pattern, d), 2, "0"))
        return F.when(text.rlike(pattern), made_of.try_cast("date").cast("string"))

    return F.coalesce(made(day_first, 1, 2), made(month_first, 2, 1))


def number_year(number: Column) -> Column:
    """The year in a company register number: letter, five digits, state, year, type, six digits (D-08)."""
    pattern = r"^[A-Z]\d{5}[A-Z]{2}(\d{4})[A-Z]{3}\d{6}$"
    return F.when(number.rlike(pattern), F.regexp_extract(number, pattern, 1).cast("int"))
