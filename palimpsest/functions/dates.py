"""Column functions on dates of laws and Congresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def prose_date(text: Column) -> Column:
    """'1976-10-19', 'Oct. 19, 1976' or 'October 19, 1976' as a date; null for others and for days that don't exist."""
    pattern = r"(?i)([a-z]{3,9})\.?\s+([0-9]{1,2})\s*,\s*([0-9]{4})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.regexp_extract(text, pattern, 1), 1, 3)))
    iso = F.regexp_extract(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    named = F.concat_ws("-", F.regexp_extract(text, pattern, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, pattern, 2), 2, "0"))
    return F.coalesce(iso.try_cast("date"), F.when(month > 0, named.try_cast("date")))


def first_year(text: Column) -> Column:
    return F.regexp_extract(text, r"\b([0-9]{4})\b", 1).try_cast("int")


def congress_start(congress: Column) -> Column:
    return F.lit(1789) + (congress - 1) * 2


def plausible_year(year: Column, congress: Column) -> Column:
    start = congress_start(congress)
    return year.between(start - 1, start + 2)


def congress_of(date: Column) -> Column:
    """The Congress sitting at a date; it begins on January 3 of odd years."""
    year = F.year(date) - F.when((F.month(date) == 1) & (F.day(date) < 3), 1).otherwise(0)
    return F.floor((year - 1789) / 2).cast("int") + 1


def display_date(date: Column) -> Column:
    """'Aug. 14, 1935'; months of up to four letters, and Sept., in their usual form."""
    name = F.element_at(F.array(*map(F.lit, ("Jan.", "Feb.", "Mar.", "Apr.", "May", "June", "July", "Aug.", "Sept.", "Oct.", "Nov.", "Dec."))), F.month(date))
    return F.concat(name, F.lit(" "), F.day(date).cast("string"), F.lit(", "), F.year(date).cast("string"))
