"""Dates as YYYY-MM or YYYY; nothing is invented, so a year alone stays a year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from onefold.functions.text import table, trimmed

#: The names of months.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}


def date(c: Column) -> Column:
    """A date's year and month, or its year; null for open ends (present, now) and for what is no date of 1900 to 2100."""
    s = F.lower(trimmed(c))
    part = lambda pattern, group: F.regexp_extract(s, pattern, group)
    numbers = table(MONTHS, "int")
    named = lambda name: F.try_element_at(numbers, name)
    forms = (  # pattern, group of the year, group of the month, whether it is a name
        (r"^([0-9]{4})[-/.]([0-9]{1,2})(?:[-/.][0-9]{1,2})?$", 1, 2, False),
        (r"^([0-9]{1,2})[-/.]([0-9]{4})$", 2, 1, False),
        (r"^([a-z]+)\.?,?\s+([0-9]{4})$", 2, 1, True),
        (r"^([0-9]{4})\s+([a-z]+)\.?$", 1, 2, True),
        (r"^([0-9]{4})$", 1, 0, None),
    )
    out = F.lit(None).cast("string")
    for pattern, y, m, name in reversed(forms):
        year = part(pattern, y)
        fits = year.cast("int").between(1900, 2100)
        if name is None:
            value = F.when(fits, year)
        else:
            month = named(part(pattern, m)) if name else part(pattern, m).cast("int")
            value = F.when(fits & month.between(1, 12), F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0")))
        out = F.when(s.rlike(pattern), value).otherwise(out)
    return out


def year(c: Column) -> Column:
    return F.substring(date(c), 1, 4).cast("int")
