"""Dates, quantities and other small readings of text. Wording that fixes a result stands
together at the top."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months and the beginnings that stand for them.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH_FORMS = {"jan": "Jan.", "feb": "Feb.", "mar": "Mar.", "apr": "Apr.", "may": "May", "jun": "Jun.", "jul": "Jul.", "aug": "Aug.", "sep": "Sep.", "oct": "Oct.", "nov": "Nov.", "dec": "Dec."}
ENDINGS = r"(?:st|nd|rd|th)?\.?"
NAMED = "|".join(sorted({f for m in MONTHS for f in (m.title(), m[:3].title())} | {"Sept"}, key=len, reverse=True))
DATE = rf"^\s*((?:{NAMED})\.?)\s+(\d{{1,2}}){ENDINGS}\s+(.*)$"
DAY = rf"^\s*(\d{{1,2}}){ENDINGS}\s+([^\d].*)$"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def month_number(name: Column) -> Column:
    """1 to 12 for a name of which one is a beginning of the other, four letters at least."""
    low = F.lower(name)
    out = F.lit(None).cast("int")
    for i, m in reversed(list(enumerate(MONTHS, 1))):
        out = F.when(F.lit(m).startswith(low) | low.startswith(m[:4]), F.lit(i)).otherwise(out)
    return F.when(F.length(low) > 2, out)


def month_of(date: Column) -> Column:
    """1 to 12 by the first three letters."""
    names = F.array(*[F.lit(m[:3]) for m in MONTHS])
    place = F.array_position(names, F.lower(F.substring(F.trim(date), 1, 3))).cast("int")
    return F.when(place > 0, place)


def issue_date(name: Column) -> Column:
    """ISO date of an issue from a file name: YYYYMMDD at its head, or "Month D YYYY" in it."""
    head = r"^(18\d{2}|1900)(\d{2})(\d{2})"
    y, m, d = (found(name, head, i) for i in (1, 2, 3))
    compact = F.when(m.cast("int").between(1, 12) & d.cast("int").between(1, 31), F.concat_ws("-", y, m, d))
    long = r"\b([A-Z][a-z]{2,})\.?\s+(\d{1,2})[,.]?\s+(18\d{2}|1900)\b"
    number = month_number(found(name, long))
    spelt = F.when(number.isNotNull(), F.concat_ws("-", found(name, long, 3), F.lpad(number.cast("string"), 2, "0"), F.lpad(found(name, long, 2), 2, "0")))
    return F.coalesce(compact, spelt)


def file_year(name: Column) -> Column:
    return F.coalesce(found(name, r"^(\d{4})"), found(name, r"(18\d\d|1900)")).cast("int")


def issue_month(name: Column) -> tuple[Column, Column]:
    """(year, month) of an issue from a file name: eight figures at its head, a month's full name with
    a day and a year, or a year alone, whose month is null."""
    head = r"^(\d{4})(\d{2})\d{2}"
    spelt = rf"(?i)({'|'.join(MONTHS)})\s+\d{{1,2}},?\s+(18\d\d|1900)"
    year = F.coalesce(found(name, head, 1), found(name, spelt, 2), found(name, r"(18\d\d|1900)")).cast("int")
    month = F.when(name.rlike(head), found(name, head, 2).cast("int")).otherwise(month_of(found(name, spelt, 1)))
    return year, month


def audit_year(name: Column) -> Column:
    """The year of an audit by file name: 1870 to 1899 as text, else unknown."""
    return F.coalesce(found(name, r"(18[7-9]\d)"), F.lit("unknown"))


def last_year(name: Column) -> Column:
    """The year of a spot check by file name: the last of 1870 to 1899 as text, else unk."""
    years = F.regexp_extract_all(name, F.lit(r"18[789]\d"), F.lit(0))
    return F.coalesce(F.try_element_at(years, F.lit(-1)), F.lit("unk"))


def bounded_year(name: Column) -> Column:
    """Four figures at the head if they are 1870 to 1910, else the first year of the 1800s, else null."""
    head = found(name, r"^(\d{4})").cast("int")
    return F.coalesce(F.when(head.between(1870, 1910), head), found(name, r"(18\d{2})").cast("int"))


def arrival_iso(date: Column, issue_year: Column, issue_month: Column) -> Column:
    """"Mon. D" in an issue's year, or the year before if December comes in a January issue."""
    month, day = month_of(date), found(date, r"^[A-Za-z]{3}\.?\s+(\d{1,2})$").cast("int")
    year = issue_year - F.when((issue_month == 1) & (month == 12), 1).otherwise(0)
    return F.when(month.isNotNull() & day.between(1, 31), F.format_string("%04d-%02d-%02d", year, month, day)).otherwise("")


def explicit_month(text: Column) -> Column:
    """The month that a line names at its head, in its short form."""
    short = F.lower(F.substring(F.trim(found(text, DATE)), 1, 3))
    return reduce(lambda acc, kv: F.when(short == kv[0], kv[1]).otherwise(acc), MONTH_FORMS.items(), F.lit(None).cast("string"))


def dated(text: Column, month: Column) -> tuple[Column, Column]:
    """(date, rest) of a line, given the month carried to it; null and the line without one."""
    named, day = text.rlike(DATE), text.rlike(DAY) & month.isNotNull()
    date = F.when(named, F.concat_ws(" ", explicit_month(text), F.regexp_extract(text, DATE, 2))).when(day, F.concat_ws(" ", month, F.regexp_extract(text, DAY, 1)))
    return date, F.when(named, F.regexp_extract(text, DATE, 3)).when(day, F.regexp_extract(text, DAY, 2)).otherwise(text)


def doc_group(stem: Column) -> Column:
    return F.regexp_replace(stem, r"_p\d{3}$", "")


def page_number(stem: Column) -> Column:
    return F.coalesce(found(stem, r"_p(\d{3})$").cast("int"), F.lit(0))


def sanitize(text: Column, n: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, n)


def quantity(text: Column) -> tuple[Column, Column]:
    """(number, what was odd) of a quantity: empty, range (its first number), fraction,
    extremely_large, negative, non_numeric or ok."""
    s = F.trim(F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit("")))
    number = lambda c: c.try_cast("double")
    ranged, parts = F.contains(s, F.lit("-")) & ~s.startswith("-"), F.split(s, "/")
    first = number(F.element_at(F.split(s, "-"), 1))
    fraction = F.try_divide(number(F.element_at(parts, 1)), F.when(F.size(parts) == 2, number(F.element_at(parts, -1))))
    fractional, plain = F.contains(s, F.lit("/")) & (F.size(parts) == 2), number(s)
    empty = F.coalesce(text, F.lit("")) == ""
    value = F.when(empty, F.lit(None).cast("double")).when(ranged, first).when(fractional, fraction).otherwise(plain)
    odd = F.when(empty, "empty").when(ranged, F.when(first.isNotNull(), "range").otherwise("non_numeric")).when(fractional, F.when(fraction.isNotNull(), "fraction").otherwise("non_numeric"))
    return value, F.coalesce(odd, F.when(plain.isNull(), "non_numeric").when(plain > 1000000, "extremely_large").when(plain < 0, "negative").otherwise("ok"))


def verbatim(line: Column, tokens: Column) -> Column:
    """How many of the tokens occur in the line as they stand."""
    return F.size(F.filter(tokens, lambda t: F.contains(line, t))).cast("long")
