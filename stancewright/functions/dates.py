"""Date expressions. Months follow the session time zone."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Forms in which day and month are both numbers that could be either.
MONTH_FIRST = ("M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M-d-yyyy")
DAY_FIRST = ("d/M/yyyy", "d/M/yyyy H:mm", "d/M/yyyy H:mm:ss", "d-M-yyyy")
CLEAR_FORMATS = (
    "d.M.yyyy", "yyyy/M/d", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyyMMdd",
    "EEE MMM dd HH:mm:ss Z yyyy",
)

#: Tried in this order after ISO text, for a column of which nothing is known; month first.
COMMON_FORMATS = (*MONTH_FIRST, *DAY_FIRST, *CLEAR_FORMATS)


def formats_of(day_first: bool) -> tuple[str, ...]:
    """The forms of a column that has the day first throughout, or the month."""
    return (*(DAY_FIRST if day_first else MONTH_FIRST), *CLEAR_FORMATS)


def day_first(df: DataFrame, name: str, mixed: str = "fail") -> bool:
    """Whether dates such as 04/05/2023 in a text column have the day first.

    One form holds for the column: some date must tell, by a number above 12, which it is; without one
    the month is first. Dates that tell both are an error, or with ``mixed='month'`` do not count.
    This is a job that reads the column once.
    """
    if mixed not in ("fail", "month"):
        raise ValueError(f"mixed must be 'fail' or 'month', not {mixed!r}")
    text = F.col("`" + name.replace("`", "``") + "`").cast("string")
    number = lambda i: F.regexp_extract(text, r"^\s*(\d{1,2})[/-](\d{1,2})[/-]\d{4}\b", i).try_cast("int")
    above = lambda i: F.max(F.when(number(i) > 12, text))
    days, months = df.agg(above(1), above(2)).first()
    if days is not None and months is not None and mixed == "fail":
        raise ValueError(f"{name} has the day first in {days!r} and the month in {months!r}; name its formats")
    return days is not None and months is None


def parse_date(
    value: Column, formats: Iterable[str] = COMMON_FORMATS, unreadable: str = "null"
) -> Column:
    """Timestamp from a text or timestamp column, by the first form that fits.

    By default each row is read by itself, so 15/04/2023 has the day first and 04/05/2023 the month.
    For a column of one form pass ``formats_of(day_first(df, name))``, as the reports do.
    Text that no form fits is NULL, or fails the running job with ``unreadable='fail'``.
    """
    if unreadable not in ("null", "fail"):
        raise ValueError(f"unreadable must be 'null' or 'fail', not {unreadable!r}")
    text = value.cast("string")
    found = F.coalesce(value.try_cast("timestamp"), *[_by_format(text, f) for f in formats])
    if unreadable == "null":
        return found
    failure = F.raise_error(F.concat(F.lit("unreadable date: "), text)).cast("timestamp")
    return F.when(found.isNull() & value.isNotNull(), failure).otherwise(found)


def _by_format(text: Column, form: str) -> Column:
    # Day names are not accepted when parsing; the date does not need them.
    bare = F.regexp_replace(text, "^[A-Za-z]+ ", "") if form.startswith("EEE ") else text
    return F.try_to_timestamp(bare, F.lit(form.removeprefix("EEE ")))


def month_of(value: Column, calendar: str = "month") -> Column:
    """Month number, which merges years, or the first day of the month."""
    if calendar == "month":
        return F.month(value)
    if calendar == "year-month":
        return F.trunc(value, "month")
    raise ValueError(f"calendar must be 'month' or 'year-month', not {calendar!r}")
