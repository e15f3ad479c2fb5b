"""Date and time values of a page, over an explicit "now"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names before translation by a language's configuration.
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def values(now: Column, compat: bool = True) -> dict[str, Column]:
    """Each value by its name. With ``compat`` the timestamp's month counts from zero."""
    f = lambda pattern: F.date_format(now, pattern)
    month = F.lpad((F.month(now) - 1).cast("string"), 2, "0") if compat else f("MM")
    return {
        "DAY": F.dayofmonth(now).cast("string"),
        "DAY2": f("dd"),
        "DAYNAME": f("EEEE"),
        "DOW": (F.dayofweek(now) - 1).cast("string"),
        "MONTH": f("MM"),
        "MONTHABBREV": f("MMM"),
        "MONTHNAME": f("MMMM"),
        "TIME": f("HH:mm"),
        "HOUR": f("HH"),
        "MINUTE": f("mm"),
        "WEEK": (F.floor((F.dayofyear(now) - 1) / 7) + 1).cast("string"),
        "YEAR": f("yyyy"),
        "TIMESTAMP": F.concat(f("yyyy"), month, f("ddHHmmss")),
    }


def http_date(now: Column) -> Column:
    """RFC 1123 date; the session's zone must be UTC."""
    return F.concat(F.date_format(now, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
