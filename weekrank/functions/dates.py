"""Date expressions: lenient parsing, partial dates and Saturday-ended weeks. All times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weekrank.functions.text import trim_all

DISPLAY_FORMAT = "dd MMM yyyy, HH:mm"
_DAY = r"^\d{4}-\d{2}-\d{2}$"
_DAY_TIME = r"^\d{4}-\d{2}-\d{2}(?U:\s)\d{2}:\d{2}:\d{2}$"
_MONTH = r"^\d{4}-\d{2}$"
_YEAR = r"^\d{4}$"
DATE_PATTERNS = {"yyyy_only": _YEAR, "yyyy_mm": _MONTH, "yyyy_mm_dd": _DAY, "datetime": _DAY_TIME}


def to_utc(c: Column) -> Column:
    """Timestamp of a date, timestamp or ISO text; null where it cannot be read."""
    return c.try_cast("timestamp")


def parse_text(c: Column) -> Column:
    """Timestamp of ISO text; bare times of day are refused (a cast would add today's date)."""
    text = trim_all(c)
    return F.when(text.rlike(r"^\d{4}"), text.try_cast("timestamp"))


def parse_display(c: Column) -> Column:
    """`02 Jan 2021, 17:23`, else ISO text, else null."""
    return F.coalesce(F.try_to_timestamp(c, F.lit(DISPLAY_FORMAT)), parse_text(c))


def display_epoch(c: Column) -> Column:
    """Epoch seconds of a display date."""
    return F.unix_timestamp(F.try_to_timestamp(c, F.lit(DISPLAY_FORMAT)))


def iso_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def week_ending_saturday(c: Column) -> Column:
    """The Saturday on or after the day: names the Sunday..Saturday week."""
    return F.next_day(F.date_sub(F.to_date(c), 1), "SA")


def nearest_saturday(c: Column) -> Column:
    """The Saturday at most three days before, else the next one."""
    day = F.to_date(c)
    since = F.pmod(F.weekday(day) - 5, F.lit(7))
    return F.when(since <= 3, F.date_sub(day, since)).otherwise(F.date_add(day, 7 - since))


def week_end(week: Column) -> Column:
    """Last second of the week's Saturday."""
    return to_utc(week) + F.expr("INTERVAL 86399 SECONDS")


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days, exact to the microsecond."""
    return (F.unix_micros(to_utc(later)) - F.unix_micros(to_utc(earlier))) / F.lit(86_400_000_000.0)


def whole_weeks_between(later: Column, earlier: Column) -> Column:
    return F.floor(F.datediff(later, earlier) / F.lit(7.0)).cast("long")


def weekday_name(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def normalise_partial(c: Column) -> Column:
    """`YYYY`, `YYYY-MM` or `YYYY-MM-DD` as an ISO day; null when it is no calendar day."""
    text = trim_all(c)
    full = F.when(F.length(text) == 4, F.concat(text, F.lit("-01-01"))).when(
        F.length(text) == 7, F.concat(text, F.lit("-01"))).otherwise(text)
    year = F.substring(full, 1, 4).try_cast("int")
    return F.when(full.rlike(_DAY) & (year >= 1), F.date_format(full.try_cast("date"), "yyyy-MM-dd"))


def release_day(c: Column) -> Column:
    """Standard `YYYY-MM-DD` text of a release date in any of four shapes (no calendar check)."""
    text = trim_all(c)
    return (F.when(text.rlike(_DAY_TIME), F.substring(text, 1, 10))
            .when(text.rlike(_DAY), text)
            .when(text.rlike(_MONTH), F.concat(text, F.lit("-01")))
            .when(text.rlike(_YEAR), F.concat(text, F.lit("-01-01"))))


def release_granularity(c: Column) -> Column:
    text = trim_all(c)
    return (F.when(text.rlike(_DAY_TIME) | text.rlike(_DAY), "day")
            .when(text.rlike(_MONTH), "month").when(text.rlike(_YEAR), "year"))


def release_timestamp(c: Column) -> Column:
    """Timestamp of a release date; null when unreadable or outside 1678..2261."""
    text = trim_all(c)
    full = (F.when(F.length(text) == 4, F.concat(text, F.lit("-01-01")))
            .when((F.length(text) == 7) & (F.substring(text, 5, 1) == "-"), F.concat(text, F.lit("-01")))
            .otherwise(text))
    year = F.substring(text, 1, 4).try_cast("int")
    return F.when(year.between(1678, 2261), full.try_cast("timestamp"))
