"""Clock times, durations and the small sums of scores, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 24 * 60
#: A clock time: hours, a separator, two digits of minutes, and am or pm if given. Fixed value.
TIME = r"([0-9]{1,2})[:.h]([0-9]{2})\s*(am|pm|a\.m\.|p\.m\.)?"
#: A boundary between a word sign and another, ASCII only.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: That boundary before a digit; the digit is tested first, as most signs are none.
_BEFORE = r"(?=[0-9])(?<![A-Za-z0-9_])"
SINGLE = rf"(?i){_BEFORE}{TIME}{EDGE}"
BOTH = rf"(?i){_BEFORE}{TIME}\s*(?:-|–|—|−|to)\s*{TIME}{EDGE}"


def minutes(clock: Column) -> Column:
    """Minutes since midnight of ``HH:MM``; 0 where it isn't one."""
    parts = F.split(clock, ":")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    return F.coalesce(number(0) * 60 + number(1), F.lit(0))


def clock(total: Column) -> Column:
    """``HH:MM`` of minutes since midnight, wrapped to one day; null for null."""
    wrapped = F.pmod(total, F.lit(DAY)).cast("int")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.concat(two(F.floor(wrapped / 60).cast("int")), F.lit(":"), two(wrapped % 60))


def duration(start: Column, end: Column) -> Column:
    """Minutes from start to end, over midnight where the end is earlier. Missing times count as midnight, but two of
    them make 0."""
    s, e = minutes(start), minutes(end)
    nothing = (s == 0) & (e == 0) & (F.coalesce(start, F.lit("")) != "00:00")
    return F.when(nothing, 0).otherwise(F.when(e < s, e - s + DAY).otherwise(e - s)).cast("int")


def marker(mark: Column) -> Column:
    """``am``, ``pm`` or an empty string."""
    return F.replace(F.lower(F.coalesce(mark, F.lit(""))), F.lit("."), F.lit(""))


def to_minutes(hour: Column, minute: Column, mark: Column) -> Column:
    """Minutes of a clock time with its am or pm applied."""
    h = hour.cast("int")
    h = F.when((mark == "pm") & (h < 12), h + 12).when((mark == "am") & (h == 12), 0).otherwise(h)
    return h * 60 + minute.cast("int")


def format_duration(total: Column) -> Column:
    return F.format_string("%dh %dm", F.floor(total / 60).cast("int"), F.round(total % 60).cast("int"))


def round_percent(part: Column, total: Column) -> Column:
    """Whole percent, half up; null for an empty total."""
    return F.when(total > 0, F.round(100.0 * part / total)).cast("int")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def text_height(length: Column, width: float, size: float) -> Column:
    """Height of a wrapped label: lines of as many signs as fit at 0.58 of the font size each, four units apart."""
    per_line = F.greatest(F.lit(1.0), F.floor(F.lit(width / (size * 0.58))))
    return F.greatest(F.lit(1.0), F.ceil(length / per_line)) * (size + 4)
