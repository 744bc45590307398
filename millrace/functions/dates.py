"""Date parts, differences, formats and parsing; all JVM-side and ANSI-safe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats in the order they are tried, day first and month first.
DETECTED = ["%Y-%m-%d", "%Y/%m/%d", "%d-%m-%Y", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%y", "%m/%d/%y", "%d/%m/%y", "%m-%d-%Y", "%Y.%m.%d", "%d.%m.%Y", "%b %d %Y", "%d %b %Y", "%B %d %Y"]
# The parts that both orders of smart parsing are made of.
_ISO = ["%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d"]
_DAY = ["%d-%m-%Y", "%d/%m/%Y", "%d/%m/%y", "%d-%m-%y"]
_MONTH = ["%m/%d/%Y", "%m/%d/%y", "%m-%d-%Y"]
_WORDS = ["%d %b %Y", "%d %B %Y", "%b %d %Y", "%B %d %Y", "%d.%m.%Y"]
DAY_FIRST = _DAY + _ISO + _MONTH + _WORDS
MONTH_FIRST = _MONTH + _ISO + _DAY + _WORDS

_JAVA = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "f": "SSSSSS", "%": "%"}


def java_pattern(strftime: str) -> str:
    """A strftime pattern as a pattern of Spark."""
    out, i = "", 0
    while i < len(strftime):
        if strftime[i] == "%" and i + 1 < len(strftime):
            out += _JAVA[strftime[i + 1]]
            i += 2
        else:
            out += f"'{strftime[i]}'" if strftime[i].isalpha() else strftime[i]
            i += 1
    return out


def _shape(strftime: str) -> str:
    """What a text in this format looks like, so that a parser that is more lenient than strptime isn't asked."""
    digits = {"Y": r"\d{4}", "y": r"\d{2}", "m": r"\d{1,2}", "d": r"\d{1,2}", "b": "[A-Za-z]{3}", "B": "[A-Za-z]+", "H": r"\d{1,2}", "M": r"\d{1,2}", "S": r"\d{1,2}"}
    out, i = "^", 0
    while i < len(strftime):
        if strftime[i] == "%":
            out += digits[strftime[i + 1]]
            i += 2
        else:
            out += "\\" + strftime[i] if strftime[i] in ".-/" else strftime[i]
            i += 1
    return out + "$"


def parse_as(c: Column, strftime: str) -> Column:
    """Timestamp of a text in just this format, else null; one-digit days and months are taken."""
    t = F.trim(c.cast("string"))
    pattern = java_pattern(strftime)
    pattern = (pattern if "MMM" in pattern else pattern.replace("MM", "M")).replace("dd", "d").replace("HH", "H")
    return F.when(t.rlike(_shape(strftime)), F.try_to_timestamp(t, F.lit(pattern))).cast("timestamp_ntz")


def parse_any(c: Column, day_first: bool = True, custom: str | None = None) -> Column:
    """The first of the ordered formats that fits, else what a cast to timestamp makes of it."""
    formats = ([custom] if custom else []) + (DAY_FIRST if day_first else MONTH_FIRST)
    return F.coalesce(*[parse_as(c, f) for f in formats], F.trim(c.cast("string")).try_cast("timestamp").cast("timestamp_ntz"))


def detect_format(c: Column) -> Column:
    """The first of the known formats that a text has."""
    out = F.lit(None).cast("string")
    for f in reversed(DETECTED):
        out = F.when(parse_as(c, f).isNotNull(), F.lit(f)).otherwise(out)
    return out


def part(c: Column, name: str) -> Column:
    """year, month, day, dayofyear, hour, minute, second, dayofweek (Monday 0), week (ISO), quarter, names and flags."""
    day, flag = F.to_date(c), lambda x: x.cast("int")
    first, last = F.trunc(day, "month"), F.last_day(day)
    parts = {
        "year": F.year, "month": F.month, "day": F.day, "dayofyear": F.dayofyear, "hour": F.hour, "minute": F.minute, "dayofweek": F.weekday, "week": F.weekofyear, "quarter": F.quarter,
        "second": lambda x: F.second(x),
        "is_weekend": lambda x: flag(F.weekday(x) >= 5),
        "is_month_start": lambda x: flag(day == first),
        "is_month_end": lambda x: flag(day == last),
        "is_quarter_start": lambda x: flag(day == F.trunc(day, "quarter")),
        "is_quarter_end": lambda x: flag((day == last) & (F.month(day) % 3 == 0)),
        "is_year_start": lambda x: flag(day == F.trunc(day, "year")),
        "is_year_end": lambda x: flag((F.month(day) == 12) & (F.day(day) == 31)),
        "day_name": lambda x: F.date_format(x, "EEEE"),
        "month_name": lambda x: F.date_format(x, "MMMM"),
        "days_in_month": lambda x: F.day(last),
    }
    return parts[name](c)


def difference(a: Column, b: Column, unit: str = "days") -> Column:
    """a - b; whole days rounded down, or hours, minutes and seconds with fractions."""
    micros = F.timestamp_diff("MICROSECOND", b, a)
    per = {"hours": 3_600_000_000, "minutes": 60_000_000, "seconds": 1_000_000}
    return F.floor(micros / 86_400_000_000).cast("long") if unit == "days" else micros / per[unit]


def add_days(c: Column, n: int) -> Column:
    return c + F.make_dt_interval(F.lit(n))


def formatted(c: Column, strftime: str = "%Y-%m-%d") -> Column:
    return F.date_format(c, java_pattern(strftime))
