"""Date expressions; all in UTC, whatever the session's time zone: they work on milliseconds since 1970 and on dates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import BadSpec
from docloom.functions import values as V
from docloom.functions.expressions import compile_expr, op, part
from docloom.functions.values import LONG, STRING, TIME, Value

#: Milliseconds of the units of fixed length.
MILLIS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": V.DAY, "week": 7 * V.DAY}
#: Letters of date formats and what they are in Spark's, for reading.
FORMAT = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%L": "SSS", "%z": "xx"}
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def dated(arg, scope) -> Column:
    if isinstance(arg, dict) and "date" in arg:
        arg = arg["date"]
    if isinstance(arg, list) and len(arg) == 1:
        arg = arg[0]
    return V.time(compile_expr(arg, scope))


def _part(name: str, f):
    @op(name)
    def compiled(arg, scope):
        return Value(f(dated(arg, scope)).cast("long"), LONG)


def _day(name: str, f):
    """A part that the date alone gives."""
    _part(name, lambda t: f(V.day_of(t)))


def hour(t: Column) -> Column:
    return V.clock(t, MILLIS["hour"], V.DAY)


def minute(t: Column) -> Column:
    return V.clock(t, MILLIS["minute"], MILLIS["hour"])


def second(t: Column) -> Column:
    return V.clock(t, 1000, MILLIS["minute"])


def millisecond(t: Column) -> Column:
    return V.clock(t, 1, 1000)


_day("$year", F.year)
_day("$month", F.month)
_day("$dayOfMonth", F.dayofmonth)
_day("$dayOfYear", F.dayofyear)
_part("$hour", hour)
_part("$minute", minute)
_part("$second", second)
_part("$millisecond", millisecond)
_day("$dayOfWeek", F.dayofweek)
_day("$week", lambda d: F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7))
_day("$isoWeek", F.weekofyear)
_day("$isoWeekYear", lambda d: F.extract(F.lit("YEAROFWEEK"), d))
_day("$isoDayOfWeek", lambda d: F.extract(F.lit("DAYOFWEEK_ISO"), d))


def unit_of(arg) -> str:
    unit = arg.get("unit")
    if not isinstance(unit, str):
        raise BadSpec("unit is a constant text")
    return unit.lower().removesuffix("s") if unit.lower().rstrip("s") in (*MILLIS, "month", "quarter", "year") else unit


def at_millis(t: Column, ms: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(t) + ms)


def moved(t: Column, unit: str, n: Column) -> Column:
    """Calendar units roll over: a month after 31 January is 2 or 3 March."""
    if unit in MILLIS:
        return at_millis(t, n * MILLIS[unit])
    months = {"month": 1, "quarter": 3, "year": 12}.get(unit)
    if months is None:
        return t
    first = F.trunc(V.day_of(t), "month")
    return at_millis(V.midnight(F.add_months(first, (n * months).cast("int"))), F.unix_millis(t) - F.unix_millis(V.midnight(first)))


def _move(name: str, sign: int):
    @op(name)
    def compiled(arg, scope):
        t, n = V.time(part(arg, "startDate", scope)), V.number(part(arg, "amount", scope)).try_cast("long")
        return Value(moved(t, unit_of(arg), n * sign), TIME)


_move("$dateAdd", 1)
_move("$dateSubtract", -1)


@op("$dateTrunc")
def _date_trunc(arg, scope):
    """Bins count from 1970; single weeks start on ``startOfWeek`` (Sunday), wider ones on the Thursday of that epoch."""
    t, unit = V.time(part(arg, "date", scope)), unit_of(arg)
    size = arg.get("binSize", 1)
    if not isinstance(size, int) or size < 1:
        raise BadSpec("binSize is a positive whole number")
    if unit == "week" and size == 1:
        start = str(arg.get("startOfWeek", "sunday")).lower()
        start = next((d for d in DAYS if d.startswith(start[:3])), "sunday")
        day = V.day_of(t)
        back = F.pmod(F.weekday(day) - DAYS.index(start), F.lit(7))
        return Value(V.midnight(F.date_sub(day, back.cast("int"))), TIME)
    if unit in MILLIS:
        span = MILLIS[unit] * size
        return Value(F.timestamp_millis(F.unix_millis(t) - F.pmod(F.unix_millis(t), F.lit(span).cast("long"))), TIME)
    if unit not in ("month", "year"):
        raise BadSpec(f"unit {unit}")
    day = V.day_of(t)
    if unit == "month":
        n = (F.year(day) - 1970) * 12 + F.month(day) - 1
        low = n - F.pmod(n, F.lit(size))
        return Value(V.midnight(F.add_months(F.lit("1970-01-01").cast("date"), low)), TIME)
    n = F.year(day) - 1970
    return Value(V.midnight(F.make_date(F.year(day) - F.pmod(n, F.lit(size)), F.lit(1), F.lit(1))), TIME)


def pieces(fmt: str) -> list[str]:
    """Letters and plain text of a format in order."""
    out = []
    for p in re.split("(%.?)", fmt):
        if p.startswith("%") and p not in FORMAT:
            raise BadSpec(f"date format {p}")
        out += [p] if p else []
    return out


def spark_format(fmt: str) -> str:
    return "".join(FORMAT[p] if p in FORMAT else "'" + p.replace("'", "''") + "'" for p in pieces(fmt))


@op("$dateToString")
def _date_to_string(arg, scope):
    return Value(V.formatted(V.time(part(arg, "date", scope)), pieces(arg.get("format", "%Y-%m-%dT%H:%M:%S.%LZ"))), STRING)


@op("$dateFromString")
def _date_from_string(arg, scope):
    v = part(arg, "dateString", scope)
    if "format" in arg:
        fmt, said = arg["format"], V.text(v)
        if "%z" not in fmt:  # else the session's zone would count
            fmt, said = fmt + " %z", F.concat(said, F.lit(" +0000"))
        return Value(F.try_to_timestamp(said, F.lit(spark_format(fmt))), TIME)
    return Value(V.when_text(V.text(v)), TIME)


PARTS = ("year", "month", "day", "hour", "minute", "second", "millisecond")


@op("$dateToParts")
def _date_to_parts(arg, scope):
    t = V.time(part(arg, "date", scope))
    day = V.day_of(t)
    got = (F.year(day), F.month(day), F.dayofmonth(day), hour(t), minute(t), second(t), millisecond(t))
    made = F.struct(*(c.cast("long").alias(n) for n, c in zip(PARTS, got, strict=True)))
    return Value(F.when(t.isNotNull(), made), T.StructType([T.StructField(n, LONG) for n in PARTS]))


@op("$dateFromParts")
def _date_from_parts(arg, scope):
    """Parts out of their range carry over."""
    if "year" not in arg:
        raise BadSpec("$dateFromParts needs a year")
    get = lambda k, d: V.number(part(arg, k, scope, d)).try_cast("long")
    y, m, d = get("year", None), get("month", 1), get("day", 1)
    first = V.midnight(F.add_months(F.make_date(y.cast("int"), F.lit(1), F.lit(1)), (m - 1).cast("int")))
    rest = (d - 1) * MILLIS["day"] + get("hour", 0) * MILLIS["hour"] + get("minute", 0) * MILLIS["minute"] + get("second", 0) * 1000 + get("millisecond", 0)
    return Value(at_millis(first, rest), TIME)


@op("$dateDiff")
def _date_diff(arg, scope):
    """Whole units that have passed, cut towards 0; a month after 31 January ends on 2 or 3 March, as in ``$dateAdd``."""
    a, b = V.time(part(arg, "startDate", scope)), V.time(part(arg, "endDate", scope))
    unit = unit_of(arg)
    if unit in MILLIS:
        ms = (F.unix_millis(b) - F.unix_millis(a)).cast("double") / MILLIS[unit]
        return Value(F.when(ms < 0, F.ceil(ms)).otherwise(F.floor(ms)).cast("long"), LONG)
    months = {"month": 1, "quarter": 3, "year": 12}.get(unit)
    if months is None:
        raise BadSpec(f"unit {unit}")
    low, high = F.least(a, b), F.greatest(a, b)
    x, y = V.day_of(low), V.day_of(high)
    apart = ((F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x)).cast("long")
    # months that still end in time, counted as $dateAdd adds them: the last one or two may roll over the end of a month
    fits = lambda n: moved(low, "month", n) <= high
    passed = F.when(fits(apart), apart).when(fits(apart - 1), apart - 1).otherwise(apart - 2)
    n = F.floor(F.greatest(passed, F.lit(0)) / months).cast("long")
    return Value(F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.when(a > b, -n).otherwise(n)).cast("long"), LONG)
