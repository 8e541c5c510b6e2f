"""Dates, times and intervals.

Dates are DATE, date-times TIMESTAMP (session zone UTC) and durations
DAY-TIME INTERVAL, which like the dialect's TIME may be negative and pass a day.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserql.functions.core import Arg, col, text

#: Day number of 1970-01-01, counted from year 0.
EPOCH_DAY = 719528
#: Longest duration, 838:59:59, in microseconds.
LONGEST = (838 * 3600 + 59 * 60 + 59) * 1_000_000

#: The fields of each interval unit, as (months, microseconds) of
#: one step, and of composite units field by field.
_MONTHS = {"YEAR": 12, "QUARTER": 3, "MONTH": 1}
_MICROS = {
    "WEEK": 7 * 86_400_000_000,
    "DAY": 86_400_000_000,
    "HOUR": 3_600_000_000,
    "MINUTE": 60_000_000,
    "SECOND": 1_000_000,
    "MICROSECOND": 1,
}
_COMPOSITE = {
    "YEAR_MONTH": ("YEAR", "MONTH"),
    "DAY_HOUR": ("DAY", "HOUR"),
    "DAY_MINUTE": ("DAY", "HOUR", "MINUTE"),
    "DAY_SECOND": ("DAY", "HOUR", "MINUTE", "SECOND"),
    "DAY_MICROSECOND": ("DAY", "HOUR", "MINUTE", "SECOND", "MICROSECOND"),
    "HOUR_MINUTE": ("HOUR", "MINUTE"),
    "HOUR_SECOND": ("HOUR", "MINUTE", "SECOND"),
    "HOUR_MICROSECOND": ("HOUR", "MINUTE", "SECOND", "MICROSECOND"),
    "MINUTE_SECOND": ("MINUTE", "SECOND"),
    "MINUTE_MICROSECOND": ("MINUTE", "SECOND", "MICROSECOND"),
    "SECOND_MICROSECOND": ("SECOND", "MICROSECOND"),
}
UNITS = (*_MONTHS, *_MICROS, *_COMPOSITE)


def date(x: Arg) -> Column:
    return col(x).try_cast("date")


def timestamp(x: Arg, time: Arg = None) -> Column:
    t = col(x).try_cast("timestamp")
    return t if time is None else t + col(time)


def time(x: Arg) -> Column:
    """The clock part as a duration."""
    t = timestamp(x)
    return t - F.date_trunc("day", t)


def _interval(micros: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / 1_000_000).cast("decimal(18,6)"))


def _micros(t: Column) -> Column:
    """Microseconds of a day-time interval, exactly."""
    days, hours = F.extract(F.lit("DAY"), t), F.extract(F.lit("HOUR"), t)
    minutes, seconds = F.extract(F.lit("MINUTE"), t), F.extract(F.lit("SECOND"), t)
    whole = ((days.cast("bigint") * 24 + hours) * 60 + minutes) * 60_000_000
    return (whole + (seconds * 1_000_000).cast("bigint")).cast("bigint")


def _clamped(t: Column) -> Column:
    return _interval(F.greatest(F.least(_micros(t), F.lit(LONGEST)), F.lit(-LONGEST)))


def date_add(x: Arg, n: Arg, unit: str, sign: int = 1) -> Column:
    """``x + INTERVAL n unit``.

    A DATE stays one for units of whole days; others make a date-time.  Months
    clamp to the month's end.  A composite unit takes a text whose numbers fill
    its fields from the right.
    """
    unit = unit.upper()
    value = col(x)
    if unit in _COMPOSITE:
        return _add_composite(value, n, unit, sign)
    if unit not in _MONTHS and unit not in _MICROS:
        raise ValueError(f"interval unit {unit}")
    if unit == "SECOND":
        steps = col(n).cast("decimal(18,6)") * sign
        return value.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), steps)
    k = (F.round(col(n)) * sign).cast("int")
    if unit in _MONTHS:
        return value + F.make_ym_interval(F.lit(0), k * _MONTHS[unit])
    if unit in ("WEEK", "DAY"):
        return value + F.make_interval(days=k * (7 if unit == "WEEK" else 1))
    t = value.cast("timestamp")
    if unit == "HOUR":
        return t + F.make_dt_interval(F.lit(0), k)
    if unit == "MINUTE":
        return t + F.make_dt_interval(F.lit(0), F.lit(0), k)
    return t + _interval((F.round(col(n)) * sign).cast("bigint"))


def _add_composite(value: Column, n: Arg, unit: str, sign: int) -> Column:
    fields = _COMPOSITE[unit]
    numbers = F.regexp_extract_all(text(n), F.lit("[0-9]+"), F.lit(0))
    negative = F.when(F.trim(text(n)).startswith("-"), -sign).otherwise(sign)
    missing = len(fields) - F.size(numbers)

    def part(k: int) -> Column:
        found = F.get(numbers, F.lit(k) - missing)
        if fields[k] == "MICROSECOND":
            found = F.rpad(found, 6, "0")
        return F.coalesce(found.cast("bigint"), F.lit(0))

    if unit == "YEAR_MONTH":
        return value + F.make_ym_interval((part(0) * negative).cast("int"), (part(1) * negative).cast("int"))
    total = sum((part(k) * _MICROS[f] for k, f in enumerate(fields)), F.lit(0))
    return value.cast("timestamp") + _interval(total * negative)


def date_sub(x: Arg, n: Arg, unit: str) -> Column:
    return date_add(x, n, unit, -1)


def adddate(x: Arg, days: Arg) -> Column:
    return date_add(x, days, "DAY")


def subdate(x: Arg, days: Arg) -> Column:
    return date_add(x, days, "DAY", -1)


def year(x: Arg) -> Column:
    return F.year(date(x))


def quarter(x: Arg) -> Column:
    return F.quarter(date(x))


def month(x: Arg) -> Column:
    return F.month(date(x))


def day(x: Arg) -> Column:
    return F.dayofmonth(date(x))


dayofmonth = day


def dayofyear(x: Arg) -> Column:
    return F.dayofyear(date(x))


def dayofweek(x: Arg) -> Column:
    """1 is Sunday."""
    return F.dayofweek(date(x))


def weekday(x: Arg) -> Column:
    """0 is Monday."""
    return F.weekday(date(x))


def to_days(x: Arg) -> Column:
    return F.datediff(date(x), F.lit("1970-01-01").cast("date")) + EPOCH_DAY


def from_days(n: Arg) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), col(n).cast("int") - EPOCH_DAY)


def to_seconds(x: Arg) -> Column:
    return F.unix_seconds(timestamp(x)) + EPOCH_DAY * 86400


def _week_parts(x: Arg, mode: int) -> tuple[Column, Column]:
    """Week number and the year it counts in, by the eight modes: odd ones begin
    on Monday, 2, 3, 6 and 7 count weeks 1 to 53 across years, and 0, 2, 5 and 7
    begin week 1 with the first such weekday of the year instead of the first
    week that has four of its days."""
    d = date(x)
    monday, ranged = mode % 2 == 1, mode % 4 >= 2
    by_weekday = mode in (0, 2, 5, 7)

    def begin(y: Column) -> Column:
        """First day of week 1."""
        new_year = F.make_date(y, F.lit(1), F.lit(1))
        on = F.weekday(new_year) if monday else F.dayofweek(new_year) - 1
        back = F.date_sub(new_year, on)
        later = on != 0 if by_weekday else on > 3
        return F.when(later, F.date_add(back, 7)).otherwise(back)

    own = F.year(d)
    this, before, after = begin(own), begin(own - 1), begin(own + 1)
    number = F.floor(F.datediff(d, this) / 7).cast("int") + 1
    if not ranged:
        return F.when(d < this, 0).otherwise(number), own
    last = F.floor(F.datediff(d, before) / 7).cast("int") + 1
    week_ = F.when(d < this, last).when(d >= after, 1).otherwise(number)
    return week_, F.when(d < this, own - 1).when(d >= after, own + 1).otherwise(own)


def week(x: Arg, mode: int = 0) -> Column:
    return _week_parts(x, mode % 8)[0]


def yearweek(x: Arg, mode: int = 0) -> Column:
    """Year and week, with weeks counted across years."""
    number, of = _week_parts(x, mode % 8 | 2)
    return of * 100 + number


def weekofyear(x: Arg) -> Column:
    return F.weekofyear(date(x))


def dayname(x: Arg) -> Column:
    return F.date_format(date(x), "EEEE")


def monthname(x: Arg) -> Column:
    return F.date_format(date(x), "MMMM")


def last_day(x: Arg) -> Column:
    return F.last_day(date(x))


def hour(x: Arg) -> Column:
    return F.hour(timestamp(x))


def minute(x: Arg) -> Column:
    return F.minute(timestamp(x))


def second(x: Arg) -> Column:
    return F.second(timestamp(x))


def microsecond(x: Arg) -> Column:
    return F.pmod(F.unix_micros(timestamp(x)), F.lit(1_000_000)).cast("int")


def time_to_sec(x: Arg) -> Column:
    return hour(x) * 3600 + minute(x) * 60 + second(x)


def extract(unit: str, x: Arg) -> Column:
    """All twenty units; composite ones read as one number."""
    unit = unit.upper()
    simple = {
        "YEAR": year, "QUARTER": quarter, "MONTH": month, "WEEK": week, "DAY": day,
        "HOUR": hour, "MINUTE": minute, "SECOND": second, "MICROSECOND": microsecond,
    }
    if unit in simple:
        return simple[unit](x)
    out = F.lit(0).cast("bigint")
    for f in _COMPOSITE[unit]:
        out = out * (1_000_000 if f == "MICROSECOND" else 100) + simple[f](x)
    return out


def _ordinal(d: Column) -> Column:
    n = F.dayofmonth(d)
    teen = n.between(11, 13)
    end = F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


#: Format letters that Spark's own letters express.
_LETTERS = {
    "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d",
    "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a",
    "j": "DDD", "r": "hh:mm:ss a", "T": "HH:mm:ss",
}


def date_format(x: Arg, form: str) -> Column:
    """All format letters; an unknown one stands for itself."""
    t, d = timestamp(x), date(x)
    special = {
        "D": lambda: _ordinal(d),
        "U": lambda: _two(week(x, 0)),
        "u": lambda: _two(week(x, 1)),
        "V": lambda: _two(week(x, 2)),
        "v": lambda: _two(week(x, 3)),
        "X": lambda: F.lpad((yearweek(x, 2) / 100).cast("int").cast("string"), 4, "0"),
        "x": lambda: F.lpad((yearweek(x, 3) / 100).cast("int").cast("string"), 4, "0"),
        "w": lambda: (F.dayofweek(d) - 1).cast("string"),
    }
    parts: list[Column] = []
    for plain, letter in re.findall(r"([^%]+)|%(.?)", form, re.S):
        if plain:
            parts.append(F.lit(plain))
        elif letter in _LETTERS:
            parts.append(F.date_format(t, _LETTERS[letter]))
        elif letter in special:
            parts.append(special[letter]())
        else:
            parts.append(F.lit(letter))
    return F.concat(*parts) if parts else F.when(t.isNotNull(), "")


time_format = date_format


def str_to_date(s: Arg, form: str) -> Column:
    """Text read by a format; NULL where it does not fit.  A format without
    clock letters gives a date."""
    letters = {
        "Y": "yyyy", "y": "yy", "m": "M", "c": "M", "d": "d", "e": "d", "H": "H", "k": "H", "h": "h", "I": "h", "l": "h",
        "i": "m", "s": "s", "S": "s", "f": "SSSSSS", "p": "a", "M": "MMMM", "b": "MMM", "j": "D", "T": "H:m:s", "r": "h:m:s a",
        "W": "EEEE", "a": "EEE",
    }
    out = ""
    for plain, letter in re.findall(r"([^%]+)|%(.?)", form, re.S):
        if plain:
            out += "".join(f"'{c}'" if c.isalpha() else c for c in plain)
        elif letter in letters:
            out += letters[letter]
        else:
            raise NotImplementedError(f"format letter %{letter}")
    t = F.try_to_timestamp(text(s), F.lit(out))
    return t if re.search("%[HkhIlisSfpTr]", form) else t.cast("date")


def unix_timestamp(x: Arg = None) -> Column:
    """Seconds since 1970; of what is no date, 0."""
    if x is None:
        return F.unix_timestamp()
    return F.when(col(x).isNotNull(), F.coalesce(F.unix_seconds(timestamp(x)), F.lit(0)))


def unix_timestamp_micros(x: Arg) -> Column:
    """The same with its fraction."""
    return (F.unix_micros(timestamp(x)).cast("decimal(20,0)") / 1_000_000).cast("decimal(20,6)")


def from_unixtime(n: Arg, form: str | None = None) -> Column:
    """NULL for negative numbers and those past the year 3000."""
    k = col(n)
    t = F.timestamp_seconds(F.when((k >= 0) & (k <= 32536771199), k))
    return t if form is None else date_format(t, form)


#: The formats that GET_FORMAT names.
_FORMATS = {
    ("DATE", "USA"): "%m.%d.%Y", ("DATE", "JIS"): "%Y-%m-%d", ("DATE", "ISO"): "%Y-%m-%d", ("DATE", "EUR"): "%d.%m.%Y",
    ("DATE", "INTERNAL"): "%Y%m%d",
    ("DATETIME", "USA"): "%Y-%m-%d %H.%i.%s", ("DATETIME", "JIS"): "%Y-%m-%d %H:%i:%s",
    ("DATETIME", "ISO"): "%Y-%m-%d %H:%i:%s", ("DATETIME", "EUR"): "%Y-%m-%d %H.%i.%s",
    ("DATETIME", "INTERNAL"): "%Y%m%d%H%i%s",
    ("TIME", "USA"): "%h:%i:%s %p", ("TIME", "JIS"): "%H:%i:%s", ("TIME", "ISO"): "%H:%i:%s", ("TIME", "EUR"): "%H.%i.%s",
    ("TIME", "INTERNAL"): "%H%i%s",
}


def get_format(kind: str, locale: str) -> str:
    return _FORMATS[kind.upper(), locale.upper()]


def convert_tz(x: Arg, source: str, target: str) -> Column:
    """Between numeric offsets, as ``+02:00``."""
    def minutes(zone: str) -> int:
        m = re.fullmatch(r"([+-])(\d{1,2}):(\d{2})", zone)
        if not m:
            raise NotImplementedError(f"time zone {zone}")
        return (1 if m[1] == "+" else -1) * (int(m[2]) * 60 + int(m[3]))

    return timestamp(x) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes(target) - minutes(source)))


def datediff(a: Arg, b: Arg) -> Column:
    return F.datediff(date(a), date(b))


def timestampdiff(unit: str, a: Arg, b: Arg) -> Column:
    """Whole units from a to b, truncated toward zero."""
    unit, x, y = unit.upper(), timestamp(a), timestamp(b)
    if unit in _MONTHS:
        first, last = F.least(x, y), F.greatest(x, y)
        months = (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first)
        rest = lambda t: F.unix_micros(t) - F.unix_micros(F.date_trunc("month", t))
        months = months - F.when(rest(last) < rest(first), 1).otherwise(0)
        n = F.floor(months / _MONTHS[unit]).cast("bigint")
        return F.when(y < x, -n).otherwise(n)
    gap = F.unix_micros(y) - F.unix_micros(x)
    n = F.floor(F.abs(gap) / F.lit(_MICROS[unit]).cast("decimal(20,0)")).cast("bigint")
    return F.when(gap < 0, -n).otherwise(n)


def timestampadd(unit: str, n: Arg, x: Arg) -> Column:
    return date_add(x, n, unit)


def timediff(a: Arg, b: Arg) -> Column:
    """A duration within ±838:59:59."""
    return _clamped(timestamp(a) - timestamp(b))


def addtime(x: Arg, duration: Arg) -> Column:
    return col(x) + col(duration)


def subtime(x: Arg, duration: Arg) -> Column:
    return col(x) - col(duration)


def full_year(y: Arg) -> Column:
    """Two-digit years: up to 69 in this century, from 70 in the last."""
    n = col(y).cast("int")
    return F.when(n < 70, n + 2000).when(n < 100, n + 1900).otherwise(n)


def makedate(y: Arg, doy: Arg) -> Column:
    """NULL for a day below 1."""
    n = col(doy).cast("int")
    return F.when(n >= 1, F.date_add(F.make_date(full_year(y), F.lit(1), F.lit(1)), n - 1))


def maketime(h: Arg, m: Arg, s: Arg) -> Column:
    """NULL where minutes or seconds are outside 0 to 59."""
    hours, minutes, seconds = col(h).cast("int"), col(m).cast("int"), col(s).cast("decimal(18,6)")
    sign = F.when(hours < 0, -1).otherwise(1)
    whole = F.abs(hours).cast("bigint") * 3_600_000_000 + minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")
    ok = minutes.between(0, 59) & (seconds >= 0) & (seconds < 60)
    return F.when(ok, _interval(F.greatest(F.least(whole * sign, F.lit(LONGEST)), F.lit(-LONGEST))))


def sec_to_time(n: Arg) -> Column:
    micros = (col(n).cast("decimal(20,6)") * 1_000_000).cast("bigint")
    return _interval(F.greatest(F.least(micros, F.lit(LONGEST)), F.lit(-LONGEST)))


def time_text(t: Arg) -> Column:
    """A duration as ``[-]HH:MM:SS``."""
    whole = _micros(col(t))
    micros = F.abs(whole)
    hours = F.floor(micros / 3_600_000_000).cast("int").cast("string")
    minutes = F.floor(micros / 60_000_000).cast("bigint") % 60
    seconds = F.floor(micros / 1_000_000).cast("bigint") % 60
    shown = F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours)
    return F.concat(F.when(whole < 0, "-").otherwise(""), F.concat_ws(":", shown, _two(minutes), _two(seconds)))


def duration(x: Arg) -> Column:
    """A text ``[-][D ]HH:MM[:SS[.f]]``, or digits ``[-]HHMMSS[.f]``, as a
    duration; NULL for any other."""
    t = F.trim(text(x))
    colons, digits = r"^-?(?:([0-9]+) )?([0-9]+):([0-5]?[0-9])(?::([0-5]?[0-9](?:\.[0-9]*)?))?$", r"^-?([0-9]*?)([0-5]?[0-9]?)([0-5]?[0-9](?:\.[0-9]*)?)$"

    def seconds(pattern: str, *weights: int) -> Column:
        parts = [F.regexp_extract(t, pattern, k + 1) for k in range(len(weights))]
        return sum((F.when(v == "", 0).otherwise(v).cast("decimal(20,6)") * w for v, w in zip(parts[1:], weights[1:])), F.when(parts[0] == "", 0).otherwise(parts[0]).cast("decimal(20,6)") * weights[0])

    total = F.when(t.rlike(colons), seconds(colons, 86400, 3600, 60, 1)).when(t.rlike(digits), seconds(digits, 3600, 60, 1))
    return sec_to_time(F.when(t.startswith("-"), -total).otherwise(total))


#: Divisor in microseconds, and modulus, of each part of a duration.
DURATION_PARTS = {
    "hour": (3_600_000_000, None),
    "minute": (60_000_000, 60),
    "second": (1_000_000, 60),
    "microsecond": (1, 1_000_000),
    "time_to_sec": (1_000_000, None),
}


def duration_part(part: str, t: Arg) -> Column:
    """A part of a duration; of the parts, only the total of seconds has a sign."""
    divisor, modulus = DURATION_PARTS[part]
    micros = _micros(col(t))
    n = F.floor(F.abs(micros) / divisor).cast("bigint")
    n = n if modulus is None else n % modulus
    return F.when(micros < 0, -n).otherwise(n) if part == "time_to_sec" else n


def time_format(t: Arg, form: str) -> Column:
    """TIME_FORMAT of a duration; hours may be more than a day's."""
    day = F.timestamp_micros((F.abs(_micros(col(t))) % 86_400_000_000).cast("bigint"))
    hours = duration_part("hour", t).cast("string")
    padded = F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours)
    parts = [padded if x == "%H" else hours if x == "%k" else date_format(day, x) for x in re.split(r"(%[Hk])", form) if x]
    return F.concat(*parts) if parts else F.when(col(t).isNotNull(), F.lit(""))


def _months(p: Arg) -> Column:
    n = col(p).cast("bigint")
    return full_year(F.floor(n / 100)) * 12 + n % 100 - 1


def period_add(p: Arg, n: Arg) -> Column:
    total = _months(p) + col(n).cast("bigint")
    return (F.floor(total / 12) * 100 + total % 12 + 1).cast("bigint")


def period_diff(a: Arg, b: Arg) -> Column:
    return (_months(a) - _months(b)).cast("bigint")


def now(fsp: int = 0) -> Column:
    """Statement time, cut to that many digits of a second."""
    return (F.floor(F.unix_micros(F.current_timestamp()) / 10 ** (6 - fsp)) * 10 ** (6 - fsp)).cast("bigint").transform(F.timestamp_micros)


current_timestamp = localtime = localtimestamp = utc_timestamp = sysdate = now


def curdate() -> Column:
    return F.current_date()


current_date = utc_date = curdate


def curtime() -> Column:
    return F.date_format(F.current_timestamp(), "HH:mm:ss")


current_time = utc_time = curtime
