"""Timestamps of logs to epoch milliseconds, by arithmetic: months, days and hours out of range roll over, and nothing raises.

The session's time zone has to be UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import js_trim, let

# Fixed values.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_TIME = r"\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?"
ISO = r"^\d{4}-\d{2}-\d{2}[T ]" + _TIME + r"\z"
SHORT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\z"
ORDINAL = r"^\d{4}-\d{3}(?:[T ]" + _TIME + r")?\z"
CLF = r"^\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}(?: [+-]\d{4})?\z"
SYSLOG = r"^[A-Za-z]{3} {1,2}\d{1,2} \d{2}:\d{2}:\d{2}\z"
EPOCH = r"^\d{9,16}(?:\.\d{1,9})?\z"

DAY = 86_400_000


def _int(c: Column, at: int, size: int) -> Column:
    return F.substring(c, at, size).try_cast("long")


def _month(c: Column) -> Column:
    out = F
    for i, name in enumerate(MONTHS, 1):
        out = out.when(c == name, i)
    return out


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970 of a date whose month and day may be out of range."""
    return F.unix_date(F.add_months(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), (month - 1).cast("int"))).cast("long") + day - 1


def _clock(c: Column, at: int) -> Column:
    """Milliseconds of hh:mm:ss from a position on."""
    return _int(c, at, 2) * 3_600_000 + _int(c, at + 3, 2) * 60_000 + _int(c, at + 6, 2) * 1000


def _fraction(rest: Column) -> Column:
    """The fraction's first three digits; missing ones are 0."""
    return F.rpad(F.regexp_extract(rest, r"^[.,](\d{1,3})", 1), 3, "0").try_cast("long")


def _minutes(zone: Column) -> Column:
    """Of +hhmm or +hh:mm."""
    digits = F.replace(zone, F.lit(":"), F.lit(""))
    size = _int(digits, 2, 2) * 60 + _int(digits, 4, 2)
    return F.when(F.left(zone, F.lit(1)) == "-", -size).otherwise(size)


def _to_utc(wall: Column, tz: str) -> Column:
    """A wall clock's milliseconds in a zone."""
    return wall if tz.upper() == "UTC" else F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(wall), tz))


def _zoned(wall: Column, zone: Column, tz: str) -> Column:
    return F.when(zone == "", _to_utc(wall, tz)).when(zone == "Z", wall).otherwise(wall - _minutes(zone) * 60_000)


def parse_timestamp(c: Column, tz: str = "UTC") -> Column:
    """Epoch milliseconds of an ISO date with time, an ordinal date or an access-log date; null for others.

    Fractions are cut to milliseconds.  ``tz`` is the zone of values that name none.
    """
    return let(js_trim(c), lambda v: _timestamp(v, tz))


def with_timestamp(df: DataFrame, value: Column, out: str, tz: str = "UTC") -> DataFrame:
    """``df`` with a column of :func:`parse_timestamp`, as code that Spark compiles: the trimmed value is a column of its own, and only values with
    a fraction, a zone or another form go the long way."""
    v = F.col("__trimmed")
    fast = F.when(F.length(v) == 19, _short(v, tz)).otherwise(let(v, lambda x: _timestamp(x, tz)))
    return df.withColumn("__trimmed", js_trim(value)).withColumn(out, fast).drop("__trimmed")


def is_timestamp(c: Column) -> Column:
    """Whether :func:`parse_timestamp` finds one, at less cost."""
    v = js_trim(c)
    month = f"^\\d\\d/({'|'.join(MONTHS)})/"
    day = F.substring(v, 6, 3)
    leap = v.rlike(r"^(\d\d(0[48]|[2468][048]|[13579][26])|([02468][048]|[13579][26])00)")
    ordinal = v.rlike(ORDINAL) & (day >= "001") & ((day <= "365") | ((day == "366") & leap))
    return F.coalesce(v.rlike(ISO) | ordinal | (v.rlike(CLF) & v.rlike(month)), F.lit(False))


def _short(v: Column, tz: str) -> Column:
    """Of an ISO date with time but without fraction and zone: no other form has its 19 characters."""
    return F.when(v.rlike(SHORT), _to_utc(_days(_int(v, 1, 4), _int(v, 6, 2), _int(v, 9, 2)) * DAY + _clock(v, 12), tz))


def _timestamp(v: Column, tz: str) -> Column:
    zone = F.regexp_extract(v, r"(Z|[+-]\d{2}:?\d{2})\z", 1)
    iso = _zoned(_days(_int(v, 1, 4), _int(v, 6, 2), _int(v, 9, 2)) * DAY + _clock(v, 12) + _fraction(F.substr(v, F.lit(20))), zone, tz)
    year, doy = _int(v, 1, 4), _int(v, 6, 3)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    timed = F.length(v) > 8
    ordinal_wall = _days(year, F.lit(1), doy) * DAY + F.when(timed, _clock(v, 10) + _fraction(F.substr(v, F.lit(18)))).otherwise(0)
    ordinal = F.when((doy >= 1) & (doy <= F.when(leap, 366).otherwise(365)), _zoned(ordinal_wall, F.when(timed, zone).otherwise(""), tz))
    clf = _zoned(_days(_int(v, 8, 4), _month(F.substring(v, 4, 3)).cast("long"), _int(v, 1, 2)) * DAY + _clock(v, 13), F.substr(v, F.lit(22)), tz)
    return F.when(v.rlike(ISO), iso).when(v.rlike(ORDINAL), ordinal).when(v.rlike(CLF), clf)


def _scaled(number: Column) -> Column:
    """Milliseconds if beyond 1e12, else seconds."""
    exact = number.cast("decimal(38,9)")
    return F.round(F.when(number > 1e12, exact).otherwise(exact * 1000)).cast("long")


def parse_epoch(c: Column) -> Column:
    v = js_trim(c)
    return F.when(v.rlike(EPOCH), _scaled(v.try_cast("decimal(38,9)")))


def parse_json_timestamp(text: Column, is_number: Column, tz: str = "UTC") -> Column:
    """Of a JSON value given as text: numbers and strings of nine digits or more are epochs, other strings timestamps."""
    digits = lambda v: v.rlike(r"^\d{9,}(\.\d+)?\z")
    return let(js_trim(text), lambda v: F.when(is_number | digits(v), _scaled(v.try_cast("decimal(38,9)"))).otherwise(_timestamp(v, tz)))


def parse_syslog(c: Column, year: Column, tz: str = "UTC") -> Column:
    """Of a date without a year."""
    v = js_trim(c)
    day = F.regexp_extract(v, r"^[A-Za-z]{3} {1,2}(\d{1,2})", 1).try_cast("long")
    wall = _days(year.cast("long"), _month(F.left(v, F.lit(3))).cast("long"), day) * DAY + _clock(F.right(v, F.lit(8)), 1)
    return F.when(v.rlike(SYSLOG) & day.between(1, 31), _to_utc(wall, tz))


def to_iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
