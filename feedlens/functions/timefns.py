"""Time expressions that keep event time as ``TIMESTAMP_NTZ`` (wall clock, UTC by convention).

Nothing here depends on the session time zone: buckets are built from ``to_date``/``hour``/``trunc``
on the NTZ value, and instants (epoch seconds, ISO strings with an offset) are turned into UTC wall
clock through epoch microseconds.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, functions as F



def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


GROUP_BY_UNITS = ("hour", "day", "week")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz(value) -> Column:
    """A TIMESTAMP_NTZ literal from a string, ``datetime`` or ``date``."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, (_dt.datetime, _dt.date)):
        value = value.isoformat(sep=" ") if isinstance(value, _dt.datetime) else value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def ntz_sql(value) -> str:
    """DuckDB literal for the same wall-clock value."""
    if isinstance(value, _dt.datetime):
        value = value.isoformat(sep=" ")
    return f"TIMESTAMP '{value}'"


def instant_to_ntz(ts: Column | str) -> Column:
    """UTC wall clock of an instant (TIMESTAMP) as TIMESTAMP_NTZ."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(_col(ts)), _epoch())


def ntz_micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 00:00 of an NTZ wall clock, from its date/time fields (no
    detour through the session time zone)."""
    c = _col(ts)
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    secs = F.extract(F.lit("SECOND"), c)                      # seconds with micro fraction
    return (days * F.lit(86_400_000_000) + F.hour(c).cast("long") * F.lit(3_600_000_000)
            + F.minute(c).cast("long") * F.lit(60_000_000) + (secs * F.lit(1_000_000)).cast("long"))


def ntz_to_instant(ts: Column | str) -> Column:
    """The instant whose UTC wall clock is the given TIMESTAMP_NTZ."""
    return F.timestamp_micros(ntz_micros(ts))


def epoch_seconds_to_ntz(secs: Column) -> Column:
    """Wall clock of epoch seconds; NULL outside the years 1 to 9999."""
    in_range = (secs >= F.lit(-62_135_596_800.0)) & (secs < F.lit(253_402_300_800.0))
    micros = F.when(in_range, secs * F.lit(1_000_000)).try_cast("long")
    return F.timestamp_add("MICROSECOND", micros, _epoch())


def parse_event_time(raw: Column | str, fallback=None) -> Column:
    """Epoch seconds (number or numeric text) -> ISO text (``Z``/offset aware) -> fallback.

    ISO text without an offset is read as wall clock directly; with an offset it is converted to
    UTC.  ``fallback`` replaces the reference's "now" and should be an explicit ``as_of`` value.
    """
    c = _col(raw).cast("string")
    t = F.trim(c)
    has_zone = t.rlike("([zZ]|[+-][0-9]{2}:?[0-9]{2})$")
    epoch = epoch_seconds_to_ntz(t.try_cast("double"))
    zoned = instant_to_ntz(F.try_to_timestamp(F.regexp_replace(t, "[zZ]$", "+00:00")))
    plain = t.try_cast("timestamp_ntz")
    number = t.rlike("^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$")
    parsed = F.when(number, epoch).when(has_zone, zoned).otherwise(plain)
    if fallback is None:
        return parsed
    return F.coalesce(parsed, ntz(fallback))


def bucket(ts: Column | str, unit: str) -> Column:
    """Start of the hour / day / Monday-week bucket of an NTZ timestamp, as TIMESTAMP_NTZ."""
    c = _col(ts)
    day = F.to_date(c)
    if unit == "hour":
        return F.timestamp_add("HOUR", F.hour(c), day.cast("timestamp_ntz"))
    if unit == "day":
        return day.cast("timestamp_ntz")
    if unit == "week":
        return F.trunc(day, "week").cast("timestamp_ntz")
    raise ValueError(_unit_error(unit))


def _unit_error(unit) -> str:
    return f"unknown time unit {unit!r}; use one of {', '.join(GROUP_BY_UNITS)}"


def bucket_sql(ts: str, unit: str) -> str:
    if unit not in GROUP_BY_UNITS:
        raise ValueError(_unit_error(unit))
    return f"CAST(date_trunc('{unit}', {ts}) AS TIMESTAMP)"


def whole_days_between(earlier: Column | str, later: Column | str) -> Column:
    """Floor of the day difference (Python ``timedelta.days``), negative for future rows."""
    micros = ntz_micros(later) - ntz_micros(earlier)
    return F.floor(micros / F.lit(86_400_000_000.0)).cast("long")


def whole_days_between_sql(earlier: str, later: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0) AS BIGINT)"
