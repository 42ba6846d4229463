"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyward.fixed import LOGIN_TIME_FORMATS

MICROS_PER_MINUTE = 60_000_000.0
MICROS_PER_HOUR = 3_600_000_000.0
MICROS_PER_DAY = 86_400_000_000.0


def parse_login_time(text: Column, source_tz: str | None = None,
                     extra_formats: tuple[str, ...] = ()) -> Column:
    """First of the known formats that parses, then a plain cast, else NULL (UTC).

    ``source_tz`` reads zone-less times as local times of that zone.
    """
    attempts = [F.try_to_timestamp(text, F.lit(fmt)) for fmt in (*LOGIN_TIME_FORMATS, *extra_formats)]
    dated = F.when(text.rlike(r"^\s*\d{4,}-\d{1,2}-\d{1,2}"), text)
    parsed = F.coalesce(*attempts, dated.try_cast("timestamp"))
    if source_tz is None:
        return parsed
    has_zone = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(has_zone, parsed).otherwise(F.to_utc_timestamp(parsed, source_tz))


def parse_offset_time(text: Column) -> Column:
    """ISO time with an offset (``Z``, ``+00:00`` or ``+0000``); NULL without one or on failure."""
    value = F.regexp_replace(F.trim(text), r"([+-]\d{2})(\d{2})$", "$1:$2")
    iso = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}(:\d{2}(:\d{2})?)?)$"
    return F.when(value.rlike(iso), value.try_cast("timestamp"))


def gap_micros(earlier: Column, later: Column) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier)


def hours_between(earlier: Column, later: Column) -> Column:
    return gap_micros(earlier, later) / F.lit(MICROS_PER_HOUR)


def minutes_between(earlier: Column, later: Column) -> Column:
    return gap_micros(earlier, later) / F.lit(MICROS_PER_MINUTE)


def days_between(earlier: Column, later: Column) -> Column:
    return gap_micros(earlier, later) / F.lit(MICROS_PER_DAY)
