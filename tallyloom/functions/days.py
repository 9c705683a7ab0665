"""Days as relations count them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.schema import at


def age_day(t: Column, as_of: datetime | str) -> Column:
    """Whole days from t to as_of, cut towards zero, plus one."""
    return (F.extract(F.lit("DAY"), at(as_of) - t) + 1).cast("long")


def floor_day(t: Column, as_of: datetime | str) -> Column:
    """Whole days from t to as_of, rounded down, plus one: times after as_of give 0 or less."""
    micros = F.timestamp_diff("MICROSECOND", t.cast("timestamp_ntz"), at(as_of))
    return (F.floor(micros / 86_400_000_000) + 1).cast("long")


def lag_minutes(cursor_us: Column, as_of: datetime | str) -> Column:
    """Whole minutes from a position in microseconds to as_of, at least 0."""
    now = F.unix_micros(at(as_of).cast("timestamp"))
    return F.greatest(F.lit(0), F.floor((now - cursor_us.cast("long")) / 60_000_000)).cast("long")
