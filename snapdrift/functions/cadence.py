"""Scan cadence in US Eastern time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"


def _eastern(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), ts.cast("timestamp_ntz"))


def is_active(ts: Column) -> Column:
    """Scans run from 6:00 to 20:00."""
    hour = F.hour(_eastern(ts))
    return (hour >= 6) & (hour < 20)


def scan_cadence(ts: Column) -> Column:
    """U16: ``struct(cadence, next_scan_seconds)`` for a naive UTC timestamp.

    The wait to the next 6:00 is wall-clock time, so a clock change in
    between does not alter it.
    """
    local = _eastern(ts)
    # timestamp_ntz fields only: no session zone is involved
    second_of_day = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local).cast("int")
    fraction = F.date_format(local, "SSSSSS").cast("int") > 0
    minute_of_day = F.hour(local) * 60 + F.minute(local)
    to_six = F.when(second_of_day < 6 * 3600, 6 * 3600).otherwise(30 * 3600) - second_of_day
    # a started second no longer counts
    wait = F.greatest(F.lit(60), to_six - fraction.cast("int"))
    overnight = (minute_of_day >= 20 * 60) | (minute_of_day < 6 * 60)
    weekend = F.weekday(local.cast("date")) >= 5
    market = minute_of_day.between(9 * 60 + 30, 16 * 60 - 1)
    name = (
        F.when(overnight, "overnight").when(weekend, "weekend").when(market, "market").otherwise("off_hours")
    )
    seconds = F.when(overnight | weekend, wait).when(market, 900).otherwise(3600)
    return F.struct(name.alias("cadence"), seconds.cast("int").alias("next_scan_seconds"))
