"""Column expressions for zone-free timestamps (``timestamp_ntz``).

Everything stays in NTZ or plain integers, so no result depends on the session
time zone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000}


def _col(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def ntz(value: str | dt.date | dt.datetime) -> Column:
    """A literal zone-free timestamp from ``YYYY-MM-DD[ HH:MM:SS]`` or a date."""
    return F.lit(str(value)).cast("timestamp_ntz")


def day_of(ts: str | Column) -> Column:
    return F.to_date(_col(ts))


def month_of(ts: str | Column) -> Column:
    """First instant of the month. ``date_trunc`` would return a zoned timestamp."""
    return F.trunc(F.to_date(_col(ts)), "month").cast("timestamp_ntz")


def hour_of(ts: str | Column) -> Column:
    return F.hour(_col(ts)).cast("bigint")


def year_of(ts: str | Column) -> Column:
    return F.year(_col(ts)).cast("bigint")


def month_number(ts: str | Column) -> Column:
    return F.month(_col(ts)).cast("bigint")


def weekday_sun0(ts: str | Column) -> Column:
    """Day of week with Sunday = 0 … Saturday = 6 (Spark counts from 1)."""
    return (F.dayofweek(_col(ts)) - 1).cast("bigint")


def epoch_micros(ts: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", ntz("1970-01-01"), _col(ts))


def boundaries_crossed(unit: str, start: str | Column, end: str | Column) -> Column:
    """How many clock ``unit`` boundaries lie between two times: 10:59 → 11:01 is one hour.

    ``timestamp_diff`` counts whole elapsed units (zero in that example), so the
    two times are first cut down to their unit.
    """
    size = F.lit(MICROS[unit])

    def index(ts: str | Column) -> Column:
        micros = epoch_micros(ts)
        return (micros - F.pmod(micros, size)) / size

    return (index(end) - index(start)).cast("bigint")


def elapsed(unit: str, start: str | Column, end: str | Column) -> Column:
    """Fractional elapsed time in ``unit``."""
    micros = F.timestamp_diff("MICROSECOND", _col(start), _col(end))
    return micros.cast("double") / F.lit(float(MICROS[unit]))


def within_days(ts: str | Column, first: str, last: str) -> Column:
    """``first`` ≤ ts < ``last`` + 1 day: sargable, so it reaches the Parquet scan."""
    end = dt.date.fromisoformat(last) + dt.timedelta(days=1)
    return (_col(ts) >= ntz(first)) & (_col(ts) < ntz(end))
