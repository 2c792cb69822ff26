"""One registered query: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fareloom.plans.bindings import EVENT_TRIPS_SQL, LINEITEM_TRIPS_SQL, event_trips, lineitem_trips

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


def on_lineitem(operator: Callable[..., DataFrame], sql: str | None, *args, **kwargs) -> Query:
    """An operator over the lineitem trips; ``sql`` reads the same projection as ``trips``."""
    return Query(
        lambda spark, sf: operator(lineitem_trips(spark, sf), *args, **kwargs),
        None if sql is None else with_trips(sql),
    )


def on_events(operator: Callable[..., DataFrame], sql: str | None, *args, **kwargs) -> Query:
    return Query(
        lambda spark, sf: operator(event_trips(spark, sf), *args, **kwargs),
        None if sql is None else with_trips(sql, EVENT_TRIPS_SQL),
    )


def with_trips(sql: str, source: str = LINEITEM_TRIPS_SQL) -> str:
    """Put the trip projection in front; ``sql`` may start with further CTEs (``, x AS (…)``)."""
    return f"WITH {source}\n{sql.strip()}"


def dec_sum(column: str, weight: str | None = None) -> str:
    """SQL for an exact SUM as a double: decimals inside, one cast outside."""
    term = f"CAST({column} AS DECIMAL(18,2))"
    if weight:
        term = f"{term} * {weight}"
    return f"CAST(SUM({term}) AS DOUBLE)"


def dec_avg(column: str) -> str:
    return f"{dec_sum(column)} / NULLIF(COUNT({column}), 0)"


def r2(expression: str) -> str:
    """SQL for a two-place rounding on a decimal, as a double."""
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(28,8)), 2) AS DOUBLE)"
