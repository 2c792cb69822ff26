"""Reports of the trip API: date ranges, daily summaries, vendor and payment views."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.columns import CARD_PAYMENT, CASH_PAYMENT, TripColumns
from fareloom.functions.numbers import fixed, from_fixed, mean_of, round2, total_of
from fareloom.functions.times import (
    day_of,
    hour_of,
    month_number,
    month_of,
    ntz,
    within_days,
    year_of,
)
from fareloom.operators import corpus
from fareloom.operators.corpus import TRIPS, rows
from fareloom.operators.ordering import GROUP_ROWS, Carried, grouped_percentiles
from fareloom.operators.selection import percentile_of
from fareloom.sources.names import find_column

YEAR, MONTH = "year", "month"


def _month_bounds(c: TripColumns, first: str, last: str) -> Column | None:
    """Conditions on the declared partition columns that cover the range.

    Spark prunes directories only on partition columns, so a filter on the
    timestamp alone would open every file of a partitioned table.
    """
    if c.pickup_year is None or c.pickup_month is None:
        return None
    a, b = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    year, month = F.col(c.pickup_year), F.col(c.pickup_month)
    if a.year == b.year:
        return (year == a.year) & month.between(a.month, b.month)
    return (
        ((year == a.year) & (month >= a.month))
        | ((year > a.year) & (year < b.year))
        | ((year == b.year) & (month <= b.month))
    )


def in_range(trips: DataFrame, first: str, last: str, c: TripColumns = TRIPS) -> DataFrame:
    """Trips picked up from ``first`` to ``last``, both days included; declared partitions are pruned."""
    kept = trips.where(within_days(c.pickup, first, last))
    bounds = _month_bounds(c, first, last)
    return kept if bounds is None else kept.where(bounds)


def date_range(
    trips: DataFrame,
    first: str,
    last: str,
    columns: Sequence[str] | None = None,
    c: TripColumns = TRIPS,
) -> DataFrame:
    """a_date_range: the rows of a day range in pickup order.

    Wanted columns are looked up leniently (``pickup_datetime`` finds
    ``tpep_pickup_datetime``); unknown ones are left out.
    """
    kept = in_range(trips, first, last, c)
    found = [find_column(name, trips.columns) for name in columns or []]
    ordered = kept.orderBy(c.pickup)
    known = list(dict.fromkeys(name for name in found if name))
    return ordered.select(*known) if known else ordered


def _since(trips: DataFrame, days: int, as_of: str, c: TripColumns) -> DataFrame:
    start = dt.date.fromisoformat(as_of) - dt.timedelta(days=days)
    return trips.where(F.col(c.pickup) >= ntz(start))


def _paid_with(c: TripColumns, code: int) -> Column:
    return F.count_if(F.col(c.payment) == code)


def daily_summary(
    trips: DataFrame, as_of: str, days: int = 30, c: TripColumns = TRIPS
) -> DataFrame:
    """a_daily_summary: one row per day since ``as_of - days``, with an exact median distance.

    Payment and passenger figures appear when the table has those columns.
    """
    recent = _since(trips, days, as_of, c)
    sums = {
        "distance_u": fixed(c.distance),
        "distance_n": F.col(c.distance).isNotNull().cast("bigint"),
        "fare_u": fixed(c.fare),
        "fare_n": F.col(c.fare).isNotNull().cast("bigint"),
        "total_u": fixed(c.total),
    }
    optional: list[Column] = []
    if c.payment in trips.columns:
        for name, code in (("credit_card_trips", CARD_PAYMENT), ("cash_trips", CASH_PAYMENT)):
            sums[name] = F.coalesce(F.col(c.payment) == code, F.lit(False)).cast("bigint")
            optional.append(F.col(name))
    if c.passengers in trips.columns:
        sums["passengers_u"] = fixed(c.passengers)
        sums["passengers_n"] = F.col(c.passengers).isNotNull().cast("bigint")
        optional.append(_mean("passengers").alias("avg_passengers"))
    carried = Carried(sums, {"min_fare": F.col(c.total)}, {"max_fare": F.col(c.total)})
    by_day = recent.withColumn("trip_date", day_of(c.pickup))
    return (
        grouped_percentiles(by_day, ["trip_date"], c.distance, {"median_distance": 0.5}, carried)
        .select(
            "trip_date",
            F.col(GROUP_ROWS).alias("total_trips"),
            _mean("distance").alias("avg_distance"),
            "median_distance",
            _mean("fare").alias("avg_fare"),
            from_fixed(F.col("total_u")).alias("daily_revenue"),
            "min_fare",
            "max_fare",
            *optional,
        )
        .orderBy(F.desc("trip_date"))
    )


def _mean(prefix: str) -> Column:
    return from_fixed(F.col(f"{prefix}_u")) / F.nullif(F.col(f"{prefix}_n"), F.lit(0))


def daily_aggregates(
    trips: DataFrame, as_of: str, days: int = 7, c: TripColumns = TRIPS
) -> DataFrame:
    """a_daily_aggregates: the plain daily figures of the last days."""
    return (
        _since(trips, days, as_of, c)
        .groupBy(day_of(c.pickup).alias("trip_date"))
        .agg(
            rows().alias("total_trips"),
            mean_of(c.distance).alias("avg_distance"),
            mean_of(c.fare).alias("avg_fare"),
            total_of(c.total).alias("daily_revenue"),
            _paid_with(c, CARD_PAYMENT).alias("credit_card_trips"),
            _paid_with(c, CASH_PAYMENT).alias("cash_trips"),
        )
        .orderBy(F.desc("trip_date"))
    )


def vendor_report(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """a_vendor_perf: full figures per vendor, best revenue first."""
    return (
        trips.groupBy(c.vendor)
        .agg(
            rows().alias("trip_count"),
            mean_of(c.distance).alias("avg_distance"),
            mean_of(c.fare).alias("avg_fare"),
            mean_of(c.total).alias("avg_total"),
            _paid_with(c, CARD_PAYMENT).alias("credit_card_trips"),
            _paid_with(c, CASH_PAYMENT).alias("cash_trips"),
            total_of(c.total).alias("total_revenue"),
        )
        .orderBy(F.desc_nulls_last("total_revenue"), c.vendor)
    )


def vendor_report_rounded(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """a_vendor_perf_rounded: rounded figures; the mean total divides by all rows."""
    passengers = (
        [mean_of(c.passengers).alias("avg_passengers")] if c.passengers in trips.columns else []
    )
    return (
        trips.groupBy(F.col(c.vendor).alias("vendor_id"))
        .agg(
            rows().alias("total_trips"),
            round2(mean_of(c.distance)).alias("avg_distance"),
            round2(mean_of(c.fare)).alias("avg_fare"),
            round2(total_of(c.total) / rows()).alias("avg_total"),
            round2(total_of(c.total)).alias("total_revenue"),
            *passengers,
        )
        .orderBy(F.desc_nulls_last("total_revenue"), "vendor_id")
    )


def _daily_mean(trips: DataFrame, c: TripColumns, day: str, n: int) -> DataFrame:
    return (
        trips.groupBy(day_of(c.pickup).alias(day))
        .agg(rows().alias("trips"), mean_of(c.total).alias("avg_fare"))
        .orderBy(F.desc(day))
        .limit(n)
    )


def daily_fare_top(trips: DataFrame, n: int = 10, c: TripColumns = TRIPS) -> DataFrame:
    """a_daily_fare_top: the latest n days."""
    return _daily_mean(trips, c, "pickup_date", n)


def vendor_averages(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """a_vendor_avg."""
    return trips.groupBy(c.vendor).agg(
        rows().alias("trips"),
        mean_of(c.distance).alias("avg_distance"),
        mean_of(c.total).alias("avg_fare"),
    )


def peak_hours(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """a_peak_hours: busiest hour of the day first."""
    return (
        trips.groupBy(hour_of(c.pickup).alias("hour_of_day"))
        .agg(rows().alias("trip_count"), mean_of(c.total).alias("avg_fare"))
        .orderBy(F.desc("trip_count"), "hour_of_day")
    )


def payment_analysis(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """a_payment_analysis: paid trips per payment type."""
    return (
        trips.where(F.col(c.total) > 0)
        .groupBy(c.payment)
        .agg(rows().alias("trips"), mean_of(c.total).alias("avg_amount"))
        .orderBy(F.desc("trips"), c.payment)
    )


def year_distribution(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """a_year_dist."""
    return trips.groupBy(year_of(c.pickup).alias(YEAR)).agg(rows().alias("trips")).orderBy(YEAR)


def year_month_distribution(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """a_year_month_dist; on a partitioned table the partition columns answer it."""
    if YEAR in trips.columns and MONTH in trips.columns:
        keys = [F.col(YEAR).cast("bigint").alias(YEAR), F.col(MONTH).cast("bigint").alias(MONTH)]
    else:
        keys = [year_of(c.pickup).alias(YEAR), month_number(c.pickup).alias(MONTH)]
    return trips.groupBy(*keys).agg(rows().alias("trips")).orderBy(YEAR, MONTH)


def daily_average_in_year(
    trips: DataFrame, year: int, n: int = 10, c: TripColumns = TRIPS
) -> DataFrame:
    """a_daily_avg_in_year: the latest n days of a year (a range, not ``year(ts) =``)."""
    return _daily_mean(in_range(trips, f"{year}-01-01", f"{year}-12-31", c), c, "day", n)


def daily_vendor_aggregates(trips: DataFrame, since: str, c: TripColumns = TRIPS) -> DataFrame:
    """a_date_vendor_agg."""
    return (
        trips.where(F.col(c.pickup) >= ntz(since))
        .groupBy(day_of(c.pickup).alias("trip_date"), c.vendor)
        .agg(rows().alias("trips"), mean_of(c.total).alias("avg_fare"))
    )


def range_count(trips: DataFrame, first: str, last: str, c: TripColumns = TRIPS) -> DataFrame:
    """a_range_count: rows in a day range, counted on pruned partitions."""
    return in_range(trips, first, last, c).agg(rows().alias("trips"))


def daily_revenue(trips: DataFrame, since: str, c: TripColumns = TRIPS) -> DataFrame:
    """a_daily_revenue."""
    return (
        trips.where(F.col(c.pickup) >= ntz(since))
        .groupBy(day_of(c.pickup).alias("trip_date"))
        .agg(
            rows().alias("total_trips"),
            mean_of(c.distance).alias("avg_distance"),
            mean_of(c.fare).alias("avg_fare"),
            total_of(c.total).alias("daily_revenue"),
        )
        .orderBy(F.desc("trip_date"))
    )


def day_totals(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """The rows of the materialised daily summary."""
    return trips.groupBy(day_of(c.pickup).alias("day")).agg(
        rows().alias("trips"),
        mean_of(c.fare).alias("avg_fare"),
        total_of(c.total).alias("revenue"),
    )


def write_daily_summary(trips: DataFrame, path: str, c: TripColumns = TRIPS) -> DataFrame:
    """a_daily_summary_table: (re)materialise the daily summary and return it read back.

    One row per day, so the write is a single small file per reducer.
    """
    summary = day_totals(trips, c)
    summary.write.mode("overwrite").parquet(path)
    return trips.sparkSession.read.schema(summary.schema).parquet(path)


def range_profile(trips: DataFrame, first: str, last: str, c: TripColumns = TRIPS) -> DataFrame:
    """a_range_profile: one row of statistics for a day range, median included."""
    kept = in_range(trips, first, last, c).select(c.distance, c.fare, c.total)
    median = F.lit(percentile_of(kept, c.fare, 0.5)).cast("double")
    return kept.agg(
        rows().alias("trips"),
        mean_of(c.distance).alias("avg_distance"),
        mean_of(c.fare).alias("avg_fare"),
        median.alias("median_fare"),
        F.min(c.fare).alias("min_fare"),
        F.max(c.fare).alias("max_fare"),
        total_of(c.total).alias("total_revenue"),
    )


def range_monthly_counts(
    trips: DataFrame, first: str, last: str, c: TripColumns = TRIPS
) -> DataFrame:
    """a_range_monthly_counts."""
    return (
        in_range(trips, first, last, c)
        .groupBy(month_of(c.pickup).alias("trip_month"))
        .agg(rows().alias("trips"))
        .orderBy("trip_month")
    )


def range_daily_stats(
    trips: DataFrame, first: str, last: str, c: TripColumns = TRIPS
) -> DataFrame:
    """a_range_daily_stats; ``trips`` counts known fares."""
    return (
        in_range(trips, first, last, c)
        .groupBy(day_of(c.pickup).alias("day"))
        .agg(
            F.count(c.fare).alias("trips"),
            round2(mean_of(c.fare)).alias("avg_fare"),
            round2(total_of(c.fare)).alias("total_fare"),
            round2(mean_of(c.distance)).alias("avg_distance"),
            round2(total_of(c.total)).alias("total_revenue"),
        )
        .orderBy("day")
    )


def sample_routes(trips: DataFrame, n: int = 5, c: TripColumns = TRIPS) -> DataFrame:
    """a_sample_routes: q03 with fewer rows and rounded figures."""
    return corpus.top_routes_by_revenue(trips, c, n).select(
        c.pickup_zone,
        c.dropoff_zone,
        F.col("freq").alias("trips"),
        round2(F.col("revenue")).alias("revenue"),
        round2(F.col("avg_fare")).alias("avg_fare"),
    )


def sample_daily(trips: DataFrame, n: int = 5, c: TripColumns = TRIPS) -> DataFrame:
    """a_sample_daily: the latest n days, rounded."""
    return (
        trips.groupBy(day_of(c.pickup).alias("trip_date"))
        .agg(
            rows().alias("trips"),
            round2(total_of(c.total)).alias("daily_revenue"),
            round2(mean_of(c.total)).alias("avg_fare"),
        )
        .orderBy(F.desc("trip_date"))
        .limit(n)
    )


def sample_hourly(trips: DataFrame, n: int = 24, c: TripColumns = TRIPS) -> DataFrame:
    """a_sample_hourly: trips and revenue per hour of day."""
    return (
        trips.groupBy(hour_of(c.pickup).alias("hour"))
        .agg(rows().alias("trips"), round2(total_of(c.total)).alias("revenue"))
        .orderBy("hour")
        .limit(n)
    )


def peek(df: DataFrame, n: int = 5, order: Sequence[str] = ()) -> DataFrame:
    """a_peek: the first n rows, of the given order if there is one."""
    return (df.orderBy(*order) if order else df).limit(n)


def table_stats(df: DataFrame) -> DataFrame:
    """a_table_stats: one row per column with its type, next to row and column counts."""
    described = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
            )
            for i, f in enumerate(df.schema.fields, start=1)
        ]
    )
    counted = df.agg(rows().alias("total_rows"))
    return counted.select(
        "total_rows",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.inline(described),
    )
