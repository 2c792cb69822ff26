"""The 20 benchmark queries (and two of their published variants) over a trip table.

All take the trip table and a :class:`TripColumns`; all return lazy DataFrames
in the published row order. Where the published ORDER BY leaves ties in front
of a LIMIT, the grouping keys are added as tie-break so the result is one
definite set of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareloom.columns import CARD_PAYMENT, CASH_PAYMENT, TripColumns
from fareloom.functions import bins
from fareloom.functions.numbers import fixed, from_fixed, mean_of, over, percent, round2, total_of
from fareloom.functions.times import (
    boundaries_crossed,
    day_of,
    elapsed,
    hour_of,
    month_of,
    weekday_sun0,
)
from fareloom.operators.ordering import GROUP_ROWS, grouped_percentiles
from fareloom.operators.selection import tile_totals, top_share_bound

TRIPS = TripColumns()


def rows() -> Column:
    return F.count(F.lit(1))


def _growth(value: Column, window) -> Column:
    previous = F.lag(value).over(window)
    return round2(percent(value - previous, previous))


def daily_vendor_growth(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """q01: revenue per day and vendor with the change against the vendor's previous day."""
    daily = (
        trips.where(F.col(c.total) > 0)
        .groupBy(day_of(c.pickup).alias("trip_date"), c.vendor)
        .agg(rows().alias("trip_count"), total_of(c.total).alias("daily_revenue"))
    )
    # Days × vendors rows at most; the window never sees trips.
    by_vendor = Window.partitionBy(c.vendor).orderBy("trip_date")
    return daily.withColumn("growth_pct", _growth(F.col("daily_revenue"), by_vendor)).orderBy(
        F.desc("trip_date"), F.asc_nulls_last(c.vendor)
    )


def hourly_demand(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """q02: trips, revenue and mean amount per day and hour."""
    return (
        trips.groupBy(day_of(c.pickup).alias("trip_date"), hour_of(c.pickup).alias("pickup_hour"))
        .agg(
            rows().alias("trips"),
            total_of(c.total).alias("revenue"),
            round2(mean_of(c.total)).alias("avg_fare"),
        )
        .orderBy(F.desc("trip_date"), "pickup_hour")
    )


def top_routes_by_revenue(trips: DataFrame, c: TripColumns = TRIPS, n: int = 10) -> DataFrame:
    """q03: the n routes between different zones that earn most."""
    return (
        trips.where(F.col(c.pickup_zone) != F.col(c.dropoff_zone))
        .groupBy(c.pickup_zone, c.dropoff_zone)
        .agg(
            rows().alias("freq"),
            total_of(c.total).alias("revenue"),
            mean_of(c.total).alias("avg_fare"),
        )
        .orderBy(F.desc_nulls_last("revenue"), c.pickup_zone, c.dropoff_zone)
        .limit(n)
    )


def _duration_speed(trips: DataFrame, c: TripColumns, minutes: Column, hours: Column) -> DataFrame:
    return (
        trips.where((F.col(c.passengers) > 0) & (F.col(c.passengers) <= 9))
        .groupBy(c.passengers)
        .agg(
            rows().alias("trips"),
            round2(F.avg(minutes)).alias("duration_mins"),
            round2(F.avg(over(F.col(c.distance), hours))).alias("speed_mph"),
        )
    )


def duration_speed(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """q04: mean duration and speed per passenger count, in clock minutes and hours crossed."""
    minutes = boundaries_crossed("minute", c.pickup, c.dropoff)
    hours = boundaries_crossed("hour", c.pickup, c.dropoff).cast("double")
    return _duration_speed(trips, c, minutes, hours).orderBy(
        F.desc_nulls_last("duration_mins"), c.passengers
    )


def duration_speed_exact(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """q04b: the same with fractional minutes and hours."""
    minutes = elapsed("minute", c.pickup, c.dropoff)
    hours = elapsed("hour", c.pickup, c.dropoff)
    return _duration_speed(trips, c, minutes, hours).orderBy(c.passengers)


def payment_tips(
    trips: DataFrame,
    c: TripColumns = TRIPS,
    payments: Sequence[int] | None = (CARD_PAYMENT, CASH_PAYMENT),
) -> DataFrame:
    """q05: tips per payment type; ``payments=None`` keeps every type (b14)."""
    kept = trips if payments is None else trips.where(F.col(c.payment).isin(*payments))
    tips, fares = F.sum(fixed(c.tip)), F.sum(fixed(c.fare))
    return (
        kept.groupBy(c.payment)
        .agg(
            rows().alias("trips"),
            from_fixed(tips).alias("total_tips"),
            round2(percent(from_fixed(tips), from_fixed(fares))).alias("tip_pct"),
        )
        .orderBy(F.desc_nulls_last("total_tips"), c.payment)
    )


def _monthly(trips: DataFrame, c: TripColumns, month: str, revenue: str) -> DataFrame:
    return trips.groupBy(month_of(c.pickup).alias(month)).agg(total_of(c.total).alias(revenue))


def monthly_rolling(trips: DataFrame, c: TripColumns = TRIPS, months: int = 3) -> DataFrame:
    """q06: monthly revenue with its trailing mean.

    The window has no PARTITION BY, but its input is one row per month.
    """
    trailing = Window.orderBy("trip_month").rowsBetween(-(months - 1), 0)
    return (
        _monthly(trips, c, "trip_month", "revenue")
        .withColumn("rolling_3m", round2(F.avg("revenue").over(trailing)))
        .orderBy("trip_month")
    )


def p90_distance(
    trips: DataFrame, c: TripColumns = TRIPS, level: float = 0.9, n: int = 100
) -> DataFrame:
    """q07: exact 90th percentile distance per vendor and month, latest n groups."""
    months = trips.select(c.vendor, month_of(c.pickup).alias("trip_month"), c.distance)
    return (
        grouped_percentiles(months, [c.vendor, "trip_month"], c.distance, {"p90_dist": level})
        .select(c.vendor, "trip_month", F.col(GROUP_ROWS).alias("trips"), "p90_dist")
        .orderBy(F.desc_nulls_last("trip_month"), F.asc_nulls_last(c.vendor))
        .limit(n)
    )


def p90_distance_approx(
    trips: DataFrame,
    c: TripColumns = TRIPS,
    level: float = 0.9,
    n: int = 100,
    accuracy: int = 10000,
) -> DataFrame:
    """q07b: the same from a mergeable sketch; rank error at most 1/accuracy."""
    return (
        trips.groupBy(c.vendor, month_of(c.pickup).alias("trip_month"))
        .agg(
            rows().alias("trips"),
            F.percentile_approx(c.distance, level, accuracy).alias("p90_dist"),
        )
        .orderBy(F.desc_nulls_last("trip_month"), F.asc_nulls_last(c.vendor))
        .limit(n)
    )


def _by_label(trips: DataFrame, c: TripColumns, label: Column, name: str) -> DataFrame:
    return (
        trips.groupBy(label.alias(name))
        .agg(rows().alias("trips"), total_of(c.total).alias("revenue"))
        .orderBy(F.desc_nulls_last("revenue"), name)
    )


def weekend_weekday(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """q08: weekend (Saturday, Sunday) against weekday."""
    weekend = weekday_sun0(c.pickup).isin(0, 6)
    return _by_label(trips, c, bins.flag(weekend, "Weekend", "Weekday"), "day_type")


def tip_pct_by_fare_bin(
    trips: DataFrame,
    c: TripColumns = TRIPS,
    edges: Sequence[float] = (10, 20),
    labels: Sequence[str] = ("<$10", "$10-20", "$20+"),
) -> DataFrame:
    """q09: mean tip share of the fare per fare range."""
    fare = F.col(c.fare)
    return (
        trips.where(fare > 0)
        .groupBy(bins.below(fare, edges, labels).alias("fare_bin"))
        .agg(rows().alias("trips"), round2(F.avg(over(F.col(c.tip), fare)) * 100.0).alias("tip_pct"))
        .orderBy(F.desc_nulls_last("tip_pct"), "fare_bin")
    )


def top_routes_by_freq(trips: DataFrame, c: TripColumns = TRIPS, n: int = 20) -> DataFrame:
    """q10: the n most frequent routes."""
    return (
        trips.groupBy(c.pickup_zone, c.dropoff_zone)
        .agg(rows().alias("freq"), mean_of(c.total).alias("avg_fare"))
        .orderBy(F.desc("freq"), c.pickup_zone, c.dropoff_zone)
        .limit(n)
    )


def vendor_performance(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """q11: revenue and tip share per vendor."""
    tips, totals = F.sum(fixed(c.tip)), F.sum(fixed(c.total))
    return (
        trips.groupBy(c.vendor)
        .agg(
            rows().alias("trips"),
            from_fixed(totals).alias("revenue"),
            round2(percent(from_fixed(tips), from_fixed(totals))).alias("tip_pct"),
        )
        .orderBy(F.desc_nulls_last("revenue"), c.vendor)
    )


def fee_impact(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """q12: with and without congestion surcharge; an unknown surcharge counts as none."""
    label = bins.flag(F.col(c.congestion) > 0, "With Fees", "No Fees")
    return _by_label(trips, c, label, "fee_category")


def revenue_quintiles(trips: DataFrame, c: TripColumns = TRIPS, tiles: int = 5) -> DataFrame:
    """q13: rows and mean amount per NTILE of the amount."""
    paid = trips.where(F.col(c.total) > 0).select(c.total)
    totals = tile_totals(paid, {c.total: "asc"}, tiles, {"units": fixed(c.total)})
    return totals.select(
        F.col("tile").alias("tier"),
        F.col("rows_in_tile").alias("trips"),
        (from_fixed(F.col("units")) / F.col("rows_in_tile")).alias("avg_amt"),
    ).orderBy("tier")


def heatmap(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """q14: trips per hour and weekday (Sunday = 0)."""
    return (
        trips.groupBy(hour_of(c.pickup).alias("hr"), weekday_sun0(c.pickup).alias("dow"))
        .agg(rows().alias("trips"))
        .orderBy("dow", "hr")
    )


def airport_trips(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """q15: trips with an airport fee against the rest."""
    label = bins.flag(F.col(c.airport) > 0, "Airport", "Regular")
    return _by_label(trips, c, label, "trip_type")


def rate_codes(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """q16: trips and mean amount per known rate code."""
    return (
        trips.where(F.col(c.rate_code).isNotNull())
        .groupBy(c.rate_code)
        .agg(rows().alias("trips"), mean_of(c.total).alias("avg_fare"))
        .orderBy(F.desc("trips"), c.rate_code)
    )


def month_over_month(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """q17: monthly revenue and its change (window input: one row per month)."""
    return (
        _monthly(trips, c, "mo", "rev")
        .withColumn("pct_chg", _growth(F.col("rev"), Window.orderBy("mo")))
        .orderBy("mo")
    )


def _per_mile(trips: DataFrame, c: TripColumns, month: str, value: Column, name: str) -> DataFrame:
    return (
        trips.where(F.col(c.distance) > 0)
        .groupBy(c.vendor, month_of(c.pickup).alias(month))
        .agg(value.alias(name))
    )


def revenue_per_mile(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """q18: revenue per distance unit for each vendor and month."""
    rate = round2(over(total_of(c.total), total_of(c.distance)))
    return _per_mile(trips, c, "mo", rate, "rpm").orderBy(F.desc("mo"), F.asc_nulls_last(c.vendor))


def cumulative_revenue(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """q19: running revenue per vendor; (day, vendor) is unique, so RANGE and ROWS agree."""
    daily = trips.groupBy(day_of(c.pickup).alias("dt"), c.vendor).agg(
        F.sum(fixed(c.total)).alias("cents")
    )
    so_far = (
        Window.partitionBy(c.vendor)
        .orderBy("dt")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return daily.select(
        "dt",
        c.vendor,
        from_fixed(F.col("cents")).alias("rev"),
        round2(from_fixed(F.sum("cents").over(so_far))).alias("cumul"),
    ).orderBy(F.asc_nulls_last(c.vendor), "dt")


def top5pct_vs_rest(trips: DataFrame, c: TripColumns = TRIPS, share: float = 0.05) -> DataFrame:
    """q20: rows with PERCENT_RANK ≤ share from the top, against the rest."""
    paid = trips.where(F.col(c.total) > 0).select(c.total)
    bound = top_share_bound(paid, c.total, share)
    tier = bins.flag(F.col(c.total) >= F.lit(bound), "Top 5%", "Rest")
    return (
        paid.groupBy(tier.alias("tier"))
        .agg(rows().alias("trips"), mean_of(c.total).alias("avg_fare"))
        .orderBy(F.desc_nulls_last("avg_fare"))
    )
