"""Second published versions of the benchmark queries that compute something different."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.columns import AIRPORT_ZONES, TripColumns
from fareloom.functions import bins
from fareloom.functions.numbers import fixed, from_fixed, mean_of, over, round2, total_of
from fareloom.functions.times import month_of
from fareloom.operators import corpus
from fareloom.operators.corpus import TRIPS, rows
from fareloom.operators.ordering import GROUP_ROWS, Carried, grouped_percentiles
from fareloom.operators.selection import percentile_of, tile_totals


def top_zones(trips: DataFrame, c: TripColumns = TRIPS, n: int = 10) -> DataFrame:
    """b08: best earning routes, trips within one zone included."""
    return (
        trips.groupBy(c.pickup_zone, c.dropoff_zone)
        .agg(rows().alias("trips"), total_of(c.total).alias("revenue"))
        .orderBy(F.desc_nulls_last("revenue"), c.pickup_zone, c.dropoff_zone)
        .limit(n)
    )


def _tip_share(trips: DataFrame, c: TripColumns, label, name: str) -> DataFrame:
    return trips.groupBy(label.alias(name)).agg(
        rows().alias("trips"),
        round2(F.avg(over(F.col(c.tip), F.col(c.fare))) * 100).alias("tip_pct"),
    )


def tip_pct_by_total_bin(
    trips: DataFrame,
    c: TripColumns = TRIPS,
    edges: Sequence[float] = (10, 20, 30),
    labels: Sequence[str] = ("$0-10", "$10-20", "$20-30", "$30+"),
) -> DataFrame:
    """b09: mean tip share of the fare per range of the total."""
    label = bins.below(F.col(c.total), edges, labels)
    return _tip_share(trips, c, label, "fare_bin").orderBy(F.desc_nulls_last("tip_pct"), "fare_bin")


def airport_by_zone(
    trips: DataFrame, c: TripColumns = TRIPS, zones: Sequence[int] = AIRPORT_ZONES
) -> DataFrame:
    """b10: airport pickups, airport dropoffs and the rest."""
    label = (
        F.when(F.col(c.pickup_zone).isin(*zones), "Airport Pickup")
        .when(F.col(c.dropoff_zone).isin(*zones), "Airport Dropoff")
        .otherwise("Non-Airport")
    )
    return (
        trips.groupBy(label.alias("location_type"))
        .agg(
            rows().alias("trips"),
            round2(mean_of(c.distance)).alias("avg_distance"),
            round2(mean_of(c.total)).alias("avg_total"),
        )
        .orderBy(F.desc("trips"), "location_type")
    )


def p90_by_month_vendor(
    trips: DataFrame, c: TripColumns = TRIPS, level: float = 0.9, n: int = 50
) -> DataFrame:
    """b12: as q07, but ordered by month and vendor and cut at 50 groups."""
    return corpus.p90_distance(trips, c, level, n).select(
        "trip_month", c.vendor, "trips", F.col("p90_dist").alias("p90_distance")
    )


def revenue_per_mile_ranked(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """b13: as q18, unrounded, best vendor of a month first."""
    return (
        trips.where(F.col(c.distance) > 0)
        .groupBy(month_of(c.pickup).alias("trip_month"), c.vendor)
        .agg(over(total_of(c.total), total_of(c.distance)).alias("revenue_per_mile"))
        .orderBy(F.desc("trip_month"), F.desc_nulls_last("revenue_per_mile"), c.vendor)
    )


def tip_pct_by_distance_bin(
    trips: DataFrame,
    c: TripColumns = TRIPS,
    edges: Sequence[float] = (1, 3, 5),
    labels: Sequence[str] = ("Short", "Medium", "Long", "Very Long"),
) -> DataFrame:
    """b15: mean tip share per distance range (upper edges included)."""
    label = bins.up_to(F.col(c.distance), edges, labels)
    return _tip_share(trips, c, label, "distance_bin").orderBy(F.desc("trips"), "distance_bin")


def fee_cross(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """b16: congestion surcharge × airport fee, both as Yes/No.

    The second flag has a name of its own: a GROUP BY alias equal to a source
    column would group on the raw fee.
    """
    return (
        trips.groupBy(
            bins.flag(F.col(c.congestion) > 0, "Yes", "No").alias("congestion"),
            bins.flag(F.col(c.airport) > 0, "Yes", "No").alias("airport"),
        )
        .agg(rows().alias("trips"), round2(total_of(c.total)).alias("revenue"))
        .orderBy(F.desc("trips"), "congestion", "airport")
    )


def quintile_profile(trips: DataFrame, c: TripColumns = TRIPS, tiles: int = 5) -> DataFrame:
    """b17: mean distance and amount per NTILE from the highest amount down.

    Equal amounts are ordered by distance, which fixes the mean distance of
    every tile without needing a unique row key.
    """
    known = {
        "distance_n": F.col(c.distance).isNotNull().cast("bigint"),
        "total_n": F.col(c.total).isNotNull().cast("bigint"),
    }
    totals = tile_totals(
        trips.select(c.total, c.distance),
        {c.total: "desc", c.distance: "asc"},
        tiles,
        {"distance_u": fixed(c.distance), "total_u": fixed(c.total), **known},
    )

    def mean(prefix: str):
        return from_fixed(F.col(f"{prefix}_u")) / F.nullif(F.col(f"{prefix}_n"), F.lit(0))

    return totals.select(
        F.col("tile").alias("revenue_quintile"),
        F.col("rows_in_tile").alias("trips"),
        round2(mean("distance")).alias("avg_distance"),
        round2(mean("total")).alias("avg_total"),
    ).orderBy("revenue_quintile")


def ratecode_median_stddev(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """b19: rows, exact median and sample standard deviation of the fare per rate code.

    The deviation comes from sums that the median's count of equal values carries along: one scan.
    """
    cents = fixed(c.fare).cast("decimal(18,0)")
    moments = {"known": F.col(c.fare).isNotNull().cast("bigint"), "sum_u": cents, "square_u": cents * cents}
    medians = grouped_percentiles(trips, [c.rate_code], c.fare, {"median_fare": 0.5}, Carried(moments))
    # Exact in whole cents, so that nothing is lost where the two terms are nearly equal.
    total = F.col("sum_u").cast("decimal(38,0)")
    spread = F.col("known") * F.col("square_u") - total * total
    pairs = F.col("known").cast("double") * (F.col("known") - 1)
    deviation = F.when(F.col("known") > 1, F.sqrt(spread.cast("double") / F.nullif(pairs, F.lit(0.0))))
    return medians.select(
        c.rate_code,
        F.col(GROUP_ROWS).alias("trips"),
        "median_fare",
        round2(deviation / 100).alias("fare_stddev"),
    ).orderBy(F.desc("trips"), c.rate_code)


def top5pct_threshold(trips: DataFrame, c: TripColumns = TRIPS, level: float = 0.95) -> DataFrame:
    """b20: amounts at or above the global 95th percentile against the rest.

    The threshold is found first and enters the plan as a literal.
    """
    bound = F.lit(percentile_of(trips, c.total, level)).cast("double")
    segment = bins.flag(F.col(c.total) >= bound, "Top 5%", "Bottom 95%")
    return (
        trips.select(segment.alias("revenue_segment"), c.distance, c.total)
        .groupBy("revenue_segment")
        .agg(
            rows().alias("trips"),
            round2(mean_of(c.distance)).alias("avg_distance"),
            round2(mean_of(c.total)).alias("avg_total"),
        )
        .orderBy(F.desc("trips"))
    )
