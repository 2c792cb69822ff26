"""Registry of the trip API reports on the given tables."""

from __future__ import annotations

from fareloom.operators import analytics as a
from fareloom.plans.bindings import table
from fareloom.plans.corpus_queries import DAY, HOUR, MONTH, REVENUE
from fareloom.plans.entry import Query, dec_avg, dec_sum, on_events, on_lineitem, r2
from fareloom.staging import scratch_path

DISTANCE, FARE, TOTAL = dec_avg("trip_distance"), dec_avg("fare_amount"), dec_avg("total_amount")
CARD = "COUNT(*) FILTER (WHERE payment_type = 1)"
CASH = "COUNT(*) FILTER (WHERE payment_type = 2)"

AS_OF = "2001-10-31"
SINCE = "1998-01-01"
LEAP = ("1996-01-01", "1996-02-29")
THIRTEEN_MONTHS = ("1997-06-01", "1998-06-30")
YEAR_END = ("1997-12-01", "1998-01-31")
SUMMER = ("1998-06-01", "1998-08-31")


def _between(span: tuple[str, str]) -> str:
    return (
        f"tpep_pickup_datetime >= TIMESTAMP '{span[0]}' "
        f"AND tpep_pickup_datetime < TIMESTAMP '{span[1]}' + INTERVAL 1 DAY"
    )


def _summary_table(trips):
    return a.write_daily_summary(trips, scratch_path(trips.sparkSession, "daily-summary"))


def analytics_queries() -> dict[str, Query]:
    latest = f"SELECT {DAY} AS {{day}}, COUNT(*) AS trips, {TOTAL} AS avg_fare FROM trips"
    return {
        "a_date_range": on_lineitem(
            a.date_range,
            f"""
            SELECT tpep_pickup_datetime, trip_distance, fare_amount, total_amount
            FROM trips WHERE {_between(LEAP)} ORDER BY 1""",
            *LEAP,
            columns=["pickup_datetime", "trip_distance", "fare_amount", "total_amount"],
        ),
        "a_daily_summary": on_lineitem(
            a.daily_summary,
            f"""
            SELECT {DAY} AS trip_date, COUNT(*) AS total_trips, {DISTANCE} AS avg_distance,
                   quantile_cont(trip_distance, 0.5) AS median_distance, {FARE} AS avg_fare,
                   {REVENUE} AS daily_revenue, MIN(total_amount) AS min_fare,
                   MAX(total_amount) AS max_fare, {CARD} AS credit_card_trips, {CASH} AS cash_trips,
                   {dec_avg('passenger_count')} AS avg_passengers
            FROM trips WHERE tpep_pickup_datetime >= DATE '{AS_OF}' - INTERVAL 30 DAY
            GROUP BY 1 ORDER BY 1 DESC""",
            AS_OF,
            days=30,
        ),
        "a_daily_aggregates": on_lineitem(
            a.daily_aggregates,
            f"""
            SELECT {DAY} AS trip_date, COUNT(*) AS total_trips, {DISTANCE} AS avg_distance,
                   {FARE} AS avg_fare, {REVENUE} AS daily_revenue,
                   {CARD} AS credit_card_trips, {CASH} AS cash_trips
            FROM trips WHERE tpep_pickup_datetime >= DATE '{AS_OF}' - INTERVAL 7 DAY
            GROUP BY 1 ORDER BY 1 DESC""",
            AS_OF,
            days=7,
        ),
        "a_vendor_perf": on_lineitem(
            a.vendor_report,
            f"""
            SELECT VendorID, COUNT(*) AS trip_count, {DISTANCE} AS avg_distance, {FARE} AS avg_fare,
                   {TOTAL} AS avg_total, {CARD} AS credit_card_trips, {CASH} AS cash_trips,
                   {REVENUE} AS total_revenue
            FROM trips GROUP BY 1 ORDER BY total_revenue DESC""",
        ),
        "a_vendor_perf_rounded": on_lineitem(
            a.vendor_report_rounded,
            f"""
            SELECT VendorID AS vendor_id, COUNT(*) AS total_trips, {r2(DISTANCE)} AS avg_distance,
                   {r2(FARE)} AS avg_fare, {r2(f'{REVENUE} / COUNT(*)')} AS avg_total,
                   {r2(REVENUE)} AS total_revenue, {dec_avg('passenger_count')} AS avg_passengers
            FROM trips GROUP BY 1 ORDER BY total_revenue DESC""",
        ),
        "a_daily_fare_top": on_lineitem(
            a.daily_fare_top, latest.format(day="pickup_date") + " GROUP BY 1 ORDER BY 1 DESC LIMIT 10"
        ),
        "a_vendor_avg": on_lineitem(
            a.vendor_averages,
            f"""
            SELECT VendorID, COUNT(*) AS trips, {DISTANCE} AS avg_distance, {TOTAL} AS avg_fare
            FROM trips GROUP BY 1""",
        ),
        "a_peak_hours": on_events(
            a.peak_hours,
            f"""
            SELECT {HOUR} AS hour_of_day, COUNT(*) AS trip_count, {TOTAL} AS avg_fare
            FROM trips GROUP BY 1 ORDER BY 2 DESC""",
        ),
        "a_payment_analysis": on_lineitem(
            a.payment_analysis,
            f"""
            SELECT payment_type, COUNT(*) AS trips, {TOTAL} AS avg_amount
            FROM trips WHERE total_amount > 0 GROUP BY 1 ORDER BY 2 DESC""",
        ),
        "a_year_dist": on_lineitem(
            a.year_distribution,
            """
            SELECT CAST(year(tpep_pickup_datetime) AS BIGINT) AS year, COUNT(*) AS trips
            FROM trips GROUP BY 1 ORDER BY 1""",
        ),
        "a_year_month_dist": on_lineitem(
            a.year_month_distribution,
            """
            SELECT CAST(year(tpep_pickup_datetime) AS BIGINT) AS year,
                   CAST(month(tpep_pickup_datetime) AS BIGINT) AS month, COUNT(*) AS trips
            FROM trips GROUP BY 1, 2 ORDER BY 1, 2""",
        ),
        "a_daily_avg_in_year": on_lineitem(
            a.daily_average_in_year,
            latest.format(day="day")
            + " WHERE year(tpep_pickup_datetime) = 1998 GROUP BY 1 ORDER BY 1 DESC LIMIT 10",
            year=1998,
        ),
        "a_date_vendor_agg": on_lineitem(
            a.daily_vendor_aggregates,
            f"""
            SELECT {DAY} AS trip_date, VendorID, COUNT(*) AS trips, {TOTAL} AS avg_fare
            FROM trips WHERE tpep_pickup_datetime >= TIMESTAMP '{SINCE}' GROUP BY 1, 2""",
            since=SINCE,
        ),
        "a_range_count": on_lineitem(
            a.range_count,
            f"SELECT COUNT(*) AS trips FROM trips WHERE {_between(SUMMER)}",
            *SUMMER,
        ),
        "a_daily_revenue": on_lineitem(
            a.daily_revenue,
            f"""
            SELECT {DAY} AS trip_date, COUNT(*) AS total_trips, {DISTANCE} AS avg_distance,
                   {FARE} AS avg_fare, {REVENUE} AS daily_revenue
            FROM trips WHERE tpep_pickup_datetime >= TIMESTAMP '{SINCE}' GROUP BY 1 ORDER BY 1 DESC""",
            since=SINCE,
        ),
        "a_daily_summary_table": on_lineitem(
            _summary_table,
            f"""
            SELECT {DAY} AS day, COUNT(*) AS trips, {FARE} AS avg_fare, {REVENUE} AS revenue
            FROM trips GROUP BY 1""",
        ),
        "a_range_profile": on_lineitem(
            a.range_profile,
            f"""
            SELECT COUNT(*) AS trips, {DISTANCE} AS avg_distance, {FARE} AS avg_fare,
                   quantile_cont(fare_amount, 0.5) AS median_fare, MIN(fare_amount) AS min_fare,
                   MAX(fare_amount) AS max_fare, {REVENUE} AS total_revenue
            FROM trips WHERE {_between(SUMMER)}""",
            *SUMMER,
        ),
        "a_range_monthly_counts": on_lineitem(
            a.range_monthly_counts,
            f"""
            SELECT {MONTH} AS trip_month, COUNT(*) AS trips
            FROM trips WHERE {_between(THIRTEEN_MONTHS)} GROUP BY 1 ORDER BY 1""",
            *THIRTEEN_MONTHS,
        ),
        "a_range_daily_stats": on_lineitem(
            a.range_daily_stats,
            f"""
            SELECT {DAY} AS day, COUNT(fare_amount) AS trips, {r2(FARE)} AS avg_fare,
                   {r2(dec_sum('fare_amount'))} AS total_fare, {r2(DISTANCE)} AS avg_distance,
                   {r2(REVENUE)} AS total_revenue
            FROM trips WHERE {_between(YEAR_END)} GROUP BY 1 ORDER BY 1""",
            *YEAR_END,
        ),
        "a_sample_routes": on_lineitem(
            a.sample_routes,
            f"""
            SELECT PULocationID, DOLocationID, COUNT(*) AS trips, {r2(REVENUE)} AS revenue,
                   {r2(TOTAL)} AS avg_fare
            FROM trips WHERE PULocationID <> DOLocationID
            GROUP BY 1, 2 ORDER BY {REVENUE} DESC, 1, 2 LIMIT 5""",
        ),
        "a_sample_daily": on_lineitem(
            a.sample_daily,
            f"""
            SELECT {DAY} AS trip_date, COUNT(*) AS trips, {r2(REVENUE)} AS daily_revenue,
                   {r2(TOTAL)} AS avg_fare
            FROM trips GROUP BY 1 ORDER BY 1 DESC LIMIT 5""",
        ),
        "a_sample_hourly": on_events(
            a.sample_hourly,
            f"""
            SELECT {HOUR} AS hour, COUNT(*) AS trips, {r2(REVENUE)} AS revenue
            FROM trips GROUP BY 1 ORDER BY 1 LIMIT 24""",
        ),
        "a_peek": Query(
            lambda spark, sf: a.peek(table(spark, sf, "events"), 5, ["event_id"]),
            "SELECT * FROM events ORDER BY event_id LIMIT 5",
        ),
        "a_table_stats": on_events(
            a.table_stats,
            """
            SELECT (SELECT COUNT(*) FROM trips) AS total_rows, CAST(6 AS BIGINT) AS column_count,
                   CAST(v.p AS BIGINT) AS position, v.n AS column_name, v.t AS data_type
            FROM (VALUES (1, 'VendorID', 'string'), (2, 'tpep_pickup_datetime', 'timestamp_ntz'),
                         (3, 'tpep_dropoff_datetime', 'timestamp_ntz'), (4, 'passenger_count', 'double'),
                         (5, 'trip_distance', 'double'), (6, 'total_amount', 'double')) AS v(p, n, t)""",
        ),
    }
