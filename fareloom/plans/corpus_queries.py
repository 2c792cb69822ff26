"""Registry of the benchmark queries and their variants on the given tables."""

from __future__ import annotations

from fareloom.operators import corpus as q
from fareloom.operators import variants as b
from fareloom.plans.entry import Query, dec_avg, dec_sum, on_events, on_lineitem, r2

DAY = "CAST(tpep_pickup_datetime AS DATE)"
MONTH = "CAST(date_trunc('month', tpep_pickup_datetime) AS TIMESTAMP)"
HOUR = "CAST(extract(hour FROM tpep_pickup_datetime) AS BIGINT)"
DOW = "CAST(extract(dow FROM tpep_pickup_datetime) AS BIGINT)"
REVENUE = dec_sum("total_amount")

# Amount bins that split lineitem prices (up to about 100,000), and distance bins for 1 … 50.
PRICE_EDGES = (10_000, 30_000)
PRICE_LABELS = ("<10k", "10k-30k", "30k+")
TOTAL_EDGES = (10_000, 20_000, 60_000)
TOTAL_LABELS = ("0-10k", "10k-20k", "20k-60k", "60k+")
DISTANCE_EDGES = (10, 25, 40)
SOME_ZONES = (3, 5, 8)


def _label_sql(case: str, name: str) -> str:
    return f"SELECT {case} AS {name}, COUNT(*) AS trips, {REVENUE} AS revenue FROM trips GROUP BY 1"


def corpus_queries() -> dict[str, Query]:
    growth = "(cur - prev) / NULLIF(prev, 0) * 100"
    monthly = f", m AS (SELECT {MONTH} AS mo, {REVENUE} AS rev FROM trips GROUP BY 1)"
    return {
        "q01_daily_vendor_growth": on_lineitem(
            q.daily_vendor_growth,
            f"""
            , d AS (SELECT {DAY} AS trip_date, VendorID, COUNT(*) AS trip_count, {REVENUE} AS cur
                    FROM trips WHERE total_amount > 0 GROUP BY 1, 2)
            , l AS (SELECT *, LAG(cur) OVER (PARTITION BY VendorID ORDER BY trip_date) AS prev FROM d)
            SELECT trip_date, VendorID, trip_count, cur AS daily_revenue, {r2(growth)} AS growth_pct
            FROM l ORDER BY trip_date DESC""",
        ),
        "q02_hourly_demand": on_events(
            q.hourly_demand,
            f"""
            SELECT {DAY} AS trip_date, {HOUR} AS pickup_hour, COUNT(*) AS trips,
                   {REVENUE} AS revenue, {r2(dec_avg('total_amount'))} AS avg_fare
            FROM trips GROUP BY 1, 2 ORDER BY 1 DESC, 2""",
        ),
        "q03_top_routes_by_revenue": on_lineitem(
            q.top_routes_by_revenue,
            f"""
            SELECT PULocationID, DOLocationID, COUNT(*) AS freq, {REVENUE} AS revenue,
                   {dec_avg('total_amount')} AS avg_fare
            FROM trips WHERE PULocationID <> DOLocationID
            GROUP BY 1, 2 ORDER BY revenue DESC, 1, 2 LIMIT 10""",
        ),
        "q04_duration_speed": on_events(
            q.duration_speed,
            f"""
            , t AS (SELECT passenger_count, trip_distance,
                      date_diff('minute', tpep_pickup_datetime, tpep_dropoff_datetime) AS mins,
                      date_diff('hour', tpep_pickup_datetime, tpep_dropoff_datetime) AS hrs
                    FROM trips WHERE passenger_count > 0 AND passenger_count <= 9)
            SELECT passenger_count, COUNT(*) AS trips, {r2('AVG(mins)')} AS duration_mins,
                   {r2('AVG(trip_distance / NULLIF(hrs, 0))')} AS speed_mph
            FROM t GROUP BY 1""",
        ),
        "q04b_duration_speed_exact": on_events(
            q.duration_speed_exact,
            f"""
            , t AS (SELECT passenger_count, trip_distance,
                      epoch_us(tpep_dropoff_datetime) - epoch_us(tpep_pickup_datetime) AS us
                    FROM trips WHERE passenger_count > 0 AND passenger_count <= 9)
            SELECT passenger_count, COUNT(*) AS trips,
                   {r2('AVG(us / 60000000.0)')} AS duration_mins,
                   {r2('AVG(trip_distance / NULLIF(us / 3600000000.0, 0))')} AS speed_mph
            FROM t GROUP BY 1 ORDER BY 1""",
        ),
        "q05_payment_tips": on_lineitem(
            q.payment_tips,
            f"""
            SELECT payment_type, COUNT(*) AS trips, {dec_sum('tip_amount')} AS total_tips,
                   {r2(f"{dec_sum('tip_amount')} / NULLIF({dec_sum('fare_amount')}, 0) * 100")} AS tip_pct
            FROM trips WHERE payment_type IN (1, 2) GROUP BY 1 ORDER BY total_tips DESC""",
        ),
        "q06_monthly_rolling_3m": on_lineitem(
            q.monthly_rolling,
            f"""{monthly}
            SELECT mo AS trip_month, rev AS revenue,
                   {r2('AVG(rev) OVER (ORDER BY mo ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS rolling_3m
            FROM m ORDER BY 1""",
        ),
        "q07_p90_distance": on_lineitem(
            q.p90_distance,
            f"""
            SELECT VendorID, {MONTH} AS trip_month, COUNT(*) AS trips,
                   quantile_cont(trip_distance, 0.9) AS p90_dist
            FROM trips GROUP BY 1, 2 ORDER BY 2 DESC, 1 LIMIT 100""",
        ),
        "q07b_p90_distance_approx": on_lineitem(
            # Groups far below the sketch's accuracy: it holds every value, so the result is exact.
            q.p90_distance_approx,
            f"""
            SELECT VendorID, {MONTH} AS trip_month, COUNT(*) AS trips,
                   quantile_disc(trip_distance, 0.9) AS p90_dist
            FROM trips GROUP BY 1, 2 ORDER BY 2 DESC, 1 LIMIT 100""",
        ),
        "q08_weekend_weekday": on_events(
            q.weekend_weekday,
            _label_sql(f"CASE WHEN {DOW} IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END", "day_type"),
        ),
        "q09_tip_pct_by_fare_bin": on_lineitem(
            q.tip_pct_by_fare_bin,
            f"""
            SELECT CASE WHEN fare_amount < 10000 THEN '<10k' WHEN fare_amount < 30000 THEN '10k-30k'
                        ELSE '30k+' END AS fare_bin,
                   COUNT(*) AS trips, {r2('AVG(tip_amount / NULLIF(fare_amount, 0)) * 100')} AS tip_pct
            FROM trips WHERE fare_amount > 0 GROUP BY 1""",
            edges=PRICE_EDGES,
            labels=PRICE_LABELS,
        ),
        "q10_top_routes_by_freq": on_lineitem(
            q.top_routes_by_freq,
            f"""
            SELECT PULocationID, DOLocationID, COUNT(*) AS freq, {dec_avg('total_amount')} AS avg_fare
            FROM trips GROUP BY 1, 2 ORDER BY freq DESC, 1, 2 LIMIT 20""",
        ),
        "q11_vendor_performance": on_lineitem(
            q.vendor_performance,
            f"""
            SELECT VendorID, COUNT(*) AS trips, {REVENUE} AS revenue,
                   {r2(f"{dec_sum('tip_amount')} / NULLIF({REVENUE}, 0) * 100")} AS tip_pct
            FROM trips GROUP BY 1 ORDER BY revenue DESC""",
        ),
        "q12_fee_impact": on_lineitem(
            q.fee_impact,
            _label_sql(
                "CASE WHEN congestion_surcharge > 0 THEN 'With Fees' ELSE 'No Fees' END",
                "fee_category",
            ),
        ),
        "q13_revenue_quintiles": on_lineitem(
            q.revenue_quintiles,
            f"""
            , t AS (SELECT total_amount, NTILE(5) OVER (ORDER BY total_amount) AS tier
                    FROM trips WHERE total_amount > 0)
            SELECT CAST(tier AS BIGINT) AS tier, COUNT(*) AS trips, {dec_avg('total_amount')} AS avg_amt
            FROM t GROUP BY 1 ORDER BY 1""",
        ),
        "q14_heatmap_24x7": on_events(
            q.heatmap,
            f"SELECT {HOUR} AS hr, {DOW} AS dow, COUNT(*) AS trips FROM trips GROUP BY 1, 2",
        ),
        "q15_airport_trips": on_lineitem(
            q.airport_trips,
            _label_sql("CASE WHEN airport_fee > 0 THEN 'Airport' ELSE 'Regular' END", "trip_type"),
        ),
        "q16_rate_codes": on_lineitem(
            q.rate_codes,
            f"""
            SELECT RatecodeID, COUNT(*) AS trips, {dec_avg('total_amount')} AS avg_fare
            FROM trips WHERE RatecodeID IS NOT NULL GROUP BY 1 ORDER BY trips DESC""",
        ),
        "q17_month_over_month": on_lineitem(
            q.month_over_month,
            f"""{monthly}
            , l AS (SELECT mo, rev AS cur, LAG(rev) OVER (ORDER BY mo) AS prev FROM m)
            SELECT mo, cur AS rev, {r2(growth)} AS pct_chg FROM l ORDER BY 1""",
        ),
        "q18_revenue_per_mile": on_lineitem(
            q.revenue_per_mile,
            f"""
            SELECT VendorID, {MONTH} AS mo,
                   {r2(f"{REVENUE} / NULLIF({dec_sum('trip_distance')}, 0)")} AS rpm
            FROM trips WHERE trip_distance > 0 GROUP BY 1, 2 ORDER BY 2 DESC""",
        ),
        "q19_cumulative_revenue": on_lineitem(
            q.cumulative_revenue,
            f"""
            , d AS (SELECT {DAY} AS dt, VendorID, SUM(CAST(total_amount AS DECIMAL(18,2))) AS rev
                    FROM trips GROUP BY 1, 2)
            SELECT dt, VendorID, CAST(rev AS DOUBLE) AS rev,
                   {r2('CAST(SUM(rev) OVER (PARTITION BY VendorID ORDER BY dt) AS DOUBLE)')} AS cumul
            FROM d ORDER BY 2, 1""",
        ),
        "q20_top5pct_vs_rest": on_lineitem(
            q.top5pct_vs_rest,
            f"""
            , r AS (SELECT total_amount, PERCENT_RANK() OVER (ORDER BY total_amount DESC) AS pct
                    FROM trips WHERE total_amount > 0)
            SELECT CASE WHEN pct <= 0.05 THEN 'Top 5%' ELSE 'Rest' END AS tier, COUNT(*) AS trips,
                   {dec_avg('total_amount')} AS avg_fare
            FROM r GROUP BY 1""",
        ),
        "b08_top_zones": on_lineitem(
            b.top_zones,
            f"""
            SELECT PULocationID, DOLocationID, COUNT(*) AS trips, {REVENUE} AS revenue
            FROM trips GROUP BY 1, 2 ORDER BY revenue DESC, 1, 2 LIMIT 10""",
        ),
        "b09_tip_pct_4bins": on_lineitem(
            b.tip_pct_by_total_bin,
            f"""
            SELECT CASE WHEN total_amount < 10000 THEN '0-10k' WHEN total_amount < 20000 THEN '10k-20k'
                        WHEN total_amount < 60000 THEN '20k-60k' ELSE '60k+' END AS fare_bin,
                   COUNT(*) AS trips, {r2('AVG(tip_amount / NULLIF(fare_amount, 0)) * 100')} AS tip_pct
            FROM trips GROUP BY 1""",
            edges=TOTAL_EDGES,
            labels=TOTAL_LABELS,
        ),
        "b10_airport_by_zone": on_lineitem(
            b.airport_by_zone,
            f"""
            SELECT CASE WHEN PULocationID IN (3, 5, 8) THEN 'Airport Pickup'
                        WHEN DOLocationID IN (3, 5, 8) THEN 'Airport Dropoff'
                        ELSE 'Non-Airport' END AS location_type,
                   COUNT(*) AS trips, {r2(dec_avg('trip_distance'))} AS avg_distance,
                   {r2(dec_avg('total_amount'))} AS avg_total
            FROM trips GROUP BY 1""",
            zones=SOME_ZONES,
        ),
        "b12_p90_by_month_vendor": on_lineitem(
            b.p90_by_month_vendor,
            f"""
            SELECT {MONTH} AS trip_month, VendorID, COUNT(*) AS trips,
                   quantile_cont(trip_distance, 0.9) AS p90_distance
            FROM trips GROUP BY 1, 2 ORDER BY 1 DESC, 2 LIMIT 50""",
        ),
        "b13_revenue_per_mile_ranked": on_lineitem(
            b.revenue_per_mile_ranked,
            f"""
            SELECT {MONTH} AS trip_month, VendorID,
                   {REVENUE} / NULLIF({dec_sum('trip_distance')}, 0) AS revenue_per_mile
            FROM trips WHERE trip_distance > 0 GROUP BY 1, 2""",
        ),
        "b14_payment_tips_all": on_lineitem(
            q.payment_tips,
            f"""
            SELECT payment_type, COUNT(*) AS trips, {dec_sum('tip_amount')} AS total_tips,
                   {r2(f"{dec_sum('tip_amount')} / NULLIF({dec_sum('fare_amount')}, 0) * 100")} AS tip_pct
            FROM trips GROUP BY 1 ORDER BY total_tips DESC""",
            payments=None,
        ),
        "b15_tip_pct_by_distance_bin": on_lineitem(
            b.tip_pct_by_distance_bin,
            f"""
            SELECT CASE WHEN trip_distance <= 10 THEN 'Short' WHEN trip_distance <= 25 THEN 'Medium'
                        WHEN trip_distance <= 40 THEN 'Long' ELSE 'Very Long' END AS distance_bin,
                   COUNT(*) AS trips, {r2('AVG(tip_amount / NULLIF(fare_amount, 0)) * 100')} AS tip_pct
            FROM trips GROUP BY 1""",
            edges=DISTANCE_EDGES,
        ),
        "b16_fee_cross": on_lineitem(
            b.fee_cross,
            f"""
            SELECT CASE WHEN congestion_surcharge > 0 THEN 'Yes' ELSE 'No' END AS congestion,
                   CASE WHEN airport_fee > 0 THEN 'Yes' ELSE 'No' END AS airport,
                   COUNT(*) AS trips, {r2(REVENUE)} AS revenue
            FROM trips GROUP BY 1, 2""",
        ),
        "b17_quintile_profile": on_lineitem(
            b.quintile_profile,
            f"""
            , t AS (SELECT trip_distance, total_amount,
                      NTILE(5) OVER (ORDER BY total_amount DESC, trip_distance) AS tile FROM trips)
            SELECT CAST(tile AS BIGINT) AS revenue_quintile, COUNT(*) AS trips,
                   {r2(dec_avg('trip_distance'))} AS avg_distance,
                   {r2(dec_avg('total_amount'))} AS avg_total
            FROM t GROUP BY 1 ORDER BY 1""",
        ),
        "b19_ratecode_median_stddev": on_lineitem(
            b.ratecode_median_stddev,
            f"""
            SELECT RatecodeID, COUNT(*) AS trips, quantile_cont(fare_amount, 0.5) AS median_fare,
                   {r2('stddev_samp(fare_amount)')} AS fare_stddev
            FROM trips GROUP BY 1""",
        ),
        "b20_top5pct_threshold": on_lineitem(
            b.top5pct_threshold,
            f"""
            , p AS (SELECT quantile_cont(total_amount, 0.95) AS bound FROM trips)
            SELECT CASE WHEN total_amount >= (SELECT bound FROM p) THEN 'Top 5%' ELSE 'Bottom 95%' END
                     AS revenue_segment,
                   COUNT(*) AS trips, {r2(dec_avg('trip_distance'))} AS avg_distance,
                   {r2(dec_avg('total_amount'))} AS avg_total
            FROM trips GROUP BY 1""",
        ),
    }
