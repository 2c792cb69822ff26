"""Operators on trip frames with NULLs, ties, zero denominators and stray dates."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fareloom.columns import TRIP_SCHEMA, TripColumns
from fareloom.operators import analytics as a
from fareloom.operators import corpus as q
from fareloom.operators import variants as b
from fareloom.sources.names import normalize_columns
from trips import D, frame, synthetic, trip


@pytest.fixture(scope="module")
def trips(spark):
    return synthetic(spark).cache()


def rows(df, *names):
    return [tuple(r[n] for n in names or df.columns) for r in df.collect()]


def test_growth_restarts_per_vendor_and_survives_zero_days(spark):
    df = frame(
        spark,
        dict(total_amount=10.0),
        dict(total_amount=15.0, tpep_pickup_datetime=D(2024, 1, 2)),
        dict(total_amount=7.0, tpep_pickup_datetime=D(2024, 1, 2), VendorID=2),
        dict(total_amount=-5.0, tpep_pickup_datetime=D(2024, 1, 3)),
    )
    got = rows(q.daily_vendor_growth(df))
    assert got == [
        (dt.date(2024, 1, 2), 1, 1, 15.0, 50.0),
        (dt.date(2024, 1, 2), 2, 1, 7.0, None),
        (dt.date(2024, 1, 1), 1, 1, 10.0, None),
    ]


def test_unknown_surcharge_counts_as_none(trips):
    got = dict(rows(q.fee_impact(trips), "fee_category", "trips"))
    assert got["With Fees"] == trips.where("congestion_surcharge > 0").count()
    assert sum(got.values()) == trips.count()


def test_rate_codes_drop_null_group_but_median_keeps_it(trips):
    assert {r[0] for r in rows(q.rate_codes(trips))} == {1.0, 2.0, 99.0}
    assert {r[0] for r in rows(b.ratecode_median_stddev(trips))} == {None, 1.0, 2.0, 99.0}


def test_duration_variants_differ(spark):
    df = frame(
        spark,
        dict(
            tpep_pickup_datetime=D(2024, 1, 1, 10, 59, 30),
            tpep_dropoff_datetime=D(2024, 1, 1, 11, 1, 0),
            trip_distance=1.0,
        ),
        dict(passenger_count=0.0),
        dict(passenger_count=None),
        dict(passenger_count=10.0),
    )
    assert rows(q.duration_speed(df)) == [(1.0, 1, 2.0, 1.0)]
    assert rows(q.duration_speed_exact(df)) == [(1.0, 1, 1.5, 40.0)]


def test_speed_is_null_without_an_hour_boundary(spark):
    assert rows(q.duration_speed(frame(spark, trip())), "speed_mph") == [(None,)]


def test_airport_pickup_wins_over_dropoff(spark):
    df = frame(
        spark,
        dict(PULocationID=132, DOLocationID=138),
        dict(DOLocationID=158),
        dict(PULocationID=1),
    )
    got = dict(rows(b.airport_by_zone(df), "location_type", "trips"))
    assert got == {"Airport Pickup": 1, "Airport Dropoff": 1, "Non-Airport": 1}


def test_fee_cross_is_two_by_two(trips):
    assert len(rows(b.fee_cross(trips))) == 4


def test_top_routes_skip_round_trips(trips):
    got = rows(q.top_routes_by_revenue(trips), "PULocationID", "DOLocationID")
    assert len(got) == 10 and all(p != d for p, d in got)
    assert len(rows(b.top_zones(trips, n=30))) == 25


def test_quintiles_cover_every_row(trips):
    got = rows(q.revenue_quintiles(trips))
    sizes = [r[1] for r in got]
    assert [r[0] for r in got] == [1, 2, 3, 4, 5] and max(sizes) - min(sizes) <= 1
    assert sum(sizes) == trips.where("total_amount > 0").count()
    assert [r[2] for r in got] == sorted(r[2] for r in got)


def test_top_share_matches_threshold_by_hand(trips):
    paid = sorted((r[0] for r in trips.where("total_amount > 0").select("total_amount").collect()), reverse=True)
    n = len(paid)
    top = sum(1 for v in paid if sum(w > v for w in paid) / (n - 1) <= 0.05)
    assert dict(rows(q.top5pct_vs_rest(trips), "tier", "trips")) == {"Top 5%": top, "Rest": n - top}


def test_cumulative_revenue_ends_at_vendor_total(trips):
    last = {}
    for _, vendor, _, so_far in rows(q.cumulative_revenue(trips)):
        last[vendor] = so_far
    totals = {r[0]: r[2] for r in rows(q.vendor_performance(trips))}
    assert last == pytest.approx(totals)


def test_renamed_columns_give_equal_results(trips):
    normal = TripColumns(
        vendor="vendorid",
        pickup="pickup_datetime",
        dropoff="dropoff_datetime",
        rate_code="ratecodeid",
        pickup_zone="pulocationid",
        dropoff_zone="dolocationid",
    )
    renamed = normalize_columns(trips)
    assert rows(q.monthly_rolling(trips)) == rows(q.monthly_rolling(renamed, normal))
    assert rows(q.hourly_demand(trips)) == rows(q.hourly_demand(renamed, normal))
    assert rows(q.p90_distance(trips)) == rows(q.p90_distance(renamed, normal))


def test_empty_input(spark):
    none = spark.createDataFrame([], TRIP_SCHEMA)
    for operator in (q.daily_vendor_growth, q.p90_distance, q.revenue_quintiles, q.top5pct_vs_rest,
                     b.quintile_profile, b.top5pct_threshold, a.vendor_report):
        assert operator(none).count() == 0
    assert rows(a.range_count(none, "2024-01-01", "2024-01-02")) == [(0,)]
    assert rows(a.range_profile(none, "2024-01-01", "2024-01-02"), "trips", "median_fare") == [(0, None)]


def test_date_range_crosses_year_end_and_is_ordered(trips):
    got = a.date_range(trips, "2024-12-01", "2025-01-31", ["pickup_datetime", "fare_amount", "nothing"])
    assert got.columns == ["tpep_pickup_datetime", "fare_amount"]
    times = [r[0] for r in got.collect()]
    assert times == sorted(times)
    assert min(times) >= D(2024, 12, 1) and max(times) < D(2025, 2, 1)
    assert {t.year for t in times} == {2024, 2025}
    assert len(times) == trips.where(
        F.to_date("tpep_pickup_datetime").between("2024-12-01", "2025-01-31")
    ).count()
    assert len({t.date() for t in times}) >= 55


def test_date_range_without_columns_keeps_all(trips):
    assert a.date_range(trips, "2024-06-15", "2024-06-15").columns == trips.columns


def test_daily_summary_adapts_to_available_columns(trips):
    full = a.daily_summary(trips, "2024-06-30", 10)
    assert {"credit_card_trips", "cash_trips", "avg_passengers"} <= set(full.columns)
    bare = a.daily_summary(trips.drop("payment_type", "passenger_count"), "2024-06-30", 10)
    assert "cash_trips" not in bare.columns and "avg_passengers" not in bare.columns
    assert rows(full, "trip_date", "median_distance") == rows(bare, "trip_date", "median_distance")


def test_thirteen_months(trips):
    assert len(rows(a.range_monthly_counts(trips, "2024-01-01", "2025-01-31"))) == 13


def test_payment_filters(trips):
    assert {r[0] for r in rows(q.payment_tips(trips))} == {1, 2}
    assert {r[0] for r in rows(q.payment_tips(trips, payments=None))} == {0, 1, 2, 3}


def test_peek_and_stats(trips):
    assert len(rows(a.peek(trips, 7))) == 7
    stats = a.table_stats(trips).collect()
    assert len(stats) == 20 and {r["total_rows"] for r in stats} == {3000}
    assert stats[0]["column_name"] == "VendorID" and stats[0]["data_type"] == "bigint"


def test_deviation_is_exact_in_cents(spark):
    fares = [1000000.01, 1000000.01, 1000000.03, None]
    df = frame(spark, *[dict(RatecodeID=1.0, fare_amount=f) for f in fares], dict(RatecodeID=2.0, fare_amount=5.0))
    got = {r["RatecodeID"]: r for r in b.ratecode_median_stddev(df).collect()}
    assert (got[1.0]["trips"], got[1.0]["median_fare"], got[1.0]["fare_stddev"]) == (4, 1000000.01, 0.01)
    assert got[2.0]["fare_stddev"] is None and got[2.0]["trips"] == 1


def test_deviation_reads_the_source_once(spark, sf_dir):
    from fareloom.plans.bindings import lineitem_trips

    plan = b.ratecode_median_stddev(lineitem_trips(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan  # only the staged counts are left to read
