"""Number, time and bin expressions: the cases where engines disagree."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fareloom.functions import bins
from fareloom.functions.numbers import fixed, mean_of, nearest, over, percent, round2, total_of
from fareloom.functions.times import (
    boundaries_crossed,
    elapsed,
    hour_of,
    month_of,
    weekday_sun0,
    within_days,
)

D = dt.datetime


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(
        f"{n} {'timestamp_ntz' if isinstance(v, D) else 'double'}" for n, v in inputs.items()
    ))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "start, end, minutes, hours",
    [
        (D(2024, 1, 1, 10, 59), D(2024, 1, 1, 11, 1), 2, 1),
        (D(2024, 1, 1, 10, 0, 59), D(2024, 1, 1, 10, 1, 0), 1, 0),
        (D(2024, 1, 1, 10, 0, 0), D(2024, 1, 1, 10, 0, 59, 999999), 0, 0),
        (D(2024, 1, 1, 11, 1), D(2024, 1, 1, 10, 59), -2, -1),
        (D(2023, 12, 31, 23, 59, 59), D(2024, 1, 1), 1, 1),
        (D(1969, 12, 31, 23, 59, 59), D(1970, 1, 1, 0, 0, 1), 1, 1),
    ],
)
def test_boundaries_crossed(spark, start, end, minutes, hours):
    assert value(spark, boundaries_crossed("minute", "a", "b"), a=start, b=end) == minutes
    assert value(spark, boundaries_crossed("hour", "a", "b"), a=start, b=end) == hours


def test_elapsed_is_fractional(spark):
    got = value(spark, elapsed("hour", "a", "b"), a=D(2024, 1, 1, 10), b=D(2024, 1, 1, 11, 30))
    assert got == 1.5


def test_calendar_parts_ignore_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        late = D(2024, 3, 31, 23, 30)  # a Sunday
        assert value(spark, month_of("a"), a=late) == D(2024, 3, 1)
        assert value(spark, hour_of("a"), a=late) == 23
        assert value(spark, weekday_sun0("a"), a=late) == 0
        assert value(spark, weekday_sun0("a"), a=D(2024, 3, 30)) == 6
        # 02:30 on this day does not exist in New York.
        assert value(spark, hour_of("a"), a=D(2024, 3, 10, 2, 30)) == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_day_range_includes_last_day(spark):
    inside = within_days("a", "2024-02-28", "2024-02-29")
    assert value(spark, inside, a=D(2024, 2, 29, 23, 59, 59, 999999)) is True
    assert value(spark, inside, a=D(2024, 3, 1)) is False
    assert value(spark, inside, a=D(2024, 2, 27, 23, 59, 59)) is False


def test_sums_do_not_depend_on_order(spark):
    rng = random.Random(7)
    amounts = [round(rng.uniform(-100, 1e5), 2) for _ in range(5000)]
    totals = set()
    for partitions in (1, 3, 8):
        rng.shuffle(amounts)
        df = spark.createDataFrame([(a,) for a in amounts], "x double").repartition(partitions)
        totals.add(df.agg(total_of("x").alias("t")).first()["t"])
    assert totals == {round(sum(round(a * 100) for a in amounts) / 100, 2)}


def test_mean_skips_nulls_and_empty_input(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,)], "x double")
    assert df.agg(mean_of("x").alias("m")).first()["m"] == 1.5
    assert df.where("x is null").agg(mean_of("x").alias("m")).first()["m"] is None


def test_cents(spark):
    for amount, cents in ((0.29, 29), (-0.29, -29), (33.33, 3333), (0.0, 0), (1e9 + 0.01, 10**11 + 1)):
        assert value(spark, fixed("x"), x=amount) == cents
    assert value(spark, nearest(F.col("x")), x=1.005) in (100, 101)


def test_zero_denominator_gives_null(spark):
    assert value(spark, over(F.col("x"), F.lit(0.0)), x=1.0) is None
    assert value(spark, percent(F.col("x"), F.lit(4.0)), x=1.0) == 25.0


def test_round2_is_half_up_on_decimals(spark):
    for x, want in ((1.005, 1.01), (-1.005, -1.01), (2.344999, 2.34), (0.125, 0.13)):
        assert value(spark, round2(F.col("x")), x=x) == want


def test_bins(spark):
    label = bins.below(F.col("x"), (10, 20), ("a", "b", "c"))
    assert [value(spark, label, x=v) for v in (9.99, 10.0, 19.99, 20.0)] == ["a", "b", "b", "c"]
    label = bins.up_to(F.col("x"), (1, 3), ("a", "b", "c"))
    assert [value(spark, label, x=v) for v in (1.0, 1.01, 3.0, 3.01)] == ["a", "b", "b", "c"]
    with pytest.raises(ValueError):
        bins.below(F.col("x"), (10,), ("a",))
    with pytest.raises(ValueError):
        bins.below(F.col("x"), (20, 10), ("a", "b", "c"))
