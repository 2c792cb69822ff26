"""Distributed ranks against the built-in windows and percentiles."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from fareloom.operators import ordering
from fareloom.operators.ordering import Carried, grouped_percentiles
from fareloom.operators.selection import (
    percentile_of,
    select_positions,
    tile_totals,
    top_share_bound,
)
from fareloom.staging import stage


def skewed(spark, n=4000, seed=1):
    """A third of the rows share one value; one group holds most rows; NULLs in both columns."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        value = 50.0 if i % 3 == 0 else round(rng.gauss(50, 20), 2)
        group = rng.choice(["hot"] * 8 + ["a", "b", None])
        rows.append((group, None if i % 97 == 0 else value, float(rng.randrange(5))))
    return spark.createDataFrame(rows, "g string, x double, y double").repartition(5)


def cents(name):
    return F.floor(F.col(name) * 100 + 0.5)


def sums():
    return {"x_u": cents("x"), "y_u": cents("y"), "n_x": F.col("x").isNotNull().cast("bigint")}


def tiles_of(df, order, tiles, **limit):
    return sorted(tuple(r) for r in tile_totals(df, order, tiles, sums(), **limit).collect())


def naive_tiles(df, tiles, *order):
    ranked = df.select("*", F.ntile(tiles).over(Window.orderBy(*order)).alias("t"))
    grouped = ranked.groupBy("t").agg(F.count(F.lit(1)), *[F.sum(e) for e in sums().values()])
    return sorted(tuple(r) for r in grouped.collect())


@pytest.mark.parametrize("tiles", [1, 2, 5, 7, 40])
def test_tiles_equal_ntile(spark, tiles):
    df = skewed(spark)
    want = naive_tiles(df, tiles, F.desc_nulls_last("x"), F.asc("y"))
    assert tiles_of(df, {"x": "desc", "y": "asc"}, tiles) == want


def test_tiles_when_edge_rows_need_slices(spark, many_slices):
    df = skewed(spark)
    want = naive_tiles(df, 7, F.desc_nulls_last("x"), F.asc("y"))
    assert tiles_of(df, {"x": "desc", "y": "asc"}, 7) == want


def test_tiles_with_fewer_rows_than_tiles(spark):
    df = spark.createDataFrame([(3.0, 0.0), (1.0, 0.0), (1.0, 0.0)], "x double, y double")
    got = tiles_of(df, {"x": "asc", "y": "asc"}, 5)
    assert got == naive_tiles(df, 5, "x", "y") and [r[0] for r in got] == [1, 2, 3]


def test_tiles_of_nothing(spark):
    assert tiles_of(skewed(spark).where("x > 1e9"), {"x": "asc"}, 5) == []


def test_selected_positions_equal_sorted_list(spark, many_slices):
    df = skewed(spark).where("x is not null")
    ordered = sorted((r["x"], -r["y"]) for r in df.select("x", "y").collect())
    spots = [0, 17, 1000, 2000, 2001, len(ordered) - 1]
    shares = [s / len(ordered) for s in spots]
    total, got = select_positions(df, {"x": "asc", "y": "desc"}, shares, lambda n: spots)
    assert total == len(ordered)
    assert [(s.position, s.sort_values) for s in got] == [(p, ordered[p]) for p in spots]


def test_positions_far_from_the_hint(spark):
    """A misleading sketch costs time, not exactness."""
    df = skewed(spark).where("x is not null")
    ordered = sorted(r["x"] for r in df.select("x").collect())
    _, got = select_positions(df, {"x": "asc"}, [0.0], lambda n: [n // 5, n - 2])
    assert [s.sort_values[0] for s in got] == [ordered[len(ordered) // 5], ordered[-2]]


@pytest.mark.parametrize("share", [0.0, 0.05, 0.31, 0.5, 1.0])
def test_top_share_equals_percent_rank(spark, share):
    df = skewed(spark).where("x is not null")
    ranked = df.select("x", F.percent_rank().over(Window.orderBy(F.desc("x"))).alias("p"))
    want = ranked.where(F.col("p") <= share).agg(F.min("x"), F.count("x")).first()
    bound = top_share_bound(df, "x", share)
    assert (bound, df.where(F.col("x") >= bound).count()) == tuple(want)


def test_top_share_of_one_row_and_of_nothing(spark):
    df = spark.createDataFrame([(4.0,)], "x double")
    assert top_share_bound(df, "x", 0.05) == 4.0
    assert top_share_bound(df.where("x > 5"), "x", 0.05) is None


@pytest.mark.parametrize("level", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_percentile_of_column_equals_builtin(spark, level):
    df = skewed(spark)
    assert percentile_of(df, "x", level) == pytest.approx(
        df.agg(F.percentile("x", level).alias("p")).first()["p"], rel=1e-12
    )
    assert percentile_of(df.where("x is null"), "x", level) is None


def test_percentiles_equal_builtin(spark, many_slices):
    df = skewed(spark)
    levels = {"p0": 0.0, "p37": 0.37, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    want = df.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("y").alias("s"),
        *[F.percentile("x", p).alias(n) for n, p in levels.items()],
    )
    got = grouped_percentiles(df, ["g"], "x", levels, Carried({"s": F.col("y")}))
    by_group = {r["g"]: r for r in got.collect()}
    expected = want.collect()
    assert len(by_group) == len(expected) == 4
    for row in expected:
        mine = by_group[row["g"]]
        assert mine["group_rows"] == row["n"] and mine["s"] == row["s"]
        for name in levels:
            assert mine[name] == pytest.approx(row[name], rel=1e-12)


def test_percentiles_of_whole_table_and_all_null_group(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0), ("b", 2.0)], "g string, x double")
    got = {r["g"]: (r["group_rows"], r["m"]) for r in grouped_percentiles(df, ["g"], "x", {"m": 0.5}).collect()}
    assert got == {"a": (2, None), "b": (2, 1.5)}
    whole = grouped_percentiles(df, [], "x", {"m": 0.5}).collect()
    assert [(r["group_rows"], r["m"]) for r in whole] == [(4, 1.5)]


def lopsided(spark, n=30_000):
    """One group of nine tenths of the rows; half of all rows share one value."""
    rng = random.Random(7)
    rows = [
        ("big" if rng.random() < 0.9 else rng.choice("abc"), 12.5 if i % 2 else round(rng.gauss(0, 9), 1)) for i in range(n)
    ]
    return spark.createDataFrame(rows, "g string, x double").repartition(6)


@pytest.mark.parametrize("cell_rows, parts", [(1_000_000, 1024), (1, 3)])
def test_percentiles_of_lopsided_groups(spark, monkeypatch, cell_rows, parts):
    """Also when cells are cut again and again."""
    monkeypatch.setattr(ordering, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(ordering, "PARTS", parts)
    df = lopsided(spark)
    levels = {"p10": 0.1, "p50": 0.5, "p51": 0.51, "p99": 0.99}
    want = {r["g"]: r for r in df.groupBy("g").agg(*[F.percentile("x", p).alias(n) for n, p in levels.items()]).collect()}
    got = grouped_percentiles(df, ["g"], "x", levels).collect()
    assert len(got) == len(want) == 4
    for row in got:
        for name in levels:
            assert row[name] == pytest.approx(want[row["g"]][name], rel=1e-12)


def test_percentiles_of_extreme_values(spark):
    values = [float("-inf"), -1e300, -2.5, -1e-9, 0.0, 1e-9, 2e-9, 3.0, 1e300, float("inf")]
    df = spark.createDataFrame([("g", v) for v in values] + [("n", float("nan")), ("n", 1.0)], "g string, x double")
    levels = {f"p{i}": i / 9 for i in range(10)}
    got = {r["g"]: r for r in grouped_percentiles(df, ["g"], "x", levels).collect()}
    assert [got["g"][f"p{i}"] for i in (1, 2, 3, 4, 5, 6, 7, 8)] == pytest.approx(values[1:-1])
    assert got["n"]["p0"] == 1.0


def shuffled_rows(spark, run):
    """Records written to shuffles by what ``run`` executes, from the status store of the application."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        none = spark._jvm.java.util.ArrayList()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return {(found.apply(i).stageId(), found.apply(i).attemptId()): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    run()
    return sum(n for key, n in stages().items() if key not in before)


def test_percentiles_shuffle_few_rows(spark):
    """No exchange carries the (group, value) pairs of the table: all of them together stay below 5 % of its rows."""
    n = 600_000
    df = spark.range(0, n, 1, 4).select((F.col("id") % 5).alias("g"), (F.rand(3) * 1000).alias("x"))
    df = stage(df, "test-percentiles")
    moved = shuffled_rows(spark, lambda: grouped_percentiles(df, ["g"], "x", {"m": 0.5}).collect())
    assert 0 < moved < n * 0.05


def test_percentile_level_is_checked(spark):
    with pytest.raises(ValueError):
        grouped_percentiles(skewed(spark), [], "x", {"m": 1.5})


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.sampled_from([0.0, 1.5, 2.0, 7.25, -3.0]), min_size=1, max_size=40),
    st.integers(1, 9),
)
def test_any_small_input(spark, values, tiles):
    df = spark.createDataFrame([(v, 0.0) for v in values], "x double, y double")
    assert tiles_of(df, {"x": "asc"}, tiles) == naive_tiles(df, tiles, "x")


@pytest.mark.parametrize("kind", ["bigint", "decimal(12,2)", "decimal(24,2)"])
def test_exact_order_columns(spark, kind):
    df = skewed(spark).select(F.floor("x").cast(kind).alias("x"))
    assert percentile_of(df, "x", 0.9) == pytest.approx(
        df.agg(F.percentile(F.col("x").cast("double"), 0.9).alias("p")).first()["p"], rel=1e-12
    )
    doubles = df.select(F.col("x").cast("double"))
    assert top_share_bound(df.where("x is not null"), "x", 0.05) == top_share_bound(
        doubles.where("x is not null"), "x", 0.05
    )


@pytest.mark.parametrize("value, kind", [(2**53 + 1, "bigint"), ("12345678901234567.25", "decimal(24,2)")])
def test_order_value_that_no_double_holds_raises(spark, value, kind):
    df = spark.createDataFrame([(str(value),), ("1",)], "x string").select(F.col("x").cast(kind))
    with pytest.raises(Exception, match="order by x"):
        percentile_of(df, "x", 0.5)


def test_order_by_text_raises(spark):
    with pytest.raises(TypeError):
        percentile_of(spark.createDataFrame([("a",)], "x string"), "x", 0.5)
