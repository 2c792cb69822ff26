"""Whole-table window functions against the built-in ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fareloom.operators.row_ranks import with_row_ranks


def naive(df, order, tie_break, neighbours, tiles):
    by = [F.desc_nulls_last(n) if d == "desc" else F.asc_nulls_last(n) for n, d in order.items()]
    within, peers = Window.orderBy(*by, *[F.asc_nulls_last(n) for n in tie_break]), Window.orderBy(*by)
    added = {
        "row_number": F.row_number().over(within),
        "rank": F.rank().over(peers),
        "dense_rank": F.dense_rank().over(peers),
        "percent_rank": F.percent_rank().over(peers),
    }
    for n in neighbours:
        added |= {f"lag_{n}": F.lag(n).over(within), f"lead_{n}": F.lead(n).over(within)}
    return df.select("*", *[c.alias(n) for n, c in added.items()], *[F.ntile(t).over(within).alias(f"ntile_{t}") for t in tiles])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_equal_to_the_builtin_windows(spark, many_slices, direction):
    """Half of the rows share one key, which therefore reaches over several slices; NULLs and ties on top."""
    rng = random.Random(3)
    rows = [(i, 5.0 if i % 2 else rng.choice([None, 1.0, 2.0, 7.5, float(i)]), rng.choice([None, "a", "b"])) for i in range(700)]
    df = spark.createDataFrame(rows, "id bigint, x double, s string").repartition(4)
    for order in ({"x": direction}, {"x": direction, "s": "asc"}):
        want = (["id"], ["id", "s"], [1, 7, 1000])
        assert rows_of(with_row_ranks(df, order, *want)) == rows_of(naive(df, order, *want))


def test_one_key_and_few_rows(spark, many_slices):
    one = spark.createDataFrame([(i, 1.0) for i in range(50)], "id bigint, x double").repartition(3)
    assert rows_of(with_row_ranks(one, {"x": "asc"}, ["id"])) == rows_of(naive(one, {"x": "asc"}, ["id"], [], []))
    nulls = one.select("id", F.lit(None).cast("double").alias("x"))
    assert rows_of(with_row_ranks(nulls, {"x": "asc"}, ["id"])) == rows_of(naive(nulls, {"x": "asc"}, ["id"], [], []))
    single = one.limit(1)
    assert rows_of(with_row_ranks(single, {"x": "asc"}, ["id"], ["x"], [3])) == rows_of(naive(single, {"x": "asc"}, ["id"], ["x"], [3]))
    assert with_row_ranks(one.where("id < 0"), {"x": "asc"}).count() == 0


def test_helper_names_are_refused(spark):
    with pytest.raises(ValueError):
        with_row_ranks(spark.range(1).withColumn("local", F.lit(1)), {"id": "asc"})
