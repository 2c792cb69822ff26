"""Inputs that drift and runs that die: loud failure, nothing lost, nothing doubled."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.functions.numbers import mean_of, total_of
from fareloom.operators import analytics as a
from fareloom.sources import files, ingest
from fareloom.streaming import streams

SMALL = T.StructType(
    [
        T.StructField("VendorID", T.LongType()),
        T.StructField("trip_distance", T.DoubleType()),
        T.StructField("total_amount", T.DoubleType()),
    ]
)


@pytest.mark.parametrize("bad", [0.004, float("nan"), float("inf")])
def test_sums_never_cut(spark, bad):
    df = spark.createDataFrame([(1.25,), (bad,), (None,)], "x double")
    with pytest.raises(Exception, match="whole number"):
        df.agg(total_of("x").alias("s")).collect()


def test_sums_with_more_decimals(spark):
    df = spark.createDataFrame([(0.004,)] * 1000 + [(None,)], "x double")
    row = df.agg(total_of("x", 3).alias("s"), mean_of("x", 3).alias("m")).first()
    assert (row.s, row.m) == (4.0, 0.004)


def test_damaged_file_is_loud(spark, tmp_path):
    spark.createDataFrame([(1, 2.0, 3.0)], SMALL).coalesce(1).write.parquet(str(tmp_path / "in"))
    (tmp_path / "in" / "bad.parquet").write_bytes(b"no parquet")
    with pytest.raises(ValueError, match="bad.parquet"):
        files.scan_folder(spark, str(tmp_path / "in"), SMALL)
    footers = files.read_footers(files.list_files(spark, str(tmp_path / "in")))
    assert files.read_drifting(footers, SMALL, skip_unreadable=True).count() == 1


def test_csv_binds_by_name_in_every_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("VendorID,trip_distance,total_amount\n1,2.5,10.5\n")
    (tmp_path / "b.csv").write_text("trip_distance,VendorID,total_amount\n7.0,2,20.5\n")
    (tmp_path / "c.csv").write_text("trip_distance,VendorID\n9.0,3\n")
    got = sorted(tuple(r) for r in files.scan_csv(spark, str(tmp_path), SMALL).collect())
    assert got == [(1, 2.5, 10.5), (2, 7.0, 20.5), (3, 9.0, None)]


def test_declared_partitions_only(spark):
    """A table whose folders are named after files keeps the rows that strayed."""
    rows = [(dt.datetime(2024, 1, 31, 23), 2024, 1), (dt.datetime(2024, 1, 31, 23), 2024, 2)]
    df = spark.createDataFrame(rows, "tpep_pickup_datetime timestamp_ntz, year int, month int")
    assert a.range_count(df, "2024-01-01", "2024-01-31").first()["trips"] == 2


def test_reload_keeps_columns_of_other_files(spark, tmp_path):
    table = str(tmp_path / "t")

    def load(name, day, **extra):
        row = {"source_file": name, "at": dt.datetime(2024, *day), "x": 1.0, **extra}
        kinds = "source_file string, at timestamp_ntz, x double" + ", fee double" * ("fee" in extra)
        ingest.reload_sources(spark.createDataFrame([tuple(row.values())], kinds), table, "at")

    load("jan", (1, 5))
    load("feb", (2, 5), fee=7.0)
    load("feb-2", (2, 6))
    back = spark.read.option("mergeSchema", "true").parquet(table)
    assert {(r.source_file, r.fee) for r in back.collect()} == {("jan", None), ("feb", 7.0), ("feb-2", None)}


def test_publish_keeps_columns_of_some_runs(spark, tmp_path):
    staging, table = str(tmp_path / "s"), str(tmp_path / "t")
    at = dt.datetime(2024, 1, 5)
    one = spark.createDataFrame([("a", at)], "source_file string, at timestamp_ntz")
    two = spark.createDataFrame([("b", at, 7.0)], "source_file string, at timestamp_ntz, fee double")
    ingest.stage_run(one, staging, "r1", "w1")
    ingest.stage_run(two, staging, "r2", "w2")
    ingest.publish_runs(spark, staging, table, "at")
    back = spark.read.option("mergeSchema", "true").parquet(table)
    assert {(r.source_file, r.fee) for r in back.collect()} == {("a", None), ("b", 7.0)}


def test_load_again_after_lost_manifest(spark, tmp_path):
    root, table, manifest = (str(tmp_path / n) for n in ("in", "t", "m"))
    spark.createDataFrame([(1, 2.0, 3.0)], SMALL).coalesce(1).write.parquet(root)
    ingest.incremental_load(spark, root, table, manifest, target=SMALL)
    ingest.incremental_load(spark, root, table, str(tmp_path / "m2"), target=SMALL)  # as if no entry had been written
    assert spark.read.parquet(table).count() == 1
    assert spark.read.parquet(str(tmp_path / "m2")).count() == 1


def test_daily_stream_has_open_days(spark, tmp_path):
    root, table, checkpoint = (str(tmp_path / n) for n in ("in", "t", "c"))
    kinds = "tpep_pickup_datetime timestamp_ntz, total_amount double"

    def arrive(*rows):
        df = spark.createDataFrame(list(rows), kinds)
        df.write.mode("append").parquet(root)
        stream = streams.daily_totals(streams.file_stream(spark, root, df.schema), "3 days")
        streams.publish_daily(stream, table, checkpoint)

    arrive((dt.datetime(2024, 1, 1, 5), 10.0), (dt.datetime(2024, 1, 2, 5), 20.0))
    arrive((dt.datetime(2024, 1, 2, 6), 1.5))
    got = {str(r.day): (r.trips, r.revenue) for r in spark.read.parquet(table).collect()}
    assert got == {"2024-01-01": (1, 10.0), "2024-01-02": (2, 21.5)}
