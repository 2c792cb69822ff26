"""Files with drifting schemas, load modes, manifest, repeatable loads."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.columns import TRIP_SCHEMA
from fareloom.sinks.writers import write_csv, write_hive_partitioned, write_parquet, write_table
from fareloom.sources import files, ingest, layout
from fareloom.sources.names import find_column, normal_name, normalize_columns
from fareloom.sources.schema import align_schema, default_fill, schema_gap
from trips import D, frame, synthetic, trip

PICKUP = "tpep_pickup_datetime"
SMALL = T.StructType(
    [
        T.StructField("VendorID", T.LongType()),
        T.StructField(PICKUP, T.TimestampNTZType()),
        T.StructField("passenger_count", T.DoubleType()),
        T.StructField("total_amount", T.DoubleType()),
        T.StructField("airport_fee", T.DoubleType()),
        T.StructField("cbd_congestion_fee", T.DoubleType()),
    ]
)


def write_one(df, path: Path):
    """One Parquet file with a name of its own."""
    path.parent.mkdir(parents=True, exist_ok=True)
    scratch = path.parent / f"_{path.stem}"
    df.coalesce(1).write.parquet(str(scratch))
    (part,) = scratch.glob("part-*.parquet")
    path.write_bytes(part.read_bytes())


def month_file(spark, root: Path, year: int, month: int, n: int = 3, stray: bool = False):
    """A yearly schema generation: types and the case of the fee column drift."""
    rows = [(v, D(year, month, 1 + v), float(v), 10.0 * v) for v in range(1, n + 1)]
    if stray:
        rows.append((9, D(2009, 1, 1), 1.0, 5.0))
    df = spark.createDataFrame(
        rows, f"VendorID bigint, {PICKUP} timestamp_ntz, passenger_count double, total_amount double"
    )
    if year == 2023:
        df = df.selectExpr(
            "cast(VendorID as int) VendorID", PICKUP, "cast(passenger_count as bigint) passenger_count",
            "total_amount", "1.25D as Airport_fee",
        )
    else:
        df = df.selectExpr("*", "cast(null as double) as airport_fee", "'z' as surplus")
    if year >= 2025:
        df = df.withColumn("cbd_congestion_fee", F.lit(0.75))
    write_one(df, root / str(year) / f"yellow_tripdata_{year}-{month:02d}.parquet")


@pytest.fixture
def landing(spark, tmp_path):
    root = tmp_path / "trip files 2023 to 2025"  # blanks in the path on purpose
    for year in (2023, 2024, 2025):
        month_file(spark, root, year, 1)
    return root


def test_drifting_files_become_one_frame(spark, landing):
    df = files.scan_folder(spark, str(landing), SMALL)
    assert df.columns == [*SMALL.names, "source_file"]
    assert [f.dataType for f in df.schema.fields[:-1]] == [f.dataType for f in SMALL.fields]
    assert df.count() == 9
    by_year = {
        r["y"]: (r["fees"], r["cbd"])
        for r in df.groupBy(F.year(PICKUP).alias("y"))
        .agg(F.count("airport_fee").alias("fees"), F.count("cbd_congestion_fee").alias("cbd"))
        .collect()
    }
    assert by_year == {2023: (3, 0), 2024: (0, 0), 2025: (0, 3)}


def test_union_without_target_keeps_every_column(spark, landing):
    columns = set(files.scan_folder(spark, str(landing)).columns)
    assert {"airport_fee", "cbd_congestion_fee", "surplus", "source_file"} <= columns


def test_source_file_matches_listing(spark, landing):
    listed = {r["source_file"] for r in files.list_files(spark, str(landing)).collect()}
    read = {r[0] for r in files.scan_folder(spark, str(landing), SMALL).select("source_file").distinct().collect()}
    assert listed == read and len(read) == 3


def test_missing_or_foreign_folder_is_empty(spark, tmp_path):
    assert files.list_files(spark, str(tmp_path / "nowhere")).count() == 0
    (tmp_path / "README.txt").write_text("x")
    (tmp_path / "data.csv").write_text("a,b\n1,2\n")
    assert files.list_files(spark, str(tmp_path)).count() == 0
    assert files.scan_folder(spark, str(tmp_path), SMALL).count() == 0


def test_manifest_from_footers(spark, landing):
    rows = {
        r["file_name"]: r
        for r in ingest.manifest_rows(
            files.read_footers(files.list_files(spark, str(landing)))
        ).collect()
    }
    row = rows["yellow_tripdata_2024-01.parquet"]
    assert row["date"] == dt.date(2024, 1, 1)
    assert (row["rows"], row["null_count"], row["status"]) == (3, 3, "success")
    assert 0 < row["compression_ratio"] < 2


@pytest.mark.parametrize(
    "name, want",
    [
        ("yellow_tripdata_2023-01.parquet", dt.date(2023, 1, 1)),
        ("yellow_tripdata_2024-12.parquet", dt.date(2024, 12, 1)),
        ("some_file.parquet", None),
        ("yellow_tripdata_2024-77.parquet", None),
    ],
)
def test_month_in_file_name(spark, name, want):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(files.file_month("n").alias("d")).first()["d"] == want


def test_batch_import_isolates_bad_files(spark, landing, tmp_path):
    (landing / "2024" / "yellow_tripdata_2024-02.parquet").write_bytes(b"not parquet")
    place = (str(tmp_path / "table"), str(tmp_path / "manifest"))
    with pytest.raises(ValueError, match="2024-02"):
        ingest.batch_import(spark, str(landing), *place, SMALL)
    assert not Path(place[0]).exists()
    log = ingest.batch_import(spark, str(landing), *place, SMALL, skip_errors=True)
    totals = {r["status"]: (r["files"], r["rows"]) for r in ingest.manifest_totals(log).collect()}
    assert totals == {"success": (3, 9), "failed": (1, 0)}
    assert spark.read.parquet(place[0]).count() == 9
    assert log.where("status = 'failed'").first()["error"]


def test_dry_run_writes_nothing(spark, landing, tmp_path):
    place = (str(tmp_path / "table"), str(tmp_path / "manifest"))
    log = ingest.batch_import(spark, str(landing), *place, SMALL, dry_run=True)
    assert {r["status"] for r in log.collect()} == {"pending"}
    assert not Path(place[0]).exists() and not Path(place[1]).exists()


def test_files_without_date_can_be_skipped(spark, landing, tmp_path):
    write_one(spark.range(2).selectExpr("id as VendorID"), landing / "2024" / "some_file.parquet")
    place = (str(tmp_path / "table"), str(tmp_path / "manifest"))
    log = ingest.batch_import(spark, str(landing), *place, SMALL, require_date=True)
    assert {r["file_name"] for r in log.where("status = 'skipped'").collect()} == {"some_file.parquet"}
    assert spark.read.parquet(place[0]).count() == 9


def test_incremental_load_takes_each_file_once(spark, landing, tmp_path):
    place = (str(tmp_path / "table"), str(tmp_path / "manifest"))
    first = ingest.incremental_load(spark, str(landing), *place, target=SMALL)
    assert first.count() == 3
    assert ingest.incremental_load(spark, str(landing), *place, target=SMALL).count() == 0
    month_file(spark, landing, 2025, 2)
    third = ingest.incremental_load(spark, str(landing), *place, target=SMALL)
    assert [r["file_name"] for r in third.collect()] == ["yellow_tripdata_2025-02.parquet"]
    assert spark.read.parquet(place[0]).count() == 12
    manifest = ingest.read_manifest(spark, place[1])
    assert manifest.count() == 4


def table_rows(spark, table):
    return sorted(
        (r["y"], r["m"], r["n"])
        for r in spark.read.parquet(table)
        .groupBy(F.col("year").alias("y"), F.col("month").alias("m"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )


def test_reload_is_idempotent_and_keeps_other_files(spark, landing, tmp_path):
    # This file holds a trip of 2009, and 2024-01 gets rows of two files.
    month_file(spark, landing, 2024, 2, stray=True)
    extra = landing / "2024" / "yellow_tripdata_2024-03.parquet"
    df = spark.createDataFrame([(5, D(2024, 1, 31), 1.0, 1.0)], f"VendorID bigint, {PICKUP} timestamp_ntz, passenger_count double, total_amount double")
    write_one(df, extra)
    table = str(tmp_path / "table")
    everything = files.scan_folder(spark, str(landing), SMALL)
    ingest.reload_sources(everything, table, PICKUP)
    once = table_rows(spark, table)
    assert (2009, 1, 1) in once and (2024, 1, 4) in once and sum(r[2] for r in once) == 14
    ingest.reload_sources(everything, table, PICKUP)
    assert table_rows(spark, table) == once
    only = everything.where(F.col("source_file").contains("2024-03"))
    ingest.reload_sources(only, table, PICKUP)
    assert table_rows(spark, table) == once


def test_reload_removes_a_month_that_became_empty(spark, landing, tmp_path):
    table = str(tmp_path / "table")
    month_file(spark, landing, 2024, 2, stray=True)
    ingest.reload_sources(files.scan_folder(spark, str(landing), SMALL), table, PICKUP)
    assert (2009, 1, 1) in table_rows(spark, table)
    corrected = files.scan_folder(spark, str(landing), SMALL).where(
        F.col("source_file").contains("2024-02") & (F.year(PICKUP) == 2024)
    )
    ingest.reload_sources(corrected, table, PICKUP)
    assert 2009 not in {r[0] for r in table_rows(spark, table)}
    assert sum(r[2] for r in table_rows(spark, table)) == 12


def test_reload_keeps_rows_without_pickup(spark, tmp_path):
    table = str(tmp_path / "table")
    df = frame(spark, trip(), dict(tpep_pickup_datetime=None)).withColumn("source_file", F.lit("f"))
    for _ in range(2):
        ingest.reload_sources(df, table, PICKUP)
    assert spark.read.parquet(table).count() == 2


def test_stage_and_publish(spark, landing, tmp_path):
    staging, table = str(tmp_path / "staging"), str(tmp_path / "table")
    everything = files.scan_folder(spark, str(landing), SMALL)
    old = everything.where(F.year(PICKUP) < 2025)
    new = everything.where(F.year(PICKUP) > 2023).withColumn("total_amount", F.lit(1.0))
    ingest.stage_run(old, staging, "r1", "a")
    ingest.stage_run(new, staging, "r2", "b")
    for _ in range(2):  # publishing again changes nothing
        ingest.publish_runs(spark, staging, table, PICKUP, required=[PICKUP])
        got = spark.read.parquet(table)
        assert got.count() == 9
        writers = {(r["year"], r["writer_id"]) for r in got.select("year", "writer_id").distinct().collect()}
        assert writers == {(2023, "a"), (2024, "b"), (2025, "b")}


def test_publish_stops_on_broken_staging(spark, tmp_path):
    staging, table = str(tmp_path / "staging"), str(tmp_path / "table")
    df = frame(spark, trip(), dict(tpep_pickup_datetime=None)).withColumn("source_file", F.lit("f"))
    ingest.stage_run(df, staging, "r1", "a")
    with pytest.raises(ValueError, match="r1"):
        ingest.publish_runs(spark, staging, table, PICKUP, required=[PICKUP])
    assert not Path(table).exists()


@pytest.mark.parametrize("codec", ["snappy", "gzip", "uncompressed"])
def test_parquet_codecs(spark, tmp_path, codec):
    import pyarrow.parquet as pq

    path = tmp_path / codec
    write_parquet(frame(spark, trip()).coalesce(1), str(path), codec)
    (part,) = path.glob("*.parquet")
    assert pq.ParquetFile(part).metadata.row_group(0).column(0).compression == codec.upper()
    with pytest.raises(ValueError):
        write_parquet(frame(spark, trip()), str(path), "lz77")


def test_load_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 2023, 1.5)], "id int, year int, value double")
    write_table(df, path, "append")
    write_table(df.selectExpr("value", "id", "'x' as more"), path, "append")
    got = spark.read.parquet(path)
    assert got.columns == ["id", "year", "value"] and got.where("year is null").count() == 1
    write_table(df, path, "create")
    assert spark.read.parquet(path).count() == 2
    write_table(df, path, "replace")
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(ValueError):
        write_table(df, path, "upsert")


def test_csv_round_trip(spark, tmp_path):
    df = frame(
        spark,
        dict(tpep_pickup_datetime=D(2024, 1, 1, 10, 0, 0, 123456), passenger_count=None),
        dict(store_and_fwd_flag=None, VendorID=2),
    ).drop("cbd_congestion_fee", "airport_fee")
    path = str(tmp_path / "csv")
    write_csv(df, path)
    got = files.scan_csv(spark, path, TRIP_SCHEMA).orderBy("VendorID").collect()
    assert got[0][PICKUP] == D(2024, 1, 1, 10, 0, 0, 123456)
    assert got[0]["passenger_count"] is None and got[0]["cbd_congestion_fee"] == 0.0
    assert got[1]["store_and_fwd_flag"] == "N"


def test_csv_with_decimal_integers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("VendorID,total_amount\n1.0,2.5\n,3\n")
    got = files.scan_csv(spark, str(tmp_path / "x.csv"), SMALL).select("VendorID", "total_amount").collect()
    assert [tuple(r) for r in got] == [(1, 2.5), (None, 3.0)]


def test_partitions_follow_pickup_time(spark, tmp_path):
    df = synthetic(spark, 600)
    root = tmp_path / "hive"
    write_hive_partitioned(df, str(root), PICKUP, sort=["VendorID"])
    assert (root / "year=2024" / "month=3").is_dir() and (root / "year=2025" / "month=1").is_dir()
    copy = files.scan_hive(spark, str(root))
    assert copy.count() == 600
    assert copy.where((F.year(PICKUP) != F.col("year")) | (F.month(PICKUP) != F.col("month"))).count() == 0
    march = df.where(F.date_format(PICKUP, "yyyy-MM") == "2024-03")
    write_hive_partitioned(march.limit(1), str(root), PICKUP)
    assert files.scan_hive(spark, str(root)).where("year = 2024 and month = 3").count() == 1
    assert files.scan_hive(spark, str(root)).where("year = 2024 and month = 4").count() > 1


def test_partition_profile(spark, landing, tmp_path):
    copy = str(tmp_path / "copy")
    files.scan_folder(spark, str(landing), SMALL).write.parquet(copy)
    got = layout.partition_profile(spark.read.parquet(copy), PICKUP).collect()
    assert [(r["year"], r["month"], r["rows"], r["strategy"]) for r in got] == [
        (y, 1, 3, "yearly") for y in (2023, 2024, 2025)
    ]
    assert all(r["files"] >= 1 and r["bytes"] > 0 for r in got)


@pytest.mark.parametrize(
    "name, want",
    [
        ("tpep_pickup_datetime", "pickup_datetime"),
        ("TPEP_DROPOFF_DATETIME", "dropoff_datetime"),
        ("VendorID", "vendorid"),
        ("PULocationID", "pulocationid"),
        ("Airport_fee", "airport_fee"),
        ("paymenttype", "payment_type"),
        ("Some Other Column", "some_other_column"),
    ],
)
def test_normal_names(name, want):
    assert normal_name(name) == want


def test_normalize_rejects_collisions(spark):
    df = spark.createDataFrame([(1, 2)], "tpep_pickup_datetime int, pickup_datetime int")
    with pytest.raises(ValueError, match="collide"):
        normalize_columns(df)
    assert not any("tpep_" in c for c in normalize_columns(frame(spark, trip())).columns)


def test_find_column():
    columns = ["VendorID", "tpep_pickup_datetime", "trip_distance", "Fare_Amount"]
    assert find_column("trip_distance", columns) == "trip_distance"
    assert find_column("pickup_datetime", columns) == "tpep_pickup_datetime"
    assert find_column("distance", columns) == "trip_distance"
    assert find_column("fare_amount", columns) == "Fare_Amount"
    assert find_column("nothing", columns) is None


def test_align_schema(spark):
    df = spark.createDataFrame([(1, "x", 2)], "vendorid int, more string, passenger_count bigint")
    assert schema_gap(df.columns, SMALL) == (
        [PICKUP, "total_amount", "airport_fee", "cbd_congestion_fee"], ["more"]
    )
    got = align_schema(df, SMALL)
    assert [(f.name, f.dataType) for f in got.schema.fields] == [(f.name, f.dataType) for f in SMALL.fields]
    assert tuple(got.first()) == (1, None, 2.0, None, None, None)
    with pytest.raises(ValueError):
        align_schema(df.withColumnRenamed("more", "VENDORID"), SMALL)


def test_default_fill_keeps_nulls_of_present_fees(spark):
    df = frame(spark, dict(store_and_fwd_flag=None, airport_fee=None)).drop("cbd_congestion_fee")
    row = default_fill(df).first()
    assert (row["store_and_fwd_flag"], row["airport_fee"], row["cbd_congestion_fee"]) == ("N", None, 0.0)


@pytest.mark.parametrize("n", [0, 1000])
def test_import_types_and_repeats(spark, tmp_path, n):
    source = "id bigint, value double, category string, date timestamp_ntz"
    start = D(2024, 1, 1)
    rows = [(i, i * 1.5, "ABC"[i % 3], start + dt.timedelta(days=i)) for i in range(n)]
    write_one(spark.createDataFrame(rows, source), tmp_path / "in" / "data_2024-01.parquet")
    target = T.StructType(
        [
            T.StructField("id", T.IntegerType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("category", T.StringType()),
            T.StructField("date", T.DateType()),
        ]
    )
    place = (str(tmp_path / "table"), str(tmp_path / "manifest"))
    for _ in range(2):
        ingest.batch_import(spark, str(tmp_path / "in"), *place, target)
    got = spark.read.parquet(place[0])
    assert got.count() == 2 * n
    assert got.select("category").distinct().count() == (3 if n else 0)
    assert [f.dataType for f in got.schema.fields[:4]] == [f.dataType for f in target.fields]
    table = str(tmp_path / "once")
    for _ in range(2):
        ingest.reload_sources(files.scan_folder(spark, str(tmp_path / "in"), target), table, "date")
    assert (spark.read.parquet(table).count() if n else 0) == n
