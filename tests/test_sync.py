"""A table follows its folder: files added, rewritten in place, emptied, broken and removed."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fareloom.plans.ingest_queries import _rewrite_in_place
from fareloom.sources import sync

SCHEMA = "t timestamp_ntz, v bigint"


@pytest.fixture
def folder(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()

    def put(name, rows):
        df = spark.createDataFrame(rows, "t string, v bigint").select(F.col("t").cast("timestamp_ntz").alias("t"), "v")
        _rewrite_in_place(spark, f"{root}/{name}.parquet", df)

    return root, put


def test_table_follows_the_folder(spark, folder, tmp_path):
    root, put = folder
    table, log = f"{tmp_path}/table", f"{tmp_path}/log"
    schema = spark.createDataFrame([], SCHEMA).schema

    def run(**options):
        done = sync.sync_folder(spark, str(root), table, log, "t", schema, **options).collect()
        rows = sorted((str(r.t)[:7], r.v) for r in spark.read.parquet(table).collect())
        return {Path(r.source_file).name: r.change for r in done}, rows

    put("a", [("2024-01-05", 1), ("2024-01-06", 2)])
    put("b", [("2024-02-05", 3)])
    assert run() == ({"a.parquet": "new", "b.parquet": "new"}, [("2024-01", 1), ("2024-01", 2), ("2024-02", 3)])
    assert run()[0] == {}
    put("a", [("2024-01-05", 1), ("2024-03-01", 9)])  # reissued; a row moved to another month
    put("c", [("2024-02-07", 4)])
    assert run() == (
        {"a.parquet": "changed", "c.parquet": "new"},
        [("2024-01", 1), ("2024-02", 3), ("2024-02", 4), ("2024-03", 9)],
    )
    put("b", [])
    assert run() == ({"b.parquet": "changed"}, [("2024-01", 1), ("2024-02", 4), ("2024-03", 9)])
    (root / "c.parquet").write_bytes(b"not parquet")
    assert run()[0] == {"c.parquet": "failed"} and len(run()[1]) == 3
    put("c", [("2024-02-07", 5)])
    assert run() == ({"c.parquet": "changed"}, [("2024-01", 1), ("2024-02", 5), ("2024-03", 9)])
    (root / "a.parquet").unlink()
    assert run()[0] == {"a.parquet": "vanished"} and run() == ({}, [("2024-01", 1), ("2024-02", 5), ("2024-03", 9)])


def test_vanished_rows_go_when_asked(spark, folder, tmp_path):
    root, put = folder
    place = (str(root), f"{tmp_path}/table", f"{tmp_path}/log", "t", spark.createDataFrame([], SCHEMA).schema)
    put("a", [("2024-01-05", 1)])
    put("b", [("2024-01-05", 2)])
    sync.sync_folder(spark, *place)
    (root / "a.parquet").unlink()
    sync.sync_folder(spark, *place, remove_vanished=True)
    assert [r.v for r in spark.read.parquet(place[1]).collect()] == [2]


def test_same_size_and_time_shows_in_the_footer_only(spark, folder, tmp_path):
    root, put = folder
    place = (str(root), f"{tmp_path}/table", f"{tmp_path}/log", "t", spark.createDataFrame([], SCHEMA).schema)
    put("a", [("2024-01-05", 1), ("2024-01-06", 1)])
    sync.sync_folder(spark, *place)
    file = root / "a.parquet"
    before = file.stat()
    put("a", [("2024-01-05", 7), ("2024-01-06", None)])
    file.write_bytes(file.read_bytes())
    os.utime(file, ns=(before.st_atime_ns, before.st_mtime_ns))
    entries = spark.read.parquet(place[2]).withColumn("bytes", F.lit(file.stat().st_size).cast("bigint"))
    assert sync.folder_changes(spark, str(root), entries).count() == 0
    found = sync.folder_changes(spark, str(root), entries, compare_footers=True).collect()
    assert [r.change for r in found] == ["changed"]
