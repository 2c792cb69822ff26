"""The stored daily sums follow their files, and unchanged files are not opened."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import trips as t
from fareloom.columns import TRIP_SCHEMA
from fareloom.operators.analytics import day_totals
from fareloom.plans.ingest_queries import _rewrite_in_place
from fareloom.sources import daily
from fareloom.sources.files import scan_folder


@pytest.fixture
def place(spark, tmp_path):
    root, table, log = tmp_path / "in", f"{tmp_path}/parts", f"{tmp_path}/log"
    root.mkdir()

    def put(name, *rows):
        _rewrite_in_place(spark, f"{root}/{name}.parquet", t.frame(spark, *rows))

    def run(**options):
        done = daily.refresh_daily_parts(spark, str(root), table, log, **options).collect()
        return {Path(r.source_file).stem: r.change for r in done}

    def told():
        return sorted(map(tuple, daily.daily_of_files(daily.read_daily_parts(spark, table)).collect()), key=str)

    def whole():
        return sorted(map(tuple, day_totals(scan_folder(spark, str(root), TRIP_SCHEMA)).collect()), key=str)

    return root, put, run, told, whole


def at(*when, **values):
    return t.trip(tpep_pickup_datetime=t.D(*when) if when else None, **values)


def test_sums_equal_a_full_recompute(place):
    root, put, run, told, whole = place
    put("a", at(2024, 1, 5, fare_amount=1.1), at(2024, 1, 5, fare_amount=None), at(2024, 1, 31), at())
    put("b", at(2024, 1, 5, total_amount=None, fare_amount=None), at(2024, 2, 1, fare_amount=None, total_amount=None))
    assert run() == {"a": "new", "b": "new"} and told() == whole() and len(told()) == 4
    assert run() == {} and told() == whole()
    put("a", at(2024, 3, 1, fare_amount=7.35))  # reissued; its days and the one without a time are gone
    put("c", at(2024, 2, 1), at(2024, 2, 1))
    assert run() == {"a": "changed", "c": "new"} and told() == whole()
    put("b")
    assert run() == {"b": "changed"} and told() == whole()
    assert {r[0].month for r in told()} == {2, 3}
    (root / "c.parquet").unlink()
    before = told()
    assert run() == {"c": "vanished"} and told() == before


def test_vanished_and_broken_files(place):
    root, put, run, told, whole = place
    put("a", at(2024, 1, 5))
    put("b", at(2024, 2, 5))
    run()
    before = told()
    (root / "b.parquet").write_bytes(b"not parquet")
    assert run() == {"b": "failed"} and told() == before
    (root / "b.parquet").unlink()
    assert run(remove_vanished=True) == {"b": "vanished"} and told() == whole() == before[:1]


def test_unchanged_files_are_not_opened(place):
    root, put, run, told, whole = place
    put("a", at(2024, 1, 5), at(2024, 1, 6))
    run()
    put("b", at(2024, 1, 6))
    expected = whole()
    file = root / "a.parquet"
    seen = file.stat()
    file.write_bytes(b"\0" * seen.st_size)  # any read of it would fail
    os.utime(file, ns=(seen.st_atime_ns, seen.st_mtime_ns))
    assert run() == {"b": "new"} and told() == expected


@pytest.mark.parametrize("dies_in", ["write", "log"])
def test_a_run_that_died_is_repeated(place, monkeypatch, spark, dies_in):
    root, put, run, told, whole = place
    put("a", at(2024, 1, 5))
    put("b", at(2024, 1, 6))
    run()
    put("a", at(2024, 3, 1))
    with monkeypatch.context() as patch:
        if dies_in == "write":  # the new month is written, the emptied one is still there
            patch.setattr(daily, "remove_path", lambda *_: 1 / 0)
            put("b", at(2024, 3, 2))
        else:
            patch.setattr(daily, "log_entries", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run()
    put("a", at(2024, 5, 1))  # reissued again before the repetition
    assert run()["a"] == "changed" and told() == whole()


def test_no_files(place):
    _, _, run, told, _ = place
    assert run() == {} and told() == []
