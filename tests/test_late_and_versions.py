"""Late stream rows, the log of versions, and comparison by rows."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fareloom.columns import TripColumns
from fareloom.operators import quality as v
from fareloom.operators import versions
from fareloom.streaming import streams
from trips import synthetic

EVENTS = "id bigint, ts timestamp_ntz, text string"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def forget_last_commit(checkpoint):
    """As if the last batch had died after its writes: it is run again."""
    last = max((p for p in Path(checkpoint, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for path in (last, last.with_name(f".{last.name}.crc")):
        path.unlink(missing_ok=True)


def test_late_events_are_kept_once(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "cp"))

    def arrive(*rows):
        df = spark.createDataFrame(list(rows), EVENTS)
        df.coalesce(1).write.mode("append").parquet(landing)
        stream = streams.file_stream(spark, landing, df.schema, files_per_batch=1)
        streams.publish_events(stream, ["id"], "ts", table, checkpoint, "1 hour")
        got = [(r.id, r.ts, r.text) for r in spark.read.parquet(table).collect()]
        return sorted(got, key=repr)

    new = [(1, at(20, 5), "a"), (2, at(20, 6), "b"), (None, at(20, 6), "no id"), (3, None, "no time")]
    assert arrive(*new, *new) == sorted(new, key=repr)
    late = [(4, at(2), "late"), (5, at(2), "late")]
    everything = sorted(new + late, key=repr)
    assert arrive(*late, *new) == everything
    assert arrive(*late[::-1], *new, *late) == everything
    files = len(list(Path(table).rglob("*.parquet")))
    forget_last_commit(checkpoint)
    last = (6, at(1), "after a batch was repeated")
    assert arrive(last) == sorted([*everything, last], key=repr)
    assert len(list(Path(table).rglob("*.parquet"))) == files + 1
    # What was seen is in the table only: no state grows beside it.
    assert not Path(checkpoint, "state").exists()


def test_only_days_of_the_batch_are_read(spark, tmp_path):
    table = str(tmp_path / "table")
    days = [(i, at(i), "x") for i in range(1, 11)]
    df = spark.createDataFrame(days, EVENTS).withColumns({"day": F.to_date("ts"), "batch": F.lit(0).cast("long")})
    df.write.partitionBy("day", "batch").parquet(table)
    held = streams._published(spark, table, [at(3).date(), at(30).date(), None], df.schema)
    assert {f.split("day=")[1][:10] for f in held.inputFiles()} == {"2024-01-03"} and held.count() == 1
    assert streams._published(spark, table, [None], df.schema).count() == 0


def test_daily_parts_count_late_rows_once(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "cp"))
    c = TripColumns(pickup="ts", total="total")

    def arrive(*rows):
        df = spark.createDataFrame(list(rows), "ts timestamp_ntz, total double")
        df.coalesce(1).write.mode("append").parquet(landing)
        streams.publish_daily_parts(streams.file_stream(spark, landing, df.schema), table, checkpoint, c)
        found = streams.daily_of_parts(spark.read.parquet(table)).collect()
        return {r.day and r.day.day: (r.trips, r.avg_fare, r.revenue) for r in found}

    assert arrive((at(20), 10.0), (at(20, 3), None), (None, 1.0)) == {20: (2, 10.0, 10.0), None: (1, 1.0, 1.0)}
    want = {20: (3, 6.0, 12.0), 1: (1, 0.1, 0.1), None: (1, 1.0, 1.0)}
    assert arrive((at(1), 0.1), (at(20), 2.0)) == want
    forget_last_commit(checkpoint)
    assert arrive((at(2), None)) == {**want, 2: (1, None, None)}


def test_loads_at_one_time_leave_one_current_version(spark, tmp_path):
    base = spark.createDataFrame([(2023, "a"), (2023, "b"), (2024, "c"), (None, "n")], "part int, text string")
    again = base.where("text in ('a', 'n')")
    history = versions.open_version(base, "2024-01-01", "w1").union(versions.open_version(again, "2024-01-01", "w2"))
    both = versions.with_validity(history, ["part"])
    for seen in (versions.current_rows(both), versions.rows_as_of(both, "2024-01-01")):
        assert sorted((r.text, r.writer_id) for r in seen.collect()) == [("a", "w2"), ("c", "w1"), ("n", "w2")]

    table = str(tmp_path / "table")
    first = versions.append_version(base, table, ["part"], "2024-01-01", "w1")
    second = versions.append_version(again, table, ["part"], "2024-01-01", "w2")
    third = versions.append_version(base.where("part = 2024"), table, ["part"], "2024-03-01", "w3")
    base.write.parquet(f"{table}/rows/load_id={versions.new_load_id()}")  # died before its log entry
    assert first < second < third

    def read(moment=None):
        df = versions.read_version(spark, table, ["part"], moment)
        loads = {f.split("load_id=")[1].split("/")[0] for f in df.inputFiles() if "/rows/" in f}
        return sorted((r.text, r.writer_id) for r in df.collect()), loads

    assert read() == ([("a", "w2"), ("c", "w3"), ("n", "w2")], {second, third})
    assert read("2024-02-01") == ([("a", "w2"), ("c", "w1"), ("n", "w2")], {first, second})
    assert read("2023-12-31")[0] == []
    # A load that is repeated under its id replaces itself.
    versions.append_version(again.where("text = 'a'"), table, ["part"], "2024-01-01", "w2", second)
    assert read()[0] == [("a", "w2"), ("c", "w3"), ("n", "w1")]
    numeric = str(tmp_path / "numeric")
    for load in ("007", "010"):
        versions.append_version(base, numeric, ["part"], "2024-01-01", load, load)
    assert {r.writer_id for r in versions.read_version(spark, numeric, ["part"]).collect()} == {"010"}


@pytest.mark.parametrize("cells", [1, 5, 1 << 16])
def test_rows_with_equal_totals_are_told_apart(spark, cells):
    kinds = "k bigint, part string, amount double, note string"
    rows = [(i, "p", float(i), None) for i in range(50)] + [(None, None, 7.0, "x"), (60, "q", 1.0, "d"), (60, "q", 1.0, "d")]
    left = spark.createDataFrame(rows, kinds)
    swapped = [(3, "p", 4.0, None), (4, "p", 3.0, "new"), (None, None, 7.0, "y"), (60, "q", 1.0, "d"), (99, None, 1.0, None)]
    kept = [r for r in rows if r[0] not in (3, 4, 5, None, 60)]
    right = spark.createDataFrame(kept + swapped, kinds).repartition(5).select("note", "amount", "part", "k")
    got = {r.k: tuple(r)[2:] for r in v.compare_rows(left, right, ["k", "part"], cells).collect()}
    assert got == {
        3: ("changed", 1, 1, "amount"), 4: ("changed", 1, 1, "amount,note"), 5: ("left", 1, 0, ""),
        None: ("changed", 1, 1, "note"), 60: ("left", 1, 0, ""), 99: ("right", 0, 1, ""),
    }
    assert v.compare_rows(left, left.repartition(3), ["k", "part"], cells).count() == 0
    assert v.compare_rows(left.limit(0), left.limit(0), ["k"], cells).count() == 0


def test_swapped_amounts_that_all_totals_miss(spark):
    df = synthetic(spark, 100)
    keyed = df.selectExpr("*", "xxhash64(*) AS row")
    a, b = keyed.where("total_amount > 0").groupBy("total_amount").agg(F.min("row").alias("row")).orderBy("row").limit(2).collect()
    other = keyed.withColumn(
        "total_amount",
        F.when(F.col("row") == a.row, F.lit(b.total_amount)).when(F.col("row") == b.row, F.lit(a.total_amount)).otherwise(F.col("total_amount")),
    )
    assert all(r["matches"] for r in v.compare_tables(keyed, other).collect())
    found = v.compare_rows(keyed, other, ["row"]).collect()
    assert {(r.row, r.status, r["columns"]) for r in found} == {(x.row, "changed", "total_amount") for x in (a, b)}
    with pytest.raises(ValueError, match="row"):
        v.compare_rows(keyed, df, ["row"])
