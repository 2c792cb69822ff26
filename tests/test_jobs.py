"""Quality reports, dedup, versions and streams."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fareloom.columns import TRIP_SCHEMA
from fareloom.operators import quality as v
from fareloom.operators.dedup import drop_exact_duplicates, drop_keyed_duplicates
from fareloom.operators.versions import current_rows, open_version, rows_as_of, with_validity
from fareloom.sources import layout
from fareloom.streaming import streams
from trips import D, frame, synthetic, trip

PICKUP = "tpep_pickup_datetime"


def as_dict(df, key="metric"):
    return {r[key]: r for r in df.collect()}


def test_equal_copies_match_and_changed_ones_do_not(spark):
    df = synthetic(spark, 300)
    assert all(r["matches"] for r in v.compare_tables(df, df.repartition(7)).collect())
    changed = as_dict(v.compare_tables(df, df.union(frame(spark, trip(VendorID=77)))))
    assert not changed["row_count"]["matches"] and not changed["vendors"]["matches"]
    assert changed["max_date"]["matches"]
    keys = as_dict(v.group_key_diagnostics(df, df.where("VendorID = 1")))
    assert not keys["date_vendor_pairs"]["matches"]


def test_validate_two_rows(spark):
    df = frame(
        spark,
        dict(tpep_pickup_datetime=D(2023, 1, 1, 10), total_amount=15.5),
        dict(tpep_pickup_datetime=D(2023, 2, 1, 11), total_amount=20.0, VendorID=2),
    )
    (row,) = v.validate(df).collect()
    assert (row["year"], row["year_rows"], row["total_rows"], row["column_count"], row["status"]) == (
        2023, 2, 2, 20, "valid",
    )
    with pytest.raises(ValueError):
        v.validate(df.drop(PICKUP))
    (none,) = v.validate(df.where("false")).collect()
    assert (none["year"], none["year_rows"], none["total_rows"], none["column_count"], none["status"]) == (
        None, 0, 0, 20, "empty",
    )


def test_null_counts_and_rules(spark):
    df = frame(spark, dict(fare_amount=-1.0), dict(fare_amount=None), trip())
    nulls = {r["column_name"]: r["nulls"] for r in v.null_counts(df).collect()}
    assert nulls["fare_amount"] == 1 and nulls["VendorID"] == 0
    assert nulls["(all)"] == sum(n for c, n in nulls.items() if c != "(all)")
    rules = v.trip_rules()
    assert [tuple(r) for r in v.rule_violations(df, rules).collect()] == [("negative_fare", 1)]
    with pytest.raises(ValueError, match="negative_fare: 1"):
        v.require_clean(df, rules)
    v.require_clean(frame(spark, trip()), rules)


def test_reconcile_finds_lost_and_unknown_files(spark):
    manifest = spark.createDataFrame([("a", 2), ("b", 1)], "source_file string, rows bigint")
    table = frame(spark, trip(), trip(), trip()).withColumn(
        "source_file", F.element_at(F.array(F.lit("a"), F.lit("c"), F.lit("c")), (F.monotonically_increasing_id() % 3 + 1).cast("int"))
    )
    got = as_dict(v.row_reconcile(manifest, table, "source_file"), "source_file")
    assert got["b"]["table_rows"] == 0 and not got["b"]["matches"]
    assert got["c"]["file_rows"] == 0 and not got["c"]["matches"]


def test_audit_counts_the_last_state_of_a_run(spark):
    audit = spark.createDataFrame(
        [
            ("r1", "p", "w", "running", D(2024, 1, 1), None, 0, 0, None),
            ("r1", "p", "w", "completed", D(2024, 1, 1), D(2024, 1, 1, 1), 10, 100, {"k": "v"}),
            ("r2", "p", "w", "running", D(2024, 1, 2), None, 0, 0, None),
            ("r3", "p", "w", "failed", D(2024, 1, 3), D(2024, 1, 3, 1), 0, 0, None),
        ],
        v.RUN_AUDIT,
    )
    got = {r["status"]: (r["runs"], r["rows_written"], r["bytes_written"]) for r in v.audit_report(audit).collect()}
    assert got == {"completed": (1, 10, 100), "running": (1, 0, 0), "failed": (1, 0, 0)}


def test_exact_and_keyed_dedup(spark):
    df = frame(spark, trip(), trip(), trip(VendorID=2))
    assert drop_exact_duplicates(df).count() == 2
    copies = spark.createDataFrame(
        [("k", 1, "old"), ("k", 3, "new"), ("k", 2, "mid"), (None, 1, "n")] + [("hot", i, "h") for i in range(500)],
        "key string, version int, text string",
    ).repartition(6)
    got = {r["key"]: tuple(r) for r in drop_keyed_duplicates(copies, ["key"], ["version"]).collect()}
    assert got == {"k": ("k", 3, "new"), None: (None, 1, "n"), "hot": ("hot", 499, "h")}


def test_versions_close_per_partition(spark):
    base = spark.createDataFrame([(2023, "a"), (2023, "b"), (2024, "c")], "part int, text string")
    history = open_version(base, "2024-01-01", "w1").union(
        open_version(base.where("part = 2023 and text = 'a'"), "2024-02-01", "w2")
    )
    versioned = with_validity(history, ["part"])
    assert sorted(r["text"] for r in current_rows(versioned).collect()) == ["a", "c"]
    assert sorted(r["text"] for r in rows_as_of(versioned, "2024-01-10").collect()) == ["a", "b", "c"]
    assert rows_as_of(versioned, "2023-12-31").count() == 0
    at_switch = rows_as_of(versioned, "2024-02-01").where("part = 2023").collect()
    assert [r["writer_id"] for r in at_switch] == ["w2"]


def test_file_stream_takes_new_files_once(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "cp"))
    source = frame(spark, trip()).drop("cbd_congestion_fee")
    for expected in (1, 2):
        source.write.mode("append").parquet(landing)
        streams.append_new_files(streams.file_stream(spark, landing, source.schema), TRIP_SCHEMA, table, checkpoint)
        got = spark.read.parquet(table)
        assert got.count() == expected
    assert got.columns == [*TRIP_SCHEMA.names, "source_file"]
    assert got.select("source_file").distinct().count() == 2
    streams.append_new_files(streams.file_stream(spark, landing, source.schema), TRIP_SCHEMA, table, checkpoint)
    assert spark.read.parquet(table).count() == 2


def test_stream_dedup_within_delay_across_batches(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "cp"))
    events = spark.createDataFrame(
        [(i, D(2024, 1, 1) + dt.timedelta(minutes=i)) for i in range(10)], "id bigint, ts timestamp_ntz"
    )
    for _ in range(3):
        events.coalesce(1).write.mode("append").parquet(landing)
    stream = streams.file_stream(spark, landing, events.schema, files_per_batch=1)
    streams.run_once(streams.drop_replays(stream, ["id"], "ts", "1 hour"), table, checkpoint)
    got = spark.read.parquet(table)
    assert got.count() == 10 and got.columns == ["id", "ts"]


def test_stream_emits_finished_days_only(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "cp"))
    df = frame(
        spark,
        dict(tpep_pickup_datetime=D(2024, 1, 1, 23, 59, 59), total_amount=10.0),
        dict(tpep_pickup_datetime=D(2024, 1, 2), total_amount=20.0),
        dict(tpep_pickup_datetime=D(2024, 1, 3, 12), total_amount=5.0),
    )
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df.coalesce(1).write.parquet(landing)
        stream = streams.file_stream(spark, landing, df.schema)
        streams.run_once(streams.daily_totals(stream, "6 hours"), table, checkpoint)
        got = sorted(tuple(r) for r in spark.read.parquet(table).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [(dt.date(2024, 1, 1), 1, 10.0, 10.0), (dt.date(2024, 1, 2), 1, 20.0, 20.0)]


def test_stats_of_an_empty_table_and_of_missing_amounts(spark):
    df = frame(spark, trip(), dict(total_amount=None, VendorID=None), trip())
    (row,) = v.data_stats(df).collect()
    known = df.where("total_amount is not null").collect()
    assert (row["total_rows"], row["vendors"]) == (3, len({r["VendorID"] for r in df.collect()} - {None}))
    assert row["total_revenue"] == round(sum(r["total_amount"] for r in known), 2)
    (none,) = v.data_stats(df.where("false")).collect()
    assert none["total_rows"] == none["vendors"] == 0 and none["avg_fare"] is None and none["min_date"] is None


def test_layout_suggestion_says_why(spark, tmp_path):
    def suggest(df, **settings):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        df.write.parquet(path)
        found = layout.suggest_partitioning(spark.read.parquet(path), PICKUP, **settings).collect()
        assert len(found) == 3 and len({(r["size_gb"], r["should_partition"], r["reason"]) for r in found}) == 1
        best = [r["layout"] for r in found if r["suggested"]]
        return best, found[0]["should_partition"], found[0]["reason"], [r["partitions"] for r in found]

    days = [dict(tpep_pickup_datetime=D(2023, m, d, 1)) for m in (1, 2) for d in (1, 2, 3)]
    df = frame(spark, *days, dict(tpep_pickup_datetime=None))
    assert suggest(df) == (["year,month,day"], False, "smaller than 1 GB", [1, 2, 6])
    assert suggest(df, worth_from_gb=0) == (["year,month,day"], True, "0 GB or more, with a time column", [1, 2, 6])
    assert suggest(df, worth_from_gb=0, max_partitions=5)[:2] == (["year,month"], True)
    assert suggest(df, max_partitions=0)[:3] == ([], False, "every layout has more than 0 folders")
    assert suggest(df.limit(1), worth_from_gb=0)[1:3] == (False, "all rows fall into one folder")
    assert suggest(df.where("tpep_pickup_datetime is null"))[:3] == ([], False, "no row has a time")
    assert suggest(df.where("false"))[:3] == ([], False, "no row has a time")
