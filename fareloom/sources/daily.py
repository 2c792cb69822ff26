"""A daily summary that follows a folder of files and reads only those that are new or changed.

What is stored are counts and sums per (day, source file), not means: they can
be added up in any order, and a reissued file takes the place of its own rows
without another file being opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.columns import TRIP_SCHEMA, TripColumns
from fareloom.functions.numbers import fixed, from_fixed
from fareloom.functions.times import day_of
from fareloom.operators.corpus import rows
from fareloom.sources.files import SOURCE_FILE, read_drifting
from fareloom.sources.ingest import read_manifest
from fareloom.sources.sync import CHANGED, NEW, VANISHED, folder_changes, log_entries, next_run
from fareloom.staging import path_exists, remove_path, stage

TRIPS = TripColumns()
DAY, MONTH_KEY = "day", "month_key"
NO_MONTH = -1
PARTS = T.StructType(
    [
        T.StructField(DAY, T.DateType()),
        T.StructField(SOURCE_FILE, T.StringType()),
        T.StructField("trips", T.LongType()),
        T.StructField("fare_units", T.LongType()),
        T.StructField("fares", T.LongType()),
        T.StructField("total_units", T.LongType()),
        T.StructField(MONTH_KEY, T.IntegerType()),
    ]
)


def day_parts(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """Counts and sums in cents per day and source file; trips without a time are a day of their own (NULL)."""
    day = day_of(c.pickup)
    return (
        trips.groupBy(day.alias(DAY), SOURCE_FILE)
        .agg(
            rows().alias("trips"),
            F.sum(fixed(c.fare)).alias("fare_units"),
            F.count(c.fare).alias("fares"),
            F.sum(fixed(c.total)).alias("total_units"),
        )
        .withColumn(MONTH_KEY, F.coalesce(F.year(DAY) * 100 + F.month(DAY), F.lit(NO_MONTH)))
        .select(*PARTS.fieldNames())
    )


def refresh_daily_parts(
    spark: SparkSession,
    root: str,
    table: str,
    log: str,
    target: T.StructType = TRIP_SCHEMA,
    c: TripColumns = TRIPS,
    remove_vanished: bool = False,
    compare_footers: bool = False,
) -> DataFrame:
    """a_daily_summary_files: bring the stored sums up to the files under ``root``.

    New and changed files are the only ones whose data is read. Their sums
    replace what the table holds of the same files; days of which no file
    changed are rewritten only where they share a month folder with one that
    did (a row per day and file, so a month is small, and a folder per day
    would be thousands of tiny files). The sums of a vanished file stay, as the
    log says, unless ``remove_vanished``. A file that can't be read fails and
    keeps its earlier sums.

    The months to rewrite are looked up in the table, not remembered, and the
    log comes last: a run that dies anywhere is repeated and gives the same
    sums, even if a file was reissued in between. One run at a time.

    Returns this run's log entries.
    """
    earlier = read_manifest(spark, log)
    changes = folder_changes(spark, root, earlier, compare_footers)
    run = next_run(earlier)
    if changes.isEmpty():
        return log_entries(changes, run)
    loaded = changes.where(F.col("change").isin(NEW, CHANGED))
    replaced = changes.where(F.col("change").isin(NEW, CHANGED, *[VANISHED] * remove_vanished)).select(SOURCE_FILE)
    if not replaced.isEmpty():
        fresh = day_parts(read_drifting(loaded.drop("change", "footer"), target), c)
        _replace_parts(spark, stage(fresh, "day-parts"), stage(replaced, "replaced-files"), table)
    entries = stage(log_entries(changes, run), "summary-entries")
    entries.write.mode("append").parquet(log)
    return entries


def _replace_parts(spark: SparkSession, fresh: DataFrame, replaced: DataFrame, table: str) -> None:
    held = read_daily_parts(spark, table)
    concerned = held.join(replaced, SOURCE_FILE, "left_semi").select(MONTH_KEY)
    # Month keys: a few hundred numbers, needed as literals for partition pruning.
    months = [r[MONTH_KEY] for r in concerned.union(fresh.select(MONTH_KEY)).distinct().collect()]
    others = held.where(F.col(MONTH_KEY).isin(months)).join(replaced, SOURCE_FILE, "left_anti")
    # Through scratch: a job can't overwrite what it reads.
    merged = stage(
        others.unionByName(fresh).hint("rebalance", MONTH_KEY).sortWithinPartitions(MONTH_KEY, DAY), "month-parts"
    )
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(MONTH_KEY)
        .parquet(table)
    )
    left = {r[MONTH_KEY] for r in merged.select(MONTH_KEY).distinct().collect()}
    for month in set(months) - left:
        remove_path(spark, f"{table}/{MONTH_KEY}={month}")


def read_daily_parts(spark: SparkSession, table: str) -> DataFrame:
    """The stored sums; none before the first run."""
    if not path_exists(spark, table):
        return spark.createDataFrame([], PARTS)
    return spark.read.schema(PARTS).parquet(table)


def daily_of_files(parts: DataFrame) -> DataFrame:
    """Trips, mean fare and revenue per day: the rows of ``day_totals`` over all rows of the files.

    A filter on ``month_key`` in front prunes folders.
    """
    return parts.groupBy(DAY).agg(
        F.sum("trips").alias("trips"),
        (from_fixed(F.sum("fare_units")) / F.nullif(F.sum("fares"), F.lit(0))).alias("avg_fare"),
        from_fixed(F.sum("total_units")).alias("revenue"),
    )
