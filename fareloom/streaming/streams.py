"""Structured Streaming jobs: continuous file append, replay dedup, daily totals.

Each function returns a streaming DataFrame or runs one ``availableNow`` round
(process what is there, then stop); a scheduler repeats the round, and the
checkpoint makes every file count exactly once across rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.columns import TripColumns
from fareloom.functions.numbers import fixed, from_fixed
from fareloom.functions.times import epoch_micros, ntz
from fareloom.operators.corpus import TRIPS
from fareloom.operators.ordering import join_on_keys
from fareloom.sources.files import SOURCE_FILE
from fareloom.sources.schema import align_schema, default_fill
from fareloom.staging import path_exists, stage

EVENT_TIME = "event_time"
DAY, BATCH = "day", "batch"


def file_stream(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    pattern: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """New Parquet files under ``root``, at any depth, as a stream.

    ``files_per_batch`` bounds a micro-batch; oldest files come first.
    """
    reader = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(root)


def append_new_files(
    stream: DataFrame, target: T.StructType, table: str, checkpoint: str
) -> None:
    """r_stream_files: align every new file to the table and append it exactly once.

    The file sink's commit log and the checkpoint make a batch that is retried
    after a failure appear once.
    """
    tagged = stream.select("*", F.col("_metadata.file_path").alias(SOURCE_FILE))
    run_once(align_schema(default_fill(tagged), target, keep=[SOURCE_FILE]), table, checkpoint)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available into a Parquet table, then stop."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()


def _watermarked(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need a zoned timestamp; the zone-free one is taken as UTC."""
    return stream.withColumn(EVENT_TIME, F.timestamp_micros(epoch_micros(ts))).withWatermark(
        EVENT_TIME, delay
    )


def _zone_free(ts: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), ntz("1970-01-01"))


def drop_replays(
    stream: DataFrame, keys: Sequence[str], ts: str, delay: str = "1 day"
) -> DataFrame:
    """r_stream_dedup: each event once, however often it is replayed within ``delay``.

    State holds one entry per key and expires with the watermark, so it is
    bounded by the events of one delay, not by the length of the stream.
    """
    return _watermarked(stream, ts, delay).dropDuplicatesWithinWatermark(list(keys)).drop(EVENT_TIME)


def daily_totals(
    stream: DataFrame, delay: str = "1 day", c: TripColumns = TRIPS
) -> DataFrame:
    """r_stream_daily: trips, mean amount and revenue per day.

    In append mode a day comes out once, when the watermark has passed its end;
    ``publish_daily`` keeps the open days up to date as well. State is one row
    per open day; micro-batches pre-aggregate before the shuffle.
    """
    return (
        _watermarked(stream, c.pickup, delay)
        .groupBy(F.window(EVENT_TIME, "1 day").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("trips"),
            F.sum(fixed(c.total)).alias("units"),
            F.count(c.total).alias("known"),
        )
        .select(
            F.to_date(_zone_free(F.col("w.start"))).alias("day"),
            "trips",
            (from_fixed(F.col("units")) / F.nullif(F.col("known"), F.lit(0))).alias("avg_fare"),
            from_fixed(F.col("units")).alias("revenue"),
        )
    )


def publish_daily(totals: DataFrame, table: str, checkpoint: str) -> None:
    """Keep a table of ``daily_totals`` by day, open days included, up to everything available.

    Update mode hands each micro-batch the days that changed, with their whole
    totals; these replace the day's folder, so a batch that is run again
    changes nothing.
    """

    def replace_days(batch: DataFrame, _: int) -> None:
        (
            batch.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day")
            .parquet(table)
        )

    _run_batches(totals.writeStream.outputMode("update"), replace_days, checkpoint)


def _run_batches(writer, run: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = writer.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def publish_events(
    stream: DataFrame, keys: Sequence[str], ts: str, table: str, checkpoint: str, delay: str = "1 day"
) -> None:
    """r_stream_late: each event once in ``table``, however late it or its replays come.

    The published table itself tells which events were seen, so there is no
    state to expire and nothing behind a watermark is lost. Only the day
    folders that a batch falls into are listed and read. Rows younger than the
    newest earlier event less ``delay`` are looked up among the published rows
    of that age, by a filter on ``ts`` that reaches the row groups; older rows
    and rows without a time in all of their days. An event and its replays
    have the same time; NULL keys are equal.

    Every batch writes folders of its own (``day=…/batch=…``) and does not
    look at them itself, so a batch that is run again gives the same table.
    """
    frontier = f"{checkpoint}/frontier"
    spark = stream.sparkSession
    schema = stream.schema.add(DAY, T.DateType()).add(BATCH, T.LongType())

    def merge(batch: DataFrame, number: int) -> None:
        arrived = stage(batch.dropDuplicates(list(keys)).withColumn(DAY, F.to_date(ts)), "stream-batch")
        before = f"{frontier}/{BATCH}={number - 1}"
        newest = spark.read.parquet(before).first()["newest"] if path_exists(spark, before) else None
        newest = F.lit(newest).cast(schema[ts].dataType)

        def unseen(rows: DataFrame, known: Column) -> DataFrame:
            # A few days: their folders are read by name.
            days = [r[DAY] for r in rows.select(DAY).distinct().collect()]
            held = _published(spark, table, days, schema).where((F.col(BATCH) != number) & known)
            return join_on_keys(rows, held.select(*keys, DAY), [*keys, DAY], "left_anti")

        since = newest - F.expr(f"INTERVAL {delay}")
        young = F.coalesce(F.col(ts) >= since, F.lit(False))
        on_time = unseen(arrived.where(young), F.col(ts) >= since)
        new = on_time.unionByName(unseen(arrived.where(~young), F.lit(True)))
        (
            new.withColumn(BATCH, F.lit(number).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(DAY, BATCH)
            .parquet(table)
        )
        latest = arrived.agg(F.greatest(F.max(ts), newest).cast("string").alias("newest"))
        latest.write.mode("overwrite").parquet(f"{frontier}/{BATCH}={number}")

    _run_batches(stream.writeStream, merge, checkpoint)


def _published(spark: SparkSession, table: str, days: Sequence, schema: T.StructType) -> DataFrame:
    """The rows of ``table`` in the folders of ``days``; days without a folder have none."""
    folders = [f"{table}/{DAY}={'__HIVE_DEFAULT_PARTITION__' if d is None else d}" for d in days]
    folders = [f for f in folders if path_exists(spark, f)]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", table).parquet(*folders)


def publish_daily_parts(stream: DataFrame, table: str, checkpoint: str, c: TripColumns = TRIPS) -> None:
    """r_stream_late_daily: counts and sums per day of every batch; ``daily_of_parts`` adds them up.

    Whole numbers can be added later in any order, so a row counts towards its
    day however late it comes, and no day needs to be held open or read again.
    A batch replaces its own folder only.
    """

    def add(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(F.to_date(c.pickup).alias(DAY)).agg(
            F.count(F.lit(1)).alias("trips"), F.sum(fixed(c.total)).alias("units"), F.count(c.total).alias("known")
        )
        sums.write.mode("overwrite").parquet(f"{table}/{BATCH}={number}")

    _run_batches(stream.writeStream, add, checkpoint)


def daily_of_parts(parts: DataFrame) -> DataFrame:
    """Trips, mean amount and revenue per day out of ``publish_daily_parts``."""
    units = F.sum("units")
    return parts.groupBy(DAY).agg(
        F.sum("trips").alias("trips"),
        (from_fixed(units) / F.nullif(F.sum("known"), F.lit(0))).alias("avg_fare"),
        from_fixed(units).alias("revenue"),
    )
