"""Keeping a table equal to a folder of files that are added, rewritten under their names, and removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.columns import TRIP_SCHEMA
from fareloom.sources.files import SOURCE_FILE, list_files, read_drifting, read_footers
from fareloom.sources.ingest import read_manifest, reload_sources
from fareloom.staging import stage

NEW, CHANGED, VANISHED, FAILED = "new", "changed", "vanished", "failed"


def footer_digest(footers: DataFrame) -> DataFrame:
    """``footers`` with a digest of what they say: schema, rows, NULLs and sizes."""
    told = F.to_json(F.struct("schema_key", "rows", "null_count", "stored_bytes", "raw_bytes"))
    return footers.withColumn("footer", F.sha2(told, 256))


def latest_entries(log: DataFrame) -> DataFrame:
    """The last entry of every file in a sync log, without files that had vanished."""
    last = log.groupBy(SOURCE_FILE).agg(
        F.max_by(F.struct("change", "bytes", "modified", "footer"), "run").alias("last")
    )
    return last.select(SOURCE_FILE, "last.*").where(F.col("change") != VANISHED)


def folder_changes(spark: SparkSession, root: str, log: DataFrame | None, compare_footers: bool = False) -> DataFrame:
    """One row per file that differs from the log, with its listing and footer: new, changed or vanished.

    A file is changed if its size or modification time is. Copies that keep
    both show only with ``compare_footers``, which reads the footer of every
    file instead of those of new and changed ones. A file that failed is
    tried again.
    """
    files = list_files(spark, root)
    known = log if log is not None else None
    entries = (
        latest_entries(known)
        if known is not None
        else spark.createDataFrame([], f"{SOURCE_FILE} string, change string, bytes bigint, modified timestamp, footer string")
    ).select(SOURCE_FILE, F.struct("change", "bytes", "modified", "footer").alias("logged"))
    both = files.join(entries, SOURCE_FILE, "full_outer")
    listed = F.col("path").isNotNull()
    differs = (F.col("logged.bytes") != F.col("bytes")) | (F.col("logged.modified") != F.col("modified"))
    change = (
        F.when(~listed, VANISHED)
        .when(F.col("logged").isNull(), NEW)
        .when(differs | (F.col("logged.change") == FAILED), CHANGED)
    )
    both = stage(both.withColumn("change", change), "folder-diff")
    suspects = both.where(listed if compare_footers else listed & F.col("change").isNotNull())
    footers = footer_digest(read_footers(suspects.select(*files.columns)))
    seen = footers.join(suspects.select(SOURCE_FILE, "change", "logged"), SOURCE_FILE)
    seen = seen.withColumn(
        "change",
        F.when(F.col("error").isNotNull(), FAILED)
        .when(F.col("change").isNull() & (F.col("footer") != F.col("logged.footer")), CHANGED)
        .otherwise(F.col("change")),
    )
    gone = both.where(F.col("change") == VANISHED).select(SOURCE_FILE, "change")
    changes = seen.where(F.col("change").isNotNull()).drop("logged").unionByName(gone, allowMissingColumns=True)
    return stage(changes, "folder-changes")


def sync_folder(
    spark: SparkSession,
    root: str,
    table: str,
    log: str,
    pickup: str,
    target: T.StructType = TRIP_SCHEMA,
    remove_vanished: bool = False,
    compare_footers: bool = False,
) -> DataFrame:
    """e_sync_changed: load new files, load changed files again in place of their earlier rows.

    Rows of a vanished file stay, as the log says, unless ``remove_vanished``.
    Only months that hold rows of the files concerned are rewritten. A file
    whose footer can't be read becomes a failed entry; its earlier rows stay
    and the next run tries it again. The log is written after the table: a run
    that dies in between is repeated, and gives the same table. One run at a time.

    Returns this run's log entries.
    """
    earlier = read_manifest(spark, log)
    changes = folder_changes(spark, root, earlier, compare_footers)
    run = next_run(earlier)
    if changes.isEmpty():
        return log_entries(changes, run)
    loaded = changes.where(F.col("change").isin(NEW, CHANGED))
    replaced = loaded.select(SOURCE_FILE)
    if remove_vanished:
        replaced = replaced.union(changes.where(F.col("change") == VANISHED).select(SOURCE_FILE))
    if not replaced.isEmpty():
        rows = read_drifting(loaded.drop("change", "footer"), target)
        reload_sources(rows, table, pickup, replaced)
    entries = stage(log_entries(changes, run), "sync-entries")
    entries.write.mode("append").parquet(log)
    return entries


def next_run(log: DataFrame | None) -> int:
    return 1 if log is None else (log.agg(F.max("run")).first()[0] or 0) + 1


def log_entries(changes: DataFrame, run: int) -> DataFrame:
    """``changes`` as the entries of one run."""
    return changes.select(
        SOURCE_FILE,
        "change",
        "bytes",
        "modified",
        "footer",
        "rows",
        "error",
        F.lit(run).cast("bigint").alias("run"),
        F.current_timestamp().alias("synced_at"),
    )
