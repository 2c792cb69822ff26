"""Loading files into a table once: batch import, manifest, incremental and repeatable loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.columns import TRIP_SCHEMA
from fareloom.sinks.writers import MONTH, YEAR, with_month_partition
from fareloom.sources.files import SOURCE_FILE, file_month, list_files, read_drifting, read_footers
from fareloom.staging import path_exists, remove_path, stage

SUCCESS, FAILED, SKIPPED, PENDING = "success", "failed", "skipped", "pending"


def manifest_rows(footers: DataFrame, loaded_as: str = SUCCESS) -> DataFrame:
    """e_manifest: one row per file — month, rows, NULLs, size ratio, status, error.

    Everything comes from Parquet footers. The ratio is stored over raw bytes.
    """
    failed = F.col("error").isNotNull()
    ratio = F.col("stored_bytes") / F.nullif(F.col("raw_bytes").cast("double"), F.lit(0.0))
    return footers.select(
        file_month("file_name").alias("date"),
        SOURCE_FILE,
        "file_name",
        "bytes",
        "rows",
        "null_count",
        F.current_timestamp().alias("processed_at"),
        ratio.alias("compression_ratio"),
        F.when(failed, FAILED).otherwise(loaded_as).alias("status"),
        "error",
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if path_exists(spark, path) else None


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """Files, rows and NULLs per status; a file loaded again counts once, with its last entry."""
    latest = manifest.groupBy(SOURCE_FILE).agg(
        F.max_by(F.struct("status", "rows", "null_count"), "processed_at").alias("last")
    )
    return latest.groupBy(F.col("last.status").alias("status")).agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("last.rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("last.null_count"), F.lit(0)).alias("null_count"),
    )


def new_files(files: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Files that no manifest row reports as loaded."""
    if manifest is None:
        return files
    done = manifest.where(F.col("status") == SUCCESS).select(SOURCE_FILE)
    return files.join(done, SOURCE_FILE, "left_anti")


def batch_import(
    spark: SparkSession,
    root: str,
    table: str,
    manifest: str,
    target: T.StructType = TRIP_SCHEMA,
    skip_errors: bool = False,
    dry_run: bool = False,
    incremental: bool = False,
    require_date: bool = False,
) -> DataFrame:
    """e_batch_import / e_incremental_load: load every (new) file under ``root``.

    One distributed read per schema generation, one append, and the manifest
    rows after the data; an incremental run whose predecessor died in between
    finds the loaded files in the table and only writes their manifest rows. Footers are read first: with ``skip_errors`` a bad
    file becomes a failed manifest row, without it nothing is loaded.
    ``require_date`` leaves out files whose name carries no month.
    Returns the manifest rows of this run.
    """
    files = list_files(spark, root)
    if incremental:
        files = new_files(files, read_manifest(spark, manifest))
    footers = stage(read_footers(files), "footers")
    if require_date:
        dated = file_month("file_name").isNotNull()
        usable, undated = footers.where(dated), footers.where(~dated)
    else:
        usable, undated = footers, None
    if dry_run:
        return manifest_rows(usable, PENDING)
    if not skip_errors:
        bad = usable.where(F.col("error").isNotNull()).select(SOURCE_FILE, "error").take(1)
        if bad:
            raise ValueError(f"cannot read {bad[0][SOURCE_FILE]}: {bad[0]['error']}")
    log = manifest_rows(usable)
    if undated is not None:
        log = log.unionByName(manifest_rows(undated, SKIPPED))
    log = stage(log, "manifest-run")
    if incremental and path_exists(spark, table):
        # A run that died between the data and its manifest rows has loaded these files already.
        held = stage(spark.read.parquet(table).select(SOURCE_FILE).distinct(), "held-files")
        usable = stage(usable.join(held, SOURCE_FILE, "left_anti").select(*usable.columns), "files-to-load")
    if not usable.where(F.col("error").isNull()).isEmpty():
        read_drifting(usable, target, skip_unreadable=True).write.mode("append").parquet(table)
    if not log.isEmpty():
        log.write.mode("append").parquet(manifest)
    return log


def incremental_load(
    spark: SparkSession, root: str, table: str, manifest: str, **options
) -> DataFrame:
    """e_incremental_load: only files the manifest does not know yet."""
    return batch_import(spark, root, table, manifest, incremental=True, **options)


def _partition_key():
    return F.coalesce(F.col(YEAR) * 100 + F.col(MONTH), F.lit(-1))


def reload_sources(
    new: DataFrame, table: str, pickup: str, replaced: DataFrame | None = None
) -> DataFrame:
    """e_idempotent_reload: put the rows of some source files into a month-partitioned table.

    Rows the table already holds from the same ``source_file`` are replaced,
    rows of other files stay, so running a load twice changes nothing. Parquet
    has no row delete; the months concerned are rewritten: those the new rows
    fall into and those that hold earlier rows of the same files. The merged
    months go to scratch first and from there over the table, because a job
    cannot overwrite what it reads. One publisher at a time.

    ``replaced`` names further source files (column ``source_file``) whose rows
    go, such as files that have no rows any more.

    Returns the affected months with their row counts after the load.
    """
    spark = new.sparkSession
    if SOURCE_FILE not in new.columns:
        raise ValueError(f"rows to load need a {SOURCE_FILE} column")
    incoming = stage(with_month_partition(new, pickup), "incoming")
    affected = incoming.select(_partition_key().alias("k")).distinct()
    if list_files(spark, table).isEmpty():
        _by_month(incoming, pickup).write.mode("overwrite").partitionBy(YEAR, MONTH).parquet(table)
        return _month_counts(incoming)

    # Months and runs may lack columns that others have; none may get lost on the way back.
    current = spark.read.option("mergeSchema", "true").parquet(table)
    # Staged, so its true (small) size lets Spark broadcast it.
    sources = incoming.select(SOURCE_FILE)
    if replaced is not None:
        sources = sources.union(replaced.select(SOURCE_FILE))
    sources = stage(sources.distinct(), "source-names")
    holding = current.join(sources, SOURCE_FILE, "left_semi").select(_partition_key().alias("k"))
    # Month keys: a few hundred numbers, needed as literals for partition pruning.
    keys = [r["k"] for r in affected.union(holding.distinct()).distinct().collect()]
    untouched = current.where(_partition_key().isin(keys)).join(sources, SOURCE_FILE, "left_anti")
    merged = untouched.unionByName(incoming, allowMissingColumns=True)
    # Scratch holds the months clustered and sorted, so publishing needs no second shuffle.
    ready = stage(_by_month(merged, pickup), "publish")
    (
        ready.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(YEAR, MONTH)
        .parquet(table)
    )
    left = _month_counts(ready)
    for key in set(keys) - {r["month_key"] for r in left.collect()}:
        remove_path(spark, f"{table}/{_partition_dir(key)}")
    return left


def _by_month(df: DataFrame, pickup: str) -> DataFrame:
    """Rows gathered by month (big months split by AQE), in pickup order inside a task."""
    return df.hint("rebalance", YEAR, MONTH).sortWithinPartitions(YEAR, MONTH, pickup)


def _month_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(_partition_key().alias("month_key")).agg(F.count(F.lit(1)).alias("rows"))


def _partition_dir(key: int) -> str:
    if key < 0:
        return f"{YEAR}=__HIVE_DEFAULT_PARTITION__/{MONTH}=__HIVE_DEFAULT_PARTITION__"
    return f"{YEAR}={key // 100}/{MONTH}={key % 100}"


def stage_run(df: DataFrame, staging: str, run_id: str, writer_id: str) -> None:
    """r_stage_and_publish, first half: one writer's isolated staging set.

    Writers share nothing, so any number of them can stage at once.
    """
    tagged = df.withColumns({"writer_id": F.lit(writer_id), "staged_at": F.current_timestamp()})
    tagged.write.mode("overwrite").parquet(f"{staging}/run_id={run_id}")


def publish_runs(
    spark: SparkSession,
    staging: str,
    table: str,
    pickup: str,
    required: Sequence[str] = (),
) -> DataFrame:
    """r_stage_and_publish, second half: check all staged sets and merge them in one step.

    A file staged by several runs is taken from the latest one. Rows with a
    NULL in a ``required`` column stop the publish before the table is touched.
    The staging sets stay, so a publish that dies half-way is simply run again.
    """
    staged = spark.read.option("mergeSchema", "true").parquet(staging)
    if required:
        broken = F.lit(False)
        for name in required:
            broken = broken | F.col(name).isNull()
        bad = staged.where(broken).groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).take(1)
        if bad:
            raise ValueError(f"run {bad[0]['run_id']}: {bad[0]['n']} rows lack one of {required}")
    latest = stage(
        staged.groupBy(SOURCE_FILE).agg(
            F.max(F.struct("staged_at", "run_id")).getField("run_id").alias("run_id")
        ),
        "latest-run",
    )
    chosen = staged.join(latest, [SOURCE_FILE, "run_id"], "left_semi")
    return reload_sources(chosen.drop("staged_at"), table, pickup)
