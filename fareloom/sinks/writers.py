"""Writing frames: CSV, Parquet with a codec, tables with a load mode, month partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.sources.schema import align_schema
from fareloom.staging import path_exists

# Codecs of the load presets.
CODECS = ("snappy", "gzip", "uncompressed")
LOAD_MODES = ("create", "append", "replace")
YEAR, MONTH = "year", "month"


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """e_sink_csv: a folder of part files, each with the header line."""
    (
        df.write.mode(mode)
        .option("header", "true")
        # The default pattern cuts timestamps to milliseconds.
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")
        .csv(path)
    )


def write_parquet(
    df: DataFrame, path: str, codec: str = "snappy", mode: str = "errorifexists"
) -> None:
    """e_sink_parquet."""
    if codec not in CODECS:
        raise ValueError(f"codec {codec!r} is not one of {CODECS}")
    df.write.mode(mode).option("compression", codec).parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """e_sink_table: ``create`` leaves an existing table alone, ``append`` fits the rows to its
    columns, ``replace`` starts over."""
    if mode not in LOAD_MODES:
        raise ValueError(f"load mode {mode!r} is not one of {LOAD_MODES}")
    if mode == "create":
        df.write.mode("ignore").parquet(path)
    elif mode == "replace":
        df.write.mode("overwrite").parquet(path)
    elif path_exists(df.sparkSession, path):
        existing = df.sparkSession.read.parquet(path).schema
        align_schema(df, existing).write.mode("append").parquet(path)
    else:
        df.write.parquet(path)


def with_month_partition(df: DataFrame, pickup: str) -> DataFrame:
    """``year`` and ``month`` of the pickup time itself.

    The month in a file name is not the month of every row in it; pruning on
    partitions taken from names would lose the strays.
    """
    return df.withColumns({YEAR: F.year(pickup), MONTH: F.month(pickup)})


def write_hive_partitioned(
    df: DataFrame,
    root: str,
    pickup: str,
    codec: str = "snappy",
    sort: Sequence[str] = (),
    mode: str = "overwrite",
) -> None:
    """e_write_hive_partitioned: ``year=/month=`` folders, only touched partitions replaced.

    The rebalance hint gathers each month before the write and lets AQE cut a
    month that outgrows the target size into several tasks, so one busy month
    is neither one task nor thousands of small files. Rows are sorted by pickup
    time inside a file to keep row-group statistics narrow.
    """
    parted = with_month_partition(df, pickup)
    (
        parted.hint("rebalance", YEAR, MONTH)
        .sortWithinPartitions(YEAR, MONTH, pickup, *sort)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", codec)
        .partitionBy(YEAR, MONTH)
        .parquet(root)
    )
