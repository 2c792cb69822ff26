"""Versioned rows: every load appends, reads choose the version.

A load of a source partition (a month, a file) opens at ``valid_from`` and
closes the previous load of the same partition. Nothing stored is ever
updated: ``valid_to`` follows from the loads that exist, so appends by many
writers need no coordination. Loads at one time are in the order of their load
ids, so exactly one version of a partition is current.

``append_version`` keeps every load in a folder of its own and the loads in a
log; a reader takes from the log which folders hold what it may see and opens
no others.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.functions.times import ntz
from fareloom.operators.ordering import join_on_keys
from fareloom.staging import stage

VALID_FROM, VALID_TO, WRITER, LOAD = "valid_from", "valid_to", "writer_id", "load_id"


def new_load_id() -> str:
    """An id that sorts after those given out before, on one clock."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def open_version(
    df: DataFrame, valid_from: str | dt.datetime, writer_id: str, load_id: str | None = None
) -> DataFrame:
    """The rows of one load, stamped; append the result to the history."""
    return df.withColumns(
        {VALID_FROM: ntz(valid_from), WRITER: F.lit(writer_id), LOAD: F.lit(load_id or new_load_id())}
    )


def _closed(loads: DataFrame, partition: Sequence[str]) -> DataFrame:
    """Loads with ``valid_to``: the start of the next one, equal to its own where both start together."""
    order = Window.partitionBy(*partition).orderBy(VALID_FROM, LOAD)
    return loads.withColumn(VALID_TO, F.lead(VALID_FROM).over(order))


def with_validity(history: DataFrame, partition: Sequence[str]) -> DataFrame:
    """r_temporal_append: the history with ``valid_to``, NULL for the current version.

    The next version is looked up on the distinct (partition, valid_from,
    load_id), one per load. Those are staged: with their true size known, Spark
    broadcasts them while they are small and the history is not shuffled.
    """
    loads = history.select(*partition, VALID_FROM, LOAD).distinct()
    closed = stage(_closed(loads, partition), "versions")
    return join_on_keys(history, closed, [*partition, VALID_FROM, LOAD])


def current_rows(versioned: DataFrame) -> DataFrame:
    return versioned.where(F.col(VALID_TO).isNull())


def rows_as_of(versioned: DataFrame, moment: str | dt.datetime) -> DataFrame:
    """What a reader saw at ``moment``; a version starts at its ``valid_from``."""
    at = ntz(moment)
    return versioned.where(
        (F.col(VALID_FROM) <= at) & (F.col(VALID_TO).isNull() | (F.col(VALID_TO) > at))
    )


def append_version(
    df: DataFrame,
    table: str,
    partition: Sequence[str],
    valid_from: str | dt.datetime,
    writer_id: str,
    load_id: str | None = None,
) -> str:
    """r_temporal_log: write one load to its folder and then to the log of loads; returns its id.

    The log entry comes last: a load that died before it is invisible. The same
    ``load_id`` again replaces the load's rows and entry.
    """
    load_id = load_id or new_load_id()
    folder = f"{table}/rows/{LOAD}={load_id}"
    df.write.mode("overwrite").parquet(folder)
    held = df.sparkSession.read.schema(df.schema).parquet(folder).select(*partition).distinct()
    entry = held.withColumns({VALID_FROM: ntz(valid_from), WRITER: F.lit(writer_id)})
    entry.write.mode("overwrite").parquet(f"{table}/log/{LOAD}={load_id}")
    return load_id


def read_version(
    spark: SparkSession, table: str, partition: Sequence[str], moment: str | dt.datetime | None = None
) -> DataFrame:
    """The rows in force at ``moment`` (now, if none), with the columns of their log entry.

    Only folders of loads in force are listed and read: at most one load for
    each partition, whatever the length of the history.
    """
    log = _read_loads(spark, f"{table}/log")
    closed = _closed(log, partition)
    in_force = stage(current_rows(closed) if moment is None else rows_as_of(closed, moment), "loads-in-force")
    ids = [r[LOAD] for r in in_force.select(LOAD).distinct().collect()]
    rows = _read_loads(spark, f"{table}/rows", sorted(ids)) if ids else _read_loads(spark, f"{table}/rows").limit(0)
    return join_on_keys(rows, in_force, [*partition, LOAD])


def _read_loads(spark: SparkSession, root: str, ids: Sequence[str] = ()) -> DataFrame:
    """The folders of the loads ``ids``, or of all; ids are text, also where they look like numbers."""
    folders = [f"{root}/{LOAD}={i}" for i in ids] or [root]
    reader = spark.read.option("basePath", root)
    fields = reader.parquet(*folders).schema.fields
    text = [T.StructField(f.name, T.StringType()) if f.name == LOAD else f for f in fields]
    return reader.schema(T.StructType(text)).parquet(*folders)
