"""Window functions over the whole table, for every row: an offset scan instead of one task.

``ROW_NUMBER() OVER (ORDER BY …)`` without PARTITION BY puts all rows into one
task. Here the rows are range-partitioned by the order and written with their
partition number, the *slice*. Inside a slice the plain window functions run.
Of each slice a summary row is left: its rows, its distinct keys, where its
last run of equal keys begins, its first and last row. Running totals over the
summaries, a row per slice, give what lies before each slice; a row's own
numbers are completed by a join on the slice.

Runs of equal keys may be cut by a slice border, since tie-breaks take part in
the partitioning: a key that fills a third of the table is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareloom.operators.ordering import SLICE
from fareloom.staging import stage

#: Names of the columns that are added.
ROW_NUMBER, RANK, DENSE_RANK, PERCENT_RANK = "row_number", "rank", "dense_rank", "percent_rank"


def _ordered(name: str, direction: str) -> Column:
    return F.desc_nulls_last(name) if direction == "desc" else F.asc_nulls_last(name)


def _slice_offsets(local: DataFrame) -> DataFrame:
    """Per slice: rows and distinct keys before it, where a run that reaches into it began, its neighbours' rows."""
    summary = local.groupBy(SLICE).agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("local_dense").alias("distinct"),
        F.max("local_rank").alias("last_run"),
        F.min_by("key", "local_row").alias("first_key"),
        F.max_by("key", "local_row").alias("last_key"),
        F.min_by("seen", "local_row").alias("first_seen"),
        F.max_by("seen", "local_row").alias("last_seen"),
    )
    # One row per slice from here on.
    order = Window.orderBy(SLICE)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = summary.select(
        "*",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("distinct").over(earlier), F.lit(0)).alias("distinct_before"),
        F.coalesce(F.col("first_key").eqNullSafe(F.lag("last_key").over(order)) & (F.lag("rows").over(order) > 0), F.lit(False)).alias("goes_on"),
        F.lag("last_seen").over(order).alias("seen_before"),
        F.lead("first_seen").over(order).alias("seen_after"),
    )
    # A slice that is all one run begun earlier says nothing about where that run began.
    begun = F.when(~F.col("goes_on") | (F.col("distinct") > 1), F.col("rows_before") + F.col("last_run"))
    placed = placed.withColumn("run_begun", F.last(begun, ignorenulls=True).over(so_far))
    return placed.select(
        SLICE,
        "rows_before",
        "goes_on",
        F.lag("run_begun").over(order).alias("run_rank"),
        (F.col("distinct_before") - F.sum(F.col("goes_on").cast("bigint")).over(so_far)).alias("dense_before"),
        "seen_before",
        "seen_after",
        F.sum("rows").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_rows"),
    )


def with_row_ranks(
    df: DataFrame,
    order: Mapping[str, str],
    tie_break: Sequence[str] = (),
    neighbours: Sequence[str] = (),
    tiles: Sequence[int] = (),
) -> DataFrame:
    """``df`` with row_number, rank, dense_rank and percent_rank over all its rows.

    ``order`` maps columns to ``"asc"`` or ``"desc"`` (NULLs last); rows equal
    in them are peers. ``tie_break`` columns, ascending, only decide row_number
    and what follows from it; rows equal in these too may swap places.
    ``neighbours`` adds ``lag_<c>`` and ``lead_<c>``, the column in the row
    before and after; ``tiles`` adds ``ntile_<n>``. An empty table stays empty.
    """
    taken = set(df.columns) & {"numbers", "local"}
    if taken or SLICE in df.columns:
        raise ValueError(f"columns {sorted(taken | ({SLICE} & set(df.columns)))} clash with helper columns")
    by = [_ordered(n, d) for n, d in order.items()]
    ties = [F.asc_nulls_last(n) for n in tie_break]
    sliced = stage(df.repartitionByRange(*by, *ties).withColumn(SLICE, F.spark_partition_id()), "ranked-slices")
    within = Window.partitionBy(SLICE).orderBy(*by, *ties)
    peers = Window.partitionBy(SLICE).orderBy(*by)
    seen = [F.col(n).alias(f"c{i}") for i, n in enumerate(neighbours)] or [F.lit(0).alias("c0")]
    local = sliced.select(
        *df.columns,
        SLICE,
        F.struct(
            F.row_number().over(within).alias("row"),
            F.rank().over(peers).alias("rank"),
            F.dense_rank().over(peers).alias("dense"),
            F.struct(*[F.lag(n).over(within).alias(f"c{i}") for i, n in enumerate(neighbours)] or [F.lit(0).alias("c0")]).alias("lag"),
            F.struct(*[F.lead(n).over(within).alias(f"c{i}") for i, n in enumerate(neighbours)] or [F.lit(0).alias("c0")]).alias("lead"),
            F.count(F.lit(1)).over(Window.partitionBy(SLICE)).alias("rows"),
        ).alias("local"),
    )
    local = stage(local, "ranked-rows")
    offsets = _slice_offsets(
        local.select(
            SLICE,
            F.col("local.row").alias("local_row"),
            F.col("local.rank").alias("local_rank"),
            F.col("local.dense").alias("local_dense"),
            F.struct(*order).alias("key"),
            F.struct(*seen).alias("seen"),
        )
    )
    offsets = stage(offsets.select(SLICE, F.struct(*[c for c in offsets.columns if c != SLICE]).alias("numbers")), "slice-offsets")
    joined = local.join(offsets, SLICE)
    here, slices = (lambda c: F.col(f"local.{c}")), (lambda c: F.col(f"numbers.{c}"))
    row = slices("rows_before") + here("row")
    in_run = slices("goes_on") & (here("rank") == 1)
    rank = F.when(in_run, slices("run_rank")).otherwise(slices("rows_before") + here("rank"))
    added = {
        ROW_NUMBER: row,
        RANK: rank,
        DENSE_RANK: slices("dense_before") + here("dense"),
        PERCENT_RANK: F.when(slices("all_rows") > 1, (rank - 1) / (slices("all_rows") - 1)).otherwise(F.lit(0.0)),
    }
    for i, name in enumerate(neighbours):
        added[f"lag_{name}"] = F.when(here("row") == 1, slices(f"seen_before.c{i}")).otherwise(here(f"lag.c{i}"))
        added[f"lead_{name}"] = F.when(here("row") == here("rows"), slices(f"seen_after.c{i}")).otherwise(here(f"lead.c{i}"))
    for count in tiles:
        added[f"ntile_{count}"] = _tile(row, slices("all_rows"), count)
    return joined.select(*df.columns, *[c.alias(n) for n, c in added.items()])


def _tile(row: Column, rows: Column, tiles: int) -> Column:
    """NTILE from the row's number: the first ``rows mod tiles`` tiles have one row more."""
    size, longer = F.floor(rows / tiles), rows % tiles
    edge = longer * (size + 1)
    early = F.floor((row - 1) / (size + 1)) + 1
    late = longer + F.floor((row - 1 - edge) / F.greatest(size, F.lit(1))) + 1
    return F.when(row <= edge, early).otherwise(late).cast("bigint")
