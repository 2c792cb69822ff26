"""Exact positions of values in sorted groups of any size.

The built-in window functions put a group into one task, and the built-in exact
percentile holds a group's distinct values in one buffer. Here the work is
spread out:

1. Count equal values: ``groupBy(group, value).count()``. Partial aggregation
   runs before the shuffle, so a value that fills a third of the table travels
   as one row per task. Later steps see distinct values, not rows.
2. Range-partition those by (group, value) and write them to scratch with the
   partition number ("slice"). Spark samples the ranges, so slices are balanced
   however one group dominates, and AQE merges the small ones. Writing fixes
   the slice of every row: recomputed tasks cannot move a row.
3. Sum rows per slice (at most slices + groups rows) and run a total over
   them: how many rows precede each slice.
4. Inside a slice a running total completes the position.

Each distinct value ends up with the interval ``[before, before + rows)`` of
zero-based positions its copies occupy.

Percentiles need a few positions only, so ``grouped_percentiles`` does not order
a table at all but narrows it; see there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fareloom.staging import stage

ROWS = "rows_equal"
BEFORE = "rows_before"
GROUP_ROWS = "group_rows"
SLICE = "slice_id"

# First cells of a group: so many for every factor e of a value's size.
STEPS = 100
# Cells that a cell is cut into.
PARTS = 1024
# Rows of a cell whose values one task may put in order; a fuller cell is cut again.
CELL_ROWS = 1_000_000


def join_on_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """NULL-safe join on ``keys`` that keeps the left copy of each."""
    a, b = left.alias("a"), right.alias("b")
    condition = None
    for key in keys:
        term = F.col(f"a.`{key}`").eqNullSafe(F.col(f"b.`{key}`"))
        condition = term if condition is None else condition & term
    extra = [F.col(f"b.`{c}`") for c in right.columns if c not in keys]
    return a.join(b, condition, how).select("a.*", *extra)


@dataclass
class SlicedValues:
    """Distinct values in order, staged, with the row count of every slice."""

    values: DataFrame
    slices: DataFrame
    keys: Sequence[str]
    order: Sequence[Column]

    def intervals(self) -> DataFrame:
        """Every value with ``rows_before`` and ``group_rows``."""
        located = join_on_keys(self.values, self.slices, [*self.keys, SLICE])
        within = (
            Window.partitionBy(*self.keys, SLICE)
            .orderBy(*self.order)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        earlier = F.coalesce(F.sum(ROWS).over(within), F.lit(0))
        return located.withColumn(BEFORE, F.col("slice_before") + earlier).drop(
            "slice_before", "rows_in_slice", SLICE
        )


def slice_values(counted: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> SlicedValues:
    """Steps 2 and 3 for a frame with one row per distinct value and a ``rows_equal`` column."""
    ranged = counted.repartitionByRange(*[F.col(k) for k in keys], *order)
    values = stage(ranged.withColumn(SLICE, F.spark_partition_id()), "ordered-values")
    per_slice = values.groupBy(*keys, SLICE).agg(F.sum(ROWS).alias("rows_in_slice"))
    by_group = Window.partitionBy(*keys)
    preceding = by_group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    slices = per_slice.select(
        *keys,
        SLICE,
        "rows_in_slice",
        F.coalesce(F.sum("rows_in_slice").over(preceding), F.lit(0)).alias("slice_before"),
        F.sum("rows_in_slice").over(by_group).alias(GROUP_ROWS),
    )
    return SlicedValues(values, slices, keys, order)


@dataclass(frozen=True)
class Carried:
    """Aggregates taken along in the first pass over the table.

    ``sums``/``lows``/``highs`` map an output name to the expression that is
    summed, minimised or maximised per cell and again per group.
    """

    sums: Mapping[str, Column] = field(default_factory=dict)
    lows: Mapping[str, Column] = field(default_factory=dict)
    highs: Mapping[str, Column] = field(default_factory=dict)

    def partial(self) -> list[Column]:
        return (
            [F.sum(e).alias(n) for n, e in self.sums.items()]
            + [F.min(e).alias(n) for n, e in self.lows.items()]
            + [F.max(e).alias(n) for n, e in self.highs.items()]
        )

    def final(self) -> list[Column]:
        return (
            [F.sum(n).alias(n) for n in self.sums]
            + [F.min(n).alias(n) for n in self.lows]
            + [F.max(n).alias(n) for n in self.highs]
        )


def grouped_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    levels: Mapping[str, float],
    carried: Carried = Carried(),
) -> DataFrame:
    """Exact continuous percentiles of ``value`` per group (PERCENTILE_CONT).

    ``levels`` maps output names to levels in [0, 1]. NULL values take no part
    in a percentile, but their rows count in ``group_rows`` and in ``carried``.
    Output: keys, ``group_rows`` (all rows of the group), one column per level
    and the carried aggregates.

    The table is narrowed, not sorted:

    1. One pass counts every group's rows per *cell*, a step on a logarithmic
       scale, with each cell's least and greatest value. Cells are combined in
       each task, so what is shuffled are cells, not rows. Group totals and
       ``carried`` come from the same pass.
    2. The counts tell in which cells the wanted positions lie. While one of
       these holds more than ``CELL_ROWS`` rows and more than one value, another
       pass cuts the hit cells into ``PARTS`` between their ends.
    3. A last pass takes the rows of the hit cells, about a hundredth of the
       table, counts equal values and completes their positions cell by cell.

    A cell's number only has to grow with its values, so the result is exact
    whatever their distribution. The hit cells, a few per group, are joined by
    broadcast if Spark finds them small.
    """
    for level in levels.values():
        if not 0.0 <= level <= 1.0:
            raise ValueError(f"percentile level {level} is outside [0, 1]")
    by = list(keys)
    if not by:
        # One group; its key is computed from each row, so that joins on it stay joins on a key.
        by = ["whole"]
        df = df.withColumn("whole", F.pmod(F.hash(value), F.lit(1)))
    size = F.col(value).cast("double")
    step = F.signum(size) * F.rint(F.log1p(F.abs(size)) * STEPS)
    cells = stage(df.groupBy(*by, step.alias("step")).agg(*_cell_counts(value), *carried.partial()), "group-cells")
    totals = cells.groupBy(*by).agg(F.sum(ROWS).alias(GROUP_ROWS), *carried.final())
    rows = df.select(*by, value)
    known = F.sum(ROWS).over(Window.partitionBy(*by))
    cells = cells.where(F.col("least").isNotNull()).select(
        *by, F.lit(0).cast("bigint").alias("ahead"), "step", ROWS, "least", "greatest", known.alias("known_rows")
    )
    hits, too_full = _hit_cells(cells, by, levels)
    while too_full:
        inside = _rows_inside(rows, hits, by, value)
        share = (F.col(value) - F.col("least")).cast("double") / F.nullif((F.col("greatest") - F.col("least")).cast("double"), F.lit(0.0))
        part = F.coalesce(F.rint(share * PARTS), F.lit(0.0)).alias("step")
        cut = inside.groupBy(*by, F.col("before").alias("ahead"), part, "known_rows").agg(*_cell_counts(value))
        hits, too_full = _hit_cells(cut, by, levels)
    found = _rows_inside(rows, hits, by, value).groupBy(*by, "before", "known_rows", value).agg(F.count(F.lit(1)).alias(ROWS))
    within = Window.partitionBy(*by, "before").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn(BEFORE, F.col("before") + F.coalesce(F.sum(ROWS).over(within), F.lit(0)))
    picked = placed.groupBy(*by).agg(*[_picked(n, p, value) for n, p in levels.items()])
    return join_on_keys(totals, picked, by, "left").select(
        *keys,
        GROUP_ROWS,
        *[_interpolated(n).alias(n) for n in levels],
        *carried.sums,
        *carried.lows,
        *carried.highs,
    )


def _cell_counts(value: str) -> list[Column]:
    return [F.count(F.lit(1)).alias(ROWS), F.min(value).alias("least"), F.max(value).alias("greatest")]


def _hit_cells(cells: DataFrame, keys: Sequence[str], levels: Mapping[str, float]) -> tuple[DataFrame, bool]:
    """The cells that a wanted position lies in, with the group's rows before them, as a table.

    ``ahead`` is the number of rows before the cell that was cut into these, and so tells cut cells apart.
    Also says whether a cell holds too many rows for one task, and values that can be told apart.
    """
    earlier = Window.partitionBy(*keys, "ahead").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("ahead") + F.coalesce(F.sum(ROWS).over(earlier), F.lit(0))
    placed = cells.withColumn("before", before)
    ends = [at for p in levels.values() for at in _positions(p)]
    hits = placed.where(" or ".join(f"({at} >= before and {at} < before + {ROWS})" for at in ends) or "false")
    full = F.expr(f"max({ROWS} > {CELL_ROWS} and cast(least as double) < cast(greatest as double))")
    seen = Observation()
    watched = hits.select(*keys, "before", ROWS, "least", "greatest", "known_rows").observe(seen, full.alias("full"))
    return stage(watched, "hit-cells"), bool(seen.get["full"])


def _rows_inside(rows: DataFrame, hits: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The rows whose value lies within a hit cell of their group."""
    joined = join_on_keys(rows.where(F.col(value).isNotNull()), hits.drop(ROWS), keys)
    return joined.where(F.col(value).between(F.col("least"), F.col("greatest")))


def _picked(name: str, level: float, value: str) -> Column:
    """The values on both sides of a percentile point, out of a group's placed values."""
    low, high = _positions(level)

    def value_at(position: str) -> str:
        covers = f"{position} >= {BEFORE} and {position} < {BEFORE} + {ROWS}"
        return f"cast(max(case when {covers} then `{value}` end) as double)"

    share = f"max({_point(level)} - {low})"
    return F.expr(f"struct({value_at(low)} as low, {value_at(high)} as high, {share} as share)").alias(f"{name}__v")


def _point(level: float) -> str:
    """The percentile point among zero-based positions of the group's values, as SQL text."""
    return f"({float(level)!r}D * (known_rows - 1))"


def _positions(level: float) -> tuple[str, str]:
    return f"floor({_point(level)})", f"ceil({_point(level)})"


def _interpolated(name: str) -> Column:
    v = F.col(f"{name}__v")
    return v["low"] + (v["high"] - v["low"]) * v["share"]


def with_scalars(left: DataFrame, one_row: DataFrame) -> DataFrame:
    """``left`` with the columns of a one-row frame on every row, without a join."""
    columns = one_row.columns
    row = one_row.select(F.struct(*columns).alias("row")).scalar()
    return left.withColumn("__row", row).select(
        *left.columns, *[F.col("__row")[c].alias(c) for c in columns]
    )
