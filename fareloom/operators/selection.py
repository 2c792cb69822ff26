"""Global ranks without sorting the table: percentiles, NTILE, PERCENT_RANK over all rows.

A rank over the whole table with no PARTITION BY would sort every row in one
task. What the queries need of it is only where a few positions fall — four
tile edges, one threshold. So the table is narrowed instead of sorted:

1. A quantile sketch (partial per task, merged) gives two values on either
   side of each wanted position: the *cuts*.
2. An exact count of the cells the cuts make — below, equal to, between and
   above them — tells which cell each position lies in. A sketch may be off;
   the count is not, and some cell always holds the position.
3. Only the rows of cells a position lies in are put in order. Normally that is a fraction
   of a thousandth of the table; their number is known from step 2, and if it
   is large they take the range-partitioned way of ``ordering``.

Each step scans the ordering column and shuffles a few rows. The driver sees
the cuts, the cell counts and the selected values, nothing that grows with the
table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.operators.ordering import BEFORE, GROUP_ROWS, ROWS, slice_values

# Rank error of the sketch is at most 1/ACCURACY; cuts lie twice as far out.
ACCURACY = 5000
# Decimal digits that a double always keeps apart.
EXACT_DIGITS = 15

_CELL, _SORT = "cell", "sort_{}"


@dataclass(frozen=True)
class Selected:
    """The row at one position: its ordering columns, ascending form."""

    position: int
    sort_values: tuple[float, ...]


def _exact_double(df: DataFrame, name: str) -> Column:
    """An ordering column as a double that orders as the column does.

    A double keeps whole numbers up to 2**53 and decimals of 15 digits apart;
    a value beyond that raises by name, and so does a column of text.
    """
    kind, value = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.StringType):
        raise TypeError(f"order by {name}: text can't be selected on")
    if isinstance(kind, T.LongType):
        held = value.between(-(2**53), 2**53)
    elif isinstance(kind, T.DecimalType) and kind.precision > EXACT_DIGITS:
        limit = f"1e{EXACT_DIGITS - kind.scale}"
        held = F.abs(value.cast("double")) < F.lit(float(limit))
    else:
        return value.cast("double")
    problem = F.concat(F.lit(f"order by {name}: a double can't hold "), value.cast("string"))
    return F.when(value.isNull() | held, value.cast("double")).otherwise(F.raise_error(problem).cast("double"))


def _sort_columns(df: DataFrame, order: Mapping[str, str]) -> dict[str, Column]:
    """Ordering columns in a form that ascends, NULLs last."""
    columns = {}
    for i, (name, direction) in enumerate(order.items()):
        value = _exact_double(df, name)
        value = -value if direction == "desc" else value
        columns[_SORT.format(i)] = F.coalesce(value, F.lit(math.inf))
    return columns


def _cell_of(name: str, cuts: Sequence[float]) -> Column:
    """Cell number for ascending cuts: even between cuts, odd on a cut."""
    column = F.col(name)
    passed = [(column >= F.lit(c)).cast("int") + (column > F.lit(c)).cast("int") for c in cuts]
    return reduce(add, passed) if passed else F.lit(0)


@dataclass(frozen=True)
class Narrowed:
    """A table cut into cells along its ordering columns, with exact counts."""

    rows: DataFrame  # sort columns, carried columns and the cell of every row
    names: tuple[str, ...]
    cuts: list[float]
    counts: dict[int, int]
    starts: dict[int, int]  # zero-based position of a cell's first row
    sums: dict[int, dict[str, int | None]]

    @property
    def total(self) -> int:
        return sum(self.counts.values())

    def placed(self, cells: Sequence[int], carried: Sequence[str]) -> DataFrame:
        """Distinct rows of some cells with ``rows_before`` counted inside their cell.

        ``carried`` columns depend on the ordering columns only, so any copy
        of a row has them.
        """
        inside = self.rows.where(F.col(_CELL).isin(list(cells)))
        counted = inside.groupBy(_CELL, *self.names).agg(
            F.count(F.lit(1)).alias(ROWS), *[F.max(c).alias(c) for c in carried]
        )
        by = [F.col(n) for n in self.names]
        return slice_values(counted, [_CELL], by).intervals().drop(GROUP_ROWS)


def narrow(
    df: DataFrame, order: Mapping[str, str], shares: Sequence[float], sums: Mapping[str, Column] = {}
) -> Narrowed:
    """Steps 1 and 2: cuts around ``shares`` (0 … 1), exact counts and sums per cell."""
    sort = _sort_columns(df, order)
    names = tuple(sort)
    rows = df.select(*[c.alias(n) for n, c in {**sort, **sums}.items()])
    spread = 2.0 / ACCURACY
    probes = sorted({min(1.0, max(0.0, s + d)) for s in shares for d in (-spread, spread)})
    cuts: list[float] = []
    if probes:
        sketch = rows.agg(F.percentile_approx(names[0], probes, ACCURACY).alias("v")).first()["v"]
        cuts = sorted({float(v) for v in sketch or []})
    celled = rows.withColumn(_CELL, _cell_of(names[0], cuts))
    per_cell = celled.groupBy(_CELL).agg(
        F.count(F.lit(1)).alias(ROWS), *[F.sum(n).alias(n) for n in sums]
    )
    cells = sorted(per_cell.collect(), key=lambda r: r[_CELL])  # 4 · shares + 1 rows at most
    starts, so_far = {}, 0
    for row in cells:
        starts[row[_CELL]] = so_far
        so_far += row[ROWS]
    return Narrowed(
        celled,
        names,
        cuts,
        {r[_CELL]: r[ROWS] for r in cells},
        starts,
        {r[_CELL]: {n: r[n] for n in sums} for r in cells},
    )


def select_positions(
    df: DataFrame,
    order: Mapping[str, str],
    shares: Sequence[float],
    positions: Callable[[int], Sequence[int]],
) -> tuple[int, list[Selected]]:
    """The rows at some zero-based positions of the ordered table, and the row count.

    ``shares`` says roughly where they lie (0 … 1); ``positions`` gives them
    once the row count is known.
    """
    cut = narrow(df, order, shares)
    wanted = sorted(set(positions(cut.total))) if cut.total else []
    home = {p: max(c for c, start in cut.starts.items() if start <= p) for p in wanted}
    found: dict[int, tuple[float, ...]] = {}
    unplaced = []
    for position, cell in home.items():
        if cell % 2 and len(cut.names) == 1:
            found[position] = (cut.cuts[cell // 2],)  # every row of the cell equals the cut
        else:
            unplaced.append((position, cell, position - cut.starts[cell]))
    if unplaced:
        placed = cut.placed(sorted({cell for _, cell, _ in unplaced}), ())
        hit = F.lit(False)
        for _, cell, offset in unplaced:
            hit = hit | (
                (F.col(_CELL) == cell)
                & (F.col(BEFORE) <= offset)
                & (F.col(BEFORE) + F.col(ROWS) > offset)
            )
        hits = placed.where(hit).collect()  # at most one row per wanted position
        for position, cell, offset in unplaced:
            for row in hits:
                if row[_CELL] == cell and row[BEFORE] <= offset < row[BEFORE] + row[ROWS]:
                    found[position] = tuple(row[n] for n in cut.names)
    return cut.total, [Selected(p, found[p]) for p in wanted]


def percentile_of(df: DataFrame, value: str, level: float) -> float | None:
    """The exact continuous percentile of a whole column; NULL when it holds no value."""

    def around(n: int) -> list[int]:
        point = level * (n - 1)
        return [math.floor(point), math.ceil(point)]

    known = df.select(value).where(F.col(value).isNotNull())
    total, selected = select_positions(known, {value: "asc"}, [level], around)
    if not total:
        return None
    low, high = selected[0].sort_values[0], selected[-1].sort_values[0]
    point = level * (total - 1)
    return low + (high - low) * (point - math.floor(point))


def top_share_bound(df: DataFrame, value: str, share: float) -> float | None:
    """The lowest value whose PERCENT_RANK, ordered from the highest down, is ≤ ``share``.

    PERCENT_RANK is (rows above) / (rows − 1), so the value at the last
    position that still satisfies it decides, and its ties go with it.
    """

    def last_inside(n: int) -> list[int]:
        if n == 1:
            return [0]
        position = math.floor(share * (n - 1))
        # Settle on the division the comparison is defined by.
        while (position + 1) / (n - 1) <= share:
            position += 1
        while position / (n - 1) > share:
            position -= 1
        return [position]

    total, selected = select_positions(df, {value: "desc"}, [share], last_inside)
    return -selected[0].sort_values[0] if total else None


def _first_of(tile: int, rows: int, tiles: int) -> int:
    """Zero-based position of a tile's first row: the first ``rows mod tiles`` tiles are longer."""
    size, longer = divmod(rows, tiles)
    return (tile - 1) * size + min(tile - 1, longer)


def tile_totals(
    df: DataFrame,
    order: Mapping[str, str],
    tiles: int,
    sums: Mapping[str, Column],
) -> DataFrame:
    """Row counts and sums per NTILE over the whole table.

    ``order`` maps ordering columns to ``"asc"``/``"desc"`` (NULLs last).
    ``sums`` are integer expressions of the ordering columns only, so copies of
    one value are interchangeable and a run of copies on a tile edge is divided
    by row count. Output: ``tile``, ``rows_in_tile`` and one column per sum.

    Cells inside one tile are done with their exact sums; only rows of cells
    that an edge runs through are looked at again.
    """
    cut = narrow(df, order, [i / tiles for i in range(1, tiles)], sums)
    edges = [_first_of(t, cut.total, tiles) for t in range(1, tiles + 2)]

    def tile_at(position: int) -> int:
        return max(t for t in range(1, tiles + 1) if edges[t - 1] <= position < edges[t])

    whole, split = [], []
    for cell, start in cut.starts.items():
        tile = tile_at(start)
        if tile_at(start + cut.counts[cell] - 1) == tile:
            whole.append((tile, cut.counts[cell], *[cut.sums[cell][n] for n in sums]))
        else:
            split.append(cell)
    spark = df.sparkSession
    fields = ", ".join(["tile bigint", "rows_in_tile bigint", *[f"`{n}` bigint" for n in sums]])
    parts = spark.createDataFrame(whole, fields)
    if split:
        first_row = F.coalesce(
            *[F.when(F.col(_CELL) == c, F.lit(cut.starts[c]).cast("bigint")) for c in split]
        )
        spans = F.array(
            *[
                F.struct(
                    F.lit(t).cast("bigint").alias("tile"),
                    F.lit(edges[t - 1]).cast("bigint").alias("start"),
                    F.lit(edges[t]).cast("bigint").alias("stop"),
                )
                for t in range(1, tiles + 1)
            ]
        )
        placed = cut.placed(split, list(sums)).select(
            (first_row + F.col(BEFORE)).alias("lo"),
            (first_row + F.col(BEFORE) + F.col(ROWS)).alias("hi"),
            *sums,
        )
        # A run of copies meets one tile, or a few when it covers an edge.
        met = F.filter(spans, lambda s: (s["start"] < F.col("hi")) & (s["stop"] > F.col("lo")))
        overlap = F.least("hi", "stop") - F.greatest("lo", "start")
        pieces = placed.select("*", F.inline(met)).withColumn("rows_in_tile", overlap)
        edge_sums = pieces.groupBy("tile").agg(
            F.sum("rows_in_tile").alias("rows_in_tile"),
            *[F.sum(F.col(n) * F.col("rows_in_tile")).alias(n) for n in sums],
        )
        parts = parts.unionByName(edge_sums)
    return parts.groupBy("tile").agg(
        F.sum("rows_in_tile").alias("rows_in_tile"), *[F.sum(n).alias(n) for n in sums]
    )
