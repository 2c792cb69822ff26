"""Dropping duplicate rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """r_dedup without keys: one of each identical row."""
    return df.distinct()


def drop_keyed_duplicates(
    df: DataFrame, keys: Sequence[str], latest_by: Sequence[str] = ()
) -> DataFrame:
    """r_dedup: one row per key, the one greatest in ``latest_by``.

    The remaining columns break ties, so the winner is always the same row. A
    maximum per key combines before the shuffle: copies of one key leave each
    task as a single row, however many there are. A maximum of rows is no
    fixed-size buffer, so both steps sort by key; ``row_number() = 1`` is limited
    before the shuffle as well, and sorts by all columns.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    leading = [c for c in latest_by if c in rest]
    ordered = leading + [c for c in rest if c not in leading]
    best = df.groupBy(*keys).agg(F.max(F.struct(*ordered)).alias("best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"best.`{c}`") for c in df.columns])
