"""Bringing a frame to a declared target schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.columns import DEFAULT_ZERO_COLUMNS

FLAG_COLUMN = "store_and_fwd_flag"


def _lookup(columns: Sequence[str]) -> dict[str, str]:
    """Lower-cased name → real name; drift changes the case of a name between files."""
    found: dict[str, str] = {}
    for column in columns:
        if column.lower() in found:
            raise ValueError(f"columns {found[column.lower()]!r} and {column!r} differ only in case")
        found[column.lower()] = column
    return found


def schema_gap(columns: Sequence[str], target: T.StructType) -> tuple[list[str], list[str]]:
    """Names the target has and the source lacks, and the other way round."""
    wanted = {f.name.lower() for f in target.fields}
    have = _lookup(columns)
    missing = [f.name for f in target.fields if f.name.lower() not in have]
    extra = [name for low, name in have.items() if low not in wanted]
    return missing, extra


def _cast(column: Column, source: T.DataType, target: T.DataType) -> Column:
    if source == target:
        return column
    if isinstance(source, T.StringType) and isinstance(target, T.IntegralType):
        # Text exports write nullable integers as "1.0".
        return column.cast("decimal(38,6)").cast(target)
    return column.cast(target)


def align_schema(
    df: DataFrame, target: T.StructType, keep: Sequence[str] = ()
) -> DataFrame:
    """e_align_schema: target columns in target order and type; missing → NULL, extra dropped.

    ``keep`` names bookkeeping columns (``source_file``) carried along behind them.
    """
    have = _lookup(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}

    def column(field: T.StructField) -> Column:
        name = have.get(field.name.lower())
        if name is None:
            return F.lit(None).cast(field.dataType).alias(field.name)
        return _cast(F.col(f"`{name}`"), types[name], field.dataType).alias(field.name)

    return df.select(*[column(f) for f in target.fields], *keep)


def default_fill(df: DataFrame, zero: Sequence[str] = DEFAULT_ZERO_COLUMNS) -> DataFrame:
    """e_default_fill: an unknown flag is 'N'; fee columns the source lacks are 0.0.

    A fee column that exists keeps its NULLs.
    """
    have = _lookup(df.columns)
    absent = {name: F.lit(0.0) for name in zero if name.lower() not in have}
    filled = df.withColumns(absent) if absent else df
    flag = have.get(FLAG_COLUMN)
    return filled if flag is None else filled.fillna("N", subset=[flag])


def union_by_name(*frames: DataFrame) -> DataFrame:
    """s_union_by_name: UNION ALL by column name, a column missing on one side is NULL there."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result
