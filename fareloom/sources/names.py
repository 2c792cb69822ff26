"""Column names: normal forms and lenient lookup. Works on names only, never on rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

# Normal names of the trip columns (with the two renamed ones).
RENAMED = {
    "tpep_pickup_datetime": "pickup_datetime",
    "tpep_dropoff_datetime": "dropoff_datetime",
}
KNOWN = (
    "trip_distance",
    "passenger_count",
    "fare_amount",
    "extra",
    "mta_tax",
    "tip_amount",
    "tolls_amount",
    "total_amount",
    "payment_type",
    "trip_type",
    "airport_fee",
    "cbd_congestion_surcharge",
    "pulocationid",
    "dolocationid",
    "vendorid",
)
PREFIX = "tpep_"


def _squeezed(name: str) -> str:
    return name.lower().replace(PREFIX, "").replace("_", "")


_NORMAL = {**RENAMED, **{name: name for name in KNOWN}}
_BY_SQUEEZED = {_squeezed(name): normal for name, normal in _NORMAL.items()}


def normal_name(name: str) -> str:
    """The normal form of one column name.

    An exact (case-blind) match first, then one that ignores underscores and
    the meter prefix, else lower case with blanks as underscores.
    """
    lowered = name.lower()
    return _NORMAL.get(lowered) or _BY_SQUEEZED.get(_squeezed(name)) or lowered.replace(" ", "_")


def normalize_columns(df: DataFrame) -> DataFrame:
    """e_normalize_columns: rename every column to its normal form."""
    names = [normal_name(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"columns {df.columns} collide after normalisation: {clashes}")
    return df.toDF(*names)


def find_column(wanted: str, available: Iterable[str]) -> str | None:
    """The column meant by ``wanted``: exact, with meter prefix, by suffix, in any case."""
    columns = list(available)
    folded = wanted.lower()
    tests = (
        lambda c: c == wanted,
        lambda c: c == PREFIX + wanted,
        lambda c: c.endswith(wanted),
        lambda c: c.lower() == folded,
        lambda c: _squeezed(c) == _squeezed(wanted),
    )
    for test in tests:
        for column in columns:
            if test(column):
                return column
    return None
