"""Run a registered query on Spark and its SQL on DuckDB, and compare every value."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


# Spark and DuckDB names for one type.
TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def sort_key(row):
    return tuple((v is None, str(v)) for v in row)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences as text; an empty list means equal columns, types and values."""
    relation = con.sql(sql)
    want_types = dict(zip(relation.columns, [str(t) for t in relation.types]))
    got_types = {f.name: TYPES.get(f.dataType.simpleString(), "?") for f in spark_df.schema.fields}
    if got_types != want_types:
        return [f"schema {got_types} != {want_types}"]
    names = sorted(got_types)
    got = sorted((tuple(r[n] for n in names) for r in spark_df.collect()), key=sort_key)
    at = [relation.columns.index(n) for n in names]
    want = sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=sort_key)
    if len(got) != len(want):
        return [f"{len(got)} rows != {len(want)}"]
    if not want:
        return ["no rows at all"]
    return [f"{g} != {w}" for g, w in zip(got, want) if not _equal(g, w)]


def _equal(got, want) -> bool:
    for g, w in zip(got, want):
        if isinstance(g, float) and isinstance(w, float):
            if not (g == w or (math.isnan(g) and math.isnan(w))):
                return False
        elif g != w:
            return False
    return True
