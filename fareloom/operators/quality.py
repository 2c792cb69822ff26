"""Fingerprints, validation, comparison of copies, and the run audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.columns import TripColumns
from fareloom.functions.numbers import fixed, from_fixed, mean_of, round2, total_of
from fareloom.functions.times import day_of, year_of
from fareloom.operators.corpus import TRIPS, rows
from fareloom.operators.selection import percentile_of
from fareloom.staging import stage

# Helper columns of ``compare_rows``; the side is 1 for a row of the left copy, -1 for one of the right.
SIDE, CELL, LEFT, RIGHT = "__side", "__cell", "__left", "__right"


def table_fingerprint(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """v_table_fingerprint: one row that two equal copies share."""
    return trips.agg(
        rows().alias("row_count"),
        F.count_distinct(c.vendor).alias("vendors"),
        F.min(c.pickup).alias("min_date"),
        F.max(c.pickup).alias("max_date"),
        round2(mean_of(c.total)).alias("avg_fare"),
        round2(total_of(c.total)).alias("total_revenue"),
    )


def _per_route(trips: DataFrame, c: TripColumns, **sums: Column) -> DataFrame:
    """Rows and sums per (vendor, zones): few rows, from which all distinct counts are taken.

    Several distinct counts over the trips themselves would make every row as
    many rows as there are counts.
    """
    return trips.groupBy(
        F.col(c.vendor).alias("vendor"),
        F.col(c.pickup_zone).alias("pickup_zone"),
        F.col(c.dropoff_zone).alias("dropoff_zone"),
    ).agg(
        rows().alias("n"),
        F.min(c.pickup).alias("min_date"),
        F.max(c.pickup).alias("max_date"),
        *[e.alias(name) for name, e in sums.items()],
    )


def _counts() -> list[Column]:
    """Rows and distinct values out of ``_per_route``."""
    return [
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.count_distinct("vendor").alias("vendors"),
        F.count_distinct("pickup_zone").alias("pickup_locations"),
        F.count_distinct("dropoff_zone").alias("dropoff_locations"),
    ]


def _mean_from(units: str, known: str) -> Column:
    return from_fixed(F.sum(units)) / F.nullif(F.sum(known), F.lit(0))


def data_stats(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """v_data_stats: the fingerprint with distinct zones."""
    routes = _per_route(trips, c, total=F.sum(fixed(c.total)), totals=F.count(c.total))
    return routes.agg(
        *_counts(),
        F.min("min_date").alias("min_date"),
        F.max("max_date").alias("max_date"),
        round2(_mean_from("total", "totals")).alias("avg_fare"),
        round2(from_fixed(F.sum("total"))).alias("total_revenue"),
    )


def quality_profile(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """v_quality_profile: rows, distinct counts, means and the exact 95th percentile fare."""
    p95 = F.lit(percentile_of(trips, c.fare, 0.95)).cast("double")
    routes = _per_route(
        trips,
        c,
        fare=F.sum(fixed(c.fare)),
        fares=F.count(c.fare),
        distance=F.sum(fixed(c.distance)),
        distances=F.count(c.distance),
    )
    return routes.agg(
        *_counts(),
        _mean_from("fare", "fares").alias("avg_fare"),
        _mean_from("distance", "distances").alias("avg_distance"),
        p95.alias("p95_fare"),
    )


def _as_text(field: T.StructField) -> Column:
    """Text that does not depend on how an engine prints a type: two decimals, whole seconds."""
    column = F.col(field.name)
    if isinstance(field.dataType, T.DoubleType):
        return column.cast("decimal(38,2)").cast("string")
    if isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    return column.cast("string")


def _as_metrics(one_row: DataFrame, value: str) -> DataFrame:
    """A one-row frame as (metric, value-as-text) rows."""
    pairs = [
        F.struct(F.lit(f.name).alias("metric"), _as_text(f).alias(value))
        for f in one_row.schema.fields
    ]
    return one_row.select(F.inline(F.array(*pairs)))


def compare_tables(left: DataFrame, right: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """v_compare_tables: the fingerprints of two copies side by side, with a match flag."""
    a = _as_metrics(table_fingerprint(left, c), "left_value")
    b = _as_metrics(table_fingerprint(right, c), "right_value")
    return a.join(b, "metric", "full_outer").select(
        "metric",
        "left_value",
        "right_value",
        F.col("left_value").eqNullSafe(F.col("right_value")).alias("matches"),
    )


def compare_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], cells: int = 1 << 16) -> DataFrame:
    """v_compare_rows: the keys under which two copies hold different rows, whatever their totals say.

    Both copies are first summed up by cell, a hash of the key: row count and
    the sum of a 64-bit digest of whole rows, which no order of rows changes.
    Cells that agree are done, so equal copies cost one scan each and a shuffle
    of at most ``cells`` sums a task. The rows of the others are cut into as
    many cells once more, by another hash, and only those of differing cells
    are compared as rows; repeated rows count as often as they occur.

    (keys, status, left_rows, right_rows, columns): rows of the key that the
    other side lacks, and, where each side has one of them, the names of the
    columns that differ, in table order and separated by commas. ``status`` is
    ``left``, ``right`` or ``changed``. Columns are matched by name.
    """
    names = left.columns
    if sorted(names) != sorted(right.columns):
        raise ValueError(f"columns differ: {sorted(set(names) ^ set(right.columns))}")
    sides = left.select(*names, F.lit(1).alias(SIDE)).unionByName(right.select(*names, F.lit(-1).alias(SIDE)))
    for level in ("compare-cells", "compare-inner-cells"):
        cell = F.pmod(F.xxhash64(F.lit(level), *keys), F.lit(cells)).cast("int")
        digest = F.xxhash64(*names)
        # Halves of the digest: sums of whole numbers that cannot overflow below 2^31 rows in a cell.
        high, low = F.shiftright(digest, 32), digest.bitwiseAND(F.lit(0xFFFFFFFF))
        sums = sides.groupBy(cell.alias(CELL)).agg(
            F.sum(SIDE).alias("n"), F.sum(F.col(SIDE) * high).alias("high"), F.sum(F.col(SIDE) * low).alias("low")
        )
        differing = stage(sums.where("n != 0 or high != 0 or low != 0").select(CELL), level)
        # Staged, so its true (small) size lets Spark broadcast it.
        sides = sides.join(differing, cell == F.col(CELL), "left_semi")
    lone = sides.groupBy(*names).agg(F.sum(SIDE).alias(SIDE)).where(F.col(SIDE) != 0)
    rest = [n for n in names if n not in keys]
    values = F.struct(*rest) if rest else F.struct(F.lit(None).alias("none"))
    found = lone.groupBy(*keys).agg(
        F.sum(F.greatest(SIDE, F.lit(0))).alias("left_rows"),
        F.sum(F.greatest(-F.col(SIDE), F.lit(0))).alias("right_rows"),
        F.max(F.when(F.col(SIDE) > 0, values)).alias(LEFT),
        F.max(F.when(F.col(SIDE) < 0, values)).alias(RIGHT),
    )
    status = F.when(F.col("right_rows") == 0, "left").when(F.col("left_rows") == 0, "right").otherwise("changed")
    unlike = [F.when(~F.col(LEFT)[n].eqNullSafe(F.col(RIGHT)[n]), n) for n in rest]
    both_one = (F.col("left_rows") == 1) & (F.col("right_rows") == 1)
    changed = F.when(both_one, F.concat_ws(",", *unlike)).otherwise("")
    return found.select(*keys, status.alias("status"), "left_rows", "right_rows", changed.alias("columns"))


def group_key_diagnostics(left: DataFrame, right: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """v_group_key_diagnostics: distinct grouping keys of two copies, to find where they differ."""

    def keys(df: DataFrame, value: str) -> DataFrame:
        day = day_of(c.pickup)
        counted = df.select(day.alias("d"), F.col(c.vendor).alias("v")).agg(
            F.count_distinct("d").alias("unique_dates"),
            F.count_distinct(F.struct("d", "v")).alias("date_vendor_pairs"),
        )
        return _as_metrics(counted, value)

    both = keys(left, "left_value").join(keys(right, "right_value"), "metric", "full_outer")
    a, b = F.col("left_value").cast("bigint"), F.col("right_value").cast("bigint")
    return both.select(
        "metric", a.alias("left_value"), b.alias("right_value"), a.eqNullSafe(b).alias("matches")
    )


def validate(trips: DataFrame, c: TripColumns = TRIPS) -> DataFrame:
    """v_validate: rows per year with the table's totals and a status.

    An empty table yields one row without a year, with 0 rows and the status
    ``empty``; a table without the needed columns fails.
    """
    missing = [n for n in (c.pickup, c.total) if n not in trips.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; the table has {trips.columns}")
    per_year = trips.groupBy(year_of(c.pickup).alias("year")).agg(rows().alias("year_rows"))
    # One row per year from here on, gathered so that no year at all is a row too.
    whole = per_year.agg(
        F.coalesce(F.sum("year_rows"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.collect_list(F.struct("year", "year_rows")).alias("years"),
    )
    return whole.select("total_rows", F.inline_outer("years")).select(
        "year",
        F.coalesce("year_rows", F.lit(0)).cast("bigint").alias("year_rows"),
        "total_rows",
        F.lit(len(trips.columns)).cast("bigint").alias("column_count"),
        F.when(F.col("total_rows") == 0, "empty").otherwise("valid").alias("status"),
    ).orderBy("year")


def null_counts(df: DataFrame) -> DataFrame:
    """v_null_counts: NULLs per column and in the whole table, in one pass."""
    counted = df.agg(*[F.count_if(F.col(f"`{n}`").isNull()).alias(n) for n in df.columns])
    names = [F.col(f"`{n}`") for n in df.columns]
    everything = names[0]
    for name in names[1:]:
        everything = everything + name
    pairs = [
        F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").alias("nulls")) for n in df.columns
    ]
    total = F.struct(F.lit("(all)").alias("column_name"), everything.alias("nulls"))
    return counted.select(F.inline(F.array(*pairs, total)))


def trip_rules(c: TripColumns = TRIPS) -> dict[str, Column]:
    """Conditions a trip row should not meet."""
    return {"negative_fare": F.col(c.fare) < 0}


def rule_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """v_negative_fares and its like: violations per rule, all rules in one pass."""
    counted = df.agg(*[F.count_if(condition).alias(name) for name, condition in rules.items()])
    pairs = [F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]
    return counted.select(F.inline(F.array(*pairs)))


def require_clean(df: DataFrame, rules: Mapping[str, Column]) -> None:
    """Raise when any rule is violated."""
    broken = rule_violations(df, rules).where("violations > 0").collect()  # one row per rule
    if broken:
        found = ", ".join(f"{r['rule']}: {r['violations']}" for r in broken)
        raise ValueError(f"data quality: {found}")


def row_reconcile(
    manifest: DataFrame, table: DataFrame, file_column: str, c: TripColumns = TRIPS
) -> DataFrame:
    """v_row_reconcile: rows promised per source file against rows in the table.

    ``manifest`` has one row per file: ``file_column`` and ``rows``.
    """
    loaded = table.groupBy(file_column).agg(
        rows().alias("table_rows"),
        F.min(c.pickup).alias("min_date"),
        F.max(c.pickup).alias("max_date"),
    )
    promised = manifest.select(file_column, F.col("rows").alias("file_rows"))
    return promised.join(loaded, file_column, "full_outer").select(
        file_column,
        F.coalesce("file_rows", F.lit(0).cast("bigint")).alias("file_rows"),
        F.coalesce("table_rows", F.lit(0).cast("bigint")).alias("table_rows"),
        "min_date",
        "max_date",
        F.col("file_rows").eqNullSafe(F.col("table_rows")).alias("matches"),
    )


RUN_AUDIT = (
    "run_id string, pipeline_id string, writer_id string, status string, "
    "started_at timestamp_ntz, ended_at timestamp_ntz, rows_written bigint, "
    "bytes_written bigint, metadata map<string,string>"
)


def latest_runs(audit: DataFrame) -> DataFrame:
    """The last state of every run; the audit itself is append-only.

    A run writes one row when it starts and one when it ends.
    """
    order = F.struct(F.col("ended_at").isNotNull(), "ended_at", "started_at")
    state = F.struct("status", "started_at", "ended_at", "rows_written", "bytes_written")
    return (
        audit.groupBy("run_id", "pipeline_id", "writer_id")
        .agg(F.max_by(state, order).alias("s"))
        .select("run_id", "pipeline_id", "writer_id", "s.*")
    )


def audit_report(audit: DataFrame) -> DataFrame:
    """v_run_audit: runs, rows and bytes per final status."""
    return (
        latest_runs(audit)
        .groupBy("status")
        .agg(
            rows().alias("runs"),
            F.coalesce(F.sum("rows_written"), F.lit(0).cast("bigint")).alias("rows_written"),
            F.coalesce(F.sum("bytes_written"), F.lit(0).cast("bigint")).alias("bytes_written"),
            F.min("started_at").alias("first_start"),
            F.max("ended_at").alias("last_end"),
        )
        .orderBy("status")
    )
