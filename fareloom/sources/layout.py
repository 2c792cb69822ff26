"""What a table looks like per partition, and which columns would partition it well."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fareloom.functions.times import month_number, year_of
from fareloom.operators.ordering import with_scalars


def partition_profile(df: DataFrame, pickup: str, yearly_up_to: int = 3) -> DataFrame:
    """e_partition_profile: rows, files and bytes per month, and the loading strategy.

    ``df`` must come straight from files. A file's size counts once per month
    it holds rows of. Up to ``yearly_up_to`` months a table is loaded by year,
    beyond that by month.
    """
    per_file = df.groupBy(
        year_of(pickup).alias("year"),
        month_number(pickup).alias("month"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
    ).agg(F.count(F.lit(1)).alias("n"))
    per_month = per_file.groupBy("year", "month").agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("bytes"),
    )
    # One row per month from here on, so counting them in one task is cheap.
    months = F.count(F.lit(1)).over(Window.partitionBy())
    strategy = F.when(months <= yearly_up_to, "yearly").otherwise("monthly")
    return per_month.select(
        "year",
        "month",
        "rows",
        "files",
        "bytes",
        (F.col("bytes") / F.lit(float(1 << 30))).alias("gigabytes"),
        strategy.alias("strategy"),
    ).orderBy("year", "month")


def suggest_partitioning(
    df: DataFrame, pickup: str, max_partitions: int = 10_000, worth_from_gb: float = 1.0
) -> DataFrame:
    """e_suggest_partitioning: exact cardinality of the date-part layouts of a timestamp column.

    The finest layout with at most ``max_partitions`` folders is the suggested
    one; ``should_partition`` says whether the table is worth it: from
    ``worth_from_gb`` on, with more than one folder. ``reason`` says why or why
    not. ``df`` must come straight from files, whose sizes are added up. Rows
    without a time belong to no folder. Times are reduced to distinct days
    first, so only days are shuffled; the files' sizes need no column at all.
    """
    days = df.groupBy(F.to_date(pickup).alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    counted = days.agg(
        F.count_distinct(F.year("day")).alias("year"),
        F.count_distinct(F.trunc("day", "month")).alias("month"),
        F.count("day").alias("day"),
    )
    files = df.groupBy(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")
    ).agg(F.count(F.lit(1)).alias("rows"))
    size = files.agg((F.coalesce(F.sum("size"), F.lit(0)) / F.lit(float(1 << 30))).alias("size_gb"))
    # One row from here on: the three cardinalities, turned into three rows.
    names = {"year": "year", "year,month": "month", "year,month,day": "day"}
    layouts = F.array(
        *[
            F.struct(F.lit(n).alias("layout"), F.col(c).alias("partitions"), F.lit(i).alias("depth"))
            for i, (n, c) in enumerate(names.items())
        ]
    )
    fits = F.filter(layouts, lambda x: (x["partitions"] <= max_partitions) & (x["partitions"] > 0))
    best = F.array_max(F.transform(fits, lambda x: F.struct(x["depth"], x["partitions"])))
    sized = with_scalars(
        counted.select(best.alias("best"), F.col("day").alias("day_count"), F.inline(layouts)), size
    )
    large, several = F.col("size_gb") >= worth_from_gb, F.col("best.partitions") > 1
    reason = (
        F.when(F.col("day_count") == 0, "no row has a time")
        .when(F.col("best").isNull(), f"every layout has more than {max_partitions} folders")
        .when(~several, "all rows fall into one folder")
        .when(~large, f"smaller than {worth_from_gb:g} GB")
        .otherwise(f"{worth_from_gb:g} GB or more, with a time column")
    )
    return sized.select(
        "layout",
        "partitions",
        F.col("depth").eqNullSafe(F.col("best.depth")).alias("suggested"),
        "size_gb",
        F.coalesce(large & several, F.lit(False)).alias("should_partition"),
        reason.alias("reason"),
    )
