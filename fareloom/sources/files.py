"""Parquet files in a folder tree: listing, footers, and one frame over drifting schemas.

Spark's own ``mergeSchema`` rejects int/long and long/double drift, and a
declared wide schema fails on a file that stores the narrow type. So files are
grouped by the schema in their footer, each group is read as what it is, cast
to the target, and the groups are unioned by name.
"""

from __future__ import annotations

import csv
import json
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.sources.schema import align_schema
from fareloom.staging import path_exists, stage

SOURCE_FILE = "source_file"
# Fixed value: where file names carry their month.
FILE_MONTH = r"(\d{4})-(\d{2})"

LISTING = "path string, source_file string, file_name string, bytes bigint, modified timestamp"
FOOTERS = (
    "path string, source_file string, file_name string, bytes bigint, modified timestamp, "
    "rows bigint, null_count bigint, stored_bytes bigint, raw_bytes bigint, "
    "schema_key string, error string"
)


def list_files(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """One row per file under ``root`` at any depth; no rows for a missing folder.

    Only file metadata is read: the content column is pruned.
    """
    if not path_exists(spark, root):
        return spark.createDataFrame([], LISTING)
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(
            "path",
            F.col("_metadata.file_path").alias(SOURCE_FILE),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("length").alias("bytes"),
            F.col("modificationTime").alias("modified"),
        )
    )


def file_month(name: str | Column) -> Column:
    """e_parse_file_date: first day of the month in a file name, NULL without one."""
    name = F.col(name) if isinstance(name, str) else name
    year, month = (F.regexp_extract(name, FILE_MONTH, i) for i in (1, 2))
    text = F.concat_ws("-", year, month, F.lit("01"))
    return F.when(year != "", F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def read_footers(files: DataFrame) -> DataFrame:
    """Rows, NULLs, sizes and schema of every file, from footers read inside tasks.

    No data page is touched. An unreadable file gets an ``error`` instead.
    The helpers are nested so they travel with the task: executors need
    pyarrow, not this package.
    """
    numbers = ("rows", "null_count", "stored_bytes", "raw_bytes")
    unknown = dict.fromkeys((*numbers, "schema_key", "error"))

    def footer(path: str) -> dict:
        import pyarrow.parquet as pq
        from pyarrow import fs

        scheme, colon, rest = path.partition("://")
        if scheme in ("s3a", "s3n"):  # Spark's names for one store
            path = "s3" + colon + rest
        if path.startswith("file:"):
            filesystem, inner = fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
        else:
            filesystem, inner = fs.FileSystem.from_uri(path)
        with filesystem.open_input_file(inner) as handle:
            meta = pq.ParquetFile(handle).metadata
        groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
        chunks = [group.column(c) for group in groups for c in range(group.num_columns)]
        counted = all(c.is_stats_set and c.statistics.has_null_count for c in chunks)
        fields = [[f.name, str(f.type)] for f in meta.schema.to_arrow_schema()]
        return {
            "rows": meta.num_rows,
            "null_count": sum(c.statistics.null_count for c in chunks) if counted else None,
            "stored_bytes": sum(c.total_compressed_size for c in chunks),
            "raw_bytes": sum(c.total_uncompressed_size for c in chunks),
            "schema_key": json.dumps(fields),
            "error": None,
        }

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path in batch["path"]:
                try:
                    found.append(footer(path))
                except Exception as problem:  # a bad file becomes a row, not a failed job
                    found.append({**unknown, "error": f"{type(problem).__name__}: {problem}"})
            details = pd.DataFrame(found, columns=list(unknown), index=batch.index)
            for name in numbers:
                details[name] = details[name].astype("Int64")
            yield pd.concat([batch, details], axis=1)

    return files.mapInPandas(probe, FOOTERS)


def read_drifting(
    footers: DataFrame, target: T.StructType | None = None, skip_unreadable: bool = False
) -> DataFrame:
    """e_scan_parquet_glob: every file as one frame with a ``source_file`` column.

    A file whose footer can't be read raises; ``skip_unreadable`` leaves such
    files out, for callers that report them.

    Without a target the columns are the union of all files, by lower-cased
    name. Partition folders in the paths are ignored. The driver sees one path
    per file, which is what its file index holds for any scan.
    """
    spark = footers.sparkSession
    groups: dict[str, list[str]] = defaultdict(list)
    if not skip_unreadable:
        broken = footers.where(F.col("error").isNotNull()).select("path", "error").take(3)
        if broken:
            raise ValueError("unreadable: " + "; ".join(f"{r['path']}: {r['error']}" for r in broken))
    readable = footers.where(F.col("error").isNull()).select("schema_key", "path")
    for row in readable.toLocalIterator():
        groups[row["schema_key"]].append(row["path"])
    if not groups:
        if target is None:
            raise ValueError("no readable file and no target schema")
        return spark.createDataFrame([], target).withColumn(SOURCE_FILE, F.lit("").cast("string"))
    frames = [_read_group(spark, groups[key], target) for key in sorted(groups)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _read_group(spark: SparkSession, paths: Sequence[str], target: T.StructType | None) -> DataFrame:
    # Listing the paths one by one keeps folder names out of the schema.
    frame = spark.read.option("recursiveFileLookup", "true").parquet(*paths)
    named = frame.select("*", F.col("_metadata.file_path").alias(SOURCE_FILE))
    if target is not None:
        return align_schema(named, target, keep=[SOURCE_FILE])
    return named.toDF(*[c.lower() for c in named.columns])


def scan_folder(spark: SparkSession, root: str, target: T.StructType | None = None) -> DataFrame:
    """All Parquet files under ``root``, whatever their schema generation; an unreadable one raises."""
    return read_drifting(stage(read_footers(list_files(spark, root)), "footers"), target)


def scan_hive(spark: SparkSession, root: str) -> DataFrame:
    """e_scan_hive: a partitioned set of any depth, partition folders as columns."""
    return spark.read.parquet(root)


def scan_csv(spark: SparkSession, path: str, target: T.StructType) -> DataFrame:
    """e_scan_csv: text with a header line, typed by column name.

    Every file is read by its own header line: Spark takes one file's header for
    all, so files are grouped by it first. The first lines are gathered in
    tasks; one path per file comes to the driver, as for any scan. Fee columns
    that a group of files lacks are filled for that group.
    """
    from fareloom.sources.schema import default_fill

    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    first = lines.where(F.col("_metadata.file_block_start") == 0)
    heads = first.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.first("value").alias("head"))
    groups: dict[str, list[str]] = defaultdict(list)
    for row in stage(heads, "csv-heads").toLocalIterator():
        groups[row["head"]].append(row["path"])
    if not groups:
        return spark.createDataFrame([], target)
    frames = []
    for head in sorted(groups):
        names = next(csv.reader([head]))
        schema = T.StructType([T.StructField(n.strip(), T.StringType()) for n in names])
        text = spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").csv(groups[head])
        frames.append(align_schema(default_fill(text), target))
    return reduce(lambda a, b: a.unionByName(b), frames)
