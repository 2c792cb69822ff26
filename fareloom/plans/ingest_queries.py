"""Registry of the load, layout, quality, versioning and streaming jobs.

Every job runs on the whole of a given table: the table is landed in scratch
as the files the job expects (several schema generations, month folders, text)
and the job's result is reported from what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom.columns import TripColumns
from fareloom.functions.numbers import total_of
from fareloom.functions.times import day_of, ntz, year_of
from fareloom.operators import analytics as a
from fareloom.operators import quality as v
from fareloom.operators.corpus import rows
from fareloom.operators.dedup import drop_keyed_duplicates
from fareloom.operators.versions import append_version, current_rows, open_version, read_version, rows_as_of, with_validity
from fareloom.plans.bindings import EVENT_TRIPS_SQL, event_trips, lineitem_trips, table
from fareloom.plans.corpus_queries import DAY, REVENUE
from fareloom.plans.entry import Query, dec_avg, on_lineitem, r2, with_trips
from fareloom.sinks.writers import (
    CODECS,
    write_csv,
    write_hive_partitioned,
    write_parquet,
    write_table,
)
from fareloom.sources import daily, files, ingest, layout, sync
from fareloom.sources.names import normalize_columns
from fareloom.sources.schema import align_schema, default_fill, union_by_name
from fareloom.staging import scratch_path
from fareloom.streaming import streams

PICKUP = "tpep_pickup_datetime"
NORMAL = TripColumns(
    vendor="vendorid", pickup="pickup_datetime", pickup_zone="pulocationid", dropoff_zone="dolocationid"
)
LATE = "1998-01-01"
FEE_FROM = "1997-01-01"

# What the landed lineitem trips are aligned to.
TARGET = T.StructType(
    [
        T.StructField("VendorID", T.LongType()),
        T.StructField(PICKUP, T.TimestampNTZType()),
        T.StructField("passenger_count", T.DoubleType()),
        T.StructField("trip_distance", T.DoubleType()),
        T.StructField("total_amount", T.DoubleType()),
        T.StructField("airport_fee", T.DoubleType()),
        T.StructField("cbd_congestion_fee", T.DoubleType()),
    ]
)

YEAR_SQL = "CAST(year(tpep_pickup_datetime) AS BIGINT)"
MONTH_SQL = "CAST(month(tpep_pickup_datetime) AS BIGINT)"
GENERATION_SQL = (
    f"CASE WHEN tpep_pickup_datetime < TIMESTAMP '{FEE_FROM}' THEN 1 "
    f"WHEN tpep_pickup_datetime < TIMESTAMP '{LATE}' THEN 2 ELSE 3 END"
)


def _land_generations(spark: SparkSession, sf: str) -> str:
    """lineitem trips as three schema generations, the way yearly exports drift.

    First narrow types and no fee, then the fee under a capitalised name, then
    the full set with a new column and one the target does not know.
    """
    trips = lineitem_trips(spark, sf).select(
        "VendorID", PICKUP, "passenger_count", "trip_distance", "total_amount", "airport_fee"
    )
    root = scratch_path(spark, "generations")
    pickup = F.col(PICKUP)
    trips.where(pickup < ntz(FEE_FROM)).select(
        F.col("VendorID").cast("int").alias("VendorID"),
        PICKUP,
        F.col("passenger_count").cast("bigint").alias("passenger_count"),
        "trip_distance",
        "total_amount",
    ).write.parquet(f"{root}/first")
    trips.where((pickup >= ntz(FEE_FROM)) & (pickup < ntz(LATE))).withColumnRenamed(
        "airport_fee", "Airport_fee"
    ).write.parquet(f"{root}/second")
    trips.where(pickup >= ntz(LATE)).withColumns(
        {"cbd_congestion_fee": F.col("airport_fee") * 2, "unknown_column": F.lit("x")}
    ).write.parquet(f"{root}/third")
    return root


def _land_years(spark: SparkSession, sf: str) -> str:
    """lineitem trips as one folder of files per year."""
    root = scratch_path(spark, "years")
    _add_years(lineitem_trips(spark, sf), root)
    return root


def _add_years(trips: DataFrame, root: str) -> None:
    by_year = trips.withColumn("load_year", F.year(PICKUP)).hint("rebalance", "load_year")
    by_year.write.mode("append").partitionBy("load_year").parquet(root)


def _yearly(df: DataFrame) -> DataFrame:
    return df.groupBy(year_of(PICKUP).alias("year")).agg(
        rows().alias("trips"), total_of("total_amount").alias("revenue")
    )


YEARLY_SQL = f"SELECT {YEAR_SQL} AS year, COUNT(*) AS trips, {REVENUE} AS revenue FROM trips GROUP BY 1"


def scan_generations(spark: SparkSession, sf: str) -> DataFrame:
    scanned = files.scan_folder(spark, _land_generations(spark, sf), TARGET)
    return _fee_report(scanned)


def _fee_report(df: DataFrame) -> DataFrame:
    return df.groupBy(year_of(PICKUP).alias("year")).agg(
        rows().alias("trips"),
        total_of("total_amount").alias("revenue"),
        F.count("airport_fee").alias("with_airport_fee"),
        total_of("cbd_congestion_fee").alias("congestion_fees"),
        F.sum(F.col("passenger_count")).alias("passengers"),
    )


FEE_REPORT_SQL = f"""
    , g AS (SELECT *, {GENERATION_SQL} AS gen FROM trips)
    SELECT {YEAR_SQL} AS year, COUNT(*) AS trips, {REVENUE} AS revenue,
           COUNT(CASE WHEN gen > 1 THEN airport_fee END) AS with_airport_fee,
           CAST(SUM(CASE WHEN gen = 3 THEN CAST(airport_fee * 2 AS DECIMAL(18,2)) END) AS DOUBLE)
             AS congestion_fees,
           SUM(passenger_count) AS passengers
    FROM g GROUP BY 1"""


def _hive_copy(spark: SparkSession, sf: str) -> str:
    root = scratch_path(spark, "hive")
    write_hive_partitioned(lineitem_trips(spark, sf), root, PICKUP, sort=["VendorID"])
    return root


def hive_totals(spark: SparkSession, sf: str) -> DataFrame:
    scanned = files.scan_hive(spark, _hive_copy(spark, sf))
    return scanned.groupBy(
        F.col("year").cast("bigint").alias("year"), F.col("month").cast("bigint").alias("month")
    ).agg(rows().alias("trips"), total_of("total_amount").alias("revenue"))


def months_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """All months written, then the months of 1996 once more with fewer rows; per folder what it holds."""
    root = _hive_copy(spark, sf)
    trips = lineitem_trips(spark, sf)
    longer = trips.where((F.year(PICKUP) == 1996) & (F.col("trip_distance") >= 25))
    short = longer.withColumn("tip_amount", F.when(F.col("VendorID") > 1, F.col("tip_amount")))
    write_hive_partitioned(short, root, PICKUP, codec="gzip", sort=["VendorID"])
    kept = files.scan_hive(spark, root)
    return kept.groupBy(F.col("year").cast("bigint").alias("year"), F.col("month").cast("bigint").alias("month")).agg(
        rows().alias("trips"),
        total_of("total_amount").alias("revenue"),
        (rows() - F.count("tip_amount")).alias("nulls"),
        F.min(PICKUP).alias("first_pickup"),
        F.max(PICKUP).alias("last_pickup"),
    )


MONTHS_REPLACED_SQL = f"""
    , kept AS (SELECT * REPLACE (CASE WHEN {YEAR_SQL} <> 1996 OR VendorID > 1 THEN tip_amount END AS tip_amount)
               FROM trips WHERE {YEAR_SQL} <> 1996 OR trip_distance >= 25)
    SELECT {YEAR_SQL} AS year, {MONTH_SQL} AS month, COUNT(*) AS trips, {REVENUE} AS revenue,
           COUNT(*) - COUNT(tip_amount) AS nulls,
           MIN(tpep_pickup_datetime) AS first_pickup, MAX(tpep_pickup_datetime) AS last_pickup
    FROM kept GROUP BY 1, 2"""

HIVE_SQL = f"""
    SELECT {YEAR_SQL} AS year, {MONTH_SQL} AS month, COUNT(*) AS trips, {REVENUE} AS revenue
    FROM trips GROUP BY 1, 2"""


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    trips = lineitem_trips(spark, sf)
    write_csv(trips, path)
    return _yearly(files.scan_csv(spark, path, trips.schema))


def event_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Microsecond timestamps survive the text form."""
    path = scratch_path(spark, "csv-events")
    events = table(spark, sf, "events")
    write_csv(events, path)
    return files.scan_csv(spark, path, events.schema).agg(
        rows().alias("n"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        total_of("value").alias("value"),
    )


def codec_copies(spark: SparkSession, sf: str) -> DataFrame:
    trips = lineitem_trips(spark, sf)
    parts = []
    for codec in CODECS:
        path = scratch_path(spark, f"codec-{codec}")
        write_parquet(trips, path, codec)
        copy = spark.read.parquet(path)
        parts.append(copy.agg(F.lit(codec).alias("codec"), rows().alias("trips"), total_of("total_amount").alias("revenue")))
    return union_by_name(*parts)


def load_modes(spark: SparkSession, sf: str) -> DataFrame:
    trips = lineitem_trips(spark, sf)
    path = scratch_path(spark, "modes")
    steps = []
    for number, mode in enumerate(("create", "create", "append", "replace"), start=1):
        write_table(trips, path, mode)
        # The next step overwrites the files, so the count is taken now.
        n = spark.read.parquet(path).count()
        steps.append((number, mode, n))
    return spark.createDataFrame(steps, "step bigint, mode string, trips bigint")


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    return a.vendor_averages(normalize_columns(lineitem_trips(spark, sf)), NORMAL)


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    """One column missing, two extra ones, an integer where a double is wanted."""
    drifted = lineitem_trips(spark, sf).withColumns(
        {"passenger_count": F.col("passenger_count").cast("int"), "unknown_column": F.lit(1)}
    )
    fitted = align_schema(drifted.drop("airport_fee"), TARGET)
    return v.null_counts(fitted)


def filled(spark: SparkSession, sf: str) -> DataFrame:
    """A flag that is unknown for some vendors, one fee column present, three absent."""
    flagged = lineitem_trips(spark, sf).select(
        "VendorID",
        "airport_fee",
        F.when(F.col("VendorID") > 1, "Y").alias("store_and_fwd_flag"),
    )
    return (
        default_fill(flagged)
        .groupBy("store_and_fwd_flag")
        .agg(
            rows().alias("trips"),
            total_of("airport_fee").alias("airport_fees"),
            F.sum("cbd_congestion_fee").alias("cbd_fees"),
            F.count("congestion_surcharge").alias("known_surcharges"),
        )
    )


def batch_imported(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "import")
    root = _land_generations(spark, sf)
    log = ingest.batch_import(spark, root, f"{base}/table", f"{base}/manifest", TARGET)
    loaded = spark.read.parquet(f"{base}/table")
    return log.groupBy("status").agg(
        F.sum("rows").alias("file_rows"),
        F.sum("null_count").alias("file_nulls"),
        F.lit(loaded.count()).cast("bigint").alias("table_rows"),
    )


def file_months(spark: SparkSession, sf: str) -> DataFrame:
    """The file every trip would come from; names are parsed once each, not once per row."""
    name = F.concat(F.lit("yellow_tripdata_"), F.date_format(PICKUP, "yyyy-MM"), F.lit(".parquet"))
    per_day = lineitem_trips(spark, sf).groupBy(F.to_date(PICKUP).alias(PICKUP)).agg(rows().alias("n"))
    per_file = per_day.groupBy(name.alias("file_name")).agg(F.sum("n").alias("trips"))
    return per_file.select(files.file_month("file_name").alias("file_date"), "trips")


def manifest_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of the manifest of the drifting files; NULLs as the files hold them."""
    root = _land_generations(spark, sf)
    footers = files.read_footers(files.list_files(spark, root))
    return ingest.manifest_totals(ingest.manifest_rows(footers)).drop("files")


def incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Early years first, then all folders: the second load takes only what is new."""
    root = _land_years(spark, sf)
    base = scratch_path(spark, "incremental")
    place = (f"{base}/table", f"{base}/manifest")
    target = lineitem_trips(spark, sf).schema
    for year in (1995, 1996):
        ingest.incremental_load(spark, f"{root}/load_year={year}", *place, target=target)
    ingest.incremental_load(spark, root, *place, target=target)
    again = ingest.incremental_load(spark, root, *place, target=target)
    extra = F.lit(again.count()).cast("bigint").alias("files_in_last_load")
    return _yearly(spark.read.parquet(place[0])).select("*", extra)


def _rewrite_in_place(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """One file's rows under its old name, as a provider reissues a month."""
    fresh = scratch_path(spark, "reissued")
    rows.coalesce(1).write.parquet(fresh)
    written = files.list_files(spark, fresh).first()["path"]
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, written))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, False)
    if not fs.rename(new, old):
        raise OSError(f"cannot replace {path}")


def synced(spark: SparkSession, sf: str) -> DataFrame:
    """All files, then again after those of 1996 were reissued with dearer trips; a third run finds nothing."""
    root = _land_years(spark, sf)
    base = scratch_path(spark, "synced")
    place = (f"{base}/table", f"{base}/log", PICKUP, lineitem_trips(spark, sf).schema)
    sync.sync_folder(spark, root, *place)
    for file in files.list_files(spark, f"{root}/load_year=1996").collect():
        dearer = spark.read.parquet(file["path"]).withColumn("total_amount", F.col("total_amount") + 1)
        _rewrite_in_place(spark, file["path"], dearer)
    second = sync.sync_folder(spark, root, *place)
    third = sync.sync_folder(spark, root, *place)
    kinds = second.select("change").distinct().collect()
    return _yearly(spark.read.parquet(place[0])).select(
        "*",
        F.lit(",".join(sorted(r["change"] for r in kinds))).alias("changes_in_second_run"),
        F.lit(third.count()).cast("bigint").alias("files_in_third_run"),
    )


def summarised_files(spark: SparkSession, sf: str) -> DataFrame:
    """The years up to 1996 first, then the later ones, and 1996 reissued; a third run reads nothing."""
    base = scratch_path(spark, "daily-files")
    root, trips = f"{base}/files", lineitem_trips(spark, sf)
    early = F.col(PICKUP) < ntz("1997-01-01")
    place = (f"{base}/parts", f"{base}/log", trips.schema)
    _add_years(trips.where(early), root)
    daily.refresh_daily_parts(spark, root, *place)
    _add_years(trips.where(~early), root)
    for file in files.list_files(spark, f"{root}/load_year=1996").collect():
        dearer = spark.read.parquet(file["path"]).withColumn("total_amount", F.col("total_amount") + 1)
        _rewrite_in_place(spark, file["path"], dearer)
    second = daily.refresh_daily_parts(spark, root, *place)
    third = daily.refresh_daily_parts(spark, root, *place)
    kinds = second.select("change").distinct().collect()
    return daily.daily_of_files(daily.read_daily_parts(spark, place[0])).select(
        "*",
        F.lit(",".join(sorted(r["change"] for r in kinds))).alias("changes_in_second_run"),
        F.lit(third.count()).cast("bigint").alias("files_in_third_run"),
    )


def reloaded(spark: SparkSession, sf: str) -> DataFrame:
    """All files, then some of them a second time: row counts stay."""
    root = _land_years(spark, sf)
    base = f"{scratch_path(spark, 'reload')}/table"
    target = lineitem_trips(spark, sf).schema
    ingest.reload_sources(files.scan_folder(spark, root, target), base, PICKUP)
    again = files.scan_folder(spark, f"{root}/load_year=1997", target)
    ingest.reload_sources(again, base, PICKUP)
    return _yearly(spark.read.parquet(base))


def profiled(spark: SparkSession, sf: str) -> DataFrame:
    copy = files.scan_hive(spark, _hive_copy(spark, sf))
    profile = layout.partition_profile(copy, PICKUP)
    return profile.select(
        "year", "month", "rows", (F.col("files") > 0).alias("has_files"),
        (F.col("bytes") > 0).alias("has_bytes"), "strategy",
    )


def suggested(spark: SparkSession, sf: str) -> DataFrame:
    found = layout.suggest_partitioning(lineitem_trips(spark, sf), PICKUP)
    return found.select("layout", "partitions", "suggested", (F.col("size_gb") > 0).alias("has_size"))


def _two_copies(operator):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return operator(lineitem_trips(spark, sf), files.scan_hive(spark, _hive_copy(spark, sf)))

    return run


def nulls(spark: SparkSession, sf: str) -> DataFrame:
    return v.null_counts(files.scan_folder(spark, _land_generations(spark, sf), TARGET).drop(files.SOURCE_FILE))


def violations(spark: SparkSession, sf: str) -> DataFrame:
    rules = {
        **v.trip_rules(),
        "zero_distance": F.col("trip_distance") <= 0,
        "fare_over_total": F.col("fare_amount") > F.col("total_amount"),
        "no_tip": F.col("tip_amount") == 0,
    }
    return v.rule_violations(lineitem_trips(spark, sf), rules)


def reconciled(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest against table after a load, reported per landing folder."""
    root = _land_years(spark, sf)
    base = scratch_path(spark, "reconcile")
    target = lineitem_trips(spark, sf).schema
    log = ingest.batch_import(spark, root, f"{base}/table", f"{base}/manifest", target)
    year = F.regexp_extract(files.SOURCE_FILE, r"load_year=(\d+)", 1).cast("bigint").alias("load_year")
    per_file = v.row_reconcile(log, spark.read.parquet(f"{base}/table"), files.SOURCE_FILE)
    return per_file.groupBy(year).agg(
        F.sum("file_rows").alias("file_rows"),
        F.sum("table_rows").alias("table_rows"),
        F.min("min_date").alias("min_date"),
        F.max("max_date").alias("max_date"),
        F.bool_and("matches").alias("matches"),
    )


def audited(spark: SparkSession, sf: str) -> DataFrame:
    """One run per day of lineitem: a start row for each, an end row for those that finished."""
    daily = lineitem_trips(spark, sf).groupBy(day_of(PICKUP).alias("d")).agg(rows().alias("n"))
    day = F.col("d").cast("timestamp_ntz")
    base = daily.select(
        F.concat(F.lit("load-"), F.col("d").cast("string")).alias("run_id"),
        F.lit("trips").alias("pipeline_id"),
        (F.dayofmonth("d") % 4).cast("string").alias("writer_id"),
        day.alias("started_at"),
        "n",
        F.dayofmonth("d").alias("dom"),
    )
    start = base.select(
        "run_id", "pipeline_id", "writer_id", F.lit("running").alias("status"), "started_at",
        F.lit(None).cast("timestamp_ntz").alias("ended_at"),
        F.lit(0).cast("bigint").alias("rows_written"), F.lit(0).cast("bigint").alias("bytes_written"),
    )
    failed = F.col("dom") == 13
    end = base.where("dom < 28").select(
        "run_id", "pipeline_id", "writer_id",
        F.when(failed, "failed").otherwise("completed").alias("status"),
        "started_at",
        F.timestamp_add("MINUTE", F.col("dom"), F.col("started_at")).alias("ended_at"),
        F.when(failed, 0).otherwise(F.col("n")).cast("bigint").alias("rows_written"),
        F.when(failed, 0).otherwise(F.col("n") * 64).cast("bigint").alias("bytes_written"),
    )
    return v.audit_report(start.unionByName(end))


def unioned(spark: SparkSession, sf: str) -> DataFrame:
    both = union_by_name(
        lineitem_trips(spark, sf).select(PICKUP, "total_amount", "airport_fee"),
        event_trips(spark, sf).select("total_amount", PICKUP, "tpep_dropoff_datetime"),
    )
    return both.groupBy(year_of(PICKUP).alias("year")).agg(
        rows().alias("trips"),
        total_of("total_amount").alias("revenue"),
        F.count("airport_fee").alias("fees"),
        F.count("tpep_dropoff_datetime").alias("dropoffs"),
    )


def deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    return drop_keyed_duplicates(
        table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"]
    )


def published(spark: SparkSession, sf: str) -> DataFrame:
    """Two writers stage overlapping years; one publish merges them."""
    root = _land_years(spark, sf)
    base = scratch_path(spark, "publish")
    target = lineitem_trips(spark, sf).schema
    everything = files.scan_folder(spark, root, target)
    early = everything.where(F.col(PICKUP) < ntz("1999-01-01"))
    late = everything.where(F.col(PICKUP) >= ntz("1998-01-01"))
    ingest.stage_run(early, f"{base}/staging", "r1", "worker_a")
    ingest.stage_run(late, f"{base}/staging", "r2", "worker_b")
    ingest.publish_runs(spark, f"{base}/staging", f"{base}/table", PICKUP, required=[PICKUP])
    return _yearly(spark.read.parquet(f"{base}/table"))


def _history(spark: SparkSession, sf: str) -> DataFrame:
    """Every year loaded once; 1997 and 1998 loaded again later without their small trips."""
    trips = lineitem_trips(spark, sf).select(
        PICKUP, "total_amount", year_of(PICKUP).alias("load_year")
    )
    again = trips.where(F.col("load_year").isin(1997, 1998) & (F.col("total_amount") >= 20000))
    path = scratch_path(spark, "history")
    open_version(trips, "2024-01-01", "worker_a").write.parquet(path)
    open_version(again, "2024-02-01", "worker_b").write.mode("append").parquet(path)
    return with_validity(spark.read.parquet(path), ["load_year"])


def temporal(spark: SparkSession, sf: str) -> DataFrame:
    history = _history(spark, sf)

    def count(df: DataFrame, view: str) -> DataFrame:
        return df.groupBy("load_year", "writer_id").agg(
            F.lit(view).alias("view"), rows().alias("trips"), total_of("total_amount").alias("revenue")
        )

    return union_by_name(
        count(current_rows(history), "current"),
        count(rows_as_of(history, "2024-01-15"), "january"),
        count(history, "all"),
    )


TEMPORAL_SQL = f"""
    , t AS (SELECT {YEAR_SQL} AS load_year, total_amount FROM trips)
    , h AS (SELECT *, TIMESTAMP '2024-01-01' AS vf, 'worker_a' AS writer_id FROM t
            UNION ALL
            SELECT *, TIMESTAMP '2024-02-01', 'worker_b' FROM t
            WHERE load_year IN (1997, 1998) AND total_amount >= 20000)
    , w AS (SELECT *, MAX(vf) OVER (PARTITION BY load_year) AS newest FROM h)
    , v AS (SELECT 'current' AS view, * FROM w WHERE vf = newest
            UNION ALL SELECT 'january', * FROM w WHERE vf <= TIMESTAMP '2024-01-15'
            UNION ALL SELECT 'all', * FROM w)
    SELECT load_year, writer_id, view, COUNT(*) AS trips, {REVENUE} AS revenue
    FROM v GROUP BY 1, 2, 3"""


def logged_versions(spark: SparkSession, sf: str) -> DataFrame:
    """As ``temporal``, but both writers open at the same time; the later load counts."""
    base = scratch_path(spark, "version-log")
    trips = lineitem_trips(spark, sf).select(PICKUP, "total_amount", year_of(PICKUP).alias("load_year"))
    small = F.col("load_year").isin(1997, 1998) & (F.col("total_amount") >= 20000)
    append_version(trips, base, ["load_year"], "2024-01-01", "worker_a")
    append_version(trips.where(small), base, ["load_year"], "2024-01-01", "worker_b")
    append_version(trips.where("load_year = 1996"), base, ["load_year"], "2024-03-01", "worker_c")

    def count(df: DataFrame, view: str) -> DataFrame:
        return df.groupBy("load_year", "writer_id").agg(
            F.lit(view).alias("view"), rows().alias("trips"), total_of("total_amount").alias("revenue")
        )

    return union_by_name(
        count(read_version(spark, base, ["load_year"]), "current"),
        count(read_version(spark, base, ["load_year"], "2024-02-01"), "february"),
    )


LOGGED_SQL = f"""
    , t AS (SELECT {YEAR_SQL} AS load_year, total_amount FROM trips)
    , w AS (SELECT *, load_year IN (1997, 1998)
                      AND max(total_amount) OVER (PARTITION BY load_year) >= 20000 AS again FROM t)
    , k AS (SELECT load_year, total_amount, CASE WHEN again THEN 'worker_b' ELSE 'worker_a' END AS writer_id
            FROM w WHERE NOT again OR total_amount >= 20000)
    , v AS (SELECT 'february' AS view, * FROM k
            UNION ALL
            SELECT 'current', load_year, total_amount,
                   CASE WHEN load_year = 1996 THEN 'worker_c' ELSE writer_id END FROM k)
    SELECT load_year, writer_id, view, COUNT(*) AS trips, {REVENUE} AS revenue
    FROM v GROUP BY 1, 2, 3"""


def streamed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds over a growing folder: the second takes only the files that are new."""
    base = scratch_path(spark, "stream-files")
    trips = lineitem_trips(spark, sf).select(
        "VendorID", PICKUP, "passenger_count", "trip_distance", "total_amount"
    )
    early = F.col(PICKUP) < ntz(LATE)
    for part in (trips.where(early), trips.where(~early)):
        part.write.mode("append").parquet(f"{base}/landing")
        stream = streams.file_stream(spark, f"{base}/landing", trips.schema)
        streams.append_new_files(stream, TARGET, f"{base}/table", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/table").groupBy(year_of(PICKUP).alias("year")).agg(
        rows().alias("trips"),
        total_of("total_amount").alias("revenue"),
        F.sum("airport_fee").alias("airport_fees"),
    )


def streamed_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every event delivered twice."""
    base = scratch_path(spark, "stream-dedup")
    events = table(spark, sf, "events")
    for _ in range(2):
        events.write.mode("append").parquet(f"{base}/landing")
    stream = streams.file_stream(spark, f"{base}/landing", events.schema)
    unique = streams.drop_replays(stream, ["event_id"], "ts")
    streams.run_once(unique, f"{base}/table", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/table").groupBy("event_type").agg(
        rows().alias("n"), F.count_distinct("event_id").alias("ids"), total_of("value").alias("value")
    )


def streamed_daily(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "stream-daily")
    trips = event_trips(spark, sf).select(PICKUP, "total_amount")
    trips.write.parquet(f"{base}/landing")
    stream = streams.file_stream(spark, f"{base}/landing", trips.schema)
    streams.publish_daily(streams.daily_totals(stream), f"{base}/table", f"{base}/checkpoint")
    schema = "trips bigint, avg_fare double, revenue double, day date"
    return spark.read.schema(schema).parquet(f"{base}/table").select("day", "trips", "avg_fare", "revenue")


def _late_rounds(df: DataFrame, ts: str) -> list[DataFrame]:
    """Newest rows first, then the oldest, far behind any delay, then all of them once more."""
    return [df.where(F.col(ts) >= ntz("2024-01-20")), df.where(F.col(ts) < ntz("2024-01-10")), df]


def streamed_late(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "stream-late")
    events = table(spark, sf, "events")
    for part in _late_rounds(events, "ts"):
        part.write.mode("append").parquet(f"{base}/landing")
        stream = streams.file_stream(spark, f"{base}/landing", events.schema)
        streams.publish_events(stream, ["event_id"], "ts", f"{base}/table", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/table").groupBy("event_type").agg(
        rows().alias("n"), F.count_distinct("event_id").alias("ids"), total_of("value").alias("value")
    )


def streamed_late_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Every row once, the oldest after the newest."""
    base = scratch_path(spark, "stream-late-daily")
    trips = event_trips(spark, sf).select(PICKUP, "total_amount")
    newest, oldest, _ = _late_rounds(trips, PICKUP)
    between = trips.where((F.col(PICKUP) >= ntz("2024-01-10")) & (F.col(PICKUP) < ntz("2024-01-20")))
    for part in (newest, oldest, between.union(trips.where(F.col(PICKUP).isNull()))):
        part.write.mode("append").parquet(f"{base}/landing")
        stream = streams.file_stream(spark, f"{base}/landing", trips.schema)
        streams.publish_daily_parts(stream, f"{base}/table", f"{base}/checkpoint")
    return streams.daily_of_parts(spark.read.parquet(f"{base}/table"))


LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]


def compared_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A copy in which the first two lines of some orders changed places: all totals agree."""
    lines = table(spark, sf, "lineitem").select(*LINE_COLUMNS)
    moved = (F.col("l_orderkey") % 100 == 0) & (F.col("l_linenumber") <= 2)
    line = F.when(moved, 3 - F.col("l_linenumber")).otherwise(F.col("l_linenumber"))
    copy = lines.withColumn("l_linenumber", line.cast(lines.schema["l_linenumber"].dataType))
    return v.compare_rows(lines, copy, ["l_orderkey", "l_linenumber"])


_COMPARED = ", ".join(LINE_COLUMNS)
_UNLIKE = ", ".join(
    f"CASE WHEN min({c}) FILTER (side > 0) IS DISTINCT FROM min({c}) FILTER (side < 0) THEN '{c}' END"
    for c in LINE_COLUMNS[2:]
)
COMPARED_SQL = f"""
    WITH a AS (SELECT {_COMPARED} FROM lineitem)
    , b AS (SELECT * REPLACE (CASE WHEN l_orderkey % 100 = 0 AND l_linenumber <= 2
                              THEN 3 - l_linenumber ELSE l_linenumber END AS l_linenumber) FROM a)
    , d AS (SELECT *, 1 AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
            UNION ALL SELECT *, -1 FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
    , g AS (SELECT l_orderkey, l_linenumber, COUNT(*) FILTER (side > 0) AS left_rows,
                   COUNT(*) FILTER (side < 0) AS right_rows, concat_ws(',', {_UNLIKE}) AS names
            FROM d GROUP BY 1, 2)
    SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber,
           CASE WHEN right_rows = 0 THEN 'left' WHEN left_rows = 0 THEN 'right' ELSE 'changed' END AS status,
           left_rows, right_rows,
           CASE WHEN left_rows = 1 AND right_rows = 1 THEN names ELSE '' END AS columns
    FROM g"""


FINGERPRINT = f"""
    SELECT COUNT(*) AS row_count, COUNT(DISTINCT VendorID) AS vendors,
           MIN(tpep_pickup_datetime) AS min_date, MAX(tpep_pickup_datetime) AS max_date,
           {r2(dec_avg('total_amount'))} AS avg_fare, {r2(REVENUE)} AS total_revenue FROM trips"""


def ingest_queries() -> dict[str, Query]:
    lineitem_rows = "(SELECT COUNT(*) FROM trips)"
    return {
        "e_scan_parquet_glob": Query(scan_generations, with_trips(FEE_REPORT_SQL)),
        "e_scan_hive": Query(hive_totals, with_trips(HIVE_SQL)),
        "e_scan_csv": Query(event_csv, """
            SELECT COUNT(*) AS n, MIN(ts) AS first_ts, MAX(ts) AS last_ts,
                   CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events"""),
        "e_sink_csv": Query(csv_round_trip, with_trips(YEARLY_SQL)),
        "e_sink_parquet": Query(codec_copies, with_trips(f"""
            SELECT codec, COUNT(*) AS trips, {REVENUE} AS revenue
            FROM trips, (VALUES ('snappy'), ('gzip'), ('uncompressed')) AS c(codec) GROUP BY 1""")),
        "e_sink_table": Query(load_modes, with_trips(f"""
            SELECT CAST(s AS BIGINT) AS step, m AS mode, CAST(f * {lineitem_rows} AS BIGINT) AS trips
            FROM (VALUES (1, 'create', 1), (2, 'create', 1), (3, 'append', 2), (4, 'replace', 1)) AS v(s, m, f)""")),
        "e_normalize_columns": Query(normalized, with_trips(f"""
            SELECT VendorID AS vendorid, COUNT(*) AS trips, {dec_avg('trip_distance')} AS avg_distance,
                   {dec_avg('total_amount')} AS avg_fare FROM trips GROUP BY 1""")),
        "e_align_schema": Query(aligned, with_trips(f"""
            SELECT column_name, CAST(f * {lineitem_rows} AS BIGINT) AS nulls
            FROM (VALUES ('VendorID', 0), ('tpep_pickup_datetime', 0), ('passenger_count', 0),
                         ('trip_distance', 0), ('total_amount', 0), ('airport_fee', 1),
                         ('cbd_congestion_fee', 1), ('(all)', 2)) AS v(column_name, f)""")),
        "e_default_fill": Query(filled, with_trips("""
            SELECT CASE WHEN VendorID > 1 THEN 'Y' ELSE 'N' END AS store_and_fwd_flag,
                   COUNT(*) AS trips, CAST(SUM(CAST(airport_fee AS DECIMAL(18,2))) AS DOUBLE) AS airport_fees,
                   CAST(0 AS DOUBLE) AS cbd_fees, COUNT(*) AS known_surcharges
            FROM trips GROUP BY 1""")),
        "e_batch_import": Query(batch_imported, with_trips("""
            SELECT 'success' AS status, COUNT(*) AS file_rows, CAST(0 AS BIGINT) AS file_nulls,
                   COUNT(*) AS table_rows FROM trips""")),
        "e_parse_file_date": Query(file_months, with_trips("""
            , n AS (SELECT 'yellow_tripdata_' || strftime(tpep_pickup_datetime, '%Y-%m') || '.parquet' AS name FROM trips)
            SELECT CAST(regexp_extract(name, '([0-9]{4}-[0-9]{2})', 1) || '-01' AS DATE) AS file_date,
                   COUNT(*) AS trips FROM n GROUP BY 1""")),
        "e_write_hive_partitioned": Query(months_replaced, with_trips(MONTHS_REPLACED_SQL)),
        "e_manifest": Query(manifest_summary, with_trips("""
            SELECT 'success' AS status, COUNT(*) AS rows, CAST(0 AS BIGINT) AS null_count FROM trips""")),
        "e_incremental_load": Query(incremental, with_trips(f"""
            SELECT *, CAST(0 AS BIGINT) AS files_in_last_load FROM ({YEARLY_SQL})""")),
        "e_sync_changed": Query(synced, with_trips(f"""
            , reissued AS (SELECT * REPLACE (total_amount + CASE WHEN {YEAR_SQL} = 1996 THEN 1 ELSE 0 END AS total_amount)
                           FROM trips)
            SELECT *, 'changed' AS changes_in_second_run, CAST(0 AS BIGINT) AS files_in_third_run
            FROM ({YEARLY_SQL.replace("FROM trips", "FROM reissued")})""")),
        "a_daily_summary_files": Query(summarised_files, with_trips(f"""
            , reissued AS (SELECT * REPLACE (total_amount + CASE WHEN {YEAR_SQL} = 1996 THEN 1 ELSE 0 END AS total_amount)
                           FROM trips)
            SELECT {DAY} AS day, COUNT(*) AS trips, {dec_avg('fare_amount')} AS avg_fare, {REVENUE} AS revenue,
                   'changed,new' AS changes_in_second_run, CAST(0 AS BIGINT) AS files_in_third_run
            FROM reissued GROUP BY 1""")),
        "e_idempotent_reload": Query(reloaded, with_trips(YEARLY_SQL)),
        "e_partition_profile": Query(profiled, with_trips(f"""
            SELECT {YEAR_SQL} AS year, {MONTH_SQL} AS month, COUNT(*) AS rows, TRUE AS has_files,
                   TRUE AS has_bytes, 'monthly' AS strategy FROM trips GROUP BY 1, 2""")),
        "e_suggest_partitioning": Query(suggested, with_trips(f"""
            , n AS (SELECT COUNT(DISTINCT year(tpep_pickup_datetime)) AS y,
                           COUNT(DISTINCT date_trunc('month', tpep_pickup_datetime)) AS m,
                           COUNT(DISTINCT {DAY}) AS d FROM trips)
            , l AS (SELECT 'year' AS layout, y AS partitions, 0 AS depth FROM n
                    UNION ALL SELECT 'year,month', m, 1 FROM n UNION ALL SELECT 'year,month,day', d, 2 FROM n)
            SELECT layout, partitions,
                   depth = (SELECT max(depth) FROM l WHERE partitions <= 10000) AS suggested,
                   TRUE AS has_size FROM l""")),
        "v_table_fingerprint": on_lineitem(v.table_fingerprint, FINGERPRINT),
        "v_data_stats": on_lineitem(v.data_stats, f"""
            SELECT COUNT(*) AS total_rows, COUNT(DISTINCT VendorID) AS vendors,
                   COUNT(DISTINCT PULocationID) AS pickup_locations,
                   COUNT(DISTINCT DOLocationID) AS dropoff_locations,
                   MIN(tpep_pickup_datetime) AS min_date, MAX(tpep_pickup_datetime) AS max_date,
                   {r2(dec_avg('total_amount'))} AS avg_fare, {r2(REVENUE)} AS total_revenue FROM trips"""),
        "v_quality_profile": on_lineitem(v.quality_profile, f"""
            SELECT COUNT(*) AS total_rows, COUNT(DISTINCT VendorID) AS vendors,
                   COUNT(DISTINCT PULocationID) AS pickup_locations,
                   COUNT(DISTINCT DOLocationID) AS dropoff_locations,
                   {dec_avg('fare_amount')} AS avg_fare, {dec_avg('trip_distance')} AS avg_distance,
                   quantile_cont(fare_amount, 0.95) AS p95_fare FROM trips"""),
        "v_compare_tables": Query(_two_copies(v.compare_tables), with_trips(f"""
            , f AS ({FINGERPRINT})
            , m AS (
              SELECT 'row_count' AS metric, CAST(row_count AS VARCHAR) AS x FROM f
              UNION ALL SELECT 'vendors', CAST(vendors AS VARCHAR) FROM f
              UNION ALL SELECT 'min_date', strftime(min_date, '%Y-%m-%d %H:%M:%S') FROM f
              UNION ALL SELECT 'max_date', strftime(max_date, '%Y-%m-%d %H:%M:%S') FROM f
              UNION ALL SELECT 'avg_fare', CAST(CAST(avg_fare AS DECIMAL(38,2)) AS VARCHAR) FROM f
              UNION ALL SELECT 'total_revenue', CAST(CAST(total_revenue AS DECIMAL(38,2)) AS VARCHAR) FROM f)
            SELECT metric, x AS left_value, x AS right_value, TRUE AS matches FROM m""")),
        "v_group_key_diagnostics": Query(_two_copies(v.group_key_diagnostics), with_trips(f"""
            , k AS (SELECT COUNT(DISTINCT {DAY}) AS a, COUNT(DISTINCT ({DAY}, VendorID)) AS b FROM trips)
            SELECT 'unique_dates' AS metric, a AS left_value, a AS right_value, TRUE AS matches FROM k
            UNION ALL SELECT 'date_vendor_pairs', b, b, TRUE FROM k""")),
        "v_validate": on_lineitem(v.validate, f"""
            SELECT {YEAR_SQL} AS year, COUNT(*) AS year_rows, {lineitem_rows} AS total_rows,
                   CAST(13 AS BIGINT) AS column_count, 'valid' AS status FROM trips GROUP BY 1"""),
        "v_null_counts": Query(nulls, with_trips(f"""
            , g AS (SELECT COUNT(*) FILTER (WHERE {GENERATION_SQL} = 1) AS old,
                           COUNT(*) FILTER (WHERE {GENERATION_SQL} < 3) AS nocbd FROM trips)
            SELECT n AS column_name, CAST(a * old + b * nocbd AS BIGINT) AS nulls
            FROM g, (VALUES ('VendorID', 0, 0), ('tpep_pickup_datetime', 0, 0), ('passenger_count', 0, 0),
                            ('trip_distance', 0, 0), ('total_amount', 0, 0), ('airport_fee', 1, 0),
                            ('cbd_congestion_fee', 0, 1), ('(all)', 1, 1)) AS v(n, a, b)""")),
        "v_negative_fares": Query(violations, with_trips("""
            , c AS (SELECT COUNT(*) FILTER (WHERE fare_amount < 0) AS neg,
                           COUNT(*) FILTER (WHERE trip_distance <= 0) AS zero,
                           COUNT(*) FILTER (WHERE fare_amount > total_amount) AS over_total,
                           COUNT(*) FILTER (WHERE tip_amount = 0) AS no_tip FROM trips)
            SELECT 'negative_fare' AS rule, neg AS violations FROM c
            UNION ALL SELECT 'zero_distance', zero FROM c
            UNION ALL SELECT 'fare_over_total', over_total FROM c
            UNION ALL SELECT 'no_tip', no_tip FROM c""")),
        "v_row_reconcile": Query(reconciled, with_trips(f"""
            SELECT {YEAR_SQL} AS load_year, COUNT(*) AS file_rows, COUNT(*) AS table_rows,
                   MIN(tpep_pickup_datetime) AS min_date, MAX(tpep_pickup_datetime) AS max_date,
                   TRUE AS matches FROM trips GROUP BY 1""")),
        "v_run_audit": Query(audited, with_trips(f"""
            , d AS (SELECT {DAY} AS d, COUNT(*) AS n, day({DAY}) AS dom FROM trips GROUP BY 1, 3)
            , s AS (SELECT CASE WHEN dom >= 28 THEN 'running' WHEN dom = 13 THEN 'failed'
                                ELSE 'completed' END AS status, * FROM d)
            SELECT status, COUNT(*) AS runs,
                   CAST(SUM(CASE WHEN status = 'completed' THEN n ELSE 0 END) AS BIGINT) AS rows_written,
                   CAST(SUM(CASE WHEN status = 'completed' THEN n * 64 ELSE 0 END) AS BIGINT) AS bytes_written,
                   MIN(CAST(d AS TIMESTAMP)) AS first_start,
                   MAX(CASE WHEN status <> 'running' THEN CAST(d AS TIMESTAMP) + to_minutes(dom) END) AS last_end
            FROM s GROUP BY 1""")),
        "s_union_by_name": Query(unioned, """
            WITH u AS (SELECT l_shipdate AS ts, l_extendedprice AS amount, 1 AS fee, NULL AS dropoff FROM lineitem
                       UNION ALL SELECT ts, value, NULL, 1 FROM events)
            SELECT CAST(year(ts) AS BIGINT) AS year, COUNT(*) AS trips,
                   CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
                   COUNT(fee) AS fees, COUNT(dropoff) AS dropoffs FROM u GROUP BY 1"""),
        "r_dedup": Query(deduplicated, """
            SELECT * FROM lineitem QUALIFY row_number() OVER (
              PARTITION BY l_orderkey, l_linenumber
              ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC,
                       l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC,
                       l_linestatus DESC) = 1"""),
        "r_stage_and_publish": Query(published, with_trips(YEARLY_SQL)),
        "r_temporal_append": Query(temporal, with_trips(TEMPORAL_SQL)),
        "r_stream_files": Query(streamed_files, with_trips(f"""
            SELECT {YEAR_SQL} AS year, COUNT(*) AS trips, {REVENUE} AS revenue,
                   CAST(0 AS DOUBLE) AS airport_fees FROM trips GROUP BY 1""")),
        "r_stream_dedup": Query(streamed_dedup, """
            SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT event_id) AS ids,
                   CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1"""),
        "r_stream_daily": Query(streamed_daily, with_trips(f"""
            SELECT {DAY} AS day, COUNT(*) AS trips, {dec_avg('total_amount')} AS avg_fare, {REVENUE} AS revenue
            FROM trips GROUP BY 1""", EVENT_TRIPS_SQL)),
        "r_temporal_log": Query(logged_versions, with_trips(LOGGED_SQL)),
        "r_stream_late": Query(streamed_late, """
            SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT event_id) AS ids,
                   CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1"""),
        "r_stream_late_daily": Query(streamed_late_daily, with_trips(f"""
            SELECT {DAY} AS day, COUNT(*) AS trips, {dec_avg('total_amount')} AS avg_fare, {REVENUE} AS revenue
            FROM trips GROUP BY 1""", EVENT_TRIPS_SQL)),
        "v_compare_rows": Query(compared_rows, COMPARED_SQL),
    }
