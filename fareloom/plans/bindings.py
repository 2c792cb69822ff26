"""The given tables seen as trip tables.

``lineitem`` plays the trips where dates, money and routes matter, ``events``
where hours, weekdays and durations do. Columns are plain projections, so
filters on ``tpep_pickup_datetime`` still reach the Parquet scan of
``l_shipdate`` and unused roles cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareloom.functions.numbers import from_fixed, nearest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(value: Column) -> Column:
    return from_fixed(nearest(value))


def lineitem_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 4).alias("VendorID"),
        F.col("l_shipdate").alias("tpep_pickup_datetime"),
        F.col("l_linenumber").cast("double").alias("passenger_count"),
        F.col("l_quantity").alias("trip_distance"),
        F.col("l_linenumber").cast("double").alias("RatecodeID"),
        F.col("l_suppkey").alias("PULocationID"),
        (F.col("l_partkey") % 100).alias("DOLocationID"),
        F.col("l_linenumber").cast("bigint").alias("payment_type"),
        _cents(price * (1 - F.col("l_discount"))).alias("fare_amount"),
        _cents(price * F.col("l_tax")).alias("tip_amount"),
        price.alias("total_amount"),
        F.col("l_discount").alias("congestion_surcharge"),
        F.col("l_tax").alias("airport_fee"),
    )


def event_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a trip that lasts ``value`` minutes and covers ``value`` miles."""
    micros = nearest(F.col("value")) * F.lit(600_000)
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("VendorID"),
        F.col("ts").alias("tpep_pickup_datetime"),
        F.timestamp_add("MICROSECOND", micros, F.col("ts")).alias("tpep_dropoff_datetime"),
        (F.col("user_id") % 12).cast("double").alias("passenger_count"),
        F.col("value").alias("trip_distance"),
        F.col("value").alias("total_amount"),
    )


# The same two projections for the SQL oracle.
LINEITEM_TRIPS_SQL = """trips AS (
  SELECT l_suppkey % 4 AS VendorID,
         l_shipdate AS tpep_pickup_datetime,
         CAST(l_linenumber AS DOUBLE) AS passenger_count,
         l_quantity AS trip_distance,
         CAST(l_linenumber AS DOUBLE) AS RatecodeID,
         l_suppkey AS PULocationID,
         l_partkey % 100 AS DOLocationID,
         CAST(l_linenumber AS BIGINT) AS payment_type,
         floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 AS fare_amount,
         floor(l_extendedprice * l_tax * 100 + 0.5) / 100 AS tip_amount,
         l_extendedprice AS total_amount,
         l_discount AS congestion_surcharge,
         l_tax AS airport_fee
  FROM lineitem)"""

EVENT_TRIPS_SQL = """trips AS (
  SELECT event_type AS VendorID,
         ts AS tpep_pickup_datetime,
         ts + to_microseconds(CAST(floor(value * 100 + 0.5) AS BIGINT) * 600000)
           AS tpep_dropoff_datetime,
         CAST(user_id % 12 AS DOUBLE) AS passenger_count,
         value AS trip_distance,
         value AS total_amount
  FROM events)"""
