"""The trip table: target schema and the roles its columns play."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The 20 columns of the trip table, in table order.
TRIP_SCHEMA = T.StructType(
    [
        T.StructField("VendorID", T.LongType()),
        T.StructField("tpep_pickup_datetime", T.TimestampNTZType()),
        T.StructField("tpep_dropoff_datetime", T.TimestampNTZType()),
        T.StructField("passenger_count", T.DoubleType()),
        T.StructField("trip_distance", T.DoubleType()),
        T.StructField("RatecodeID", T.DoubleType()),
        T.StructField("store_and_fwd_flag", T.StringType()),
        T.StructField("PULocationID", T.LongType()),
        T.StructField("DOLocationID", T.LongType()),
        T.StructField("payment_type", T.LongType()),
        T.StructField("fare_amount", T.DoubleType()),
        T.StructField("extra", T.DoubleType()),
        T.StructField("mta_tax", T.DoubleType()),
        T.StructField("tip_amount", T.DoubleType()),
        T.StructField("tolls_amount", T.DoubleType()),
        T.StructField("improvement_surcharge", T.DoubleType()),
        T.StructField("total_amount", T.DoubleType()),
        T.StructField("congestion_surcharge", T.DoubleType()),
        T.StructField("airport_fee", T.DoubleType()),
        T.StructField("cbd_congestion_fee", T.DoubleType()),
    ]
)

# Fee columns that default to 0.0 when a source lacks them.
DEFAULT_ZERO_COLUMNS = (
    "improvement_surcharge",
    "congestion_surcharge",
    "airport_fee",
    "cbd_congestion_fee",
)

# Payment codes and zones the analytics single out.
CARD_PAYMENT = 1
CASH_PAYMENT = 2
AIRPORT_ZONES = (132, 138, 158)


@dataclass(frozen=True)
class TripColumns:
    """Which column of a frame plays which role; defaults fit ``TRIP_SCHEMA``.

    Every analytic takes one of these, so the same function serves a
    normalised copy (``pickup_datetime`` …) or any other trip-shaped table.
    """

    vendor: str = "VendorID"
    pickup: str = "tpep_pickup_datetime"
    dropoff: str = "tpep_dropoff_datetime"
    passengers: str = "passenger_count"
    distance: str = "trip_distance"
    rate_code: str = "RatecodeID"
    pickup_zone: str = "PULocationID"
    dropoff_zone: str = "DOLocationID"
    payment: str = "payment_type"
    fare: str = "fare_amount"
    tip: str = "tip_amount"
    total: str = "total_amount"
    congestion: str = "congestion_surcharge"
    airport: str = "airport_fee"
    #: Partition columns known to be the pickup time's year and month. Only the
    #: owner of a layout can know: folders named after files hold stray rows.
    pickup_year: str | None = None
    pickup_month: str | None = None
