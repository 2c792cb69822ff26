"""Small trip frames with the awkward rows real data has."""

from __future__ import annotations

import datetime as dt
import random

from fareloom.columns import TRIP_SCHEMA

D = dt.datetime


def trip(**values):
    base = {f.name: None for f in TRIP_SCHEMA.fields}
    base.update(
        VendorID=1,
        tpep_pickup_datetime=D(2024, 1, 1, 10, 0),
        tpep_dropoff_datetime=D(2024, 1, 1, 10, 30),
        passenger_count=1.0,
        trip_distance=2.5,
        RatecodeID=1.0,
        store_and_fwd_flag="N",
        PULocationID=10,
        DOLocationID=20,
        payment_type=1,
        fare_amount=10.0,
        tip_amount=2.0,
        total_amount=12.5,
        congestion_surcharge=2.5,
        airport_fee=0.0,
    )
    base.update(values)
    return tuple(base[f.name] for f in TRIP_SCHEMA.fields)


def frame(spark, *rows):
    return spark.createDataFrame([r if isinstance(r, tuple) else trip(**r) for r in rows], TRIP_SCHEMA)


def synthetic(spark, n=3000, seed=42):
    """Random trips over 14 months; a third of them share one amount, some roles are NULL."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        pickup = D(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(420 * 24 * 60))
        total = 20.0 if i % 3 == 0 else round(rng.uniform(-5, 200), 2)
        rows.append(
            trip(
                VendorID=rng.choice([1, 2, 2, 2, 6]),
                tpep_pickup_datetime=pickup,
                tpep_dropoff_datetime=pickup + dt.timedelta(minutes=rng.randint(-5, 90)),
                passenger_count=rng.choice([None, 0.0, 1.0, 1.0, 2.0, 9.0, 12.0]),
                trip_distance=round(rng.uniform(0, 30), 2) if rng.random() > 0.05 else 0.0,
                RatecodeID=rng.choice([None, 1.0, 2.0, 99.0]),
                PULocationID=rng.choice([132, 138, 7, 8, 9]),
                DOLocationID=rng.choice([132, 158, 7, 8, 9]),
                payment_type=rng.choice([0, 1, 1, 1, 2, 3]),
                fare_amount=rng.choice([0.0, -3.0]) if rng.random() < 0.05 else round(total * 0.8, 2),
                tip_amount=round(rng.uniform(0, 20), 2),
                total_amount=total,
                congestion_surcharge=rng.choice([None, 0.0, 2.5]),
                airport_fee=rng.choice([None, 0.0, 1.25]),
            )
        )
    return frame(spark, *rows)
