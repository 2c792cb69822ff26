"""Trip analytics and ingest jobs expressed on the Spark DataFrame API."""

from fareloom.columns import TripColumns

__all__ = ["TripColumns"]
