"""Whole-table window functions, bound to ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareloom.operators.row_ranks import with_row_ranks
from fareloom.plans.bindings import table
from fareloom.plans.entry import Query


def row_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by quantity, which has 49 values and NULLs; the price of the line before and after each."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_extendedprice").alias("price"),
        F.nullif(F.col("l_quantity"), F.lit(13.0)).alias("quantity"),
    )
    ties = ["l_orderkey", "l_linenumber", "l_partkey", "price"]
    return with_row_ranks(lines, {"quantity": "desc"}, ties, neighbours=["price"], tiles=[7])


ROW_RANKS_SQL = """
WITH lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price, NULLIF(l_quantity, 13) AS quantity FROM lineitem
)
SELECT *, ROW_NUMBER() OVER o AS row_number,
       RANK() OVER (ORDER BY quantity DESC NULLS LAST) AS rank,
       DENSE_RANK() OVER (ORDER BY quantity DESC NULLS LAST) AS dense_rank,
       PERCENT_RANK() OVER (ORDER BY quantity DESC NULLS LAST) AS percent_rank,
       LAG(price) OVER o AS lag_price, LEAD(price) OVER o AS lead_price, NTILE(7) OVER o AS ntile_7
FROM lines
WINDOW o AS (ORDER BY quantity DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, price)"""


def rank_queries() -> dict[str, Query]:
    return {"r_row_ranks": Query(row_ranks, ROW_RANKS_SQL)}
