"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """At most ``per_label`` rows of each label, those of the smallest hashes of ``key``.

    One pass counts the labels. A second lets a row through if its hash lies
    below the share that its label needs, with a margin; what is left is
    bounded by the number of labels, and a window takes the exact number.
    The same table always gives the same rows. Null labels are left out.
    """
    rows = rows.where(F.col(label).isNotNull())
    counts = rows.groupBy(label).count().collect()
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30))
    share = [
        (F.col(label) == F.lit(r[label])) & (place < F.lit(int((1 << 30) * min(1.0, (1.3 * per_label + 50) / r["count"]))))
        for r in counts
    ]
    passed = rows.where(reduce(lambda a, b: a | b, share, F.lit(False)))
    order = Window.partitionBy(label).orderBy(F.xxhash64(F.col(key)), F.col(key))
    return passed.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_label).drop("_rank")
