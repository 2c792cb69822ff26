"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.staging import stage

#: Links per task of the rounds' last shuffles; most graphs of copies are far smaller than the tables they come from.
TASK_LINKS = 1 << 14


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _least(links: DataFrame, label: str, tasks: int) -> DataFrame:
    """The least neighbour of every node, as a table: the joins below then have two plain exchanges."""
    return stage(links.groupBy("a").agg(F.min("b").alias("least")).coalesce(tasks), label)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns ``a`` and ``b``); root is the least node reached.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each
    step hangs a node's neighbours on the least of them, the number of links
    never grows, and the number of rounds is logarithmic in the length of
    chains. Every round is written to scratch, so no plan gets deep and lost
    executors cost one round. A node with very many links is split over tasks
    by the join, and its least neighbour is found by a partial aggregate. The
    rounds take as many tasks as the links need, not one for every shuffle
    partition of the session: with few links that is most of their time.
    Links with a null end or with equal ends are left out.
    """
    links = links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    links = stage(links.distinct(), "links")
    before, tasks = None, 1
    while (now := _state(links)) != before:
        before = now
        tasks = max(1, -(-now[0] // TASK_LINKS))
        both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")).toDF("a", "b"))
        low = _least(both, "large-star", tasks).select("a", F.least("a", "least").alias("least"))
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        )
        large = stage(large.coalesce(tasks), "large-links")
        low = _least(large, "small-star", tasks)
        near = large.join(low, "a")
        hung = near.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        links = stage(hung.union(low.select("a", F.col("least").alias("b"))).distinct().coalesce(tasks), "small-links")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(links.select("b", "b").distinct().coalesce(tasks).toDF("node", "root"))
