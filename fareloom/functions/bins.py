"""Labelled ranges as chained conditions; the first match wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def below(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """``value < edges[i]`` → ``labels[i]``, anything else (also NULL) → the last label."""
    return _chain(edges, labels, lambda edge: value < F.lit(edge))


def up_to(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """``value <= edges[i]`` → ``labels[i]``, anything else (also NULL) → the last label."""
    return _chain(edges, labels, lambda edge: value <= F.lit(edge))


def flag(condition: Column, yes: str, no: str) -> Column:
    """Two labels; an unknown condition counts as ``no``."""
    return F.when(condition, F.lit(yes)).otherwise(F.lit(no))


def _chain(edges, labels, test) -> Column:
    if len(labels) != len(edges) + 1:
        raise ValueError("one more label than edges is needed")
    if list(edges) != sorted(edges):
        raise ValueError("edges must ascend")
    result = F.when(test(edges[0]), F.lit(labels[0]))
    for edge, label in zip(edges[1:], labels[1:]):
        result = result.when(test(edge), F.lit(label))
    return result.otherwise(F.lit(labels[-1]))
