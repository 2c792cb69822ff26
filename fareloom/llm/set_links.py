"""Links between sets that share enough, inside groups of any size, as few as connect what belongs together."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.staging import stage

#: Items of the sets that a task holds from one slice; a larger group becomes several pairs of slices.
SLICE_ITEMS = 1 << 19
#: Items in a row; a larger set has several rows.
ROW_ITEMS = 1024


@dataclass(frozen=True)
class Enough:
    """What two sets must share: ``least`` items, and ``percent`` of their union."""

    least: int = 1
    percent: int = 0

    def of(self, shared, size, other):
        """For numbers, arrays and columns."""
        return (shared >= self.least) & (shared * 100 >= (size + other - shared) * self.percent)


def spanning(sets: list[np.ndarray], sides: np.ndarray, enough: Enough) -> list[tuple[int, int]]:
    """Links between places of ``sets`` (of distinct items each) that connect all that enough connects.

    Sides 0 and 1 are compared with each other, side 2 with everything. Sets
    connected already are not compared again: a group of copies takes one step
    per member.
    """
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    _, ids = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(flat) + 1, bool)
    label, links = np.arange(len(sets)), []
    for a in range(len(sets)):
        if sides[a] == 1:
            continue
        others = (label != label[a]) & (sizes > 0)
        others &= sides == 1 if sides[a] == 0 else np.arange(len(sets)) > a
        others &= enough.of(np.minimum(sizes, sizes[a]), sizes, sizes[a])
        at = np.flatnonzero(others)
        if not len(at) or not sizes[a]:
            continue
        own = ids[starts[a] : starts[a] + sizes[a]]
        mark[own] = True
        if 2 * sizes[at].sum() > len(flat):
            shared = np.add.reduceat(mark[ids], starts[sizes > 0], dtype=np.int64)[np.searchsorted(np.flatnonzero(sizes > 0), at)]
        else:
            shared = np.array([np.count_nonzero(mark[ids[starts[b] : starts[b] + sizes[b]]]) for b in at])
        mark[own] = False
        for b in at[enough.of(shared, sizes[at], sizes[a])]:
            if label[b] != label[a]:
                links.append((a, int(b)))
                label[label == label[b]] = label[a]
    return links


def _compare(enough: Enough):
    """Spanning links of every run of rows with one (group_id, low, high)."""
    key = ["group_id", "low", "high"]

    def links(rows: list[tuple]) -> tuple[list[int], list[int]]:
        members: dict[tuple[int, int], list[np.ndarray]] = {}
        for member, side, items in rows:
            members.setdefault((member, side), []).append(items)
        names = list(members)
        sets = [np.concatenate(v) for v in members.values()]
        found = spanning(sets, np.array([s for _, s in names]), enough)
        found = [(names[a][0], names[b][0]) for a, b in found]
        return [a for a, _ in found], [b for _, b in found]

    def batch_of(a: list[int], b: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in key)))
            members, sides = batch.column("member").to_pylist(), batch.column("side").to_pylist()
            items = batch.column("items")
            values, ends = items.values.to_numpy(zero_copy_only=False), items.offsets.to_numpy()
            first, second = [], []
            for i, k in enumerate(keys):
                if k != now:
                    if len(held) > 1:
                        a, b = links(held)
                        first += a
                        second += b
                    held, now = [], k
                held.append((members[i], sides[i], values[ends[i] : ends[i + 1]]))
            held = [(m, s, v.copy()) for m, s, v in held]  # the batch itself may go
            yield batch_of(first, second)
        if len(held) > 1:
            yield batch_of(*links(held))

    return run


def _slices(items: Column, slice_items: int) -> Column:
    return F.ceil(items / slice_items).cast("int")


def _own(slices: Column) -> Column:
    return F.pmod(F.xxhash64("member"), slices).cast("int")


def linked_within(sets: DataFrame, enough: Enough, slice_items: int = SLICE_ITEMS) -> DataFrame:
    """(a, b) links between members of one group whose sets share ``enough``, a spanning part of them.

    ``sets`` is a written table (group_id, member, size, items): bigints, a
    member's ``size`` distinct items in one or more rows. Every two members of
    a group are compared unless links connect them anyway.

    A group of up to ``slice_items`` items is compared in one task. A larger
    one is first compared with one member, its leader, by a join; what the
    leader links needs no comparison among itself. Only the rest is compared
    with the group, in slices: each pair of a slice of the rest and a slice of
    the group is a piece of work of its own. So a group of near copies, however large,
    takes work in proportion to it.
    """
    sizes = sets.groupBy("group_id", "member").agg(F.max("size").alias("size"))
    groups = sizes.groupBy("group_id").agg(
        F.sum("size").alias("all_items"), F.count("*").alias("members"), F.min("member").alias("leader")
    )
    groups = stage(groups.where("members > 1").withColumn("slices", _slices(F.col("all_items"), slice_items)), "set-groups")
    small = groups.where("slices <= 1").select("group_id")
    plain = sets.join(small, "group_id").select(
        "group_id", F.lit(0).alias("low"), F.lit(0).alias("high"), "member", F.lit(2).alias("side"), "items"
    )
    large = groups.where("slices > 1")
    if large.isEmpty():
        return _compared(plain, enough)

    lead = sets.join(large.select("group_id", "leader", "slices"), "group_id").where("member = leader")
    lead = stage(
        lead.groupBy("group_id", "slices").agg(
            F.max("member").alias("leader"), F.max("size").alias("leader_size"), F.flatten(F.collect_list("items")).alias("leader_items")
        ),
        "set-leaders",
    )
    met = sets.join(lead, "group_id").select(
        "group_id", "member", "size", "leader", "leader_size", F.size(F.array_intersect("items", "leader_items")).alias("shared")
    )
    met = met.groupBy("group_id", "member", "size", "leader", "leader_size").agg(F.sum("shared").alias("shared"))
    is_linked = (F.col("member") == F.col("leader")) | enough.of(F.col("shared"), F.col("size"), F.col("leader_size"))
    met = stage(met.select("group_id", "member", "size", "leader", is_linked.alias("linked")), "set-met")
    rest = met.where("not linked")
    rests = rest.groupBy("group_id").agg(_slices(F.sum("size"), slice_items).alias("rest_slices"))
    rests = stage(rests.join(large.select("group_id", "slices"), "group_id"), "set-rests")
    every = sets.join(rests, "group_id")
    whole = every.select(
        "group_id",
        F.explode(F.sequence(F.lit(0), F.col("rest_slices") - 1)).alias("low"),
        _own(F.col("slices")).alias("high"),
        "member",
        F.lit(1).alias("side"),
        "items",
    )
    left = every.join(rest.select("group_id", "member"), ["group_id", "member"], "left_semi").select(
        "group_id",
        _own(F.col("rest_slices")).alias("low"),
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("high"),
        "member",
        F.lit(0).alias("side"),
        "items",
    )
    led = met.where("linked and member <> leader").select(F.col("leader").alias("a"), F.col("member").alias("b"))
    return _compared(plain.union(whole).union(left), enough).union(led)


def _compared(rows: DataFrame, enough: Enough) -> DataFrame:
    dealt = rows.repartition("group_id", "low", "high").sortWithinPartitions("group_id", "low", "high", "member")
    return dealt.mapInArrow(_compare(enough), "a bigint, b bigint").where("a <> b")
