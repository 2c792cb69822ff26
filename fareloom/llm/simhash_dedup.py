"""SimHash near-dedup by a grid range-join over segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.llm.components import components
from fareloom.llm.text import as_bytes, parts, whole_row
from fareloom.staging import stage

SHINGLE_WORDS = 4
MAX_BITS = 4
SEGMENT_BITS = 2
#: The Manhattan budget is shared out: one of so many groups of segments is within ``MAX_BITS // GROUPS``.
GROUPS = 3
#: Rows of one cell that a task compares at a time; a fuller cell becomes several pairs of slices.
SLICE = 2048
SEED = 42


def simhash(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """64 bits, each set if set in more than half of the hashes of the text's shingles; no word gives 0.

    Words are parted by ASCII white space, A-Z is lower-cased. A text of fewer
    words than a shingle is one shingle.
    """
    found = text.lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    counts, step, total = np.zeros(64, np.int64), 1 << 14, len(found) - words + 1
    for low in range(0, total, step):
        part = found[low : low + step + words - 1]
        hashes = np.fromiter(
            (digest(join(s), SEED) for s in zip(*(part[j:] for j in range(words)))), np.uint64
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def simhash_column(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """``simhash`` of a text column as a bigint; null text counts as empty."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts(batches):
            prints = np.array([simhash(t, words) for t in as_bytes(texts)], dtype=np.uint64)
            yield pa.array(prints.view(np.int64))

    return F.arrow_udf(run, "bigint")(text)


def segment_counts(prints: np.ndarray, bits: int = SEGMENT_BITS) -> np.ndarray:
    """Number of set bits in each segment of ``bits`` bits, a row per fingerprint."""
    starts = np.arange(0, 64, bits, dtype=np.uint64)
    masked = (prints[:, None] >> starts[None, :]) & np.uint64((1 << bits) - 1)
    return np.bitwise_count(masked).astype(np.uint8)


def _cells(max_bits: int, bits: int, groups: int):
    """Each fingerprint's own cells (home) and those that it reaches one step up (not home).

    Two fingerprints within ``max_bits`` differ by at most that much in the
    sum of all segments' count differences, so in one of the groups by at most
    ``max_bits // groups``: by 0, and they share a cell, or by 1, and one's
    step up along a segment leads to the cell of the other.
    """
    if max_bits // groups > 1:
        raise ValueError("more groups are needed for this distance")
    segments = -(-64 // bits)
    if -(-segments // groups) * (bits + 1).bit_length() > 56:
        raise ValueError("a group's counts don't fit into a cell number")
    shared = np.array_split(np.arange(segments), groups)
    width = np.uint64((bits + 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            counts = segment_counts(prints, bits).astype(np.uint64)
            for g, part in enumerate(shared):
                places = np.arange(len(part), dtype=np.uint64) * width
                home = (counts[:, part] << places[None, :]).sum(axis=1, dtype=np.uint64)
                home = home | np.uint64(g << 56)
                cells, owners, homes = [home], [prints], [np.ones(len(home), bool)]
                for j, place in enumerate(places) if max_bits // groups else ():
                    up = counts[:, part[j]] < bits
                    cells.append(home[up] + (np.uint64(1) << place))
                    owners.append(prints[up])
                    homes.append(np.zeros(int(up.sum()), bool))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(cells).view(np.int64)),
                        pa.array(np.concatenate(homes)),
                        pa.array(np.concatenate(owners).view(np.int64)),
                    ],
                    names=["cell", "home", "print"],
                )

    return run


def spanning_links(prints: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links ``first[i]``-``second[i]`` (places in ``prints``), as few as keep the same components.

    Each node ends on the least place that it reaches: labels are lowered along
    links and then followed until nothing changes.
    """
    nodes, flat = np.unique(np.concatenate((first, second)), return_inverse=True)
    x, y = flat[: len(first)], flat[len(first) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return prints[nodes[moved]], prints[nodes[label[moved]]]


def _verify(max_bits: int, bits: int):
    """Links found inside the sorted runs of equal (cell, slices), as spanning links."""

    def pairs(places, prints, sides):
        """Candidates of all runs: home rows with everything after them, across the two slices."""
        a_all, b_all = [], []
        ends = np.repeat(np.append(places[1:], len(prints)), np.diff(np.append(places, len(prints))))
        at = np.flatnonzero(sides != 2)
        step = 0
        while True:
            step += 1
            at = at[at + step < ends[at]]
            if not len(at):
                break
            a, b = prints[at], prints[at + step]
            near = np.bitwise_count(a ^ b) <= max_bits
            if near.any():
                a_all.append(at[near])
                b_all.append(at[near] + step)
                if sum(map(len, a_all)) > 1 << 20:  # keep no more than a spanning set
                    yield np.concatenate(a_all), np.concatenate(b_all)
                    a_all, b_all = [], []
        if a_all:
            yield np.concatenate(a_all), np.concatenate(b_all)

    def links(rows):
        keys = np.stack([rows[k].astype(np.int64) for k in ("cell", "low", "high")])
        places = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1))
        prints, homes = rows["print"].view(np.uint64), rows["home"]
        a, b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for x, y in pairs(places, prints, np.where(homes, 0, 2)):
            more = spanning_links(prints, x, y)
            a, b = np.concatenate((a, more[0])), np.concatenate((b, more[1]))
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell", "low", "high", "home", "print"]
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            if held is not None:
                rows = {n: np.concatenate((held[n], rows[n])) for n in names}
            last = np.flatnonzero(
                (rows["cell"] != rows["cell"][-1])
                | (rows["low"] != rows["low"][-1])
                | (rows["high"] != rows["high"][-1])
            )
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield links({n: rows[n][:cut] for n in names})
            held = {n: rows[n][cut:] for n in names}
        if held is not None:
            yield links(held)

    return run


def near_links(
    prints: DataFrame,
    max_bits: int = MAX_BITS,
    segment_bits: int = SEGMENT_BITS,
    groups: int = GROUPS,
    slice_rows: int = SLICE,
) -> DataFrame:
    """(a, b) links that connect all fingerprints (column ``print``, distinct) within ``max_bits``.

    Only a spanning set of the links of each task's rows comes out, so a dense
    group of n fingerprints gives about n rows, not n squared. A cell with more
    than ``slice_rows`` rows is cut into slices by hash, and every pair of its
    slices is compared on its own, in whichever task.
    """
    if 64 % segment_bits:
        raise ValueError("segments must share 64 bits evenly")
    cells = stage(
        prints.select("print").mapInArrow(
            _cells(max_bits, segment_bits, groups), "cell bigint, home boolean, print bigint"
        ),
        "simhash-cells",
    )
    slices = F.ceil(F.col("rows") / slice_rows).cast("int")
    full = stage(
        cells.groupBy("cell").agg(F.count("*").alias("rows")).where(F.col("rows") > slice_rows)
        .select("cell", slices.alias("slices")),
        "simhash-full-cells",
    )
    own = F.pmod(F.xxhash64("print"), F.col("n")).cast("int")
    sliced = cells.join(full, "cell", "left").select(
        "cell", "home", "print", F.coalesce("slices", F.lit(1)).alias("n")
    ).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    paired = sliced.select("cell", "home", "print", "own", other.alias("other")).select(
        "cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "home", "print"
    )
    grouped = paired.repartition("cell", "low", "high").sortWithinPartitions(
        "cell", "low", "high", F.col("home").desc()
    )
    return grouped.mapInArrow(_verify(max_bits, segment_bits), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """(doc_id, print, component_id), a row per row of ``docs``.

    Fingerprints link at ``max_bits`` or fewer differing bits; component_id is
    the smallest doc_id that links lead to. ``print`` is the fingerprint as a
    bigint.

    Null and blank texts have fingerprint 0 and link like others. Rows that
    repeat an id are kept as rows. A null id is never a component_id; a
    component of such rows alone has a null one. An empty table gives no rows.
    """
    return _rooted_rows(docs, text, doc_id, shingle_words, max_bits).drop("root")


def _rooted_rows(docs: DataFrame, text: str, doc_id: str, shingle_words: int, max_bits: int) -> DataFrame:
    """``near_duplicates`` with ``root``, a fingerprint that tells components apart where ids clash."""
    rows = stage(
        docs.select(F.col(doc_id).alias("doc_id"), simhash_column(F.col(text), shingle_words).alias("print")),
        "simhash-prints",
    )
    prints = stage(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    joined = stage(components(near_links(prints, max_bits)), "simhash-components")
    rooted = prints.join(joined.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    rooted = stage(rooted, "simhash-roots")
    names = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-names")
    named = stage(rooted.join(names, "root").select("print", "component_id", "root"), "simhash-named")
    return rows.join(named, "print").select("doc_id", "print", "component_id", "root")


def hex_print(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def drop_near_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``docs`` with one row of each component, whatever the ids: of those of the smallest id that of the smallest print.

    An id may repeat with other texts, whose rows are judged each by its own
    component; of several rows with the id and print to keep, that of the
    smallest text stays. Rows without an id are kept only where their whole
    component has none, one for each. Extra columns may have any names.
    """
    found = stage(_rooted_rows(docs, text, doc_id, shingle_words, max_bits), "simhash-found")
    kept = (
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min("component_id").alias("kept"), F.min("print").alias("kept_print"))
        .drop("root")
    )
    # Only where an id repeats, or is missing, the text is read again to tell its rows apart.
    repeated = found.where("doc_id is not null").groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("several"))
    repeated = stage(repeated.where("several").select(F.col("doc_id").alias("repeated")), "simhash-repeated-ids")
    kept = stage(kept.join(repeated, F.col("kept") == F.col("repeated"), "left"), "simhash-kept")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), whole_row(docs).alias("row"))
    plain = kept.where("kept is not null and repeated is null").select("kept")
    clear = rows.join(plain, F.col("id") == F.col("kept"), "left_semi").select("row")
    unclear = rows.where("id is null").unionByName(rows.join(repeated, F.col("id") == F.col("repeated"), "left_semi"))
    unclear = unclear.withColumn("print", simhash_column(F.col("text"), shingle_words))
    told = kept.where("kept is null or repeated is not null").select("kept", "kept_print")
    same = F.col("id").eqNullSafe(F.col("kept")) & (F.col("print") == F.col("kept_print"))
    # Rows that also share the text are told apart by all they hold.
    first = F.min_by("row", F.struct("text", F.to_json("row")))
    one = unclear.join(told, same, "left_semi").groupBy("id", "print").agg(first.alias("row")).select("row")
    return clear.unionByName(one).select(*(F.col("row")[c].alias(c) for c in docs.columns))
