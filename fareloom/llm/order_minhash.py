"""Order MinHash fingerprints: likeness of texts that falls with their edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.llm.text import mixed, shingle_hashes

KMER = 8
#: Entries of a fingerprint, and k-mers in each entry's tuple.
ENTRIES = 48
TUPLE = 2
SEED = 5
#: Hex digits of an entry.
DIGITS = 4

_STEP = np.uint64(0x9E3779B97F4A7C15)


def multipliers(entries: int = ENTRIES) -> np.ndarray:
    """One odd number per entry; it orders the k-mers' 32-bit hashes anew."""
    return np.random.default_rng(SEED).integers(0, 1 << 31, entries, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def numbered_kmers(text: str, k: int = KMER) -> np.ndarray:
    """A hash per k-mer of code points in text order; equal k-mers are told apart by how many came before.

    A text shorter than k is one k-mer; the empty text has a k-mer of its own.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(points) < k:
        return mixed(np.array([len(points)], np.uint64) + shingle_hashes(points + np.uint64(1), len(points)).sum(keepdims=True))
    hashes = shingle_hashes(points + np.uint64(1), k)
    low = np.uint64(max(1, int(len(hashes)).bit_length()))
    keys = np.sort(((hashes >> low) << low) | np.arange(len(hashes), dtype=np.uint64))
    at = (keys & np.uint64((1 << int(low)) - 1)).astype(np.int64)
    kinds = keys >> low
    index = np.arange(len(keys))
    start = np.where(np.concatenate(([True], kinds[1:] != kinds[:-1])), index, 0)
    occurrence = np.empty(len(keys), np.uint64)
    occurrence[at] = index - np.maximum.accumulate(start)
    return mixed(hashes + occurrence * _STEP)


def sketch(kmers: np.ndarray, factors: np.ndarray, size: int = TUPLE) -> np.ndarray:
    """One number per entry: the ``size`` least k-mers under the entry's order, in text order, hashed together.

    Fewer k-mers than ``size`` are all taken.
    """
    n = len(kmers)
    size = min(size, n)
    short = kmers.astype(np.uint32)
    limit = min(1.0, 10 * size / n)
    chosen = np.empty((len(factors), size), np.int64)
    if limit < 1:
        block = max(1, (1 << 22) // n)  # entries at a time, so that a long text takes bounded memory
        for low in range(0, len(factors), block):
            part = factors[low : low + block]
            order = short[None, :] * part[:, None]
            row, place = np.nonzero(order < np.uint32(limit * 0xFFFFFFFF))
            counts = np.bincount(row, minlength=len(part))
            ranked = np.argsort((row.astype(np.uint64) << np.uint64(32)) | order[row, place], kind="stable")
            starts = np.cumsum(counts) - counts
            full = counts >= size
            for j in range(size):
                chosen[low : low + block][full, j] = place[ranked[starts[full] + j]]
            for r in np.flatnonzero(~full):
                chosen[low + r] = np.argsort(order[r], kind="stable")[:size]
    else:
        order = short[None, :] * factors[:, None]
        chosen[:] = np.argsort(order, axis=1, kind="stable")[:, :size]
    chosen.sort(axis=1)
    total = np.zeros(len(factors), np.uint64)
    for j in range(size):
        total = total * _STEP + kmers[chosen[:, j]]
    return mixed(total) >> np.uint64(64 - 4 * DIGITS)


def fingerprint(text: str, factors: np.ndarray | None = None, k: int = KMER) -> np.ndarray:
    """The sketch of a whole text."""
    return sketch(numbered_kmers(text, k), multipliers() if factors is None else factors)


def as_hex(entries: np.ndarray) -> str:
    return "".join(f"{int(e):0{DIGITS}x}" for e in entries)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries, 0 to 1."""
    return float((a == b).mean())


def fingerprints(text: Column, entries: int = ENTRIES, k: int = KMER) -> Column:
    """Fingerprint of a text column as a hex string; null text counts as empty."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        factors = multipliers(entries)
        for texts in batches:
            yield pa.array([as_hex(fingerprint(t or "", factors, k)) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)


def in_id_order(rows: DataFrame, rows_per_bucket: int = 2000) -> DataFrame:
    """``rows`` (doc_id, text) in descending id order within each task, the row after a task's last one behind it.

    One shuffle moves every text once. Quantiles of the ids cut them into
    buckets; the first document of a bucket goes to the bucket before it as
    well, and the very first one to the last, with ``tail`` set. Only the cuts
    and the buckets' first ids come to the driver, at most 20,000 of each.
    """
    n = rows.count()
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = int(min(20_000, max(4 * partitions, n // rows_per_bucket, 1)))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = rows.agg(F.percentile_approx("doc_id", F.lit(shares), F.lit(20_000)).alias("c")).first()["c"] if n else []
    cuts = np.unique(np.array(cuts or [], dtype=np.int64))

    def bucket_of(ids: pa.Array) -> np.ndarray:
        """0 for the largest ids; ids that are null go with the smallest."""
        known = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return len(cuts) - np.searchsorted(cuts, known, side="left")

    def bucket(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            yield pa.array(bucket_of(ids), pa.int32())

    named = rows.select("doc_id", F.arrow_udf(bucket, "int")(F.col("doc_id")).alias("bucket"))
    firsts = sorted(named.groupBy("bucket").agg(F.max("doc_id").alias("first")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}

    def targets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("bucket", pa.int32()), ("tail", pa.bool_())]))
        for ids in batches:
            out = []
            for own, doc_id in zip(bucket_of(ids).tolist(), ids.to_pylist()):
                row = [{"bucket": own, "tail": False}]
                if doc_id in before:
                    row.append({"bucket": before[doc_id], "tail": True})
                out.append(row)
            yield pa.array(out, kind)

    dealt = rows.select(
        "doc_id",
        "text",
        F.explode(F.arrow_udf(targets, "array<struct<bucket:int,tail:boolean>>")(F.col("doc_id"))).alias("to"),
    ).select("to.bucket", "to.tail", "doc_id", "text")
    return dealt.repartition("bucket").sortWithinPartitions(
        "bucket", "tail", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()
    )


def edited_pairs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document against an edited copy and against the next document.

    The copy has its last floor(n_chars / 2) code points replaced by the first
    as many of the next document, or all of it if it has fewer. The next
    document is the next row in descending doc_id order (rows that repeat an id
    follow each other by text, null ids come last); after the last row comes the
    first. Returns doc_id, n_chars, edited (the copy's text), fingerprint,
    edited_fingerprint, near_edited and near_next, a row per row of ``docs``.

    Null text counts as empty. A table of one row is its own next document. An
    empty table gives no rows. Ids must be integers.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers()
        names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        waiting = None
        out: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for rows in batches:
            values = (rows.column(i).to_pylist() for i in range(4))
            for bucket, tail, key, whole in zip(*values):
                whole = whole or ""
                if waiting is None and tail:
                    continue  # a further row of the tail
                mine = fingerprint(whole, factors)
                if waiting is not None:
                    key_before, before, print_before = waiting
                    half = len(before) // 2
                    edited = before[: len(before) - half] + whole[:half]
                    other = fingerprint(edited, factors)
                    out.append(
                        (key_before, len(before), edited, as_hex(print_before), as_hex(other),
                         likeness(print_before, other), likeness(print_before, mine))
                    )
                    held += len(edited)
                    if held > 1 << 22:
                        yield batch()
                        out.clear()
                        held = 0
                waiting = None if tail else (key, whole, mine)
        if out:
            yield batch()

    schema = (
        "doc_id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return in_id_order(rows).mapInArrow(run, schema)
