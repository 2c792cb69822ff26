"""MinHash near-dedup by an inverted join over signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.llm.components import components
from fareloom.llm.set_links import ROW_ITEMS, Enough, linked_within
from fareloom.llm.text import BLANKS, BLOCK, WordHasher, as_bytes, blocks, list_array, mixed, parts, shingle_hashes
from fareloom.staging import stage

SHINGLE_WORDS = 3
PERCENT = 85
COORDINATES = 64
#: Chance that a pair just at the limit has fewer equal coordinates than the match threshold.
MISS = 1e-9


def match_threshold(coordinates: int = COORDINATES, percent: int = PERCENT, miss: float = MISS) -> int:
    """The number of equal coordinates that a pair at the limit has but for a chance of ``miss``."""
    p, below, count = percent / 100, 0.0, 0
    while True:
        below += comb(coordinates, count) * p**count * (1 - p) ** (coordinates - count)
        if below > miss:
            return max(1, count)
        count += 1


def _hasher() -> WordHasher:
    """Words are whatever stands between ASCII blanks."""
    hasher = WordHasher()
    table = np.ones(256, bool)
    table[list(BLANKS)] = False
    hasher.word_byte = table
    return hasher


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that end at blanks; a word is never cut."""
    low = 0
    while len(text) - low > BLOCK:
        high = low + BLOCK
        while high < len(text) and text[high] not in BLANKS:
            high += 1
        yield text[low:high]
        low = high
    yield text[low:]


def document_shingles(hasher: WordHasher, texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Hashes of every text's shingles, repeats included; a shorter text is one shingle, one without words none."""
    for _, block in blocks([t.lower() for t in texts]):
        if len(block) == 1 and len(block[0]) > BLOCK:
            words = [np.concatenate([hasher.read([p]).hashes() for p in _pieces(block[0])])]
        else:
            read = hasher.read(block)
            hashes = read.hashes()
            words = [hashes[read.first[i] : read.first[i + 1]] for i in range(len(block))]
        for found in words:
            yield shingle_hashes(found, min(size, len(found))) if len(found) else found


def _digest(distinct: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(distinct.tobytes())


def signatures(shingles: list[np.ndarray], coordinates: int) -> np.ndarray:
    """A row per set: in each coordinate the least hash under that coordinate's own hash function, 32 bits of it."""
    starts = np.concatenate(([0], np.cumsum([len(s) for s in shingles])[:-1])).astype(np.int64)
    flat = np.concatenate(shingles)
    found = np.empty((len(shingles), coordinates), np.int64)
    for i, seed in enumerate(mixed(np.arange(1, coordinates + 1, dtype=np.uint64))):
        found[:, i] = (np.minimum.reduceat(mixed(flat ^ seed), starts) >> np.uint64(32)).astype(np.int64)
    return found


def signature_column(text: Column, words: int = SHINGLE_WORDS, coordinates: int = COORDINATES) -> Column:
    """Struct of n_shingles, a digest of the shingle set and its tokens, a number per coordinate and value.

    A text without words has no shingles, a null digest and null tokens.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = _hasher()
        for texts in parts(batches):
            sets = list(document_shingles(hasher, as_bytes(texts), words))
            distinct = [np.unique(s) for s in sets]
            full = [i for i, s in enumerate(sets) if len(s)]
            tokens = [None] * len(sets)
            if full:
                places = np.arange(coordinates, dtype=np.int64) << 32
                for i, row in zip(full, signatures([sets[i] for i in full], coordinates) | places):
                    tokens[i] = row
            yield pa.StructArray.from_arrays(
                [
                    pa.array([len(s) for s in distinct], pa.int64()),
                    pa.array([_digest(s) if len(s) else None for s in distinct], pa.binary()),
                    pa.array(tokens, pa.list_(pa.int64())),
                ],
                names=["n", "digest", "tokens"],
            )

    return F.arrow_udf(run, "n bigint, digest binary, tokens array<bigint>")(text)


def _sets(words: int):
    """(digest, size, items) of every text of a batch, a set in rows of up to ``ROW_ITEMS``, with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for texts in parts(batch.column(0) for batch in batches):
            digests, sizes, places, items = [], [], [], []
            for shingles in document_shingles(hasher, as_bytes(texts), words):
                distinct = np.unique(shingles)
                digest = _digest(distinct)
                for place in range(0, len(distinct), ROW_ITEMS):
                    digests.append(digest)
                    sizes.append(len(distinct))
                    places.append(place)
                    items.append(distinct[place : place + ROW_ITEMS].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(places, pa.int64()), list_array(items, pa.int64())],
                names=["digest", "size", "place", "items"],
            )

    return run


def candidate_links(classes: DataFrame, matches: int) -> DataFrame:
    """(a, b) links over ``cls`` that connect all rows of (cls, tokens) with at least ``matches`` equal tokens.

    Documents are posted under each token. Tokens of one document only are
    dropped, and documents left with too few. What is left of a document is
    ordered by frequency; of two with enough equal tokens each has one of them
    among all but its ``matches`` - 1 most frequent, so only under that prefix
    a document is looked up, and the long lists of common tokens are skipped.
    Of lists with the same members one is merged.
    """
    postings = classes.select("cls", F.explode("tokens").alias("token"))
    counts = stage(postings.groupBy("token").count().where("count > 1"), "minhash-counts")
    shared = postings.join(counts, "token").groupBy("cls").agg(
        F.sort_array(F.collect_list(F.struct(F.col("count").alias("rows"), "token"))).alias("by_rows")
    )
    shared = shared.where(F.size("by_rows") >= matches).select(
        "cls",
        F.col("by_rows.token").alias("tokens"),
        F.slice(F.col("by_rows.token"), F.lit(1), F.size("by_rows") - (matches - 1)).alias("prefix"),
    )
    shared = stage(shared, "minhash-prefixes")
    listed = shared.select("cls", F.explode("prefix").alias("token"))
    lists = listed.groupBy("token").agg(
        F.count("*").alias("rows"), F.bit_xor(F.xxhash64("cls")).alias("who"), F.min("cls").alias("low"), F.max("cls").alias("high")
    )
    kept = stage(lists.where("rows > 1").groupBy("rows", "who", "low", "high").agg(F.min("token").alias("token")), "minhash-lists")
    members = listed.join(kept.select("token"), "token").join(shared.select("cls", "tokens"), "cls")
    sets = members.select(
        F.col("token").alias("group_id"), F.col("cls").alias("member"), F.size("tokens").cast("bigint").alias("size"), F.col("tokens").alias("items")
    )
    return linked_within(stage(sets, "minhash-members"), Enough(least=matches))


def near_duplicate_sets(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    shingle_words: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    coordinates: int = COORDINATES,
    miss: float = MISS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of ``docs``.

    Two documents are linked if the sets of their shingles share ``percent``
    of their union; component_id is the smallest doc_id that links lead to,
    kept says whether it is the document's own. Equal sets become one class
    first. Signatures propose pairs of classes, and all that they connect are
    compared by their full sets, so no link is wrong, and one is missed with a
    chance of at most ``miss``.

    Null and blank texts have no shingles and are linked with nothing. Rows
    that repeat an id are kept as rows. A null id is never a component_id; a
    component of such rows alone has a null one, and its rows are all kept. An
    empty table gives no rows.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = docs.select("doc_id", signature_column(F.col("text"), shingle_words, coordinates).alias("s"))
    rows = stage(rows.select("doc_id", "s.*"), "minhash-rows")
    classes = rows.where("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.max("n").alias("size"), F.any_value("tokens").alias("tokens")
    )
    classes = stage(classes.withColumn("cls", F.monotonically_increasing_id()), "minhash-classes")
    found = candidate_links(classes, match_threshold(coordinates, percent, miss))
    clusters = stage(components(stage(found, "minhash-candidates")).toDF("cls", "group_id"), "minhash-clusters")

    proposed = stage(
        classes.join(clusters, "cls").select("digest", "least", "group_id", F.col("cls").alias("member")), "minhash-proposed"
    )
    read = docs.join(proposed.select("least").distinct(), F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    sets = read.select("text").mapInArrow(_sets(shingle_words), "digest binary, size bigint, place bigint, items array<bigint>")
    sets = sets.groupBy("digest", "size", "place").agg(F.any_value("items").alias("items"))
    sets = stage(sets.join(proposed, "digest").select("group_id", "member", "size", "items"), "minhash-sets")
    links = stage(linked_within(sets, Enough(percent=percent)), "minhash-links")
    linked = stage(components(links).toDF("cls", "root"), "minhash-roots")

    rooted = stage(
        classes.join(linked, "cls", "left").select("digest", "least", F.coalesce("root", "cls").alias("root")), "minhash-rooted"
    )
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(rooted.join(names, "root").select("digest", "component_id"), "minhash-named")
    return rows.join(named, "digest", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
