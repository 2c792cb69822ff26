"""Line dedup: lines that many documents share stay in one of them only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.llm.text import BLANKS, as_bytes, parts, whole_row
from fareloom.staging import stage

MIN_CHARS = 40
MIN_DOCS = 5


def line_digest(line: bytes, min_chars: int) -> bytes | None:
    """128 bits that stand for a line's key; None if the key is shorter than ``min_chars``.

    The key is the line without blanks at both ends and with A-Z in lower case.
    """
    key = line.strip(BLANKS).lower()  # of bytes: ASCII letters only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.md5(key, usedforsecurity=False).digest()


def _digests(min_chars: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts(batches):
            found = []
            for text in as_bytes(texts):
                keys = dict.fromkeys(line_digest(line, min_chars) for line in text.split(b"\n"))
                keys.pop(None, None)
                found.append(list(keys))
            yield pa.array(found, pa.list_(pa.binary()))

    return F.arrow_udf(run, "array<binary>")


def _rewritten(min_chars: int):
    kind = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, drops in parts(batches):
            kept, lines, dropped = [], [], []
            for text, drop in zip(as_bytes(texts), drops.to_pylist()):
                lines.append(text.count(b"\n") + 1)
                if drop:
                    gone = set(drop)
                    left = [x for x in text.split(b"\n") if line_digest(x, min_chars) not in gone]
                    dropped.append(lines[-1] - len(left))
                    text = b"\n".join(left)
                else:
                    dropped.append(0)
                kept.append(text.decode("utf-8", "replace"))
            yield pa.StructArray.from_arrays(
                [pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                fields=list(kind),
            )

    return F.arrow_udf(run, "struct<text string, n_lines bigint, n_dropped bigint>")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, digest, keys): the digests of the lines that each text of a document loses.

    ``digest`` is that of the whole text. It keeps rows without an id, or with
    the same one, apart, so that no group holds more than one text's keys.

    Every document counts once per key. The count combines before each
    exchange, and the frequent keys are a table of their own, so that the join
    back to the lines is between two plain exchanges and a key that most
    documents hold is split over tasks.
    """
    lines = stage(
        docs.select("doc_id", F.xxhash64("text").alias("digest"), F.explode(_digests(min_chars)(F.col("text"))).alias("key")),
        "line-keys",
    )
    frequent = stage(
        lines.groupBy("key")
        .agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("key", "keeper"),
        "frequent-lines",
    )
    lost = lines.join(frequent, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "digest").agg(F.collect_set("key").alias("keys"))


def line_dedup(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """All columns of ``docs`` with the shared lines gone from ``text``, plus ``line_counts``.

    A key of at least ``min_chars`` code points that at least ``min_docs``
    documents hold loses all its lines except in the document with the largest
    id holding it, where all stay. ``line_counts`` is a struct of ``n_lines``
    (before) and ``n_dropped``. A column that is already called ``line_counts``
    is replaced.

    Null or empty text is one empty line and comes back as empty text. Rows
    that repeat an id are one document: they count once and lose the same
    lines. Rows without an id count for nothing and lose every frequent line.
    An empty table gives an empty table.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    lost = dropped_lines(source, min_chars, min_docs)
    # The text goes through the join once, inside its row.
    whole = docs.select(
        F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_digest"), whole_row(docs).alias("_row")
    )
    joined = whole.join(
        lost.select(F.col("doc_id").alias("_lost_id"), F.col("digest").alias("_lost_digest"), F.col("keys").alias("_lost")),
        F.col("_id").eqNullSafe(F.col("_lost_id")) & (F.col("_digest") == F.col("_lost_digest")),
        "left",
    )
    done = joined.select("_row", _rewritten(min_chars)(F.col("_row")[text], F.col("_lost")).alias("_new"))
    columns = [
        (F.col("_new.text") if c == text else F.col("_row")[c]).alias(c) for c in docs.columns if c != "line_counts"
    ]
    return done.select(*columns, F.struct("_new.n_lines", "_new.n_dropped").alias("line_counts"))
