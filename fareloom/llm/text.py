"""Texts as byte strings and word hashes, for the functions that run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the line and word rules: space, tab, line feed, vertical tab, form feed, return.
BLANKS = b" \t\n\x0b\x0c\r"

#: Bytes per block of texts that are handled together; a longer text is a block of its own.
BLOCK = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by name, whatever characters the names hold."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that helper columns beside it clash with none of them."""
    return F.struct(*columns_of(df))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text falls into ``fold``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def parts(batches: Iterator, size: int = 2 * BLOCK) -> Iterator:
    """Every batch in slices of about ``size`` bytes of text, copied nowhere.

    A batch is an array of texts, or a tuple whose first array is. What a task
    makes of a slice, and not of a whole batch of long texts, is what it holds.
    A worker outlives its tasks, so Arrow memory that earlier batches and tasks
    have freed goes back to the system here.
    """
    for batch in batches:
        pa.default_memory_pool().release_unused()
        texts = batch[0] if isinstance(batch, tuple) else batch
        if not len(texts):
            yield batch
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < len(texts):
            done = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + size, side="right")))
            high = min(high, low + 4096)
            if isinstance(batch, tuple):
                yield tuple(column.slice(low, high - low) for column in batch)
            else:
                yield batch.slice(low, high - low)
            low = high
    pa.default_memory_pool().release_unused()


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null becomes the empty text."""
    return [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]


def as_text(texts: pa.Array) -> list[str]:
    return [t or "" for t in texts.to_pylist()]


def blocks(texts: list[bytes], size: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of consecutive texts of about ``size`` bytes, with the place of the first."""
    first, held = 0, 0
    for at, text in enumerate(texts):
        held += len(text) + 1
        if held >= size:
            yield first, texts[first : at + 1]
            first, held = at + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def letters_and_digits() -> np.ndarray:
    """Which byte values belong to words: ASCII letters, digits and every byte of other scripts."""
    table = np.zeros(256, dtype=bool)
    for low, high in ((b"0", b"9"), (b"A", b"Z"), (b"a", b"z"), (b"\x80", b"\xff")):
        table[low[0] : high[0] + 1] = True
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """Hashes all words of a block of texts at once.

    A prefix sum of bytes times powers of an odd number gives the hash of any
    byte range by one subtraction, so a word, its beginning or its end cost
    the same whatever their length.
    """

    def __init__(self) -> None:
        self.word_byte = letters_and_digits()
        self._grow(BLOCK)

    def _grow(self, size: int) -> None:
        ones = np.ones(size, dtype=np.uint64)
        ones[1:] = _ODD
        self.power = np.cumprod(ones)
        ones[1:] = _INVERSE
        self.inverse = np.cumprod(ones)

    def read(self, texts: list[bytes]) -> WordBlock:
        buffer = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        if len(buffer) > len(self.power):
            self._grow(len(buffer) + BLOCK)
        inside = self.word_byte[buffer]
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            change = np.concatenate(([0], change))
        starts, ends = change[0::2], change[1::2]
        weighted = (buffer.astype(np.uint64) + np.uint64(1)) * self.power[: len(buffer)]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(weighted)))
        edges = np.cumsum([0] + [len(t) + 1 for t in texts])
        return WordBlock(buffer, starts, ends, sums, np.searchsorted(starts, edges), self.inverse)


class WordBlock:
    """Word places of a block; words ``first[i]:first[i + 1]`` are those of text ``i``."""

    def __init__(self, buffer, starts, ends, sums, first, inverse) -> None:
        self.buffer, self.starts, self.ends, self.sums, self.first = buffer, starts, ends, sums, first
        self._inverse = inverse

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """Hash of each byte range, the words themselves by default."""
        starts = self.starts if starts is None else starts
        ends = self.ends if ends is None else ends
        return mixed((self.sums[ends] - self.sums[starts]) * self._inverse[starts])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` word hashes, ``len(words) - size + 1`` of them."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for j in range(size):
        total = total * _ODD + words[j : j + count]
    return mixed(total)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One Arrow list per array."""
    sizes = np.cumsum([0] + [len(p) for p in parts])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, kind))
