"""Benchmark decontamination: windows of a document that are nearly a benchmark item."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.llm.text import WordHasher, as_text, blocks, parts, shingle_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Fingerprints this far apart are candidates. At a similarity of 0.8 the expected distance is
#: 10 bits with a deviation of 3, so a qualifying window is missed with a chance of about 1 in 100,000.
RADIUS = 23
#: Byte-wide blocks of a fingerprint: within RADIUS bits, one of 8 differs by at most 23 // 8 = 2.
BLOCKS = 8
#: Bounds of an index that is broadcast; a larger benchmark takes several, each against all documents.
INDEX_CHARS = 16_000_000
INDEX_ITEMS = 20_000


def _votes(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _prints(counts: np.ndarray, total: int) -> np.ndarray:
    """Fingerprints from the number of shingles that set each bit."""
    return np.packbits(counts * 2 > total, axis=1, bitorder="little").view(np.uint64).ravel()


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and bytes of other scripts."""
    block = WordHasher().read([text])
    raw = block.buffer.tobytes()
    return [raw[a:b] for a, b in zip(block.starts.tolist(), block.ends.tolist())]


def shingles(words: list[bytes], size: int) -> Counter:
    """Runs of ``size`` words with their counts; fewer words are one shingle."""
    if len(words) < size:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*(words[j:] for j in range(size))))


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: shared counts over the larger counts."""
    shared = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


class ItemIndex:
    """Some benchmark items: their shingle hashes, and by item length the block tables of their fingerprints."""

    def __init__(self, items: list[tuple], size: int) -> None:
        self.size = size
        self.ids, self.counts, lengths, prints = [], [], [], []
        owners = defaultdict(set)
        hasher = WordHasher()
        for item_id, text in items:
            block = hasher.read([(text or "").lower().encode("utf-8", "surrogatepass")])
            words = block.hashes()
            if not len(words):
                continue
            raw = block.buffer.tobytes()
            spelled = [raw[a:b] for a, b in zip(block.starts.tolist(), block.ends.tolist())]
            grams = shingle_hashes(words, min(size, len(words)))
            for h in set(grams.tolist()):
                owners[h].add(len(words))
            self.ids.append(item_id)
            self.counts.append(shingles(spelled, size))
            lengths.append(len(words))
            prints.append(_prints(_votes(grams).sum(axis=0, dtype=np.int64)[None, :], len(grams))[0])
        self.prints = np.array(prints, dtype=np.uint64)
        lengths = np.array(lengths, dtype=np.int64)
        self.short = sorted({int(n) for n in lengths if n < size})
        self.hashes = np.array(sorted(owners), dtype=np.uint64)
        #: For each shingle hash, the lengths of the items that hold it.
        self.lengths_of = [sorted(owners[h]) for h in self.hashes.tolist()]
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        bits = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
        near = bits <= RADIUS // BLOCKS
        self.of_length, self.tables = {}, {}
        for n in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == n)
            own = self.prints[mine].view(np.uint8).reshape(-1, BLOCKS)
            self.of_length[n] = mine
            self.tables[n] = np.stack([near[:, own[:, j]] for j in range(BLOCKS)])

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that some item holds, and which of the index's hashes they are."""
        at = np.flatnonzero(self.filter[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return at, at
        place = np.searchsorted(self.hashes, hashes[at])
        place[place == len(self.hashes)] = 0
        same = self.hashes[place] == hashes[at]
        return at[same], place[same]

    def near(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, bits) for all items of ``n`` words within RADIUS of the fingerprints."""
        tables, mine = self.tables[n], self.of_length[n]
        parts = prints.view(np.uint8).reshape(-1, BLOCKS)
        close = tables[0][parts[:, 0]].copy()
        for j in range(1, BLOCKS):
            close |= tables[j][parts[:, j]]
        row, item = np.nonzero(close)
        bits = np.bitwise_count(prints[row] ^ self.prints[mine[item]])
        keep = bits <= RADIUS
        return row[keep], mine[item[keep]], bits[keep]


def _window_starts(places: np.ndarray, before: int, last: int) -> np.ndarray:
    """Every window start from 0 to ``last`` at most ``before`` words ahead of one of the sorted ``places``, once."""
    low, high = np.maximum(places - before, 0), np.minimum(places, last)
    gaps = np.flatnonzero(low[1:] > high[:-1] + 1)
    first, final = low[np.append(0, gaps + 1)], high[np.append(gaps, len(high) - 1)]
    return np.concatenate([np.arange(a, b + 1) for a, b in zip(first.tolist(), final.tolist())])


def _spans(starts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted ``starts`` in parts that each reach over fewer than ``width`` words, however far apart they lie."""
    at = 0
    while at < len(starts):
        end = int(np.searchsorted(starts, starts[at] + width))
        yield starts[at:end]
        at = end


def _leaks_in(index: ItemIndex, words: np.ndarray, hits: dict[int, set], spell, threshold: float) -> list[tuple]:
    """Best window per item in one document. ``hits``: item length -> places of shingles that such items hold."""
    best: dict[int, tuple] = {}
    for n, places in sorted(hits.items()):
        width = min(n, len(words))
        size = min(index.size, n)
        if len(words) < size:
            continue
        last = len(words) - width
        starts = _window_starts(np.array(sorted(places), dtype=np.int64), width - size, last)
        low, per = int(starts[0]), width - size + 1
        grams = shingle_hashes(words[low : int(starts[-1]) + width], size)
        for part in _spans(starts, 4096):
            base = int(part[0]) - low
            votes = _votes(grams[base : int(part[-1]) - low + per])
            sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(votes, axis=0, dtype=np.int32)))
            at = part - part[0]
            prints = _prints(sums[at + per] - sums[at], per)
            for row, item, bits in zip(*(x.tolist() for x in index.near(n, prints))):
                start = int(part[row])
                alike = weighted_similarity(shingles(spell(start, start + width), index.size), index.counts[item])
                if alike >= threshold and (item not in best or alike > best[item][3]):
                    best[item] = (start, width, bits, alike)
    return [(index.ids[i], *w) for i, w in sorted(best.items())]


def _scan(index: ItemIndex, threshold: float, item_type: str):
    kind = f"array<struct<item_id:{item_type},start_word:int,n_words:int,bits:int,similarity:double>>"

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = WordHasher()
        arrow = None
        for texts in parts(batches):
            out = []
            lowered = [t.lower().encode("utf-8", "surrogatepass") for t in as_text(texts)]
            for _, block in blocks(lowered):
                found = hasher.read(block)
                words = found.hashes()
                first = found.first
                hits: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
                for size in [*index.short, index.size]:
                    at, which = index.found(shingle_hashes(words, size))
                    doc = np.searchsorted(first, at, side="right") - 1
                    inside = at + size <= first[doc + 1]
                    for a, w, d in zip(at[inside].tolist(), which[inside].tolist(), doc[inside].tolist()):
                        for n in index.lengths_of[w]:
                            if min(n, index.size) == size:
                                hits[d][n].add(a - int(first[d]))
                raw = found.buffer

                def leaks(d: int) -> list[tuple]:
                    low = int(first[d])

                    def spell(a: int, b: int) -> list[bytes]:
                        x, y = found.starts[low + a : low + b], found.ends[low + a : low + b]
                        return [raw[i:j].tobytes() for i, j in zip(x.tolist(), y.tolist())]

                    return _leaks_in(index, words[low : int(first[d + 1])], hits[d], spell, threshold)

                out += [leaks(d) if d in hits else [] for d in range(len(block))]
            names = ("item_id", "start_word", "n_words", "bits", "similarity")
            rows = [[dict(zip(names, leak)) for leak in row] for row in out]
            arrow = arrow or _arrow_type(item_type)
            yield pa.array(rows, arrow)

    return F.arrow_udf(run, kind)


def _arrow_type(item_type: str) -> pa.DataType:
    item = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_type]
    return pa.list_(
        pa.struct(
            [
                ("item_id", item),
                ("start_word", pa.int32()),
                ("n_words", pa.int32()),
                ("bits", pa.int32()),
                ("similarity", pa.float64()),
            ]
        )
    )


def leaks(
    text: Column,
    benchmark: DataFrame,
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = SIMILARITY,
    shingle_words: int = SHINGLE_WORDS,
) -> Column:
    """array<struct<item_id, start_word, n_words, bits, similarity>>: the items that a text holds.

    Every window of as many words as an item has (the whole text if it has
    fewer) is compared with it: SimHash fingerprints within RADIUS bits by the
    multi-index, then weighted Jaccard of the shingles, which must reach
    ``threshold``. The best window of an item is reported, the first of equals.
    Only windows that share a shingle with some item of their length are
    fingerprinted; others have similarity 0.

    Words are runs of letters and digits, lower-cased. Null or empty texts and
    items hold nothing; items of the same text are reported under each id; a
    null item_id is reported as null. An empty benchmark finds nothing. The
    benchmark is read in blocks of bounded size, one index each, and each
    is held against all texts.
    """
    kind = benchmark.schema[item_id].dataType.simpleString()
    if kind not in ("bigint", "int", "string"):
        raise TypeError(f"item ids of type {kind}")
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-n // INDEX_ITEMS), -(-chars // INDEX_CHARS))
    found = []
    for part in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == part).collect()
        index = ItemIndex(sorted(map(tuple, rows), key=repr), shingle_words)
        found.append(_scan(index, threshold, kind)(text))
    return found[0] if passes == 1 else F.concat(*found)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, bits, similarity), a row per document and item that it holds.

    Rows that repeat an id and a text give one row. Clean documents give none.
    """
    found = docs.select(F.col(doc_id).alias("doc_id"), F.explode(leaks(F.col(text), benchmark, **settings)).alias("leak"))
    return found.select("doc_id", "leak.*").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **settings) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item."""
    return docs.where(F.size(leaks(F.col(text), benchmark, **settings)) == 0)
