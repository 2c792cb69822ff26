"""Phrase collocations, counted over a prefix-free parse of the texts.

The parse cuts every text where the hash of the three words that follow says
so, so equal passages are cut alike wherever they stand. A chunk carries the
three words that follow it in its piece as its tail; distinct chunks with
their frequencies are the dictionary. A phrase of up to four words is counted
in the chunk in whose body it begins, weighted by the chunk's frequency: it
ends in the tail at the latest, and no phrase is counted twice.

Phrases are counted by length. One of n words is looked at only if both its
phrases of n - 1 words passed, which a bitmap of fixed size tells by hash; a
bit too many costs time and nothing else. The last pass counts what is left by
its words, so no result rests on a hash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareloom.llm.text import BLOCK, WordBlock, WordHasher, as_bytes, blocks, mixed, parts, shingle_hashes
from fareloom.staging import stage

MAX_WORDS = 4
LEAST = 30
TOP = 2000
#: A phrase goes if a longer one around it has so many percent of its frequency.
COVERED = 80
#: One in so many places is a cut.
CUT_ONE_IN = 32
#: Bits of the bitmap of phrases that passed; fixed, whatever the input.
FILTER_BITS = 1 << 26
NO_LANG = "und"

#: Blanks part words, breaks part pieces.
BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_TAIL = MAX_WORDS - 1
_NEXT = re.compile(rb"(?:[ \t]*[^ \t.,;:!?\n-\r]+){0,%d}" % _TAIL)
#: Bytes of chunks handled together, and keys held before they are added up.
_READ, _HELD = 4 * BLOCK, 1 << 21


def _hasher(apart: bytes) -> WordHasher:
    hasher = WordHasher()
    table = np.ones(256, bool)
    table[list(apart)] = False
    hasher.word_byte = table
    return hasher


def _units(text: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """A text, or a long one in parts: with each, the words at its end that belong to the next."""
    low = 0
    while len(text) - low > size:
        high = low + size
        while high < len(text) and text[high] not in BLANKS + BREAKS:
            high += 1
        ahead = _NEXT.match(text, high).group()
        yield text[low:high] + ahead, len(ahead.split())
        low = high
    yield text[low:], 0


def _breaks(block: WordBlock, apart: bytes) -> np.ndarray:
    """Whether a break stands before each word."""
    table = np.zeros(256, np.int64)
    table[list(apart)] = 1
    so_far = np.concatenate(([0], np.cumsum(table[block.buffer])))
    before = np.concatenate(([0], block.ends[:-1]))
    found = so_far[block.starts] > so_far[before]
    found[:1] = True
    return found


def chunks(hasher: WordHasher, units: list[tuple[bytes, int]], one_in: int) -> tuple[list[bytes], np.ndarray]:
    """The chunks of some texts in lower case, and the words in the body of each.

    A chunk is its body, a tab and its tail; words are parted by a space,
    pieces by a line feed.
    """
    block = hasher.read([text for text, _ in units])
    if not len(block.starts):
        return [], np.zeros(0, np.int64)
    broken = _breaks(block, BREAKS)
    firsts = block.first[:-1]
    limits = block.first[1:] - np.array([tail for _, tail in units])
    cut = np.zeros(len(block.starts) + 1, bool)
    windows = shingle_hashes(block.hashes(), _TAIL)
    cut[: len(windows)] = windows % np.uint64(one_in) == 0
    for shift in range(1, _TAIL):  # windows that run into the next text
        cut[np.maximum(block.first[1:] - shift, 0)] = False
    behind = np.flatnonzero(limits < block.first[1:])
    for i in behind:
        cut[limits[i] : block.first[i + 1]] = False
    full = limits > firsts
    cut[firsts[full]] = True
    cut[-1] = False
    low = np.flatnonzero(cut)
    owner = np.searchsorted(block.first, low, side="right") - 1
    high = np.minimum(np.append(low[1:], len(block.starts)), limits[owner])
    tails, going = np.zeros(len(low), np.int64), np.ones(len(low), bool)
    for j in range(_TAIL):
        at = high + j
        going &= at < block.first[owner + 1]
        going &= ~broken[np.minimum(at, len(broken) - 1)]
        tails += going
    sizes = block.ends - block.starts
    plain = block.buffer.copy()
    plain[block.ends] = ord(" ")
    plain[block.ends[:-1][broken[1:]]] = ord("\n")
    keep = hasher.word_byte[block.buffer]
    keep[block.ends] = True
    text = plain[keep].tobytes()
    place = np.concatenate(([0], np.cumsum(sizes + 1)))
    edges = zip(place[low].tolist(), (place[high] - 1).tolist(), place[high].tolist(), (place[high + tails] - 1).tolist())
    return [text[a:b] + b"\t" + text[c:d] for a, b, c, d in edges], high - low


def _parse(one_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher(BLANKS + BREAKS)
        for texts, langs in parts((b.column("text"), b.column("lang")) for b in batches):
            langs = langs.to_pylist()
            units, owners = [], []
            for lang, text in zip(langs, as_bytes(texts)):
                for unit in _units(text.lower(), BLOCK):
                    units.append(unit)
                    owners.append(lang)
            for first, block in blocks([text for text, _ in units]):
                # a text is a unit or more, so what one chunk says never mixes languages
                for lang in dict.fromkeys(owners[first : first + len(block)]):
                    mine = [units[i] for i in range(first, first + len(block)) if owners[i] == lang]
                    found, words = chunks(hasher, mine, one_in)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found), pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(words, pa.int64())],
                        names=["lang", "chunk", "words"],
                    )

    return run


def dictionary(docs: DataFrame, text: str, lang: str, one_in: int = CUT_ONE_IN) -> DataFrame:
    """(lang, chunk, words, times): the distinct chunks of the parse with their frequencies."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit(NO_LANG)).alias("lang"))
    parsed = rows.mapInArrow(_parse(one_in), "lang string, chunk string, words bigint")
    return parsed.groupBy("lang", "chunk").agg(F.max("words").alias("words"), F.count("*").alias("times"))


class Grams:
    """Phrases of a run of chunks: their keys by length, where they count and how often."""

    def __init__(self, hasher: WordHasher, langs: list[str], texts: list[bytes], times: np.ndarray) -> None:
        self.block = block = hasher.read(texts)
        self.words = block.hashes()
        of = np.repeat(np.arange(len(texts)), np.diff(block.first))
        tabs = np.flatnonzero(block.buffer == ord("\t"))
        self.body = block.starts < tabs[of]
        self.times = times[of]
        seeds = {name: xxhash.xxh64_intdigest(name.encode(), 7) for name in dict.fromkeys(langs)}
        self.seed = np.array([seeds[name] for name in langs], np.uint64)[of]
        self.of = of
        self.whole = ~_breaks(block, b"\n")  # no break between a word and the one before

    def level(self, size: int, passed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the phrases of ``size`` words by first word, and which of them may count."""
        count = len(self.words) - size + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        keys = mixed(shingle_hashes(self.words, size) ^ self.seed[:count] ^ np.uint64(size))
        whole = np.ones(count, bool)
        for j in range(1, size):
            whole &= self.whole[j : j + count]
        if passed is not None:
            whole &= passed[:count] & passed[1 : count + 1]
        return keys, whole


def _holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes], np.ndarray]]:
    """Chunks of several batches at a time, about ``_READ`` bytes."""
    langs, texts, times, held = [], [], [], 0
    for batch in batches:
        found = as_bytes(batch.column("chunk"))
        langs += batch.column("lang").to_pylist()
        texts += found
        times.append(batch.column("times").to_numpy(zero_copy_only=False))
        held += sum(map(len, found))
        if held >= _READ:
            yield langs, texts, np.concatenate(times)
            langs, texts, times, held = [], [], [], 0
    if texts:
        yield langs, texts, np.concatenate(times)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sums of their times and a place of each."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[starts], np.add.reduceat(times[order], starts), order[starts]


def _count_keys(size: int, bits):
    """(key, times) of the phrases of ``size`` words that may be frequent, added up within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher(b" \t\n")
        held, waiting = [], 0

        def flush() -> pa.RecordBatch:
            keys, times, _ = _summed(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times)], names=["key", "times"])

        for langs, texts, times in _gathered(batches):
            grams, passed = Grams(hasher, langs, texts, times), None
            for n in range(1, size):
                keys, whole = grams.level(n, passed)
                passed = whole & _holds(bits.value, keys)
            keys, whole = grams.level(size, passed)
            at = np.flatnonzero(whole & grams.body[: len(keys)])
            if len(at):
                held.append((keys[at], grams.times[at]))
                waiting += len(at)
            if waiting > _HELD:
                yield flush()
                held, waiting = [], 0
        if held:
            yield flush()

    return run


def _count_phrases(bits):
    """(lang, size, phrase, times) of all phrases that passed at every length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher(b" \t\n")
        for langs, texts, times in _gathered(batches):
            grams, passed = Grams(hasher, langs, texts, times), None
            text = grams.block.buffer.tobytes().replace(b"\t", b" ")
            for size in range(1, MAX_WORDS + 1):
                keys, whole = grams.level(size, passed)
                passed = whole & _holds(bits.value, keys)
                at = np.flatnonzero(passed & grams.body[: len(keys)])
                if not len(at):
                    continue
                _, sums, where = _summed(keys[at], grams.times[at])
                at = at[where]
                low, high = grams.block.starts[at].tolist(), grams.block.ends[at + size - 1].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([langs[i] for i in grams.of[at].tolist()], pa.string()),
                        pa.array(np.full(len(at), size, np.int32)),
                        pa.array([text[a:b] for a, b in zip(low, high)], pa.binary()).cast(pa.string()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["lang", "size", "phrase", "times"],
                )

    return run


def _add_bits(bits: np.ndarray, keys: DataFrame) -> np.ndarray:
    """The bitmap with the bits of ``keys`` set; no more rows than it has 64-bit words reach the driver."""
    slot = F.col("key").bitwiseAND(F.lit(len(bits) * 8 - 1))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = keys.select(slot.alias("slot")).select(F.shiftright("slot", 6).alias("word"), bit.alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    whole = bits.view("<i8")
    at = found.column("word").to_numpy()
    whole[at] |= found.column("bit").to_numpy()
    return bits


def phrase_counts(parsed: DataFrame, least: int = LEAST, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, size, phrase, f): every phrase of up to four words found ``least`` times or more, exactly counted.

    ``parsed`` is a written ``dictionary``. A frequent phrase has frequent
    parts, so all of these are in the result too.
    """
    context = parsed.sparkSession.sparkContext
    bits = np.zeros(filter_bits // 8, np.uint8)
    for size in range(1, MAX_WORDS + 1):
        known = context.broadcast(bits)
        counted = parsed.mapInArrow(_count_keys(size, known), "key bigint, times bigint")
        frequent = counted.groupBy("key").agg(F.sum("times").alias("f")).where(F.col("f") >= least)
        bits = _add_bits(bits.copy(), frequent)
        known.unpersist()
    known = context.broadcast(bits)
    phrases = parsed.mapInArrow(_count_phrases(known), "lang string, size int, phrase string, times bigint")
    counted = phrases.groupBy("lang", "size", "phrase").agg(F.sum("times").alias("f")).where(F.col("f") >= least)
    return stage(counted, "phrase-counts")


def _cut(words: Column, start: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all phrases of two words or more, by their weakest cut.

    The score of a cut is two million times ``a`` by the frequencies of both
    parts, rounded down; sums and products are decimals.
    """
    words = F.split("phrase", " ")
    cuts = counts.where("size >= 2").select(
        "lang", "phrase", F.col("f").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    )
    cuts = cuts.select(
        "lang", "phrase", "a", "k", _cut(F.col("words"), 1, F.col("k")).alias("left"),
        _cut(F.col("words"), F.col("k") + 1, F.size("words") - F.col("k")).alias("right"),
    )
    of = counts.select(F.col("lang").alias("of_lang"), F.col("phrase").alias("of"), "f")
    left = cuts.join(of, (F.col("lang") == F.col("of_lang")) & (F.col("left") == F.col("of"))).withColumnRenamed("f", "l").drop("of", "of_lang")
    both = left.join(of, (F.col("lang") == F.col("of_lang")) & (F.col("right") == F.col("of"))).withColumnRenamed("f", "r").drop("of", "of_lang")
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(counts: DataFrame, percent: int = COVERED) -> DataFrame:
    """(lang, phrase) of phrases inside a longer one that has ``percent`` or more of their frequency."""
    words = F.split("phrase", " ")
    longer = counts.where("size >= 3").select("lang", "size", words.alias("words"), F.col("f").alias("longer"))
    sized = longer.select("*", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("inner"))
    placed = sized.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("inner") + 1)).alias("start"))
    within = placed.groupBy("lang", _cut(F.col("words"), F.col("start"), F.col("inner")).alias("phrase")).agg(
        F.max("longer").alias("longer")
    )
    both = within.join(counts.select("lang", "phrase", "f"), ["lang", "phrase"])
    wide: Callable[[str], Column] = lambda c: F.col(c).cast("decimal(20,0)")
    return both.where(wide("longer") * 100 >= wide("f") * percent).select("lang", "phrase")


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    top: int = TOP,
    percent: int = COVERED,
    one_in: int = CUT_ONE_IN,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two to four words.

    ``a`` is the phrase's frequency, ``l`` and ``r`` those of the two parts of
    its weakest cut, ``n`` all words of the language. Words are lower-cased in
    A-Z only and stand between blanks; no phrase runs over punctuation or a
    line end. A null language is ``und``, a null text empty; repeated rows
    count each; an empty table, or one in which nothing is found ``least``
    times, gives no rows. Ties go by frequency, then by the bytes of the phrase.
    """
    parsed = stage(dictionary(docs, text, lang, one_in), "phrase-chunks")
    counts = phrase_counts(parsed, least, filter_bits)
    totals = stage(parsed.groupBy("lang").agg(F.sum(F.col("words") * F.col("times")).alias("n")), "phrase-totals")
    kept = scored(counts).join(covered(counts, percent), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
