"""Spelling variants: words one code point apart, found by pivotal grams.

Bigrams have one order for all words, the rarest first. A word's *prefix* is
every occurrence of a bigram up to the third in that order; among them two
that do not overlap, the *pivots*, are chosen by dynamic programming so that
they are the rarest. One edit touches one of two pivots at most, so of two
near words the one whose prefix ends earlier has a pivot that stands whole in
the other's prefix. Positions are held exact: an edit behind the left pivot
leaves everything up to it as it is, one before the right pivot everything
from it on. So a pivot is looked up together with that beginning or end and
the possible lengths, and what is found is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.staging import stage

GRAM = 2
#: Edits that near words are apart.
EDITS = 1
#: Words need so many code points for two bigrams that do not overlap.
LEAST_CHARS = GRAM * (EDITS + 1)
#: Bigrams whose frequency is looked up, the most frequent ones; any others come first in the order.
KNOWN_GRAMS = 1 << 16
RATIO = 10

_POSTING = "spot string, chars int, word string, n bigint, last bigint, letters bigint, pivot boolean"


def pivots(places: list[int], weights: list[int], count: int = EDITS + 1, gram: int = GRAM) -> list[int]:
    """Indices of ``count`` grams that do not overlap and weigh least together.

    ``places`` ascend. ``best[k]`` after the i-th gram is the least weight of k
    grams among the first i, and which; a gram extends the best choice among
    those that end before it begins.
    """
    best: list[list[tuple[int, list[int]] | None]] = [[(0, [])] + [None] * count]
    for i, place in enumerate(places):
        before = i
        while before and places[before - 1] > place - gram:
            before -= 1
        row = list(best[-1])
        for k in range(1, count + 1):
            taken = best[before][k - 1]
            if taken is not None:
                choice = (taken[0] + weights[i], taken[1] + [i])
                if row[k] is None or choice[0] < row[k][0]:
                    row[k] = choice
        best.append(row)
    return best[-1][count][1]


def _postings(known: dict[str, tuple[int, int]]):
    """Rows of the index (every prefix gram, from both sides) and of the lookups (pivots, three lengths)."""

    def order(gram: str) -> int:
        if gram in known:
            return known[gram][0]
        place = 0
        for c in gram:
            place = place << 21 | ord(c)
        return place - (1 << 62)

    def rows(word: str, n: int):
        grams = [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]
        orders = [order(g) for g in grams]
        last = sorted(orders)[GRAM * EDITS]
        prefix = [i for i, o in enumerate(orders) if o <= last]
        chosen = pivots(prefix, [known.get(grams[i], (0, 0))[1] for i in prefix])
        letters = 0
        for c in word:
            letters |= 1 << ord(c) % 63
        for i in prefix:
            yield "<" + word[: i + GRAM], len(word), word, n, last, letters, False
            yield ">" + word[i:], len(word), word, n, last, letters, False
        left, right = prefix[chosen[0]], prefix[chosen[-1]]
        for chars in range(len(word) - EDITS, len(word) + EDITS + 1):
            # The end of the other word is as long, its beginning is what differs, and the other way round.
            yield "<" + word[: left + GRAM], chars, word, n, last, letters, True
            yield ">" + word[right:], chars, word, n, last, letters, True

    names = ["spot", "chars", "word", "n", "last", "letters", "pivot"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low in range(0, len(words), 1024):
                found = [r for w, n in zip(words[low : low + 1024], counts[low : low + 1024]) for r in rows(w, n)]
                columns = list(zip(*found)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words that one edit turns into each other.

    ``words`` has distinct ``word`` and its count ``n``; the edit inserts,
    deletes or replaces one code point. Null words and words of fewer than
    four code points are near nothing. The order of bigrams is a parameter of
    speed alone; the join lets a pair through only when it is verified.
    """
    words = words.where(F.char_length("word") >= LEAST_CHARS).select("word", F.col("n").cast("bigint").alias("n"))
    starts = F.sequence(F.lit(1), F.char_length("word") - GRAM + 1)
    grams = words.select(F.explode(F.transform(starts, lambda i: F.substr("word", i, F.lit(GRAM)))).alias("gram"))
    counted = grams.groupBy("gram").count().orderBy(F.desc("count"), "gram").limit(KNOWN_GRAMS).collect()
    known = {r["gram"]: (len(counted) - i, r["count"]) for i, r in enumerate(counted)}
    postings = stage(words.mapInArrow(_postings(known), _POSTING), "spelling-postings")
    a = postings.where("pivot").alias("a")
    b = postings.where("not pivot").alias("b")
    found = a.join(
        b,
        (F.col("a.spot") == F.col("b.spot"))
        & (F.col("a.chars") == F.col("b.chars"))
        & (F.col("a.last") <= F.col("b.last"))
        & (F.bit_count(F.col("a.letters").bitwiseXOR(F.col("b.letters"))) <= 2 * EDITS)
        & (F.col("a.word") != F.col("b.word"))
        & (F.levenshtein("a.word", "b.word", EDITS) == 1),
    ).select(
        F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n")
    )
    found = stage(found, "spelling-found")
    both = found.union(found.select("near", "near_n", "word", "n"))
    return both.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word that following forms leads to.

    Every round doubles how far a word sees. A form is ``RATIO`` times as
    frequent as its word, so chains are short and without rings.
    """
    seen = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        a, b = seen.alias("a"), seen.alias("b")
        further = a.join(b, F.col("a.root") == F.col("b.word"), "left")
        seen = stage(
            further.select(
                "a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")
            ),
            "spelling-roots",
        )
        if seen.where("moved").isEmpty():
            return seen.select("word", "root")
        seen = seen.select("word", "root")


def spelling_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row per row of ``words`` (distinct ``word``, count ``n``).

    A word's form is its most frequent near word (ties: the least in
    code-point order) if that is at least ``ratio`` times as frequent, else
    null; root is the word itself where it has no form. An empty table gives
    no rows; a null word comes out without a form or root, with no near words.
    """
    words = stage(words.select("word", F.col("n").cast("bigint").alias("n")), "spelling-words")
    best = (
        near_words(words)
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    )
    enough = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    formed = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    formed = stage(formed, "spelling-forms")
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def letter_runs(text: Column, least: int = 1) -> Column:
    """All maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) of at least so many code points."""
    return F.regexp_extract_all(text, F.lit("[A-Za-zÀ-ÿ]{%d,}" % least), F.lit(0))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
