"""The parse and its counts against naive counting, scores against exact integers, the query against SQL."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fareloom.llm import collocations, queries


def naive_counts(texts):
    found = Counter()
    for text in texts:
        for piece in re.split(r"[.,;:!?\n-\r]", text or ""):
            words = [w for w in re.split(r"[ \t]+", "".join(c.lower() if c.isascii() else c for c in piece)) if w]
            for n in range(1, 5):
                found.update((n, " ".join(words[i : i + n])) for i in range(len(words) - n + 1))
    return found


def some_texts(seed=1, count=40):
    rng = random.Random(seed)
    words = ["the", "Cat", "sat", "on", "éİ", "mat's", "x y", "a-b", "ÉTÉ"]
    texts = ["", " \t ", "...", "one", "the cat", "the cat sat. on", "\x0b,the\x0ccat"]
    for _ in range(count):
        parts = []
        for _ in range(rng.choice([1, 5, 60])):
            parts += [rng.choice(words), rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", " ; "])]
        texts.append("".join(parts))
    return texts + texts[10:20] + ["word " * 500]


def chunk_counts(texts, one_in, size):
    hasher = collocations._hasher(collocations.BLANKS + collocations.BREAKS)
    times, words = Counter(), 0
    for text in texts:
        units = list(collocations._units(text.encode().lower(), size))
        found, bodies = collocations.chunks(hasher, units, one_in)
        times.update(found)
        words += int(bodies.sum())
    grams = collocations.Grams(collocations._hasher(b" \t\n"), ["en"] * len(times), list(times), np.array(list(times.values())))
    text = grams.block.buffer.tobytes().replace(b"\t", b" ")
    counts = Counter()
    for n in range(1, 5):
        keys, whole = grams.level(n, None)
        for i in np.flatnonzero(whole & grams.body[: len(keys)]):
            counts[n, text[grams.block.starts[i] : grams.block.ends[i + n - 1]].decode()] += int(grams.times[i])
    return counts, words, len(times)


@pytest.mark.parametrize("one_in", [1, 2, 32, 10**9])
@pytest.mark.parametrize("size", [7, 90, 1 << 20])
def test_parse_counts_every_phrase_once(one_in, size):
    texts = some_texts()
    want = naive_counts(texts)
    counts, words, _ = chunk_counts(texts, one_in, size)
    assert counts == want
    assert words == sum(c for (n, _), c in want.items() if n == 1)


def test_equal_passages_become_equal_chunks():
    rng = random.Random(3)
    passage = " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) + rng.choice("mnopq") for _ in range(600))
    once = chunk_counts([passage], 8, 1 << 20)[2]
    many = chunk_counts([f"start {i} {passage} end {i}" for i in range(20)], 8, 1 << 20)[2]
    assert once > 40 and many < once + 4 * 20


@pytest.mark.parametrize("filter_bits", [1 << 6, 1 << 20])
def test_frequent_phrases_whatever_the_filter(spark, documents, filter_bits):
    texts = some_texts(2)
    docs = documents([(i, t, "en" if i % 3 else None) for i, t in enumerate(texts)])
    parsed = collocations.stage(collocations.dictionary(docs, "text", "lang"), "test")
    got = {(r.lang, r["size"], r.phrase): r.f for r in collocations.phrase_counts(parsed, 5, filter_bits).collect()}
    want = {}
    for lang, part in (("en", [t for i, t in enumerate(texts) if i % 3]), ("und", texts[::3])):
        want |= {(lang, n, p): c for (n, p), c in naive_counts(part).items() if c >= 5}
    assert got == want


def test_scores_by_exact_integers(spark):
    big = 3 * 10**14
    rows = [("en", 1, "a", 2 * big), ("en", 1, "b", big + 7), ("en", 1, "c", big), ("en", 2, "a b", big), ("en", 2, "b c", big - 1), ("en", 3, "a b c", big - 2)]
    counts = spark.createDataFrame(rows, "lang string, size int, phrase string, f bigint")
    got = {r.phrase: r for r in collocations.scored(counts).collect()}
    assert got["a b"].score == 2_000_000 * big // (3 * big + 7)
    cuts = [2_000_000 * (big - 2) // (2 * big + big - 1), 2_000_000 * (big - 2) // (big + big)]
    assert (got["a b c"].score, got["a b c"].l, got["a b c"].r) == (min(cuts), 2 * big, big - 1)
    assert {r.phrase for r in collocations.covered(counts).collect()} == {"a b", "b c"}
    assert collocations.covered(counts.withColumn("f", F.when(F.col("size") == 3, F.col("f") / 2).otherwise(F.col("f")).cast("bigint"))).count() == 0


def test_ranks_and_hard_rows(documents, hard_documents, no_documents):
    assert collocations.collocations(no_documents).count() == 0
    rows = collocations.collocations(hard_documents).collect()  # one text says "word" 40,000 times
    assert [(r.phrase, r.rank) for r in rows] == [("word word word word", 1)]
    assert (rows[0].lang, rows[0].a, rows[0].l, rows[0].n) == ("en", 39_997, 40_000, 40_000 + 2 + 1 + 8)
    tied = documents([(i, "x y. p q", None) for i in range(30)])
    got = collocations.collocations(tied, top=1).collect()
    assert [(r.lang, r.rank, r.phrase, r.score, r.n) for r in got] == [("und", 1, "p q", 1_000_000, 120)]


def test_matches_sql(spark, sf_dir, duck):
    import oracle

    name = "op13_collocations"
    assert oracle.compare(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLE_SQL[name]) == []
