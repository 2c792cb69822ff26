"""Pivotal grams against brute force over all pairs, and the query against SQL."""

from __future__ import annotations

import random
from itertools import combinations

from pyspark.sql import functions as F

from fareloom.llm import queries, spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary(seed=5, count=300):
    rng = random.Random(seed)
    words = set()
    for _ in range(count):
        letters = rng.choice(["ab", "abcé", "abcdefghijklmnopqrstuvwxyzàéÿ"])
        word = "".join(rng.choice(letters) for _ in range(rng.randint(4, 10)))
        words.add(word)
        for _ in range(3):
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + "é" + word[at + 1 :]])
            words.add(word)
    return sorted(w for w in words if len(w) >= 4)


def test_near_words_are_all_found(spark):
    words = vocabulary()
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint").repartition(5)
    got = {(r.word, r.near) for r in spelling.near_words(frame).collect()}
    want = {(a, b) for a in words for b in words if a != b and one_edit(a, b)}
    assert len(want) > 1000 and got == want


def test_order_of_unknown_bigrams(spark, monkeypatch):
    monkeypatch.setattr(spelling, "KNOWN_GRAMS", 3)
    words = vocabulary(6, 60)
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")
    got = {(r.word, r.near) for r in spelling.near_words(frame).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and one_edit(a, b)}


def test_pivots_are_the_lightest_that_do_not_overlap():
    rng = random.Random(2)
    for _ in range(200):
        places = sorted(rng.sample(range(8), rng.randint(3, 6)))
        weights = [rng.randint(1, 9) for _ in places]
        apart = [c for c in combinations(range(len(places)), 2) if places[c[1]] - places[c[0]] >= 2]
        chosen = spelling.pivots(places, weights)
        assert tuple(chosen) in apart
        assert sum(weights[i] for i in chosen) == min(sum(weights[i] for i in c) for c in apart)


def test_forms_and_roots(spark):
    rows = [("colour", 1000), ("color", 90), ("colr", 9), ("colox", 9), ("other", 500), (None, 3), ("abc", 1), ("abd", 99)]
    frame = spark.createDataFrame(rows, "word string, n bigint")
    got = {r.word: r for r in spelling.spelling_forms(frame).collect()}
    assert len(got) == len(rows)
    assert (got["colr"].form, got["colr"].root, got["colr"].form_n) == ("color", "colour", 90)
    assert (got["color"].form, got["color"].root, got["color"].n_near) == ("colour", "colour", 3)
    assert (got["colour"].form, got["colour"].root, got["colour"].n_near) == (None, "colour", 1)
    assert (got["abc"].form, got["abc"].n_near) == (None, 0)  # too short to be near anything
    assert got[None].n_near == 0 and got[None].form is None
    tie = spark.createDataFrame([("tiger", 1), ("tigex", 10), ("tigez", 10)], "word string, n bigint")
    assert {r.word: r.form for r in spelling.spelling_forms(tie).collect()}["tiger"] == "tigex"


def test_hard_documents(hard_documents, no_documents):
    assert queries.typed_words(no_documents).count() == 0
    assert spelling.spelling_forms(queries.typed_words(no_documents)).count() == 0
    rows = {r.word: r.n for r in queries.typed_words(hard_documents).collect()}
    assert rows == {}  # no run of seven letters is there twice
    long = hard_documents.withColumn("text", F.concat(F.col("text"), F.lit(" "), F.repeat(F.lit("lettering "), 30_000)))
    rows = {r.word: r.n for r in queries.typed_words(long).collect()}
    assert sum(rows.values()) == 30_000 * 7 and set(rows) >= {"lettering"}


def test_matches_sql(spark, sf_dir, duck):
    import oracle

    name = "op11_spelling_variants"
    assert oracle.compare(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLE_SQL[name]) == []
