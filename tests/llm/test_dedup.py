"""Line dedup, SimHash near-dedup and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fareloom.llm import components, decontaminate, line_dedup, queries, simhash_dedup
from fareloom.llm.text import WordHasher, blocks

WORDS = [a + b + c for a in "bdklmnprst" for b in "aeiou" for c in ("n", "r", "st", "l")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_lines_by_hand(documents):
    long = "This Line Has More Than Forty Characters In It, No Doubt"
    rows = [(i, f"own {i}\n  {long if i % 2 else long.lower()}\t\nshort", "en") for i in range(6)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(documents(rows)).collect()}
    assert got[0].text == "own 0\nshort" and tuple(got[0].line_counts) == (3, 1)
    assert got[5].text == rows[5][1] and tuple(got[5].line_counts) == (3, 0)
    four = line_dedup.line_dedup(documents(rows[:4])).collect()
    assert all(r.line_counts.n_dropped == 0 for r in four)


def test_lines_of_hard_rows(hard_documents, no_documents):
    rows = line_dedup.line_dedup(hard_documents).collect()
    assert len(rows) == 9 and all(r.text is not None and r.score == "x" for r in rows)
    assert line_dedup.line_dedup(no_documents).count() == 0


def test_lost_lines_of_rows_without_an_id_stay_apart(documents):
    shared = [f"shared line {n:02} of more than forty characters, no doubt" for n in range(20)]
    rows = [(i, "\n".join(shared), "en") for i in range(5)] + [(None, f"own {line[12:14]}\n{line}", "en") for line in shared]
    docs = documents(rows)
    lost = line_dedup.dropped_lines(docs.select("doc_id", "text")).where("doc_id is null").collect()
    assert len(lost) == 20 and all(len(r["keys"]) == 1 for r in lost)
    got = [r.text for r in line_dedup.line_dedup(docs).collect() if r.doc_id is None]
    assert sorted(got) == [f"own {n:02}" for n in range(20)]


def test_line_keys_count_code_points():
    assert line_dedup.line_digest(("é" * 39).encode(), 40) is None
    assert line_dedup.line_digest(("é" * 40).encode(), 40) is not None
    assert line_dedup.line_digest(b"\x0b" + b"A" * 40, 40) == line_dedup.line_digest(b"a" * 40 + b" \r", 40)


@pytest.mark.parametrize("name", ["op5_line_dedup", "op8_chat_format"])
def test_matches_sql(spark, sf_dir, duck, name):
    import oracle

    assert oracle.compare(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLE_SQL[name]) == []


def brute_components(prints, bits):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("slice_rows", [2048, 7])
def test_simhash_links_all_near_prints(spark, slice_rows):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:30]:  # chains of near prints, some just too far apart
        for _ in range(6):
            for b in rng.sample(range(64), rng.choice([1, 4, 5])):
                p ^= 1 << b
            prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "print bigint").repartition(4)
    links = simhash_dedup.near_links(frame, slice_rows=slice_rows)
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in components.components(links).collect()}
    want = brute_components(prints, 4)
    groups = {}
    for p in prints:
        groups.setdefault(want[p], set()).add(p)
    mine = {}
    for p in prints:
        mine.setdefault(got.get(p, p), set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_simhash_by_definition():
    import xxhash

    words = "one two three four Five six seven".split()
    grams = [" ".join(words[i : i + 4]).lower() for i in range(4)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 4)
    assert simhash_dedup.simhash(b" one two\tthree four FIVE\nsix seven ") == want
    assert simhash_dedup.simhash(b" \n") == 0
    assert simhash_dedup.simhash(b"A b") == xxhash.xxh64_intdigest("a b", 42)


def test_simhash_query_on_hard_rows(hard_documents, no_documents):
    rows = simhash_dedup.near_duplicates(hard_documents).collect()
    assert len(rows) == 9
    blank = {r.component_id for r in rows if r["print"] == 0}
    assert blank == {1}  # null, empty and blank texts are one component
    assert simhash_dedup.near_duplicates(no_documents).count() == 0
    kept = simhash_dedup.drop_near_duplicates(hard_documents).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 4), (False, 5), (False, 6), (True, 0)]


def test_one_row_stays_of_each_component_whatever_the_ids(documents):
    rng = random.Random(8)
    a, b, c, d, e = (prose(rng, 300) for _ in range(5))
    near = lambda t: t + " more"
    rows = [(1, a, "en"), (1, b, "en"), (2, near(b), "en"), (3, a, "en"), (4, c, "en"), (1, c, "en"), (5, d, "en"), (5, near(d), "en"), (None, e, "en"), (None, e, "en"), (None, a, "en")]
    assert (simhash_dedup.simhash(b.encode()) ^ simhash_dedup.simhash(near(b).encode())).bit_count() <= 4
    assert 0 < (simhash_dedup.simhash(d.encode()) ^ simhash_dedup.simhash(near(d).encode())).bit_count() <= 4
    for seed in (1, 4):
        got = [(r.doc_id, r.text) for r in simhash_dedup.drop_near_duplicates(documents(rows).repartition(seed)).collect()]
        assert len(got) == 5 and {(1, a), (1, b), (1, c), (None, e)} < set(got)
        assert {i for i, t in got if t in (d, near(d))} == {5}


def test_components_of_a_long_chain(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components.components(links).collect()} == {0}
    assert components.components(links.where("a < 0")).count() == 0


def test_leaks_found_by_brute_force(spark, documents):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.choice([8, 60, 90]))) for i in range(12)] + [(50, None), (51, ""), (52, "two words")]
    docs = []
    for i in range(60):
        words = prose(rng, rng.choice([3, 30, 200])).split()
        passage = items[i % 12][1].split()
        for _ in range(i % 4):  # none to three edited words
            passage[rng.randrange(len(passage))] = rng.choice(WORDS)
        at = rng.randrange(len(words) + 1)
        docs.append((i, " ".join(words[:at] + (passage if i % 3 else []) + words[at:]).upper(), "en"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(documents(docs), bench).collect()}
    want = {}
    split = lambda t: decontaminate.words_of((t or "").lower().encode())
    for i, text, _ in docs:
        words = split(text)
        for item, passage in items:
            spelled = split(passage)
            n = min(len(spelled), len(words))
            for s in range(len(words) - n + 1) if n else ():
                a = decontaminate.shingles(words[s : s + n], 5)
                alike = decontaminate.weighted_similarity(a, decontaminate.shingles(spelled, 5))
                if alike >= 0.8:
                    want[i, item] = max(want.get((i, item), 0), alike)
    assert got == want and len(want) >= 15


def test_leaks_of_hard_rows(spark, hard_documents, no_documents):
    bench = spark.createDataFrame([(1, "word " * 30), (None, "a row without an id, of several words")], "item_id bigint, text string")
    got = decontaminate.contaminated(hard_documents, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(6, 1), (None, None)}
    kept = decontaminate.drop_contaminated(hard_documents, bench)
    assert kept.count() == 7 and kept.columns == hard_documents.columns
    assert decontaminate.contaminated(no_documents, bench).count() == 0
    assert decontaminate.contaminated(hard_documents, bench.limit(0)).count() == 0


def test_word_hashes_do_not_depend_on_place():
    hasher = WordHasher()
    first = hasher.read([b"alpha beta", b"", b"beta, gamma"])
    h = first.hashes()
    assert h[1] == h[2] and len(set(h.tolist())) == 3 and first.first.tolist() == [0, 2, 2, 4]
    assert [len(t) for _, t in blocks([b"x" * 10] * 5, 22)] == [2, 2, 1]
    assert np.array_equal(hasher.read([b"beta"]).hashes(), h[1:2])


def odd_columns(df):
    """Columns that operators might call theirs, and names that need quoting."""
    names = ["_print", "_kept", "_several", "_id", "_row", "id", "row", "kept", "repeated", "root", "a.b", "c`d", "e f"]
    return df.select("*", *(F.lit(n).alias(n) for n in names)), names


def test_extra_columns_of_any_name(documents):
    rng = random.Random(4)
    a, b = prose(rng, 300), prose(rng, 300)
    docs, names = odd_columns(documents([(1, a, "en"), (2, a, "en"), (3, b, "en"), (3, a, "en"), (None, "alone", "en"), (4, None, "en")]))
    kept = simhash_dedup.drop_near_duplicates(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in rows) == [0, 1, 3, 4]
    lines = line_dedup.line_dedup(docs)
    assert lines.columns == [*docs.columns, "line_counts"]
    assert all(r[n] == n for r in rows + lines.collect() for n in names)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_of_rows_with_one_id_and_print_the_smallest_text_stays(documents, seed):
    rng = random.Random(9)
    text = prose(rng, 50)
    rows = [(1, text + tail, "en") for tail in ("  ", "", "\n", " ", "\t")] * 2
    got = simhash_dedup.drop_near_duplicates(documents(rows).repartition(seed)).collect()
    assert [r.text for r in got] == [text]


def test_window_starts_by_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        last, before = rng.randrange(60), rng.randrange(12)
        places = sorted(rng.sample(range(last + before + 1), rng.randint(1, min(6, last + before + 1))))
        want = {s for p in places for s in range(p - before, p + 1) if 0 <= s <= last}
        starts = decontaminate._window_starts(np.array(places), before, last)
        assert starts.tolist() == sorted(want)
        spans = list(decontaminate._spans(starts, 5))
        assert np.concatenate(spans).tolist() == starts.tolist() and all(s[-1] - s[0] < 5 for s in spans)


def test_repetitive_text_takes_bounded_memory(documents, spark):
    import tracemalloc

    rng = random.Random(11)
    item = prose(rng, 2000)
    index = decontaminate.ItemIndex([(1, item)], 5)
    run = " ".join(item.split()[40:60])
    words = ((run + " ") * 3000).encode().split()
    found = WordHasher().read([b" ".join(words)])
    at, _ = index.found(decontaminate.shingle_hashes(found.hashes(), 5))
    tracemalloc.start()
    leaks = decontaminate._leaks_in(index, found.hashes(), {2000: set(at.tolist())}, lambda a, b: words[a:b], 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert leaks == [] and len(at) > 40_000 and peak < 100 << 20
