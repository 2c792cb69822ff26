"""MinHash near-dedup and its set links against brute force, and the query against SQL."""

from __future__ import annotations

import random

import numpy as np
import pytest

from fareloom.llm import components, minhash_dedup, queries, set_links
from fareloom.llm.set_links import Enough, linked_within, spanning
from fareloom.staging import stage

WORDS = [a + b + c for a in "bdklmnprst" for b in "aeiou" for c in ("n", "r", "st", "l")]


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def components_of(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near(a, b, percent=85):
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def corpus(seed=4):
    """Bases, copies, and copies with so many replaced words that they lie on both sides of the limit."""
    rng = random.Random(seed)
    rows = []
    for base in range(12):
        words = [rng.choice(WORDS) for _ in range(rng.choice([4, 30, 120, 400]))]
        rows.append(" ".join(words))
        for _ in range(rng.randint(1, 12)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append(rng.choice(["  ", "\n"]).join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    return [(i, t, "en") for i, t in enumerate(rows)]


def test_components_equal_brute_force(documents):
    rows = corpus()
    sets = {i: shingles(t) for i, t, _ in rows}
    want = components_of(sorted(sets), lambda a, b: near(sets[a], sets[b]))
    got = {r.doc_id: r for r in minhash_dedup.near_duplicate_sets(documents(rows)).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (i == want[i]) for i, r in got.items())
    assert 12 <= sum(r.kept for r in got.values()) < len(rows)


@pytest.mark.parametrize("slice_items", [1 << 19, 900])
def test_links_within_groups_of_any_size(spark, slice_items):
    rng = random.Random(8)
    rows, want = [], {}
    for group in range(3):
        base = rng.sample(range(10**9), 200)
        members = {}
        for member in range(40 if group else 4):
            near_base = set(base[: rng.choice([200, 200, 100])]) | set(rng.sample(range(10**9), rng.choice([2, 10, 30])))
            members[group * 100 + member] = near_base
        want |= components_of(sorted(members), lambda a, b: near(members[a], members[b], 80))
        for m, items in members.items():
            items = sorted(items)
            rows += [(group, m, len(items), items[i : i + 64]) for i in range(0, len(items), 64)]
    frame = spark.createDataFrame(rows, "group_id bigint, member bigint, size bigint, items array<bigint>").repartition(4)
    links = linked_within(stage(frame, "test"), Enough(percent=80), slice_items).collect()
    assert len(links) < 1000  # of 1566 pairs
    pairs = {(r.a, r.b) for r in links} | {(r.b, r.a) for r in links}
    assert components_of(sorted(want), lambda a, b: (a, b) in pairs) == want


def test_spanning_takes_sides():
    sets = [np.array([1, 2, 3]), np.array([1, 2, 3]), np.array([9]), np.array([], int)]
    assert spanning(sets, np.array([0, 0, 1, 1]), Enough(percent=50)) == []
    assert spanning(sets, np.array([2, 2, 2, 2]), Enough(percent=50)) == [(0, 1)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    b = np.concatenate((a[:2700], rng.integers(0, 1 << 63, 300).astype(np.uint64)))
    rows = minhash_dedup.signatures([a, b], 2000)
    assert abs((rows[0] == rows[1]).mean() - 2700 / 3300) < 0.05
    naive = [min(int(minhash_dedup.mixed(np.array([x ^ seed]))[0]) for x in a[:50]) >> 32 for seed in minhash_dedup.mixed(np.arange(1, 4, dtype=np.uint64))]
    assert minhash_dedup.signatures([a[:50]], 3)[0].tolist() == naive


def test_threshold_leaves_the_stated_chance():
    from math import comb

    t = minhash_dedup.match_threshold(64, 85, 1e-9)
    chance = [sum(comb(64, i) * 0.85**i * 0.15 ** (64 - i) for i in range(n)) for n in (t, t + 1)]
    assert chance[0] <= 1e-9 < chance[1]


def test_long_texts_in_pieces(monkeypatch):
    text = b" ".join(random.Random(1).choice(WORDS).encode() for _ in range(5000))
    whole = list(minhash_dedup.document_shingles(minhash_dedup._hasher(), [text], 3))[0]
    monkeypatch.setattr(minhash_dedup, "BLOCK", 1000)
    cut = list(minhash_dedup.document_shingles(minhash_dedup._hasher(), [text], 3))[0]
    assert len(whole) == 4998 and np.array_equal(whole, cut)


def test_hard_documents(hard_documents, no_documents):
    rows = minhash_dedup.near_duplicate_sets(hard_documents).collect()
    assert len(rows) == 9
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[1].n_shingles == by_id[2].n_shingles == by_id[3].n_shingles == 0
    assert all(by_id[i].component_id == i and by_id[i].kept for i in (1, 2, 3, 4, 5, 6))
    assert by_id[6].n_shingles == 1
    nameless = [r for r in rows if r.doc_id is None]
    assert len(nameless) == 2 and all(r.component_id is None and r.kept for r in nameless)
    assert minhash_dedup.near_duplicate_sets(no_documents).count() == 0


def test_matches_sql(spark, sf_dir, duck):
    import oracle

    name = "op12_minhash_near_dedup"
    assert oracle.compare(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLE_SQL[name]) == []


def test_components_of_few_links_take_few_tasks(spark, monkeypatch):
    written = []

    def recorded(df, label):
        table = stage(df, label)
        written.append((label, len(table.inputFiles())))
        return table

    monkeypatch.setattr(components, "stage", recorded)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    rng = random.Random(3)
    pairs = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1500)] + [(5000 + i, 5001 + i) for i in range(40)]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for most in (1 << 14, 100):  # all in one task, and many
            monkeypatch.setattr(components, "TASK_LINKS", most)
            links = spark.createDataFrame(pairs, "a bigint, b bigint")
            got = {r.node: r.root for r in components.components(links).collect()}
            nodes = sorted({n for p in pairs if p[0] != p[1] for n in p})
            root = {n: n for n in nodes}
            for _ in nodes:
                changed = [(a, b) for a, b in pairs if a != b and root[a] != root[b]]
                if not changed:
                    break
                for a, b in changed:
                    root[a] = root[b] = min(root[a], root[b])
            assert got == root
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rounds = [n for label, n in written if label != "links"]
    assert len(rounds) > 8 and min(rounds) == 1 and 1 < max(rounds) <= 16
