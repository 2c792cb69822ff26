"""Language ID, toxicity and quality by held-out accuracy; the pipeline stage by stage."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from fareloom.llm import language_id, quality, queries, sampling, toxicity
from fareloom.llm.text import held_out

SF = "/root/testdata/sf0.1"


def accuracy(rows, truth, column):
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    return sum(r[column] == truth[r.doc_id] for r in held) / len(held)


def test_language(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.language_query(spark, SF).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, truth, "lang_pred") > 0.99
    assert sum(r.rejected for r in rows) < 20


@pytest.mark.parametrize("name, label", [("op3_toxicity", "toxic"), ("op10_quality", "quality")])
def test_labels(spark, name, label):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.QUERIES[name](spark, SF).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, truth, "predicted") > 0.97


def test_hard_rows(spark, hard_documents, no_documents):
    marks = spark.createDataFrame([(4, 1, 0), (4, 1, 1), (5, 0, 0), (6, 1, 0), (None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        for labels in (marks, marks.limit(0)):
            rows = scores(hard_documents, labels, F.lit(True)).collect()
            assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
        assert scores(no_documents, marks, F.lit(True)).count() == 0
    for teachers in (hard_documents, no_documents):
        model = language_id.learn(teachers)
        rows = language_id.identify_languages(hard_documents, model).collect()
        assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
        assert all(r.lang == "und" and r.rejected for r in rows if r.doc_id in (1, 2, 3, 5))
        assert language_id.identify_languages(no_documents, model).count() == 0


def test_sample_is_bounded_and_stable(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 100 == 0, "rare").otherwise("many").alias("label"))
    take = lambda n: sorted((r.label, r.id) for r in sampling.bounded_sample(rows.repartition(n), "label", "id", 150).collect())
    first = take(3)
    assert len(first) == 300 and first == take(7)


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        assert {r.doc_id for r in docs.collect()} <= set(before) and docs.count() > 0.8 * len(before)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    left = {r.doc_id: r for r in docs.collect()}
    assert len(last) == len(left) and all(len(r.token_ids) == r.n_tokens for r in last)
    assert all(r.n_chars == len(r.text) for r in left.values())
    bench = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(b in r.text for b in bench for r in left.values())


def test_pipeline_of_hard_rows(spark, hard_documents, no_documents, sf_dir):
    for docs in (hard_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.count() <= docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count()


def test_long_texts_count_as_in_one_piece():
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abc é,ß\n語Z"), 4000))
    naive, padded = np.zeros(language_id.BUCKETS), (" " + text.lower() + " ").encode()
    codes = [c if c >= 128 or ord("a") <= c <= ord("z") else 32 for c in padded]
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b != 32:
            naive[((a | b << 8 | c << 16) * 2654435761 % 2**32) >> (32 - language_id.BUCKETS.bit_length() + 1)] += 1
    for step in (1, 7, 1000, 1 << 20):
        assert np.array_equal(language_id.bucket_counts(text, step), naive)
    assert language_id.bucket_counts("").sum() == 0


@pytest.mark.parametrize("kind", ["int", "double", "string", "boolean"])
def test_quality_labels_of_any_type(spark, documents, kind):
    docs = documents([(i, ("Good plain words here. " if i % 2 else "xx!! 99 ?? ") * (3 + i % 5), "en") for i in range(60)])
    marks = spark.createDataFrame([(i, str(i % 2)) for i in range(60)], "doc_id bigint, text string")
    labels = marks.select("doc_id", F.col("text").cast("int").cast(kind).alias("quality"))
    if kind != "boolean":  # neither teaches anything nor hides the other label of the document
        other = [(i, "2") for i in range(60)] + [(0, None)] + ([(1, "good")] if kind == "string" else [])
        labels = labels.union(spark.createDataFrame(other, "doc_id bigint, l string").select("doc_id", F.col("l").cast(kind)))
    rows = quality.quality_scores(docs, labels, F.lit(True)).collect()
    assert sum((r.score > 0.5) == bool(r.doc_id % 2) for r in rows) > 55


#: Texts in languages and scripts that the model of the test below has not learned, and letters in no order.
UNLEARNED = [
    "\u8fd9\u662f\u4e00\u4e2a\u5173\u4e8e\u5929\u6c14\u548c\u57ce\u5e02\u751f\u6d3b\u7684\u77ed\u6587" * 4,
    "\u042d\u0442\u043e \u043a\u043e\u0440\u043e\u0442\u043a\u0438\u0439 \u0442\u0435\u043a\u0441\u0442 \u043e \u043f\u043e\u0433\u043e\u0434\u0435 \u0438 \u0436\u0438\u0437\u043d\u0438 \u0432 \u0433\u043e\u0440\u043e\u0434\u0435 " * 4,
    "xq zvkj wpqf hjkx bvcz qqwx zzkv jfqp xkwz vbqj " * 6,
]


@pytest.mark.parametrize("languages", [["en", "de"], ["de", "en", "es", "fr"]])
def test_unlearned_scripts_and_gibberish_are_rejected(spark, documents, languages):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("lang").isin(languages))
    fold = held_out(F.col("doc_id"), 4, 2)
    model = language_id.learn(docs.where(~fold))
    strange = language_id.identify_languages(documents([(i, t, None) for i, t in enumerate(UNLEARNED)]), model).collect()
    assert all(r.rejected for r in strange), strange
    clean = language_id.identify_languages(docs.where(fold), model).where("score > 0").collect()
    assert sum(r.rejected for r in clean) <= 0.001 * len(clean), [r for r in clean if r.rejected][:5]


def test_model_by_plain_arithmetic():
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.02, (3, language_id.BUCKETS)).astype(np.float32)
    model = language_id.fit_model(list(rng.poisson(0.05, (30, language_id.BUCKETS)).astype(np.float32)), ["a", "b", "c"] * 10)
    for row, chances in zip(counts, model.probabilities(counts)):
        seen = [b for b in range(language_id.BUCKETS) for _ in range(int(row[b]))]
        inside = sum(model.embedding[b].astype(float) for b in seen) / len(seen)
        z = [(float(inside @ model.weights[:, k]) + float(model.bias[k])) / model.temperature for k in range(3)]
        e = [np.exp(v - max(z)) for v in z]
        assert np.allclose(chances, np.array(e) / sum(e), atol=1e-4)


def test_toxicity_learns_from_every_labelled_document(spark, documents):
    rng = np.random.default_rng(4)
    words = [a + b + c for a in "bdfglmnprst" for b in "aeiou" for c in ("n", "r", "st", "l")]
    n = 3400
    marks = spark.range(2 * n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    # toxic documents behind the first 3000 by hash have a word of their own
    sample = {r.doc_id for r in sampling.bounded_sample(marks, "toxic", "doc_id", 3000).collect()}
    texts = []
    for i in range(2 * n):
        found = list(rng.choice(words, 12))
        if i % 2:
            found[rng.integers(12)] = "vexat" if i in sample else "grumlo"
        texts.append(" ".join(found))
    fresh = [(10**6 + i, " ".join([*rng.choice(words, 6), *mark, *rng.choice(words, 5)]), None) for i, mark in enumerate([["grumlo"], ["vexat"], []] * 40)]
    docs = documents([(i, t, None) for i, t in enumerate(texts)] + fresh)
    rows = toxicity.toxicity_scores(docs, marks, F.lit(True)).where("doc_id >= 1000000").collect()
    right = [(r.score >= toxicity.CUT) == ((r.doc_id - 10**6) % 3 != 2) for r in rows]
    assert len(rows) == 120 and sum(right) >= 118


def test_toxicity_shards_do_not_depend_on_partitions(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    monkeypatch.setattr(toxicity, "SHARD", 60)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    marks = labels.selectExpr("doc_id", "toxic as label")
    nets = [toxicity.learn(docs.repartition(k).select("doc_id", "text"), marks) for k in (2, 7)]
    assert np.array_equal(nets[0].embedding, nets[1].embedding) and nets[0].bias == nets[1].bias
    assert nets[0].thresholds == nets[1].thresholds and toxicity.OTHER in nets[0].thresholds


def test_toxicity_texts_go_through_one_exchange_only(spark, documents, monkeypatch):
    rng = np.random.default_rng(7)
    docs = documents([(i, " ".join(rng.choice(list("abcdefgh"), 5)) + f" w{i}", None) for i in (*range(60), 7, 7, None)])
    marks = spark.range(0, 90, 3).selectExpr("id as doc_id", "cast(id % 2 as int) as label")
    marks = marks.union(spark.sql("select 7L, 1"))
    plans = []
    write = toxicity.stage
    monkeypatch.setattr(toxicity, "stage", lambda df, *a, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *a, **k))
    wanted = sorted([i % 2 for i in range(0, 60, 3)] + [1, 1, 1])
    for bits in (1 << 26, 64):  # a full bitmap lets other documents pass, which have no label
        monkeypatch.setattr(toxicity, "LISTED_BITS", bits)
        rows = toxicity._shards(docs.select("doc_id", "text"), marks, 4).collect()
        assert sorted(x for r in rows for x in r.labels) == wanted and sum(len(r.texts) for r in rows) == len(wanted)
    assert len(plans) == 2 and all("Join" not in p and p.count("RepartitionByExpression") == 1 for p in plans)


def test_toxicity_threshold_has_least_error():
    rng = np.random.default_rng(6)
    cells = np.unique(rng.integers(-300, 300, 80))
    toxic, clean = rng.poisson(2 + cells / 150, len(cells)), rng.poisson(2 - cells / 150, len(cells))
    errors = lambda cut: int(toxic[cells < cut].sum() + clean[cells >= cut].sum())
    at = toxicity.threshold(cells, toxic, clean) * toxicity.CELLS
    assert errors(at) == min(errors(c) for c in range(-400, 400))
