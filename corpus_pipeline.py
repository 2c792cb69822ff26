"""Corpus preparation: five stages from ``documents`` to token ids.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept. ``run`` writes every stage's rows to the shared scratch folder and reads
them again for the next. Null columns, empty texts, repeated rows and empty
tables pass as the operators say; a document with a null text is rejected by
the first stage. Other columns pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareloom.llm.decontaminate import drop_contaminated
from fareloom.llm.language_id import drop_unidentified, learn
from fareloom.llm.line_dedup import line_dedup
from fareloom.llm.queries import TOKENIZER, tokenized
from fareloom.llm.simhash_dedup import drop_near_duplicates
from fareloom.llm.text import columns_of, held_out
from fareloom.staging import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; the model learns from the labelled folds."""
    return drop_unidentified(docs, learn(docs.where(~held_out(F.col("doc_id"), 4, 2))))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that five documents share; n_chars counts what is left."""
    done = line_dedup(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*columns_of(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and token_ids."""
    return tokenized(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", remove_benchmark),
    ("bpe", encode),
]

#: SQL can say neither the classifier nor the fingerprints nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
