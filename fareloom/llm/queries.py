"""The registered queries of this folder, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareloom.llm import (
    bpe,
    chat,
    collocations,
    decontaminate,
    language_id,
    line_dedup,
    minhash_dedup,
    order_minhash,
    quality,
    simhash_dedup,
    spelling,
    surrogates,
    toxicity,
)
from fareloom.llm.collocations_sql import COLLOCATIONS_SQL
from fareloom.llm.minhash_sql import MINHASH_SQL
from fareloom.llm.spelling_sql import SPELLING_SQL
from fareloom.llm.text import held_out

TOKENIZER = "word_bpe_49k.json"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, the two digests, and the ids themselves."""
    both = docs.select("doc_id", bpe.round_trip(F.col("text"), tokenizer).alias("both"))
    both = both.select("doc_id", F.col("both.ids").alias("token_ids"), F.col("both.decoded").alias("decoded"))
    return both.select(
        "doc_id",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(bpe.joined_ids(F.col("token_ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "token_ids",
    )


def bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)).drop("token_ids")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "line_counts.*", F.sha2("text", 256).alias("kept_sha256"))


LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(list) AS line, generate_subscripts(list, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS list FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.*, f.k IS NOT NULL AND l.doc_id <> f.keeper AS gone FROM keyed l LEFT JOIN frequent f ON l.k = f.k
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_dedup.hex_print(F.col("print")).alias("fingerprint"), "component_id")


def language_model(docs: DataFrame) -> language_id.LanguageModel:
    return language_id.learn(docs.where(~held_out(F.col("doc_id"), 4, 2)))


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language_id.identify_languages(docs, language_model(docs))
    return found.select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("lang").alias("lang_pred"), "score", "rejected"
    )


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out(F.col("doc_id"), 3, 1)
    found = toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held)
    predicted = (F.col("score") >= toxicity.CUT).cast("int")
    return found.select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"), "language")


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out(F.col("doc_id"), 5, 0)
    found = quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held)
    predicted = (F.col("score") >= 0.3).cast("int")
    return found.select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"))


#: The key of the registered query; a real run brings its own secret.
SURROGATE_KEY = b"example key of the registered query"


def surrogate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.with_surrogates(read(spark, sf_dir, "documents"), SURROGATE_KEY)


def fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.edited_pairs(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything but conv_id is read back from the formatted text and its loss spans."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    typed = rows.union(hostile).withColumn("parts", chat.text_parts(F.col("text")))
    found = chat.format_conversations(typed).select(
        "conv_id",
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return found.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, length('<s>[INST]</s>') + length(role) + length(text)
            + length(regexp_replace(role || text, '[^<\[\\]', '', 'g')) AS marked
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(marked) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


SPELLING_CHARS, SPELLING_ROWS, TYPO_SHARE = 7, 2, 31


def typed_words(docs: DataFrame) -> DataFrame:
    """(word, n): letter runs in lower case, one in 31 of them with a code point left out, counted over all texts."""
    runs = docs.select("doc_id", F.explode(spelling.letter_runs(F.col("text"), SPELLING_CHARS)).alias("run"))
    runs = runs.select("doc_id", spelling.lower_ascii(F.col("run")).alias("run"))
    code = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = (F.col("code") % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.withColumn("code", code).select(F.when(F.col("code") % TYPO_SHARE == 0, cut).otherwise(F.col("run")).alias("word"))
    words = words.where(F.char_length("word") >= SPELLING_CHARS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= SPELLING_ROWS)


def spelling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(typed_words(read(spark, sf_dir, "documents")))


def minhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicate_sets(read(spark, sf_dir, "documents"))


def collocation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": surrogate_query,
    "op2_bpe_encode_decode": bpe_encode_decode,
    "op3_toxicity": toxicity_query,
    "op4_benchmark_decontamination": decontamination,
    "op5_line_dedup": line_dedup_query,
    "op6_simhash_near_dedup": simhash_query,
    "op7_order_minhash": fingerprint_query,
    "op8_chat_format": chat_query,
    "op9_language_id": language_query,
    "op10_quality": quality_query,
    "op11_spelling_variants": spelling_query,
    "op12_minhash_near_dedup": minhash_query,
    "op13_collocations": collocation_query,
}

ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": LINE_DEDUP_SQL,
    "op8_chat_format": CHAT_SQL,
    "op11_spelling_variants": SPELLING_SQL,
    "op12_minhash_near_dedup": MINHASH_SQL,
    "op13_collocations": COLLOCATIONS_SQL,
}
