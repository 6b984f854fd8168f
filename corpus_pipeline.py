"""A corpus pipeline: each stage is written as Parquet and read again as the next one's documents.

language ID (texts of no sure language go, lang is what was found) -> line dedup -> SimHash near-dedup
(one document of each group stays) -> secrets (replaced by a mark) -> packing.

All stages but the last return the columns of documents, with n_chars brought
up to date where a text changes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneweave.llm import jaccard, language, lines, packing, secrets
from sceneweave.llm.common import checkpoint_folder, read_table
from sceneweave.llm.queries import tokenizer_file


#: Least mean probability of a text's language.
SURE = 0.5
#: Words in a shingle, bits in which fingerprints differ that the trie join proposes, and the least Jaccard similarity of near-duplicates.
SHINGLE, BUDGET, SIMILARITY = 5, 6, 0.8


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language the network is sure of, with that language in ``lang``.

    Rejected are null texts, texts without a letter, and texts of which no
    language has half the probability: a few letters, or no prose. If there is
    no label to learn from, texts with a letter stay as they are.
    """
    network = language.train(docs.where(~language.held_out()))
    if network is None:
        return docs.where(language.has_letter(F.col("text")))
    aside = {c: f"aside_{c}" for c in ("lang_pred", "score") if c in docs.columns}
    found = language.annotate(docs.withColumnsRenamed(aside), network)
    sure = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE)).withColumn("lang", F.col("lang_pred"))
    return sure.drop("lang_pred", "score").withColumnsRenamed({b: a for a, b in aside.items()}).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cleaned = lines.drop_repeated_lines(docs, carry=tuple(others)).withColumnRenamed("kept_text", "text")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, shingle=SHINGLE, budget=BUDGET, similarity=SIMILARITY)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact_documents(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("language ID", identify_languages),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL has neither the trained network nor the tokenizer; a brute-force test covers the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is kept in the shared checkpoint folder."""
    folder = f"{checkpoint_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
