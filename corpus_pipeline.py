"""A training-data pipeline over the documents table, as named stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as
Parquet and reread as the next stage's ``docs``. All stages but the last keep the columns
of ``docs``, and each works on all that its predecessor kept. An empty table passes every
stage; further columns of ``docs`` may have any names and are kept up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import exact_dedup, language_id, mixing, piece_tokenizer, similar_texts
from quarryline.session import ensure_checkpoint_dir, remove_folder, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: null or without letters, or a score below one half.

    Repeated rows go or stay together.
    """
    return language_id.drop_unidentified(docs, language_id.train(docs))


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of equal texts stays; of rows with its id, too, one stays. Null texts are empty ones."""
    return exact_dedup.drop_exact_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with 0.8 or more of their shingles of five words in common stays.

    They meet in balls of SimHash fingerprints and in bands of least hashes, and whole texts decide.
    The smallest doc_id stays; null and wordless texts are equal.
    """
    return similar_texts.drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights; a document used in n epochs has n rows. A null source is one, too."""
    return mixing.take_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the verified round trip and parity; null texts have none."""
    return piece_tokenizer.encode_pieces(docs, piece_tokenizer.read_model())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", remove_exact_copies),
    ("near_dedup", remove_near_copies),
    ("mixing", mix),
    ("sentencepiece", tokenize),
]

#: SQL cannot express the language model, the near copies' components or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``.

    What lies between them is written to the shared checkpoint folder, and deleted when the stage
    that reads it is written itself; the result reads what the last but one left.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
