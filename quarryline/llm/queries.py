"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import (
    chat_format,
    exact_dedup,
    gif_media,
    language_id,
    license_scan,
    mixing,
    near_dedup,
    periodic_runs,
    piece_tokenizer,
    quality,
    secret_scan,
    toxicity,
    turn_repair,
)
from quarryline.session import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(documents(spark, sf_dir))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.repair_chats(table(spark, sf_dir, "conversations"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir).select("doc_id", "source", "text")).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("mix_words").alias("size"),
        F.col("mix_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.text_media(documents(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_tokenizer.encode_pieces(documents(spark, sf_dir), piece_tokenizer.read_model())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(periodic_runs.find_runs(periodic_runs.planted_tails(documents(spark, sf_dir))))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.repair_digests(turn_repair.damaged_turns(conversations), conversations)


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(license_scan.scan_licenses(documents(spark, sf_dir)))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_chat_format": op2_chat_format,
    "op3_simhash": op3_simhash,
    "op4_secrets": op4_secrets,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_gif_media": op7_gif_media,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_turn_repair": op12_turn_repair,
    "op13_licenses": op13_licenses,
}

ORACLE_SQL = {
    "op5_mixing": mixing.MIXING_SQL,
    "op9_exact_dedup": exact_dedup.EXACT_DEDUP_SQL,
    "op12_turn_repair": turn_repair.repair_sql(),
    "op13_licenses": license_scan.license_sql(),
}
