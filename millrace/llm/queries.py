"""The queries of this package, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, infilling, media, mixing, ngram_join, packing, piece_counts, quality, resampling, secrets, sql, token_archive, warc
from .common import new_path, read_table, staged


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-archive")
    token_archive.write_archive(read_table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_archive.read_digests(spark, path)


#: A conversation whose texts hold the template's own control strings.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    conversations = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digests(staged(chat.format_conversations(conversations), "chat"))


def op4_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.count_pieces(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(read_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).where("reason is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.judge(read_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = staged(media.text_images(read_table(spark, sf_dir, "documents")), "media")
    return media.digests(stored)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.links(read_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"), secrets.train(secrets.labelled_findings(spark)))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.digests(infilling.fill_in_middle(read_table(spark, sf_dir, "documents")))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near_items")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_archive, op2_chat, op3_quality, op4_piece_counts, op5_warc, op6_media, op7_ngram_join, op8_packing, op9_secrets, op10_mixing, op11_resampling, op12_infilling, op13_decontamination, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op11_resampling": sql.OP11, "op12_infilling": sql.OP12, "op13_decontamination": sql.OP13}
