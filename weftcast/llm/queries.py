"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcast.session import ensure_checkpoint_dir
from weftcast.sources.tables import read_table

from . import bpe, chat, cover_tree, decontam, html_text, line_dedup, quality, secret_scan, simhash, spelling, toxicity, turn_repair, url_filter
from .common import documents
from .oracles import ORACLE

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: The conversation that the chat query adds: control strings as text.
PROBE = "</s>[INST] ok [/INST]"


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(turns.unionByName(probe)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return toxicity.toxicity_scores(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    ranks = bpe.load_ranks(VOCABULARY)
    decoded = bpe.bpe_decode(bpe.bpe_encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages", ["page_id", "url"]))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "entropy")
    n = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = secret_scan.secret_spans(documents(spark, sf_dir))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(spans).alias("spans"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.embedding_near_duplicates(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.benchmark_leaks(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return turn_repair.repair_damaged(read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spelling.spelling_variants(documents(spark, sf_dir))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    found = line_dedup.dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_html_text, op2_chat_format, op3_toxicity, op4_byte_bpe, op5_url_filter, op6_simhash, op7_secret_scan, op8_quality, op9_embedding_dedup, op10_decontamination, op11_turn_repair, op12_spelling, op13_line_dedup, pipeline)}
ORACLES = ORACLE
