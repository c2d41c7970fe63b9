"""Corpus pipeline: quality, near-duplicates, benchmark passages, secrets, token ids.

Every stage takes the documents that the one before kept. All but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcast.llm import bpe, common, decontam, quality, secret_scan, simhash
from weftcast.session import ensure_checkpoint_dir
from weftcast.sources.tables import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of the documents it is given."""
    common.whole_texts(spark)
    return quality.keep_quality(docs, read_table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the document with the smallest id stays, one row of it if it is repeated.

    A group without any id keeps one row: that of the smallest text hash. If one
    id has texts in several groups, each of them keeps its row of that id.
    """
    common.whole_texts(spark)
    found = simhash.simhash_near_duplicates(docs, shingle=3, max_bits=2).where("kept")
    chosen = found.groupBy("root", "component_id").agg(F.min("text_hash").alias("h"), F.count(F.lit(1)).alias("rows"))
    name = common.free_name("_hash", docs.columns)
    rows = docs.withColumn(name, F.xxhash64("text"))
    same = lambda c: rows["doc_id"].eqNullSafe(c["component_id"]) & (rows[name] == c["h"])
    single, repeated = chosen.where("rows = 1"), chosen.where("rows > 1")
    once = rows.join(single, same(single), "left_semi").select(*docs.columns)
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    first = F.min_by(F.struct(*docs.columns), F.xxhash64(*hashed))
    several = rows.join(repeated, same(repeated), "left_semi").groupBy("doc_id", name).agg(first.alias("d")).select("d.*")
    return once.unionByName(several)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    common.whole_texts(spark)
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return secret_scan.redact(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, with the digest of the text that the ids decode to."""
    ensure_checkpoint_dir(spark)
    common.whole_texts(spark)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    decoded = bpe.bpe_decode(bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("byte_bpe", token_stage),
]

#: The classifier's fit isn't SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read back."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
