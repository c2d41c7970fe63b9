"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcast.session import cut_lineage, ensure_checkpoint_dir
from weftcast.sources.tables import read_table


def whole_texts(spark: SparkSession, rows: int = 1024) -> None:
    """Smaller Arrow batches for this session: their rows are whole documents, and a batch is held in memory at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole_texts(spark)
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"])


def whole_text(col: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's decimal text leaves remainder 1 modulo 3; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def held_out_id(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Work that several branches need is done once, and a lost executor rereads
    files instead of losing them.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_buckets(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Like ``shared_table``, as a table bucketed by ``column``: grouping by it reads the files without a shuffle.

    The files lie in the shared checkpoint folder, as an external table whose
    name is given up again once it is read.
    """
    spark = df.sparkSession
    unique = f"{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", f"{ensure_checkpoint_dir(spark)}/{unique}").bucketBy(buckets, column).saveAsTable(unique)
    table = spark.table(unique)
    spark.sql(f"DROP TABLE {unique}")
    return table


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores until it clashes with no column."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each row; null reads as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def label_rows(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): one training label for each id outside the held-out fold.

    Rows with a null id or label are left out; repeated rows of an id are
    averaged, and an average of one half or more counts as 1.
    """
    return (
        labels.select("doc_id", F.col(column).cast("double").alias("v"))
        .where(F.col("doc_id").isNotNull() & F.col("v").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg((F.avg("v") >= 0.5).cast("int").alias("y"))
    )


def bounded_ids(ids: DataFrame, bound: int, seed: int = 11) -> DataFrame:
    """A bounded sample of label rows: those ``bound`` with the smallest hash of the id (a top-k, no full sort)."""
    return ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(bound)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b) as (node, component), component being the smallest node.

    Alternating large-star and small-star steps: every step replaces the edges
    of a node by edges to its smallest neighbour, so that hubs shrink and the
    number of rounds is logarithmic. Each round is one checkpoint in the shared
    folder; the driver sees two numbers a round, never a node.
    """
    def smallest(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.min("b").alias("m"))

    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = smallest(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a <> b")
        low = smallest(large)
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut_lineage(small.select("e.a", "e.b").where("a <> b").distinct())
        state = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = state


WORD = re.compile(r"[^\W\d_]+")
