"""SimHash near-duplicates by a segment-popcount embedding.

Each fingerprint maps to the bit counts of its 32 two-bit segments. The
Manhattan distance of two such count vectors never exceeds the Hamming distance
of the fingerprints, so fingerprints within ``max_bits`` have a grid cell
between them that is half of that, rounded up, from each. The range join puts a
fingerprint into all cells so near. Cells of up to ``CELL`` fingerprints
compare each two and verify the Hamming distance. Larger ones are cut by the
same embedding with one-bit segments, where Manhattan and Hamming distance are
one: a cell then is a bit pattern, holds no more fingerprints than there are
patterns around it, and all in the nearer half link to all in it, so that links
to the smallest of them replace the pairs. A group of k near copies makes some
k links, never k * k.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftcast.session import cut_lineage

from .common import components, text_bytes

SHINGLE = 3
MAX_BITS = 2
SEED = 42
CELL = 16  # fingerprints of a two-bit cell that are compared each with each
SALTS = 1024
LOW_BITS = 0x5555555555555555
SLICE = 1 << 16  # shingles turned into bit counts at once: 4 MB


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of one UTF-8 text; zero for a text without words."""
    words = text.lower().split()  # bytes: exactly A-Z are lowered, and exactly \x20 \x09-\x0D split
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    starts, last = starts[:n].tolist(), last[:n].tolist()
    for at in range(0, n, SLICE):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[at:at + SLICE], last[at:at + SLICE])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(((ones * 2 > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, text_hash): the fingerprint of every whole text as a signed 64-bit number; null text reads as empty.

    text_hash is ``xxhash64(text)``; it tells apart rows that share an id.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in text_bytes(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp), batch.column(2)], ["doc_id", "fp", "text_hash"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, fp long, text_hash long")


def segment_counts(fp):
    """Bit counts of the 32 two-bit segments, kept as 32 two-bit numbers in one long."""
    low, high = fp.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # the sum, without a carry past bit 63


def masks(bits: int) -> list[int]:
    """All 64-bit numbers with at most ``bits`` ones, as signed longs."""
    sums = (sum(1 << i for i in places) for k in range(bits + 1) for places in combinations(range(64), k))
    return [m - (1 << 64) if m >> 63 else m for m in sums]


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links that connect exactly the distinct fingerprints ``fp`` within ``max_bits`` bits (0 to 4) of one another.

    Components are those of all pairs within the bound; every row returned is
    such a pair, verified on the fingerprints themselves.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("max_bits must be 0 to 4")
    far, near = masks(max_bits - max_bits // 2), masks(max_bits // 2)
    around = lambda m: F.transform(F.array(*[F.lit(x) for x in m]), lambda x: F.col("fp").bitwiseXOR(x))
    verified = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= max_bits
    cell = Window.partitionBy("cell")
    grid = fps.select("fp", F.explode(F.array_distinct(F.transform(around(far), segment_counts))).alias("cell"))
    met = cut_lineage(grid.withColumn("size", F.count(F.lit(1)).over(cell)).where("size > 1"))

    later = F.collect_list("fp").over(cell.orderBy("fp").rowsBetween(1, CELL - 1))
    pairs = met.where(F.col("size") <= CELL).select("fp", later.alias("later")).select(F.explode(F.filter("later", lambda x: verified(x, F.col("fp")))).alias("a"), F.col("fp").alias("b"))

    keys = F.transform(around(far), lambda k: F.struct(k.alias("key"), (F.bit_count(k.bitwiseXOR(F.col("fp"))) <= max_bits // 2).alias("inner")))
    fine = met.where(F.col("size") > CELL).select("fp", F.explode(F.filter(keys, lambda k: segment_counts(k["key"]) == F.col("cell"))).alias("k")).select("fp", "k.*")
    centre = F.min(F.when(F.col("inner"), F.col("fp"))).over(Window.partitionBy("key"))
    stars = fine.select(F.col("fp").alias("a"), centre.alias("b")).where((F.col("a") != F.col("b")) & verified(F.col("a"), F.col("b")))
    return pairs.unionByName(stars).distinct()


def simhash_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, text_hash, root, component_id, kept) for each row of ``docs``; link: at most ``max_bits`` differing bits.

    root is the component's smallest fingerprint and names the component;
    component_id is the smallest doc_id reachable by links, which two components
    share if one id has two texts that don't link; kept marks that
    document (of repeated rows of an id each is marked). Null texts read as
    empty; texts without words share fingerprint zero and link like any other.
    A row without an id gets the smallest id of its group, or null if there is
    none, and is kept only then. No rows give no rows. Other columns of ``docs``
    are not read.

    Rows of one fingerprint are dealt to ``SALTS`` shares, so a group of exact
    copies never meets in one task.
    """
    fps = cut_lineage(fingerprints(docs, shingle, seed).withColumn("share", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))))
    shares = fps.groupBy("fp", "share").agg(F.min("doc_id").alias("first"))
    classes = cut_lineage(shares.groupBy("fp").agg(F.min("first").alias("first")))
    found = components(links(classes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    tied = classes.join(found, "fp")
    roots = classes.join(found.select(F.col("component").alias("fp")).distinct(), "fp").withColumn("component", F.col("fp"))
    group = tied.select("component", "first", "fp").unionByName(roots.select("component", "first", "fp"))
    least = group.groupBy("component").agg(F.min("first").alias("least"))
    moved = group.join(least, "component").select("fp", "component", "least")
    known = classes.join(moved, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"), F.coalesce("least", "first").alias("component_id"))
    known = shares.select("fp", "share").join(known, "fp")
    return fps.join(known, ["fp", "share"]).select("doc_id", "fp", "text_hash", "root", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
