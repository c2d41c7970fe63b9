"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

The index of a corpus has three tables in the shared folder. The log holds, for
each insertion and deletion of a document, its line keys with a reference more or
less; summed up by (key, document) it is the exact reference count. ``common``
holds the keys that enough documents hold, with their number of documents and
the largest id. Each shard of keys has a cuckoo filter over its common keys.

A line whose key misses the filter stays, and its key goes no further; a key
that hits is verified against ``common``. An update counts the keys that it
touches anew and moves those that cross the bound into or out of the filters, so
a deleted document leaves the index as if it had never been there.

Keys are 128-bit BLAKE2b digests of the lines' normal forms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table, text_bytes

MIN_CHARS, MIN_DOCS = 20, 3
SHARDS = 64
SLOTS = 4
FILL = 0.8  # share of a filter's slots that it is made for
KICKS = 500
SPREAD = 0x9E3779B97F4A7C15
FILTER_BYTES = 64 << 20  # filters are sent to the tasks up to this size; beyond it all keys go to the exact table
LOG = "key binary, doc_id long, text_hash long, refs long"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Digest of a line without ASCII white space at its ends and with A-Z lower-cased; None if that is too short."""
    line = line.strip(b" \t\n\x0b\x0c\r")
    if len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode()) < min_chars):
        return None
    return hashlib.blake2b(line.lower(), digest_size=16).digest()


def line_keys(docs: DataFrame, refs: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, doc_id, text_hash, refs): the distinct line keys of each row of ``docs``; text_hash is ``xxhash64(text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = [{line_key(x, min_chars) for x in set(t.split(b"\n"))} - {None} for t in text_bytes(part.column(1))]
                row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                keys = pa.array([k for f in found for k in f], pa.binary())
                yield pa.RecordBatch.from_arrays([keys, part.column(0).cast(pa.int64()).take(row), part.column(2).take(row), pa.array(np.full(len(row), refs))], ["key", "doc_id", "text_hash", "refs"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, LOG)


# ------------------------------------------------------------------ cuckoo filter
def halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers of each key: the first gives shard and fingerprint, the second the bucket."""
    both = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def shard_of(key: Column, shards: int) -> Column:
    """The key's shard, from its first two bytes."""
    return F.conv(F.hex(F.substring(key, 1, 2)), 16, 10).cast("int") % shards


class Cuckoo:
    """A set of 16-bit fingerprints in buckets of four, each in one of two buckets; supports removal of what was inserted."""

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, np.uint64(len(table) - 1)

    @staticmethod
    def sized(n: int) -> Cuckoo:
        buckets = 1
        while buckets * SLOTS * FILL < n:
            buckets *= 2
        return Cuckoo(np.zeros((buckets, SLOTS), np.uint16))

    def places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and both buckets of each key."""
        high, low = halves(keys)
        mark = (high >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)
        first = low & self.mask
        return mark.astype(np.uint16), first, first ^ self.other(mark)

    def other(self, mark: np.ndarray) -> np.ndarray:
        """What leads from either bucket of a fingerprint to the other."""
        return (mark * np.uint64(SPREAD) >> np.uint64(20)) & self.mask

    def holds(self, keys: list[bytes]) -> np.ndarray:
        """True for every key that was inserted, and by chance for few others."""
        if not keys:
            return np.zeros(0, bool)
        mark, a, b = self.places(keys)
        return ((self.table[a] == mark[:, None]) | (self.table[b] == mark[:, None])).any(axis=1)

    def insert(self, keys: list[bytes]) -> bool:
        """Insert all keys; False if one found no place, which leaves the filter unusable."""
        if not keys:
            return True
        for mark, a, b in zip(*(x.tolist() for x in self.places(keys))):
            for at in (a, b):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = mark
                    break
            else:
                at = b
                for kick in range(KICKS):
                    slot = (mark + kick) % SLOTS
                    mark, self.table[at, slot] = int(self.table[at, slot]), mark
                    at ^= mark * SPREAD >> 20 & int(self.mask)
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = mark
                        break
                else:
                    return False
        return True

    def remove(self, keys: list[bytes]) -> None:
        """Take one fingerprint of each key out again; the keys must be in the set."""
        if not keys:
            return
        for mark, a, b in zip(*(x.tolist() for x in self.places(keys))):
            at = a if (self.table[a] == mark).any() else b
            self.table[at, np.flatnonzero(self.table[at] == mark)[0]] = 0

    @staticmethod
    def of(keys: list[bytes]) -> Cuckoo:
        """A filter of ``keys``, made anew at twice the size if a key finds no place."""
        room = len(keys)
        while True:
            made = Cuckoo.sized(room)
            if made.insert(keys):
                return made
            room = 2 * max(room, 1)


FILTERS = "shard int, n long, cuckoo binary"


def filter_table(shard: int, n: int, cuckoo: Cuckoo) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([n]), "cuckoo": pa.array([cuckoo.table.tobytes()], pa.binary())})


def unpacked(data: bytes) -> Cuckoo:
    return Cuckoo(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())


def build_filters(common: DataFrame) -> DataFrame:
    """(shard, n, cuckoo) of the common keys of each shard."""
    def build(table: pa.Table) -> pa.Table:
        keys = sorted(table.column("key").to_pylist())
        return filter_table(table.column("shard")[0].as_py(), len(keys), Cuckoo.of(keys))

    return common.select("shard", "key").groupBy("shard").applyInArrow(build, FILTERS)


def move_keys(filters: DataFrame, moved: DataFrame, common: DataFrame) -> DataFrame:
    """``filters`` after the keys of ``moved`` (shard, key, up) went in or out; a shard that overflows is made anew from ``common``."""
    def move(old: pa.Table, keys: pa.Table) -> pa.Table:
        if old.num_rows == 0 and keys.num_rows == 0:
            return pa.table({"shard": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "cuckoo": pa.array([], pa.binary())})
        if keys.num_rows == 0:
            return old
        up = keys.column("up").to_pylist()
        listed = keys.column("key").to_pylist()
        into, out = sorted(k for k, u in zip(listed, up) if u), [k for k, u in zip(listed, up) if not u]
        n = (old.column("n")[0].as_py() if old.num_rows else 0) + len(into) - len(out)
        cuckoo = unpacked(old.column("cuckoo")[0].as_py()) if old.num_rows else Cuckoo.sized(0)
        cuckoo.remove(out)
        whole = n <= cuckoo.table.size * 0.95 and cuckoo.insert(into)
        shard = keys.column("shard")[0].as_py()
        return filter_table(shard, n, cuckoo) if whole else pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([-1]), "cuckoo": pa.array([b""], pa.binary())})

    after = shared_table(filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(move, FILTERS), "filters")
    full = after.where("n < 0").select("shard")
    return after.where("n >= 0").unionByName(build_filters(common.join(full, "shard", "left_semi")))


# ------------------------------------------------------------------ index
@dataclass
class LineIndex:
    """log (key, doc_id, text_hash, refs), common (shard, key, docs, top), filters (shard, n, cuckoo), all in the shared folder."""

    log: DataFrame
    common: DataFrame
    filters: DataFrame
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS
    shards: int = SHARDS


def key_counts(log: DataFrame) -> DataFrame:
    """(key, docs, top) from the reference counts; rows without an id are one document, below all others.

    The counts by (key, document) come first, so that a line of very many
    documents is spread over the tasks and then met as one row of each.
    """
    held = log.groupBy("key", "doc_id").agg(F.sum("refs").alias("refs")).where("refs > 0")
    return held.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("top"))


def common_keys(counts: DataFrame, min_docs: int, shards: int) -> DataFrame:
    return counts.where(F.col("docs") >= min_docs).select(shard_of(F.col("key"), shards).alias("shard"), "key", "docs", "top")


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int = SHARDS) -> LineIndex:
    """The index of ``docs`` (doc_id, text)."""
    log = shared_table(line_keys(docs, 1, min_chars), "lines")
    common = shared_table(common_keys(key_counts(log), min_docs, shards), "common")
    return LineIndex(log, common, shared_table(build_filters(common), "filters"), min_chars, min_docs, shards)


def update(index: LineIndex, docs: DataFrame, refs: int) -> LineIndex:
    change = shared_table(line_keys(docs, refs, index.min_chars), "lines")
    touched = change.select("key").distinct()
    log = index.log.unionByName(change)
    now = common_keys(key_counts(log.join(touched, "key", "left_semi")), index.min_docs, index.shards)
    now = shared_table(now, "touched")
    common = shared_table(index.common.join(touched, "key", "left_anti").unionByName(now), "common")
    before = index.common.join(touched, "key", "left_semi")
    up = now.join(before, "key", "left_anti").select("shard", "key", F.lit(True).alias("up"))
    down = before.join(now, "key", "left_anti").select("shard", "key", F.lit(False).alias("up"))
    filters = shared_table(move_keys(index.filters, up.unionByName(down), common), "filters")
    return LineIndex(log, common, filters, index.min_chars, index.min_docs, index.shards)


def insert_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with the rows of ``docs`` added."""
    return update(index, docs, 1)


def delete_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index without the rows of ``docs``, which have to be in it with these texts."""
    return update(index, docs, -1)


def candidates(keys: DataFrame, index: LineIndex) -> DataFrame:
    """``keys`` (key, doc_id, text_hash) without those that miss their shard's filter."""
    size = index.filters.agg(F.sum(F.length("cuckoo"))).first()[0] or 0
    if size > FILTER_BYTES:
        return keys
    shards = index.shards
    table = keys.sparkSession.sparkContext.broadcast({r.shard: bytes(r.cuckoo) for r in index.filters.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {s: unpacked(data) for s, data in table.value.items()}
        for batch in batches:
            listed = batch.column(0).to_pylist()
            raw = np.frombuffer(b"".join(listed), np.uint8).reshape(-1, 16)
            shard = (raw[:, 0].astype(np.int64) * 256 + raw[:, 1]) % shards
            hit = np.zeros(len(listed), bool)
            for s in np.unique(shard):
                if int(s) in filters:
                    at = np.flatnonzero(shard == s)
                    hit[at] = filters[int(s)].holds([listed[i] for i in at])
            yield batch.filter(pa.array(hit))

    return keys.mapInArrow(run, keys.schema)


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): each row of ``docs`` without its common lines, ``kept`` being the other lines joined by a newline.

    Common is a line whose key has at least ``min_chars`` code points and is
    found in at least ``min_docs`` documents of ``index`` (None: of ``docs``);
    all its lines go, but for those of the largest doc_id that holds it. Null
    texts read as empty, which is one empty line; rows that share an id are one
    document with regard to the counts, and each stays a row; rows without an id
    are one document that is below all others; no rows give no rows. Other
    columns of ``docs`` are not read.
    """
    docs = docs.select("doc_id", "text")
    if index is None:
        index = build_index(docs, min_chars, min_docs)
        keys = index.log
    else:
        keys = line_keys(docs, 1, index.min_chars)
    likely = candidates(keys.select("key", "doc_id", "text_hash"), index)
    verdict = likely.join(index.common.select("key", "top"), "key").where(~F.col("doc_id").eqNullSafe(F.col("top")))
    drops = verdict.groupBy(F.col("doc_id").alias("id"), "text_hash").agg(F.collect_set("key").alias("drops"))
    rows = docs.withColumn("h", F.xxhash64("text"))
    met = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("text_hash")), "left")
    min_chars = index.min_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, dropped, kept = [], [], []
            for text, drops in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist()):
                gone, n = set(drops or ()), text.count(b"\n") + 1
                if gone:
                    lines = [x for x in text.split(b"\n") if line_key(x, min_chars) not in gone]
                    text, left = b"\n".join(lines), len(lines)
                else:
                    left = n
                total.append(n)
                dropped.append(n - left)
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return met.select("doc_id", "text", "drops").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")
