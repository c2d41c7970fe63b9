"""Benchmark decontamination by the q-gram lemma.

A passage of length L that occurs in a text with at most k edits shares at least
L + 1 - q * (k + 1) of its q-grams with it, on diagonals (text position minus
passage position) at most k apart. Shared q-grams are counted in overlapping
bands of diagonals, regions that reach the bound are kept, and a banded alignment
of the whole passage verifies each.

The grams of a passage are as long as its own budget allows: q characters, or
fewer where the bound would fall below one (lengths such as 10 to 15 at q = 8 and a budget of a
tenth). No budget is cut; passages of one gram length make one index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 8
EDITS = 0.1  # edit budget as a share of a passage's length
BLOCK_CHARS = 8 << 20  # benchmark text that one pass holds: bounds what is sent to the tasks
SLICE_CHARS = 1 << 20  # document text handled at once; longer texts go in overlapping windows
POSTINGS = 1 << 22  # shared q-grams counted at once
TABLE_BITS = 20
BASE = np.uint64(0x9E3779B97F4A7C15)
END = "\U0010ffff"


def normal(text: str | None) -> str:
    """Lower case, with each run of white space as one space."""
    return " ".join((text or "").lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A polynomial hash of each q-gram, built by doubling."""
    total, width, offset = None, 1, 0
    run, power = codes.astype(np.uint64) + np.uint64(1), np.full(1, BASE)
    while True:
        if q & width:
            n = max(0, len(codes) - q + 1)
            part = run[offset:offset + n]
            total = part.copy() if total is None else total * power + part
            offset += width
        if 2 * width > q:
            return total
        run = run[:-width] * power + run[width:] if len(run) > width else run[:0]
        width, power = 2 * width, power * power


@dataclass
class Passages:
    """Passages with grams of ``q`` characters: sorted hashes and, for each, the passages and positions it is found at."""

    q: int
    ids: list
    codes: list[np.ndarray]
    budget: np.ndarray
    need: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    item: np.ndarray
    position: np.ndarray
    table: np.ndarray

    def reach(self) -> int:
        """No passage is found in a stretch longer than this."""
        return int(max(len(c) for c in self.codes) + self.budget.max())


@dataclass
class Benchmark:
    """An index for each gram length, and the passages that go by as they are: those of one to ``q`` - 1 characters without a budget."""

    indexes: list[Passages]
    short: list[tuple[int, str]]


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes ^ (hashes >> np.uint64(29))) * BASE >> np.uint64(64 - TABLE_BITS)


def index_passages(rows: list[tuple[int, str]], q: int = Q, edits: float = EDITS) -> Benchmark:
    """Passages without a budget that are shorter than ``q`` are searched as they are; empty ones are left out."""
    by_length: dict[int, list] = {}
    short = []
    for i, raw in rows:
        text = normal(raw)
        budget = min(int(len(text) * edits), len(text) - 1)  # a budget of the whole length would find a passage anywhere
        if text and not budget and len(text) < q:
            short.append((i, text))
        elif text:
            by_length.setdefault(min(q, len(text) // (budget + 1)), []).append((i, points(text), budget))
    return Benchmark([index_grams(part, size) for size, part in sorted(by_length.items())], short)


def index_grams(part: list[tuple[int, np.ndarray, int]], q: int) -> Passages:
    length, budget = np.array([len(c) for _, c, _ in part]), np.array([k for _, _, k in part], np.int64)
    grams = [gram_hashes(c, q) for _, c, _ in part]
    item = np.repeat(np.arange(len(part)), [len(g) for g in grams])
    position = np.concatenate([np.arange(len(g)) for g in grams])
    every = np.concatenate(grams)
    order = np.argsort(every, kind="stable")
    hashes, starts, sizes = np.unique(every[order], return_index=True, return_counts=True)
    table = np.zeros(1 << TABLE_BITS, bool)
    table[slots(hashes)] = True
    return Passages(q, [i for i, _, _ in part], [c for _, c, _ in part], budget, length + 1 - q * (budget + 1), hashes, starts, sizes, item[order], position[order], table)


def aligned(text: np.ndarray, at: np.ndarray, limit: np.ndarray, passages: Passages, item: np.ndarray, width: int) -> np.ndarray:
    """Fewest edits that turn the whole passage into a stretch of text, for each region.

    Row j of the alignment holds the ``width`` diagonals from at[i] on, less
    their number, so that inserting costs nothing along a row; a stretch may
    begin and end on any of them. Characters outside [limit[i, 0], limit[i, 1])
    match nothing, which costs as much as leaving out a passage's character.
    """
    lengths = np.array([len(passages.codes[i]) for i in item])
    letters = np.zeros((lengths.max(), len(item)), np.uint32)
    for region, i in enumerate(item):
        letters[:lengths[region], region] = passages.codes[i]
    where = at[None, :] + np.arange(lengths.max() + width)[:, None]
    inside = (where >= limit[:, 0]) & (where < limit[:, 1])
    window = np.where(inside, text[np.clip(where, 0, len(text) - 1)], np.uint32(0xFFFFFFFF))
    step = np.arange(width, dtype=np.int32)[:, None]
    cost = np.repeat(-step, len(item), axis=1)
    best = np.zeros(len(item), np.int64)
    ends = set(lengths.tolist())
    for j in range(lengths.max()):
        moved = cost + (window[j:j + width] != letters[j])
        np.minimum(moved[:-1], cost[1:] + 2, out=moved[:-1])
        cost = np.minimum.accumulate(moved, axis=0)
        if j + 1 in ends:
            done = lengths == j + 1
            best[done] = (cost[:, done] + step).min(axis=0)
    return best


def added_up(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    low, high = (int(keys.min()), int(keys.max())) if len(keys) else (0, 0)
    if high - low < 2 * len(keys):
        total = np.bincount(keys - low, weights=counts, minlength=1)
        at = np.nonzero(total)[0]
        return at + low, total[at].astype(np.int64)
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, weights=counts, minlength=1)[:len(found)].astype(np.int64)


def full_bands(hit: np.ndarray, gram: np.ndarray, doc: np.ndarray, starts: np.ndarray, size: int, passages: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, passage, band of diagonals) of the bands with enough shared q-grams, counted ``POSTINGS`` at a time."""
    sizes = passages.sizes[gram]
    cuts = np.nonzero(np.diff(np.cumsum(sizes) // POSTINGS))[0] + 1
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in np.split(np.arange(len(hit)), cuts):
        many = sizes[part]
        begin = np.cumsum(many) - many
        posting = np.repeat(passages.starts[gram[part]] - begin, many) + np.arange(many.sum())
        text, item = np.repeat(doc[part], many), passages.item[posting]
        diagonal = np.repeat(hit[part], many) - passages.position[posting] - starts[text] + size
        bands = diagonal // (passages.budget[item] + 1)  # a band covers two such steps, so each diagonal lies in two bands
        key, count = added_up((text * len(passages.ids) + item) * (4 * size) + bands)
        key, count = added_up(np.concatenate([key, key - 1]), np.concatenate([count, count]))
        keys, counts = (key, count) if not len(keys) else added_up(np.concatenate([keys, key]), np.concatenate([counts, count]))
    spot, band = np.divmod(keys, 4 * size)
    text, item = np.divmod(spot, len(passages.ids))
    keep = counts >= passages.need[item]
    return text[keep], item[keep], band[keep]


def slice_leaks(texts: list[str], passages: Passages) -> Iterator[tuple[int, object, int]]:
    """(place in ``texts``, item id, edits) of each region within its passage's budget."""
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    text = points(END.join(texts) + END)
    hashes = gram_hashes(text, passages.q)
    hit = np.nonzero(passages.table[slots(hashes)])[0]
    gram = np.searchsorted(passages.hashes, hashes[hit])
    real = passages.hashes[np.minimum(gram, len(passages.hashes) - 1)] == hashes[hit]
    hit, gram = hit[real], gram[real]
    doc = np.searchsorted(starts, hit, side="right") - 1
    enough = np.bincount(doc, minlength=len(texts)) >= passages.need.min()
    hit, gram, doc = hit[enough[doc]], gram[enough[doc]], doc[enough[doc]]
    doc, item, band = full_bands(hit, gram, doc, starts, len(text), passages)
    k = passages.budget[item]
    at = band * (k + 1) - len(text) + starts[doc]
    order = np.argsort([len(passages.codes[i]) for i in item], kind="stable")
    for part in np.array_split(order, max(1, len(order) // 64)):
        if len(part):
            limit = np.stack([starts[doc[part]], starts[doc[part] + 1] - 1], axis=1)
            edits = aligned(text, at[part], limit, passages, item[part], int(2 * k[part].max() + 2))
            for d, i, e, most in zip(doc[part], item[part], edits, k[part]):
                if e <= most:
                    yield int(d), passages.ids[i], int(e)


def windows(text: str, reach: int) -> Iterator[str]:
    """The text in parts of ``SLICE_CHARS`` characters, each with the next ``reach``: any stretch of so many lies in one part."""
    for at in range(0, max(1, len(text) - reach), SLICE_CHARS):
        yield text[at:at + SLICE_CHARS + reach]


def find_leaks(texts: list[str | None], benchmark: Benchmark) -> dict[tuple[int, object], int]:
    """(row of ``texts``, item id) to the fewest edits, for passages within their budget."""
    found: dict[tuple[int, object], int] = {}
    reach = max((p.reach() for p in benchmark.indexes), default=0)
    rows: list[int] = []
    batch: list[str] = []

    def flush() -> None:
        for passages in benchmark.indexes if batch else ():
            for place, item, edits in slice_leaks(batch, passages):
                spot = (rows[place], item)
                found[spot] = min(edits, found.get(spot, edits))
        rows.clear()
        batch.clear()

    size = 0
    for row, raw in enumerate(texts):
        text = normal(raw)
        for i, short in benchmark.short:
            if short in text:
                found[row, i] = 0
        for part in windows(text, reach) if text and benchmark.indexes else ():
            rows.append(row)
            batch.append(part)
            size += len(part)
            if size >= SLICE_CHARS:
                flush()
                size = 0
    flush()
    return found


def passage_blocks(benchmark: DataFrame, q: int, edits: float, block_chars: int) -> Iterator[Benchmark]:
    """The benchmark's passages, in blocks of about ``block_chars`` characters: one pass over the documents each."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).distinct().orderBy("item_id", "text").collect()
        yield index_passages([(r.item_id, r.text) for r in rows], q, edits)


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits): each passage that a document holds within the passage's edit budget.

    Compared are texts in lower case with white space folded. The budget is
    ``edits`` of a passage's length, rounded down, whatever the length. Null and empty texts and passages hold and match nothing;
    passages too short for an edit match exactly; repeated rows of a document
    or item give one row with the fewest edits; passages without id are left
    out; no documents or no passages give no rows. Other columns are not read.
    """
    spark, out = docs.sparkSession, None
    for passages in passage_blocks(benchmark, q, edits, block_chars):
        shared = spark.sparkContext.broadcast(passages)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, leaks = batch.column(0).to_pylist(), find_leaks(batch.column(1).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r, _ in leaks], pa.int64()), pa.array([i for _, i in leaks], pa.int64()), pa.array(list(leaks.values()), pa.int32())], ["doc_id", "item_id", "edits"])

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, edits int")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows whose text holds a passage; all columns stay, nothing is shuffled."""
    spark, names = docs.sparkSession, docs.columns
    at = names.index("text")
    for passages in passage_blocks(benchmark, q, edits, block_chars):
        shared = spark.sparkContext.broadcast(passages)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, _ in find_leaks(batch.column(at).to_pylist(), shared.value)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
