"""Hashed indicators of whole texts for the linear classifiers."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 1 << 18
KNOWN = 50_000  # words whose features a task remembers
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’…–—"
PREFIX = 4

Features = Callable[[str], np.ndarray]


class Known(dict):
    """A bounded memory of a function of words."""

    def __init__(self, of: Callable[[str], int]):
        super().__init__()
        self.of = of

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = out = self.of(word)
        return out


def hashed(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % DIM


def word_code(token: str) -> int:
    """The ids of a token's word and of its first letters, in one number; -1: no letters left."""
    word = token.strip(EDGE)
    if not word:
        return -1
    return hashed("w:" + word) * DIM + hashed("p:" + word[:PREFIX])


def word_features() -> Features:
    """Indicators of lower-case words and of their first four letters."""
    known = Known(word_code)

    def run(text: str) -> np.ndarray:
        tokens = set(text.lower().split())
        codes = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        codes = codes[codes >= 0]
        return np.unique(np.concatenate([codes // DIM, codes % DIM]))

    return run


def shape_code(token: str) -> int:
    """A token's shape: marks around it as they are, and the case and length of what is between."""
    core = token.strip(EDGE)
    head, _, tail = token.partition(core) if core else (token, "", "")
    case = "0" if not core else "d" if core.isdigit() else "l" if core.islower() else "U" if core.isupper() else "T" if core[:1].isupper() and core[1:].islower() else "m"
    return zlib.crc32(f"{re.sub(r'(.)\1{3,}', r'\1\1\1\1', head[:8])} {case}{min(len(core), 24) // 4} {re.sub(r'(.)\1{3,}', r'\1\1\1\1', tail[:8])}".encode("utf-8", "surrogatepass"))


def shape_features() -> Features:
    """Indicators of n-grams of token shapes, one to three long, of runs of a repeated token, and of how much of a text repeats."""
    known = Known(shape_code)

    def run(text: str) -> np.ndarray:
        tokens = text.split()
        n = len(tokens)
        one = np.fromiter(map(known.__getitem__, tokens), np.int64, n)
        ids = np.fromiter(map(hash, tokens), np.int64, n)
        same = ids[1:] == ids[:-1]
        two = one[:-1] * 31 + one[1:] * 7 + 1
        three = two[:-1] * 131 + one[2:] * 17 + 2
        share = int(10 * len(set(tokens)) / n) if n else -1
        runs = int(10 * same.mean()) if n > 1 else -1
        facts = np.array([hashed(f"distinct {share}"), hashed(f"runs {runs}"), hashed(f"words {n.bit_length()}")])
        repeated = np.array([hashed("twice"), hashed("thrice")])[[bool(same.any()), bool((same[1:] & same[:-1]).any())]]
        grams = np.concatenate([one, two, three]) % 1000003 % DIM
        return np.unique(np.concatenate([grams, facts, repeated]))

    return run


def class_counts(rows: DataFrame, features: Callable[[], Features]) -> DataFrame:
    """(feature, n0, n1): documents of each class that hold a feature, of ``rows`` (text, y); feature -1 counts the documents.

    Added up in each task first: at most DIM rows leave it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts = features(), np.zeros((2, DIM + 1), np.int64)
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[y, of(text or "")] += 1
                counts[y, DIM] += 1
        used = np.nonzero(counts.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.where(used == DIM, -1, used)), pa.array(counts[0, used]), pa.array(counts[1, used])], ["feature", "n0", "n1"])

    parts = rows.select("text", "y").mapInArrow(run, "feature long, n0 long, n1 long")
    return parts.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def count_arrays(rows: DataFrame, features: Callable[[], Features]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by class (2, DIM) and documents by class (2,): bounded by DIM on the driver."""
    counts = np.zeros((2, DIM + 1), np.int64)
    for r in class_counts(rows, features).collect():
        counts[:, r.feature] = r.n0, r.n1
    return counts[:, :DIM], counts[:, DIM]


def score_texts(docs: DataFrame, features: Callable[[], Features], score) -> DataFrame:
    """(doc_id, score) of each whole text by ``score``, a function of its features; null reads as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = features()
        for batch in batches:
            out = [score(of(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
