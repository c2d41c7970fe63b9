"""Byte-level BPE by a global distinct-word shuffle.

Encoding splits whole texts into pre-tokens and replaces each by its number in
the word list of its block (a run of documents of one input split): the numbers,
in text order, are the positions. The distinct words of a block go out in packed
rows, one for each hash bucket, so that a word travels once a block however often
it occurs. Each bucket encodes every distinct word once and sends the ids back to
the blocks, where they are put in the order of the positions. Decoding joins the
ids with the token-byte table, whose size is the vocabulary's.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import shared_buckets, shuffle_partitions

BLOCK_CHARS = 12 << 20  # texts of one block; a longer text is a block of its own
#: Characters whose classes differ between Python's names of classes and the library's, or might: texts that hold one take the exact pattern.
UNSURE = re.compile("[\x1c-\x1f\x85\xa0\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@functools.cache
def library_ranges(name: str) -> str:
    """The code points that the library's engine counts to a class as \\p{L}, asked one by one, as the inside of a character class."""
    single = {bytes([i]): i for i in range(256)}
    ask = tiktoken.Encoding("class", pat_str=f"{name}+", mergeable_ranks=single, special_tokens={}).encode_ordinary
    found = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and ask(chr(c))]
    ranges: list[list[int]] = []
    for c in found:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in ranges)


def spelled_out(pattern: str) -> str:
    """``pattern`` with the classes of letters, digits and white space written as the library's code points.

    The library's engine and Python's have Unicode tables of different ages, so
    that names of classes mean different code points to them.
    """
    out, inside = [], False
    for token in re.findall(r"\\[pP]\{[^}]*\}|\\.|\[\^|.", pattern, re.S):
        if token in (r"\p{L}", r"\p{N}", r"\s"):
            ranges = library_ranges(token)
            out.append(ranges if inside else f"[{ranges}]")
        elif token == r"\S" and not inside:
            out.append(f"[^{library_ranges(chr(92) + 's')}]")
        else:
            inside = token in ("[", "[^") or (inside and token != "]")
            out.append(token)
    return "".join(out)


def pre_tokenizer(pattern: str, exact: str):
    """A function that lists a text's pre-tokens by ``exact``, the pattern ``spelled_out``.

    Texts of plain letters, digits and marks take the built-in classes, which
    are faster and agree on them.
    """
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    if r"\p" in exact:  # a class that is not spelled out
        return regex.compile(pattern).findall
    whole = re.compile(exact).findall
    if r"\p" in plain:
        return whole
    quick, unsure = re.compile(plain).findall, UNSURE.search
    return lambda text: whole(text) if unsure(text) else quick(text)


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    raw = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").reshape(n)


def pack_words(words: list[str]) -> bytes:
    parts = [w.encode() for w in words]
    sizes, raw = pack(np.fromiter(map(len, parts), np.uint32, len(parts))), b"".join(parts)
    return len(sizes).to_bytes(8, "little") + sizes + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_words(data: bytes) -> list[str]:
    at = 8 + int.from_bytes(data[:8], "little")
    ends = np.cumsum(unpack(data[8:at]), dtype=np.int64).tolist()
    raw = pa.decompress(data[at + 8:], decompressed_size=int.from_bytes(data[at:at + 8], "little"), codec="zstd", asbytes=True)
    return [raw[a:b].decode() for a, b in zip([0, *ends], ends)]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, ... of all runs, in order."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def split_blocks(docs: DataFrame, pattern: str, buckets: int, block_chars: int) -> DataFrame:
    """Rows (block, bucket, doc_id, words, codes): a text's word numbers (bucket null), or words of a bucket with their numbers."""
    exact = spelled_out(pattern)

    def rows(block: int, bucket, doc_id, words, codes) -> pa.RecordBatch:
        columns = [pa.array([block] * len(codes), pa.int64()), pa.array(bucket, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(words, pa.binary()), pa.array(codes, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "bucket", "doc_id", "words", "codes"])

    def flush(block: int, ids: list, texts: list[np.ndarray], numbers: dict[str, int]) -> Iterator[pa.RecordBatch]:
        uses = np.zeros(len(numbers), np.int64)
        for codes in texts:
            np.add.at(uses, codes, 1)
        rank = np.empty(len(numbers), np.uint32)
        rank[np.argsort(-uses, kind="stable")] = np.arange(len(numbers))  # frequent words get small numbers, which pack well
        yield rows(block, [None] * len(ids), ids, [None] * len(ids), [pack(rank[codes]) for codes in texts])
        of = defaultdict(lambda: ([], []))
        for word, code in zip(numbers, rank.tolist()):
            words, codes = of[zlib.crc32(word.encode()) % buckets]
            words.append(word)
            codes.append(code)
        yield rows(block, list(of), [None] * len(of), [pack_words(w) for w, _ in of.values()], [pack(np.array(c)) for _, c in of.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, block, chars = pre_tokenizer(pattern, exact), TaskContext.get().partitionId() << 32, 0
        ids, texts, numbers = [], [], defaultdict(count().__next__)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if chars and chars + len(text) > block_chars:
                    yield from flush(block, ids, texts, numbers)
                    ids, texts, numbers = [], [], defaultdict(count().__next__)
                    chars, block = 0, block + 1
                chars += len(text)
                found = tokens(text)
                ids.append(doc_id)
                texts.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
        yield from flush(block, ids, texts, numbers)

    return docs.select("doc_id", "text").mapInArrow(run, "block long, bucket int, doc_id long, words binary, codes binary")


def encode_words(words: DataFrame, ranks, parts: int) -> DataFrame:
    """(block, sizes, ids, codes): the ids of each block's words; every distinct word of a bucket is encoded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        bucket, known = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column(1)[row].as_py() != bucket:
                    bucket, known = batch.column(1)[row].as_py(), {}
                ids, sizes = [], []
                for word in unpack_words(batch.column(2)[row].as_py()):
                    if (got := known.get(word)) is None:
                        known[word] = got = encode(word)
                    sizes.append(len(got))
                    ids += got
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([pack(np.array(sizes))]), pa.array([pack(np.array(ids))]), batch.column(3).slice(row, 1)], ["block", "sizes", "ids", "codes"])

    dealt = words.select("block", "bucket", "words", "codes").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "block long, sizes binary, ids binary, codes binary")


def reassemble(texts: pa.Table, words: pa.Table) -> pa.Table:
    """The texts' ids by position, from the ids of the block's words."""
    sizes, ids, codes = ([unpack(x.as_py()) for x in words.column(c)] for c in ("sizes", "ids", "codes"))
    size, start = np.zeros((2, sum(map(len, codes))), np.int64)
    flat, at = np.concatenate([np.zeros(0, np.uint32), *ids]), 0
    for s, i, c in zip(sizes, ids, codes):
        size[c], start[c] = s, at + np.cumsum(s) - s
        at += len(i)
    out, n = [], []
    for row in texts.column("codes"):
        c = unpack(row.as_py())
        got = flat[spread(start[c], size[c])]
        out.append(got.astype("<u4").tobytes())
        n.append(len(got))
    return pa.table({"doc_id": texts.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids": pa.array(out, pa.binary())})


def bpe_encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids) for each row of ``docs``; ids: little-endian unsigned 32-bit numbers.

    Each match of ``pattern`` in the whole text is encoded separately, without
    special tokens. Null texts read as empty and have no tokens; null and
    repeated ids keep their rows; no rows give no rows; other columns of
    ``docs`` are not read. Memory of a task is bounded by one block and its
    words, or by one text if that is longer.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    split = shared_buckets(split_blocks(docs, pattern, 8 * parts, block_chars), "bpe", "block", parts)  # texts stay where they are
    words = encode_words(split.where("bucket is not null"), spark.sparkContext.broadcast(ranks), parts)
    texts = split.where("bucket is null").select("block", "doc_id", "codes")
    return texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(reassemble, "doc_id long, n_tokens long, ids binary")


def bpe_decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` with the bytes of its ids as ``decoded``; its columns doc_id, n_tokens and ids stay."""
    table: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = encoded.sparkSession.sparkContext.broadcast(table)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.fromiter(map(len, shared.value), np.int64, len(shared.value))
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(shared.value), np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [np.frombuffer(x or b"", "<u4") for x in part.column(2).to_pylist()]
                texts = [flat[spread(start[i], size[i])].tobytes() for i in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
