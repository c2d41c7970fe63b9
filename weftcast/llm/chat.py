"""Chat formatting by columnar byte assembly.

Turns are dealt by ranges of (conversation, turn), so that a very long
conversation is spread over tasks; each batch is assembled at once: lengths of
all headers, contents and footers, cumulative offsets, scatter indices, and one
preallocated Arrow buffer that all bytes are copied into.

Template of a turn: ``<|im_start|>`` role newline text ``<|im_end|>`` newline.
Inside roles and texts a backslash and each control string get a backslash in
front, and a newline in a role becomes backslash n; this is reversible, and no
control string is left inside a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = [START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
ESCAPED = r"(\\|" + "|".join(re.escape(c) for c in CONTROL) + ")"
TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!\|im_end\|>))*)" + re.escape(END) + "\n", re.S)
ROWS = 4096  # turns assembled into one buffer
SEGMENTS = "conv_id long, first_turn long, part int, formatted binary, mask array<long>, turns long"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, ESCAPED, r"\\\1")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array without nulls."""
    texts = pc.cast(texts, pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def place(out: np.ndarray, at: np.ndarray, starts: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> None:
    """Copy the runs data[starts[i] : starts[i] + sizes[i]] to out[at[i] ...] by scatter indices."""
    ends = np.cumsum(sizes)
    step = np.arange(ends[-1] if len(ends) else 0)
    begin = ends - sizes
    out[np.repeat(at - begin, sizes) + step] = data[np.repeat(starts - begin, sizes) + step]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all turns; the turns' ends, and the begin and end of each text in it."""
    start, text = utf8(escape(texts))
    role_start, role = utf8(pc.replace_substring(escape(roles), "\n", r"\n"))
    sizes = [np.full(len(texts), len(START)), np.diff(role_start), np.ones(len(texts), np.int64), np.diff(start), np.full(len(texts), len(END) + 1)]
    ends = np.cumsum(np.stack(sizes, axis=1).ravel()).reshape(-1, 5)
    begins = ends - np.stack(sizes, axis=1)
    buffer = pa.allocate_buffer(int(ends[-1, -1]) if len(ends) else 0)
    out = np.frombuffer(buffer, np.uint8)
    zero = np.zeros(len(texts), np.int64)
    fixed = np.frombuffer(f"{START}\n{END}\n".encode(), np.uint8)
    place(out, begins[:, 0], zero, sizes[0], fixed)
    place(out, begins[:, 1], role_start[:-1], sizes[1], role)
    place(out, begins[:, 2], zero + len(START), sizes[2], fixed)
    place(out, begins[:, 3], start[:-1], sizes[3], text)
    place(out, begins[:, 4], zero + len(START) + 1, sizes[4], fixed)
    return buffer, ends[:, 4], begins[:, 3], ends[:, 3]


def format_chats(turns: DataFrame, learn_role: str = "assistant", rows: int = ROWS) -> DataFrame:
    """Segments (conv_id, first_turn, part, formatted, mask, turns) of the formatted conversations.

    Joined by (first_turn, part), the segments of a conversation are its whole
    formatted text in order of turn, then role and text. mask lists begin and
    end bytes, in the segment, of each text of ``learn_role``. Null roles and
    texts read as empty; null turns come first; repeated rows are turns of their
    own; rows without conv_id are one conversation, null; no rows give no
    segments. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                conv, turn, role, text = batch.columns
                buffer, ends, begin, end = assemble(role, text)
                ids, known = pc.fill_null(conv, 0).to_numpy(), conv.is_valid().to_numpy(zero_copy_only=False)
                first = np.concatenate(([True], (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])))
                head = np.nonzero(first)[0]
                tail = np.append(head[1:], len(ids))
                offsets = np.concatenate(([0], ends[tail - 1])).astype(np.int64)
                formatted = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(offsets), buffer]).cast(pa.binary())
                learn = pc.equal(role, learn_role).to_numpy(zero_copy_only=False)
                spans = [np.stack([begin[a:b][learn[a:b]] - o, end[a:b][learn[a:b]] - o], axis=1).ravel() for a, b, o in zip(head, tail, offsets)]
                take = pa.array(head)
                yield pa.RecordBatch.from_arrays([conv.take(take), turn.take(take), pa.array(np.arange(part, part + len(head)), pa.int32()), formatted, pa.array(spans, pa.list_(pa.int64())), pa.array(tail - head)], ["conv_id", "first_turn", "part", "formatted", "mask", "turns"])
                part += len(head)

    ordered = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = ordered.repartitionByRange(shuffle_partitions(turns.sparkSession), "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, SEGMENTS)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from formatted text."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a formatted turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation what the formatted segments hold: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    Segments of a conversation are streamed in order through running digests,
    one segment in memory at a time. A digest needs its conversation's bytes in
    order, so one conversation is one task's work here; counts and texts are
    not kept.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []

        def close() -> None:
            if state is not None:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, data, mask in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                raw = data.as_py()
                formatted = raw.decode()
                turns = parse(formatted)
                state[1] += len(turns)
                state[2].update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                state[5] += len(formatted)
                for a, b in zip(mask[::2], mask[1::2]):
                    text = unescape(raw[a:b].decode())
                    state[3] += len(text)
                    state[4].update(text.encode())
            if done:
                yield out()
                done = []
        close()
        yield out()

    dealt = segments.repartition(shuffle_partitions(segments.sparkSession), "conv_id").sortWithinPartitions("conv_id", "first_turn", "part")
    return dealt.select("conv_id", "formatted", "mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
