"""Accumulators that tasks fill and that are merged afterwards.

``centred_moments`` gives count, means and centred cross products of many
columns by group (#68-#71).  Each task measures its rows batch by batch around
their own mean and merges the parts pairwise, so that no sum of squares of raw
values is ever formed: a column with a mean of 1e9 keeps its variance.  A group
leaves a task as one row of arrays, however many columns there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

HELD_BYTES = 128 << 20  # what a task holds of its groups before it hands them on
SHARES = 64  # parts that the rows of a group are merged to before they meet in one task


def group_codes(batch: pa.RecordBatch, names: list[str]) -> tuple[list[tuple], np.ndarray]:
    """The distinct keys of a batch, nulls being a key of their own, and the place of each row's key among them."""
    code = np.zeros(batch.num_rows, np.int64)
    for name in names:
        column = batch.column(name).dictionary_encode(null_encoding="encode")
        found, place = np.unique(code * max(1, len(column.dictionary)) + column.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        code = place.astype(np.int64)
    _, first, place = np.unique(code, return_index=True, return_inverse=True)
    return list(zip(*[batch.column(n).take(pa.array(first)).to_pylist() for n in names])), place


def accumulated(batches: Iterator[pa.RecordBatch], names: list[str], measure: Callable, merge: Callable, width: int) -> Iterator[tuple[list[tuple], list, list[pa.DataType]]]:
    """(keys, states, types of the keys) of a task's groups, whenever ``HELD_BYTES`` are held and at the end.

    ``measure`` makes a state of the rows of one group in a batch, ``merge`` one of two; a state holds ``width`` numbers.
    """
    held: dict[tuple, object] = {}
    types: list[pa.DataType] = []
    for batch in batches:
        types = [batch.schema.field(n).type for n in names]
        keys, place = group_codes(batch, names)
        rows = np.split(np.argsort(place, kind="stable"), np.cumsum(np.bincount(place, minlength=len(keys)))[:-1]) if keys else []
        for key, at in zip(keys, rows):
            state = measure(batch, at)
            held[key] = merge(held[key], state) if key in held else state
        if len(held) * width * 8 > HELD_BYTES:
            yield list(held), list(held.values()), types
            held = {}
    if held:
        yield list(held), list(held.values()), types


def key_arrays(keys: list[tuple], types: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array([k[i] for k in keys], t) for i, t in enumerate(types)]


def float_rows(states: list[np.ndarray]) -> pa.Array:
    """One list of doubles for each state."""
    ends = np.cumsum([0] + [s.size for s in states]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([s.ravel() for s in states])))


# --------------------------------------------------------------------------- #
# centred moments
# --------------------------------------------------------------------------- #
def measured(x: np.ndarray) -> np.ndarray:
    """[n, means, centred cross products] of rows x columns, flat.

    Rows are taken less the first one, then less their mean: a constant column
    has moments of exactly zero.
    """
    first = x[0]
    y = x - first
    mean = y.mean(axis=0)
    y -= mean
    return np.concatenate(([float(len(x))], first + mean, (y.T @ y).ravel()))


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The moments of the rows of both."""
    q = moment_columns(a)
    n = a[0] + b[0]
    step = b[1:q + 1] - a[1:q + 1]
    cross = a[q + 1:] + b[q + 1:] + (np.outer(step, step) * (a[0] * b[0] / n)).ravel()
    return np.concatenate(([n], a[1:q + 1] + step * (b[0] / n), cross))


def moment_columns(state: np.ndarray) -> int:
    """How many columns a state is of: its size is 1 + q + q * q."""
    return int((np.sqrt(4.0 * state.size - 3.0) - 1.0) / 2.0 + 0.5)


def centred_moments(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """One row for each key: (keys..., moments), [n, means, centred cross products] of ``cols``.

    Rows with a null or NaN in any of ``cols`` are left out; a key without any
    other row has no moments.  A group that lies in many tasks is merged in
    ``SHARES`` parts first.
    """
    q = len(cols)
    some = F.lit(True)
    for c in cols:
        some = some & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = df.where(some).select(*keys, F.array(*[F.col(c).cast("double") for c in cols]).alias("moments"))
    schema = StructType([*[df.schema[k] for k in keys], StructField("moments", ArrayType(DoubleType()))])
    width = 1 + q + q * q

    def values(batch: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
        return batch.column("moments").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)

    def fold(batch: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
        parts = values(batch, at)
        total = parts[0]
        for part in parts[1:]:
            total = merged(total, part)
        return total

    def combined(measure: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found, states, types in accumulated(batches, keys, measure, merged, width):
                yield pa.RecordBatch.from_arrays([*key_arrays(found, types), float_rows(states)], [*keys, "moments"])
        return run

    def last(parts: pa.Table) -> pa.Table:
        batch = parts.combine_chunks().to_batches()[0]
        return pa.table([*[batch.column(k).slice(0, 1) for k in keys], float_rows([fold(batch, np.arange(batch.num_rows))])], names=[*keys, "moments"])

    parts = rows.mapInArrow(combined(lambda batch, at: measured(values(batch, at))), schema)
    parts = parts.select("*", F.pmod(F.spark_partition_id(), F.lit(SHARES)).alias("share")).repartition(*keys, "share")
    return parts.mapInArrow(combined(fold), schema).groupBy(*keys).applyInArrow(last, schema)
