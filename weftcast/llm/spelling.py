"""Spelling variant grouping by a frequency-vector trie.

A word's vector is its length and its letter counts in groups of letters. The
trie's levels are the vector's entries: words with the same counts share a path.
An edit adds one letter to a group, takes one from a group, or both, so that the
words near a word lie on paths that a depth-first search reaches with a surplus
of one and a deficit of one to spend. Leaf words are verified.

The trie is cut into cells, subtrees of a bounded number of words: nodes that
hold more are cut at the next level. Above the cells the search is a join a
level, inside a cell it runs in one task, for all words that reach the cell at
once. Of two words near each other the one with the smaller vector is searched
for in the cell of the other, so that each pair is found once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftcast.session import broadcast_if_small, cut_lineage

from .common import shared_table, text_bytes

MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
DELETED = 31  # one run in so many loses a code point
GROUPS = 16
CELL_WORDS = 1 << 15
HELD = 200_000  # distinct words that a task counts before it passes the counts on
LEAF = 1 << 16  # pairs of words whose vectors are compared at once
WIDE = 32  # letters of a word that are compared as arrays
LETTERS = "[a-zÀ-ÿ]"  # of texts whose A-Z are lower-cased


# ------------------------------------------------------------------ words
def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the runs of letters of whole texts, A-Z lower-cased, damaged by crc32, that are long and frequent enough.

    h = crc32(doc_id:run); where DELETED divides h, the run loses its code point
    h % length. Counts are added up in the tasks first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts = re.compile(f"{LETTERS}{{{min_chars},}}").findall, Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(find(text.lower().decode())).items():
                    h = zlib.crc32(word.encode(), head)
                    if h % DELETED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < min_chars:
                            continue
                    counts[word] += n
                if len(counts) > HELD:
                    yield flush()
        yield flush()

    parts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[str]:
    """The letters of all words in ``groups`` groups of like weight: the more frequent first, each to the lightest group."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    made = [[0, i, ""] for i in range(groups)]
    for r in sorted(letters.collect(), key=lambda r: (-r["count"], r.letter)):  # at most the alphabet
        least = min(made)
        least[0] += r["count"]
        least[2] += r.letter
    return [letters for _, _, letters in made]


def with_paths(words: DataFrame, groups: list[str]) -> DataFrame:
    """``words`` with their path: length, then the count of each group's letters."""
    size = F.length("word")
    counts = [size - F.length(F.translate("word", g, "")) if g else F.lit(0) for g in groups]
    return words.select("word", "n", F.array(size, *counts).alias("path"))


# ------------------------------------------------------------------ cells
def cells_of(words: DataFrame, depth: int, cell_words: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes of more than ``cell_words`` words by level, and all cells (node, blocks).

    A cell is a node of no more words whose parent holds more, or a whole path
    of more words, which is cut into blocks.
    """
    heavy, cells = [], []
    held = words.agg(F.count(F.lit(1)).alias("count")).select(F.array().cast("array<int>").alias("node"), "count")
    for level in range(depth + 1):
        counts = cut_lineage(held)
        last = level == depth
        big = counts.where(F.col("count") > cell_words)
        cells.append((counts if last else counts.where(F.col("count") <= cell_words)).select("node", F.ceil(F.col("count") / cell_words).cast("int").alias("blocks")))
        if last or not big.take(1):
            break
        heavy.append(big.select("node"))
        inside = words.withColumn("node", F.slice("path", 1, level)).join(broadcast_if_small(heavy[-1]), "node", "left_semi") if level else words
        held = inside.groupBy(F.slice("path", 1, level + 1).alias("node")).count()
    out = cells[0]
    for c in cells[1:]:
        out = out.unionByName(c)
    return heavy, out


def visits(words: DataFrame, heavy: list[DataFrame], cells: DataFrame) -> DataFrame:
    """(node, block, word, n, home): each word in its own cell, and in those of greater vectors that the budget reaches.

    ``more`` is the surplus left, ``less`` the deficit left; the first entry
    that differs has to be greater, so a deficit is spent after a surplus only.
    """
    reached = words.select("word", "n", "path", F.array().cast("array<int>").alias("node"), F.lit(1).alias("more"), F.lit(1).alias("less"))
    all_reached = None
    for level, big in enumerate(heavy):
        inside = reached
        if level:  # the root is a cell only if nothing is cut
            marked = broadcast_if_small(big)
            outside, inside = reached.join(marked, "node", "left_anti"), reached.join(marked, "node", "left_semi")
            all_reached = outside if all_reached is None else all_reached.unionByName(outside)
        own = F.col("path")[level]
        if level == 0:  # the length: one more leaves one surplus and no deficit to the groups
            steps = [F.struct(own.alias("c"), F.lit(1).alias("more"), F.lit(1).alias("less")), F.struct((own + 1).alias("c"), F.lit(1).alias("more"), F.lit(0).alias("less"))]
        else:
            steps = [F.struct(own.alias("c"), F.col("more").alias("more"), F.col("less").alias("less")),
                     F.when(F.col("more") == 1, F.struct((own + 1).alias("c"), F.lit(0).alias("more"), F.col("less").alias("less"))),
                     F.when((F.col("more") == 0) & (F.col("less") == 1) & (own > 0), F.struct((own - 1).alias("c"), F.lit(0).alias("more"), F.lit(0).alias("less")))]
        step = F.explode(F.filter(F.array(*steps), lambda s: s.isNotNull())).alias("s")
        reached = inside.select("word", "n", "path", "node", step).select("word", "n", "path", F.concat("node", F.array("s.c")).alias("node"), F.col("s.more").alias("more"), F.col("s.less").alias("less"))
    all_reached = reached if all_reached is None else all_reached.unionByName(reached)
    met = all_reached.join(broadcast_if_small(cells), "node")
    mine = F.col("node") == F.slice("path", 1, F.size("node"))
    block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    # a word of a cell in blocks is searched for in the blocks after its own, a visitor in all
    first = F.when(mine, block).otherwise(F.lit(0))
    spread = met.select("node", "word", "n", F.when(mine, block).alias("own"), F.explode(F.sequence(first, F.col("blocks") - 1)).alias("block"))
    return spread.select("node", "block", "word", "n", F.col("own").eqNullSafe(F.col("block")).alias("home"))


# ------------------------------------------------------------------ search in a cell
def vectors(words: list[bytes], group_of: np.ndarray, groups: int) -> np.ndarray:
    """The words' letter counts by group."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    of = group_of[np.frombuffer(b"".join(words), np.uint8)]
    flat = np.bincount(np.repeat(np.arange(len(words)), sizes) * groups + of, minlength=len(words) * groups)
    return flat.reshape(-1, groups).astype(np.int32)


def one_edit(a: bytes, b: bytes) -> bool:
    """True if unlike words, ``a`` not longer than ``b``, differ by one inserted, deleted or replaced letter."""
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


class Cell:
    """A cell's words, as arrays: vectors, letters from the left and from the right, and a place for each in the order of vectors."""

    def __init__(self, words: list[bytes], home: np.ndarray, table: np.ndarray):
        self.words, self.home = words, home
        self.table = table.astype(np.int16 if table.max(initial=0) < 1 << 14 else np.int64)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.left, self.right = (np.frombuffer(b"".join(w[:WIDE].ljust(WIDE, b"\0") for w in ws), np.uint8).reshape(-1, WIDE) for ws in (words, [w[::-1] for w in words]))
        self.place = np.empty(len(words), np.int64)
        self.place[np.lexsort((*table.T[::-1], self.size))] = np.arange(len(words))

    def verified(self, q: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Which of the pairs are one edit apart: what they share from the left and from the right covers all but one letter.

        Of two home words, each found at the other's node, one order counts.
        """
        ok = ((q != h) & (~self.home[q] | (self.place[q] < self.place[h]))).nonzero()[0]
        a, b = q[ok], h[ok]
        shared = [np.where(e.all(axis=1), WIDE, e.argmin(axis=1)) for e in (self.left[a] == self.left[b], self.right[a] == self.right[b])]
        near = shared[0] + shared[1] + 1 >= self.size[b]
        for i in np.flatnonzero(self.size[b] > WIDE):  # longer than the arrays are wide
            near[i] = one_edit(self.words[a[i]], self.words[b[i]])
        return ok[near]


def near_by_parts(cell: Cell, homes: np.ndarray, others: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs (other, home) of one edit, through what is left of a word without one letter: linear in the words."""
    left: dict[tuple[int, bytes], list[int]] = {}
    for h in homes.tolist():
        w = cell.words[h]
        for i in range(len(w)):
            left.setdefault((i, w[:i] + w[i + 1:]), []).append(h)
    for q in others.tolist():
        w, found = cell.words[q], set()
        for i in range(len(w)):
            found.update(h for h in left.get((i, w[:i] + w[i + 1:]), ()) if cell.size[h] == len(w))
        for i in range(len(w) + 1):
            found.update(left.get((i, w), ()))
        at = np.array(sorted(found - {q}), np.int64)
        for h in at[cell.verified(np.full(len(at), q), at)].tolist():
            yield q, h


def search_cell(words: list[bytes], home: np.ndarray, table: np.ndarray, leaf: int = LEAF) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of near words, j of this cell and i with a smaller vector, or both of one vector.

    Depth-first over the trie of the cell's words, with all the words that
    reach a node at once and what each has left of surplus and deficit.
    """
    cell, groups = Cell(words, home, table), table.shape[1]
    at_home = np.flatnonzero(home)
    stack, held, pending = [], [], 0
    for length in np.unique(cell.size[at_home]).tolist():
        inside = at_home[cell.size[at_home] == length]
        same, shorter = np.flatnonzero(cell.size == length), np.flatnonzero(cell.size == length - 1)
        for reach, less in ((same, 1), (shorter, 0)):
            if len(reach):
                stack.append((0, inside, reach, np.ones(len(reach), np.int8), np.full(len(reach), less, np.int8)))
    while stack:
        level, inside, reach, more, less = stack.pop()
        if level == groups and len(inside) * len(reach) > leaf:
            if cell.size[inside[0]] <= WIDE:
                yield from near_by_parts(cell, inside, reach)
                continue
            rows = max(1, leaf // len(inside))
            for at in range(0, len(reach), rows):
                part = slice(at, at + rows)
                yield from pairs_of(cell, [alike(cell, level, inside, reach[part], more[part], less[part])])
        elif level == groups or len(inside) * len(reach) <= leaf:
            held.append(alike(cell, level, inside, reach, more, less))
            pending += len(held[-1][0])
            if pending > leaf:
                yield from pairs_of(cell, held)
                held, pending = [], 0
        else:
            counts, mine = cell.table[inside, level], cell.table[reach, level]
            for c in np.unique(counts).tolist():
                step = c - mine
                # spending a deficit needs the surplus spent before: the greater vector is the home word's
                ok = (step == 0) | ((step == 1) & (more == 1)) | ((step == -1) & (more == 0) & (less == 1))
                if ok.any():
                    s = step[ok]
                    stack.append((level + 1, inside[counts == c], reach[ok], more[ok] - (s == 1), less[ok] - (s == -1)))
    yield from pairs_of(cell, held)


def alike(cell: Cell, level: int, inside: np.ndarray, reach: np.ndarray, more: np.ndarray, less: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of ``reach``, of ``inside``) whose vectors below ``level`` are within what is left of the budget."""
    own, theirs = cell.table[inside, level:], cell.table[reach, level:]
    apart = np.zeros((len(reach), len(inside)), own.dtype)
    for g in range(own.shape[1]):
        apart += np.abs(own[None, :, g] - theirs[:, None, g])
    over = own.sum(axis=1)[None, :] - theirs.sum(axis=1)[:, None]  # surplus less deficit, where apart is their sum
    q, h = np.nonzero((apart + over <= 2 * more[:, None]) & (apart - over <= 2 * less[:, None]))
    return reach[q], inside[h]


def pairs_of(cell: Cell, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    if held:
        q, h = (np.concatenate(x) for x in zip(*held))
        near = cell.verified(q, h)
        yield from zip(q[near].tolist(), h[near].tolist())


def near_counts(found: DataFrame, groups: list[str], leaf: int = LEAF) -> DataFrame:
    """(word, n_near, best_n, best) in each cell of ``found`` (node, block, word, n, home): near words and the most frequent of them."""
    group_of = np.zeros(256, np.int64)
    for i, g in enumerate(groups):
        group_of[list(g.encode("latin-1"))] = i
    size = len(groups)

    def run(cell: pa.Table) -> pa.Table:
        home = np.array(cell.column("home").to_pylist(), bool)
        names, counts = cell.column("word").to_pylist(), cell.column("n").to_pylist()
        near: dict[int, list] = {}
        if home.any():
            words = [w.encode("latin-1") for w in names]  # one byte a letter
            for q, h in search_cell(words, home, vectors(words, group_of, size), leaf):
                for x, y in ((q, h), (h, q)):
                    got = near.setdefault(x, [0, 0, ""])
                    got[0] += 1
                    if (-counts[y], names[y]) < (-got[1], got[2]):
                        got[1:] = counts[y], names[y]
        rows = list(near.values())
        return pa.table({"word": pa.array([names[i] for i in near], pa.string()), "n_near": pa.array([r[0] for r in rows], pa.int64()), "best_n": pa.array([r[1] for r in rows], pa.int64()), "best": pa.array([r[2] for r in rows], pa.string())})

    return found.groupBy("node", "block").applyInArrow(run, "word string, n_near long, best_n long, best string")


def near_words(words: DataFrame, groups: int = GROUPS, cell_words: int = CELL_WORDS, leaf: int = LEAF) -> DataFrame:
    """(word, n_near, best_n, best) for each word of ``words`` (word, n) that is near another; best: largest n, ties by code points."""
    letters = letter_groups(words, groups)
    paths = with_paths(words, letters)
    heavy, cells = cells_of(paths, groups + 1, cell_words)
    parts = near_counts(visits(paths, heavy, cells), letters, leaf)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) from (word, form), by doubling the followed distance: enough for chains of ``steps`` forms."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(steps, 1))))):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = cut_lineage(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return at


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, groups: int = GROUPS, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the whole texts of ``docs`` (doc_id, text).

    Words are runs of letters A-Z, a-z and \\u00C0-\\u00FF, damaged as
    ``word_counts`` says, of at least ``min_chars`` code points and ``min_count``
    occurrences. A word's form is its most frequent near word (one edit away;
    ties: the smallest), if that is at least ``ratio`` times as frequent; root
    is the last form that forms lead to, the word itself if it has none; ``ratio``
    is above one, so that forms grow and end. Null
    texts have no words; a null id counts as an empty one; repeated rows count
    again; no words give no rows. Other columns of ``docs`` are not read.
    """
    words = shared_table(word_counts(docs, min_chars, min_count), "words")
    near = near_words(words, groups, cell_words)
    formed = (F.col("best_n") >= ratio * F.col("n"))
    known = shared_table(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "forms")
    most = known.agg(F.max("form_n")).first()[0] or 1
    last = roots(known.where("form is not null"), int(math.log(most) / math.log(ratio)) + 1)
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
