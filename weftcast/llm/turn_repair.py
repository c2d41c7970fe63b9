"""Conversation structure repair by a survivor-coalescence Viterbi search.

The rows of a conversation are read in order by an automaton of four states:
E (nothing kept), S (a system row kept), U (a user row last), A (an assistant
row last); E and A may end. Each row is kept, given another role or deleted, and
empty user and assistant rows may be inserted anywhere. For each state the
cheapest edits that lead to it survive, the ASCII-least of equally cheap ones.

Survivors are leaves of a backpointer tree whose nodes count the references to
them. A node that nothing refers to goes, and with it what only it referred to;
once all survivors share an ancestor, the edits up to it are certain and are
emitted. A task so holds the unresolved edits of one conversation, never its
texts: those meet their edits in a second pass.

Two survivors have read the same rows and each of their edit strings ends with
a row's edit, so neither is the beginning of the other: the order of their
complete unresolved suffixes is fixed when they part, and a rank that is renewed
with every row stands for the comparison of the whole suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table, shuffle_partitions

SPACE = " \t\n\x0b\x0c\r"
DELETE, CHANGE, INSERT, TRUNCATED = 3, 2, 2, 1  # costs; keeping is free
#: What a state becomes by its own next role: inserts walk along it.
NEXT = {"E": "U", "S": "U", "U": "A", "A": "U"}
ROLE = {"U": "user", "A": "assistant"}
#: How much dearer the rest of a conversation can be from the second state than from the first.
EXCESS = {
    "E": {"S": 4, "U": 5, "A": 3},
    "S": {"E": 0, "U": 2, "A": 0},
    "U": {"E": 2, "S": 2, "A": 2},
    "A": {"E": 0, "S": 4, "U": 2},
}
ENDS = {"E": 0, "A": 0, "U": 1, "S": 2}  # inserts that a state needs to end


class Node:
    """A row's edit after the edits of ``parent``: ``inserts`` inserted rows from state ``before``, then ``edit`` to state ``after``."""

    __slots__ = ("parent", "before", "inserts", "edit", "after", "refs", "children")

    def __init__(self, parent: Node | None, before: str, inserts: int, edit: str, after: str):
        self.parent, self.before, self.inserts, self.edit, self.after = parent, before, inserts, edit, after
        self.refs, self.children = 1, []  # the survivor itself, then one for each child
        if parent is not None:
            parent.refs += 1
            parent.children.append(self)

    def release(self) -> None:
        node = self
        while node is not None:
            node.refs -= 1
            if node.refs or node.parent is None:
                return
            node.parent.children.remove(node)
            node = node.parent


def inserted(state: str, n: int) -> tuple[list[str], str]:
    """Roles of ``n`` inserted rows, and the state after them."""
    roles = []
    for _ in range(n):
        state = NEXT[state]
        roles.append(ROLE[state])
    return roles, state


class Search:
    """The search over one conversation's rows; ``step`` and ``close`` yield the edits that became certain."""

    def __init__(self):
        self.root = Node(None, "E", 0, "", "E")
        self.alive = {"E": (0, 0, self.root)}  # state -> cost, rank, node

    def step(self, initial: str, deleted: bool, truncated: bool) -> Iterator[Node]:
        """Read a row: its role's initial, whether it has to go, and whether keeping it costs more."""
        best: dict[str, tuple] = {}

        def offer(after: str, cost: int, rank: int, inserts: int, edit: str, before: str, node: Node) -> None:
            key = (cost, rank, "I" * inserts + edit)
            if after not in best or key < best[after][0]:
                best[after] = (key, inserts, edit, before, node)

        extra = TRUNCATED if truncated else 0
        for before, (cost, rank, node) in self.alive.items():
            state = before
            for inserts in range(3):
                if inserts:
                    state = NEXT[state]
                paid = cost + INSERT * inserts
                offer(state, paid + DELETE, rank, inserts, "D", before, node)
                if not deleted:
                    after = NEXT[state]
                    if initial == after.lower():
                        offer(after, paid + extra, rank, inserts, "K", before, node)
                    if initial == "s" and state == "E":
                        offer("S", paid + extra, rank, inserts, "K", before, node)
                    offer(after, paid + CHANGE + extra, rank, inserts, "R", before, node)
        # ranks by the whole strings: of different survivors by theirs, of the same by what is added
        order = {state: i for i, state in enumerate(sorted(best, key=lambda s: best[s][0][1:]))}
        found = {s: (best[s][0][0], order[s]) for s in best}
        kept = [s for s in found if not any(found[s] > (found[o][0] + EXCESS[s][o], found[o][1]) for o in found if o != s)]
        old = [node for _, _, node in self.alive.values()]
        self.alive = {s: (*found[s], Node(best[s][4], best[s][3], *best[s][1:3], s)) for s in kept}
        for node in old:
            node.release()
        while self.root.refs == 1 and self.root.children:
            child, = self.root.children
            child.parent, self.root = None, child
            yield child

    def close(self) -> tuple[int, str, int, list[Node]]:
        """Cost, the last state, the inserts that end it, and the edits not emitted yet."""
        _, _, _, state = min((cost + INSERT * ENDS[s], rank, "I" * ENDS[s], s) for s, (cost, rank, _) in self.alive.items())
        cost, _, node = self.alive[state]
        rest = []
        while node is not self.root:
            rest.append(node)
            node = node.parent
        return cost + INSERT * ENDS[state], state, ENDS[state], rest[::-1]


def fault_rows(turns: DataFrame, *tie: str) -> DataFrame:
    """Rows (conv_id, pos, turn, role, text, initial, fault, illegal) of each conversation in order.

    pos counts from 1 by turn (nulls first), then role, text and ``tie``. fault is
    the row's first of blank, duplicate and truncated, else null; illegal: the
    initials of the row before and of this one are neither su, ua nor au. Null
    roles and texts read as one space.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", "turn", space("role"), space("text"), *tie)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", *tie)
    same = Window.partitionBy("conv_id", "role", "digest").orderBy("pos")
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    rows = rows.select("*", F.row_number().over(order).cast("long").alias("pos"), F.left("role", F.lit(1)).alias("initial"), F.lag(F.left("role", F.lit(1))).over(order).alias("previous"))
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("copy", F.row_number().over(same))
    fault = F.when(last == "", "blank").when(F.col("copy") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    illegal = F.col("previous").isNotNull() & ~F.concat("previous", "initial").isin("su", "ua", "au")
    return rows.select("conv_id", "pos", "turn", "role", "text", "initial", fault.alias("fault"), illegal.alias("illegal"))


EDITS = "conv_id long, pos long, inserts array<string>, edit string, new_role string, cost long"


def plan_edits(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, inserts, edit, new_role, cost) of the cheapest repair of ``fault_rows``, ASCII-least of ties.

    One row for each row: roles inserted before it, its edit (K, R or D) and the
    role that R gives it. A last row of each conversation, with edit null and the
    pos after the last, has the inserts at the end and the cost of the repair.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, search, pos, read, out = None, None, 0, 0, []

        def emit(nodes) -> None:
            nonlocal pos
            for node in nodes:
                pos += 1
                out.append((conv, pos, inserted(node.before, node.inserts)[0], node.edit, ROLE[node.after] if node.edit == "R" else None, None))

        def close() -> None:
            if search is not None:
                cost, state, ends, rest = search.close()
                emit(rest)
                out.append((conv, read + 1, inserted(state, ends)[0], None, None, cost))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "pos", "inserts", "edit", "new_role", "cost"])
            out.clear()
            return made

        for batch in batches:
            for at, initial, fault in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2))):
                if search is None or at != conv:
                    close()
                    conv, search, pos, read = at, Search(), 0, 0
                read += 1
                emit(search.step(initial, fault in ("blank", "duplicate"), fault == "truncated"))
            yield batch_of()
        close()
        yield batch_of()

    dealt = rows.select("conv_id", "pos", "initial", "fault").repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "pos")
    return dealt.select("conv_id", "initial", "fault").mapInArrow(run, EDITS)


def apply_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): each conversation's edits in order, with the repaired rows.

    edit is K, R, I or D; a D has null role and text and is no row of the repaired
    conversation. Conversations are whole and in order inside a partition.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, planned, first = None, 0, None, True
        for batch in batches:
            out = []
            for at, kind, inserts, edit, new_role, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if first or at != conv:
                    conv, place, first = at, 0, False
                if kind == 0:
                    planned = (edit, new_role)
                    made = [("I", r, "") for r in inserts]
                elif planned[0] == "D":
                    made = [("D", None, None)]
                else:
                    made = [(planned[0], planned[1] or role, text)]
                for one in made:
                    place += 1
                    out.append((conv, place, *one))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "place", "edit", "role", "text"])

    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    plan = edits.select("conv_id", "pos", F.lit(0).alias("kind"), "inserts", "edit", "new_role", null("string", "role"), null("string", "text"))
    given = rows.select("conv_id", "pos", F.lit(1).alias("kind"), null("array<string>", "inserts"), null("string", "edit"), null("string", "new_role"), "role", "text")
    dealt = plan.unionByName(given).repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "pos", "kind")
    return dealt.drop("pos").mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) of ``apply_edits``: rows are streamed through the digest, only the audit is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, done = None, None, []

        def close() -> None:
            if state is not None:
                done.append((conv, "".join(state[0]), state[1].hexdigest()))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * 3
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.string(), pa.string()])], ["conv_id", "audit", "repaired_sha256"])
            done.clear()
            return made

        for batch in batches:
            for at, edit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or at != conv:
                    close()
                    conv, state = at, ([], hashlib.sha256(), [])
                state[0].append(edit)
                if edit != "D":
                    state[1].update(f"{chr(10) if state[2] else ''}{role}:{text}".encode())
                    state[2][:] = [True]
            yield batch_of()
        close()
        yield batch_of()

    return repaired.select("conv_id", "edit", "role", "text").mapInArrow(run, "conv_id long, audit string, repaired_sha256 string")


def repair_conversations(turns: DataFrame, *tie: str) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of ``turns``.

    Rows are taken by turn (nulls first), then role, text and ``tie``. Null roles
    and texts read as one space; rows without conv_id are one conversation, null;
    repeated rows are duplicates and go; a conversation of null turns has no gaps;
    no rows give no rows. Other columns are not read. A conversation's edits
    depend on one another, so one conversation is one task's work; its memory
    is that of its unresolved edits, not of its texts.
    """
    rows = shared_table(fault_rows(turns, *tie), "turns")
    edits = shared_table(plan_edits(rows), "edits")
    of = lambda kind: F.count_if(F.col("fault") == kind).alias(kind)
    wide = F.col("turn").cast("decimal(20,0)")
    gaps = F.coalesce((F.max(wide) - F.min(wide) + 1 - F.count_distinct("turn")).cast("long"), F.lit(0))
    counts = rows.groupBy("conv_id").agg(gaps.alias("gaps"), of("blank"), of("duplicate"), of("truncated"), F.count_if("illegal").alias("illegal"))
    found = edits.where("edit is null").select("conv_id", "cost").alias("e")
    out = on_conversation(counts, found)
    return on_conversation(out, digests(apply_edits(rows, edits)))


def on_conversation(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` with the other columns of ``b``; null ids meet."""
    return a.join(b.withColumnRenamed("conv_id", "other"), F.col("conv_id").eqNullSafe(F.col("other")), "left").drop("other")


def damage(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copy) damaged by crc32(conv_id:turn) % 20: dropped, emptied, cut, repeated or given role user."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", of("role").alias("role"), of("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role: Column = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def repair_damaged(turns: DataFrame) -> DataFrame:
    """``repair_conversations`` of the damaged rows, for every conversation of ``turns``: zeros where no row is left."""
    out = on_conversation(turns.select("conv_id").distinct(), repair_conversations(damage(turns), "copy"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
