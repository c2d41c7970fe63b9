"""Conversation repair, spelling variants and line dedup against brute force, on fixtures and odd rows."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftcast.llm import line_dedup, queries, spelling, turn_repair
from weftcast.llm.oracles import ORACLE

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", ["op11_turn_repair", "op12_spelling", "op13_line_dedup"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    made = con.execute(ORACLE[name])
    columns = [d[0] for d in made.description]
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(str, found.select(*columns).collect())) == sorted(str(r) for r in spark_rows(columns, made.fetchall()))


def spark_rows(columns, rows):
    from pyspark.sql import Row
    return [Row(**dict(zip(columns, r))) for r in rows]


# ------------------------------------------------------------------ conversations
def plain_repair(rows):
    """Cost, audit and repaired lines of (initial, deleted, truncated, line) rows, by Dijkstra over (row, state)."""
    heap, done = [(0, "", 0, "E", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in "EA":
            return cost, audit, out
        after = "A" if state == "U" else "U"
        name = {"U": "user", "A": "assistant"}[after]
        heapq.heappush(heap, (cost + 2, audit + "I", i, after, (*out, f"{name}:")))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if not gone:
                if role[:1] == after.lower():
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, after, (*out, f"{role}:{text}")))
                if role[:1] == "s" and state == "E":
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, "S", (*out, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, after, (*out, f"{name}:{text}")))


def plain_report(rows):
    """The report of (turn, role, text) rows in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        left = text.strip(SPACE)
        faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, lines = plain_repair([(r, t, f in ("blank", "duplicate"), f == "truncated") for (_, r, t), f in zip(rows, faults)])
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def search_edits(rows):
    search, nodes, most = turn_repair.Search(), [], 0
    for role, _, gone, cut in rows:
        nodes += search.step(role[:1], gone, cut)
        most = max(most, tree_size(search))
    cost, _, ends, rest = search.close()
    return cost, "".join("I" * n.inserts + n.edit for n in [*nodes, *rest]) + "I" * ends, most


def tree_size(search):
    nodes, stack = 0, [search.root]
    while stack:
        node = stack.pop()
        nodes += 1
        stack += node.children
        assert node.refs == len(node.children) + sum(n is node for _, _, n in search.alive.values())
    return nodes


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool"]), st.just("x"), st.booleans(), st.booleans()), max_size=14))
def test_search_is_the_cheapest_and_least(rows):
    cost, audit, _ = plain_repair(rows)
    assert search_edits(rows)[:2] == (cost, audit)


def test_search_forgets_what_is_certain():
    rng = random.Random(3)
    rows = [(r, "x", rng.random() < 0.1, rng.random() < 0.1) for r in ["user", "assistant"] * 3000]
    assert search_edits(rows)[2] < 60


ODD_TURNS = [
    (1, 0, "user", "Hello there."), (1, 1, "assistant", "Yes!"),
    (2, None, None, None), (2, None, "user", "no turn"), (2, 3, "assistant", "late."),
    (3, 5, "user", "same."), (3, 5, "user", "same."), (3, 5, "assistant", "other?"),
    (None, 0, "system", "s."), (None, 1, "user", "no id."), (None, 2, "assistant", "ok."),
    (5, None, "assistant", "only nulls"), (5, None, "", " \x0b "),
    (6, 0, "user", "a  "), (6, 9, "usher", "long " * 40_000),
    (7, 0, "system", "s."), (7, 1, "system", "t."),
]


def test_odd_conversations(spark):
    given = spark.createDataFrame(ODD_TURNS, TURNS).selectExpr("*", "'x' as audit", "1 as pos", "2 as fault")
    got = {r.conv_id: r.asDict() for r in turn_repair.repair_conversations(given).collect()}
    rows = defaultdict(list)
    for c, turn, role, text in ODD_TURNS:
        rows[c].append((turn, " " if role is None else role, " " if text is None else text))
    for c, listed in rows.items():
        listed.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        assert {k: v for k, v in got[c].items() if k != "conv_id"} == plain_report(listed), c
    assert len(got) == len(rows)
    empty = spark.createDataFrame([], TURNS)
    assert turn_repair.repair_conversations(empty).count() == 0 and turn_repair.repair_damaged(empty).count() == 0


def test_every_original_conversation_is_returned(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row, = turn_repair.repair_damaged(spark.createDataFrame([(dropped, 0, "user", "x.")], TURNS)).collect()
    assert row.asDict() == {"conv_id": dropped, **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def test_one_conversation_over_many_batches(spark):
    rng = random.Random(5)
    turns = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice([f"text {i}.", f"text {i}", "", "again."])) for i in range(5000)]
    got = turn_repair.repair_conversations(spark.createDataFrame(turns, TURNS)).first().asDict()
    assert {k: v for k, v in got.items() if k != "conv_id"} == plain_report([t[1:] for t in turns])


# ------------------------------------------------------------------ spelling
def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w if h % 31 else w[:h % len(w)] + w[h % len(w) + 1:]] += 1
    return {w: m for w, m in n.items() if len(w) >= 7 and m >= 2}


def plain_variants(n):
    near = {w: set() for w in n}
    for a, b in itertools.combinations(sorted(n, key=len), 2):
        if len(b) - len(a) <= 1 and any(b[:i] + b[i + 1:] in (a, a[:i] + a[i + 1:] if len(a) == len(b) else a) for i in range(len(b))):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def spelled(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.fixture(scope="module")
def variants():
    """Words of few letters, so that many are near each other and many share a vector, with counts of three orders."""
    rng = random.Random(1)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([7, 8, 9, 40]))) for _ in range(160)} | {"ab" * i + "ba" + "ab" * (30 - i) for i in range(8)} | {"x" * i + "y" + "x" * (39 - i) for i in range(9)} | {"x" * 38 + "y"} | {"wordlike", "wordlikes", "wordliek", "vordlike", "ordlike"}
    return [(i, " ".join([w] * rng.choice([1, 2, 3, 30, 400]))) for i, w in enumerate(sorted(words))]


@pytest.mark.parametrize("cell_words, leaf", [(1 << 16, 1 << 16), (40, 16), (3, 4)])
def test_variants_equal_brute_force(spark, docs_of, variants, cell_words, leaf):
    words = spelling.word_counts(docs_of(variants))
    n = plain_words(variants)
    assert {r.word: r.n for r in words.collect()} == n
    near = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(words, cell_words=cell_words, leaf=leaf).collect()}
    want = plain_variants(n)
    assert {w: v[0] for w, v in near.items()} == {w: v[3] for w, v in want.items() if v[3]}
    assert spelled(spelling.spelling_variants(docs_of(variants), cell_words=cell_words)) == want


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = spelled(queries.op12_spelling(spark, SF))
    n = plain_words(rows)
    assert {w: v[2] for w, v in got.items()} == n
    for w, (form, _, m, _, form_n) in got.items():
        assert form is None or (n[form] == form_n >= 10 * m and spelling.one_edit(*sorted((w.encode("latin-1"), form.encode("latin-1")), key=len)))


def test_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)], "word string, form string")
    assert {r.root for r in spelling.roots(forms, 11).collect()} == {"w11"}


def test_odd_words(spark, docs_of):
    rows = [(1, None), (2, ""), (None, "somewords somewords"), (3, "somewords SOMEWORDS someWordz"), (3, "somewords SOMEWORDS someWordz"), (4, "Été×÷ÿééé " * 2), (5, "a" * 200_000 + " " + "a" * 200_000 + " " + "a" * 199_999 + " " + "a" * 199_999)]
    given = docs_of(rows).selectExpr("*", "1 as word", "2 as n", "3 as path", "4 as node")
    assert spelled(spelling.spelling_variants(given)) == plain_variants(plain_words(rows))
    assert spelling.spelling_variants(docs_of([])).count() == 0


# ------------------------------------------------------------------ lines
def plain_lines(rows, corpus=None):
    key = lambda x: x.strip(SPACE).translate({i: i + 32 for i in range(65, 91)})
    held = defaultdict(set)
    for doc_id, text in rows if corpus is None else corpus:
        for x in (text or "").split("\n"):
            held[key(x)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        top = lambda x: max(held[key(x)], key=lambda d: (d is not None, d or 0))
        kept = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or doc_id == top(x)]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=str)


LINE = "this line is found in a number of documents"
ODD_LINES = [
    (1, None), (2, ""), (3, f"{LINE}\n\x0b {LINE.upper()} \x0c\n short\n"), (4, f"one\n{LINE}\ntwo"), (4, f"one\n{LINE}\ntwo"), (4, f"{LINE} \n{LINE}"),
    (9, f"{LINE}\n{LINE}\nlast"), (None, f"{LINE}\nno id"), (None, f"{LINE}\nno id again"),
    (5, "é" * 19 + "\n" + "é" * 20), (6, "é" * 19 + "\n" + "é" * 20), (7, "é" * 19 + "\n" + "é" * 20), (8, "É" * 20),
    (10, "\n".join(f"line number {i} of a very long text" for i in range(50_000))), (11, "line number 7 of a very long text"), (12, " line number 7 of a very long text"),
]


def test_odd_lines(spark, docs_of):
    given = docs_of(ODD_LINES).selectExpr("*", "1 as h", "'k' as key", "map('a', 1) as drops", "2 as id")
    assert line_rows(line_dedup.dedup_lines(given)) == plain_lines(ODD_LINES)
    assert line_dedup.dedup_lines(docs_of([])).count() == 0


def test_insertions_and_deletions_are_reversible(spark, docs_of):
    rng = random.Random(2)
    text = lambda: "\n".join(f"shared line of the corpus, number {int(rng.paretovariate(0.6)) % 90}" for _ in range(rng.randint(1, 12)))
    rows = [(i, text()) for i in range(60)]
    first, second, gone = rows[:30], rows[30:], rows[10:45]
    index = line_dedup.build_index(docs_of(first), shards=4)
    start = common_of(index)
    index = line_dedup.insert_documents(index, docs_of(second))
    assert common_of(index) == common_of(line_dedup.build_index(docs_of(rows), shards=4))
    assert line_rows(line_dedup.dedup_lines(docs_of(rows), index)) == plain_lines(rows)
    index = line_dedup.delete_documents(index, docs_of(gone))
    left = [r for r in rows if r not in gone]
    assert line_rows(line_dedup.dedup_lines(docs_of(left), index)) == plain_lines(left)
    index = line_dedup.insert_documents(line_dedup.delete_documents(index, docs_of(rows[45:])), docs_of(rows[10:30]))
    assert common_of(index) == start
    for f in index.filters.collect():
        keys = [bytes(r.key) for r in index.common.where(f"shard = {f.shard}").collect()]
        cuckoo = line_dedup.unpacked(f.cuckoo)
        assert f.n == len(keys) == np.count_nonzero(cuckoo.table) and cuckoo.holds(keys).all()


def common_of(index):
    return sorted((bytes(r.key), r.docs, r.top) for r in index.common.collect())


def test_repeated_rows_are_counted_by_reference(spark, docs_of):
    rows = [(1, LINE), (1, LINE), (2, LINE), (3, LINE)]
    index = line_dedup.build_index(docs_of(rows))
    index = line_dedup.delete_documents(index, docs_of(rows[:1]))
    assert [r.docs for r in index.common.collect()] == [3]
    assert line_dedup.delete_documents(index, docs_of(rows[:1])).common.count() == 0


def test_filters_beyond_the_bound_change_nothing(spark, docs_of, monkeypatch):
    want = line_rows(line_dedup.dedup_lines(docs_of(ODD_LINES)))
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 0)
    assert line_rows(line_dedup.dedup_lines(docs_of(ODD_LINES))) == want


def test_cuckoo_filter():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(30_000)]
    cuckoo = line_dedup.Cuckoo.of(keys[:20_000])
    assert cuckoo.holds(keys[:20_000]).all() and cuckoo.holds(keys[20_000:]).mean() < 0.01
    cuckoo.remove(keys[:15_000])
    assert cuckoo.holds(keys[15_000:20_000]).all() and np.count_nonzero(cuckoo.table) == 5_000
    full = line_dedup.Cuckoo.sized(4)
    assert not full.insert(keys[:50])
    moved = [keys[0]] * 9  # nine equal fingerprints don't fit two buckets of any size
    assert not line_dedup.Cuckoo.sized(1000).insert(moved)
