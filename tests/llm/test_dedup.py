"""Near-duplicates and benchmark passages against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftcast.llm import common, cover_tree, decontam, queries, simhash

SF = "/root/testdata/sf0.01"


def groups(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_classes(rows):
    """component_id of each (doc_id, fingerprint), by all pairs."""
    fp = np.array([f for _, f in rows], np.uint64)
    near = [(i, i + 1 + int(j)) for i in range(len(fp)) for j in np.nonzero(np.bitwise_count(fp[i + 1:] ^ fp[i]) <= 2)[0]]
    least = {}
    for (doc, _), g in zip(rows, (root := groups(len(rows), near))):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    return [least.get(g) for g in root]


def test_simhash_matches_all_pairs(spark, docs_of):
    base = "one two three four five six seven eight nine ten"
    odd = [(-1, None), (-2, ""), (-3, " \t\n"), (-4, "Word"), (-5, "WORD"), (-5, "two words"), (None, "no id at all here"), (None, base), (-6, base.upper()), (-7, "É é É"), (-8, "\x0b".join(base.split())), (-9, "long " * 70_000)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(docs_of(odd)).withColumns({"fp": F.lit(1), "component_id": F.lit(2)})
    got = simhash.simhash_near_duplicates(docs).collect()
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    want = sorted(((d, f, c) for (d, f), c in zip(rows, simhash_classes(rows))), key=key)
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=key) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.component_id is not None)


@pytest.mark.parametrize(("max_bits", "cell"), [(0, 16), (1, 16), (2, 16), (2, 2), (2, 1000), (3, 16), (3, 2)])
def test_links_connect_all_close_fingerprints(spark, monkeypatch, max_bits, cell):
    """Chains and clusters of fingerprints at one, two and three bits, with cells compared pair by pair and cut finer."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 60, dtype=np.uint64).tolist()
    fps = {0, 2**64 - 1, 1, 3, 7, 2**63, 2**63 | 1 << 62}
    for s in seeds:
        fps.add(s)
        for k in (1, 2, 3):
            fps.add(s ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    for i in range(40):  # a cluster within two bits of one centre
        fps.add(seeds[0] ^ (1 << i))
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), max_bits).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= max_bits for a, b in edges)
    found = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= max_bits]
    want = groups(len(fps), near)
    label = [found.get(f, f) for f in signed]
    assert len(set(zip(want, label))) == len(set(want)) == len(set(label))


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1001 + i) for i in range(300)]
    got = dict(common.components(spark.createDataFrame([*chain, *hub, (5, 5), (7, 6)], "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 201)}, **{1001 + i: 1000 for i in range(300)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_query_and_no_documents(spark, docs_of):
    assert queries.op6_simhash(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert simhash.simhash_near_duplicates(docs_of([])).count() == 0


def cosine_classes(rows, cosine=0.95):
    v = np.array([x for _, x in rows])
    near = cover_tree.unit(v) @ cover_tree.unit(v).T >= cosine
    root = groups(len(rows), zip(*np.nonzero(near)))
    least = {}
    for (i, _), g in zip(rows, root):
        least[g] = min(i, least.get(g, i))
    return sorted((i, int(n) - 1, least[g]) for (i, _), n, g in zip(rows, near.sum(axis=1), root))


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = [(centres[i % 12] + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.2, 0.3, 1.0])) * rng.choice([1e-20, 1.0, 1e20]) for i in range(n)]
    rows[5:40] = [rows[4]] * 35  # equal vectors
    return [(i, [float(x) for x in r]) for i, r in enumerate(rows)]


def test_embeddings_match_all_pairs(spark):
    rows = clustered(700, 8, 1)
    odd = [(-1, None), (-2, [0.0] * 8), (-3, [float("nan")] + [1.0] * 7), (-4, [None] + [1.0] * 7), (-5, []), (-6, [float("inf")] * 8), (None, rows[0][1]), (-8, [1.0, 2.0]), (-9, [2.0, 4.0])]
    table = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").withColumns({"key": F.lit(1), "cell": F.lit("x")})
    got = cover_tree.embedding_near_duplicates(table, pivots=4, chunk=60).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None and r.vec_id >= 0) == cosine_classes(rows)
    rest = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None or r.vec_id < 0}
    assert rest == {**{i: (0, i, True) for i in range(-6, 0)}, None: (0, None, True), -8: (1, -9, False), -9: (1, -9, True)}


def leaves_of(spark, n, groups_of):
    """Chunks of n unit vectors in tight groups of ``groups_of`` around directions of their own."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(n // groups_of, 6))
    points = cover_tree.unit(np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), groups_of, axis=0) + rng.normal(size=(n // groups_of * groups_of, 6)) * 0.002)
    rows = spark.createDataFrame([(i, 1, "6", p.tobytes()) for i, p in enumerate(points)], cover_tree.CELLED)
    return cover_tree.split_cells(rows, 8, 50).groupBy("cell").applyInArrow(cover_tree.gather, cover_tree.CHUNKED).cache(), points


def test_meetings_of_chunks_grow_about_linearly_on_clustered_data(spark):
    counts = {}
    for n in (2000, 8000):
        chunks, points = leaves_of(spark, n, 100)
        rows = {r.cell: r for r in chunks.collect()}
        pairs = {(r.a, r.b) for r in cover_tree.meetings(chunks, 0.999).collect()}
        counts[n] = len(rows), len(pairs)
        place = {k: c for c, r in rows.items() for k in np.frombuffer(r["keys"], np.int64)}
        assert len(place) == n and all(len(r["keys"]) <= 400 for r in rows.values())
        a, b = np.nonzero(np.triu(points @ points.T >= 0.999))
        assert {tuple(sorted((place[i], place[j]))) for i, j in zip(a, b)} <= pairs  # no link is pruned
    (few, near), (many, met) = counts[2000], counts[8000]
    assert met < 6 * near and met < many * many / 8, counts


def test_embedding_query_matches_all_pairs(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op9_embedding_dedup(spark, SF).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == cosine_classes(rows)
    assert cover_tree.embedding_near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_cover_tree_invariants():
    points = cover_tree.unit(np.array([x for _, x in clustered(300, 6, 2)]))
    tree = cover_tree.CoverTree(np.unique(points, axis=0))
    for (above, reach, _), (centres, _, parents) in zip(tree.levels, tree.levels[1:]):
        gap = np.sqrt(np.maximum(2 - 2 * (tree.points[centres] * tree.points[above[parents]]).sum(axis=1), 0))
        assert (gap <= reach[parents] + 1e-7).all() and set(above.tolist()) <= set(centres.tolist())


def edits(rnd, text, k):
    s = list(text)
    for _ in range(k):
        i, kind = rnd.randrange(len(s)), rnd.randrange(3)
        s[i:i + (kind != 2)] = [] if kind == 1 else rnd.choice("abcxyz")
    return "".join(s)


def semi_global(text, passage):
    """Fewest edits of ``passage`` against any stretch of ``text``: the whole table."""
    row = np.zeros(len(text) + 1, np.int64)
    chars = np.array([ord(c) for c in text])
    for j, c in enumerate(passage):
        best = np.minimum(row[1:] + 1, row[:-1] + (chars != ord(c)))
        best = np.concatenate(([j + 1], best))
        row = np.minimum.accumulate(best - np.arange(len(best))) + np.arange(len(best))
    return int(row.min())


def test_passages_match_the_whole_alignment(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rnd, passages = random.Random(4), decontam.index_passages(items)
    docs = []
    for n in range(60):
        item = decontam.normal(items[n % len(items)][1])
        docs.append(texts[n][:400] + " " + edits(rnd, item, rnd.randint(0, int(0.13 * len(item)))) + "\n" + texts[-n][:300])
    got = decontam.find_leaks(docs, passages)
    for n, doc in enumerate(docs):
        for m in {n % len(items), (n * 7 + 3) % len(items)}:
            item = decontam.normal(items[m][1])
            k = int(len(item) * decontam.EDITS)
            d = semi_global(decontam.normal(doc), item)
            assert got.get((n, items[m][0])) == (d if d <= k else None)


def test_decontamination_budget_of_every_length():
    """Passages of 1 to 45 characters, with as many edits as the budget and one more, against the whole alignment."""
    rnd = random.Random(11)
    items = [(n, "".join(rnd.choice("abcdefgh ") for _ in range(n)).replace(" ", "x")) for n in range(1, 46)]
    docs = []
    for _, item in items:
        for edits in (int(len(item) * decontam.EDITS), int(len(item) * decontam.EDITS) + 1):
            text = list(item)
            for at in rnd.sample(range(len(text)), min(edits, len(text))):
                text[at] = rnd.choice(["", "z", text[at] + "q"])
            docs.append("".join(rnd.choice("mnop") for _ in range(30)) + "".join(text) + "rstu" * 5)
    got = decontam.find_leaks(docs, decontam.index_passages(items))
    for d, doc in enumerate(docs):
        for n, item in items:
            least = semi_global(doc, item)
            assert got.get((d, n)) == (least if least <= int(n * decontam.EDITS) else None)


def test_decontamination_of_repetitive_and_long_texts(monkeypatch):
    import tracemalloc
    benchmark = decontam.index_passages([(1, "a" * 200), (2, "the quick brown fox jumps over the lazy dog again and again")])
    whole = ["a" * 60000 + " " + "b" * 10 + "the quick brown fox jumps over the lazy dog again and again" + "c" * 900, "a" * 300, None, "", "a" * 150]
    tracemalloc.start()
    once = decontam.find_leaks(whole, benchmark)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    assert once == {(0, 1): 0, (0, 2): 0, (1, 1): 0}
    for slice_chars, postings in ((97, 1 << 22), (1000, 512)):  # windows and counts in parts find the same
        monkeypatch.setattr(decontam, "SLICE_CHARS", slice_chars)
        monkeypatch.setattr(decontam, "POSTINGS", postings)
        short = [whole[0][-1000:], *whole[1:]]
        assert decontam.find_leaks(short, benchmark) == {(0, 2): 0, (1, 1): 0}


def test_exact_passages_of_the_query(spark):
    items = [(r.item_id, decontam.normal(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [(r.doc_id, decontam.normal(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.edits for r in queries.op10_decontamination(spark, SF).collect()}
    exact = {(d, i) for d, t in texts for i, p in items if p in t}
    assert exact and exact == {k for k, e in got.items() if e == 0}


def test_odd_documents_and_passages(spark, docs_of):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog, twice."), (2, "tiny"), (3, ""), (4, None), (None, "passage without an id, long enough"), (1, "The quick brown fox jumps over the lazy dog, twice.")], "item_id long, text string")
    docs = docs_of([(1, "x THE  quick\nbrown fox jumps over the lazy dog, twice. y"), (2, None), (3, ""), (4, "a tiny thing"), (5, "clean text of some length without anything"), (1, "x THE  quick\nbrown fox jumps over the lazy dog, twice. y"), (None, "the quick brown fox jumps over the lazy dog, twice."), (6, "z" * 200_000 + " the quick brown fax jumps over the lazy dog, twice.")]).withColumn("item_id", F.lit(9))
    for block in (decontam.BLOCK_CHARS, 60):
        got = {(r.doc_id, r.item_id, r.edits) for r in decontam.benchmark_leaks(docs, bench, block_chars=block).collect()}
        assert got == {(1, 1, 0), (4, 2, 0), (None, 1, 0), (6, 1, 1)}
        assert sorted(r.doc_id for r in decontam.decontaminate(docs, bench, block_chars=block).collect()) == [2, 3, 5]
    assert decontam.benchmark_leaks(docs_of([]), bench).count() == 0
    assert decontam.benchmark_leaks(docs, bench.limit(0)).count() == 0
