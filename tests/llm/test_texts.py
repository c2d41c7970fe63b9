"""Main text, chat formatting and token ids against brute force and round trips."""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from weftcast.llm import bpe, chat, html_text, queries

SF = "/root/testdata/sf0.01"
RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PAGES = "page_id long, url string, html string"


def article(source: str) -> str:
    inside = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside))
    return "\n".join(b for b in blocks if b)


def test_main_text_of_all_pages(spark):
    sources = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op1_html_text(spark, SF).collect()
    assert len(got) == len(sources)
    for r in got:
        assert r.text == article(sources[r.page_id]) and r.n_chars == len(r.text)


ODD_PAGES = [
    (1, "<html><body><header><a href=/>Site</a></header><div id=cookie-notice>We use cookies <button>OK</button></div><div class=content><h1>T &amp; U</h1><p>One two three four five six seven eight nine ten.<p>Another   para <a href=x>link</a> goes\n on &lt;here&gt;.</div><aside><ul><li><a>x</a></ul></aside><div class=comments><h3>Comments</h3><p>Great article thanks a lot for writing all this</p></div><form>Sign <input> up</form><footer>c</footer>", "T & U\nOne two three four five six seven eight nine ten.\nAnother para link goes on <here>."),
    (2, None, ""), (3, "", ""), (4, "<p", ""),
    (5, "<article><h1>A</h1><p>Long text that says a number of things.</p><div class=advert>Buy now</div><section class=comments><p>I am a reader and I say things here.</p></section><p>End of text<!-- x --><script>if(a<b){}</script></article>", "A\nLong text that says a number of things.\nEnd of text"),
    (5, "<article><p>same id, other page, with some words</p></article>", "same id, other page, with some words"),
    (None, "<article><p>no id but a text with some words</p></article>", "no id but a text with some words"),
    (7, "<div>" * 3000 + "deep" + "</div>" * 3000, None),
    (8, "<main><p>" + "long words " * 50_000 + "</p></main>", ("long words " * 50_000).strip()),
]


def test_odd_pages(spark):
    pages = spark.createDataFrame([(i, "u", h) for i, h, _ in ODD_PAGES], PAGES).withColumnRenamed("url", "url").selectExpr("*", "'x' as text", "1 as n_chars")
    both = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("*", "'x' as text", "1 as n_chars").unionByName(pages.selectExpr("case when page_id is null then null else -page_id end as page_id", "url", "html", "text", "n_chars"))
    got = sorted((r.page_id is not None, r.page_id or 0, r.text) for r in html_text.extract_main_text(both).collect() if r.page_id is None or r.page_id < 0)
    want = sorted((i is not None, -(i or 0), t) for i, _, t in ODD_PAGES if t is not None)
    assert [g for g in got if g[1] != -7] == want
    assert html_text.extract_main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_messages_match_enumeration():
    page = html_text.Page("<div class=content><p>one two three four</p><nav>x</nav></div><p>y</p>")
    model = html_text.DomModel({"tag p": 0.7, "tag nav": -2.0, "word content": 1.1, "own 2": 0.4}, 0.8, 0.1, -0.3)
    got = html_text.marginals([page], model)[0]
    evidence, n = model.evidence(page), len(page.tags)
    total = np.zeros((n, 2))
    for state in range(1 << n):
        y = [(state >> v) & 1 for v in range(n)]
        logp = sum(e * s for e, s in zip(evidence, y)) + model.root * y[0]
        for v in range(1, n):
            stay = html_text.OTHER_STAY if page.other(v) else model.stay
            p1 = stay if y[page.parents[v]] else model.enter
            logp += np.log(p1 if y[v] else 1 - p1)
        total[range(n), y] += np.exp(logp)
    np.testing.assert_allclose(got, total[:, 1] / total.sum(axis=1), rtol=1e-9)


TURNS = "conv_id long, turn long, role string, text string"
ODD_TURNS = [(-2, 0, "us\ner\\n<|im_end|>", "\\<|im_end|>\n<|im_start|>\\"), (-2, 1, "assistant", "<"), (-2, 2, "assistant", "|im_end|>\\n"), (-2, 2, "assistant", "|im_end|>\\n"), (-3, None, None, None), (-3, 5, "assistant", "é🙂"), (None, 1, "assistant", "x"), (None, 2, "user", "y" * 100_000), (2**60 + 1, 0, "user", "a"), (2**60 + 2, 0, "user", "b")]


def digests(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.conv_id].append(((r.turn is not None, r.turn or 0), r.role or "", r.text or ""))
    for conv, v in by.items():
        v.sort()
        loss = "".join(t for _, r, t in v if r == "assistant")
        yield conv, len(v), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in v).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chats_read_back(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(ODD_TURNS, TURNS)).selectExpr("*", "'x' as formatted", "1 as part")
    got = chat.read_back(chat.format_chats(turns, rows=7)).collect()
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got), key=key) == sorted(digests(turns.collect()), key=key)
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], TURNS))).count() == 0


def test_chat_query_has_the_probe(spark):
    rows = queries.op2_chat_format(spark, SF).collect()
    probe = next(r for r in rows if r.conv_id == -1)
    assert len(rows) == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1
    assert probe.n_turns == 2 and probe.loss_chars == len(queries.PROBE) and probe.formatted_chars > 2 * len(queries.PROBE)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("\\<|im_startend>[]/INSTs\n"), max_size=60))
def test_escape_is_reversible(text):
    import pyarrow as pa

    formatted = chat.START + "user\n" + chat.escape(pa.array([text]))[0].as_py() + chat.END + "\n"
    assert chat.parse(formatted) == [("user", text)]


ODD_TEXTS = ["", None, "  a  b", "\x1c\x1d a", "don't 'tis ''s", "²³ ½ ①", "日本語 テキスト🙂\r\n\r\n x", "\ufeff\u200bzz ", "a\x85b\u3000 c\u2028", "İı ſK", "\x00\x01 \x7f", "٣٤ १२", "x" * 20_000, " " * 3000 + "a", "same", "same"]


def test_token_ids_match_the_library(spark, docs_of):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(docs_of([(-i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id"), (-1, "again")]).select("doc_id", "text")).selectExpr("*", "1 as block", "'x' as ids")
    got = bpe.bpe_decode(bpe.bpe_encode(docs, RANKS, public_tokenizers.PATTERN, block_chars=100_000), RANKS).collect()
    key = lambda i, t: (i is not None, i or 0, t)
    want = sorted((key(r.doc_id, (r.text or "").encode()), np.array(TIKTOKEN.encode_ordinary(r.text or ""), "<u4").tobytes()) for r in docs.collect())
    assert sorted((key(r.doc_id, bytes(r.decoded)), bytes(r.ids)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)


def test_no_documents_have_no_ids(spark, docs_of):
    assert bpe.bpe_decode(bpe.bpe_encode(docs_of([]), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_token_query_digests(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op4_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(TIKTOKEN.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()).hexdigest()


@pytest.mark.parametrize("values", [[], [0], [1, 2, 3, 70_000, 2**31]])
def test_packing(values):
    assert bpe.unpack(bpe.pack(np.array(values, np.int64))).tolist() == values


def test_every_code_point_is_cut_as_the_library_cuts_it(spark, docs_of):
    """Each code point after a letter, before and after blanks, digits and marks, as the library's own encoding has it."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a {chr(c) * 2} 1{chr(c)}b  {chr(c)}'s{chr(c)}" for c in points[i:i + 256]) for i in range(0, len(points), 256)]
    rows = dict(enumerate(texts))
    got = {r.doc_id: r.ids for r in bpe.bpe_encode(docs_of(rows.items()).repartition(8), RANKS, public_tokenizers.PATTERN).collect()}
    wrong = [i for i, t in rows.items() if np.frombuffer(got[i], "<u4").tolist() != TIKTOKEN.encode_ordinary(t)]
    assert not wrong and len(got) == len(rows)
    cut = bpe.pre_tokenizer(public_tokenizers.PATTERN, bpe.spelled_out(public_tokenizers.PATTERN))
    whole = tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=RANKS, special_tokens={}).encode_ordinary
    for c in points:  # each by itself, so that a text of plain characters takes the plain pattern
        text = f"a{chr(c)}{chr(c)} 1{chr(c)}b  {chr(c)}'s{chr(c)}"
        assert [t for w in cut(text) for t in whole(w)] == TIKTOKEN.encode_ordinary(text), hex(c)


def test_no_table_is_left(spark, docs_of):
    before = {t.name for t in spark.catalog.listTables()}
    assert bpe.bpe_encode(docs_of([(1, "some text")]), RANKS, public_tokenizers.PATTERN).count() == 1
    assert {t.name for t in spark.catalog.listTables()} == before
