"""Main-text extraction by a tree-structured graphical model over DOM nodes.

Each element is a two-state variable, content or not. Its tag, the words of its
class and id, its role, its own text and its share of link text make the node
potential; the parent's state makes the edge potential. Both are estimated from
labelled pages: pages with exactly one article or main element, whose inside is
content but for parts that are known not to be. Sum-product messages, upward and
then downward, give each element's exact marginal; text whose element is content
with probability one half or more is kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sigmoid

FIT_PAGES = 2000  # labelled pages that the potentials are estimated from, chosen by a hash of the id
SLICE = 512  # pages whose trees are passed messages together

#: Fixed lists of HTML: elements without end tag, raw-text elements, elements that break lines, and those that end a paragraph.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|textarea|noframes|xmp"
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
ENDS_P = BLOCK - set("body head html title option optgroup td th tr tbody thead tfoot caption legend".split())
ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
SCOPE = set("article aside blockquote body div dl figure footer form header html main nav ol section table td th ul".split())

#: Words of tags, classes and ids that tell content from the rest: the model's prior counts.
NOT_CONTENT_TAGS = "aside button dialog fieldset footer form head input label menu nav noscript option select svg title".split()
NOT_CONTENT_WORDS = "ad ads advert advertisement advertising alert author banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer form gdpr header legal login masthead menu meta modal nav navbar navigation newsletter notice overlay pager pagination popup promo promotion recommended related reply replies rss search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar tracking trending widget".split()
CONTENT_TAGS = "article main".split()
CONTENT_WORDS = "article body content entry main post prose story text".split()
NEUTRAL = set("a b blockquote br div em h1 h2 h3 h4 h5 h6 i li ol p pre section span strong table tbody td tr u ul".split())  # found on both sides
PRIOR = 400.0  # weight of a word of these lists, in nodes
SMOOTH = 8.0
OTHER_STAY = 0.5  # P(content | parent is content) of elements that the lists know as something else
LIMIT = 6.0  # of one feature's log odds; measures have a twelfth, tags found on both sides half of that

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?P<rawattrs>[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?P<close>>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
SPLIT = re.compile(r"[^a-z]+")


class Page:
    """Elements in page order: tag, words, parent, depth; and text pieces as (element, text), None between blocks."""

    def __init__(self, source: str):
        self.tags, self.words, self.parents, self.depths = ["#page"], [()], [-1], [0]
        self.pieces: list[tuple[int, str] | None] = []
        stack = [0]
        for m in TOKEN.finditer(source):
            if (text := m["text"]) is not None:
                self.pieces.append((stack[-1], text))
            elif (tag := m["tag"]) is not None and m["close"]:
                tag = tag.lower()
                if m["end"]:
                    self.close(stack, {tag}, set())
                else:
                    if tag in ENDS_P:
                        self.close(stack, {"p"}, SCOPE)
                    if tag in ENDS_OWN:
                        while self.close(stack, ENDS_OWN[tag], SCOPE - {"td", "th"}):
                            pass
                    self.open(stack, tag, m["attrs"])
                if tag in BLOCK:
                    self.pieces.append(None)
                elif tag == "br":
                    self.pieces.append((stack[-1], " "))

    def open(self, stack: list[int], tag: str, attrs: str) -> None:
        words = tuple(w for name, a, b, c in NAMED.findall(attrs) for w in SPLIT.split((a or b or c).lower()) if w) if attrs else ()
        self.tags.append(tag)
        self.words.append(words)
        self.parents.append(stack[-1])
        self.depths.append(len(stack))
        if tag not in VOID and not attrs.rstrip().endswith("/"):
            stack.append(len(self.tags) - 1)

    def close(self, stack: list[int], tags: set[str], scope: set[str]) -> bool:
        """Close the innermost open element of ``tags``, unless one of ``scope`` comes first."""
        for k in range(len(stack) - 1, 0, -1):
            if self.tags[stack[k]] in tags:
                del stack[k:]
                return True
            if self.tags[stack[k]] in scope:
                return False
        return False

    def features(self) -> list[list[str]]:
        """Of each element: tag, words, size of its own text, and share of link text below it."""
        n = len(self.tags)
        own, linked, below = [0] * n, [0] * n, [0] * n
        for piece in self.pieces:
            if piece:
                own[piece[0]] += len(piece[1].strip())
        for v in range(n - 1, 0, -1):
            below[v] += own[v]
            if self.tags[v] == "a":
                linked[v] = below[v]
            below[self.parents[v]] += below[v]
            linked[self.parents[v]] += linked[v]
        out = []
        for v in range(n):
            row = ["tag " + self.tags[v], *("word " + w for w in self.words[v]), f"own {min(own[v].bit_length(), 10) // 2}"]
            if below[v] > 10 and self.tags[v] in BLOCK:
                row.append(f"links {int(3 * linked[v] / below[v])}")
            out.append(row)
        return out

    def other(self, v: int) -> bool:
        """Whether the word lists know this element as something else than content."""
        return self.tags[v] in NOT_CONTENT_TAGS or any(w in NOT_CONTENT_WORDS for w in self.words[v])

    def labels(self) -> list[int] | None:
        """1 for elements inside the page's only article or main element, without known other parts; None: not a labelled page."""
        for name in ("article", "main"):
            roots = [v for v, t in enumerate(self.tags) if t == name]
            if len(roots) == 1:
                out = [0] * len(self.tags)
                for v in range(roots[0], len(self.tags)):
                    out[v] = int(v == roots[0] or (out[self.parents[v]] and not self.other(v)))
                return out
            if roots:
                return None
        return None


@dataclass
class DomModel:
    odds: dict[str, float]  # log odds of content, by feature
    stay: float  # P(content | parent is content), of elements that the word lists don't know as something else
    enter: float  # P(content | parent isn't)
    root: float  # log odds of the page node

    def evidence(self, page: Page) -> list[float]:
        get = self.odds.get
        return [sum(get(f, 0.0) for f in row) for row in page.features()]


def marginals(pages: list[Page], model: DomModel) -> list[np.ndarray]:
    """P(content) of each element, all pages' trees at once, level by level: messages up to the roots, then down."""
    sizes = [len(p.tags) for p in pages]
    first = np.cumsum([0, *sizes])
    parent = np.concatenate([np.array(p.parents) + o for p, o in zip(pages, first)]) if pages else np.zeros(0, np.int64)
    depth = np.concatenate([p.depths for p in pages]) if pages else np.zeros(0, np.int64)
    odds = np.array([e for p in pages for e in model.evidence(p)])
    up = np.zeros(len(odds))
    other = np.array([p.other(v) for p in pages for v in range(len(p.tags))], bool)
    stay = np.where(other, OTHER_STAY, model.stay)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []
    mix = lambda p, hi, lo: np.log((hi * p + lo * (1 - p)) / ((1 - hi) * p + (1 - lo) * (1 - p)))
    for level in reversed(levels[1:]):
        p = sigmoid(odds[level])
        up[level] = np.log((stay[level] * p + (1 - stay[level]) * (1 - p)) / (model.enter * p + (1 - model.enter) * (1 - p)))
        np.add.at(odds, parent[level], up[level])
    if levels:
        odds[levels[0]] += model.root
    for level in levels[1:]:
        without = sigmoid(odds[parent[level]] - up[level])  # what the parent believes but for this child
        odds[level] += mix(without, stay[level], model.enter)
    return [sigmoid(odds[a:b]) for a, b in zip(first[:-1], first[1:])]


def main_text(page: Page, content: np.ndarray) -> str:
    """The kept text: references decoded, white space inside a block as one space, blocks joined by newlines."""
    blocks, block = [], []
    for piece in [*page.pieces, None]:
        if piece is None:
            if block and (line := " ".join(html.unescape("".join(block)).split())):
                blocks.append(line)
            block = []
        elif content[piece[0]] >= 0.5:
            block.append(piece[1])
    return "\n".join(blocks)


def prior_counts() -> Counter:
    """Counts (feature, label) that the word lists stand for."""
    out: Counter = Counter()
    for label, tags, words in ((0, NOT_CONTENT_TAGS, NOT_CONTENT_WORDS), (1, CONTENT_TAGS, CONTENT_WORDS)):
        for f in [*("tag " + t for t in tags), *("word " + w for w in words)]:
            out[f, label] += PRIOR
    return out


def page_counts(source: str) -> Counter:
    """Counts (feature, label) and (edge, parent's label, label) of a labelled page; nothing for others."""
    page, out = Page(source), Counter()
    if (labels := page.labels()) is not None:
        for v, row in enumerate(page.features()):
            out["#node", labels[v]] += 1
            for f in row:
                out[f, labels[v]] += 1
            if v:
                out[f"#edge {labels[page.parents[v]]}", labels[v]] += 1
    return out


def fit_dom_model(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DomModel:
    """Potentials from a bounded sample of pages and the prior word lists; without labelled pages, from the lists alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for source in batch.column(0).to_pylist():
                total.update(page_counts(source or ""))
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in total], pa.string()), pa.array([y for _, y in total], pa.int32()), pa.array(list(total.values()), pa.int64())], ["feature", "label", "n"])

    chosen = pages.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(fit_pages)
    sample = pages.join(F.broadcast(chosen), "page_id").select("html")  # a proven bound: fit_pages ids
    counts = prior_counts()
    for r in sample.mapInArrow(run, "feature string, label int, n long").groupBy("feature", "label").agg(F.sum("n").alias("n")).collect():
        counts[r.feature, r.label] += r.n
    nodes = [counts["#node", y] + 2 * PRIOR for y in (0, 1)]
    odds = {}
    for f in {f for f, _ in counts if not f.startswith("#")}:
        rate = [(counts[f, y] + SMOOTH / 2 * nodes[y] / sum(nodes)) / nodes[y] for y in (0, 1)]
        limit = LIMIT / 24 if f.startswith("tag ") and f[4:] in NEUTRAL else LIMIT if f.startswith(("tag ", "word ")) else LIMIT / 12
        odds[f] = float(np.clip(np.log(rate[1] / rate[0]), -limit, limit))
    share = lambda edge, a, b: (counts[edge, 1] + a) / (counts[edge, 1] + counts[edge, 0] + a + b)
    return DomModel(odds, min(0.9, share("#edge 1", 19.0, 1.0)), float(np.clip(share("#edge 0", 1.0, 19.0), 0.02, 0.1)), -2.0)


def extract_main_text(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``: the main text of the whole html.

    Null and empty html, and pages without content, have empty text; markup that
    ends early or isn't closed is read as far as it goes; null and repeated ids
    keep their rows; no pages give no rows; other columns are not read.
    """
    model = pages.sparkSession.sparkContext.broadcast(fit_dom_model(pages, fit_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                trees = [Page(s or "") for s in batch.column(2).to_pylist()]
                texts = [main_text(p, c) for p, c in zip(trees, marginals(trees, model.value))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
