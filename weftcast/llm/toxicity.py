"""Toxicity by weak supervision.

Voters look for words of a lexicon, for words and word beginnings that labelled
training rows mark, for patterns, and for how many of these meet in a text. A
generative label model estimates each voter's accuracy from how voters agree over
all documents, and the correlations that two voters have beyond the label, which
lower the weight of both. Its posteriors label a bounded sample of documents, on
which a linear classifier is trained; the classifier scores every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftcast.session import broadcast_if_small, cut_lineage

from .common import bounded_ids, held_out, label_rows, sigmoid
from .features import DIM, count_arrays, hashed, score_texts, word_features

#: Lexicon of insults; each word is a voter.
LEXICON = ["clown", "disgusting", "dumb", "fool", "garbage", "hate", "idiot", "jerk", "liar", "loser", "moron", "pathetic", "pig", "scum", "shut", "stupid", "trash", "ugly", "vermin", "worthless"]
#: Patterns; each is a voter.
PATTERNS = [r"(?i)\byou('re| are)? (an? |all |so )?(such |total |complete )?(idiot|moron|loser|clown|scum|trash|pathetic|stupid|worthless|disgusting)", r"(?i)\b(shut up|go to hell|kill yourself|drop dead)\b", r"[A-Z]{4,}[^.\n]{0,40}!!+"]
MINED = 96  # voters taken from labelled training rows
SUPPORT = 5  # labelled rows that must hold a mined word
MEETING = [1, 2, 4]  # voters on how many words of lexicon and mined list a text holds
FIT_ROWS = 8000  # documents that the linear classifier is trained on
VOCABULARY = 4096  # features that the classifier may use
RESIDUAL = 0.3  # correlation beyond the label from which two voters count as dependent
ROUNDS = 6  # of expectation maximisation
STEPS = 300  # of the linear classifier
THRESHOLD = 0.7


@dataclass
class Voters:
    """Feature ids of word voters, in order; pattern, meeting and silence voters follow."""

    words: np.ndarray
    patterns: list = field(default_factory=lambda: [re.compile(p) for p in PATTERNS])

    def __len__(self) -> int:
        return len(self.words) + len(self.patterns) + len(MEETING) + 1

    def votes(self, text: str, features: np.ndarray) -> np.ndarray:
        hit = np.isin(self.words, features, assume_unique=False)
        n = hit.sum()
        patterns = [p.search(text) is not None for p in self.patterns]
        return np.concatenate([hit, patterns, [n >= k for k in MEETING], [n == 0 and not any(patterns)]]).astype(bool)


def mine_voters(counts: np.ndarray, docs: np.ndarray) -> Voters:
    """The lexicon, and the features with the clearest log odds for label 1 among training rows."""
    rate = (counts + 0.5) / (docs[:, None] + 1.0)
    odds = np.log(rate[1] / (1 - rate[1])) - np.log(rate[0] / (1 - rate[0]))
    error = np.sqrt((1 / (counts + 0.5)).sum(axis=0))
    clear = np.where((counts[1] >= SUPPORT) & (odds > 2.0), odds / error, -np.inf)
    best = np.argsort(-clear, kind="stable")[:MINED]
    lexicon = [hashed("w:" + w) for w in LEXICON]
    return Voters(np.array(list(dict.fromkeys([*lexicon, *best[np.isfinite(clear[best])].tolist()])), np.int64))


def vote_patterns(docs: DataFrame, marked: DataFrame, voters: Voters) -> DataFrame:
    """(pattern, y, n): how often each pattern of votes, packed as bits, occurs over all documents; y: the training label or null."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = word_features()
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            packed = [np.packbits(shared.value.votes(t, of(t))).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "pattern"])

    votes = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, pattern binary")
    return votes.join(broadcast_if_small(marked), "doc_id", "left").groupBy("pattern", "y").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class LabelModel:
    """P(label 1), each voter's rates in the two classes, and its weight after correlations."""

    prior: float
    on1: np.ndarray
    on0: np.ndarray
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        yes, no = np.log(self.on1 / self.on0), np.log((1 - self.on1) / (1 - self.on0))
        return sigmoid(np.log(self.prior / (1 - self.prior)) + np.where(votes, yes, no) @ self.weight)


def class_sums(patterns: DataFrame, m: int, model: LabelModel | None, pairs: bool = False) -> np.ndarray:
    """By class: documents, votes of each voter and, with ``pairs``, joint votes of each pair.

    Documents with a training label count in their class, the others by the
    model's posterior, or not at all without a model. Added up in each task:
    2 * (1 + m + m * m / 2) numbers or so at most leave it.
    """
    shared = patterns.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + m + (m * m if pairs else 0)))
        for batch in batches:
            bits = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            votes, n = np.unpackbits(bits, axis=1)[:, :m].astype(float), batch.column(2).to_numpy().astype(float)
            y = batch.column(1).cast(pa.float64()).fill_null(-1.0).to_numpy()
            guess = shared.value.posterior(votes > 0) if shared.value is not None else np.full(len(n), 0.5)
            known = y >= 0
            share = np.where(known, y, guess)
            n = n if shared.value is not None else n * known
            for c, r in ((0, n * (1 - share)), (1, n * share)):
                total[c, 0] += r.sum()
                total[c, 1:m + 1] += r @ votes
                if pairs:
                    total[c, m + 1:] += ((votes * r[:, None]).T @ votes).ravel()
        if pairs:  # a pair counts the same either way round
            square = total[:, m + 1:].reshape(2, m, m)
            square[:, np.tril_indices(m, -1)[0], np.tril_indices(m, -1)[1]] = 0.0
        c, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(cell), pa.array(total[c, cell])], ["c", "cell", "v"])

    out = np.zeros((2, 1 + m + (m * m if pairs else 0)))
    parts = patterns.select("pattern", "y", "n").mapInArrow(run, "c long, cell long, v double")
    for r in parts.groupBy("c", "cell").agg(F.sum("v").alias("v")).collect():
        out[r.c, r.cell] = r.v
    if pairs:
        upper = out[:, m + 1:].reshape(2, m, m)
        out[:, m + 1:] = (upper + np.triu(upper, 1).transpose(0, 2, 1)).reshape(2, m * m)
    return out


def rates(sums: np.ndarray, m: int, weight: np.ndarray, start: bool = False) -> LabelModel:
    n = sums[:, 0] + 1.0
    on = (sums[:, 1:m + 1] + np.array([[0.05], [0.5]])) / (n[:, None] + np.array([[1.0], [10.0]]))
    if start and sums[1, 0] == 0:  # no label 1: words and patterns speak for it, silence against
        on = np.tile(np.array([[0.005], [0.2]]), (1, m))
        on[:, -1] = 0.95, 0.1
    prior = float(np.clip(n[1] / n.sum(), 0.01, 0.5)) if sums.sum() else 0.05
    return LabelModel(prior, np.clip(on[1], 1e-4, 1 - 1e-4), np.clip(on[0], 1e-5, 1 - 1e-4), weight)


def fit_label_model(patterns: DataFrame, m: int) -> LabelModel:
    """Accuracies and correlations of the voters by expectation maximisation over all documents.

    Rounds begin from the labelled training rows; documents without a label then
    take part with their posterior. Two voters whose votes correlate within the
    classes, beyond the label, share their weight by that correlation.
    """
    weight = np.ones(m)
    model = rates(class_sums(patterns, m, None), m, weight, start=True)
    for step in range(ROUNDS):
        sums = class_sums(patterns, m, model, pairs=step == 0)
        if step == 0:
            excess = np.zeros((m, m))
            for c in (0, 1):
                n = max(sums[c, 0], 1.0)
                rate, joint = sums[c, 1:m + 1] / n, sums[c, m + 1:].reshape(m, m) / n
                deviation = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
                excess = np.maximum(excess, np.abs(joint - np.outer(rate, rate)) / np.outer(deviation, deviation))
            np.fill_diagonal(excess, 0.0)
            weight = 1.0 / (1.0 + np.where(excess > RESIDUAL, np.minimum(excess, 1.0), 0.0).sum(axis=1))
        model = rates(sums, m, weight)
    return model


@dataclass
class ToxicityModel:
    weight: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> float:
        return float(sigmoid(self.weight[features].sum() + self.bias))


def fit_linear(rows: list[np.ndarray], posterior: np.ndarray, vocabulary: np.ndarray, rounds: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights (over DIM) and bias of a logistic model with soft labels and an L2 penalty, by accelerated gradient steps."""
    place = np.full(DIM, -1)
    place[vocabulary] = np.arange(len(vocabulary))
    kept = [place[f][place[f] >= 0] for f in rows]
    row, col = np.repeat(np.arange(len(rows)), [len(k) for k in kept]), np.concatenate([np.zeros(0, np.int64), *kept])
    share = np.clip(posterior.mean(), 0.02, 0.98)
    importance = np.where(posterior > 0.5, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share))) / len(rows)  # half way to balanced classes
    longest = max([1, *(len(k) for k in kept)])
    w, b = np.zeros(len(vocabulary)), 0.0
    look_w, look_b, penalty = w, b, 1e-4
    pace = 1.0 / np.sqrt(longest)
    for step in range(rounds):
        error = (sigmoid(np.bincount(row, look_w[col], len(rows)) + look_b) - posterior) * importance
        new_w = look_w - pace * 4 * (np.bincount(col, error[row], len(vocabulary)) + penalty * look_w)
        new_b = look_b - pace * error.sum()
        momentum = step / (step + 3)
        look_w, look_b = new_w + momentum * (new_w - w), new_b + momentum * (new_b - b)
        w, b = new_w, new_b
    out = np.zeros(DIM)
    out[vocabulary] = w
    return out, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """A model fitted without the held-out fold's labels.

    Label counts use all labelled training rows, voters' agreements all
    documents; ``fit_rows`` documents, half of them labelled training rows if
    there are so many, bound the classifier's training set. Without labelled
    rows of label 1 the rounds begin from fixed rates.
    """
    marked, texts = label_rows(labels, "toxic"), docs.select("doc_id", "text")
    counts, total = count_arrays(texts.join(broadcast_if_small(marked), "doc_id"), word_features)
    voters = mine_voters(counts, total)
    model = fit_label_model(cut_lineage(vote_patterns(texts, marked, voters)), len(voters))
    shared = docs.sparkSession.sparkContext.broadcast((voters, model))

    def fit(t: pa.Table) -> pa.Table:
        of, (v, m) = word_features(), shared.value
        order = np.argsort(t.column("doc_id").to_numpy(), kind="stable")
        text = t.column("text").to_pylist()
        rows = [of(text[i] or "") for i in order]
        posterior = m.posterior(np.array([v.votes(text[i] or "", f) for i, f in zip(order, rows)]))
        n1 = np.bincount(np.concatenate([np.zeros(0, np.int64), *(f for f, p in zip(rows, posterior) if p > 0.5)]), minlength=DIM)
        n = np.bincount(np.concatenate([np.zeros(0, np.int64), *rows]), minlength=DIM)
        share = max(1e-9, (posterior > 0.5).mean())
        gain = np.where(n >= SUPPORT, np.abs(n1 - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share) + 1e-9), 0.0)
        vocabulary = np.unique(np.concatenate([v.words, np.argsort(-gain, kind="stable")[:VOCABULARY]]))
        weight, bias = fit_linear(rows, posterior, vocabulary)
        return pa.table({"weight": [weight.tobytes()], "bias": [float(bias)]})

    known = bounded_ids(marked.select("doc_id"), fit_rows // 2)
    others = bounded_ids(docs.select("doc_id").where("doc_id is not null").distinct(), fit_rows // 2, seed=12)
    sample = known.unionByName(others).distinct()  # a proven bound: fit_rows ids
    got = texts.join(F.broadcast(sample), "doc_id").groupBy(F.lit("one sample").alias("sample")).applyInArrow(fit, "weight binary, bias double").collect()
    if not got:
        return ToxicityModel(np.zeros(DIM), -3.0)
    return ToxicityModel(np.frombuffer(got[0].weight), got[0].bias)


def toxicity_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; predicted 1: score 0.7 or more.

    Null texts read as empty and get a score too; null and repeated ids keep
    their rows; no documents give no rows. Only the text makes the score; other
    columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, fit_rows))
    scored = score_texts(docs, word_features, lambda f: model.value.score(f))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
