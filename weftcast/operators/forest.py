"""Trees, forests and boosted trees of all entities (#72-#78), grown level by level.

A fit is a unit of work: one entity's rows with a block of candidates and folds.
Spark deals the units over the tasks; in a task all trees of a unit grow together,
one pass a level over the rows of all their open nodes. Jobs so do not grow with
entities, candidates, folds, trees or rounds. Entities of more than ``TASK_ROWS``
rows are grown by ``levels.grow_levels`` instead, one aggregation a level over
all their rows; both give the same trees, because both add up whole numbers:
targets and gradients are kept as multiples of 2 ** -20, so that sums do not
depend on their order or on the layout of the rows.

A split is judged by T(G)^2 / (H + l2) of its sides, less that of the node, with
G the sum of what is left to explain, H of the weights, and T shrinkage by l1:
for plain trees this is the fall of the squared error. Ties go to the smaller
feature, then to the smaller cut. Bags, row and column samples are drawn by a
hash of (seed, tree, row position or feature), never by partition.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

SCALE = 1 << 20  # whole-number targets and gradients are multiples of 1 / SCALE
MAX_BINS = 512  # distinct values of a feature that are kept apart; more are cut at quantiles
TASK_ROWS = 1 << 16  # rows of an entity that one task fits
TREES = 64  # trees of a forest that grow together
LEAST_GAIN = 1e-9
NO_LIMIT = 1 << 30

try:  # tasks get this module with the function, without a package on their path
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
except ImportError:  # pragma: no cover
    pass


# --------------------------------------------------------------------------- #
# parameters
# --------------------------------------------------------------------------- #
# The untuned defaults of the eight models' tree family.
DEFAULTS = {
    "decision_tree": {"max_depth": None, "min_samples_leaf": 1, "min_samples_split": 2},
    "random_forest": {"n_estimators": 100, "max_depth": None, "min_samples_leaf": 1, "min_samples_split": 2, "max_features": 1.0},
    "xgboost": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.3, "subsample": 1.0, "colsample_bytree": 1.0, "reg_alpha": 0.0, "reg_lambda": 1.0, "min_child_weight": 1.0},
    "lightgbm": {"n_estimators": 100, "num_leaves": 31, "max_depth": -1, "learning_rate": 0.1, "subsample": 1.0, "subsample_freq": 0, "colsample_bytree": 1.0, "min_child_samples": 20, "reg_alpha": 0.0, "reg_lambda": 0.0},
}


def rules(key: str, params: dict, n_features: int) -> dict:
    """What a model's parameters mean for growth; an unknown parameter is an error.

    ``subsample`` of lightgbm acts every ``subsample_freq`` rounds, and by
    default, as in that library, never.
    """
    if unknown := set(params) - set(DEFAULTS[key]):
        raise ValueError(f"{key}: unknown parameters {sorted(unknown)}")
    p = {**DEFAULTS[key], **params}
    depth = p.get("max_depth")
    share = p.get("max_features", 1.0)
    per_node = {"sqrt": math.isqrt(n_features), "log2": int(math.log2(n_features))}.get(share) if isinstance(share, str) else int(share * n_features)
    return {
        "key": key,
        "trees": int(p.get("n_estimators", 1)),
        "boosted": key in ("xgboost", "lightgbm"),
        "bagged": key == "random_forest",
        "depth": NO_LIMIT if depth is None or depth < 0 else int(depth),
        "leaf": int(p.get("min_samples_leaf", p.get("min_child_samples", 1))),
        "split": int(p.get("min_samples_split", 2)),
        "weight": float(p.get("min_child_weight", 0.0)),
        "leaves": int(p.get("num_leaves", NO_LIMIT)),
        "l1": float(p.get("reg_alpha", 0.0)),
        "l2": float(p.get("reg_lambda", 0.0)),
        "rate": float(p.get("learning_rate", 1.0)),
        "rows": float(p.get("subsample", 1.0)),
        "every": int(p.get("subsample_freq", 1)),
        "per_node": max(1, min(n_features, per_node)),
        "per_tree": max(1, int(p.get("colsample_bytree", 1.0) * n_features)),
    }


# --------------------------------------------------------------------------- #
# draws
# --------------------------------------------------------------------------- #
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def draw(*longs) -> np.ndarray:
    """XXH64 of long values, each hash the seed of the next, beginning with 42: SQL's ``xxhash64`` of the same columns."""
    state = np.asarray(42, np.uint64)
    with np.errstate(over="ignore"):
        for value in longs:
            h = state + _P5 + np.uint64(8)
            h = h ^ (_turn(np.asarray(value).astype(np.int64).view(np.uint64) * _P2, 31) * _P1)
            h = _turn(h, 27) * _P1 + _P4
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            state = h ^ (h >> np.uint64(32))
    return state


def share(h: np.ndarray) -> np.ndarray:
    """A hash as a number from 0 to below 1."""
    return (h >> np.uint64(11)).astype(float) * 2.0 ** -53


#: Below which shares a row is drawn 0, 1, 2, ... times: Poisson with mean 1.
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
BAG, ROWS, COLUMNS, NODE = 1, 2, 3, 4  # what a draw is for


def first_of(h: np.ndarray, k: int) -> np.ndarray:
    """True for the ``k`` smallest of each row."""
    if k >= h.shape[-1]:
        return np.ones(h.shape, bool)
    return h <= np.partition(h, k - 1, axis=-1)[..., k - 1:k]


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(x * SCALE + 0.5).astype(np.int64)


# --------------------------------------------------------------------------- #
# growth
# --------------------------------------------------------------------------- #
def cuts_of(x: np.ndarray, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Cuts of each feature: midpoints of neighbouring values, at most ``max_bins`` of them at quantiles."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > max_bins:
            values = np.unique(np.sort(column)[(np.arange(1, max_bins + 1) * (len(column) - 1)) // max_bins])
        out.append((values[1:] + values[:-1]) / 2)
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Number of cuts below each value: a value is at most cut b if its bin is at most b."""
    return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1).astype(np.int32)


def shrunk(g: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """Drawn towards 0 by ``l1``."""
    return g - np.clip(g, -l1, l1)


class Nodes:
    """Growing arrays of nodes; node t is the root of tree t."""

    def __init__(self):
        self.parts: dict[str, list[np.ndarray]] = {}

    def add(self, **columns) -> None:
        for name, values in columns.items():
            self.parts.setdefault(name, []).append(np.asarray(values))

    def arrays(self) -> dict[str, np.ndarray]:
        return {name: np.concatenate(parts) for name, parts in self.parts.items()}


class Rows:
    """A unit's rows for a number of trees: entries are tree * rows + row; features' entries in the order of their bins."""

    def __init__(self, order: np.ndarray, bins: np.ndarray, trees: int):
        self.features, self.rows = order.shape
        self.bins, self.trees = bins, trees
        self.entries = (order[:, None, :] + (np.arange(trees) * self.rows)[None, :, None]).reshape(self.features, -1).astype(np.int64)
        self.bin_of = np.ascontiguousarray(np.tile(bins.T, (1, trees))).ravel()  # by feature, then entry
        self.lane = (np.arange(self.features) * (trees * self.rows))[:, None]

    def some(self, picked: np.ndarray) -> np.ndarray:
        """Entries of ``picked`` (of all entries), by feature."""
        return self.entries if picked.all() else self.entries[picked[self.entries]].reshape(self.features, -1)


def running(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Running sums along the rows of ``values``, from the start of each node."""
    run = np.zeros((len(values), values.shape[1] + 1), np.int64)
    np.cumsum(values, axis=1, out=run[:, 1:])
    base = np.repeat(run[:, start], size, axis=1)
    return np.subtract(run[:, 1:], base, out=base)


def one_target(flat_g: np.ndarray, flat_w: np.ndarray, entries: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Nodes whose rows all have the same target: no split of them gains anything."""
    out = np.ones(len(size), bool)
    if len(entries):
        target = flat_g[entries] // flat_w[entries]
        some = size > 0
        out[some] = np.maximum.reduceat(target, start[some]) == np.minimum.reduceat(target, start[some])
    return out


def grow(rows: Rows, weight: np.ndarray, target: np.ndarray, rule: dict[str, np.ndarray], seed: int) -> dict[str, np.ndarray]:
    """All trees at once; weight and whole-number target are (trees, rows), ``rule`` has an array entry for each tree.

    Nodes (tree, feature or -1, cut, left, right, value, gain, depth, parent,
    size) are numbered over all trees, roots first.
    """
    trees = len(weight)
    flat_w, flat_g = weight.ravel(), (weight * target).ravel()
    member = rows.some(flat_w > 0)  # (features, entries) by node, within it by the feature's bins
    ones = not (flat_w > 1).any()
    size, tree, node = (weight > 0).sum(axis=1), np.arange(trees), np.arange(trees)
    drawn = (rule["per_node"] < rows.features).any()  # nodes have keys only if features are drawn by node
    key = draw(seed, NODE, rule["tree"]) if drawn else node.view(np.uint64)
    same = one_target(flat_g, flat_w, member[0], np.cumsum(size) - size, size)
    total_g, total_w = (weight * target).sum(axis=1), weight.sum(axis=1)
    made, count, depth, parent = Nodes(), trees, 0, np.full(trees, -1)
    while len(node):
        l1, l2 = rule["l1"][tree], rule["l2"][tree]
        value = shrunk(total_g * (1.0 / SCALE), l1) / np.maximum(total_w + l2, 1e-300)
        open_ = ~same & (size >= np.maximum(rule["split"][tree], 2 * rule["leaf"][tree])) & (depth < rule["depth"][tree])
        feature, cut, gain = np.full(len(node), -1), np.zeros(len(node), np.int64), np.zeros(len(node))
        left, right, split = np.full(len(node), -1), np.full(len(node), -1), np.zeros(0, bool)
        if open_.any():
            if not open_.all():
                member = np.compress(np.repeat(open_, size), member, axis=1)
            tree_o, size_o, key_o, g_o, w_o = (x[open_] for x in (tree, size, key, total_g, total_w))
            start = np.cumsum(size_o) - size_o
            f, b, g = best_splits(rows, member, start, size_o, flat_g, None if ones else flat_w, g_o, w_o, {k: rule[k][tree_o] for k in ("l1", "l2", "leaf", "weight")}, chosen(rule, tree_o, key_o, rows.features, seed))
            split = g > LEAST_GAIN
            feature[open_], cut[open_], gain[open_] = np.where(split, f, -1), np.where(split, b, 0), np.where(split, g, 0.0)
            where = np.flatnonzero(open_)[split]
            left[where] = count + 2 * np.arange(len(where))
            right[where] = left[where] + 1
        made.add(tree=tree, feature=feature, cut=cut, left=left, right=right, value=value, gain=gain, depth=np.full(len(node), depth), parent=parent, size=size)
        n_split = int(split.sum())
        if not n_split:
            break
        # the next level: left and right rows of each split node, in the order of the features
        size_s = size_o[split]
        if n_split < len(split):
            member = np.compress(np.repeat(split, size_o), member, axis=1)
        begin, seg = np.cumsum(size_s) - size_s, np.repeat(np.arange(n_split), size_s)
        some = member[0]
        goes = rows.bins[some % rows.rows, f[split][seg]] <= b[split][seg]
        n_left = np.add.reduceat(goes, begin, dtype=np.int64)
        gl, wl = (np.add.reduceat(np.where(goes, x[some], 0), begin) for x in (flat_g, flat_w))
        size = np.stack([n_left, size_s - n_left], axis=1).ravel()
        same = np.ones(2 * n_split, bool)
        if (depth + 1 < rule["depth"][tree_o[split]]).any():  # else all children are leaves
            side = np.zeros(len(flat_w), bool)
            side[some] = goes
            is_left = side.take(member)
            rank = running(is_left, begin, size_s)  # left rows up to here within the node
            to = np.where(is_left, rank + (begin[seg] - 1), (n_left[seg] + np.arange(member.shape[1])) - rank)
            to += (np.arange(len(member)) * member.shape[1])[:, None]
            moved = np.empty(member.shape, np.int64)
            moved.ravel()[to.ravel()] = member.ravel()
            member = moved
            same = one_target(flat_g, flat_w, member[0], np.cumsum(size) - size, size)
        gs, ws = g_o[split], w_o[split]
        total_g, total_w = np.stack([gl, gs - gl], axis=1).ravel(), np.stack([wl, ws - wl], axis=1).ravel()
        parent = np.repeat(node[open_][split], 2)
        node, tree = count + np.arange(2 * n_split), np.repeat(tree_o[split], 2)
        key = draw(np.repeat(key_o[split].view(np.int64), 2), np.tile([0, 1], n_split)) if drawn else node.view(np.uint64)
        count, depth = count + 2 * n_split, depth + 1
    out = made.arrays()
    return leaf_wise(out, rule) if (rule["leaves"] < NO_LIMIT).any() else out


def chosen(rule: dict, tree: np.ndarray, key: np.ndarray, features: int, seed: int) -> np.ndarray | None:
    """(nodes, features) that may split each node; None: all."""
    per_node, allowed = rule["per_node"], rule["allowed"]
    if (per_node >= features).all():
        return None if allowed.all() else allowed[tree]
    h = draw(key.view(np.int64)[:, None], np.arange(features)[None, :])
    out = np.empty(h.shape, bool)
    for k in np.unique(per_node[tree]):
        at = per_node[tree] == k
        out[at] = first_of(h[at], int(k))
    return out


def best_splits(rows: Rows, member, start, size, flat_g, flat_w, total_g, total_w, rule, may) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, cut and gain of the best split of each node; a gain below zero where there is none.

    ``flat_w`` None: all weights are one.
    """
    width, nodes = member.shape[1], len(start)
    seg = np.repeat(np.arange(nodes), size)
    lanes, dead = None, None
    if may is not None:
        n = int(may.sum(axis=1).max(initial=1))
        if n < rows.features:  # each node's own features only
            lanes = np.argsort(~may, axis=1, kind="stable")[:, :n].T
            if not may.sum(axis=1).min(initial=n) == n:
                dead = ~np.take_along_axis(may, lanes.T, axis=1).T
            lane_of = lanes[:, seg]
            member = member[lane_of, np.arange(width)]
            bin_of = rows.bin_of[member + lane_of * (rows.trees * rows.rows)]
        else:
            dead = None if may.all() else ~may.T
    if lanes is None:
        bin_of = rows.bin_of.take(member + rows.lane)
    g = running(flat_g.take(member), start, size) * (1.0 / SCALE)
    place = np.arange(1, width + 1) - start[seg]  # rows on the left
    w = place if flat_w is None else running(flat_w[member], start, size)
    all_g, all_w = (total_g * (1.0 / SCALE))[seg], total_w[seg]
    leaf, least = rule["leaf"][seg], rule["weight"][seg]
    fits = (place >= leaf) & (size[seg] - place >= leaf)
    fits[start + size - 1] = False
    ok = np.zeros(member.shape, bool)
    ok[:, :-1] = bin_of[:, 1:] != bin_of[:, :-1]
    ok &= fits
    if rule["weight"].any():
        ok &= (w >= least) & (all_w - w >= least)
    if dead is not None:
        ok &= ~np.repeat(dead, size, axis=1)
    l1, l2 = rule["l1"], rule["l2"]
    a, b = g, all_g - g
    if l1.any():
        a, b = shrunk(a, l1[seg]), shrunk(b, l1[seg])
    more = l2[seg]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = a * a / (w + more) + b * b / (all_w - w + more)
    gain[~ok] = -1.0
    top = np.maximum.reduceat(gain, start, axis=1)  # (lanes, nodes)
    lane = np.argmax(top, axis=0)
    best = top[lane, np.arange(nodes)]
    hit = gain[lane[seg], np.arange(width)] == best[seg]
    first = np.minimum.reduceat(np.where(hit, np.arange(width), width), start)
    own = shrunk(total_g * (1.0 / SCALE), l1)
    feature = lane if lanes is None else lanes[lane, np.arange(nodes)]
    return feature, bin_of[lane, first], np.where(best >= 0, best - own * own / (total_w + l2), -1.0)


def leaf_wise(nodes: dict[str, np.ndarray], rule: dict) -> dict[str, np.ndarray]:
    """The trees as best-first growth leaves them: the split of largest gain first, until a tree has its number of leaves.

    A node's split does not depend on other nodes, so picking from the whole
    tree by gain gives the tree that would have grown that way. Ties: the
    smaller node.
    """
    import heapq

    feature = np.full(len(nodes["feature"]), -1)
    left, right, gain, was, tree = (nodes[c].tolist() for c in ("left", "right", "gain", "feature", "tree"))
    for root, limit in enumerate(rule["leaves"].tolist()):
        heap = [(-gain[root], root)] if was[root] >= 0 else []
        leaves = 1
        while heap and leaves < limit:
            _, at = heapq.heappop(heap)
            feature[at] = was[at]
            leaves += 1
            for child in (left[at], right[at]):
                if was[child] >= 0:
                    heapq.heappush(heap, (-gain[child], child))
    split = feature >= 0
    return {**nodes, "feature": feature, "left": np.where(split, nodes["left"], -1), "right": np.where(split, nodes["right"], -1), "gain": np.where(split, nodes["gain"], 0.0)}


def leaf_values(nodes: dict[str, np.ndarray], bins: np.ndarray, trees: int) -> np.ndarray:
    """(trees, rows): the value of the leaf that each row reaches."""
    at = np.repeat(np.arange(trees)[:, None], len(bins), axis=1)
    row = np.arange(len(bins))[None, :]
    feature, cut, left, right = (nodes[c] for c in ("feature", "cut", "left", "right"))
    while True:
        f = feature[at]
        open_ = f >= 0
        if not open_.any():
            return nodes["value"][at]
        at = np.where(open_, np.where(bins[row, f] <= cut[at], left[at], right[at]), at)


def rule_arrays(listed: list[dict], tree: np.ndarray, features: int, seed: int) -> dict[str, np.ndarray]:
    """The rules of trees as arrays; ``tree`` is each tree's number in its model."""
    out = {name: np.array([r[name] for r in listed]) for name in ("depth", "leaf", "split", "weight", "leaves", "l1", "l2", "per_node", "per_tree")}
    out["tree"] = np.asarray(tree)
    h = draw(seed, COLUMNS, out["tree"][:, None], np.arange(features)[None, :])
    out["allowed"] = np.stack([first_of(h[i], int(k)) for i, k in enumerate(out["per_tree"])]) if len(listed) else np.ones((0, features), bool)
    return out


def members(rule: dict, tree: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """(trees, rows): how often each row is drawn for each tree."""
    place = np.arange(rows)[None, :]
    if rule["bagged"]:
        return np.searchsorted(POISSON, share(draw(seed, BAG, tree[:, None], place)), side="right")
    if rule["boosted"] and rule["rows"] < 1 and rule["every"]:
        drawn = tree - tree % rule["every"]
        return (share(draw(seed, ROWS, drawn[:, None], place)) < rule["rows"]).astype(np.int64)
    return np.ones((len(tree), rows), np.int64)


class Unit:
    """Fits of one entity's rows: features, log target, candidates' rules, and the rows that each (candidate, fold) learns from."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fits: list[tuple[dict, np.ndarray]], seed: int, cuts: list[np.ndarray] | None = None):
        self.cuts = cuts_of(x) if cuts is None else cuts
        self.bins = binned(x, self.cuts)
        self.order = np.argsort(self.bins, axis=0, kind="stable").T
        self.y, self.fits, self.seed = y, fits, seed
        self.features = x.shape[1]
        self.rows = Rows(self.order, self.bins, 1)

    def grow(self, listed, tree, weight, target):
        if self.rows.trees != len(listed):
            self.rows = Rows(self.order, self.bins, len(listed))
        return grow(self.rows, weight, target, rule_arrays(listed, tree, self.features, self.seed), self.seed)

    def run(self, keep: bool = False) -> Iterator[tuple[int, np.ndarray, list]]:
        """(fit, forecast of all rows, trees): each tree is (weight, nodes), kept on demand."""
        yield from self.plain(keep)
        yield from self.boosted(keep)

    def plain(self, keep: bool) -> Iterator[tuple[int, np.ndarray, list]]:
        listed = [i for i, (r, _) in enumerate(self.fits) if not r["boosted"]]
        jobs = [(i, t) for i in listed for t in range(self.fits[i][0]["trees"])]
        sums = {i: np.zeros(len(self.y)) for i in listed}
        trees: dict[int, list] = {i: [] for i in listed}
        target = whole(self.y)
        for at in range(0, len(jobs), TREES):
            part = jobs[at:at + TREES]
            rules_ = [self.fits[i][0] for i, _ in part]
            weight = np.concatenate([members(self.fits[i][0], np.array([t]), len(self.y), self.seed) * self.fits[i][1] for i, t in part])
            nodes = self.grow(rules_, np.array([t for _, t in part]), weight, np.broadcast_to(target, weight.shape))
            values = leaf_values(nodes, self.bins, len(part))
            for j, (i, _) in enumerate(part):
                sums[i] += values[j]
                if keep:
                    trees[i].append(one_tree(nodes, j, self.cuts))
        for i in listed:
            n = self.fits[i][0]["trees"]
            yield i, sums[i] / n, [(1.0 / n, t) for t in trees[i]]

    def boosted(self, keep: bool) -> Iterator[tuple[int, np.ndarray, list]]:
        live = [i for i, (r, _) in enumerate(self.fits) if r["boosted"]]
        margin, trees = {}, {i: [] for i in live}
        for i in live:  # a model starts from the mean of what it learns from
            use = self.fits[i][1]
            margin[i] = np.full(len(self.y), (whole(self.y) * use).sum() / SCALE / max(int(use.sum()), 1))
            if keep:
                trees[i].append((1.0, constant(margin[i][0])))
        number = 0
        while live:
            rules_ = [self.fits[i][0] for i in live]
            weight = np.concatenate([members(r, np.array([number]), len(self.y), self.seed) * self.fits[i][1] for i, r in zip(live, rules_)])
            target = np.stack([whole(self.y - margin[i]) for i in live])
            learned = ~(target * np.stack([self.fits[i][1] for i in live])).any(axis=1)  # nothing is left to explain
            if learned.any():
                for i in [i for i, d in zip(live, learned) if d]:
                    live.remove(i)
                    yield i, margin[i], trees[i]
                continue
            nodes = self.grow(rules_, np.full(len(live), number), weight, target)
            values = leaf_values(nodes, self.bins, len(live))
            number += 1
            for j, i in enumerate(live):
                margin[i] = margin[i] + rules_[j]["rate"] * values[j]
                if keep:
                    trees[i].append((rules_[j]["rate"], one_tree(nodes, j, self.cuts)))
            for i in [i for i in live if self.fits[i][0]["trees"] <= number]:
                live.remove(i)
                yield i, margin[i], trees[i]


def constant(value: float) -> dict[str, list]:
    return {"feature": [-1], "threshold": [0.0], "left": [-1], "right": [-1], "value": [float(value)], "gain": [0.0]}


def one_tree(nodes: dict[str, np.ndarray], tree: int, cuts: list[np.ndarray]) -> dict[str, list]:
    """A tree's nodes by themselves, its root first, with thresholds in place of bins; nodes that no row can reach are left out."""
    feature, cut, left, right = (nodes[c] for c in ("feature", "cut", "left", "right"))
    listed, place = [tree], {tree: 0}
    for at in listed:
        if feature[at] >= 0:
            for child in (int(left[at]), int(right[at])):
                place[child] = len(listed)
                listed.append(child)
    f = feature[listed].tolist()
    return {
        "feature": f,
        "threshold": [float(cuts[k][cut[at]]) if k >= 0 else 0.0 for k, at in zip(f, listed)],
        "left": [place[int(left[at])] if k >= 0 else -1 for k, at in zip(f, listed)],
        "right": [place[int(right[at])] if k >= 0 else -1 for k, at in zip(f, listed)],
        "value": nodes["value"][listed].tolist(),
        "gain": nodes["gain"][listed].tolist(),
    }


# --------------------------------------------------------------------------- #
# Spark: units of work
# --------------------------------------------------------------------------- #
PACKED = "entity string, n int, features int, x binary, y binary"


def packed_rows(rows: DataFrame, cols: list[str], y: str) -> DataFrame:
    """(entity, n, features, x, y): each entity's rows in order of period, as one matrix; of entities of at most ``TASK_ROWS`` rows.

    A null feature reads as 0, the training mean on the scaled axis, as in the
    linear models; rows without a target are left out.
    """
    width = len(cols)
    zero = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols]
    flat = rows.select("entity", "period", F.array(*zero).alias("x"), F.col(y).cast("double").alias("y")).where("y is not null")
    known = flat.groupBy("entity").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") <= TASK_ROWS)
    flat = flat.join(known, "entity", "left_semi")

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("period")
        x = np.asarray(table.column("x").combine_chunks().flatten(), float)
        return pa.table({"entity": table.column("entity").slice(0, 1), "n": pa.array([table.num_rows], pa.int32()), "features": pa.array([width], pa.int32()), "x": pa.array([x.tobytes()], pa.binary()), "y": pa.array([np.asarray(table.column("y"), float).tobytes()], pa.binary())})

    return flat.groupBy("entity").applyInArrow(pack, PACKED)


def unpacked(x: bytes, y: bytes, features: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(x, float).reshape(-1, features), np.frombuffer(y, float)


def fold_bounds(n: int, fold: int, splits: int) -> tuple[int, int]:
    """Rows before the first number are learned from, those up to the second are forecast."""
    t = n // (splits + 1)
    start = n - (splits - fold) * t
    return start, start + t


def cv_scores(packed: DataFrame, key: str, candidates: list[dict], splits: int, objective: str, seed: int, block: int) -> DataFrame:
    """(entity, candidate, fold, score) of every candidate on every fold, by units of ``block`` candidates with all their folds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, y = unpacked(row["x"], row["y"], row["features"])
                listed = range(row["unit"] * block, min((row["unit"] + 1) * block, len(candidates)))
                fits, names = [], []
                for c in listed:
                    for fold in range(splits):
                        start, stop = fold_bounds(len(y), fold, splits)
                        fits.append((rules(key, candidates[c], x.shape[1]), (np.arange(len(y)) < start).astype(np.int64)))
                        names.append((c, fold, start, stop))
                out = []
                for i, forecast, _ in Unit(x, y, fits, seed).run():
                    c, fold, start, stop = names[i]
                    a, p = y[start:stop], forecast[start:stop]
                    if objective == "rmse":
                        a, p = (np.maximum(np.expm1(v), 0.0) for v in (a, p))
                    score = float("nan") if start == stop or start == 0 else float(np.sqrt(np.mean((a - p) ** 2)) if objective == "rmse" else np.mean(np.abs(a - p)))
                    out.append((row["entity"], c, fold, score))
                columns = list(zip(*out)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.float64()))], ["entity", "candidate", "fold", "score"])

    units = -(-len(candidates) // block)
    dealt = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("unit"))
    return spread_units(dealt).mapInArrow(run, "entity string, candidate int, fold int, score double")


def spread_units(units: DataFrame) -> DataFrame:
    """Units dealt one by one over the tasks: few rows, each of much work, so ranges and not hashes, which would pair some."""
    spark = units.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
    return units.repartitionByRange(parts, "entity", "unit")


MODEL = "entity string, model_key string, tree int, weight double, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, gain array<double>"


def fit_models(packed: DataFrame, chosen_params: DataFrame, seed: int) -> DataFrame:
    """One row for each tree of each (entity, model_key) of ``chosen_params`` (entity, model_key, params as JSON), fitted on all rows.

    A model's forecast is the sum of weight x leaf value over its trees; boosted
    models have a first tree of one leaf, the mean.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, y = unpacked(row["x"], row["y"], row["features"])
                fits = [(rules(row["model_key"], json.loads(row["params"]), x.shape[1]), np.ones(len(y), np.int64))]
                for _, _, trees in Unit(x, y, fits, seed).run(keep=True):
                    listed = [{"entity": row["entity"], "model_key": row["model_key"], "tree": i, "weight": weight, **tree} for i, (weight, tree) in enumerate(trees)]
                    yield pa.RecordBatch.from_pylist(listed, MODEL_ARROW)

    dealt = packed.join(chosen_params, "entity").withColumn("unit", F.col("model_key"))
    return spread_units(dealt).mapInArrow(run, MODEL)


MODEL_ARROW = pa.schema([("entity", pa.string()), ("model_key", pa.string()), ("tree", pa.int32()), ("weight", pa.float64()), ("feature", pa.list_(pa.int32())), ("threshold", pa.list_(pa.float64())), ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32())), ("value", pa.list_(pa.float64())), ("gain", pa.list_(pa.float64()))])


class Ensemble:
    """The trees of one model as flat arrays."""

    def __init__(self, trees: pa.Table):
        self.weight = np.asarray(trees.column("weight"), float)
        size = np.asarray(pa.compute.list_value_length(trees.column("feature")), np.int64)
        self.root = np.cumsum(size) - size
        flat = lambda c: np.asarray(pa.compute.list_flatten(trees.column(c)))
        move = np.repeat(self.root, size)
        self.feature, self.threshold, self.value = flat("feature"), flat("threshold"), flat("value")
        self.left, self.right = flat("left") + move, flat("right") + move

    def forecast(self, x: np.ndarray) -> np.ndarray:
        """Forecast of the rows of ``x``."""
        at = np.repeat(self.root[:, None], len(x), axis=1)
        row = np.arange(len(x))[None, :]
        while True:
            f = self.feature[at]
            open_ = f >= 0
            if not open_.any():
                return self.weight @ self.value[at]
            at = np.where(open_, np.where(x[row, f] <= self.threshold[at], self.left[at], self.right[at]), at)


SCORE_ROWS = 4096


def predict_models(rows: DataFrame, models: DataFrame, cols: list[str], out: str = "predicted_t") -> DataFrame:
    """The simple columns of ``rows`` beside ``cols``, with (model_key, ``out``) for every tree model of their entity.

    A model meets each block of ``SCORE_ROWS`` rows or so of its entity once;
    rows of an entity without a model go.
    """
    counted = rows.groupBy("entity").agg(F.ceil(F.count(F.lit(1)) / SCORE_ROWS).cast("int").alias("blocks"))
    keys = [f.name for f in rows.schema.fields if f.name not in cols and not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    packed = rows.join(counted, "entity").select(*keys, F.pmod(F.xxhash64("period"), F.col("blocks")).cast("int").alias("block"),
                                                 F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]).alias("x"))
    sent = models.join(counted, "entity").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    width = len(cols)

    def score(block: pa.Table, trees: pa.Table) -> pa.Table:
        x = np.asarray(block.column("x").combine_chunks().flatten(), float).reshape(-1, width) if block.num_rows else np.zeros((0, width))
        fitted, parts = (trees.column("model_key").unique().to_pylist() if block.num_rows else []), []
        for key in fitted:
            own = trees.filter(pa.compute.equal(trees.column("model_key"), key)).sort_by("tree")
            parts.append(pa.table({**{k: block.column(k) for k in keys}, "model_key": pa.array([key] * len(x)), out: pa.array(Ensemble(own).forecast(x))}))
        empty = pa.table({**{k: block.column(k).slice(0, 0) for k in keys}, "model_key": pa.array([], pa.string()), out: pa.array([], pa.float64())})
        return pa.concat_tables([empty, *parts])

    types = "".join(f"`{k}` {packed.schema[k].dataType.simpleString()}, " for k in keys)
    return packed.groupBy("entity", "block").cogroup(sent.select("entity", "block", "model_key", "tree", "weight", "feature", "threshold", "left", "right", "value").groupBy("entity", "block")).applyInArrow(score, f"{types}model_key string, {out} double")


def importances(models: DataFrame) -> DataFrame:
    """(entity, model_key, slot, importance) that sum to one for each model.

    Trees and forests: the share of the error's fall, averaged over trees;
    xgboost: mean gain of a feature's splits; lightgbm: number of splits.
    """
    node = models.select("entity", "model_key", "tree", F.explode(F.arrays_zip("feature", "gain")).alias("n")).where("n.feature >= 0")
    by_tree = node.groupBy("entity", "model_key", "tree", F.col("n.feature").alias("slot")).agg(F.sum("n.gain").alias("gain"), F.count(F.lit(1)).alias("splits"))
    whole_tree = by_tree.groupBy("entity", "model_key", "tree").agg(F.sum("gain").alias("all"))
    parts = by_tree.join(whole_tree, ["entity", "model_key", "tree"]).groupBy("entity", "model_key", "slot").agg(F.sum(F.col("gain") / F.col("all")).alias("share"), F.sum("gain").alias("gain"), F.sum("splits").alias("splits"))
    raw = F.when(F.col("model_key") == "xgboost", F.col("gain") / F.col("splits")).when(F.col("model_key") == "lightgbm", F.col("splits").cast("double")).otherwise(F.col("share"))
    parts = parts.select("entity", "model_key", "slot", raw.alias("raw"))
    total = parts.groupBy("entity", "model_key").agg(F.sum("raw").alias("total"))
    return parts.join(total, ["entity", "model_key"]).select("entity", "model_key", "slot", (F.col("raw") / F.col("total")).alias("importance"))
