"""Trees of entities too long for one task: one aggregation a level over all their rows.

The same trees as ``forest``: whole-number sums by (entity, fit, tree, node,
feature, bin) are added up by Spark, running sums over the bins give each cut's
sides, and the best cut of each node comes from a two-step minimum, by feature
and then by node. A fit is a candidate with the rows that it learns from; all
trees of all fits of all entities grow in the same jobs, so jobs grow with depth
(and, boosted, with rounds) only. No task holds an entity: histograms have at
most ``forest.MAX_BINS`` bins a feature.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..spec import PanelSpec
from . import forest
from .blocked import POS, row_positions

try:  # as in ``forest``
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
except ImportError:  # pragma: no cover
    pass

KEYS = ["entity", "fit", "tree"]
RULES = "fit int, leaf long, split long, weight double, depth long, l1 double, l2 double, per_node int, per_tree int, bagged boolean, boosted boolean, rows double, every int, trees int"


def long_entities(rows: DataFrame, task_rows: int) -> DataFrame:
    """(entity, n) of the entities with more than ``task_rows`` rows."""
    return rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > task_rows)


def binned_rows(rows: DataFrame, cols: list[str], y: str) -> tuple[DataFrame, DataFrame]:
    """(entity, period, pos, n, y, bins) of ``rows`` and (entity, cuts): cuts come from at most ``forest.TASK_ROWS`` rows or so, drawn by hash."""
    zero = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]
    flat = rows.select("entity", "period", F.array(*zero).alias("x"), F.col(y).cast("double").alias("y")).where("y is not null")
    counts = flat.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    flat = cut_lineage(row_positions(flat, PanelSpec()).withColumnRenamed(POS, "pos").join(counts, "entity"))
    width = len(cols)

    def matrix(table: pa.Table) -> np.ndarray:
        return np.asarray(table.column("x").combine_chunks().flatten(), float).reshape(-1, width)

    def cuts(table: pa.Table) -> pa.Table:
        found = forest.cuts_of(matrix(table))
        return pa.table({"entity": table.column("entity").slice(0, 1), "cuts": pa.array([[c.tolist() for c in found]], pa.list_(pa.list_(pa.float64())))})

    def bins(table: pa.Table, known: pa.Table) -> pa.Table:
        out = table.select(["entity", "period", "pos", "n", "y"])
        made = forest.binned(matrix(table), [np.array(c) for c in known.column("cuts")[0].as_py()]) if table.num_rows else np.zeros((0, width), np.int32)
        return out.append_column("bins", pa.array(list(made), pa.list_(pa.int32())))

    drawn = F.shiftrightunsigned(F.xxhash64("entity", "pos"), 11) * F.lit(2.0 ** -53) < F.lit(float(forest.TASK_ROWS)) / F.col("n")
    known = cut_lineage(flat.where(drawn).select("entity", "x").groupBy("entity").applyInArrow(cuts, "entity string, cuts array<array<double>>"))
    blocks = F.ceil(F.col("n") / forest.SCORE_ROWS).cast("int")
    dealt = flat.withColumn("block", F.pmod(F.col("pos"), blocks).cast("int"))
    sent = known.join(counts, "entity").select("entity", "cuts", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    period = flat.schema["period"].dataType.simpleString()
    made = dealt.groupBy("entity", "block").cogroup(sent.groupBy("entity", "block")).applyInArrow(bins, f"entity string, period {period}, pos long, n long, y double, bins array<int>")
    return cut_lineage(made), known


def share(*longs: Column) -> Column:
    """``forest.share`` of ``forest.draw``."""
    return F.shiftrightunsigned(F.xxhash64(*[c.cast("long") for c in longs]), 11) * F.lit(2.0 ** -53)


def whole(x: Column) -> Column:
    return F.floor(x * forest.SCALE + 0.5).cast("long")


def shrunk(g: Column, l1: Column) -> Column:
    return g - F.greatest(F.least(g, l1), -l1)


def first_features(seed: list[Column], k: Column, features: int) -> Column:
    """The ``k`` features of smallest hash."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda f: F.struct(F.concat(F.lpad(F.hex(F.xxhash64(*[s.cast("long") for s in seed], f.cast("long"))), 16, "0")).alias("h"), f.alias("f")))
    return F.transform(F.slice(F.array_sort(drawn), F.lit(1), k), lambda s: s["f"])


def grow_levels(state: DataFrame, rules: DataFrame, seed: int, features: int) -> DataFrame:
    """Nodes (entity, fit, tree, node, feature, cut, left, right, value, gain) of every tree of ``state`` (entity, fit, tree, bins, w, g).

    ``rules`` (``RULES``) has one row for each fit; node keys are hashes of the way from the root.
    """
    rule = F.broadcast(rules)  # one row for each candidate and fold
    lit = lambda v: F.lit(v).cast("long")
    state = state.where("w > 0").withColumn("node", F.xxhash64(lit(seed), lit(forest.NODE), F.col("tree").cast("long")))
    made, depth = [], 0
    while True:
        state = cut_lineage(state)
        totals = state.groupBy(*KEYS, "node").agg(F.sum(F.col("w") * F.col("g")).alias("G"), F.sum("w").alias("W"), F.count(F.lit(1)).alias("C"))
        nodes = totals.join(rule, "fit")
        total = F.col("G") * (1.0 / forest.SCALE)
        own = shrunk(total, F.col("l1"))
        nodes = nodes.select(*KEYS, "node", "G", "W", "C", "leaf", "weight", "l1", "l2", "per_node", "per_tree", "boosted", (own / (F.col("W") + F.col("l2"))).alias("value"), (own * own / (F.col("W") + F.col("l2"))).alias("score"),
                             ((F.col("C") >= F.greatest("split", 2 * F.col("leaf"))) & (F.col("depth") > depth)).alias("open"))
        nodes = cut_lineage(nodes)
        may = F.when(F.col("boosted"), first_features([lit(seed), lit(forest.COLUMNS), F.col("tree")], F.col("per_tree"), features)).otherwise(first_features([F.col("node")], F.col("per_node"), features))
        may = F.when((F.col("per_node") >= features) & (F.col("per_tree") >= features), F.sequence(F.lit(0), F.lit(features - 1))).otherwise(may)
        open_ = nodes.where("open").withColumn("may", may)
        inside = state.join(open_.select(*KEYS, "node", "may"), [*KEYS, "node"])
        cell = inside.select(*KEYS, "node", "w", "g", F.explode(F.transform("may", lambda f: F.struct(f.alias("feature"), F.get("bins", f).alias("bin")))).alias("b"))
        hist = cell.groupBy(*KEYS, "node", F.col("b.feature").alias("feature"), F.col("b.bin").alias("bin")).agg(F.sum(F.col("w") * F.col("g")).alias("g"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("c"))
        run = Window.partitionBy(*KEYS, "node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        sides = hist.select(*KEYS, "node", "feature", "bin", F.sum("g").over(run).alias("gl"), F.sum("w").over(run).alias("wl"), F.sum("c").over(run).alias("cl"))
        sides = sides.join(open_.drop("may", "boosted", "open", "value"), [*KEYS, "node"]).where("cl >= leaf and C - cl >= leaf and wl >= weight and W - wl >= weight and cl < C")
        gl = F.col("gl") * (1.0 / forest.SCALE)
        a, b = shrunk(gl, F.col("l1")), shrunk(total - gl, F.col("l1"))
        gain = a * a / (F.col("wl") + F.col("l2")) + b * b / (F.col("W") - F.col("wl") + F.col("l2"))
        best = F.min(F.struct((-gain).alias("m"), F.col("feature").alias("feature"), F.col("bin").alias("cut")))
        splits = sides.groupBy(*KEYS, "node").agg(best.alias("s"))
        found = nodes.join(splits, [*KEYS, "node"], "left")
        gain = -F.col("s.m") - F.col("score")
        split = F.coalesce(gain > forest.LEAST_GAIN, F.lit(False))
        side = lambda i: F.when(split, F.xxhash64("node", lit(i)))
        level = cut_lineage(found.select(*KEYS, "node", F.when(split, F.col("s.feature")).otherwise(-1).alias("feature"), F.when(split, F.col("s.cut")).otherwise(0).alias("cut"), side(0).alias("left"), side(1).alias("right"), "value", F.when(split, gain).otherwise(0.0).alias("gain"), F.lit(depth).alias("depth")))
        made.append(level)
        on = level.where("feature >= 0")
        if not on.take(1):
            return reduce(DataFrame.unionByName, made)
        goes = F.get("bins", F.col("feature")) <= F.col("cut")
        state = state.join(on.select(*KEYS, "node", "feature", "cut", "left", "right"), [*KEYS, "node"]).select(*KEYS, "bins", "w", "g", F.when(goes, F.col("left")).otherwise(F.col("right")).alias("node"))
        depth += 1


def tree_rows(nodes: DataFrame, cuts: DataFrame, weight: Column, leaves: dict[int, int]) -> DataFrame:
    """``forest.MODEL`` rows of grown nodes, model_key being the fit; ``leaves``: the best-first limit of each fit."""
    def build(table: pa.Table, known: pa.Table) -> pa.Table:
        parts = []
        if table.num_rows:
            at = [np.array(c) for c in known.column("cuts")[0].as_py()]
            names = list(zip(table.column("fit").to_pylist(), table.column("tree").to_pylist()))
            by: dict[tuple, list[int]] = {}
            for i, name in enumerate(names):
                by.setdefault(name, []).append(i)
            for (fit, tree), listed in by.items():
                part = table.take(pa.array(listed)).sort_by("depth")
                place = {k: i for i, k in enumerate(part.column("node").to_pylist())}
                child = lambda c: np.array([place.get(k, -1) for k in part.column(c).to_pylist()])
                one = {c: np.asarray(part.column(c)) for c in ("feature", "cut", "value", "gain")} | {"left": child("left"), "right": child("right"), "tree": np.zeros(len(listed), np.int64)}
                if leaves.get(fit, forest.NO_LIMIT) < forest.NO_LIMIT:
                    one = forest.leaf_wise(one, {"leaves": np.array([leaves[fit]])})
                parts.append({"entity": part.column("entity")[0].as_py(), "model_key": str(fit), "tree": tree, "weight": part.column("weight")[0].as_py(), **forest.one_tree(one, 0, at)})
        return pa.Table.from_pylist(parts, forest.MODEL_ARROW)

    return nodes.withColumn("weight", weight).groupBy("entity").cogroup(cuts.groupBy("entity")).applyInArrow(build, forest.MODEL)


def fit_levels(rows: DataFrame, cols: list[str], y: str, fits: list[tuple[dict, tuple[int, int] | None]], seed: int) -> DataFrame:
    """Trees (``forest.MODEL``, model_key the number of the fit) of ``fits``: rules, and (fold, splits) or None for all rows."""
    data, cuts = binned_rows(rows, cols, y)
    spark, features = data.sparkSession, len(cols)
    listed = [(i, *[r[c] for c in ("leaf", "split", "weight", "depth", "l1", "l2", "per_node", "per_tree", "bagged", "boosted", "rows", "every", "trees")]) for i, (r, _) in enumerate(fits)]
    rules = spark.createDataFrame(listed, RULES)
    folds = spark.createDataFrame([(i, *(f or (None, None))) for i, (_, f) in enumerate(fits)], "fit int, fold int, splits int")
    t = F.floor(F.col("n") / (F.col("splits") + 1))
    used = data.join(F.broadcast(folds.join(rules.select("fit", "boosted", "bagged", "rows", "every", "trees"), "fit")), F.lit(True)).where(F.col("fold").isNull() | (F.col("pos") < F.col("n") - (F.col("splits") - F.col("fold")) * t))
    lit = lambda v: F.lit(v).cast("long")
    leaves = {i: r["leaves"] for i, (r, _) in enumerate(fits)}
    out = []
    if any(not r["boosted"] for r, _ in fits):
        each = used.where("not boosted").select("entity", "fit", "pos", "bins", "bagged", whole(F.col("y")).alias("g"), F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"))
        u = share(lit(seed), lit(forest.BAG), F.col("tree"), F.col("pos"))
        drawn = F.size(F.filter(F.array(*[F.lit(float(p)) for p in forest.POISSON]), lambda p: p <= u))
        state = each.select(*KEYS, "bins", F.when(F.col("bagged"), drawn).otherwise(1).cast("long").alias("w"), "g")
        nodes = grow_levels(state, rules, seed, features)
        counts = F.create_map(*[F.lit(v) for i, (r, _) in enumerate(fits) for v in (i, 1.0 / r["trees"])])
        out.append(tree_rows(nodes, cuts, counts[F.col("fit")], leaves))
    if any(r["boosted"] for r, _ in fits):
        rates = F.create_map(*[F.lit(v) for i, (r, _) in enumerate(fits) for v in (i, r["rate"])])
        learn = cut_lineage(used.where("boosted").select("entity", "fit", "pos", "bins", "y", "rows", "every", "trees"))
        base = learn.groupBy("entity", "fit").agg((F.sum(whole(F.col("y"))) * (1.0 / forest.SCALE) / F.count(F.lit(1))).alias("base"))
        one = lambda c: F.array(F.lit(c))
        out.append(base.select("entity", F.col("fit").cast("string").alias("model_key"), F.lit(0).alias("tree"), F.lit(1.0).alias("weight"), one(-1).alias("feature"), one(0.0).alias("threshold"), one(-1).alias("left"), one(-1).alias("right"), F.array("base").alias("value"), one(0.0).alias("gain")))
        margin = learn.join(base, ["entity", "fit"]).withColumnRenamed("base", "margin")
        for number in range(max(r["trees"] for r, _ in fits if r["boosted"])):
            margin = cut_lineage(margin.where(F.col("trees") > number))
            drawn = lit(number) - F.when(F.col("every") > 0, F.pmod(lit(number), F.col("every"))).otherwise(0)
            inside = (F.col("rows") >= 1) | (F.col("every") == 0) | (share(lit(seed), lit(forest.ROWS), drawn, F.col("pos")) < F.col("rows"))
            state = margin.select("entity", "fit", F.lit(number).alias("tree"), "bins", inside.cast("long").alias("w"), whole(F.col("y") - F.col("margin")).alias("g"))
            grown = cut_lineage(tree_rows(grow_levels(state, rules, seed, features), cuts, rates[F.col("fit")], leaves).withColumn("tree", F.lit(number + 1)))
            out.append(grown)
            margin = next_margin(margin, grown, cuts)
    return reduce(DataFrame.unionByName, out)


def next_margin(margin: DataFrame, grown: DataFrame, cuts: DataFrame) -> DataFrame:
    """Margins after a round's trees: rows are walked down their bins, a level a step."""
    bin_cut = F.transform(F.arrays_zip("feature", "threshold"), lambda n: F.when(n["feature"] >= 0, F.array_position(F.get("cuts", n["feature"]), n["threshold"]) - 1).otherwise(0))
    trees = grown.join(cuts, "entity").select("entity", F.col("model_key").cast("int").alias("fit"), "weight", "feature", "left", "right", "value", bin_cut.alias("cut"))
    deepest = trees.agg(F.max(F.size("feature"))).first()[0] or 1
    step = lambda at: F.when(F.get("feature", at) < 0, at).when(F.get("bins", F.get("feature", at)) <= F.get("cut", at), F.get("left", at)).otherwise(F.get("right", at))
    walked = margin.join(trees, ["entity", "fit"])
    leaf = F.aggregate(F.sequence(F.lit(1), F.lit(deepest)), F.lit(0), lambda at, _: step(at))
    return walked.select(*margin.columns[:-1], (F.col("margin") + F.col("weight") * F.get("value", leaf)).alias("margin"))


def cv_scores(rows: DataFrame, cols: list[str], y: str, key: str, candidates: list[dict], splits: int, objective: str, seed: int) -> DataFrame:
    """``forest.cv_scores`` of long entities."""
    names = [(c, f) for c in range(len(candidates)) for f in range(splits)]
    models = cut_lineage(fit_levels(rows, cols, y, [(forest.rules(key, candidates[c], len(cols)), (f, splits)) for c, f in names], seed))
    where = row_positions(rows.where(F.col(y).isNotNull()), PanelSpec()).withColumnRenamed(POS, "pos").join(rows.where(F.col(y).isNotNull()).groupBy("entity").agg(F.count(F.lit(1)).alias("n")), "entity")
    forecast = forest.predict_models(where, models, cols)
    fit = F.col("model_key").cast("int")
    t = F.floor(F.col("n") / (splits + 1))
    fold, candidate = fit % splits, F.floor(fit / splits).cast("int")
    start = F.col("n") - (splits - fold) * t
    valid = forecast.where((F.col("pos") >= start) & (F.col("pos") < start + t))
    if objective == "rmse":
        a, p = (F.greatest(F.expm1(c), F.lit(0.0)) for c in (y, "predicted_t"))
        score = F.sqrt(F.avg((a - p) * (a - p)))
    else:
        score = F.avg(F.abs(F.col(y) - F.col("predicted_t")))
    return valid.groupBy("entity", candidate.alias("candidate"), fold.cast("int").alias("fold")).agg(score.alias("score"))


def fit_models(rows: DataFrame, cols: list[str], y: str, params: DataFrame, seed: int) -> DataFrame:
    """``forest.fit_models`` of long entities: models of the same parameters are fitted together."""
    import json

    listed = [(r.model_key, r.params) for r in params.select("model_key", "params").distinct().collect()]  # candidates, not rows
    if not listed:
        return rows.sparkSession.createDataFrame([], forest.MODEL)
    grown = fit_levels(rows, cols, y, [(forest.rules(k, json.loads(p), len(cols)), None) for k, p in listed], seed)
    names = rows.sparkSession.createDataFrame([(str(i), k, p) for i, (k, p) in enumerate(listed)], "fit string, model_key string, params string")
    known = params.select("entity", "model_key", "params").join(F.broadcast(names), ["model_key", "params"])
    return grown.withColumnRenamed("model_key", "fit").join(known, ["entity", "fit"]).select("entity", "model_key", *[c.split(" ")[0] for c in forest.MODEL.split(", ")[2:]])
