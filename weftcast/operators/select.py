"""Feature selection by mutual information (#13, #19, #49, #52, #53).

Kraskov-Stoegbauer-Grassberger estimator (k = 3), as scikit-learn's
``mutual_info_regression`` computes it, re-expressed as Spark jobs:

1. long form (entity, feature, rid, x, y): x and y scaled by their population
   std, plus a deterministic tie-breaking jitter of order 1e-10 (the library
   draws it from a seeded RNG; ours is an integer hash of (row, feature) so
   any engine reproduces it);
2. eps_i = Chebyshev distance to the k-th nearest neighbour, found EXACTLY by
   a grid equi-join: points are bucketed into square cells of side h and
   every query point meets only the points of its 3 x 3 cell block.  All
   points within distance h lie in that block, so a query with >= k
   candidates at distance <= h is resolved exactly; the others retry with 2h.
   Pairs are emitted only between neighbouring cells, never all pairs of a
   group;
3. nx_i / ny_i = points strictly within eps_i along x / y, counted without
   pairs: thresholds x_i +- eps_i are merged with the data values in one sort
   per (entity, feature) and read off a running count;
4. MI = psi(n) + psi(k) - <psi(nx + 1)> - <psi(ny + 1)>, floored at 0, with
   psi(m) = H(m - 1) - gamma for integers (harmonic numbers, gamma cancels).
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import harmonic
from ..session import cut_lineage

JITTER = 1e-10
EPS_SHRINK = 1.0 - 1e-9  # strict "< eps": neighbours at exactly eps stay out


def jitter(rid, fidx) -> F.Column:
    """Deterministic value in [-1, 1) from (row, feature): two LCG steps on BIGINT."""
    a = (rid.cast("long") * 1103515245 + (fidx.cast("long") + 7) * 12345 + 12345) % 2147483648
    b = (a * 1103515245 + 12345) % 2147483648
    return b.cast("double") / 1073741824.0 - 1.0


def mi_points(df: DataFrame, entity: str, period: str, target_t: str, features: list[str]) -> DataFrame:
    """(entity, feature, feature_idx, rid, n, x, y) with scaling and jitter applied."""
    w = Window.partitionBy(entity).orderBy(period)
    base = df.select(entity, F.row_number().over(w).alias("rid"), F.col(target_t).cast("double").alias("y0"),
                     *[F.col(c).cast("double").alias(c) for c in features])
    args = [F.lit(len(features))]
    for i, c in enumerate(features):
        args += [F.lit(c), F.lit(i), F.col(c)]
    long = base.select(entity, "rid", "y0", F.stack(*args).alias("feature", "feature_idx", "x0"))
    g = Window.partitionBy(entity, "feature")
    sx = F.stddev_pop("x0").over(g)
    sy = F.stddev_pop("y0").over(g)
    xs = F.col("x0") / F.coalesce(F.when(sx != 0, sx), F.lit(1.0))
    ys = F.col("y0") / F.coalesce(F.when(sy != 0, sy), F.lit(1.0))
    scaled = long.select(entity, "feature", "feature_idx", "rid", xs.alias("xs"), ys.alias("ys"),
                         F.count(F.lit(1)).over(g).alias("n"))
    mx = F.greatest(F.lit(1.0), F.avg(F.abs("xs")).over(g))
    my = F.greatest(F.lit(1.0), F.avg(F.abs("ys")).over(g))
    return scaled.select(
        entity, "feature", "feature_idx", "rid", "n",
        (F.col("xs") + F.lit(JITTER) * mx * jitter(F.col("rid"), F.col("feature_idx"))).alias("x"),
        (F.col("ys") + F.lit(JITTER) * my * jitter(F.col("rid"), F.lit(-1))).alias("y"))


_OFFSETS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]


def knn_radius(points: DataFrame, entity: str, k: int = 3) -> DataFrame:
    """Exact Chebyshev distance to the k-th neighbour: (entity, feature, rid, eps).

    Cells double until every point is resolved; there is no round limit.
    """
    keys = [entity, "feature"]
    # initial cell side: about k points expected in a query's radius-h box for
    # standardized data spread over a few units; refined by doubling.
    pts = points.select(*keys, "rid", "x", "y", "n",
                        (F.lit(6.0) * F.sqrt(F.lit(float(k)) / F.col("n"))).alias("h0")).cache()
    unresolved = pts.filter(F.col("n") > k).select(*keys, "rid", "x", "y", "h0")
    found = None
    for r in count():
        scale = float(2 ** r)
        h = F.col("h0") * scale
        cells = pts.select(*keys, F.col("rid").alias("rid_b"), F.col("x").alias("x_b"), F.col("y").alias("y_b"),
                           F.floor(F.col("x") / h).alias("cx"), F.floor(F.col("y") / h).alias("cy"))
        offs = F.array(*[F.struct(F.lit(a).alias("ox"), F.lit(b).alias("oy")) for a, b in _OFFSETS])
        q = unresolved.select(*keys, "rid", "x", "y", h.alias("h"), F.explode(offs).alias("o"))
        q = q.select(*keys, "rid", "x", "y", "h",
                     (F.floor(F.col("x") / F.col("h")) + F.col("o.ox")).alias("cx"),
                     (F.floor(F.col("y") / F.col("h")) + F.col("o.oy")).alias("cy"))
        cand = q.join(cells, [*keys, "cx", "cy"]).filter(F.col("rid") != F.col("rid_b"))
        d = F.greatest(F.abs(F.col("x") - F.col("x_b")), F.abs(F.col("y") - F.col("y_b")))
        cand = cand.select(*keys, "rid", d.alias("d"), "h").filter(F.col("d") <= F.col("h"))
        w = Window.partitionBy(*keys, "rid").orderBy("d")
        res = cand.select(*keys, "rid", "d", F.row_number().over(w).alias("rn")) \
                  .filter(F.col("rn") == k).select(*keys, "rid", F.col("d").alias("eps"))
        # cached rounds; a reliable checkpoint every few rounds bounds the lineage
        res = cut_lineage(res) if r % 4 == 3 else res.cache()
        found = res if found is None else found.unionByName(res)
        nxt = unresolved.join(res.select(*keys, "rid"), [*keys, "rid"], "left_anti")
        unresolved = cut_lineage(nxt) if r % 4 == 3 else nxt.cache()
        left = unresolved.count()
        if left == 0:
            break
    pts.unpersist()
    return cut_lineage(found)


def marginal_counts(points: DataFrame, eps: DataFrame, entity: str) -> DataFrame:
    """nx, ny = #points strictly within eps of the query along x / y (self excluded), no pairs."""
    keys = [entity, "feature"]
    q = points.join(eps, [*keys, "rid"]).select(*keys, "rid", "x", "y",
                                                (F.col("eps") * F.lit(EPS_SHRINK)).alias("e"))
    ev = []
    for dim in ("x", "y"):
        v = F.col(dim)
        ev.append(points.select(*keys, F.lit(dim).alias("dim"), v.alias("v"), F.lit(1).alias("t"),
                                F.lit(None).cast("int").alias("rid")))
        ev.append(q.select(*keys, F.lit(dim).alias("dim"), (v + F.col("e")).alias("v"), F.lit(0).alias("t"), "rid"))
        ev.append(q.select(*keys, F.lit(dim).alias("dim"), (v - F.col("e")).alias("v"), F.lit(2).alias("t"), "rid"))
    events = ev[0]
    for e in ev[1:]:
        events = events.unionByName(e)
    w = Window.partitionBy(*keys, "dim").orderBy("v", "t").rowsBetween(Window.unboundedPreceding, 0)
    run = events.select(*keys, "dim", "t", "rid", F.sum((F.col("t") == 1).cast("int")).over(w).alias("c"))
    run = run.filter(F.col("t") != 1)
    hi = lambda dim: F.max(F.when((F.col("dim") == dim) & (F.col("t") == 0), F.col("c")))
    lo = lambda dim: F.max(F.when((F.col("dim") == dim) & (F.col("t") == 2), F.col("c")))
    return run.groupBy(*keys, "rid").agg((hi("x") - lo("x") - 1).alias("nx"), (hi("y") - lo("y") - 1).alias("ny"))


def mutual_info_ksg(df: DataFrame, entity: str, period: str, target_t: str, features: list[str],
                    k: int = 3) -> DataFrame:
    """#49: MI(feature; target) per (entity, feature): (entity, feature, feature_idx, n, mi)."""
    pts = cut_lineage(mi_points(df, entity, period, target_t, features))
    eps = knn_radius(pts, entity, k)
    cnt = marginal_counts(pts, eps, entity)
    meta = pts.groupBy(entity, "feature").agg(F.first("feature_idx").alias("feature_idx"), F.first("n").alias("n"))
    agg = cnt.groupBy(entity, "feature").agg(F.avg(harmonic("nx")).alias("hx"), F.avg(harmonic("ny")).alias("hy"))
    out = meta.join(agg, [entity, "feature"], "left")
    mi = harmonic(F.col("n") - 1) + harmonic(F.lit(k - 1)) - F.col("hx") - F.col("hy")
    return out.select(entity, "feature", "feature_idx", "n",
                      F.when(F.col("n") > k, F.greatest(mi, F.lit(0.0))).alias("mi"))


def select_top_k(scores: DataFrame, entity: str, k: int = 30, enabled: bool = True) -> DataFrame:
    """#52: top-k features per entity by MI; (entity, feature, feature_idx, mi, selected, sel_order).

    Ties go to the later column (scikit-learn's stable argsort keeps the last
    k); ``k = min(k, #features)``; disabled selection keeps every feature.
    Output order of the selected set is the original column order.
    """
    w = Window.partitionBy(entity).orderBy(F.col("mi").desc_nulls_last(), F.col("feature_idx").desc())
    sel = (F.row_number().over(w) <= k) if enabled else F.lit(True)
    ranked = scores.select("*", sel.alias("selected"))
    w2 = Window.partitionBy(entity, "selected").orderBy("feature_idx")
    return ranked.select("*", F.when(F.col("selected"), F.row_number().over(w2)).alias("sel_order"))


def mi_score_ranking(scores: DataFrame, selected: DataFrame, entity: str, top: int = 30) -> DataFrame:
    """#53: MI scores in descending order, top ``top`` per entity, with the selected flag."""
    w = Window.partitionBy(entity).orderBy(F.col("mi").desc_nulls_last(), F.col("feature_idx").desc())
    flags = selected.select(entity, "feature", "selected")
    r = scores.join(flags, [entity, "feature"]).select("*", F.row_number().over(w).alias("mi_rank"))
    return r.filter(F.col("mi_rank") <= top)


def align_selected(long_rows: DataFrame, selected: DataFrame, entity: str) -> DataFrame:
    """#13: keep only the fitted selection, in fitted order (long form semi-join).

    Raises if no selection has been fitted, like the reference's transform-before-fit error.
    """
    if selected is None:
        raise RuntimeError("align_selected called before a selection was fitted")
    sel = selected.filter(F.col("selected")).select(entity, "feature", "sel_order")
    return long_rows.join(sel, [entity, "feature"], "inner")
