"""URL filters by a path-template tree, in built-in functions only.

Per host, paths become templates: segments that vary (a digit in them, or rare
values at a node of many children) become wildcards. Each node of the tree, from
the host down, carries counts of labelled block and allow urls. Walking down a
template, a branch whose labelled rate does not differ from what is above it is
merged into it. A template is rejected by the smoothed labelled purity of the
branch it ends in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftcast.session import cut_lineage

#: Rules (host, path, verdict) of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Words that label a url as one to block when a part of its host holds them.
BLOCK_WORDS = ["adult", "ads", "bet", "bets", "casino", "pills", "porn", "spam", "track", "xxx"]
MIN_CHILDREN = 8  # a node with fewer different children keeps them apart
RARE = 0.02  # a child with a smaller share of such a node is a value of a variable
PRIOR_ROWS = 2.0  # weight of the prior in a smoothed purity
UNLABELLED = 0.25  # an unlabelled url counts as so much of an allowed one
Z = 1.96  # two rates differ from here on
REJECT = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null. ``rules`` is a configured list, held in the plan."""
    fits = lambda r: ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1])
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r[0] + r[1])):
        out = F.when(fits(r), F.struct(F.lit(r[0] + r[1]).alias("rule"), F.lit(r[2]).alias("verdict"))).otherwise(out)
    return out


def templates(urls: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with ``nodes``: the template prefixes of the path, from the host's root down.

    Digits make a segment variable at once; of the others, rare children of a
    node with many different children are variable too.
    """
    segments = F.filter(F.split(F.regexp_replace("path", r"\.[A-Za-z0-9]{1,5}$", ""), "/"), lambda s: s != "")
    plain = F.transform(segments, lambda s: F.when(s.rlike("[0-9]"), "*").otherwise(F.lower(s)))
    shaped = urls.withColumn("plain", plain).withColumn("parents", F.transform("plain", lambda s, i: F.concat_ws("/", F.slice(F.col("plain"), F.lit(1), i))))
    # counts of children by distinct path first: one row for each (host, path shape)
    shapes = shaped.groupBy("host", "plain", "parents").agg(F.count(F.lit(1)).alias("n"))
    children = shapes.select("host", "n", F.explode(F.arrays_zip(F.col("parents").alias("parent"), F.col("plain").alias("child"))).alias("e")).groupBy("host", "e.parent", "e.child").agg(F.sum("n").alias("n"))
    wide = children.groupBy("host", "parent").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("total")).where(F.col("children") >= MIN_CHILDREN)
    rare = children.join(wide, ["host", "parent"]).where(F.col("n") < RARE * F.col("total")).select("host", "parent", "child")
    pairs = shapes.select("host", "plain", F.posexplode(F.arrays_zip(F.col("parents").alias("parent"), F.col("plain").alias("child"))).alias("at", "e")).select("host", "plain", "at", "e.parent", "e.child")
    marked = pairs.join(rare.withColumn("rare", F.lit(True)), ["host", "parent", "child"], "left")
    names = F.transform(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("rare"), "*").otherwise(F.col("child")).alias("name")))), lambda s: s["name"])
    renamed = marked.groupBy("host", "plain").agg(names.alias("names"))
    nodes = F.concat(F.array(F.lit("")), F.transform("names", lambda s, i: F.concat(F.lit("/"), F.concat_ws("/", F.slice(F.col("names"), F.lit(1), i + 1)))))
    known = shapes.select("host", "plain").join(renamed, ["host", "plain"], "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>"))).select("host", "plain", nodes.alias("nodes"))
    return shaped.join(known, ["host", "plain"]).drop("plain", "parents")


def purity(blocked: Column, allowed: Column, unlabelled: Column, prior: Column) -> Column:
    """The smoothed share of labelled block urls."""
    return (blocked + PRIOR_ROWS * prior) / (blocked + allowed + UNLABELLED * unlabelled + PRIOR_ROWS)


def branch_purity(path: Column) -> Column:
    """The smoothed purity of the branch that a template ends in, of its nodes' counts from the root down.

    A node stays with what is above it unless a two-proportion test tells their
    labelled rates apart; the unlabelled count with their small weight. A node
    without any label is a branch of its own, with what is above as its prior.
    """
    size = lambda s: s["b"] + s["a"] + UNLABELLED * s["u"]
    rate = lambda s: s["b"] / F.greatest(size(s), F.lit(1e-9))

    def step(state: Column, node: Column) -> Column:
        top = state["top"]
        n1, n2 = F.greatest(size(top), F.lit(1e-9)), F.greatest(size(node), F.lit(1e-9))
        pooled = (top["b"] + node["b"]) / (n1 + n2)
        spread = pooled * (1 - pooled) * (1 / n1 + 1 / n2)
        gap = rate(top) - rate(node)
        apart = (gap * gap > Z * Z * spread) | (node["b"] + node["a"] == 0)
        return F.struct(F.when(apart, node).otherwise(top).alias("top"), F.when(apart, purity(top["b"], top["a"], top["u"], state["prior"])).otherwise(state["prior"]).alias("prior"))

    begin = F.struct(path[0].alias("top"), F.lit(0.0).alias("prior"))
    return F.aggregate(F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))), begin, step, lambda s: purity(s["top"]["b"], s["top"]["a"], s["top"]["u"], s["prior"]))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, block_words: list[str] = BLOCK_WORDS, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for each row of ``pages``.

    Labelled are urls that a rule fits, and those with a word of ``block_words``
    in their host. The rule's verdict stands; other urls are blocked if the
    purity of their branch is REJECT or more. Null urls and urls without
    ``://`` have empty host and path and are judged like any other; null and
    repeated keys keep their rows; no rows give no rows; other columns are not
    read.
    """
    host, path = split_url(F.col(url))
    parsed = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    bad = F.arrays_overlap(F.split("host", "[.-]"), F.array(*[F.lit(w) for w in block_words])) if block_words else F.lit(False)
    label = F.when(F.col("r").isNotNull(), F.col("r.verdict")).when(bad, "block")
    shaped = cut_lineage(templates(parsed).withColumn("r", rule).withColumn("label", label))
    count = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    leaves = shaped.groupBy("host", "nodes").agg(count(F.col("label") == "block").alias("b"), count(F.col("label") == "allow").alias("a"), count(F.col("label").isNull()).alias("u"))
    tree = leaves.select("host", F.explode("nodes").alias("node"), "b", "a", "u").groupBy("host", "node").agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.sum("u").alias("u"))
    steps = leaves.select("host", "nodes", F.posexplode("nodes").alias("depth", "node")).join(tree, ["host", "node"])
    walks = steps.groupBy("host", "nodes").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "b", "a", "u"))), lambda s: F.struct(s["b"].alias("b"), s["a"].alias("a"), s["u"].alias("u"))).alias("walk"))
    judged = walks.select("host", "nodes", F.round(branch_purity(F.col("walk")), 9).alias("purity"))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return shaped.join(judged, ["host", "nodes"]).select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), F.element_at("nodes", -1).alias("template"), "purity")
