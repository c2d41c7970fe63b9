"""Secret scans in built-in functions only.

Base kinds are patterns. The method adds high-entropy spans: candidate strings
are scanned by a sliding window whose Shannon entropy is kept by incremental
counts, with a threshold for each character class, and an allow-list suppresses
well-known harmless shapes.

Positions are code points, ends exclusive. Entropies are compared in whole
numbers (c * log2(c) in millionths), so that every engine gets the same spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, whole_text

#: Fixed patterns of the base kinds, in the order that kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGNED = 12
KINDS = ["assign", "access", "hex", "entropy"]

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character classes, the first that fits counts, and the entropy in bits from which a window of 20 is a secret's.
CLASSES = [("hex", "^[0-9a-fA-F]+$", 3.0), ("alnum", "^[A-Za-z0-9]+$", 3.75), ("base64", "", 3.9)]
#: Allow-list: identifiers, digests that pin files, placeholders, and slugs or paths of plain words and numbers.
ALLOWED = [
    "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "^(sha(1|256|384|512)|md5)-",
    "EXAMPLE|example|0123456789|1234567890|abcdefghij|ABCDEFGHIJ",
    "^[/_+=-]*([A-Za-z]+|[0-9]{1,10})([/_+=-]+([A-Za-z]+|[0-9]{1,10}))*[/_+=-]*$",
]
STRIDE = 200  # windows scanned in one piece of a long candidate
BLOCK = 1024  # code points of a text that redaction takes together
UNIT = 1_000_000
#: c * log2(c) in millionths for each count that a window can hold.
TERMS = [round(UNIT * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]


def bound(bits: float) -> int:
    """A window's entropy is ``bits`` or more if its sum of terms is no more than this."""
    return math.floor(UNIT * WINDOW * (math.log2(WINDOW) - bits))


def bound_to(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, as lambdas work theirs out for every element."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, combine, zero: Column) -> Column:
    """For each of ``values`` what ``combine`` makes of those before it, ``zero`` for the first.

    Blocks of about the root of the array's size are scanned each by itself,
    then their results, so that no array grows by one element at a time for long.
    """
    none = F.array().cast("array<int>")

    def scan(block: Column) -> Column:
        start = F.struct(zero.alias("at"), none.alias("before"))
        return F.aggregate(block, start, lambda s, x: F.struct(combine(s["at"], x).alias("at"), F.concat(s["before"], F.array(s["at"])).alias("before")))

    def blocks(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda k: scan(F.slice(v, k * size + 1, size)))

    def whole(scanned: Column) -> Column:
        carried = scan(F.transform(scanned, lambda b: b["at"]))["before"]
        return F.flatten(F.zip_with(scanned, carried, lambda b, c: F.transform(b["before"], lambda x: combine(c, x))))

    return bound_to(values, lambda v: F.when(F.size(v) > 0, bound_to(blocks(v), whole)).otherwise(none))


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>>: the leftmost non-overlapping matches, from the lengths of the pieces between them."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(found: Column) -> Column:
        gaps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, f: F.struct(F.length(p).alias("gap"), F.length(f).alias("n"), f.alias("found")))
        return bound_to(gaps, lambda g: F.zip_with(g, running(F.transform(g, lambda m: m["gap"] + m["n"]), lambda a, b: a + b, F.lit(0)), lambda m, at: F.struct((at + m["gap"]).alias("start"), (at + m["gap"] + m["n"]).alias("end"), m["found"].alias("found"))))

    return F.when(text.rlike(pattern), bound_to(found, place)).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))


def times(text: Column, char: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, char, F.lit("")))


def hot_windows(piece: Column, most: Column) -> Column:
    """struct<first, last>: where the first and last window begin, of those whose sum of terms is ``most`` or less; first -1: none.

    The sum moves from window to window by the counts of the character that
    leaves and of the one that enters, among the characters that stay.
    """
    term = lambda c: F.element_at(F.array(*[F.lit(t) for t in TERMS]), c + 1)
    head = F.substring(piece, 1, WINDOW)
    distinct = F.array_distinct(F.split(head, ""))
    begin = F.aggregate(F.filter(distinct, lambda ch: ch != ""), F.lit(0), lambda s, ch: s + term(times(head, ch)))
    mark = lambda state, i, total: F.struct(total.alias("total"), F.when((total <= most) & (state["first"] < 0), i).otherwise(state["first"]).alias("first"), F.when(total <= most, i).otherwise(state["last"]).alias("last"))

    def step(state: Column, i: Column) -> Column:
        stay = F.substring(piece, i + 1, F.lit(WINDOW - 1))
        leaves, enters = times(stay, F.substring(piece, i, F.lit(1))), times(stay, F.substring(piece, i + WINDOW, F.lit(1)))
        return mark(state, i, state["total"] + term(enters + 1) - term(enters) - term(leaves + 1) + term(leaves))

    start = F.transform(F.array(begin), lambda total: mark(F.struct(total.alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last")), F.lit(0), total))[0]
    steps = F.when(F.length(piece) > WINDOW, F.sequence(F.lit(1), F.length(piece) - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def entropy_spans(candidates: Column) -> Column:
    """array<struct<start, end>>: for each candidate with windows at its class's threshold, from the first to the end of the last."""
    limit = lambda w: F.when(w.rlike(CLASSES[0][1]), bound(CLASSES[0][2])).when(w.rlike(CLASSES[1][1]), bound(CLASSES[1][2])).otherwise(bound(CLASSES[2][2]))
    mixed = lambda w: w.rlike("[0-9]") & w.rlike("[A-Za-z]")
    allowed = lambda w: w.rlike("|".join(f"({a})" for a in ALLOWED))

    def scan(c: Column) -> Column:
        w = c["found"]
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - WINDOW) / STRIDE).cast("int")), lambda k: F.struct((k * STRIDE).alias("at"), hot_windows(F.substring(w, k * STRIDE + 1, F.lit(STRIDE + WINDOW - 1)), limit(w)).alias("hot")))
        hot = F.filter(pieces, lambda p: p["hot"]["first"] >= 0)
        first = F.array_min(F.transform(hot, lambda p: p["at"] + p["hot"]["first"]))
        last = F.array_max(F.transform(hot, lambda p: p["at"] + p["hot"]["last"]))
        return F.struct((c["start"] + first).alias("start"), (c["start"] + last + WINDOW).alias("end"))

    kept = F.filter(candidates, lambda c: mixed(c["found"]) & ~allowed(c["found"]))
    return F.filter(F.transform(kept, scan), lambda s: s["start"].isNotNull())


def uncovered(spans: Column) -> Column:
    """``spans`` in order, less each entropy span that a base span covers from its begin to its end."""
    def sift(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: F.when(x["rank"] < 3, x["end"]).otherwise(0)), F.greatest, F.lit(0))
        kept = F.zip_with(s, reach, lambda x, r: F.struct(x.alias("span"), ((x["rank"] < 3) | (r < x["end"])).alias("stays")))
        return F.transform(F.filter(kept, lambda x: x["stays"]), lambda x: x["span"])

    return bound_to(F.array_sort(spans), sift)


def secret_spans(docs: DataFrame, name: str = "spans") -> DataFrame:
    """``docs`` with column ``name``: array<struct<start, rank, end, kind>> by start, then kind as listed.

    Null texts read as empty and have no spans; very long texts, and those of
    very many matches, are scanned whole; null or repeated ids keep their rows;
    no rows give no rows. All columns of ``docs`` stay; one called ``name`` is
    replaced. Base spans always stay; an entropy span stays unless one base
    span covers all of it.
    """
    text = whole_text()
    span = lambda k: lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("rank"), s["end"].alias("end"), F.lit(KINDS[k]).alias("kind"))
    values = F.when(text.rlike(ASSIGN), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>"))
    assigned = F.zip_with(located(text, ASSIGN), values, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.length(v).alias("n")))
    assign = F.transform(F.filter(assigned, lambda s: s["n"] >= MIN_ASSIGNED), span(0))
    base = F.concat(assign, F.transform(located(text, ACCESS), span(1)), F.transform(located(text, HEX), span(2)))
    added = bound_to(located(text, CANDIDATE), lambda c: F.transform(entropy_spans(c), span(3)))
    return docs.withColumn(name, uncovered(F.concat(base, added)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with ``mark`` for each stretch of overlapping ``spans``, which are in order.

    The text is cut into blocks once; what stays between two stretches comes from the blocks it touches.
    """
    def cut(blocks: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
        return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), start % BLOCK + 1, end - start)

    def assemble(blocks: Column, ends: Column) -> Column:
        bare = F.zip_with(spans, ends, lambda s, at: F.struct(at.alias("at"), s["start"].alias("to")))
        gaps = F.transform(F.filter(bare, lambda g: g["to"] >= g["at"]), lambda g: F.concat(cut(blocks, g["at"], g["to"]), F.lit(mark)))
        return F.concat(F.array_join(gaps, ""), cut(blocks, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest, F.lit(0))
    return bound_to(blocks, lambda b: bound_to(ends, lambda e: assemble(b, e)))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each stretch of secret spans in ``text`` replaced by ``mark`` and n_chars, if there, counted anew.

    Overlapping spans make one stretch. Texts without spans, null ones included,
    stay as they are, and so do all other columns, whatever their names.
    """
    spans = free_name("spans", docs.columns)
    hit = F.size(spans) > 0
    out = secret_spans(docs, spans).withColumn("text", F.when(hit, redacted(F.col("text"), F.col(spans), mark)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop(spans)
