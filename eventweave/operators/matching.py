"""Matching of gold and predicted arguments within a sample.

Expressions over arrays of a few structs in one row; matching of whole samples, of any size, is in ``flat``.
Ordered one-to-one assignments are folds whose state is the list of partners chosen so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventweave.functions.bbox import iou, normalize_bbox
from eventweave.functions.text import let, truthy

Pair = Callable[[Column, Column], Column]
#: Bits of a bitmap that Spark aggregates.
BITS = 32768


def last_wins(rows: DataFrame, key: str, pos: str = "_pos") -> DataFrame:
    """The last row of each key by position; empty and null keys go."""
    order = Window.partitionBy(key).orderBy(F.desc(pos))
    return rows.where(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) != "").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def first_wins(rows: DataFrame, key: str, pos: str = "_pos") -> DataFrame:
    order = Window.partitionBy(key).orderBy(pos)
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def pending(samples: DataFrame, *done: DataFrame, key: str = "id") -> DataFrame:
    """Samples whose key is in none of the given tables' first columns."""
    out = samples
    for d in done:
        out = out.join(d.select(d[d.columns[0]].alias(key)), key, "left_anti")
    return out


def same_trigger(g: Column, p: Column) -> Column:
    return (g["event_type"] == p["event_type"]) & g["trigger_start"].eqNullSafe(p["trigger_start"]) & g["trigger_end"].eqNullSafe(p["trigger_end"])


def same_span(g: Column, p: Column) -> Column:
    return (g["start"] == p["start"]) & (g["end"] == p["end"])


def spans_overlap(g: Column, p: Column) -> Column:
    return F.greatest(g["start"], p["start"]) < F.least(g["end"], p["end"])


def overlong(g: Column, p: Column) -> Column:
    """Whether a prediction holds a gold span of its role and more."""
    return same_trigger(g, p) & (g["role"] == p["role"]) & (p["start"] <= g["start"]) & (p["end"] >= g["end"]) & ((p["start"] < g["start"]) | (p["end"] > g["end"]))


def _indexed(arr: Column) -> Column:
    return F.transform(arr, lambda x, i: F.struct(i.alias("i"), x.alias("x")))


def greedy_first(left: Column, right: Column, fits: Pair) -> Column:
    """For each left item in order the index of the first free right item that fits, or -1."""
    numbered = _indexed(right)

    def pick(chosen: Column, x: Column) -> Column:
        free = F.filter(numbered, lambda r: ~F.array_contains(chosen, r["i"]) & F.coalesce(fits(x, r["x"]), F.lit(False)))
        return F.concat(chosen, F.array(F.coalesce(F.try_element_at(free, F.lit(1))["i"], F.lit(-1))))

    return F.aggregate(left, F.array().cast("array<int>"), pick)


def pairs_where(left: Column, right: Column, fits: Pair, make: Pair) -> Column:
    """make(l, r) of every pair that fits."""
    return F.flatten(F.transform(left, lambda a: F.transform(F.filter(right, lambda b: F.coalesce(fits(a, b), F.lit(False))), lambda b: make(a, b))))


def best_box(item: Column, candidates: Column, same_role: bool, threshold: float | None = None) -> Column:
    """The candidate of the item's type with the largest IoU, of equal ones the first; of its role or of others only. Null if there is none."""
    def fits(c: Column) -> Column:
        role = (c["x"]["role"] == item["role"]) if same_role else (c["x"]["role"] != item["role"])
        return (c["x"]["event_type"] == item["event_type"]) & role

    scored = F.transform(F.filter(_indexed(candidates), fits), lambda c: F.struct(iou(c["x"]["bbox"], item["bbox"]).alias("o"), (-c["i"]).alias("n")))
    best = F.array_max(scored if threshold is None else F.filter(scored, lambda s: s["o"] >= threshold))
    return let(best, lambda b: F.when(b.isNotNull(), F.try_element_at(candidates, -b["n"] + 1)))


def rescues(gold: Column, pred: Column) -> Column:
    """Text arguments that match only by role aliases, of arrays (n, event_type, raw_role) that are equal but for their raw roles: each prediction takes the first free gold argument with
    its raw role, else the first free one; (event_type, gold_role, pred_role) of the latter where raw roles differ."""
    numbered = _indexed(gold)

    def pick(chosen: Column, p: Column) -> Column:
        free = F.filter(numbered, lambda g: ~F.array_contains(chosen, g["i"]))
        exact = F.filter(free, lambda g: g["x"]["raw_role"] == p["raw_role"])
        return F.concat(chosen, F.array(F.coalesce(F.try_element_at(exact, F.lit(1))["i"], F.try_element_at(free, F.lit(1))["i"], F.lit(-1))))

    partners = F.aggregate(pred, F.array().cast("array<int>"), pick)
    made = F.transform(pred, lambda p, i: F.when(F.element_at(partners, i + 1) >= 0, F.struct(p["event_type"].alias("event_type"), F.try_element_at(gold, F.element_at(partners, i + 1) + 1)["raw_role"].alias("gold_role"), p["raw_role"].alias("pred_role"))))
    return F.filter(made, lambda r: r.isNotNull() & (r["gold_role"] != r["pred_role"]))


def attach_grounding(args: Column, results: Column) -> Column:
    """Image arguments with boxes of grounding results written back: the nth unresolved argument of a (role, label) takes the nth grounded result of it."""
    same = lambda a, b: (a["role"] == b["role"]) & (a["label"] == b["label"])
    waiting = lambda a: a["bbox"].isNull() & (a["grounding_status"] == "unresolved")
    good = F.filter(results, lambda r: (r["grounding_status"] == "grounded") & r["bbox"].isNotNull())

    def one(a: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice(args, 1, i + 1), lambda b: same(a, b) & waiting(b)))
        found = F.try_element_at(F.filter(good, lambda r: same(a, r)), F.when(nth > 0, nth).otherwise(1))
        return F.when(waiting(a) & found.isNotNull(), a.withField("bbox", found["bbox"]).withField("grounding_status", F.lit("grounded"))).otherwise(a)

    return F.transform(args, one)


def grounded_boxes(results: Column) -> Column:
    """{role, label} to box of grounding results, whatever their status; of equal keys the last counts. Results without a role, label or box are left out."""
    made = F.transform(F.coalesce(results, F.array()), lambda r: F.struct(F.struct(truthy(r["role"]).alias("role"), truthy(r["label"]).alias("label")).alias("key"), normalize_bbox(r["bbox"]).alias("value")))

    def last(all_: Column) -> Column:
        return F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.greatest(F.size(all_) - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]))

    whole = F.filter(made, lambda e: (e["key"]["role"] != "") & (e["key"]["label"] != "") & e["value"].isNotNull())
    return F.map_from_entries(let(whole, last))


def phrase_starts(tokens: Column, phrase: Column) -> Column:
    """All places where an array of tokens occurs in another, overlaps included."""
    n = F.size(tokens) - F.size(phrase)
    places = F.when((n >= 0) & (F.size(phrase) > 0), F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.slice(tokens, i + 1, F.size(phrase)) == phrase)


def phrase_places(docs: DataFrame, phrases: DataFrame, key: str, tokens: str, phrase: str) -> DataFrame:
    """(key, phrase, start) of every place where a document's tokens hold one of its phrases, overlaps included; phrases (key, phrase) are arrays of tokens.

    A document's runs of tokens are listed once for each length that its phrases have and looked up for all of them, so its work is its positions for each length, not for each
    phrase. Only runs whose hash is in a bitmap of the document's phrases leave their task to be compared. Empty and null phrases are nowhere, and a phrase that is given twice counts once."""
    asked = phrases.select(key, F.col(phrase).alias("phrase")).where(F.size("phrase") > 0).distinct()
    bit = F.pmod(F.xxhash64("phrase"), F.lit(BITS))
    marks = asked.groupBy(key).agg(F.collect_set(F.size("phrase")).alias("lengths"), F.bitmap_construct_agg(bit).alias("marks"))
    held = docs.select(key, F.col(tokens).alias("tokens")).join(marks, key).select(key, "tokens", "marks", F.explode("lengths").alias("n")).where(F.size("tokens") >= F.col("n"))
    runs = held.select(key, "marks", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("tokens") - F.col("n") + 1), lambda i: F.slice("tokens", i, F.col("n")))).alias("start", "phrase"))
    byte = F.conv(F.hex(F.substring("marks", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    likely = runs.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(key, "start", "phrase")
    return likely.join(asked, [key, "phrase"]).select(key, "phrase", "start")


def choose_nearest(spans: Column, anchors: Column) -> Column:
    """The span whose middle is nearest to any anchor's; the only span without anchors; null if two are equally near or anchors lack."""
    middle = lambda s: s["start"] + s["end"]
    far = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_min(F.transform(anchors, lambda a: F.abs(middle(s) - middle(a)))).alias("d"), s.alias("s"))))
    tie = F.try_element_at(far, F.lit(1))["d"] == F.try_element_at(far, F.lit(2))["d"]
    return F.when(F.size(spans) == 1, F.try_element_at(spans, F.lit(1))).when((F.size(anchors) > 0) & (F.size(spans) > 1) & ~F.coalesce(tie, F.lit(False)), F.try_element_at(far, F.lit(1))["s"])
