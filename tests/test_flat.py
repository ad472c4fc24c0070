"""Matching in flat tables against plain loops, and on samples with very many arguments."""

from __future__ import annotations

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventweave.operators import flat

ITEM = "s string, n int, side int, role string, start int, end int"


def items(rng, samples=60, most=9):
    rows = []
    for s in range(samples):
        for n in range(rng.randint(0, most)):
            a = rng.randint(-3, 8)
            rows.append((f"s{s}", n, rng.randint(0, 1), rng.choice(["x", "y", None]), a, a + rng.randint(-1, 4)))
    return rows


def found(df, name):
    return {(r.s, r.n): r[name] for r in df.collect()}


def plain(rows, holds):
    """For each item whether an item of the other side in its sample holds with it."""
    return {(a[0], a[1]): any(b[0] == a[0] and b[2] != a[2] and holds(a, b) for b in rows) for a in rows}


def test_spans_are_matched_as_by_plain_loops(spark):
    rows = items(random.Random(1))
    df = spark.createDataFrame(rows, ITEM)
    over = lambda a, b: max(a[4], b[4]) < min(a[5], b[5])
    assert found(flat.swept_overlaps(df, ["s"], "o"), "o") == plain(rows, over)
    assert found(flat.swept_overlaps(df, ["s", "role"], "o"), "o") == plain(rows, lambda a, b: a[3] == b[3] and over(a, b))
    assert found(flat.same_places(df, ["s"], "o"), "o") == plain(rows, lambda a, b: a[4:] == b[4:])
    longer = lambda g, p: p[4] <= g[4] and p[5] >= g[5] and p[4:] != g[4:]
    assert found(flat.swept_containments(df, ["s"], "o"), "o") == plain(rows, lambda a, b: longer(a, b) if a[2] == 0 else longer(b, a))


def test_equal_items_are_matched_one_to_one(spark):
    rows = items(random.Random(2), most=14)
    key = lambda r: (r[0], r[3], r[4] % 3)
    df = spark.createDataFrame(rows, ITEM).withColumn("k", F.pmod("start", F.lit(3)))
    got = found(flat.numbered_matches(df, ["s", "role", "k"]), "matched")
    for side in (0, 1):
        there, seen = Counter(key(r) for r in rows if r[2] != side), Counter()
        for r in sorted((r for r in rows if r[2] == side), key=lambda r: r[1]):
            seen[key(r)] += 1
            assert got[r[:2]] == (seen[key(r)] <= there[key(r)])
    sides = [Counter(key(r) for r in rows if r[2] == s) for s in (0, 1)]
    want = Counter()
    for k, n in (sides[0] & sides[1]).items():
        want[k[0]] += n
    assert {r.s: r.tp for r in flat.shared_counts(df, "s", ["role", "k"]).collect() if r.tp} == want


BOX = "s string, n int, side int, x1 double, y1 double, x2 double, y2 double"


def boxes(rng, samples=50, most=10):
    rows = []
    for s in range(samples):
        for n in range(rng.randint(0, most)):
            x, y = rng.randint(-4, 5), rng.randint(-4, 5)
            rows.append((f"s{s}", n, rng.randint(0, 1), float(x), float(y), float(x + rng.choice([0, 1, 2, 7, -1])), float(y + rng.randint(0, 5))))
    return rows


def overlap(g, p):
    w, h = min(g[5], p[5]) - max(g[3], p[3]), min(g[6], p[6]) - max(g[4], p[4])
    area = lambda b: (b[5] - b[3]) * (b[6] - b[4])
    return (w * h, w * h / (area(g) + area(p) - w * h), w * h / area(g), w * h / area(p)) if w > 0 and h > 0 and min(g[5] - g[3], p[5] - p[3], g[6] - g[4], p[6] - p[4]) > 0 else None


def test_boxes_meet_as_in_plain_loops(spark):
    rows = boxes(random.Random(3))
    odd = [("s0", 90, 0, float("nan"), 0.0, 5.0, 5.0), ("s0", 91, 1, 0.0, 0.0, float("inf"), 5.0), ("s0", 92, 1, float("-inf"), 0.0, 5.0, 5.0)]
    got = {(r.s, r.gold_n, r.pred_n): (r.inter, r.iou, r.cover, r.purity) for r in flat.overlapping_boxes(spark.createDataFrame(rows + odd, BOX), ["s"], ["n"]).collect()}
    want = {(g[0], g[1], p[1]): overlap(g, p) for g in rows for p in rows if g[0] == p[0] and g[2] == 0 and p[2] == 1 and overlap(g, p)}
    assert got == want


def test_boxes_are_taken_greedily(spark):
    rng = random.Random(4)
    pairs = [(f"s{s}", p, g, rng.choice([0.25, 0.5, 0.75])) for s in range(80) for p in range(rng.randint(0, 5)) for g in range(10, 10 + rng.randint(0, 5)) if rng.random() < 0.6]
    got = {(r.s, r.pred_n, r.gold_n) for r in flat.greedy_pairs(spark.createDataFrame(pairs, "s string, pred_n int, gold_n int, iou double"), ["s"]).collect()}
    want, taken = set(), set()
    for s, p in sorted({x[:2] for x in pairs}):
        free = sorted((-o, g) for s2, p2, g, o in pairs if (s2, p2) == (s, p) and (s, g) not in taken)
        if free:
            want.add((s, p, free[0][1]))
            taken.add((s, free[0][1]))
    assert got == want


@pytest.mark.parametrize("n", [20_000])
def test_a_sample_of_many_arguments_costs_its_overlaps(spark, n):
    rows = spark.range(2 * n).select(F.lit("one").alias("s"), F.col("id").cast("int").alias("n"), (F.col("id") % 2).cast("int").alias("side"), F.lit("x").alias("role"), (F.col("id") * 3).cast("int").alias("start"), (F.col("id") * 3 + 4).cast("int").alias("end"))
    began = time.monotonic()
    assert flat.swept_overlaps(rows, ["s"], "o").where("o").count() == 2 * n
    assert flat.numbered_matches(rows, ["s", "role", "start", "end"]).where("matched").count() == 0
    placed = rows.select("s", "n", "side", F.col("start").cast("double").alias("x1"), F.lit(0.0).alias("y1"), F.col("end").cast("double").alias("x2"), F.lit(1.0).alias("y2"))
    assert flat.overlapping_boxes(placed, ["s"], ["n"]).count() == 2 * n - 1
    assert time.monotonic() - began < 60
