"""Samples that are dealt once: their stored arguments, and what is told of some of them, meet without another shuffle of all of them."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventweave.operators import errors, flat, scoring
from eventweave.plans import evaluation
from eventweave.session import dealt, materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture
def merging(spark):
    """A session that broadcasts nothing, as on large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffles(df):
    """The keys of the shuffles of a plan."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def keys(df):
    return [re.sub(r"#\w+", "", k) for k in shuffles(df)]


def test_what_is_dealt_by_a_key_is_stored_so(merging):
    rows = merging.range(1000).select((F.col("id") % 37).alias("s"), F.col("id").alias("n"), F.lit("x").alias("t"))
    kept = materialize(dealt(rows.repartition("s"), "s", 2), "rows")
    over = kept.withColumn("k", F.count("*").over(Window.partitionBy("s", "t")))
    assert not shuffles(over) and sorted(over.select("s", "n", "t").collect()) == sorted(rows.collect())
    assert {r.k for r in over.collect()} == {27, 28}
    assert not [t for t in merging.catalog.listTables("default") if t.name.startswith("dealt_")]


def test_facts_meet_items_that_are_not_dealt_anew(merging):
    items = [(s, n, f"{s}{n}") for s in ("a", "b", "c") for n in (3, 1, 2)] + [(None, 1, "none"), ("d", 7, None)]
    facts = [("a", 2, 5, 0.5), ("a", 3, None, 1.0), ("c", 1, 6, None), ("d", 7, 1, 2.0), ("e", 1, 9, 9.0)]
    own = materialize(dealt(merging.createDataFrame(items, "s string, n int, t string").repartition("s"), "s", 3), "items")
    told = merging.createDataFrame(facts, "s string, n int, p int, x double")
    made = flat.attached(own, told, "s", "n", parts=3)
    assert keys(made) == ["__of"]  # facts alone
    want = own.join(told, ["s", "n"], "left").select(made.columns)
    assert sorted(map(repr, made.collect())) == sorted(map(repr, want.collect())) and made.count() == len(items)


def test_errors_shuffle_arguments_only_where_boxes_meet(merging):
    found = evaluation.scored(merging, SF, F.col)
    events = errors.breakdown_events(found)
    made = keys(events)
    # text arguments are swept and boxes told of their partners where they are; only sides of boxes that may meet, and what comes of that, go by more than the sample
    assert not [k for k in made if k.startswith("sample_id, event_type") and "strip" not in k]
    assert sum("strip" in k for k in made) == 2 and made.count("sample_id, n") <= 1


def test_pairs_of_boxes_count_as_before_where_many_meet(merging):
    rows = [(s, "A", "A", True, n, side, "image", "A", r, r, None, None, None, None, float(n % 3), 0.0, float(n % 3 + 2), 2.0 + side) for s in range(5) for n, side, r in [(i, i % 2, "PQ"[(i // 2 + s) % 2]) for i in range(s * 3)]]
    names = "sample_id int, gold_type string, pred_type string, gate boolean, n int, side int, medium string, event_type string, role string, raw_role string, trigger_start int, trigger_end int, start int, end int, x1 double, y1 double, x2 double, y2 double"
    found = scoring.score_samples(merging.createDataFrame(rows, names))
    joined = found.boxes.join(found.taken.select("sample_id", F.col("pred_n").alias("n"), F.col("gold_n").alias("partner")).unionByName(found.taken.select("sample_id", F.col("gold_n").alias("n"), F.col("pred_n").alias("partner"))), ["sample_id", "n"], "left")
    assert sorted(map(repr, found.image.select(joined.columns).collect())) == sorted(map(repr, joined.collect()))
    assert found.image.where("partner is not null").count() > 0


def test_boxes_that_face_others_are_not_dealt_anew_before_they_meet(merging):
    made = keys(evaluation.scored(merging, SF, F.col).taken)
    assert sum("strip" in k for k in made) == 2 and sum("strip" not in k for k in made) == 1  # sides of strips, and groups of the pairs that are found
