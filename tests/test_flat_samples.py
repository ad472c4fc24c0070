"""Samples read from flat tables against the same samples as nested records, and queries that read them once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from eventweave.operators import errors, scoring
from eventweave.plans import evaluation

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both(spark):
    gold, pred, _ = evaluation.samples(spark, SF)
    return scoring.score_samples(scoring.paired(gold, pred)), evaluation.scored(spark, SF)


def test_flat_samples_are_scored_as_nested_ones(both):
    for score in (scoring.totals, scoring.by_type_and_role, scoring.role_confusions, scoring.alias_rescues, lambda s: errors.counts(errors.breakdown_events(s))):
        nested, flat = (sorted(map(repr, score(s).collect())) for s in both)
        assert nested == flat and nested
    kept = ["medium", "sample_id", "gold_type", "pred_type", "gate", "side", "event_type", "role", "raw_role", "trigger_start", "trigger_end", "start", "end", "x1", "y1", "x2", "y2"]
    nested, flat = (sorted(map(repr, s.pairs.select(kept).collect())) for s in both)
    assert nested == flat


def test_the_last_record_of_a_sample_counts_and_arguments_of_others_go(spark):
    samples = spark.createDataFrame([("a", "Conflict:Attack"), ("b", None), ("", "Life:Die")], "sample_id string, event_type string")
    records = spark.createDataFrame([("a", "Life:Die", 0, 1, 0), ("a", "conflict attack", None, 3, 1), ("", "Life:Die", 0, 1, 0)], "sample_id string, event_type string, trigger_start int, trigger_end int, _pos int")
    spans = "sample_id string, _pos int, n int, side int, role string, trigger_start int, trigger_end int, start int, end int"
    texts = spark.createDataFrame([("a", None, 0, 0, "Target", 0, 1, 2, 3), ("a", 0, 1, 1, "Agent", 0, 1, 2, 3), ("a", 1, 2, 1, " Target\t", 0, 1, 2, 3), ("a", 1, 3, 1, "", 0, 1, 2, 3), ("b", 1, 1, 1, "Place", 0, 1, 2, 3)], spans)
    boxes = spark.createDataFrame([("a", None, 0, 0, "Target", 0.0, 0.0, 1.0, 1.0), ("a", 1, 1, 1, "Suspect ", 0.0, 0.0, 1.0, None)], "sample_id string, _pos int, n int, side int, role string, x1 double, y1 double, x2 double, y2 double")
    got = {(r.sample_id, r.medium, r.n): (r.gate, r.role, r.raw_role, r.trigger_start, r.trigger_end) for r in scoring.paired_rows(samples, records, texts, boxes).collect()}
    assert got == {
        ("a", "sample", 0): (True, "", "", None, None), ("b", "sample", 0): (False, "", "", None, None), ("", "sample", 0): (False, "", "", None, None),
        ("a", "text", 0): (True, "Target", "Target", 0, 1), ("a", "text", 2): (True, "Target", "Target", None, 3),
        ("a", "image", 0): (True, "Target", "Target", None, None), ("a", "invalid", 1): (True, "Person", "Suspect", None, None),
    }


def test_the_samples_of_a_score_are_grouped_by_no_list(both):
    """The lines of an order are numbered in a window; no array of them is made and taken apart again."""
    plan = both[1].text._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("lineitem") <= 1


def test_a_summary_reads_its_samples_once(spark):
    found = spark.createDataFrame([("a", "", ["text_arg_missing", "text_arg_extra"], ["c1"], ["Place"]), ("b", "Life:Die", [], [], ["Agent"])], "sample_id string, gold_type string, categories array<string>, causes array<string>, roles array<string>")
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    rows = found.withColumn("sample_id", F.udf(seen)("sample_id")).where("sample_id != ''")
    made = errors.summary(rows)
    got = {tuple(r)[:3]: r.n for r in made.collect()}
    assert read.value == 2
    dense = {("category", "", c): 0 for c in errors.CATEGORIES} | {("type", "(missing)", c): 0 for c in errors.CATEGORIES} | {("role", "Place", c): 0 for c in errors.CATEGORIES}
    one = {(k, n, c): 1 for k, n in (("category", ""), ("type", "(missing)"), ("role", "Place")) for c in ("text_arg_missing", "text_arg_extra")}
    assert got == dense | one | {("samples", "", ""): 2, ("cases", "", ""): 1, ("cause", "c1", ""): 1}
    assert len(made.collect()) == len(got)


def test_boxes_of_an_order_meet_in_strips_and_not_in_arrays(spark):
    from eventweave.plans import catalog

    plan = catalog.iou_pairs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "strip" in plan


def test_examples_are_limited_before_they_are_shuffled(spark):
    plan = evaluation.examples_per_bucket(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit [counter" in plan and "dense_rank(sample_id" in plan and ", Partial" in plan
