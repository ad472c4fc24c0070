"""Rules of events look at the words of their spans, read a name once, and are dealt evenly."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from eventweave.functions import spans, text
from eventweave.operators import verify
from eventweave.plans import corpora

SF = "/root/testdata/sf0.001"


def test_white_space_goes_as_its_pattern_says(spark):
    points = spark.range(1, 0x110000).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c")).where("c != ''")  # a byte order mark is read as nothing
    pattern = f"^{text.WS}+|{text.WS}+$"
    for value in (F.col("c"), F.concat("c", F.lit("a b"), "c"), F.concat(F.lit(" \n"), "c", F.lit("x"), "c", F.lit("\t　"))):
        assert points.where(~text.trim_ws(value).eqNullSafe(F.regexp_replace(value, pattern, ""))).count() == 0
    assert points.where(text.trim_ws(F.col("c")) == "").count() == len(text.WS_CHARACTERS)
    assert spark.range(1).select(text.trim_ws(F.lit(None).cast("string")).alias("x")).first().x is None


def test_preferred_spans_look_at_the_tokens_of_spans_only(spark):
    tokens = F.concat(F.array_repeat(F.lit("filler"), 10_000), F.array(*map(F.lit, "the President Barack Obama".split())), F.array_repeat(F.lit("filler"), 10_000))
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    rows = spark.range(200).select("id", tokens.alias("t")).select(spans.preferred_spans(F.col("t"), F.array(span(10_000, 10_004), span(10_001, 10_002), span(30_000, 30_001), span(None, 2))).alias("p"))
    began = time.monotonic()
    got = {tuple(tuple(x) for x in r.p) for r in rows.collect()}
    assert got == {((10_002, 10_004, True, False, False), (10_001, 10_002, False, False, False), (30_000, 30_001, False, False, False), (None, 2, False, False, False))}
    assert time.monotonic() - began < 20


def test_rules_trim_names_once(spark):
    made = verify.with_diagnostics(corpora._marked(spark, SF), "tokens", "seen", "results")
    optimized = made._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("regexp_extract_all") <= 2  # a trigger's words and an argument's


def test_events_are_dealt_before_their_rules(spark):
    assert "RepartitionByExpression [event_id" in corpora._marked(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
