"""Events of nodes and streams, failed ones too, and phrases by their places."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from eventweave.operators import matching
from eventweave.streaming import events


def test_nodes_report_what_they_did_and_how_they_failed(spark, tmp_path):
    log = events.NodeLog()
    with log.node("seven") as count:
        assert count(spark.range(7), total=F.sum("id"), none=F.sum(F.lit(None).cast("int"))).collect()
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"), log.node("broken") as count:
        count(spark.range(3).select(F.expr("id / 0"))).collect()
    with log.node("idle"):
        pass
    good, bad, idle = log.events
    assert (good["success"], good["rows"], good["metrics"], good["error"]) == (True, 7, {"total": 21, "none": 0}, None) and good["latency_ms"] > 0
    assert (bad["success"], bad["rows"]) == (False, None) and "DIVIDE_BY_ZERO" in bad["error"]
    assert (idle["success"], idle["rows"]) == (True, None)
    log.write(spark, str(tmp_path / "e"))
    log.write(spark, str(tmp_path / "e"))
    assert log.events == [] and {r.node: r.success for r in spark.read.schema(events.EVENT).json(str(tmp_path / "e")).collect()} == {"seven": True, "broken": False, "idle": True}


def test_streams_report_their_batches_and_failures(spark, tmp_path):
    log = events.NodeLog()
    spark.streams.addListener(log)
    try:
        spark.range(5).write.json(str(tmp_path / "in"))
        stream = lambda rows, ck: rows.writeStream.format("noop").queryName(ck).option("checkpointLocation", str(tmp_path / ck)).trigger(availableNow=True).start()
        rows = spark.readStream.schema("id bigint").json(str(tmp_path / "in"))
        stream(rows, "fine").awaitTermination()
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
            stream(rows.select(F.expr("id / 0").alias("x")), "broken").awaitTermination()
        for _ in range(100):
            if any(not e["success"] for e in log.events) and any(e["rows"] == 5 for e in log.events):
                break
            spark.range(1).count()
    finally:
        spark.streams.removeListener(log)
    assert any(e["node"] == "fine" and e["rows"] == 5 and e["success"] for e in log.events)
    assert any(not e["success"] and "DIVIDE_BY_ZERO" in e["error"] for e in log.events)


def test_phrases_are_found_in_all_their_places(spark):
    rng = random.Random(5)
    docs = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 30))]) for i in range(30)] + [(90, None), (91, ["a"])]
    phrases = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 4))]) for i in range(32) for _ in range(4)] + [(1, None), (91, ["a"]), (91, ["a", "a"]), (None, ["a"])]
    found = matching.phrase_places(spark.createDataFrame(docs, "id int, w array<string>"), spark.createDataFrame(phrases, "id int, p array<string>"), "id", "w", "p")
    got = sorted((r.id, tuple(r.phrase), r.start) for r in found.collect())
    own = dict(docs)
    want = sorted({(i, tuple(p), k) for i, p in phrases if p and own.get(i) for k in range(len(own[i]) - len(p) + 1) if own[i][k : k + len(p)] == p})
    assert got == want


def shuffled_rows(spark):
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_runs_of_tokens_that_no_phrase_can_be_stay_where_they_are(spark):
    words = [str(k) for k in range(20_000)]
    docs = spark.createDataFrame([(1, words)], "id int, w array<string>")
    phrases = spark.createDataFrame([(1, ["7", "8"]), (1, ["19998", "19999"])], "id int, p array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_rows(spark)
        found = matching.phrase_places(docs, phrases, "id", "w", "p").select("start").collect()
        assert sorted(r.start for r in found) == [7, 19998]
        assert shuffled_rows(spark) - before < 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
