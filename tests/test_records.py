"""Audit and prompt records."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from eventweave.operators import records
from eventweave.sources import files


def test_rendering(spark):
    row = spark.sql("select array(named_struct('event_type', 'A', 'note', ''), named_struct('event_type', 'B', 'note', 'n'), named_struct('event_type', 'C', 'note', 'm')) as e, array('a', 'b', 'c') as w").select(
        records.rendered_examples(F.col("e"), ["event_type", "note"]), records.rendered_examples(F.slice("e", 1, 0), ["note"]), records.json_lines(F.slice("e", 2, 1)), records.json_lines(F.slice("e", 1, 0)),
        records.mention_text(F.col("w"), F.lit(1), F.lit(3)), records.mention_text(F.col("w"), F.lit(2), F.lit(9)), records.perception_summary(F.lit(" x "), F.lit(None)),
    ).first()
    assert tuple(row) == ("example 1\nevent_type: A\n\nexample 2\nevent_type: B\nnote: n", "(none)", '{"event_type":"B","note":"n"}', "(none)", "b c", "", "Text: x\nImage: ")


def test_traces_and_changes(spark):
    states = spark.createDataFrame([("1", "data:image/png;base64,AAAA", "x")], "id string, image string, stage_a_output string")
    row = records.trace_records(states, F.lit("benchmark"), F.lit(True)).first()
    assert (row.effective_search_enabled, row.image, row.stage_a_output, row.stage_b_output) == (False, "data:image/png;<redacted>", "x", None)
    arg = "array<struct<role:string,label:string,bbox:array<double>,grounding_status:string>>"
    df = spark.createDataFrame([([("P", "man", None, "unresolved"), ("A", "car", None, "unresolved")], [("P", "man", [1.0], "grounded"), ("A", "car", None, "unresolved")])], f"b {arg}, a {arg}")
    assert [tuple(c) for c in df.select(records.argument_changes(F.col("b"), F.col("a")).alias("c")).first().c] == [(0, "P", "man", "unresolved", "grounded")]


def test_support(spark):
    schema = """event_type string, trigger struct<text:string>, text_arguments array<struct<text:string>>, image_arguments array<struct<label:string>>, text string, image_desc string,
    grounding_results array<struct<grounding_status:string>>, evidence array<struct<title:string,snippet:string>>"""
    full = (("arrested",), [("officers",)], [("handcuffs",)], "Police officers arrested him", "a man in handcuffs", [("grounded",)], [("Man arrested", "")])
    rows = [("Justice:Arrest-Jail", *full), ("", *full), ("Life:Die", None, None, None, None, None, None, None)]
    got = [tuple(r.support) for r in records.support_flags(spark.createDataFrame(rows, schema)).collect()]
    assert got == [(True, True, True, True), (False,) * 4, (False,) * 4]


def test_situations_and_shards(spark, tmp_path):
    df = spark.createDataFrame([("dir/running_12.jpg", [{"agent": "man", "place": ""}, {"agent": "boy", "place": "park"}])], "image_id string, frames array<map<string,string>>")
    row = records.situation_truth(df, 3).first()
    assert row.verb == "running" and sorted(map(sorted, row.nouns[:2])) == [["blank", "park"], ["boy", "man"]] and row.nouns[2] == []
    np.save(tmp_path / "a.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    np.save(tmp_path / "b.npy", np.zeros((0, 2)))
    assert sorted((r.row, r.embedding) for r in files.read_npy_shards(spark, str(tmp_path)).collect()) == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]
