"""Small operators that no query calls by themselves."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from eventweave.functions import text
from eventweave.operators import corpus, records, vectors, verify
from eventweave.sources import files, sinks


def test_types_of_raw_events(spark):
    rows = spark.createDataFrame([("Conflict", "Attack"), ("Conflict:Attack", "x"), (" Life ", None), (None, "Die"), (None, None)], "t string, s string")
    assert [r[0] for r in rows.select(corpus.event_type_of(F.col("t"), F.col("s"))).collect()] == ["Conflict:Attack", "Conflict:Attack", "Life", ":Die", ""]


def test_given_tokens_come_before_those_of_the_text(spark):
    rows = spark.createDataFrame([("a b", ["x"]), ("a b.", []), ("c", None), (None, None)], "t string, w array<string>")
    assert [r[0] for r in rows.select(text.token_sequence(F.col("t"), F.col("w"))).collect()] == [["x"], ["a", "b", "."], ["c"], []]


def test_image_arguments_need_image_evidence(spark):
    rows = spark.createDataFrame([([("Place", "hall")], True), ([("Place", "hall")], False)], "image_arguments array<struct<role:string,label:string>>, seen boolean")
    assert [len(r.image_arguments) for r in verify.without_image_evidence(rows, "seen").collect()] == [1, 0]


def test_hits_carry_their_metadata(spark):
    hit = vectors.with_metadata(spark.createDataFrame([(1, 0.5, 2)], "row long, score float, rank long"), "ace_text").first()
    assert hit.retrieval.asDict() == {"score": 0.5, "rank": 2, "index_name": "ace_text"}


def test_arguments_are_summarized_with_their_words(spark):
    arg = "array<struct<role:string,start:int,end:int>>"
    rows = spark.createDataFrame([([("Person", 1, 3), ("Place", 2, 9)], [("Person", [0.0, 0.0, 1.0, 1.0])], ["the", "old", "man"])], f"t {arg}, i array<struct<role:string,bbox:array<double>>>, w array<string>")
    made = rows.select(records.summarize_arguments(F.col("t"), F.col("i"), F.col("w")).alias("x")).first().x
    assert [(a.role, a.text) for a in made.text] == [("Person", "old man"), ("Place", "")] and made.image[0].bbox == [0.0, 0.0, 1.0, 1.0]


def test_analysis_files(spark, tmp_path):
    sinks.write_analysis(spark.createDataFrame([(3,)], "cases int"), spark.createDataFrame([("a", ["x"]), ("b", [])], "id string, categories array<string>"), str(tmp_path))
    summary = [p for p in (tmp_path / "error_summary").iterdir() if p.name.startswith("part")]
    assert len(summary) == 1 and json.loads(summary[0].read_text()) == {"cases": 3}
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "error_cases")).collect()) == ["a", "b"]


def test_vector_shards_are_read_as_one(spark, tmp_path):
    for name, n in (("a", 2), ("b", 0), ("c", 1)):
        spark.createDataFrame([(i, [1.0]) for i in range(n)], "row long, embedding array<float>").write.parquet(str(tmp_path / name))
    assert files.read_vectors(spark, *[str(tmp_path / n) for n in "abc"]).count() == 3
    with pytest.raises(ValueError):
        files.read_vectors(spark, str(tmp_path / "b"))


def test_mappings_of_any_size_are_not_collected(spark, monkeypatch):
    rows = spark.createDataFrame([("web", "Hit", "Conflict:Attack", 1), ("web", "hit", "Life:Die", 2)], "dataset string, raw_type string, event_type string, _pos int")
    events = spark.createDataFrame([("HIT",), ("miss",)], "raw_type string")
    assert [r.event_type for r in corpus.map_event_types(events, rows, "web").collect()] == ["Life:Die", None]
    monkeypatch.setattr(corpus, "MOST_PAIRS", 2)
    many = spark.range(5).select(F.lit("web").alias("dataset"), F.col("id").cast("string").alias("raw_type"), F.lit("Life:Die").alias("event_type"))
    with pytest.raises(ValueError, match="more than 2"):
        corpus.map_event_types(events, many, "web")
