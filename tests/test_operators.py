"""Corpora, vectors, evidence, verification, sources and sinks, providers, streams."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventweave.operators import corpus, evidence, ordering, phrases, providers, vectors, verify
from eventweave.sources import files, sinks
from eventweave.streaming import resume

ACE = "text string, sentence string, doc_id string, event array<struct<type:string,text:string,args:array<struct<type:string,text:string>>>>, _pos int"
MAVEN = """id string, document string, entities array<struct<id:string,mention:array<struct<mention:string,offset:array<int>>>>>,
events array<struct<id:string,type:string,mention:array<struct<id:string,trigger_word:string,offset:array<int>>>,argument:map<string,array<struct<content:string,entity_id:string,offset:array<int>>>>>>"""


def test_ace_lines(spark):
    rows = [("A man  was\theld.", None, None, [("Justice:Arrest-Jail", "held", [("Person", "A man"), ("Place", " ")])], 7), (None, "Other.", "d1", [("x", "y", None), ("z", "w", [])], 8)]
    got = corpus.flatten_ace(spark.createDataFrame(rows, ACE), "train").orderBy("id").collect()
    assert [(r.doc_id, r.id, r.raw_type, r.text, r.trigger_text) for r in got] == [("d1", "d1::event::0", "x", "Other.", "y"), ("d1", "d1::event::1", "z", "Other.", "w"), ("train::000007", "train::000007::event::0", "Justice:Arrest-Jail", "A man was held.", "held")]
    assert [(a.role, a.text, a.span) for a in got[2].arguments] == [("Person", "A man", None)]


def test_maven_documents(spark):
    entities = [("e1", [("the army", [0, 8])]), ("e1", [("the later army", [0, 8])]), ("e2", [])]
    args = {"Agent_x": [("own words", "e1", None), (None, "e1", None), (None, "e2", None), (None, "nobody", None)]}
    df = spark.createDataFrame([("m1", "Text.", entities, [("ev", "Attack", [("t1", "hit", [1, 2]), ("t2", "struck", [3, 4])], args)])], MAVEN)
    row = corpus.flatten_maven(df).first()
    assert (row.id, row.trigger_text, [(a.role, a.text) for a in row.arguments]) == ("m1::ev", "hit", [("Agent", "own words"), ("Agent", "the later army")])


def test_swig_images_and_mapping(spark, tmp_path):
    path = tmp_path / "swig.json"
    path.write_text(json.dumps({"a_1.jpg": {"verb": "arresting", "height": 1, "width": 1, "bb": {}, "frames": [{"suspect": "man", "agent": "police", "place": ""}, {}]}, "b_1.jpg": {"verb": "baking", "height": 1, "width": 1, "bb": {}, "frames": []}}))
    images = files.read_keyed_objects(spark, str(path), "verb string, height int, width int, bb map<string,array<int>>, frames array<map<string,string>>")
    flat = corpus.flatten_swig(images)
    assert {r.image_id: r.frame for r in flat.collect()} == {"a_1.jpg": "agent=police, suspect=man", "b_1.jpg": ""}
    mapping = tmp_path / "mapping.json"
    mapping.write_text(json.dumps({"event_type_map": {" Arresting ": "Justice:Arrest-Jail", "x": ""}, "role_map": {"Justice:Arrest-Jail": {"Suspect": "Person", "agent": "Agent", "place": "Nowhere"}}}))
    types, roles = files.read_mapping(spark, str(mapping), "swig")
    examples, manifest = corpus.normalize_images(flat, types, roles, F.concat(F.lit("/img/"), F.col("image_id")))
    assert [r.skip_reason for r in examples.orderBy("id").collect()] == [None, "unmapped_event_type:baking"]
    assert sorted((a.role, a.label) for a in examples.where("skip_reason is null").first().image_arguments) == [("Agent", "police"), ("Person", "man")]
    assert [(r.image_id, r.path) for r in manifest.collect()] == [("a_1.jpg", "/img/a_1.jpg")]


def test_normalized_text_events_and_reasons(spark):
    types = spark.createDataFrame([("ace2005", "Conflict:Attack", "Conflict:Attack")], "dataset string, raw_type string, event_type string")
    roles = spark.createDataFrame([("ace2005", "Conflict:Attack", "Victim", "Target")], "dataset string, event_type string, raw_role string, role string")
    rows = [(f"d{i}", f"d{i}", t, x, g, [("victim", "town", None), ("Other", "z", None)]) for i, (t, x, g) in enumerate([("conflict:attack ", "They hit a town.", "hit"), ("Unknown:Event", "x", "y"), ("Conflict:Attack", "", "y"), ("Conflict:Attack", "x", "")])]
    flat = spark.createDataFrame(rows, "doc_id string, id string, raw_type string, text string, trigger_text string, arguments array<struct<role:string,text:string,span:struct<start:int,end:int>>>")
    out = corpus.normalize_text_events(flat, types, roles, "ace2005")
    assert {r.id: r.skip_reason for r in out.collect()} == {"d0": None, "d1": "unmapped_event_type:unknown:event", "d2": "missing_raw_text", "d3": "missing_trigger"}
    assert [(a.role, a.text) for a in corpus.kept(out).first().text_arguments] == [("Target", "town")]
    bad = spark.createDataFrame([("ace2005", "Conflict:Attack", "No:Type")], "dataset string, raw_type string, event_type string")
    with pytest.raises(Exception, match="unsupported event type"):
        corpus.map_event_types(flat, bad, "ace2005").collect()


def test_only_allowed_fields_reach_a_model(spark):
    df = spark.createDataFrame([("1", "t", ["t"], "i.jpg", "Conflict:Attack", "gold")], "id string, text string, words array<string>, image string, event_type string, meta string")
    assert corpus.model_input(df).columns == ["id", "text", "words", "image"]


def test_vector_search_filters_first_and_ranks(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "Life:Die"), (2, [0.6, 0.8], "Life:Die"), (3, [0.0, 1.0], "Contact:Meet"), (4, [1.0, 0.0], "Contact:Meet")], "id long, v array<float>, event_type string")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "qid long, qv array<float>")
    hits = vectors.top_k(q, rows, 2, "qid", "id", "qv", "v").orderBy("rank").collect()
    assert [(r.rank, r.id) for r in hits] == [(1, 1), (2, 4)]
    only = vectors.top_k(q, rows, 2, "qid", "id", "qv", "v", F.col("event_type") == "Life:Die").orderBy("rank").collect()
    assert [r.id for r in only] == [1, 2] and abs(only[1].score - 0.6) < 1e-6
    sinks.save_index(rows.select("id", F.col("v").alias("embedding")), str(tmp_path / "ix"), 2, index_name="t")
    assert files.load_index(spark, str(tmp_path / "ix")).count() == 4
    with pytest.raises(ValueError):
        sinks.save_index(rows.select("id", F.col("v").alias("embedding")).limit(0), str(tmp_path / "iy"), 2)
    assert set(files.existing_indexes(spark, {"a": str(tmp_path / "ix"), "b": str(tmp_path / "nope")})) == {"a"}


def test_evidence_keeps_the_best_relevant_items(spark):
    schema = "query_id int, query string, source string, title string, snippet string, score double, published_at string, _pos int"
    rows = [(1, "protest in city", "crowd march", "City protest grows", "a crowd", 0.9, "2024-03-30", 0), (1, "protest in city", "crowd march", "cooking", "recipes", 1.0, "2024-03-30", 1), (1, "protest in city", "crowd march", "protest", "march in city", 0.5, None, 2)]
    got = evidence.rerank(spark.createDataFrame(rows, schema), F.lit("2024-03-31 00:00:00").cast("timestamp")).orderBy("rank").collect()
    assert [r._pos for r in got] == [0, 2]


EVENT = """id string, event_type string, trigger struct<text:string,modality:string,span:struct<start:int,end:int>>, text_arguments array<struct<role:string,text:string,span:struct<start:int,end:int>>>,
image_arguments array<struct<role:string,label:string,bbox:array<double>,grounding_status:string>>, tokens array<string>, seen boolean"""
WORDS = "the police arrested President Barack Obama in a street".split()


def event(kind="Justice:Arrest-Jail", trigger=("arrested", "text", (2, 3)), text=(), image=(), seen=True):
    return ("e", kind, trigger, list(text), list(image), WORDS, seen)


def issues(spark, *rows):
    df = verify.with_diagnostics(spark.createDataFrame(list(rows), EVENT), image_evidence="seen")
    return [[(d.field_path, d.issue_type) for d in r.diagnostics] for r in df.collect()]


def test_diagnostics(spark):
    got = issues(
        spark,
        event(),
        event(text=[("Person", "President Barack Obama", (3, 6)), ("Agent", "the police", (0, 2)), ("Boss", "x", None), ("Place", "street", (0, 1)), ("Place", "street", (5, 99))]),
        event(kind="Nope", trigger=("x", "image", (9, 9)), image=[("Place", "Street", None, "grounded"), ("", "", [1.0], "unresolved")], seen=False),
    )
    assert got[0] == []
    assert got[1] == [
        ("text_arguments[2].role", "invalid_role"),
        ("text_arguments[0].text", "contains_person_title_prefix"), ("text_arguments[0].span", "unnormalized_head_word"),
        ("text_arguments[1].text", "contains_determiner"), ("text_arguments[1].span", "unnormalized_head_word"),
        ("text_arguments[3].span", "span_mismatch"), ("text_arguments[4].span", "invalid_span"),
    ]
    assert got[2] == [
        ("event_type", "unsupported_event_type"), ("trigger.modality", "invalid_modality"), ("trigger.span", "span_mismatch"),
        ("image_arguments[0].label", "generic_weak_place"), ("image_arguments[0].grounding_status", "invalid_grounding_status"),
        ("image_arguments[1].role", "missing_or_empty"), ("image_arguments[1].label", "missing_or_empty"), ("image_arguments[1].grounding_status", "invalid_grounding_status"), ("image_arguments[1].bbox", "invalid_bbox_format"),
        ("image_arguments", "missing_image_evidence"),
    ]


def test_alignment_and_repair(spark):
    df = spark.createDataFrame([event(trigger=("arrested", "text", (0, 1)), text=[("Person", "President Barack Obama", None), ("Agent", "nobody", (1, 2))], image=[("Place", "street", None, "unresolved"), ("Person", "man", None, "unresolved")])], EVENT)
    row = verify.align_events(df).first()
    assert tuple(row.trigger.span) == (2, 3)
    assert [(a.role, a.text, tuple(a.span)) for a in row.text_arguments] == [("Person", "Barack Obama", (4, 6))]
    assert [(d.field_path, d.issue_type) for d in row.alignment] == [("text_arguments[1].span", "span_mismatch")]
    assert [a.label for a in verify.drop_weak_places(df).first().image_arguments] == ["man"]
    assert [a.label for a in verify.drop_flagged_weak_places(verify.with_diagnostics(df)).first().image_arguments] == ["man"]
    asked = df.select(verify.grounding_requests(F.col("image_arguments")).alias("r")).first().r
    assert [a.grounding_query for a in asked] == ["Place: street", "Person: man"]
    assert df.select(verify.candidate_queries(F.lit("Person: man || man | Boy")).alias("q")).first().q == ["Person: man", "man", "Boy"]
    new = F.struct(F.lit("Life:Die").alias("event_type"), F.col("trigger"), F.transform("text_arguments", lambda a: a.withField("role", F.lit("Place")).withField("text", F.lit("new"))).alias("text_arguments"), F.col("image_arguments"))
    merged = verify.merge_by_paths(df.withColumn("new", new).withColumn("paths", F.array(F.lit("event_type"), F.lit("text_arguments[0].role"), F.lit("text_arguments[1]"))), "new").first()
    assert merged.event_type == "Justice:Arrest-Jail" and [(a.role, a.text) for a in merged.text_arguments] == [("Place", "President Barack Obama"), ("Place", "new")]


def test_verification_ends_after_three_repairs(spark):
    rows = spark.createDataFrame([(1, 0), (2, 2), (3, 9)], "id int, bad int")
    out = providers.verify_and_repair(rows, lambda d: d.withColumn("verified", F.col("bad") <= 0), lambda d: d.withColumn("bad", F.col("bad") - 1))
    assert sorted((r.id, r.verified, r.repair_attempts) for r in out.collect()) == [(1, True, 0), (2, True, 2), (3, False, 3)]


def test_providers_fall_back_by_batch(spark):
    class Doubler:
        schema = "x long, ok boolean"

        def open(self):
            self.ready = True

        def apply(self, batch):
            if (batch.x == 5).any():
                raise ValueError("no")
            return batch.assign(x=batch.x * 2, ok=self.ready)

    rows = spark.range(0, 8, 1, 1).select(F.col("id").alias("x"))
    out = providers.run_provider(rows, Doubler(), 4, lambda b, e: pd.DataFrame({"x": b.x, "ok": False}))
    assert sorted((r.x, r.ok) for r in out.collect()) == sorted([(0, True), (2, True), (4, True), (6, True), (4, False), (5, False), (6, False), (7, False)])


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"samples": [{"id": "1"}, {"id": "2"}]}')
    (tmp_path / "b.json").write_text('[{"id": "3"}]')
    (tmp_path / "c.json").write_text('{"id": "4"}')
    (tmp_path / "d.jsonl").write_text('{"id": "5"}\n\n{"id": "6"}\n')
    (tmp_path / "e.json").write_text('{"id": "7"}\n{"id": "8"}\n')
    (tmp_path / "f.jsonl").write_text('{"id": "9"}\n\nnot json\n{"id": "10"}\n')
    ids = lambda df: [r.id for r in df.collect()]
    read = lambda n, **k: ids(files.read_json_documents(spark, str(tmp_path / n), "id string", **k))
    assert (read("a.json"), read("b.json"), read("c.json"), read("d.jsonl"), read("e.json", kind="corpus")) == (["1", "2"], ["3"], ["4"], ["5", "6"], ["7", "8"])
    with pytest.raises(Exception):
        ids(files.read_jsonl(spark, str(tmp_path / "f.jsonl"), "id string"))
    lenient = files.read_jsonl_lenient(spark, str(tmp_path / "f.jsonl"), "id string")
    assert sorted((r._pos, r.id) for r in lenient.collect()) == [(0, "9"), (3, "10")]
    assert [r.id for r in files.read_jsonl_lenient(spark, str(tmp_path / "f.jsonl"), "id string", 3).collect()] == ["9"]


def test_results_fan_out(spark, tmp_path):
    rows = spark.createDataFrame([("1", "p", "t", True, []), ("2", "p", "t", False, ["x"])], "id string, prediction string, trace string, verified boolean, issues array<string>")
    sinks.write_results(rows, str(tmp_path))
    assert spark.read.json(str(tmp_path / "errors")).first().sample_id == "2"
    assert spark.read.json(str(tmp_path / "summary")).first().asDict() == {"samples": 2, "verified": 1, "with_issues": 1, "skipped": 0}


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    done = lambda: sorted(r.id for r in spark.read.parquet(out).collect())
    for part in (["a", "b"], ["c"]):
        spark.createDataFrame([(i,) for i in part], "id string").coalesce(1).write.mode("append").json(src)
        resume.evaluate_new(spark, src, "id string", lambda d: d, out, ck).awaitTermination()
        assert done() == sorted(set("abc"[: 2 if part[0] == "a" else 3]))


def test_positions_are_dense(spark):
    rows = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "x int")
    assert [r.position for r in ordering.dense_positions(rows, "x").orderBy("x").collect()] == list(range(50))
    assert {r.batch for r in ordering.batches(rows, 20, "x").collect()} == {0, 1, 2}


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "before one two three four after"), (2, "one two"), (3, None), (4, "(one two three four)")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three four"), (8, "two three four after")], "item_id long, text string")
    assert sorted(map(tuple, phrases.containing(docs, items).collect())) == [(1, 7), (1, 8), (4, 7)]


def test_last_batch_wraps_around(spark):
    for n, size in ((7, 3), (6, 3), (2, 5), (0, 4)):
        rows = spark.createDataFrame([(i, -i) for i in range(n)], "id long, ratio long")
        got = sorted((r.batch, r.id) for r in ordering.batches(rows, size, "ratio", wrap=True).collect())
        order = list(range(n))[::-1]
        assert got == sorted((i // size, order[x % n]) for i in range(0, n, size) for x in range(i, i + size))
