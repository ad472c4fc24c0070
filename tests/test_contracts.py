"""Edges of the operators' contracts: odd sources, refused indexes, repeated keys, wrappers of model answers."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventweave.functions import bbox, spans, text
from eventweave.operators import corpus, errors, evidence, matching, ordering, providers, records, scoring, vectors, verify
from eventweave.plans.corpora import _PIXELS
from eventweave.settings import Settings
from eventweave.sources import files, sinks
from test_scoring import ATTACK, MEET, PRED, gold, pred, scored


def test_json_elements_are_read_one_by_one(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1"}, 3, {"id": "2"}, null, "x"]')
    (tmp_path / "b.json").write_text('{"samples": null, "data": [{"id": "3"}]}')
    (tmp_path / "c.jsonl").write_text('{"id": "4"}\n5\n\n[6]\n')
    (tmp_path / "d.json").write_text('{"id": "7"}\n{"id": "8"}\n')
    read = lambda n, **k: [r.id for r in files.read_json_documents(spark, str(tmp_path / n), "id string", **k).collect()]
    assert (read("a.json"), read("b.json"), read("c.jsonl")) == (["1", "2"], ["3"], ["4"])
    assert read("d.json", kind="corpus") == ["7", "8"]
    with pytest.raises(ValueError):
        read("d.json", kind="corpus", fall_back=False)
    (tmp_path / "e.jsonl").write_text('{"id": "1"}\nbroken {\n[1]\n\n{"id": "2"}')
    assert [(r._pos, r.id) for r in files.read_jsonl_lenient(spark, str(tmp_path / "e.jsonl"), "id string").orderBy("_pos").collect()] == [(0, "1"), (4, "2")]


def test_a_refused_index_leaves_the_old_one(spark, tmp_path):
    root = str(tmp_path / "ix")
    rows = lambda *v: spark.createDataFrame([(i, x) for i, x in enumerate(v)], "row long, embedding array<float>")
    sinks.save_index(rows([1.0, 0.0], [0.0, 1.0]), root, kind="text")
    for bad in (rows(), rows([1.0]), rows([float("nan"), 0.0]), rows(None)):
        with pytest.raises(ValueError):
            sinks.save_index(bad, root, 2)
        with pytest.raises(ValueError):
            sinks.add_to_index(bad, root)
    assert files.load_index(spark, root).count() == 2
    sinks.add_to_index(rows([0.6, 0.8]), root)
    assert files.load_index(spark, root).count() == 3 and files.read_manifest(spark, root)["embedding_dim"] == 2
    sinks.save_index(rows([1.0]), root)
    assert files.load_index(spark, root).count() == 1 and len([p for p in (tmp_path / "ix").iterdir() if p.name.startswith("vectors")]) == 1
    assert set(files.existing_indexes(spark, {"a": root, "b": str(tmp_path / "none")})) == {"a"}
    assert (files.index_name("/x/ace2005.text.jsonl"), files.index_name("my.own.jsonl")) == ("ace_text", "my_own")


def test_embedding_shards_with_metadata(spark, tmp_path):
    for name, n in (("a", 3), ("b", 0)):
        np.save(tmp_path / f"{name}.emb.npy", np.arange(2.0 * n).reshape(n, 2))
        (tmp_path / f"{name}.meta.jsonl").write_text("".join(json.dumps({"id": f"{name}{i}"}) + "\n" for i in range(n)))
    got = files.read_embedding_shards(spark, str(tmp_path), "id string").orderBy("row").collect()
    assert [(r.id, r.embedding) for r in got] == [("a0", [0.0, 1.0]), ("a1", [2.0, 3.0]), ("a2", [4.0, 5.0])]
    (tmp_path / "a.meta.jsonl").write_text('{"id": "a0"}\n')
    with pytest.raises(ValueError, match="3 vectors, 1 lines"):
        files.read_embedding_shards(spark, str(tmp_path), "id string")


def test_odd_vectors_take_no_part(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 0.0]), (3, [0.6, 0.8]), (4, None), (5, [0.0, 1.0]), (6, [None, 1.0])], "id long, v array<double>")
    hits = vectors.top_k(rows, rows, 3, "id", "id", "v", "v")
    assert sorted((r.query_id, r["rank"], r.id) for r in hits.collect()) == [(1, 1, 1), (1, 2, 3), (1, 3, 5), (3, 1, 3), (3, 2, 5), (3, 3, 1), (5, 1, 5), (5, 2, 3), (5, 3, 1)]


def test_layers(spark):
    index = lambda *r: spark.createDataFrame(list(r), "row long, event_type string, embedding array<double>")
    ask = lambda *r: spark.createDataFrame(list(r), "query_id long, event_type string, embedding array<double>")
    indexes = {"ace_text": index((1, MEET, [1.0, 0.0]), (2, ATTACK, [1.0, 0.0])), "maven_text": index((1, MEET, [1.0, 0.0]), (7, MEET, [0.0, 1.0])), "bridge": index((3, ATTACK, [1.0, 0.0]))}
    q = ask((1, MEET, [1.0, 0.0]), (2, "", [1.0, 0.0]))
    hits = vectors.layered_retrieve({n: q for n in ("ace_text", "maven_text", "swig_text", "bridge")}, indexes, {"text": 2, "bridge": 0})
    got = sorted((r.layer, r.query_id, r["rank"], r.index_name, r.row) for r in hits.collect())
    assert got == [("bridge", 2, 1, "bridge", 3), ("text", 1, 1, "ace_text", 1), ("text", 1, 2, "maven_text", 1), ("text", 2, 1, "ace_text", 1), ("text", 2, 2, "ace_text", 2)]
    states = spark.createDataFrame([(1, " t ", "i", ""), (2, "", "i", "e"), (3, None, None, None)], "id long, text string, image_desc string, event_type string")
    assert [tuple(r)[2:] for r in vectors.retrieval_queries(states).orderBy("query_id").collect()] == [("t", "t i", "t i"), ("e", "i e", "e i"), (None, None, None)]
    vectors.layer_views({"text": states}, spark, "t_")
    assert spark.table("t_text").count() == 3
    vectors.layer_views(None, spark, "t_")
    assert not spark.catalog.tableExists("t_text")
    loads = []
    cache = vectors.IndexCache(lambda s, root: loads.append(root) or states)
    assert cache.get(spark, "r", k=1) is cache.get(spark, "r", k=1) and cache.get(spark, "r", k=2) is not None and loads == ["r", "r"]


def test_evidence_needs_all_four_texts(spark):
    rows = [("t", "s", "u", "news", "0.5"), ("t", "s", "u", "news", None), ("", "s", "u", "news", "1"), ("t", " ", "u", "news", "1"), ("t", "s", "u", "", "1"), ("t", "s", "u", "news", "x"), ("t", "s", "u", "news", "7")]
    df = spark.createDataFrame(rows, "title string, snippet string, url string, source_type string, score string")
    assert sorted(r.score for r in evidence.valid_evidence(df).collect()) == [0.0, 0.5, 1.0]
    answer = json.dumps({"results": [{"title": "a", "content": " c ", "snippet": "s", "url": "u", "published_date": "2024-01-01", "score": 3}, {"title": "", "content": "c", "url": "u"}, {"title": "b", "snippet": "s", "url": "v"}]})
    hits = evidence.search_hits(spark.createDataFrame([(1, answer), (2, "oops"), (3, None)], "q long, response string")).orderBy("_pos").collect()
    assert [(r.q, r._pos, r.title, r.snippet, r.published_at, r.score, r.source_type) for r in hits] == [(1, 0, "a", "c", "2024-01-01", 1.0, "search"), (1, 2, "b", "s", None, 0.0, "search")]


def test_records_without_a_prediction_field_are_read(spark):
    flat = pred("a", ATTACK, [("Target", 2, 3)], [("Target", [0, 0, 9, 9])])
    own = PRED.replace("prediction struct<", "").replace(">>>, _pos int", ">>, _pos int").replace("event_type:string,trigger:", "event_type string, trigger ").replace(",text_arguments:", ", text_arguments ").replace(",image_arguments:", ", image_arguments ")
    df = spark.createDataFrame([{"id": "a", "_pos": 0, **flat["prediction"]}], own)
    rows = scoring.score_samples(scoring.paired(scored_gold(spark, [gold("a", ATTACK, [("Target", 2, 3)], [("Target", [0, 0, 9, 9])])]), df)).by_sample().first()
    assert (rows.event_tp, rows.text_tp, rows.image_tp) == (1, 1, 1)
    mixed = spark.createDataFrame([{"id": "b", "_pos": 0, "prediction": None, "event_type": ATTACK}], PRED + ", event_type string")
    assert scoring.predicted_items(mixed).first().pred_type == ATTACK
    bad = scoring.invalid_boxes(spark.createDataFrame([pred("a", ATTACK, image=[("Target", [0, 0, 9, 9]), ("Place", None), ("Place", [1, 2])])], PRED))
    assert [(r.sample_id, r["index"], r.role) for r in bad.orderBy("index").collect()] == [("a", 1, "Place"), ("a", 2, "Place")]


def scored_gold(spark, rows):
    from test_scoring import GOLD

    return spark.createDataFrame(rows, GOLD)


def test_of_equal_mapping_keys_the_last_counts(spark):
    rows = spark.createDataFrame([(1, "click", [("A", "x"), ("a ", "y"), ("b", "z")]), (2, "none", None)], "id long, raw_type string, arguments array<struct<role:string,text:string>>")
    types = spark.createDataFrame([("w", "Click", ATTACK), ("w", " click", MEET)], "dataset string, raw_type string, event_type string").coalesce(1)
    roles = spark.createDataFrame([("w", MEET, "A", "Place"), ("w", MEET, "a", "Participant"), ("w", MEET, "b", "Giver")], "dataset string, event_type string, raw_role string, role string").coalesce(1)
    typed = corpus.map_event_types(rows, types, "w")
    assert sorted((r.id, r.event_type) for r in typed.collect()) == [(1, MEET), (2, None)]
    got = {r.id: [tuple(a) for a in r.arguments] for r in corpus.map_roles(typed, roles, "w").collect()}
    assert got == {1: [("Participant", "x"), ("Participant", "y")], 2: []}


def test_texts_and_triggers_of_raw_records(spark):
    rows = spark.sql("""select 1 as id, array('a ', 'b') as text, named_struct('text', ' hit ', 'span', cast(null as struct<start:int,end:int>), 'start', 2, 'end', 3) as trigger, 'x' as mention, 4 as trigger_start, 5 as trigger_end
        union all select 2, null, named_struct('text', '', 'span', null, 'start', null, 'end', null), 'fall', 4, 5""")
    got = rows.select("id", corpus.text_of(rows, "raw_text", "text").alias("t"), corpus.trigger_of(rows).alias("g")).orderBy("id").collect()
    assert [(r.t, r.g.text, tuple(r.g.span)) for r in got] == [("a b", "hit", (2, 3)), ("", "fall", (4, 5))]
    plain = spark.createDataFrame([(1, "hit"), (2, "")], "id long, trigger string")
    assert [r.g and (r.g.text, r.g.span) for r in plain.select(corpus.trigger_of(plain).alias("g")).collect()] == [("hit", None), None]
    assert [r.s and tuple(r.s) for r in spark.sql("select explode(array(array(1, 2), array(1), array(1, null))) as v").select(spans.span_of(F.col("v")).alias("s")).collect()] == [(1, 2), None, None]


def test_layer_examples_and_manifests(spark):
    made = corpus.text_examples(spark.createDataFrame([(7, MEET, "met", [("Place", "hall")])], "id long, event_type string, trigger string, text_arguments array<struct<role:string,text:string>>")).first()
    assert (made.id, made.trigger.text, made.source_dataset, made.retrieval_text) == ("7", "met", "", f"{MEET} met Place hall")
    image = corpus.image_examples(spark.createDataFrame([("i", "seen", [("Place", "hall")])], "id string, image_desc string, image_roles array<struct<role:string,label:string>>")).first()
    assert (image.modality, image.retrieval_text) == ("image_semantics", "seen Place hall")
    assert corpus.bridge_examples(spark.createDataFrame([("b", "Place", ["in"], None)], "id string, role string, text_cues array<string>, visual_cues array<string>")).first().retrieval_text == "Place in"
    png = bytes.fromhex(_PIXELS[0])
    images = spark.createDataFrame([("file:/a.png", png), ("file:/b.png", b"junk"), ("file:/c.jpg", bytes.fromhex("FFD8FFE0"))], "path string, content binary")
    rows = spark.createDataFrame([("1", "/a.png"), ("2", "/b.png"), ("3", "/c.jpg"), ("4", "/d.png"), ("5", None)], "image_id string, path string")
    got = {r.image_id: r.error for r in corpus.checked_manifest(rows, images).collect()}
    assert got == {"1": None, "2": "BAD_IMAGE:UnidentifiedImage", "3": "BAD_IMAGE:Truncated", "4": "NOT_FOUND", "5": "NO_PATH"}
    assert [r.skip_reason for r in corpus.with_retrieval_text(spark.createDataFrame([(" ",), ("x",)], "retrieval_text string")).collect()] == ["missing_retrieval_text", None]
    bytes_ = files.with_image_bytes(spark.createDataFrame([("data:image/gif;base64,AAAA",), ("/a.png",), ("http://x/y",), ("z",)], "ref string"), "ref", files=images.withColumn("mime", F.lit("image/png")), fetched=spark.createDataFrame([("http://x/y", b"1", "image/bmp")], "reference string, content binary, mime string"))
    assert {r.ref: (r.mime, r.content and len(r.content)) for r in bytes_.collect()} == {"data:image/gif;base64,AAAA": ("image/gif", 3), "/a.png": ("image/png", 67), "http://x/y": ("image/bmp", 1), "z": (None, None)}
    with pytest.raises(ValueError):
        corpus.select_sample(rows.withColumnRenamed("image_id", "id"), "9")
    assert corpus.select_sample(rows.withColumnRenamed("image_id", "id"), "2").first().path == "/b.png"


def test_of_traces_the_last_counts_and_causes_are_summed(spark):
    golds = [gold("a", ATTACK, [("Target", 6, 7)], [("Place", [0, 0, 9, 9])]), gold("b", ATTACK), gold("c", "")]
    preds = [pred("a", ATTACK, [("Target", 6, 7)]), pred("b", ATTACK), pred("c", ATTACK)]
    kind = "sample_id string, id string, stage_b_output struct<text_arguments:array<struct<role:string,text:string>>>, stage_c_output struct<image_arguments:array<struct<role:string,label:string>>>, verifier_output struct<verified:boolean>, _pos int"
    traces = [("a", None, ([("Target", "the big town")],), ([("Place", "street")],), (True,), 0), (None, "a", ([("Target", "the big town")],), None, (True,), 1), ("b", None, None, None, (True,), 2), ("b", None, None, None, (False,), 3)]
    words = golds[0] | {"words": ["w"] * 6 + ["town"]}
    words["text_event_mentions"][0]["arguments"][0]["text"] = "town"
    from test_scoring import GOLD

    samples = spark.createDataFrame([words], GOLD + ", words array<string>")
    found = errors.error_categories(scored(spark, golds, preds), spark.createDataFrame(traces, kind), samples=samples)
    got = {r.sample_id: r for r in found.collect()}
    assert len(got) == 3 and set(got["a"].categories) == {"image_arg_missing", "stage_c_missing_candidate", "verifier_false_accept"}
    assert got["a"].causes == ["image_argument_recall", "stage_c_missing_candidate", "verifier"] and got["a"].notes == ["broader_text:Target"]
    assert (got["b"].categories, got["c"].categories) == (["verifier_false_reject"], [])
    rows = {(r["kind"], r["name"], r["category"]): r["n"] for r in errors.summary(found).collect()}
    assert rows["samples", "", ""] == 3 and rows["cases", "", ""] == 2 and rows["cause", "verifier", ""] == 2
    assert rows["role", "Place", "image_arg_missing"] == 1 and rows["type", ATTACK, "verifier_false_reject"] == 1 and rows["category", "", "text_arg_extra"] == 0
    weak = errors.error_categories(scored(spark, golds[:1], preds[:1]), spark.createDataFrame(traces[:1], kind)).first()
    assert weak.notes == ["weak_place_dropped"]


def test_positions_come_from_one_dealing(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(40)], "x int, y int")
    assert sorted(r.position for r in ordering.dense_positions(rows, "x", "y").collect()) == list(range(40))


def test_each_repair_round_asks_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def verify_(df):
        def run(batches):
            for b in batches:
                asked.add(len(b))
                yield b.assign(verified=b.x > 2)

        return df.mapInPandas(run, "x long, verified boolean")

    out = providers.verify_and_repair(spark.range(4).select(F.col("id").alias("x")), verify_, lambda d: d.withColumn("x", F.col("x") + 1), 3)
    assert sorted((r.x, r.verified, r.repair_attempts) for r in out.collect()) == [(3, True, 0), (3, True, 1), (3, True, 2), (3, True, 3)]
    assert asked.value == 4 + 3 + 2 + 1


ARGS = "array<struct<role:string,label:string,bbox:array<double>,grounding_status:string>>"


def test_grounding_answers_and_boxes(spark):
    answer = json.dumps({"results": [{"bbox": [1, "2", 3, 4], "score": "0.5"}, "x", {"label": "van", "grounding_status": "odd"}]})
    ask = spark.createDataFrame([(answer, [("P", "man", "P: man"), ("T", "car", "T: car"), ("T", "bus", "T: bus"), ("T", "cab", "T: cab")])], "answer string, requests array<struct<role:string,label:string,grounding_query:string>>")
    got = ask.select(verify.grounding_results(F.col("answer"), F.col("requests")).alias("r"), verify.grounding_results(F.lit("oops"), F.col("requests")).alias("bad")).first()
    assert [(r.role, r.label, r.bbox, r.score, r.grounding_status) for r in got.r] == [("P", "man", [1.0, 2.0, 3.0, 4.0], 0.5, "grounded"), ("T", "car", None, None, "failed"), ("T", "van", None, None, "failed"), ("T", "cab", None, None, "failed")]
    assert {r.grounding_status for r in got.bad} == {"failed"} and len(got.bad) == 4
    boxes = spark.createDataFrame([([("P", "man", [1.0] * 4, "failed"), ("P", "man", [2.0] * 4, "grounded"), ("P", "", [3.0] * 4, "grounded"), ("P", "x", [3.0], "grounded")],)], f"r {ARGS}")
    assert {tuple(k): v for k, v in boxes.select(matching.grounded_boxes(F.col("r")).alias("m")).first().m.items()} == {("P", "man"): [2.0] * 4}
    small = spark.range(1).select(bbox.clamped_iou(F.array(*map(F.lit, (0.0, 0.0, 2.0, 2.0))), F.array(*map(F.lit, (1.0, 1.0, 3.0, 3.0)))).alias("a"), bbox.clamped_iou(F.array(*[F.lit(1.0)] * 4), F.array(*[F.lit(1.0)] * 4)).alias("b")).first()
    assert abs(small.a - 1 / 7) < 1e-12 and small.b == 0.0


EVENT = f"event_type string, trigger struct<text:string,modality:string,span:struct<start:int,end:int>>, text_arguments array<struct<role:string,text:string,span:struct<start:int,end:int>>>, image_arguments {ARGS}, tokens array<string>"


def test_repair_of_spans_and_boxes(spark):
    words = "police arrested a man and a man".split()
    row = (ATTACK, ("arrested", None, (5, 6)), [("Target", "police", (3, 4)), ("Target", "man", (3, 4)), ("Place", "gone", (0, 1))], [("P", "man", None, "unresolved"), ("Q", "car", [1.0] * 4, "grounded")], words)
    df = spark.createDataFrame([(*row, ["trigger.span", "text_arguments[0].span", "text_arguments[1]", "text_arguments[2].text"])], EVENT + ", paths array<string>")
    got = verify.reground(df).first()
    assert tuple(got.trigger.span) == (1, 2) and [(a.text, tuple(a.span)) for a in got.text_arguments] == [("police", (0, 1))]
    plans = spark.createDataFrame([(*row, [("P", "man", [2.0] * 4, "grounded")], [(p, "x", "y")] if p else None) for p in ("image_arguments[0].label", "trigger", None)], EVENT + f", grounding_results {ARGS}, diagnostics array<struct<field_path:string,issue_type:string,suggested_action:string>>")
    assert [r.image_arguments[0].grounding_status for r in verify.apply_grounding(plans).collect()] == ["grounded", "unresolved", "unresolved"]
    lost = spark.createDataFrame([([("P", "man", None, "unresolved"), ("Q", "car", None, "failed")], [("P", "man", [2.0] * 4, "grounded"), ("Q", "car", [2.0] * 4, "grounded")])], f"image_arguments {ARGS}, was {ARGS}")
    assert [a.grounding_status for a in verify.restore_boxes(lost, "was").first().image_arguments] == ["grounded", "failed"]


def test_verdicts(spark):
    answers = ['{"verdict": "yes", "issues": ["a"], "confidence": 7}', '```json\n{"verdict": "NO", "issues": ["a", "b"], "reason": " r "}\n```', '{"verdict": "no", "issues": "c", "confidence": "x", "diagnostics": [{"field_path": "trigger", "issue_type": "t", "suggested_action": "s"}, {"field_path": ""}]}', "no idea", None]
    kind = "answer string, failure string, error string, diagnostics array<struct<field_path:string,issue_type:string,suggested_action:string>>"
    rows = spark.createDataFrame([(a, "timeout" if a is None else None, None, []) for a in answers] + [(answers[0], None, "bad", []), (answers[0], None, None, [("trigger", "invalid_span", "x")])], kind).coalesce(1)
    got = verify.with_verdict(rows, failure="failure").collect()
    assert [r.verified for r in got] == [True, False, False, False, False, False, False]
    assert [r.issues for r in got][:3] == [[], ["a", "b"], ["c"]] and got[4].issues == ["timeout"]
    assert [r.confidence for r in got][:3] == [1.0, 0.0, 0.0] and got[1].reason == "r"
    assert [[d.issue_type for d in r.diagnostics] for r in got] == [[], [], ["t"], ["invalid_verifier_output"], ["verifier_failure"], ["schema_validation_failed"], ["invalid_span"]]
    none = spark.createDataFrame([(None, None, None, None, ["a"]), (ATTACK, (None, None, None), [], [], ["a"])], EVENT).coalesce(1)
    assert [[(d.field_path, d.issue_type) for d in r.diagnostics] for r in verify.with_diagnostics(none).collect()] == [[("event", "invalid_object")], [("trigger", "invalid_object")]]


def test_contexts_histories_and_settings(spark):
    states = spark.createDataFrame([("1", "t", None, ["w"], [("a",)], "data:image/png;base64,AAAA")], "id string, text string, image_desc string, text_tokens array<string>, text_examples array<struct<id:string>>, raw_image string")
    made = records.fusion_context(states).first().fusion_context
    assert (made.raw_text, made.raw_image_desc, len(made.patterns.text), made.patterns.bridge, made.evidence) == ("t", "", 1, [], [])
    assert "text_tokens" not in made.asDict()
    row = states.select(records.memory_entry(F.col("text"), F.col("image_desc")).alias("m"), records.appended(F.lit(None).cast("array<string>"), F.lit("x")).alias("a"), records.appended(F.array(F.lit("x")), F.lit("y")).alias("b"), records.merged_outputs(F.create_map(F.lit("s"), F.lit("1"), F.lit("k"), F.lit("2")), {"s": F.lit('{"i":"data:image/png;base64,AAAA"}')}).alias("o")).first()
    assert [tuple(x) for x in row.m] == [("t", "")] and (row.a, row.b) == (["x"], ["x", "y"]) and row.o == {"k": "2", "s": '{"i":"data:image/png;<redacted>"}'}
    images = spark.createDataFrame([("file:/a.png",)], "path string")
    assert [r.path for r in records.image_query_paths(spark.createDataFrame([("1", " /a.png "), ("2", "/b.png"), ("3", "data:x"), ("4", None)], "id string, raw_image string"), images).collect()] == ["/a.png"]
    answer = spark.createDataFrame([('{"image_desc": " d "}',), ("none",)], "a string").coalesce(1)
    got = [r.p for r in answer.select(records.perception_record(F.col("a"), F.lit("old"), F.lit("t")).alias("p")).collect()]
    assert [tuple(p) for p in got] == [("d", "Text: t\nImage: d"), ("old", "Text: t\nImage: old")]
    assert "strong" not in records.ontology_block(MEET) and "Participant" in records.ontology_block(MEET)
    s = Settings.of({"run_mode": "Open_World ", "enable_search": "on", "search_top_k": "0", "search_min_relevance": "7", "rag_text_top_k": "x", "image_iou": "0.4"})
    assert (s.search, s.search_top_k, s.search_min_relevance, s.rag_text_top_k, s.image_iou) == (True, 1, 1.0, 3, 0.4)
    assert not Settings.of({"run_mode": "odd", "enable_search": "1"}).search
    spark.conf.set("spark.eventweave.rag_text_top_k", "9")
    assert Settings.from_session(spark).top_k() == {"text": 9, "image": 3, "bridge": 3}
    spark.conf.unset("spark.eventweave.rag_text_top_k")
    assert spark.range(1).select(text.file_identity(F.lit("p"), F.lit(0).cast("timestamp"), F.lit(3))).first()[0] != spark.range(1).select(text.file_identity(F.lit("p"), F.lit(1).cast("timestamp"), F.lit(3))).first()[0]
    assert records.first_rows(spark.range(5), 2, "id").count() == 2 and records.first_rows(spark.range(5), None, "id").count() == 5


def test_top_verbs(spark):
    rows = spark.createDataFrame([("i", "run", {"run": 0.5, "sit": 0.5, "fly": 0.1}), ("j", "sit", {"run": 0.9, "sit": 0.8})], "image string, verb string, scores map<string,double>")
    got = {r.image: (r.top, r.accuracy) for r in scoring.verb_accuracy(rows, 2).collect()}
    assert got == {"i": (["run", "sit"], 0.5), "j": (["run", "sit"], 0.5)}


def test_gated_counts_leave_out_wrong_types(spark):
    rows = scored(spark, [gold("a", ATTACK, [("Target", 2, 3)]), gold("b", MEET, [("Place", 4, 5)])], [pred("a", ATTACK, [("Target", 2, 3)]), pred("b", ATTACK, [("Place", 4, 5)])])
    got = {(r.level, r.event_type): (r.tp, r.pred, r.gold) for r in scoring.by_type_and_role(rows, gated=True).where("level != 'role'").collect()}
    assert got == {("all", None): (1, 1, 1), ("type", ATTACK): (1, 1, 1)}


def test_services_that_fail_give_nothing(spark):
    rows = spark.createDataFrame([("a", "war"), ("b", " "), ("c", "odd")], "id string, query string").coalesce(1)

    def post(values):
        if values["query"] == "odd":
            raise TimeoutError
        return json.dumps({"results": [{"title": "t", "content": values["query"], "url": "u"}]})

    assert [(r.id, r.snippet) for r in providers.search_evidence(rows, post).collect()] == [("a", "war")]
    assert providers.search_evidence(rows, None).count() == 0
    asks = spark.createDataFrame([("/a.png", [("P", "man", "P: man")]), ("/b.png", [("P", "man", "P: man"), ("T", "car", "T: car")])], "raw_image string, requests array<struct<role:string,label:string,grounding_query:string>>")
    box = lambda v: json.dumps({"results": [{"bbox": [1, 2, 3, 4]}]}) if v["raw_image"] == "/a.png" else 1 / 0
    got = {r.raw_image: [g.grounding_status for g in r.grounding_results] for r in providers.ground(asks, box).collect()}
    assert got == {"/a.png": ["grounded"], "/b.png": ["failed", "failed"]}


def test_vectors_and_descriptions_of_models(spark):
    rows = spark.createDataFrame([(i, "x" * i) for i in range(5)], "id long, text string").coalesce(1)
    got = providers.encode(rows, lambda texts: [[len(t), 1.0, 9.0] for t in texts], "text", dims=2, batch_rows=2).collect()
    assert [len(r.embedding) for r in got] == [2] * 5 and abs(got[3].embedding[0] - 3 / 10**0.5) < 1e-6
    with pytest.raises(Exception, match="an encoder gave"):
        providers.encode(rows, lambda texts: [1.0], "text").collect()
    states = spark.createDataFrame([("/a.png", "t"), ("/b.png", "t")], "raw_image string, text string").coalesce(1)
    calls = spark.sparkContext.accumulator(0)

    def see(values):
        calls.add(1)
        return json.dumps({"image_desc": values["raw_image"]})

    first = providers.perceive(states, see).collect()
    assert [r.perception.image_desc for r in first] == ["/a.png", "/b.png"] and calls.value == 2
    known = spark.createDataFrame([(first[0].key, first[0].answer)], "key string, answer string")
    again = providers.perceive(states, see, known).collect()
    assert sorted(r.perception.image_desc for r in again) == ["/a.png", "/b.png"] and calls.value == 3
    assert [r.perception.image_desc for r in providers.perceive(states, None).collect()] == ["", ""]


def test_staged_extraction(spark):
    states = spark.createDataFrame([("1", "Justice:Arrest-Jail", True), ("2", "Party", True), ("3", "Life:Die", False)], "id string, kind string, seen boolean")
    select = lambda d: d.withColumn("answer", F.concat(F.lit('{"event_type": "'), "kind", F.lit('"}')))
    read = lambda d: d.withColumn("answer", F.lit('{"trigger": {"text": "t"}, "text_arguments": [{"role": "Person", "text": "man"}]}'))
    look = lambda d: d.withColumn("answer", F.lit('Sure: {"image_arguments": [{"role": "Place", "label": "street", "bbox": [1]}, {"role": "Person", "label": "man"}]}'))
    got = {r.id: r for r in providers.extract(states, select, read, look, image_evidence="seen").collect()}
    assert [(a.role, a.label, a.bbox, a.grounding_status) for a in got["1"].image_arguments] == [("Person", "man", None, "unresolved")]
    assert (got["1"].trigger.text, len(got["1"].text_arguments), got["3"].image_arguments) == ("t", 1, [])
    assert (got["2"].event_type, got["2"].error, got["2"].text_arguments) == ("", "unsupported event_type: Party", [])
    assert {r.id: (r.event_type, r.error) for r in providers.extract(states, select, read, look, "transfer").collect()}["2"] == ("Unsupported", None)


def test_runs_begin_with_inputs_only(spark):
    df = spark.createDataFrame([("1", " t ", ["t"], "i.jpg", "Conflict:Attack"), ("2", None, None, None, None), ("3", "t", [], "/abs.jpg", "x")], "id string, text string, words array<string>, image string, event_type string")
    got = {r.id: r for r in corpus.agent_states(df, Settings(run_mode="open_world", enable_search=True), "/root/img/").collect()}
    assert (got["1"].text, got["1"].raw_image, got["1"].effective_search_enabled, got["2"].raw_image, got["2"].tokens, got["3"].raw_image) == ("t", "/root/img/i.jpg", True, None, [], "/abs.jpg")
    assert "event_type" not in got["1"].asDict()
    gold = spark.createDataFrame([("", "s1", [(MEET, "t", ["a"])], None), ("g", None, None, ATTACK)], "id string, sentence_id string, event_mentions array<struct<event_type:string,trigger:string,arguments:array<string>>>, event_type string")
    assert [(r.sample_id, r.event_type, r.arguments) for r in corpus.gold_annotations(gold).collect()] == [("s1", MEET, ["a"]), ("g", ATTACK, None)]
