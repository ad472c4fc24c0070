"""Scores and error taxonomy on inline samples."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from eventweave.operators import errors, matching, scoring

GOLD = """id string, event_type string, text_event_mentions array<struct<event_type:string,trigger:struct<start:int,end:int,text:string>,arguments:array<struct<role:string,start:int,end:int,text:string>>>>,
image_event struct<event_type:string,role:map<string,array<struct<image_ref:string,bbox:array<double>>>>>, image_arguments_flat array<struct<event_type:string,role:string,bbox:array<double>>>, meta struct<crossmedia_event_type:string>"""
PRED = "id string, prediction struct<event_type:string,trigger:struct<text:string,start:int,end:int>,text_arguments:array<struct<role:string,text:string,start:int,end:int>>,image_arguments:array<struct<role:string,bbox:array<double>>>>, _pos int"
ATTACK, MEET, ARREST = "Conflict:Attack", "Contact:Meet", "Justice:Arrest-Jail"


def gold(i, kind, text=(), image=(), trigger=(0, 1)):
    args = [{"role": r, "start": a, "end": b, "text": ""} for r, a, b in text]
    return {"id": i, "event_type": kind, "text_event_mentions": [{"event_type": kind, "trigger": {"start": trigger[0], "end": trigger[1], "text": ""}, "arguments": args}], "image_event": None, "image_arguments_flat": [{"event_type": kind, "role": r, "bbox": [float(x) for x in b]} for r, b in image], "meta": None}


def pred(i, kind, text=(), image=(), trigger=(0, 1), pos=0):
    t = None if trigger is None else {"text": "", "start": trigger[0], "end": trigger[1]}
    return {"id": i, "prediction": {"event_type": kind, "trigger": t, "text_arguments": [{"role": r, "text": "", "start": a, "end": b} for r, a, b in text], "image_arguments": [{"role": r, "bbox": b and [float(x) for x in b]} for r, b in image]}, "_pos": pos}


def scored(spark, golds, preds, **how):
    return scoring.score_samples(scoring.paired(spark.createDataFrame(golds, GOLD), spark.createDataFrame(preds, PRED)), **how)


def test_alias_types_count_as_right(spark):
    rows = scored(spark, [gold("a", ARREST)], [pred("a", "Justice:ArrestJail")])
    event = {r.metric: r for r in scoring.totals(rows).collect()}["event"]
    assert (event.tp, event.precision, event.recall, event.f1) == (1, 1.0, 1.0, 1.0)


def test_exact_arguments_gate_and_missing_predictions(spark):
    golds = [gold("a", ATTACK, [("Target", 2, 3)]), gold("b", ATTACK, [("Target", 2, 3)]), gold("c", ATTACK, [("Target", 5, 6)])]
    preds = [pred("a", ATTACK, [("Target", 9, 10)], pos=0), pred("a", ATTACK, [("Target", 2, 3)], pos=1), pred("b", MEET, [("Target", 2, 3)])]
    got = {r.metric: (r.tp, r.pred, r.gold) for r in scoring.totals(scored(spark, golds, preds)).collect()}
    assert got["text"] == (1, 2, 3)
    assert got["gated_text"] == (1, 1, 1)
    assert got["event"] == (1, 2, 3)


def test_null_triggers_are_equal_and_can_be_ignored(spark):
    g = gold("a", ATTACK, [("Target", 2, 3)])
    g["text_event_mentions"][0]["trigger"] = None
    assert scored(spark, [g], [pred("a", ATTACK, [("Target", 2, 3)], trigger=None)]).by_sample().first().text_tp == 1
    far = pred("a", ATTACK, [("Target", 2, 3)], trigger=(7, 8))
    assert scored(spark, [g], [far]).by_sample().first().text_tp == 0
    assert scored(spark, [g], [far], ignore_trigger=True).by_sample().first().text_tp == 1


def test_meeting_roles_have_aliases_in_meetings_only(spark):
    rows = scored(spark, [gold("a", MEET, [("Participant", 2, 3)]), gold("b", "Conflict:Demonstrate", [("Participant", 2, 3)])], [pred("a", MEET, [("Entity", 2, 3)]), pred("b", "Conflict:Demonstrate", [("Entity", 2, 3)])])
    assert {r.sample_id: r.text_tp for r in rows.by_sample().collect()} == {"a": 1, "b": 0}
    assert [tuple(r) for r in scoring.alias_rescues(rows).collect()] == [("text", MEET, "Participant", "Entity", 1)]
    raw = [tuple(r) for r in scoring.role_confusions(rows, normalized=False).orderBy("event_type").collect()]
    assert raw == [("text", "Conflict:Demonstrate", "Participant", "Entity", 1), ("text", MEET, "Participant", "Entity", 1)]
    assert [tuple(r)[1] for r in scoring.role_confusions(rows).collect()] == ["Conflict:Demonstrate"]


def test_boxes_of_the_role_map_are_used_without_a_flat_list(spark):
    g = gold("a", ATTACK) | {"image_event": {"event_type": ATTACK, "role": {"Target": [{"image_ref": "x", "bbox": [0.0, 0.0, 10.0, 10.0]}]}}}
    row = scored(spark, [g], [pred("a", ATTACK, image=[("Target", [1, 1, 11, 11])])]).by_sample().first()
    assert row.image_tp == 1 and len(row.gold_image) == 1


def test_counts_by_type_and_role_add_up(spark):
    golds = [gold("a", ATTACK, [("Target", 2, 3), ("Place", 4, 5)], [("Target", [0, 0, 9, 9])]), gold("b", MEET, [("Place", 4, 5)])]
    preds = [pred("a", ATTACK, [("Target", 2, 3), ("Target", 2, 3)], [("Target", [0, 0, 9, 9])]), pred("b", ATTACK, [("Place", 4, 5)])]
    got = {(r.level, r.event_type, r.role): (r.tp, r.pred, r.gold) for r in scoring.by_type_and_role(scored(spark, golds, preds)).collect()}
    assert got[("all", None, None)] == (2, 4, 4)
    assert got[("type", ATTACK, None)] == (2, 3, 3)
    assert got[("role", ATTACK, "Target")] == (2, 3, 2)
    assert got[("role", MEET, "Place")] == (0, 1, 1)


def plain_greedy(preds, golds, threshold):
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        if w <= 0 or h <= 0:
            return 0.0
        return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)

    free, out = list(range(len(golds))), []
    for r, b in preds:
        fit = [(iou(b, golds[k][1]), -k) for k in free if golds[k][0] == r and iou(b, golds[k][1]) > threshold]
        k = -max(fit)[1] if fit else -1
        out.append(k)
        if k >= 0:
            free.remove(k)
    return out


def test_greedy_boxes_agree_with_a_plain_loop(spark):
    rng = random.Random(4)
    box = lambda: (lambda x, y: [x, y, x + rng.randint(1, 4), y + rng.randint(1, 4)])(rng.randint(0, 3), rng.randint(0, 3))
    items = lambda: [(rng.choice(["Target", "Place"]), box()) for _ in range(rng.randint(0, 6))]
    samples = [(str(i), items(), items()) for i in range(300)]
    rows = scored(spark, [gold(i, ATTACK, image=g) for i, g, _ in samples], [pred(i, ATTACK, image=p) for i, _, p in samples], image_iou=0.3)
    got = {r.sample_id: r.partners for r in rows.by_sample().collect()}
    assert got == {i: plain_greedy(p, g, 0.3) for i, g, p in samples}


def test_text_buckets(spark):
    g = gold("a", ATTACK, [("Target", 0, 2), ("Attacker", 7, 9), ("Place", 12, 14)])
    p = pred("a", ATTACK, [("Attacker", 0, 2), ("Attacker", 7, 10), ("Bogus", 20, 21)])
    got = {r.counter: r.n for r in errors.counts(errors.breakdown_events(scored(spark, [g], [p]))).collect()}
    want = {"text.fp_wrong_role_same_span": 1, "text.fn_wrong_role_same_span": 1, "text.fp_boundary_error_same_role": 1, "text.fn_boundary_error_same_role": 1, "text.fp_role_outside_schema": 1, "text.pred_role_illegal_under_pred_event": 1, "text.pred_role_outside_gold_schema_union": 1, "text.fn_missing_argument": 1, "text.total_fp": 3, "text.total_fn": 3}
    assert {k: v for k, v in got.items() if v} == want
    assert len(got) == 37


def test_image_buckets(spark):
    g = gold("a", ATTACK, image=[("Target", [0, 0, 10, 10]), ("Place", [20, 20, 30, 30]), ("Instrument", [50, 50, 60, 60])])
    p = pred("a", ATTACK, image=[("Attacker", [0, 0, 10, 10]), ("Place", [10, 10, 40, 40]), ("Instrument", [80, 80, 90, 90]), ("Target", None)])
    got = {r.counter: r.n for r in errors.counts(errors.breakdown_events(scored(spark, [g], [p]), low=0.1)).collect() if r.n}
    assert got == {"image.fp_wrong_role_correct_box": 1, "image.fn_wrong_role_correct_box": 1, "image.fp_box_not_precise_enough_oversized": 1, "image.fn_box_not_precise_enough_oversized": 1, "image.fp_no_overlap_same_role": 1, "image.fn_no_overlap_same_role": 1, "image.fp_spurious_argument": 1, "image.total_fp": 4, "image.total_fn": 3}


def test_wrong_and_missing_types(spark):
    golds = [gold("a", ATTACK, [("Target", 0, 2)]), gold("b", ATTACK, [("Target", 0, 2)])]
    events = errors.breakdown_events(scored(spark, golds, [pred("a", MEET, [("Place", 5, 6)])]))
    got = {(r.sample_id, r.counter): r.n for r in events.collect()}
    assert got[("a", "text.fp_due_to_wrong_event_type")] == 1 and got[("a", "text.event_type_mismatch_samples")] == 1
    assert got[("b", "text.fn_due_to_missing_event_type")] == 1
    assert {r.counter: len(r.samples) for r in errors.examples(events, 1).collect()}["text.fn_due_to_missing_event_type"] == 1


def test_categories(spark):
    golds = [gold("long", ATTACK, [("Target", 6, 7)]), gold("swap", ATTACK, [("Target", 6, 7)]), gold("few", ATTACK, image=[("Target", [0, 0, 9, 9]), ("Target", [20, 20, 29, 29])]), gold("fine", ATTACK)]
    preds = [pred("long", ATTACK, [("Target", 4, 7)]), pred("swap", ATTACK, [("Place", 6, 7)]), pred("few", ATTACK, image=[("Target", [0, 0, 9, 9])]), pred("fine", ATTACK)]
    trace = "sample_id string, stage_c_output struct<image_arguments:array<struct<role:string,label:string>>>, grounding_results array<struct<role:string,grounding_status:string>>, verifier_output struct<verified:boolean>"
    traces = spark.createDataFrame([("few", ([("Target", "a man"), ("Target", "a car")],), [("Target", "grounded"), ("Target", "failed")], (True,)), ("fine", ([],), [], (False,))], trace)
    got = {r.sample_id: set(r.categories) for r in errors.error_categories(scored(spark, golds, preds), traces).collect()}
    assert got["long"] == {"text_arg_missing", "text_arg_extra", "text_arg_boundary_overlong"}
    assert got["swap"] == {"text_arg_missing", "text_arg_extra", "text_arg_role_mismatch"}
    assert got["few"] == {"image_arg_missing", "image_arg_same_role_instance_shortfall", "grounding_failed_after_stage_c_candidate", "verifier_false_accept"}
    assert got["fine"] == {"verifier_false_reject"}
    assert errors.category_counts(errors.error_categories(scored(spark, golds, preds))).first().text_arg_missing == 2


def test_verb_metrics(spark):
    rows = [("i1", "run", "run", "a", True, True), ("i1", "run", "run", "b", False, True), ("i2", "run", "sit", "a", True, False), ("i3", "sit", "sit", "a", True, True)]
    got = scoring.verb_metrics(spark.createDataFrame(rows, "image string, verb string, pred_verb string, role string, noun_ok boolean, box_ok boolean")).first()
    assert (round(got.verb, 6), round(got.value, 6), got.value_all, round(got.value_bbox, 6), got.value_all_bbox) == (round(2 / 3, 6), round((2 / 3 + 1) / 2, 6), (0.5 + 1) / 2, round((1 / 3 + 1) / 2, 6), 0.5)


def test_published_figures_follow_from_their_counts(spark):
    rows = spark.createDataFrame([(271, 293, 309, 0.9249, 0.8770, 0.9003), (134, 544, 465, 0.2463, 0.2882, 0.2656), (347, 1410, 1460, 0.2461, 0.2377, 0.2418)], "tp int, pred int, gold int, p double, r double, f double")
    for r in rows.select("p", "r", "f", *scoring.precision_recall(F.col("tp"), F.col("pred"), F.col("gold"))).collect():
        assert abs(r.precision - r.p) < 6e-5 and abs(r.recall - r.r) < 6e-5 and abs(r.f1 - r.f) < 6e-5


def test_grounding_results_go_to_arguments_in_order(spark):
    arg = "array<struct<role:string,label:string,bbox:array<double>,grounding_status:string>>"
    args = [("Target", "car", None, "unresolved"), ("Target", "car", None, "unresolved"), ("Place", "hall", [1.0, 1.0, 2.0, 2.0], "grounded")]
    results = [("Target", "car", None, "failed"), ("Target", "car", [5.0, 5.0, 6.0, 6.0], "grounded")]
    df = spark.createDataFrame([(args, results)], f"args {arg}, results {arg}")
    got = df.select(matching.attach_grounding(F.col("args"), F.col("results")).alias("x")).first().x
    assert [a.grounding_status for a in got] == ["grounded", "unresolved", "grounded"] and got[0].bbox == [5.0, 5.0, 6.0, 6.0]
