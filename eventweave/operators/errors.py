"""Error taxonomy: fine-grained counters, and error categories of samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventweave.functions.bbox import iou, judged, quality_bucket
from eventweave.functions.text import let
from eventweave.ontology import allowed_roles, canonical_role, mentions_weak_place
from eventweave.operators import flat
from eventweave.operators import matching as m
from eventweave.operators.flat import GOLD, PRED
from eventweave.operators.scoring import PLACE, Scored, settle

# Counters of the breakdown and categories of the summary.
TEXT_COUNTERS = (
    "true_positive", "event_type_mismatch_samples", "fp_due_to_wrong_event_type", "fp_wrong_role_same_span", "fp_boundary_error_same_role", "fp_wrong_role_and_boundary",
    "fp_role_outside_schema", "fp_spurious_argument", "fn_due_to_missing_event_type", "fn_wrong_role_same_span", "fn_boundary_error_same_role", "fn_wrong_role_and_boundary",
    "fn_missing_argument", "pred_role_illegal_under_pred_event", "pred_role_outside_gold_schema_union",
)
IMAGE_COUNTERS = (
    "true_positive", "event_type_mismatch_samples", "fp_due_to_wrong_event_type", "fp_wrong_role_correct_box", "fp_box_not_precise_enough_oversized", "fp_box_not_precise_enough_undersized",
    "fp_box_not_precise_enough_shifted", "fp_weak_overlap_same_role", "fp_no_overlap_same_role", "fp_spurious_argument", "fn_due_to_missing_event_type", "fn_wrong_role_correct_box",
    "fn_box_not_precise_enough_oversized", "fn_box_not_precise_enough_undersized", "fn_box_not_precise_enough_shifted", "fn_weak_overlap_same_role", "fn_no_overlap_same_role", "fn_missing_argument",
)
COUNTERS = [*(f"text.{c}" for c in TEXT_COUNTERS), *(f"image.{c}" for c in IMAGE_COUNTERS)]
CATEGORIES = (
    "event_type_mismatch", "text_arg_missing", "text_arg_extra", "text_arg_boundary_overlong", "text_arg_role_mismatch", "image_arg_missing", "image_arg_extra", "image_arg_iou_low",
    "image_arg_generic_weak_place", "image_arg_same_role_instance_shortfall", "grounding_failed_after_stage_c_candidate", "stage_c_missing_candidate", "verifier_false_reject", "verifier_false_accept",
)
# The stage that each category points to.
CAUSES = {
    "event_type_mismatch": "stage_a_event_type_selection", "text_arg_missing": "stage_b_argument_recall", "text_arg_extra": "stage_b_argument_precision", "text_arg_boundary_overlong": "stage_b_text_boundary",
    "text_arg_role_mismatch": "stage_b_role_assignment", "image_arg_missing": "image_argument_recall", "image_arg_extra": "image_argument_precision", "image_arg_iou_low": "grounding_box_quality",
    "image_arg_generic_weak_place": "stage_c_weak_place_proposal", "image_arg_same_role_instance_shortfall": "image_multi_instance_recall",
    "grounding_failed_after_stage_c_candidate": "grounding_failed_after_stage_c_candidate", "stage_c_missing_candidate": "stage_c_missing_candidate", "verifier_false_reject": "verifier", "verifier_false_accept": "verifier",
}


def _text_events(scored: Scored, differ: Column, untyped: Column) -> DataFrame:
    """Text arguments with a partner (gold ones), and those without: of several faults the first counts, from a span that the other side has under another role to one that is nowhere."""
    spare = ~F.col("exact")
    text = flat.same_places(flat.swept_overlaps(scored.exact_text(), PLACE, "near", spare), PLACE, "there", spare)  # both by one sort
    text = flat.swept_overlaps(text, [*PLACE, "role"], "as_role", spare)
    rows = text.where(spare | (F.col("side") == GOLD)).select("*", allowed_roles(F.col("gold_type")).alias("gold_roles"), allowed_roles(F.col("pred_type")).alias("pred_roles"))
    outside = (F.size("gold_roles") > 0) & ~F.array_contains("gold_roles", F.col("role"))
    found = lambda side: F.when(F.col("there"), f"text.{side}_wrong_role_same_span").when(F.col("as_role"), f"text.{side}_boundary_error_same_role").when(F.col("near"), f"text.{side}_wrong_role_and_boundary")
    fp = F.when(differ, "text.fp_due_to_wrong_event_type").otherwise(F.coalesce(found("fp"), F.when(outside, "text.fp_role_outside_schema"), F.lit("text.fp_spurious_argument")))
    fn = F.when(untyped, "text.fn_due_to_missing_event_type").otherwise(F.coalesce(found("fn"), F.lit("text.fn_missing_argument")))
    illegal = (F.col("pred_type") != "") & ~F.array_contains("pred_roles", F.col("role"))
    pred = F.col("side") == PRED
    names = F.array(F.when(F.col("exact"), "text.true_positive").when(pred, fp).otherwise(fn), F.when(pred & illegal, "text.pred_role_illegal_under_pred_event"), F.when(pred & outside, "text.pred_role_outside_gold_schema_union"))
    found = _events(rows, F.explode(F.array_compact(names)))
    hit = F.col("counter") == "text.true_positive"
    return found.withColumn("gold_role", F.when(~hit, F.col("gold_role")))


def _image_events(scored: Scored, differ: Column, untyped: Column, threshold: float, low: float, cover_high: float, purity_low: float) -> DataFrame:
    """Boxes without a partner: a box of another role in their place, else how they miss the box of their role that they share most with."""
    loose = scored.image.where("partner is null")
    pairs = flat.overlapping_boxes(loose, ["sample_id", "event_type"], ["n", "role"])
    ends = [F.struct(F.col(f"{own}_n").alias("n"), F.col(f"{other}_n").alias("other")) for own, other in (("gold", "pred"), ("pred", "gold"))]
    said = pairs.withColumn("same", F.col("gold_role") == F.col("pred_role")).where(F.col("same") | (F.col("iou") >= threshold))
    each = said.select("sample_id", F.explode(F.array(*ends)).alias("e"), "same", "iou", "cover", "purity")
    best = F.max(F.when(F.col("same"), F.struct("iou", (-F.col("e.other")).alias("order"), "cover", "purity")))
    met = each.groupBy("sample_id", F.col("e.n").alias("n")).agg(F.bool_or(~F.col("same") & (F.col("iou") >= threshold)).alias("wrong"), best.alias("best"))
    kind = Window.partitionBy("sample_id", "event_type", "role")
    others = flat.other_side(F.count_if(F.col("side") == GOLD).over(kind), F.count_if(F.col("side") == PRED).over(kind))
    rows = scored.told(loose.withColumn("others", others), met, ["event_type", "role"])
    quality = F.when(F.col("others") > 0, judged(*[F.coalesce(F.col(f"best.{c}"), F.lit(0.0)) for c in ("iou", "cover", "purity")], threshold, low, cover_high, purity_low))

    def bucket(side: str, none: str) -> Column:
        return F.when(F.coalesce("wrong", F.lit(False)), f"image.{side}_wrong_role_correct_box").when(quality.isNull(), none).otherwise(quality_bucket(quality, side))

    fp = F.when(differ, "image.fp_due_to_wrong_event_type").otherwise(bucket("fp", "image.fp_spurious_argument"))
    fn = F.when(untyped, "image.fn_due_to_missing_event_type").otherwise(bucket("fn", "image.fn_missing_argument"))
    return _events(rows, F.when(F.col("side") == PRED, fp).otherwise(fn))


def _events(rows: DataFrame, counter: Column) -> DataFrame:
    role = lambda side: F.when(F.col("side") == side, F.col("role"))
    return rows.select("sample_id", counter.alias("counter"), F.lit(1).alias("n"), role(GOLD).alias("gold_role"), role(PRED).alias("pred_role"))


def breakdown_events(scored: Scored, threshold: float = 0.5, low: float = 0.2, cover_high: float = 0.8, purity_low: float = 0.6) -> DataFrame:
    """(sample_id, counter, n, gold_role, pred_role): what each sample adds to each counter."""
    differ = (F.col("gold_type") != "") & (F.col("pred_type") != "") & (F.col("gold_type") != F.col("pred_type"))
    untyped = (F.col("gold_type") != "") & (F.col("pred_type") == "")
    none = F.lit(None).cast("string")
    whole = lambda rows, counter, n: rows.select("sample_id", counter.alias("counter"), n.cast("int").alias("n"), none.alias("gold_role"), none.alias("pred_role"))
    count = lambda rows, counter: whole(rows.groupBy("sample_id").agg(F.count("*").alias("k")), F.lit(counter), F.col("k"))
    parts = [
        _text_events(scored, differ, untyped),
        _image_events(scored, differ, untyped, threshold, low, cover_high, purity_low),
        count(scored.image.where((F.col("side") == GOLD) & F.col("partner").isNotNull()), "image.true_positive"),
        count(scored.invalid, "image.fp_spurious_argument"),
        whole(scored.samples.where(differ), F.explode(F.array(F.lit("text.event_type_mismatch_samples"), F.lit("image.event_type_mismatch_samples"))), F.lit(1)),
    ]
    return reduce(DataFrame.unionByName, parts)


def counts(events: DataFrame) -> DataFrame:
    """(counter, n) of all counters, 0 where nothing was counted, and the totals of false positives and negatives; one pass over events."""
    totals = [f"{m}.total_{k}" for m in ("text", "image") for k in ("fp", "fn")]
    names = events.sparkSession.createDataFrame([(c,) for c in (*COUNTERS, *totals)], "counter string")
    kind = F.regexp_extract("counter", r"\.(f[pn])_", 1)
    total = F.when(kind != "", F.concat(F.substring_index("counter", ".", 1), F.lit(".total_"), kind))
    found = events.groupBy("counter").agg(F.sum("n").alias("n")).select(F.explode(F.array_compact(F.array("counter", total))).alias("counter"), "n")
    return names.join(found.groupBy("counter").agg(F.sum("n").alias("n")), "counter", "left").select("counter", F.coalesce("n", F.lit(0)).alias("n"))


def examples(events: DataFrame, limit: int = 5, order: str = "sample_id") -> DataFrame:
    """(counter, samples): the first ``limit`` samples of each counter but the true positives."""
    first = Window.partitionBy("counter").orderBy(order, "gold_role", "pred_role")
    kept = events.where(~F.col("counter").endswith("true_positive")).withColumn("k", F.row_number().over(first)).where(F.col("k") <= limit)
    packed = F.array_sort(F.collect_list(F.struct("k", "sample_id", "gold_role", "pred_role")))
    return kept.groupBy("counter").agg(packed.alias("samples"))


def joined(gold: DataFrame, pred: DataFrame, traces: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every gold sample with its last prediction record, trace and metrics, as structs; null where there is none. Ids are ``id`` or ``sample_id``, of traces and metrics the latter first."""
    sides = {"prediction_record": last_by_id(pred, "id", "sample_id"), "trace": last_by_id(traces, "sample_id", "id"), "metrics": last_by_id(metrics, "sample_id", "id")}
    ids = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ("id", "sample_id", "sentence_id") if c in gold.columns]
    out = gold.select(F.coalesce(*ids).alias("sample_id"), F.struct(*[gold[c] for c in gold.columns]).alias("gold"))
    for name, side in sides.items():
        out = out.join(side.select("sample_id", F.struct(*[c for c in side.columns if c != "sample_id"]).alias(name)), "sample_id", "left")
    return out


_CANDIDATES = "array<struct<role:string,label:string>>"
_GROUNDED = "array<struct<role:string,grounding_status:string>>"


def last_by_id(rows: DataFrame, *names: str) -> DataFrame:
    """The last row of each sample (by ``_pos``, or else as the rows come), whose id is the first of these columns that is there and not empty, as ``sample_id``."""
    found = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in rows.columns]
    named = rows.withColumn("sample_id", F.coalesce(*found))
    if "_pos" not in rows.columns:
        named = named.withColumn("_pos", F.monotonically_increasing_id())
    return m.last_wins(named, "sample_id").drop("_pos")


def _traced(rows: DataFrame, traces: DataFrame | None) -> DataFrame:
    """rows with what their traces say: traced, candidates, grounded, verified (null without a verifier's answer) and proposed."""
    none = {"candidates": _CANDIDATES, "grounded": _GROUNDED, "verified": "boolean", "proposed": "array<struct<role:string,text:string>>"}
    if traces is None:
        return rows.withColumns({"traced": F.lit(False)} | {k: F.lit(None).cast(v) for k, v in none.items()})
    own = last_by_id(traces, "sample_id", "id")
    has = lambda c: c in own.columns
    made = {
        "candidates": F.transform("stage_c_output.image_arguments", lambda a: F.struct(canonical_role(a["role"]).alias("role"), a["label"].alias("label"))) if has("stage_c_output") else F.lit(None),
        "grounded": F.transform("grounding_results", lambda a: F.struct(canonical_role(a["role"]).alias("role"), a["grounding_status"].alias("grounding_status"))) if has("grounding_results") else F.lit(None),
        "verified": F.when(F.col("verifier_output").isNotNull(), F.coalesce(F.col("verifier_output.verified"), F.lit(False))) if has("verifier_output") else F.lit(None),
        "proposed": F.transform("stage_b_output.text_arguments", lambda a: F.struct(F.coalesce(a["role"], F.lit("")).alias("role"), F.trim(F.coalesce(a["text"], F.lit(""))).alias("text"))) if has("stage_b_output") else F.lit(None),
    }
    own = own.select("sample_id", F.lit(True).alias("traced"), *[v.cast(none[k]).alias(k) for k, v in made.items()])
    return rows.join(own, "sample_id", "left").withColumn("traced", F.coalesce("traced", F.lit(False)))


def _with_words(rows: DataFrame, samples: DataFrame | None) -> DataFrame:
    """rows with the words of their samples, and the first text of each gold role."""
    if samples is None:
        return rows.withColumns({"words": F.array().cast("array<string>"), "gold_values": F.array().cast("array<struct<role:string,text:string>>")})
    every = F.flatten(F.transform(F.coalesce("text_event_mentions", F.array()), lambda x: F.transform(F.coalesce(x["arguments"], F.array()), lambda a: F.struct(canonical_role(a["role"]).alias("role"), F.trim(F.coalesce(a["text"], F.lit(""))).alias("text")))))
    own = settle(samples.select(F.col("id").alias("sample_id"), F.coalesce("words", F.array()).alias("words"), F.filter(every, lambda a: (a["role"] != "") & (a["text"] != "")).alias("every")), {"every": F.col("every")})
    first = F.filter("every", lambda a, i: ~F.exists(F.slice("every", 1, i), lambda b: b["role"] == a["role"]))
    return rows.join(own.select("sample_id", "words", first.alias("gold_values")), "sample_id", "left")


def error_categories(scored: Scored, traces: DataFrame | None = None, image_iou: float = 0.5, samples: DataFrame | None = None) -> DataFrame:
    """(sample_id, gold_type, categories, causes, roles, notes) of every sample.

    Traces (sample_id, stage_b_output, stage_c_output, grounding_results, verifier_output) tell causes by stage; of several traces of a sample the last counts.
    ``causes`` are the stages that categories point to. ``notes`` name two things that are no errors: a broader text that a stage proposed and the prediction
    narrowed to the gold span (``broader_text:ROLE``; needs the gold samples), and a weak place that was proposed and dropped (``weak_place_dropped``)."""
    rows = _with_words(_traced(scored.by_sample(), traces), samples)
    arrays = {"candidates": F.coalesce("candidates", F.array().cast(_CANDIDATES)), "grounded": F.coalesce("grounded", F.array().cast(_GROUNDED))}
    count = lambda arr, role: F.size(F.filter(arr, lambda a: a["role"] == role))
    ground_n = lambda r: F.size(F.filter("grounded", lambda a: (a["role"] == r) & (a["grounding_status"] == "grounded")))
    kinds = lambda r: F.struct(r.alias("role"), count("gold_image", r).alias("gold"), count("pred_image", r).alias("pred"), count("candidates", r).alias("cand"), ground_n(r).alias("ground"))
    rows = settle(settle(rows, arrays), {"by_role": F.transform(F.array_distinct(F.transform("gold_image", lambda a: a["role"])), kinds)})
    any_pair = lambda left, right, fits: F.exists(left, lambda g: F.exists(right, lambda p: F.coalesce(fits(g, p), F.lit(False))))
    swapped = any_pair("spare_gold", "spare_pred", lambda g, p: m.same_span(g, p) & (g["role"] != p["role"]) & m.same_trigger(g, p))
    longer = any_pair("spare_gold", "spare_pred", m.overlong)
    low = any_pair("loose_gold", "loose_pred", lambda g, p: (g["role"] == p["role"]) & (g["event_type"] == p["event_type"]) & let(iou(g["bbox"], p["bbox"]), lambda o: (o > 0) & (o < image_iou)))
    roles_where = lambda holds: F.transform(F.filter("by_role", holds), lambda k: k["role"])
    short = roles_where(lambda k: (k["gold"] > 1) & (k["pred"] < k["gold"]))
    missed = roles_where(lambda k: F.col("traced") & (k["pred"] < k["gold"]) & (k["cand"] < k["gold"]))
    lost = roles_where(lambda k: F.col("traced") & (k["pred"] < k["gold"]) & (k["cand"] >= k["gold"]) & (k["ground"] < F.least(k["cand"], k["gold"])))
    place = F.lit("Place")
    proposed_weak = F.exists("candidates", lambda c: (c["role"] == place) & mentions_weak_place(c["label"]))
    right = (F.size("spare_gold") == 0) & (F.size("spare_pred") == 0) & (F.col("image_tp") == F.size("gold_image")) & (F.col("image_tp") == F.size("pred_image")) & F.col("gate")
    rows = settle(rows, {"swapped": swapped, "longer": longer, "low": low, "short": short, "missed": missed, "lost": lost, "weak": proposed_weak, "more_places": count("pred_image", place) > count("gold_image", place), "right": right})
    weak = F.col("weak") & F.col("more_places")
    flags = {
        "event_type_mismatch": (F.col("gold_type") != "") & (F.col("gold_type") != F.col("pred_type")),
        "text_arg_missing": F.size("spare_gold") > 0,
        "text_arg_extra": F.size("spare_pred") > 0,
        "text_arg_boundary_overlong": F.col("longer"),
        "text_arg_role_mismatch": F.col("swapped"),
        "image_arg_missing": F.size("loose_gold") > 0,
        "image_arg_extra": F.size("loose_pred") > 0,
        "image_arg_iou_low": F.col("low"),
        "image_arg_generic_weak_place": weak,
        "image_arg_same_role_instance_shortfall": F.size("short") > 0,
        "grounding_failed_after_stage_c_candidate": F.size("lost") > 0,
        "stage_c_missing_candidate": F.size("missed") > 0,
        "verifier_false_reject": F.coalesce(~F.col("verified"), F.lit(False)) & F.col("right"),
        "verifier_false_accept": F.coalesce(F.col("verified"), F.lit(False)) & ~F.col("right"),
    }
    roles_of = lambda arr: F.transform(arr, lambda a: a["role"])
    roles = F.concat(roles_of("spare_gold"), roles_of("spare_pred"), roles_of("loose_gold"), roles_of("loose_pred"), F.col("short"), F.col("missed"), F.col("lost"), F.when(weak, F.array(place)).otherwise(F.array().cast("array<string>")))
    given = F.transform("pred_text", lambda a: F.when((a["start"] >= 0) & (a["start"] < a["end"]) & (a["end"] <= F.size("words")), F.array_join(F.slice("words", a["start"] + 1, a["end"] - a["start"]), " ")))
    broader = F.filter("gold_values", lambda g: F.array_contains(F.array_compact(given), g["text"]) & F.exists("proposed", lambda p: (p["role"] == g["role"]) & (p["text"] != g["text"]) & p["text"].contains(g["text"])))
    dropped = F.col("traced") & F.col("weak") & ~F.col("more_places")
    notes = F.concat(F.transform(F.coalesce(broader, F.array().cast("array<struct<role:string,text:string>>")), lambda g: F.concat(F.lit("broader_text:"), g["role"])), F.when(dropped, F.array(F.lit("weak_place_dropped"))).otherwise(F.array().cast("array<string>")))
    named = F.array_compact(F.array(*[F.when(flags[c], c) for c in CATEGORIES]))
    causes = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(flags[c], CAUSES[c]) for c in CATEGORIES]))))
    return rows.select("sample_id", "gold_type", named.alias("categories"), causes.alias("causes"), F.array_sort(F.filter(F.array_distinct(roles), lambda r: r != "")).alias("roles"), notes.alias("notes"))


def category_counts(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Samples of each category, one column a category: overall, or by columns of found."""
    return found.groupBy(*(by or [])).agg(*[F.count_if(F.array_contains("categories", c)).alias(c) for c in CATEGORIES])


def summary(found: DataFrame) -> DataFrame:
    """(kind, name, category, n) of samples: all of them (``samples``) and those with a category (``cases``), by category (0 where there is none), by category of each gold
    type and of each role involved, and by cause."""
    one = lambda kind, name, category: F.struct(F.lit(kind).alias("kind"), name.alias("name"), category.alias("category"))
    none = F.lit("")
    gold = F.coalesce(F.nullif(F.col("gold_type"), F.lit("")), F.lit("(missing)"))
    rows = F.concat(
        F.array(one("samples", none, none)),
        F.when(F.size("categories") > 0, F.array(one("cases", none, none))).otherwise(F.array().cast("array<struct<kind:string,name:string,category:string>>")),
        F.transform("categories", lambda c: one("category", none, c)),
        F.transform("categories", lambda c: one("type", gold, c)),
        F.flatten(F.transform("roles", lambda r: F.transform("categories", lambda c: one("role", r, c)))),
        F.transform("causes", lambda c: one("cause", c, none)),
    )
    alike = found.groupBy("gold_type", "categories", "roles", "causes").agg(F.count("*").alias("k"))  # before their pairs are written out
    counted = alike.select(F.explode(rows).alias("r"), "k").select("r.*", "k").groupBy("kind", "name", "category").agg(F.sum("k").alias("n"))
    # a type or role of samples with a category has a count, so what has none is filled in from the counts alone
    zeros = found.sparkSession.createDataFrame([("category", "", CATEGORIES[0], 0)], "kind string, name string, category string, n long")
    named = counted.unionByName(zeros).groupBy("kind", "name").agg(F.collect_list(F.struct("category", "n")).alias("found"))
    every = F.when(F.col("kind").isin("category", "type", "role"), F.array(*map(F.lit, CATEGORIES))).otherwise(F.transform("found", lambda x: x["category"]))
    total = lambda c: F.aggregate(F.filter("found", lambda x: x["category"] == c), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return named.select("kind", "name", F.explode(F.transform(every, lambda c: F.struct(c.alias("category"), total(c).alias("n")))).alias("r")).select("kind", "name", "r.*")
