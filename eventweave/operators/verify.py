"""Rule diagnostics of extracted events, and their deterministic repair.

An event row has event_type, trigger {text, modality, span}, text_arguments [{role, text, span}], image_arguments [{role, label, bbox, grounding_status}];
``tokens`` are those that spans count. Diagnostics are an array of {field_path, issue_type, suggested_action} in a fixed order. A null span is no issue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweave.functions.bbox import normalize_bbox
from eventweave.functions.spans import align_arguments, preferred_spans, shrink_arguments, span_fits, span_matches, unique_span
from eventweave.functions.text import json_object, let, truthy
from eventweave.ontology import allowed_roles, is_supported, is_weak_place_label
from eventweave.operators.matching import attach_grounding
from eventweave.operators.scoring import settle

DIAGNOSTIC = "struct<field_path:string,issue_type:string,suggested_action:string>"


def _issue(when: Column, path: Column | str, kind: str, action: str) -> Column:
    path = F.lit(path) if isinstance(path, str) else path
    return F.when(F.coalesce(when, F.lit(False)), F.struct(path.alias("field_path"), F.lit(kind).alias("issue_type"), F.lit(action).alias("suggested_action")).cast(DIAGNOSTIC))


def _each(arr: str, rules, facts) -> Column:
    """Issues of each element in order; rules(element, path, facts) gives columns, facts(element, i) a struct of what several of them use, made once."""
    def one(x: Column, i: Column) -> Column:
        at = F.concat(F.lit(f"{arr}["), i.cast("string"), F.lit("]"))
        return let(facts(x, i), lambda f: F.array(*rules(x, lambda field: F.concat(at, F.lit(f".{field}" if field else "")), f)))

    return F.flatten(F.transform(F.coalesce(F.col(arr), F.array()), one))


def with_diagnostics(events: DataFrame, tokens: str = "tokens", image_evidence: str | None = None, grounding: str | None = None) -> DataFrame:
    """events with ``diagnostics``. ``image_evidence`` names a boolean column; ``grounding`` an array of {role, label, bbox, grounding_status} results.

    An event or a trigger of which all fields are null is no object; nothing else is said of it."""
    toks, supported, allowed = F.col(tokens), F.col("__supported"), F.col("__allowed")
    given = F.transform(F.coalesce("text_arguments", F.array()), lambda a: F.struct(a["span"]["start"].alias("start"), a["span"]["end"].alias("end")))
    kind = truthy(F.col("event_type"))
    base = settle(events, {"__pref": preferred_spans(toks, given), "__supported": is_supported(kind), "__allowed": allowed_roles(kind)})
    span = F.col("trigger.span")
    fits = F.coalesce(span_fits(span["start"], span["end"], toks), F.lit(False))
    no_event = F.col("event_type").isNull() & F.col("trigger").isNull() & F.col("text_arguments").isNull() & F.col("image_arguments").isNull()
    no_trigger = F.col("trigger").isNotNull() & F.col("trigger.text").isNull() & F.col("trigger.modality").isNull() & span.isNull()
    has_trigger = F.col("trigger").isNotNull() & ~no_trigger
    named = lambda x, i: F.struct(truthy(x["role"]).alias("role"), truthy(x["label"]).alias("label"))
    role_only = lambda x, i: F.struct(truthy(x["role"]).alias("role"))
    role_rule = lambda x, at, f: [_issue(supported & (f["role"] != "") & ~F.array_contains(allowed, f["role"]), at("role"), "invalid_role", "replace_or_drop")]

    def placed(x: Column, i: Column) -> Column:
        s = x["span"]
        valid = F.coalesce(span_fits(s["start"], s["end"], toks), F.lit(False))
        return F.struct(valid.alias("valid"), span_matches(s["start"], s["end"], toks, x["text"]).alias("match"), F.try_element_at("__pref", i + 1).alias("pref"))

    def text_rules(x: Column, at, f: Column) -> list[Column]:
        s, valid, match, pref = x["span"], f["valid"], f["match"], f["pref"]
        broad = match & ((pref["start"] != s["start"]) | (pref["end"] != s["end"]))
        return [
            _issue(s.isNotNull() & ~valid, at("span"), "invalid_span", "realign_or_drop"),
            _issue(s.isNotNull() & valid & ~match, at("span"), "span_mismatch", "realign_or_drop"),
            _issue(match & pref["determiner"], at("text"), "contains_determiner", "shrink_to_head_word"),
            _issue(match & pref["quantity"], at("text"), "contains_quantity", "shrink_to_head_word"),
            _issue(match & pref["titled"], at("text"), "contains_person_title_prefix", "strip_person_title_prefix"),
            _issue(broad, at("span"), "unnormalized_head_word", "shrink_to_head_word"),
        ]

    def image_rules(x: Column, at, f: Column) -> list[Column]:
        status = F.coalesce(x["grounding_status"], F.lit(""))
        return [
            _issue(x.isNull(), at(""), "invalid_object", "drop_or_rebuild"),
            _issue(x.isNotNull() & (f["role"] == ""), at("role"), "missing_or_empty", "fill_or_drop"),
            _issue(x.isNotNull() & (f["label"] == ""), at("label"), "missing_or_empty", "fill_or_drop"),
            _issue((f["role"] == "Place") & is_weak_place_label(f["label"]), at("label"), "generic_weak_place", "drop_or_replace_with_directly_visible_place"),
            _issue(x.isNotNull() & x["bbox"].isNull() & (status != "unresolved"), at("grounding_status"), "invalid_grounding_status", "mark_unresolved_or_drop"),
            _issue(x["bbox"].isNotNull() & (status != "grounded"), at("grounding_status"), "invalid_grounding_status", "mark_grounded_or_drop_bbox"),
            _issue(x["bbox"].isNotNull() & ((F.size(x["bbox"]) != 4) | F.exists(x["bbox"], lambda v: v.isNull())), at("bbox"), "invalid_bbox_format", "fix_or_drop"),
        ]

    results = F.col(grounding) if grounding else F.lit(None).cast("array<struct<role:string,label:string,bbox:array<double>,grounding_status:string>>")
    applied = lambda x, at, f: [_issue((truthy(x["grounding_status"]) == "unresolved") & (f["role"] != "") & (f["label"] != "") & F.exists(results, lambda r: (r["grounding_status"] == "grounded") & (F.size(r["bbox"]) == 4) & (truthy(r["role"]) == f["role"]) & (truthy(r["label"]) == f["label"])), at("grounding_status"), "grounding_result_not_applied", "upgrade_from_grounding")]
    seen = F.coalesce(F.col(image_evidence), F.lit(False)) if image_evidence else F.lit(True)
    parts = [
        F.array(_issue(~supported, "event_type", "unsupported_event_type", "set_supported_event_type")),
        _each("text_arguments", role_rule, role_only),
        _each("image_arguments", role_rule, role_only),
        F.array(
            _issue(no_trigger, "trigger", "invalid_object", "drop_or_rebuild"),
            _issue(has_trigger & (F.coalesce(F.col("trigger.modality"), F.lit("")) != "text"), "trigger.modality", "invalid_modality", "set_text_modality_or_drop"),
            _issue(has_trigger & span.isNotNull() & ~fits, "trigger.span", "invalid_span", "realign_or_drop"),
            _issue(has_trigger & span.isNotNull() & fits & ~span_matches(span["start"], span["end"], toks, F.col("trigger.text")), "trigger.span", "span_mismatch", "realign_or_drop"),
            _issue(F.col("text_arguments").isNull(), "text_arguments", "invalid_list", "drop_or_rebuild"),
        ),
        _each("text_arguments", lambda x, at, f: [_issue(x.isNull(), at(""), "invalid_object", "drop_or_rebuild"), *text_rules(x, at, f)], placed),
        F.array(_issue(F.col("image_arguments").isNull(), "image_arguments", "invalid_list", "drop_or_rebuild")),
        _each("image_arguments", image_rules, named),
        F.array(_issue((F.size(F.coalesce("image_arguments", F.array())) > 0) & ~seen, "image_arguments", "missing_image_evidence", "drop_or_rebuild")),
        _each("image_arguments", applied, named),
    ]
    found = F.when(no_event, F.array(_issue(F.lit(True), "event", "invalid_object", "drop_or_rebuild"))).otherwise(F.array_compact(F.concat(*parts)))
    return base.withColumn("diagnostics", found).drop("__pref", "__supported", "__allowed")


def validation_error(events: DataFrame) -> DataFrame:
    """events with ``error``, the first schema or ontology violation; null for a valid event."""
    allowed = allowed_roles(F.col("event_type"))
    bad_role = lambda arr: F.try_element_at(F.filter(F.coalesce(F.col(arr), F.array()), lambda a: ~F.array_contains(allowed, truthy(a["role"]))), F.lit(1))["role"]
    error = (
        F.when(truthy(F.col("event_type")) == "", "event_type is missing")
        .when(~is_supported(F.col("event_type")), F.concat(F.lit("unsupported event_type: "), F.col("event_type")))
        .when(F.col("text_arguments").isNull(), "text_arguments is not a list")
        .when(F.col("image_arguments").isNull(), "image_arguments is not a list")
        .when(bad_role("text_arguments").isNotNull(), F.concat(F.lit("text role not allowed: "), bad_role("text_arguments")))
        .when(bad_role("image_arguments").isNotNull(), F.concat(F.lit("image role not allowed: "), bad_role("image_arguments")))
        .when(F.exists("image_arguments", lambda a: a["bbox"].isNotNull() & (F.size(a["bbox"]) != 4)), "bbox is not four numbers")
    )
    return events.withColumn("error", error)


def align_events(events: DataFrame, tokens: str = "tokens") -> DataFrame:
    """events whose trigger and text arguments have spans that match their text, arguments shrunk to preferred boundaries; what can't be placed goes."""
    toks = F.col(tokens)
    trigger = F.col("trigger")
    own = F.coalesce(span_matches(trigger["span"]["start"], trigger["span"]["end"], toks, trigger["text"]), F.lit(False))
    place = F.when(own, trigger["span"]).otherwise(unique_span(toks, trigger["text"]).cast("struct<start:int,end:int>"))
    out = events.withColumn("__args", align_arguments(F.coalesce("text_arguments", F.array()), toks))
    out = out.withColumn("__pref", preferred_spans(toks, F.transform("__args", lambda a: a["span"])))
    out = out.withColumn("trigger", F.when(place.isNotNull(), F.struct(trigger["text"].alias("text"), F.lit("text").alias("modality"), place.alias("span"))))
    dropped = F.transform(F.filter(F.transform("__args", lambda a, i: F.struct(a["span"].alias("span"), i.alias("i"), a["problem"].alias("problem"))), lambda a: a["span"].isNull()), lambda a: F.struct(F.concat(F.lit("text_arguments["), a["i"].cast("string"), F.lit("].span")).alias("field_path"), a["problem"].alias("issue_type"), F.lit("realign_or_drop").alias("suggested_action")).cast(DIAGNOSTIC))
    return out.withColumns({"text_arguments": shrink_arguments(F.col("__args"), F.col("__pref"), toks), "alignment": dropped}).drop("__args", "__pref")


def verdict(answer: Column, issues: Column) -> Column:
    """Verified only by YES without issues; any other answer is NO."""
    return (F.upper(truthy(answer)) == "YES") & (F.size(F.coalesce(issues, F.array())) == 0)


_ANSWER = "verdict string, issues string, confidence string, reason string, diagnostics array<struct<field_path:string,issue_type:string,suggested_action:string>>"


def with_verdict(events: DataFrame, answer: str = "answer", failure: str | None = None) -> DataFrame:
    """events (with ``diagnostics`` and, of validation_error(), ``error``) with ``verified``, ``issues``, ``confidence``, ``reason`` and what a verifier's answer adds to their diagnostics.

    The answer is text with a JSON object. Anything but YES is NO, YES clears the answer's own issues, and confidence is kept within 0 and 1. An event is verified by
    YES if no rule and no validation found anything. An answer without an object, a failed validation and, named by a column, a failed call are diagnostics of the event."""
    obj = json_object(F.col(answer))
    parsed = F.from_json(obj, _ANSWER)
    own = lambda when, kind, action: _issue(when, "event", kind, action)
    rows = settle(events, {"__a": parsed, "__ok": obj.isNotNull()})
    text, yes = F.trim(F.col("__a.issues")), F.upper(truthy(F.col("__a.verdict"))) == "YES"
    said = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    said = F.when(yes | text.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(said))
    confidence = F.coalesce(F.col("__a.confidence").try_cast("double"), F.lit(0.0))
    failed = F.col(failure) if failure else F.lit(None).cast("string")
    error = F.col("error") if "error" in events.columns else F.lit(None).cast("string")
    told = F.filter(F.coalesce("__a.diagnostics", F.array().cast(f"array<{DIAGNOSTIC}>")), lambda d: (truthy(d["field_path"]) != "") & (truthy(d["issue_type"]) != "") & (truthy(d["suggested_action"]) != ""))
    wrapper = F.array_compact(F.array(own(error.isNotNull(), "schema_validation_failed", "drop_or_rebuild"), own(failed.isNull() & ~F.col("__ok"), "invalid_verifier_output", "retry_or_repair")))
    found = F.array_distinct(F.concat(F.coalesce("diagnostics", F.array().cast(f"array<{DIAGNOSTIC}>")), wrapper, F.when(yes, F.array().cast(f"array<{DIAGNOSTIC}>")).otherwise(told)))
    found = F.when(failed.isNotNull(), F.array(own(F.lit(True), "verifier_failure", "retry_or_repair"))).otherwise(found)
    rules = F.transform(F.coalesce("diagnostics", F.array().cast(f"array<{DIAGNOSTIC}>")), lambda d: F.concat_ws(": ", d["field_path"], d["issue_type"]))
    issues = F.array_distinct(F.concat(rules, F.array_compact(F.array(error, F.when(~F.col("__ok"), "the verifier's answer holds no JSON object"))), said))
    issues = F.when(failed.isNotNull(), F.array(failed)).otherwise(issues)
    out = settle(rows, {"diagnostics": found, "issues": issues, "confidence": F.when(failed.isNotNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))), "reason": truthy(F.col("__a.reason")), "__yes": F.coalesce(yes, F.lit(False)) & failed.isNull()})
    return out.withColumn("verified", F.col("__yes") & (F.size("issues") == 0)).drop("__a", "__ok", "__yes")


def target_paths(diagnostics: Column) -> Column:
    """Field paths to repair, each once, in order."""
    return F.array_distinct(F.transform(diagnostics, lambda d: d["field_path"]))


def merge_by_paths(events: DataFrame, proposed: str, paths: str = "paths") -> DataFrame:
    """events with just the fields that paths name taken from a proposed event (a struct column). Event types and grounding statuses never change."""
    hit = lambda path: F.array_contains(F.col(paths), path)
    new = F.col(proposed)

    def merged(arr: str, fields: tuple[str, ...]) -> Column:
        def one(x: Column, i: Column) -> Column:
            at = F.concat(F.lit(f"{arr}["), i.cast("string"), F.lit("]"))
            other = F.try_element_at(new[arr], i + 1)
            out = x
            for f in fields:
                out = out.withField(f, F.when(other.isNotNull() & hit(F.concat(at, F.lit(f".{f}"))), other[f]).otherwise(x[f]))
            return F.when(other.isNotNull() & hit(at), other).otherwise(out)

        return F.when(hit(F.lit(arr)), new[arr]).otherwise(F.transform(arr, one))

    trigger = F.when(hit(F.lit("trigger")), new["trigger"]).when(F.col("trigger").isNotNull() & new["trigger"].isNotNull(), F.struct(F.col("trigger.text").alias("text"), F.when(hit(F.lit("trigger.modality")), new["trigger"]["modality"]).otherwise(F.col("trigger.modality")).alias("modality"), F.when(hit(F.lit("trigger.span")), new["trigger"]["span"]).otherwise(F.col("trigger.span")).alias("span"))).otherwise(F.col("trigger"))
    return events.withColumns({"trigger": trigger, "text_arguments": merged("text_arguments", ("span", "role", "text")), "image_arguments": merged("image_arguments", ("bbox", "role", "label"))})


def _targeted(arr: str, paths: str) -> Column:
    """Places of an array that paths name, whole or a field of it."""
    found = F.filter(F.transform(F.col(paths), lambda p: F.regexp_extract(p, rf"^{arr}\[(\d+)\]", 1)), lambda x: x != "")
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


def reground(events: DataFrame, tokens: str = "tokens", paths: str = "paths") -> DataFrame:
    """events with the spans that paths name found anew: where their text stands, if it does at one place only; a trigger or argument without such a place goes."""
    toks = F.col(tokens)
    hit = F.exists(paths, lambda p: (p == "trigger") | p.startswith("trigger."))
    place = lambda text: unique_span(toks, text).cast("struct<start:int,end:int>")
    trigger = F.when(place(F.col("trigger.text")).isNotNull(), F.struct(F.col("trigger.text").alias("text"), F.lit("text").alias("modality"), place(F.col("trigger.text")).alias("span")))
    moved = F.transform("text_arguments", lambda a, i: F.when(F.array_contains("__at", i), a.withField("span", place(a["text"]))).otherwise(a))
    kept = F.filter(moved, lambda a, i: ~F.array_contains("__at", i) | a["span"].isNotNull())
    rows = settle(events, {"__at": F.coalesce(_targeted("text_arguments", paths), F.array().cast("array<int>"))})
    return rows.withColumns({"trigger": F.when(hit, trigger).otherwise(F.col("trigger")), "text_arguments": kept}).drop("__at")


def apply_grounding(events: DataFrame, grounding: str = "grounding_results", plan: str = "diagnostics") -> DataFrame:
    """events with boxes of grounding results written back where a repair plan names image arguments or results that weren't applied."""
    wanted = F.exists(F.coalesce(plan, F.array().cast(f"array<{DIAGNOSTIC}>")), lambda d: (d["issue_type"] == "grounding_result_not_applied") | d["field_path"].startswith("image_arguments["))
    return events.withColumn("image_arguments", F.when(wanted & F.col(grounding).isNotNull(), attach_grounding(F.col("image_arguments"), F.col(grounding))).otherwise(F.col("image_arguments")))


def restore_boxes(events: DataFrame, original: str) -> DataFrame:
    """events with boxes that a repair lost put back: where the argument at the same place of the original (a column of image arguments) was grounded and now is unresolved
    without a box."""
    def one(a: Column, i: Column) -> Column:
        was = F.try_element_at(original, i + 1)
        lost = (F.size(was["bbox"]) == 4) & (was["grounding_status"] == "grounded") & a["bbox"].isNull() & (a["grounding_status"] == "unresolved")
        return F.when(F.coalesce(lost, F.lit(False)), a.withField("bbox", was["bbox"]).withField("grounding_status", F.lit("grounded"))).otherwise(a)

    return events.withColumn("image_arguments", F.transform("image_arguments", one))


def drop_flagged_weak_places(events: DataFrame, diagnostics: str = "diagnostics") -> DataFrame:
    """Image arguments without those flagged as generic places."""
    flagged = F.transform(F.filter(diagnostics, lambda d: d["issue_type"] == "generic_weak_place"), lambda d: F.regexp_extract(d["field_path"], r"\[(\d+)\]", 1))
    return events.withColumn("image_arguments", F.filter("image_arguments", lambda a, i: ~F.array_contains(flagged, i.cast("string"))))


def drop_weak_places(events: DataFrame) -> DataFrame:
    """Image arguments of arrests without places of generic labels."""
    weak = lambda a: (a["role"] == "Place") & is_weak_place_label(a["label"])
    return events.withColumn("image_arguments", F.filter("image_arguments", lambda a: ~((F.col("event_type") == "Justice:Arrest-Jail") & weak(a))))


def without_image_evidence(events: DataFrame, evidence: str) -> DataFrame:
    return events.withColumn("image_arguments", F.when(F.col(evidence), F.col("image_arguments")).otherwise(F.slice("image_arguments", 1, 0)))


def grounding_requests(args: Column) -> Column:
    """{role, label, grounding_query} of image arguments that still lack a box."""
    need = F.filter(args, lambda a: (truthy(a["role"]) != "") & (truthy(a["label"]) != "") & a["bbox"].isNull() & (a["grounding_status"] == "unresolved"))
    return F.transform(need, lambda a: F.struct(truthy(a["role"]).alias("role"), truthy(a["label"]).alias("label"), F.concat_ws(": ", truthy(a["role"]), truthy(a["label"])).alias("grounding_query")))


_RESULT = "role string, label string, grounding_query string, bbox array<string>, score string, grounding_status string"


def grounding_results(response: Column, requests: Column) -> Column:
    """{role, label, grounding_query, bbox, score, grounding_status} of each request, from a detector's JSON answer ``{"results": [...]}`` by place.

    What a result lacks comes from its request; a status that isn't grounded, failed or unresolved follows from the box; a request without a result has failed."""
    results = F.coalesce(F.from_json(response, "results array<string>")["results"], F.array().cast("array<string>"))

    def one(request: Column, i: Column) -> Column:
        raw = F.try_element_at(results, i + 1)
        result = F.when(F.trim(raw).startswith("{"), F.from_json(raw, _RESULT))

        def made(r: Column) -> Column:
            either = lambda n: F.coalesce(F.nullif(r[n], F.lit("")), request[n], F.lit(""))
            box, status = normalize_bbox(r["bbox"]), F.lower(truthy(r["grounding_status"]))
            status = F.when(status.isin("grounded", "failed", "unresolved"), status).when(box.isNotNull(), "grounded").otherwise("failed")
            return F.struct(either("role").alias("role"), either("label").alias("label"), either("grounding_query").alias("grounding_query"), box.alias("bbox"), r["score"].try_cast("double").alias("score"), status.alias("grounding_status"))

        return let(result, made)

    return F.transform(requests, one)


def candidate_queries(query: Column) -> Column:
    """Up to three phrases for a detector: parts between pipes, and what follows a colon; each once whatever its case."""
    parts = F.filter(F.transform(F.split(query, r"\|{1,2}"), lambda x: F.trim(x)), lambda x: x != "")
    every = F.flatten(F.transform(parts, lambda x: F.array(x, F.trim(F.substring_index(x, ":", -1)))))
    first = F.filter(every, lambda x, i: (x != "") & ~F.exists(F.slice(every, 1, i), lambda y: F.lower(y) == F.lower(x)))
    return F.slice(first, 1, 3)


def grounding_activity(args: Column, results: Column) -> Column:
    """Counts of arguments and results by status."""
    n = lambda arr, s: F.size(F.filter(F.coalesce(arr, F.array()), lambda a: a["grounding_status"] == s))
    return F.struct(F.size(F.coalesce(results, F.array())).alias("requests"), n(results, "grounded").alias("grounded"), n(results, "failed").alias("failed"), n(args, "grounded").alias("applied"), n(args, "unresolved").alias("unresolved"))


def event_surface(events: DataFrame) -> Column:
    """The words of an event: its trigger and argument texts."""
    return F.concat_ws(" ", F.col("trigger.text"), F.array_join(F.transform(F.coalesce("text_arguments", F.array()), lambda a: a["text"]), " "))


def prediction_record(events: DataFrame, id_col: str = "id") -> DataFrame:
    """Flat prediction records of aligned events: spans side by side with texts, and image arguments that are grounded."""
    text = F.transform("text_arguments", lambda a: F.struct(a["role"].alias("role"), a["text"].alias("text"), a["span"]["start"].alias("start"), a["span"]["end"].alias("end")))
    image = F.transform(F.filter("image_arguments", lambda a: (a["grounding_status"] == "grounded") & (F.size(a["bbox"]) == 4)), lambda a: F.struct(a["role"].alias("role"), a["bbox"].alias("bbox")))
    trigger = F.when(F.col("trigger").isNotNull(), F.struct(F.col("trigger.text").alias("text"), F.col("trigger.span.start").alias("start"), F.col("trigger.span.end").alias("end")))
    return events.select(F.col(id_col).alias("id"), F.struct("event_type", trigger.alias("trigger"), text.alias("text_arguments"), image.alias("image_arguments")).alias("prediction"))


