"""Records for people, prompts and audits: summaries, rendered examples, traces, snapshots and support flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweave.functions.text import content_tokens, json_object, let, redact_reference, truthy
from eventweave.ontology import ROLES
from eventweave.operators.evidence import has_external_support
from eventweave.operators.verify import event_surface


def mention_text(words: Column, start: Column, end: Column) -> Column:
    """The words of a span, or an empty string if it doesn't fit."""
    fits = F.coalesce((start >= 0) & (start < end) & (end <= F.size(words)), F.lit(False))
    return F.when(fits, F.array_join(F.slice(words, F.when(fits, start).otherwise(0) + 1, F.when(fits, end - start).otherwise(0)), " ")).otherwise("")


def summarize_arguments(text: Column, image: Column, words: Column) -> Column:
    """{text: [{role, start, end, text}], image: [{role, bbox}]} of scored arguments."""
    texts = F.transform(text, lambda a: F.struct(a["role"].alias("role"), a["start"].alias("start"), a["end"].alias("end"), mention_text(words, a["start"], a["end"]).alias("text")))
    return F.struct(texts.alias("text"), F.transform(image, lambda a: F.struct(a["role"].alias("role"), a["bbox"].alias("bbox"))).alias("image"))


def json_lines(items: Column) -> Column:
    """Array elements as JSON, one a line; ``(none)`` without any."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(F.transform(items, lambda x: F.to_json(x)), "\n")).otherwise("(none)")


def rendered_examples(examples: Column, fields: list[str], limit: int = 2) -> Column:
    """The first examples as numbered blocks of ``field: value`` lines; ``(none)`` without any. Fields that are empty are left out."""
    def block(e: Column, i: Column) -> Column:
        lines = F.array(*[F.when(truthy(e[f]) != "", F.concat(F.lit(f"{f}: "), truthy(e[f]))) for f in fields])
        return F.array_join(F.concat(F.array(F.concat(F.lit("example "), (i + 1).cast("string"))), F.array_compact(lines)), "\n")

    return F.when(F.coalesce(F.size(examples), F.lit(0)) > 0, F.array_join(F.transform(F.slice(examples, 1, limit), block), "\n\n")).otherwise("(none)")


def perception_summary(text: Column, image: Column) -> Column:
    """Two lines: what the text says, and what the image shows."""
    return F.concat(F.lit("Text: "), truthy(text), F.lit("\nImage: "), truthy(image))


def example_counts(similar: Column) -> Column:
    """How many retrieved examples each layer holds."""
    return F.struct(*[F.coalesce(F.size(similar[k]), F.lit(0)).alias(k) for k in ("text", "image", "bridge")])


def trace_records(states: DataFrame, run_mode: Column, search: Column) -> DataFrame:
    """One audit row a sample; parts that a run didn't reach are null, image references are safe to log, and search counts only in open-world runs."""
    given = lambda name: F.col(name) if name in states.columns else F.lit(None).cast("string")
    parts = ["stage_a_output", "stage_b_output", "stage_c_output", "grounding_results", "verifier_output"]
    return states.select(
        F.col("id").alias("sample_id"), run_mode.alias("run_mode"), ((run_mode == "open_world") & search).alias("effective_search_enabled"),
        redact_reference(given("image").cast("string")).alias("image"), *[given(p).alias(p) for p in parts],
    )


def argument_changes(before: Column, after: Column) -> Column:
    """Image arguments before and after grounding, by place: {index, role, label, before, after} of those whose status changed."""
    pairs = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    changed = F.filter(F.transform(pairs, lambda p, i: p.withField("i", i)), lambda p: ~p["b"]["grounding_status"].eqNullSafe(p["a"]["grounding_status"]))
    return F.transform(changed, lambda p: F.struct(p["i"].alias("index"), p["b"]["role"].alias("role"), p["b"]["label"].alias("label"), p["b"]["grounding_status"].alias("before"), p["a"]["grounding_status"].alias("after")))


def support_flags(events: DataFrame, text: str = "text", image: str = "image_desc", grounding: str = "grounding_results", evidence: str = "evidence") -> DataFrame:
    """events with ``support`` {text, image, grounding, external}: which sources share words or boxes with the event. All false without a type."""
    typed = truthy(F.col("event_type")) != ""
    words = content_tokens(event_surface(events))
    labels = content_tokens(F.array_join(F.transform(F.coalesce("image_arguments", F.array()), lambda a: a["label"]), " "))
    shared = lambda own, other: let(own, lambda w: F.coalesce(F.arrays_overlap(w, content_tokens(F.col(other))), F.lit(False)))
    boxed = F.exists(F.coalesce(grounding, F.array()), lambda r: r["grounding_status"] == "grounded")
    flags = {"text": shared(words, text), "image": shared(labels, image), "grounding": F.coalesce(boxed, F.lit(False)), "external": F.coalesce(has_external_support(event_surface(events), F.col(evidence)), F.lit(False))}
    return events.withColumn("support", F.struct(*[(typed & v).alias(k) for k, v in flags.items()]))


def situation_truth(images: DataFrame, roles: int = 6) -> DataFrame:
    """(image_id, verb, nouns) for training: the verb before the first underscore of the file's name, and for each role of the first frame the distinct
    nouns of all frames (``blank`` for none), padded to ``roles`` with empty lists."""
    names = F.map_keys(F.try_element_at("frames", F.lit(1)))
    nouns = F.transform(F.coalesce(names, F.array()), lambda r: F.array_distinct(F.transform("frames", lambda f: F.coalesce(F.nullif(F.try_element_at(f, r), F.lit("")), F.lit("blank")))))
    padded = F.slice(F.concat(nouns, F.array_repeat(F.array().cast("array<string>"), roles)), 1, roles)
    return images.select("image_id", F.substring_index(F.substring_index("image_id", "/", -1), "_", 1).alias("verb"), padded.alias("nouns"))


def fusion_context(states: DataFrame) -> DataFrame:
    """(id, fusion_context {raw_text, raw_image_desc, perception_summary, patterns {text, image, bridge}, evidence}) of states; what a state lacks is empty. Words of the text aren't carried on."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) if name in states.columns else F.lit("")
    field = lambda name, none: F.coalesce(F.col(name), F.array().cast(states.schema[name].dataType)) if name in states.columns else F.array().cast(none)
    patterns = F.struct(*[field(f"{k}_examples", "array<string>").alias(k) for k in ("text", "image", "bridge")])
    return states.select("id", F.struct(text("text").alias("raw_text"), text("image_desc").alias("raw_image_desc"), text("perception_summary").alias("perception_summary"), patterns.alias("patterns"), field("evidence", "array<string>").alias("evidence")).alias("fusion_context"))


def memory_entry(text: Column, image: Column) -> Column:
    """[{text, image_desc}]: what a run remembers of a sample."""
    none = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.array(F.struct(none(text).alias("text"), none(image).alias("image_desc")))


def appended(history: Column, entry: Column) -> Column:
    """A trace or a repair history with one more entry at its end; a missing one begins with it."""
    return F.when(history.isNull(), F.array(entry)).otherwise(F.array_append(history, entry))


def merged_outputs(outputs: Column, updates: dict[str, Column]) -> Column:
    """A map of stage outputs as JSON, with those of updates put in or replaced; inline image data is cut out of them."""
    new = F.create_map(*[x for k, v in updates.items() for x in (F.lit(k), F.regexp_replace(v.cast("string"), r"(data:[^;,\"]*);base64,[A-Za-z0-9+/=]*", "$1;<redacted>"))])
    old = F.coalesce(outputs, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(old, lambda k, v: ~k.isin(*updates)), new)


def image_query_paths(states: DataFrame, images: DataFrame, image: str = "raw_image") -> DataFrame:
    """(id, path) of states whose image is a path among those of ``images`` (path); inline data and other references ask nothing."""
    plain = lambda c: F.regexp_replace(F.trim(c), r"^file:/+", "/")
    found = images.select(plain(F.col("path")).alias("__path")).distinct()
    return states.where(F.trim(F.coalesce(F.col(image).cast("string"), F.lit(""))) != "").select("id", plain(F.col(image).cast("string")).alias("path")).join(found, F.col("path") == F.col("__path"), "left_semi")


def ontology_block(event_type: str) -> str:
    """The roles of a type for a prompt: a line each for those that images show well and for the others."""
    roles = ROLES.get(event_type, {})
    named = lambda kind: ", ".join(r for r, v in roles.items() if v == kind) or "(none)"
    return f"event type: {event_type}\nroles: {', '.join(roles) or '(none)'}\nclearly visible: {named('strong')}\nseldom visible: {named('weak')}"


def perception_record(answer: Column, image_desc: Column, text: Column) -> Column:
    """{image_desc, perception_summary} of a vision model's answer (text with a JSON object); what is missing or empty comes from what was known before."""
    def made(r: Column) -> Column:
        desc = F.coalesce(F.nullif(truthy(r["image_desc"]), F.lit("")), truthy(image_desc))
        return F.struct(desc.alias("image_desc"), F.coalesce(F.nullif(truthy(r["perception_summary"]), F.lit("")), perception_summary(text, desc)).alias("perception_summary"))

    return let(F.from_json(json_object(answer), "image_desc string, perception_summary string"), made)


def first_rows(rows: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows in an order, for previews and trial runs; all of them without n."""
    return rows if n is None else rows.orderBy(*order).limit(max(0, n))
