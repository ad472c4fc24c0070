"""Corpus ETL: flatten raw corpora to one row an event, map them into the ontology, and normalise them.

Skipped rows stay in the output with a ``skip_reason``; ``kept`` and ``skip_counts`` split it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventweave.functions.images import image_fault
from eventweave.functions.text import clean_text, mapping_key, retrieval_text, skip_reason, text_part, truthy
from eventweave.ontology import ROLES, allowed_roles, literal_map
from eventweave.operators.scoring import settle
from eventweave.settings import Settings

_SPAN = "struct<start:int,end:int>"
# Names of the corpora.
SOURCE_NAMES = {"ace2005": "ACE2005", "maven_arg": "MAVEN-ARG", "swig": "SWiG"}


def first_present(df: DataFrame, *names: str) -> Column:
    """The first of these columns that exists and isn't null; an empty string counts."""
    found = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def event_type_of(type_: Column, subtype: Column) -> Column:
    """``type`` or ``type:subtype``; a type with a colon is complete."""
    main, sub = truthy(type_), truthy(subtype)
    return F.when(main.contains(":") | (sub == ""), main).otherwise(F.concat_ws(":", main, sub))


def flatten_ace(records: DataFrame, split: str, pos: str = "_pos") -> DataFrame:
    """(doc_id, id, raw_type, text, trigger_text, arguments) from line records with events; ``_pos`` is the 0-based line."""
    doc = F.coalesce(F.nullif(truthy(first_present(records, "doc_id", "docid", "id")), F.lit("")), F.format_string(f"{split}::%06d", F.col(pos)))
    rows = records.select(doc.alias("doc_id"), clean_text(first_present(records, "text", "sentence")).alias("text"), F.posexplode("event").alias("i", "e"))
    args = F.filter(F.coalesce(F.col("e.args"), F.array()), lambda a: truthy(a["text"]) != "")
    return rows.where(F.col("e").isNotNull()).select(
        "doc_id",
        F.concat_ws("::", "doc_id", F.lit("event"), F.col("i").cast("string")).alias("id"),
        truthy(F.col("e.type")).alias("raw_type"),
        "text",
        clean_text(F.col("e.text")).alias("trigger_text"),
        F.transform(args, lambda a: F.struct(truthy(a["type"]).alias("role"), clean_text(a["text"]).alias("text"), F.lit(None).cast(_SPAN).alias("span"))).alias("arguments"),
    )


def flatten_maven(documents: DataFrame) -> DataFrame:
    """The same from documents with events, mentions and entities: an event's first mention; an argument's own text, or else its
    entity's first mention; arguments with neither are dropped. Roles end at the first underscore."""
    entities = F.filter(F.coalesce(F.col("entities"), F.array()), lambda e: F.size(e["mention"]) > 0)
    named = F.transform(entities, lambda e: F.struct(e["id"].alias("key"), e["mention"][0]["mention"].alias("value")))
    documents = documents.withColumn("__named", named)
    pairs = F.col("__named")
    # of equal ids the last counts
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]))
    rows = documents.withColumn("__last", last).select(truthy(F.col("id")).alias("doc_id"), clean_text(F.col("document")).alias("text"), F.map_from_entries("__last").alias("known"), F.posexplode("events").alias("i", "e"))
    mention = F.try_element_at("e.mention", F.lit(1))
    pairs = F.flatten(F.transform(F.map_entries(F.coalesce(F.col("e.argument"), F.create_map().cast("map<string,array<struct<content:string,entity_id:string,offset:array<int>>>>"))), lambda kv: F.transform(kv["value"], lambda a: F.struct(F.substring_index(kv["key"], "_", 1).alias("role"), clean_text(F.coalesce(F.nullif(truthy(a["content"]), F.lit("")), F.try_element_at("known", a["entity_id"]))).alias("text")))))
    return rows.select(
        "doc_id",
        F.concat_ws("::", "doc_id", F.coalesce(F.nullif(truthy(F.col("e.id")), F.lit("")), F.concat(F.lit("event"), F.col("i").cast("string")))).alias("id"),
        truthy(F.col("e.type")).alias("raw_type"),
        "text",
        clean_text(mention["trigger_word"]).alias("trigger_text"),
        F.transform(F.filter(pairs, lambda a: a["text"] != ""), lambda a: F.struct(a["role"].alias("role"), a["text"].alias("text"), F.lit(None).cast(_SPAN).alias("span"))).alias("arguments"),
    )


def flatten_swig(images: DataFrame) -> DataFrame:
    """(image_id, verb, frame, arguments) with the first frame's roles and labels; ``frame`` lists them by role."""
    first = F.try_element_at(F.filter("frames", lambda f: f.isNotNull()), F.lit(1))
    pairs = F.filter(F.map_entries(F.coalesce(first, F.create_map().cast("map<string,string>"))), lambda kv: truthy(kv["value"]) != "")
    frame = F.array_join(F.array_sort(F.transform(pairs, lambda kv: F.concat_ws("=", kv["key"], kv["value"]))), ", ")
    return images.select("image_id", truthy(F.col("verb")).alias("verb"), frame.alias("frame"), F.transform(pairs, lambda kv: F.struct(kv["key"].alias("role"), kv["value"].alias("label"))).alias("arguments"))


#: Pairs of a mapping that may become a literal in the plan; those of the corpora have some thousand.
MOST_PAIRS = 1 << 15


def _last(pairs: DataFrame, key: Column, value: str) -> dict[str, str]:
    """The last value of each key, in the order of ``_pos`` or else of the rows. A mapping of more than MOST_PAIRS keys is an error."""
    pos = F.col("_pos") if "_pos" in pairs.columns else F.monotonically_increasing_id()
    last = pairs.select(key.alias("k"), F.col(value).alias("v"), pos.alias("p")).groupBy("k").agg(F.max_by("v", "p").alias("v"))
    found = last.limit(MOST_PAIRS + 1).collect()
    if len(found) > MOST_PAIRS:
        raise ValueError(f"a mapping has more than {MOST_PAIRS} keys")
    return {r.k: r.v for r in found}


def map_event_types(rows: DataFrame, type_map: DataFrame, dataset: str, raw: str = "raw_type") -> DataFrame:
    """rows with ``event_type`` by (dataset, lower-case raw type); null without a mapping, an error if a mapping that is used leaves the ontology.

    ``type_map`` (dataset, raw_type, event_type), the size of an ontology mapping, becomes a literal map, so types are mapped without a join; of equal keys the last counts."""
    pairs = _last(type_map.where(F.col("dataset") == dataset), mapping_key(F.col("raw_type")), "event_type")
    found = F.try_element_at(literal_map(pairs), mapping_key(F.col(raw))) if pairs else F.lit(None).cast("string")
    odd = sorted({v for v in pairs.values() if v not in ROLES})
    if odd:
        found = F.when(found.isin(*odd), F.raise_error(F.concat(F.lit("mapping to an unsupported event type: "), found)).cast("string")).otherwise(found)
    return rows.withColumn("event_type", found)


def map_roles(rows: DataFrame, role_map: DataFrame, dataset: str, value: str = "text") -> DataFrame:
    """rows with ``arguments`` reduced to those whose role maps to an allowed one, in their order, and whose ``value`` isn't empty.

    ``role_map`` (dataset, event_type, raw_role, role), the size of an ontology mapping, becomes a literal map, so arguments are rewritten in place without a join;
    of equal keys the last counts."""
    key = F.concat_ws("|", "event_type", mapping_key(F.col("raw_role")))
    pairs = _last(role_map.where(F.col("dataset") == dataset), key, "role")
    known = literal_map(pairs) if pairs else F.create_map().cast("map<string,string>")
    role = lambda a: F.try_element_at(known, F.concat_ws("|", F.col("event_type"), mapping_key(a["role"])))
    named = F.transform(F.coalesce("arguments", F.array()), lambda a: a.withField("role", role(a)))
    return rows.withColumn("arguments", F.filter(named, lambda a: F.coalesce(F.array_contains(allowed_roles(F.col("event_type")), a["role"]), F.lit(False)) & (truthy(a[value]) != "")))


def text_of(rows: DataFrame, *names: str) -> Column:
    """The clean text of the first of these columns that is there; a list's elements are joined by spaces."""
    found = [F.array_join(F.col(n).cast("array<string>"), " ", "None") if rows.schema[n].dataType.typeName() == "array" else F.col(n).cast("string") for n in names if n in rows.columns]
    return clean_text(F.coalesce(*found)) if found else F.lit("")


def trigger_of(rows: DataFrame) -> Column:
    """{text, span} of a ``trigger`` object, or of flat fields; null without a text. A span needs two whole numbers."""
    whole = lambda c: F.when(c.cast("double") == F.floor(c.cast("double")), c.cast("int"))
    span = lambda a, b: F.when(whole(a).isNotNull() & whole(b).isNotNull(), F.struct(whole(a).alias("start"), whole(b).alias("end")))
    made = lambda t, s: F.when(t != "", F.struct(t.alias("text"), s.cast(_SPAN).alias("span")))
    none = F.lit(None).cast("int")
    flat_at = span(F.col("trigger_start"), F.col("trigger_end")) if {"trigger_start", "trigger_end"} <= set(rows.columns) else span(none, none)
    kind = rows.schema["trigger"].dataType if "trigger" in rows.columns else None
    names = [n for n in ("trigger_text", "trigger", "mention") if n in rows.columns and rows.schema[n].dataType.typeName() == "string"]
    flat = made(clean_text(F.coalesce(*[F.col(n) for n in names])) if names else F.lit(""), flat_at)
    if kind is None or kind.typeName() != "struct":
        return flat
    field = lambda n: F.col(f"trigger.{n}") if n in kind.names else none
    own = span(field("start"), field("end"))
    own = F.coalesce(F.col("trigger.span").cast(_SPAN), own) if "span" in kind.names else own
    return F.coalesce(made(clean_text(field("text")), own), flat)


def normalize_text_events(flat: DataFrame, type_map: DataFrame, role_map: DataFrame, dataset: str) -> DataFrame:
    """Text examples from flattened events. Skipped, in this order: types without a mapping, no text, no trigger."""
    typed = map_roles(map_event_types(flat, type_map, dataset), role_map, dataset)
    typed = settle(typed, {"__trigger": trigger_of(typed)})
    reason = F.when(F.col("event_type").isNull(), skip_reason("unmapped_event_type", F.coalesce(F.nullif(truthy(F.col("raw_type")), F.lit("")), F.lit("missing")))).when(F.col("text") == "", skip_reason("missing_raw_text")).when(F.col("__trigger").isNull(), skip_reason("missing_trigger"))
    pairs = F.transform("arguments", lambda a: F.concat_ws(" ", a["role"], a["text"]))
    kind, trigger = text_part(F.col("event_type")), text_part(F.col("__trigger.text"))
    summary = retrieval_text(kind, trigger, pairs)
    each = lambda n: F.transform("arguments", lambda a: a[n])
    return typed.select(
        "id",
        F.lit(SOURCE_NAMES.get(dataset, dataset)).alias("source_dataset"),
        "doc_id",
        F.lit("text").alias("modality"),
        "event_type",
        F.col("__trigger").alias("trigger"),
        F.col("text").alias("raw_text"),
        F.col("arguments").alias("text_arguments"),
        summary.alias("pattern_summary"),
        retrieval_text(kind, trigger, text_part(F.col("text")), text_part(summary), each("role"), each("text")).alias("retrieval_text"),
        reason.alias("skip_reason"),
    )


def normalize_images(flat: DataFrame, type_map: DataFrame, role_map: DataFrame, path: Column, dataset: str = "swig", image_desc: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Image examples, with ``skip_reason``, and the manifest of those that are kept. Skipped: types without a mapping, no image_id, no path.

    The visual situation is what flat's ``visual_situation`` says, or else the verb."""
    given = lambda n: clean_text(F.col(n)) if n in flat.columns else F.lit("")
    desc = clean_text(image_desc) if image_desc is not None else given("image_desc")
    typed = map_roles(map_event_types(flat, type_map, dataset, "verb"), role_map, dataset, "label")
    typed = settle(typed, {"path": path.cast("string"), "__desc": desc, "__situation": F.coalesce(F.nullif(given("visual_situation"), F.lit("")), F.col("verb"))})
    reason = F.when(F.col("event_type").isNull(), skip_reason("unmapped_event_type", F.coalesce(F.nullif(truthy(F.col("verb")), F.lit("")), F.lit("missing")))).when(truthy(F.col("image_id")) == "", skip_reason("missing_image_id")).when(truthy(F.col("path")) == "", skip_reason("missing_path"))
    kind, verb, frame, seen, situation = (text_part(F.col(c)) for c in ("event_type", "verb", "frame", "__desc", "__situation"))
    each = lambda n: F.transform("arguments", lambda a: a[n])
    summary = retrieval_text(kind, verb, situation, F.transform("arguments", lambda a: F.concat_ws(" ", a["role"], a["label"])))
    name = F.lit(SOURCE_NAMES.get(dataset, dataset))
    examples = typed.select(
        F.concat(F.lit(f"{dataset}-text::"), "image_id").alias("id"), name.alias("source_dataset"), "image_id", F.lit("image_semantics").alias("modality"), "event_type", F.col("verb").alias("swig_verb"),
        F.col("frame").alias("swig_frame"), F.col("__desc").alias("image_desc"), F.col("__situation").alias("visual_situation"), F.col("arguments").alias("image_arguments"), summary.alias("visual_pattern_summary"),
        retrieval_text(kind, verb, frame, seen, situation, text_part(summary), each("role"), each("label")).alias("retrieval_text"), reason.alias("skip_reason"),
    )
    manifest = typed.where(reason.isNull()).select(
        F.concat(F.lit(f"{dataset}-image::"), "image_id").alias("id"), name.alias("source_dataset"), "image_id", "path", "event_type", F.col("verb").alias("swig_verb"), F.col("frame").alias("swig_frame"),
        F.col("arguments").alias("image_arguments"), retrieval_text(kind, verb, frame, each("role"), each("label")).alias("retrieval_text"),
    )
    return examples, manifest


def with_retrieval_text(records: DataFrame) -> DataFrame:
    """records with ``skip_reason``: those without a retrieval text can't be indexed."""
    return records.withColumn("skip_reason", F.when(truthy(F.col("retrieval_text")) == "", skip_reason("missing_retrieval_text")))


def checked_manifest(manifest: DataFrame, images: DataFrame) -> DataFrame:
    """manifest rows with ``error``: NO_PATH, NOT_FOUND, or BAD_IMAGE:... (UnidentifiedImage, Truncated or Damaged); null for a whole image.

    ``images`` (path, content) are the files that were found, as of read_images(). They are walked through where they are read, and only what is wrong with them is joined. Of files with
    one path any counts."""
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    found = images.select(plain(F.col("path")).alias("__path"), F.concat(F.lit("BAD_IMAGE:"), image_fault(F.col("content"))).alias("__fault"), F.lit(True).alias("__there")).dropDuplicates(["__path"])
    rows = manifest.withColumn("path", truthy(F.col("path"))).join(found, plain(F.col("path")) == F.col("__path"), "left")
    error = F.when(F.col("path") == "", "NO_PATH").when(F.col("__there").isNull(), "NOT_FOUND").otherwise(F.col("__fault"))
    return rows.withColumn("error", error).drop("__path", "__fault", "__there")


def _text(rows: DataFrame, name: str) -> Column:
    return truthy(F.col(name)) if name in rows.columns else F.lit("")


def _joined(*parts: Column) -> Column:
    flat = F.flatten(F.array(*parts))
    return F.array_join(F.filter(flat, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), " ")


def _example(rows: DataFrame, modality: str, fields: list[str], extra: dict[str, Column], parts: list[Column]) -> DataFrame:
    made = rows.select(*[_text(rows, c).alias(c) for c in ("id", "source_dataset", *fields)], F.lit(modality).alias("modality"), _text(rows, "retrieval_text").alias("retrieval_text"), *[v.alias(k) for k, v in extra.items()])
    return made.withColumn("retrieval_text", F.when(F.col("retrieval_text") != "", F.col("retrieval_text")).otherwise(_joined(*parts)))


def text_examples(rows: DataFrame) -> DataFrame:
    """Rows as examples of the text layer: missing fields are empty, a plain trigger becomes {text, span}, and a missing retrieval text is put together."""
    kind = rows.schema["trigger"].dataType if "trigger" in rows.columns else None
    if kind is not None and kind.typeName() == "struct":
        trigger = F.struct(truthy(F.col("trigger.text")).alias("text"), (F.col("trigger.span") if "span" in kind.names else F.lit(None)).cast(_SPAN).alias("span"))
    else:
        trigger = F.struct(_text(rows, "trigger").alias("text"), F.lit(None).cast(_SPAN).alias("span"))
    args = F.coalesce(F.col("text_arguments"), F.array()) if "text_arguments" in rows.columns else F.array().cast("array<struct<role:string,text:string>>")
    words = F.flatten(F.transform("text_arguments", lambda a: F.array(a["role"], a["text"])))
    parts = [F.array("event_type", "raw_text", "pattern_summary", "trigger.text"), words]
    return _example(rows, "text", ["event_type", "raw_text", "pattern_summary"], {"trigger": trigger, "text_arguments": args}, parts)


def image_examples(rows: DataFrame) -> DataFrame:
    """Rows as examples of the image layer; arguments are ``image_arguments`` or else ``image_roles``."""
    given = [F.when(F.size(c) > 0, F.col(c)) for c in ("image_arguments", "image_roles") if c in rows.columns]
    kind = "array<struct<role:string,label:string>>"
    args = F.coalesce(*[g.cast(kind) for g in given], F.array().cast(kind))
    words = F.flatten(F.transform("image_arguments", lambda a: F.array(a["role"], a["label"])))
    parts = [F.array("event_type", "visual_situation", "image_desc", "visual_pattern_summary"), words]
    return _example(rows, "image_semantics", ["event_type", "image_desc", "visual_situation", "visual_pattern_summary"], {"image_arguments": args}, parts)


def bridge_examples(rows: DataFrame) -> DataFrame:
    """Rows as examples of the bridge layer between text and image cues of a role."""
    cues = {c: (F.transform(F.coalesce(F.col(c), F.array()), lambda x: x.cast("string")) if c in rows.columns else F.array().cast("array<string>")) for c in ("text_cues", "visual_cues")}
    return _example(rows, "bridge", ["event_type", "role", "note"], cues, [F.array("event_type", "role", "note"), F.col("text_cues"), F.col("visual_cues")])


def agent_states(samples: DataFrame, settings: Settings, image_root: str = "") -> DataFrame:
    """What a run begins with for each sample: its input alone, image paths below a root unless they are absolute, and nothing found yet."""
    rows = model_input(samples)
    text = lambda c: truthy(F.col(c)) if c in rows.columns else F.lit("")
    image = F.nullif(text("image"), F.lit(""))
    path = F.when(image.rlike("^(/|[a-z0-9]+:)"), image).otherwise(F.concat(F.lit(image_root.rstrip("/") + "/" if image_root else ""), image))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return rows.select(
        "id", text("text").alias("text"), (F.coalesce("words", F.array()) if "words" in rows.columns else none("string")).alias("tokens"), path.alias("raw_image"),
        F.lit(settings.event_type_mode).alias("event_type_mode"), F.lit(settings.run_mode).alias("run_mode"), F.lit(settings.search).alias("effective_search_enabled"), F.lit("").alias("image_desc"),
        F.lit("").alias("perception_summary"), none("struct<title:string,snippet:string>").alias("evidence"), F.lit(False).alias("verified"), none("string").alias("issues"), F.lit(0).alias("repair_attempts"),
    )


def gold_annotations(samples: DataFrame) -> DataFrame:
    """The gold fields of samples, for comparison only: the first event mention's type, trigger and arguments, or else the sample's type, and all annotations there are."""
    mentions = next((F.col(c) for c in ("gold_event_mentions", "event_mentions", "events", "gold_events") if c in samples.columns), None)
    first = F.try_element_at(mentions, F.lit(1)) if mentions is not None else None
    own = F.col("event_type") if "event_type" in samples.columns else F.lit(None).cast("string")
    rest = [c for c in ("text_event_mentions", "text_arguments_flat", "image_event", "image_arguments_flat", "ground_truth", "labels", "annotations") if c in samples.columns]
    made = [F.coalesce(first["event_type"], own).alias("event_type"), first["trigger"].alias("trigger"), first["arguments"].alias("arguments")] if first is not None else [own.alias("event_type")]
    ids = [F.nullif(truthy(F.col(c)), F.lit("")) for c in ("id", "sample_id", "sentence_id") if c in samples.columns]
    return samples.select(F.coalesce(*ids).alias("sample_id"), *made, *rest)


def select_sample(samples: DataFrame, sample_id: str | None = None) -> DataFrame:
    """The first sample, or the one with an id; an error if there is none."""
    found = samples.limit(1) if sample_id is None else samples.where(F.col("id") == sample_id).limit(1)
    if found.isEmpty():
        raise ValueError("no samples" if sample_id is None else f"no sample {sample_id}")
    return found


def kept(rows: DataFrame) -> DataFrame:
    return rows.where("skip_reason is null").drop("skip_reason")


def skip_counts(rows: DataFrame) -> DataFrame:
    return rows.where("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("n"))


def model_input(samples: DataFrame) -> DataFrame:
    """What an extractor may see of gold samples: nothing but identity, text, words and image."""
    return samples.select(*[c for c in ("id", "text", "words", "image") if c in samples.columns])
