"""Queries that run corpus normalisation, rule diagnostics, repair, grounding and layered retrieval over rows made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweave.functions import spans
from eventweave.operators import corpus, evidence, records, vectors, verify
from eventweave.operators import matching as m
from eventweave.operators.scoring import settle
from eventweave.plans.registry import query, table

# corpora --------------------------------------------------------------------------------------------------------------

_TURNS = "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, string_split(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' '), ' ')[1] AS word FROM conversations"


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    word = lambda x: F.split(F.trim(F.regexp_replace(x["text"], "[ \\t\\n\\r]+", " ")), " ")[0]
    return turns.select("conv_id", F.transform("t", lambda x: x.withField("word", word(x))).alias("t"))


@query(f"""SELECT conv_id::VARCHAR AS doc_id, conv_id || '::' || CASE WHEN i % 2 = 0 THEN 'ev' || i ELSE 'event' || i END AS id, role AS raw_type, word AS trigger_text,
list_filter(['Speaker|' || role, CASE WHEN i % 3 = 0 THEN 'Topic|own' END, CASE WHEN i % 3 = 1 THEN 'Topic|' || last_value(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END], lambda x: x IS NOT NULL) AS arguments FROM ({_TURNS})""")
def maven_flatten(spark, sf_dir):
    """Documents with entities and events: every turn is an event; the entity ``last`` is named by every turn, and the last one counts."""
    entity = lambda id_, name: F.struct(id_.alias("id"), F.array(F.struct(name.alias("mention"), F.lit(None).cast("array<int>").alias("offset"))).alias("mention"))
    arg = lambda content, key: F.array(F.struct(content.cast("string").alias("content"), key.cast("string").alias("entity_id"), F.lit(None).cast("array<int>").alias("offset")))

    def event(x, i):
        topic = F.when(i % 3 == 0, arg(F.lit(" own"), F.lit("none"))).when(i % 3 == 1, arg(F.lit(""), F.lit("last"))).otherwise(arg(F.lit(None), F.lit("none")))
        args = F.map_from_arrays(F.array(F.lit("Speaker_1"), F.lit("Topic_of_talk")), F.array(arg(F.lit(None), F.concat(F.lit("e"), i.cast("string"))), topic))
        return F.struct(F.when(i % 2 == 0, F.concat(F.lit("ev"), i.cast("string"))).otherwise("").alias("id"), x["role"].alias("type"), F.array(F.struct(F.lit("m").alias("id"), x["word"].alias("trigger_word"), F.lit(None).cast("array<int>").alias("offset")), F.struct(F.lit("n").alias("id"), F.lit("second").alias("trigger_word"), F.lit(None).cast("array<int>").alias("offset"))).alias("mention"), args.alias("argument"))

    docs = _conversations(spark, sf_dir).select(
        F.col("conv_id").cast("string").alias("id"), F.lit("text").alias("document"),
        F.concat(F.transform("t", lambda x, i: entity(F.concat(F.lit("e"), i.cast("string")), x["role"])), F.transform("t", lambda x: entity(F.lit("last"), x["role"]))).alias("entities"),
        F.transform("t", event).alias("events"),
    )
    return corpus.flatten_maven(docs).select("doc_id", "id", "raw_type", "trigger_text", F.transform("arguments", lambda a: F.concat_ws("|", a["role"], a["text"])).alias("arguments"))


@query("SELECT p_partkey || '.jpg' AS image_id, p_type AS verb, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'agent=' || p_brand || ', item=' || p_name END AS frame, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 2 END AS n_arguments FROM part")
def swig_flatten(spark, sf_dir):
    frame = F.create_map(F.lit("item"), F.col("p_name"), F.lit("agent"), F.col("p_brand"), F.lit("place"), F.lit(" "))
    none = F.array().cast("array<map<string,string>>")
    images = table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("image_id"), F.col("p_type").alias("verb"), F.when(F.col("p_size") % 5 == 0, none).otherwise(F.array(F.lit(None).cast("map<string,string>"), frame)).alias("frames"))
    return corpus.flatten_swig(images).select("image_id", "verb", "frame", F.size("arguments").alias("n_arguments"))


_VERBS = "CASE WHEN p_size % 3 = 0 THEN 'Contact:Meet' WHEN p_size % 3 = 1 THEN 'Life:Die' END"
_KEPT = "CASE WHEN p_size % 5 = 0 THEN [] WHEN p_size % 3 = 0 THEN ['Participant ' || p_brand] WHEN p_size % 3 = 1 THEN ['Agent ' || p_brand, 'Victim ' || p_name] ELSE [] END"


def _image_maps(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    types = spark.createDataFrame([("swig", "Kind 0", "Life:Die"), ("swig", "kind 0 ", "Contact:Meet"), ("swig", "kind 1", "Life:Die")], "dataset string, raw_type string, event_type string").coalesce(1)
    roles = spark.createDataFrame([("swig", "Contact:Meet", "agent", "Participant"), ("swig", "Contact:Meet", "item", "Victim"), ("swig", "Life:Die", "Agent", "Agent"), ("swig", "Life:Die", "item", "Place"), ("swig", "Life:Die", " ITEM", "Victim")], "dataset string, event_type string, raw_role string, role string").coalesce(1)
    return types, roles


def _images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    frame = F.map_from_arrays(F.array(F.lit("agent"), F.lit("item"), F.lit("place")), F.array("p_brand", "p_name", F.lit("")))
    frames = F.when(F.col("p_size") % 5 == 0, F.array().cast("array<map<string,string>>")).otherwise(F.array(frame))
    raw = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.col("p_partkey").cast("string")).alias("image_id"), F.concat(F.lit("Kind "), (F.col("p_size") % 3).cast("string")).alias("verb"), frames.alias("frames"), "p_partkey")
    flat = corpus.flatten_swig(raw)
    path = F.when(F.col("image_id").try_cast("long") % 7 != 0, F.concat(F.lit("/img/"), "image_id"))
    return corpus.normalize_images(flat, *_image_maps(spark), path)


@query(f"""WITH r AS (SELECT *, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_partkey::VARCHAR END AS image_id, {_VERBS} AS t, {_KEPT} AS args FROM part),
s AS (SELECT image_id, t, args, CASE WHEN t IS NULL THEN 'unmapped_event_type:kind_2' WHEN image_id = '' THEN 'missing_image_id' WHEN p_partkey % 7 = 0 THEN 'missing_path' END AS skip_reason,
  'Kind ' || p_size % 3 AS verb, CASE WHEN p_size % 5 = 0 THEN '' ELSE ' agent=' || p_brand || ', item=' || p_name END AS frame FROM r)
SELECT image_id, t AS event_type, t || ' ' || verb || ' ' || verb || coalesce(' ' || nullif(array_to_string(args, ' '), ''), '') AS pattern,
t || ' ' || verb || frame || ' ' || verb || ' ' || t || ' ' || verb || ' ' || verb || coalesce(' ' || nullif(array_to_string(args, ' '), ''), '') || coalesce(' ' || nullif(array_to_string(list_concat(list_transform(args, lambda a: string_split(a, ' ')[1]), list_transform(args, lambda a: regexp_replace(a, '^[^ ]+ ', ''))), ' '), ''), '') AS retrieval_text
FROM s WHERE skip_reason IS NULL""")
def image_examples(spark, sf_dir):
    examples, _ = _images(spark, sf_dir)
    return corpus.kept(examples).select("image_id", "event_type", F.col("visual_pattern_summary").alias("pattern"), "retrieval_text")


@query(f"""WITH r AS (SELECT *, {_VERBS} AS t FROM part), s AS (SELECT CASE WHEN t IS NULL THEN 'unmapped_event_type:kind_2' WHEN p_partkey % 9 = 0 THEN 'missing_image_id' WHEN p_partkey % 7 = 0 THEN 'missing_path' END AS skip_reason FROM r)
SELECT skip_reason, count(*) AS n FROM s WHERE skip_reason IS NOT NULL GROUP BY 1""")
def image_skip_reasons(spark, sf_dir):
    examples, _ = _images(spark, sf_dir)
    return corpus.skip_counts(examples)


@query(f"SELECT 'swig-image::' || p_partkey AS id, '/img/' || p_partkey AS path, {_VERBS} AS event_type, CAST(len({_KEPT}) AS INTEGER) AS n_arguments FROM part WHERE {_VERBS} IS NOT NULL AND p_partkey % 9 <> 0 AND p_partkey % 7 <> 0")
def image_manifest(spark, sf_dir):
    _, manifest = _images(spark, sf_dir)
    return manifest.select("id", "path", "event_type", F.size("image_arguments").alias("n_arguments"))


# Images of one pixel: PNG, JPEG, GIF, WebP and BMP.
_PIXELS = (
    "89504e470d0a1a0a0000000d4948445200000001000000010800000000" + "3a7e9b550000000a49444154789c636000000002000148afa4710000000049454e44ae426082",
    "ffd8ffe000104a46494600010100000100010000ffdb004300" + "01" * 64 + "ffc0000b080001000101011100ffc40014" + "0001" + "00" * 16 + "ffda0008010100003f00" + "37ff00ff" + "d9",
    "47494638396101000100800000000000ffffff21f90401000000002c00000000010001000002024401003b",
    "524946461a000000574542505650384c0d0000002f00000010071011118888fe0700",
    "424d3a000000000000003600000028000000010000000100000001001800000000000400000000000000000000000000000000000000" + "ffffff00",
)


@query("""WITH r AS (SELECT p_partkey AS k, p_partkey % 5 AS kind, CASE WHEN p_size % 6 = 0 THEN '' ELSE '/img/' || p_partkey END AS path, p_partkey // 5 % 5 AS state FROM part)
SELECT k::VARCHAR AS image_id, CASE WHEN path = '' THEN 'NO_PATH' WHEN state = 0 THEN 'NOT_FOUND' WHEN state = 1 THEN 'BAD_IMAGE:UnidentifiedImage' WHEN state = 2 THEN 'BAD_IMAGE:Truncated' WHEN state = 3 THEN 'BAD_IMAGE:Damaged' END AS error FROM r""")
def manifest_check(spark, sf_dir):
    """Images of five kinds, whole, cut short, damaged inside, or of no known kind."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    kinds, state = F.array(*[F.unhex(F.lit(x)) for x in _PIXELS]), F.floor(k / 5) % 5
    image = F.element_at(kinds, (k % 5 + 1).cast("int"))
    # a byte of the pixels under a checksum, of a width, of a block's kind, of a signature, of a depth
    at = F.element_at(F.array(*[F.lit(n) for n in (48, 97, 19, 20, 28)]), (k % 5 + 1).cast("int"))
    broken = F.concat(F.substring(image, F.lit(1), at), F.unhex(F.lit("00")), F.substring(image, at + 2, F.lit(1 << 20)))
    content = F.when(state == 1, F.concat(F.unhex(F.lit("00")), image)).when(state == 2, F.substring(image, F.lit(1), F.octet_length(image) - 2)).when(state == 3, broken).otherwise(image)
    images = part.where(state != 0).select(F.concat(F.lit("file:/img/"), k.cast("string")).alias("path"), content.alias("content"))
    rows = part.select(k.cast("string").alias("image_id"), F.when(F.col("p_size") % 6 != 0, F.concat(F.lit("/img/"), k.cast("string"))).alias("path"))
    return corpus.checked_manifest(rows, images).select("image_id", "error")


@query("""SELECT id, event_type, CASE WHEN given <> '' THEN given ELSE array_to_string(list_filter([event_type, raw, trig, 'Place', nation], lambda x: trim(coalesce(x, '')) <> ''), ' ') END AS retrieval_text FROM
(SELECT c_custkey::VARCHAR AS id, trim(c_mktsegment) AS event_type, CASE WHEN c_custkey % 3 = 0 THEN 'given ' || c_name ELSE '' END AS given, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS raw, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 't' || c_nationkey END AS trig, c_nationkey::VARCHAR AS nation FROM customer)""")
def layer_examples(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit(" "), F.col("c_mktsegment")).alias("event_type"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("given "), F.col("c_name"))).alias("retrieval_text"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("raw_text"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("t"), F.col("c_nationkey").cast("string"))).alias("trigger"),
        F.array(F.struct(F.lit("Place").alias("role"), F.col("c_nationkey").cast("string").alias("text"))).alias("text_arguments"),
    )
    return corpus.text_examples(rows).select("id", "event_type", "retrieval_text")


# rules and repair: a sentence of nine words, in which every event marks a span of one to three words -----------------------------------------

_WORDS = "the two men met President Barack Obama in Paris".split()
_EVENT = """e AS (SELECT event_id, user_id % 9 AS s, least(9, user_id % 9 + 1 + event_id % 3) AS e, event_id % 4 AS q, event_id % 5 AS z, event_id % 7 AS w, event_id % 11 AS v,
  CASE event_type WHEN 'click' THEN 'Justice:Arrest-Jail' WHEN 'view' THEN 'Contact:Meet' ELSE event_type END AS t FROM events),"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with tokens: a text argument whose text is that of its span, or of a span one word on; a trigger; an image argument."""
    # rows are few bytes and much work, so files make too few tasks, and so would partitions that are joined by their bytes
    ev = table(spark, sf_dir, "events").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    start = (F.col("user_id") % 9).cast("int")
    rows = settle(ev, {"s": start, "e": F.least(F.lit(9), start + 1 + (F.col("event_id") % 3).cast("int")), "tokens": F.array(*map(F.lit, _WORDS)), "q": F.col("event_id") % 4, "z": F.col("event_id") % 5, "w": F.col("event_id") % 7, "v": F.col("event_id") % 11})
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    shift = F.when(F.col("q") == 1, 1).otherwise(0)
    text = F.array_join(F.slice("tokens", F.least(F.col("s") + shift, F.lit(8)) + 1, F.col("e") - F.col("s")), " ")
    own = F.struct(F.when(F.col("z") == 0, "Agent").otherwise("Participant").alias("role"), text.alias("text"), F.when(F.col("q") != 2, span(F.col("s"), F.when(F.col("q") == 3, 10).otherwise(F.col("e")))).alias("span"))
    status = F.when(F.col("w") < 3, "unresolved").when(F.col("w") < 5, "grounded").otherwise("failed")
    image = F.struct(F.when(F.col("v") == 0, "").otherwise("Place").alias("role"), F.when(F.col("v") == 1, "street").when(F.col("v") == 2, " ").otherwise("hall").alias("label"), F.when(F.col("w") % 2 == 1, F.array(*[F.lit(x) for x in (1.0, 2.0, 3.0, 4.0)])).when(F.col("w") == 6, F.array(F.lit(1.0))).alias("bbox"), status.alias("grounding_status"))
    trigger = F.when(F.col("z") != 1, F.struct(F.lit("met").alias("text"), F.when(F.col("z") != 2, "text").alias("modality"), span(F.lit(3), F.when(F.col("z") == 3, 5).otherwise(4)).alias("span")))
    kind = F.when(F.col("event_type") == "click", "Justice:Arrest-Jail").when(F.col("event_type") == "view", "Contact:Meet").otherwise(F.col("event_type"))
    results = F.array(F.struct(F.lit("Place").alias("role"), F.lit("hall").alias("label"), F.array(*[F.lit(x) for x in (5.0, 6.0, 7.0, 8.0)]).alias("bbox"), F.when(F.col("z") == 4, "grounded").otherwise("failed").alias("grounding_status")))
    return rows.select("event_id", kind.alias("event_type"), trigger.alias("trigger"), F.array(own).alias("text_arguments"), F.array(image).alias("image_arguments"), "tokens", results.alias("results"), (F.col("z") != 3).alias("seen"), "s", "e", "q")


_NAMES = ", ".join(f"'{w}'" for w in _WORDS)
#: By hand, for spans of the sentence: where the part of a mention that stands for it begins and ends.
_PREFERRED = """CASE WHEN e - s = 1 THEN s WHEN s = 0 AND e = 2 THEN 0 WHEN s = 0 AND e = 3 THEN 2 WHEN s = 4 THEN 5 WHEN s = 5 AND e = 7 THEN 5 ELSE e - 1 END"""
_MATCH = "(q = 0 OR q = 1 AND s = 8)"  # one word on from the last one is the last one again
_LABEL = "CASE v WHEN 1 THEN 'street' WHEN 2 THEN '' ELSE 'hall' END"


@query(f"""WITH {_EVENT} d AS (SELECT event_id, s, e, list_filter([
 CASE WHEN t NOT IN ('Justice:Arrest-Jail', 'Contact:Meet') THEN 'event_type|unsupported_event_type' END,
 CASE WHEN t = 'Justice:Arrest-Jail' AND z <> 0 OR t = 'Contact:Meet' AND z = 0 THEN 'text_arguments[0].role|invalid_role' END,
 CASE WHEN z = 2 THEN 'trigger.modality|invalid_modality' END, CASE WHEN z = 3 THEN 'trigger.span|span_mismatch' END,
 CASE WHEN q = 3 THEN 'text_arguments[0].span|invalid_span' END, CASE WHEN q = 1 AND NOT {_MATCH} THEN 'text_arguments[0].span|span_mismatch' END,
 CASE WHEN {_MATCH} AND s = 0 THEN 'text_arguments[0].text|contains_determiner' END, CASE WHEN {_MATCH} AND s = 1 THEN 'text_arguments[0].text|contains_quantity' END,
 CASE WHEN {_MATCH} AND s = 4 AND e > 5 THEN 'text_arguments[0].text|contains_person_title_prefix' END,
 CASE WHEN {_MATCH} AND {_PREFERRED} <> s THEN 'text_arguments[0].span|unnormalized_head_word' END,
 CASE WHEN v = 0 THEN 'image_arguments[0].role|missing_or_empty' END, CASE WHEN v = 2 THEN 'image_arguments[0].label|missing_or_empty' END, CASE WHEN v = 1 THEN 'image_arguments[0].label|generic_weak_place' END,
 CASE WHEN w = 4 THEN 'image_arguments[0].grounding_status|invalid_grounding_status' END, CASE WHEN w IN (1, 5, 6) THEN 'image_arguments[0].grounding_status|invalid_grounding_status' END,
 CASE WHEN w = 6 THEN 'image_arguments[0].bbox|invalid_bbox_format' END, CASE WHEN z = 3 THEN 'image_arguments|missing_image_evidence' END,
 CASE WHEN w < 3 AND z = 4 AND v > 2 THEN 'image_arguments[0].grounding_status|grounding_result_not_applied' END], lambda x: x IS NOT NULL) AS found FROM e)
SELECT event_id, found FROM d""")
def diagnostics_rules(spark, sf_dir):
    rows = verify.with_diagnostics(_marked(spark, sf_dir), "tokens", "seen", "results")
    return rows.select("event_id", F.transform("diagnostics", lambda d: F.concat_ws("|", d["field_path"], d["issue_type"])).alias("found"))


@query(f"""WITH {_EVENT} f AS (SELECT *, {_PREFERRED} AS a FROM e)
SELECT event_id, CASE WHEN q < 2 THEN [a::INTEGER, e::INTEGER] WHEN q = 3 THEN [s::INTEGER, 10] END AS span, CASE WHEN q < 2 THEN list_aggregate(([{_NAMES}])[a + 1 : e], 'string_agg', ' ') END AS text FROM f""")
def preferred_spans(spark, sf_dir):
    """The part of each mention that stands for it, and its words; spans that don't fit stay."""
    rows = _marked(spark, sf_dir).withColumn("p", spans.preferred_spans(F.col("tokens"), F.transform("text_arguments", lambda a: a["span"]))[0])
    words = F.array_join(F.slice("tokens", F.col("p.start") + 1, F.greatest(F.col("p.end") - F.col("p.start"), F.lit(0))), " ")
    return rows.select("event_id", F.when(F.col("p.start").isNotNull(), F.array("p.start", "p.end")).alias("span"), F.when(F.col("q") < 2, words).alias("text"))


@query(f"""WITH {_EVENT} f AS (SELECT *, CASE WHEN q = 1 AND s < 8 THEN s + 1 ELSE s END AS s1 FROM e), g AS (SELECT event_id, z, q, s1 AS s, least(9, s1 + e - s) AS e FROM f), h AS (SELECT *, {_PREFERRED} AS a FROM g)
SELECT event_id, CASE WHEN z <> 1 THEN [3, 4] END AS trigger, [a::INTEGER, e::INTEGER] AS argument FROM h""")
def align_events(spark, sf_dir):
    """Triggers and arguments with the spans that their texts have, arguments at preferred boundaries; every text stands in the sentence once."""
    rows = verify.align_events(_marked(spark, sf_dir))
    own = lambda s: F.when(s.isNotNull(), F.array(s["start"], s["end"]))
    return rows.select("event_id", own(F.col("trigger.span")).alias("trigger"), own(F.try_element_at("text_arguments", F.lit(1))["span"]).alias("argument"))


@query(f"""WITH {_EVENT} f AS (SELECT event_id, z, w, v, {_LABEL} AS label, event_id % 2 = 0 AS hit FROM e)
SELECT event_id, CASE WHEN w < 3 AND z = 4 AND v > 2 AND w <> 1 AND hit THEN 'grounded' WHEN w < 3 THEN 'unresolved' WHEN w < 5 THEN 'grounded' ELSE 'failed' END AS status FROM f""")
def grounding_applied(spark, sf_dir):
    """Statuses of image arguments after boxes of grounding results were written back where a plan names them."""
    plan = F.when(F.col("event_id") % 2 == 0, F.array(F.struct(F.lit("image_arguments[0]").alias("field_path"), F.lit("x").alias("issue_type"), F.lit("y").alias("suggested_action"))))
    rows = verify.apply_grounding(_marked(spark, sf_dir).withColumn("plan", plan), "results", "plan")
    return rows.select("event_id", F.col("image_arguments")[0]["grounding_status"].alias("status"))


@query(f"""WITH {_EVENT} f AS (SELECT event_id, CASE z WHEN 0 THEN 'Agent' ELSE 'Participant' END AS role, CASE v WHEN 0 THEN '' ELSE 'Place' END AS irole, {_LABEL} AS label, event_id % 6 AS p FROM e)
SELECT event_id, CASE WHEN p IN (0, 3) THEN 'New' ELSE role END AS role, CASE WHEN p = 3 THEN 'new' WHEN p = 1 THEN 'new' END IS NOT NULL AS text_new, CASE WHEN p = 2 THEN 'van' WHEN v2 THEN ' ' ELSE label END AS label FROM (SELECT f.*, v = 2 AS v2 FROM f JOIN e USING (event_id))""")
def merged_by_paths(spark, sf_dir):
    """Fields that repair paths name, taken from a proposed event; other fields stay."""
    kind = F.col("event_id") % 6
    rows = _marked(spark, sf_dir)
    arg, image = rows.schema["text_arguments"].dataType.elementType, rows.schema["image_arguments"].dataType.simpleString()
    new = F.struct(F.lit("Life:Die").alias("event_type"), F.col("trigger").alias("trigger"), F.array(F.struct(F.lit("New").alias("role"), F.lit("new").alias("text"), F.lit(None).cast(arg["span"].dataType).alias("span"))).alias("text_arguments"), F.array(F.struct(F.lit("Old").alias("role"), F.lit("van").alias("label"), F.lit(None).cast("array<double>").alias("bbox"), F.lit("grounded").alias("grounding_status"))).cast(image).alias("image_arguments"))
    paths = F.when(kind == 0, F.array(F.lit("text_arguments[0].role"))).when(kind == 1, F.array(F.lit("text_arguments[0].text"))).when(kind == 2, F.array(F.lit("image_arguments[0].label"), F.lit("image_arguments[0].grounding_status"))).when(kind == 3, F.array(F.lit("text_arguments[0]"))).otherwise(F.array(F.lit("event_type")))
    out = verify.merge_by_paths(rows.withColumns({"new": new, "paths": paths}), "new")
    return out.select("event_id", F.col("text_arguments")[0]["role"].alias("role"), (F.col("text_arguments")[0]["text"] == "new").alias("text_new"), F.col("image_arguments")[0]["label"].alias("label"))


@query("""WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus, l_quantity) AS n, l_returnflag AS role, l_linestatus AS label, l_quantity > 25 AS good FROM lineitem),
a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, role, label ORDER BY n) AS i FROM l WHERE n % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, role, label ORDER BY n) AS i FROM l WHERE n % 2 = 1 AND good)
SELECT a.l_orderkey, a.n, r.n AS taken FROM a JOIN r USING (l_orderkey, role, label, i)""")
def grounding_attached(spark, sf_dir):
    """Which result (an odd line) each image argument (an even line) takes: the nth of a role and label the nth grounded one."""
    item = F.struct("l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x, i: x.withField("n", i + 1)).alias("all"))
    made = lambda keep, box, status: F.transform(F.filter("all", keep), lambda x: F.struct(x["l_returnflag"].alias("role"), x["l_linestatus"].alias("label"), box(x).alias("bbox"), status(x).alias("grounding_status"), x["n"].cast("long").alias("n")))
    args = made(lambda x: x["n"] % 2 == 0, lambda x: F.lit(None).cast("array<double>"), lambda x: F.lit("unresolved"))
    results = made(lambda x: x["n"] % 2 == 1, lambda x: F.array(x["n"].cast("double")), lambda x: F.when(x["l_quantity"] > 25, "grounded").otherwise("failed"))
    out = settle(rows, {"args": args, "results": results}).select("l_orderkey", F.explode(m.attach_grounding(F.col("args"), F.col("results"))).alias("a"))
    return out.where("a.grounding_status = 'grounded'").select("l_orderkey", "a.n", F.col("a.bbox")[0].cast("long").alias("taken"))


@query("""WITH v AS (SELECT event_id, user_id, CASE event_id % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' END AS said FROM events)
SELECT event_id, said = 'YES' AND user_id % 4 <> 0 AS verified, CASE WHEN event_id % 3 = 2 THEN 0.0 ELSE least(1.0, (user_id % 15) / 10.0) END AS confidence, CAST((user_id % 4 = 0)::INT + CASE event_id % 3 WHEN 0 THEN 0 ELSE 1 END + CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END AS INTEGER) AS n_issues FROM
(SELECT event_id, user_id, coalesce(said, '') AS said FROM v)""")
def verdicts(spark, sf_dir):
    """Verifiers' answers with the rules' findings: an answer that holds no object, one with two issues, and YES, which clears its own issues."""
    kind = F.col("event_id") % 3
    answer = F.concat(F.lit('{"verdict": "'), F.when(kind == 0, "yes").otherwise("No"), F.lit('", "issues": ["x", "y"], "confidence": '), ((F.col("user_id") % 15) / 10.0).cast("string"), F.lit("}"))
    found = F.when(F.col("user_id") % 4 == 0, F.array(F.struct(F.lit("trigger").alias("field_path"), F.lit("z").alias("issue_type"), F.lit("w").alias("suggested_action")))).otherwise(F.array().cast(f"array<{verify.DIAGNOSTIC}>"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(kind == 2, "no answer").otherwise(F.concat(F.lit("Here: "), answer)).alias("answer"), found.alias("diagnostics"))
    return verify.with_verdict(rows).select("event_id", "verified", "confidence", F.size("issues").alias("n_issues"))


# retrieval and search ---------------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT vec_id AS query_id, CASE WHEN vec_id % 150 = 0 THEN -1 ELSE label END AS kind, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
c AS (SELECT vec_id AS row, label, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 4 = 0 THEN 'ace_text' WHEN vec_id % 4 = 1 THEN 'maven_text' WHEN vec_id % 4 = 2 THEN 'swig_text' ELSE 'bridge' END AS index_name FROM embeddings),
h AS (SELECT query_id, index_name, row, list_dot_product(q.e, c.e) AS s, CASE WHEN index_name IN ('ace_text', 'maven_text') THEN 'text' WHEN index_name = 'swig_text' THEN 'image' ELSE 'bridge' END AS layer FROM q JOIN c ON kind = -1 OR label = kind),
r AS (SELECT *, row_number() OVER (PARTITION BY layer, query_id ORDER BY s DESC, index_name, row) AS rank FROM h)
SELECT layer, query_id, CAST(rank AS INTEGER) AS rank, index_name, row, round(s, 6) AS score FROM r WHERE rank <= CASE layer WHEN 'text' THEN 4 WHEN 'image' THEN 3 ELSE 1 END""")
def layered_retrieval(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("event_type"), "embedding")
    asked = rows.where("row % 50 = 0").select(F.col("row").alias("query_id"), F.when(F.col("row") % 150 == 0, "").otherwise(F.coalesce("event_type", F.lit("none"))).alias("event_type"), "embedding")
    indexes = {name: rows.where(F.col("row") % 4 == k) for k, name in enumerate(("ace_text", "maven_text", "swig_text", "bridge"))}
    return vectors.layered_retrieve(dict.fromkeys(indexes, asked), indexes, {"text": 4, "image": 3, "bridge": 1}).withColumn("score", F.round("score", 6))


@query("""SELECT o_orderkey, n - 1 AS _pos, title, 'text ' || l_linenumber AS snippet, least(1.0, l_quantity / 40) AS score FROM
(SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag) AS n, l_linenumber, l_quantity, CASE WHEN l_quantity % 4 = 0 THEN '' ELSE 'title ' || l_returnflag END AS title FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 8 <> 0) WHERE title <> ''""")
def search_hits(spark, sf_dir):
    """Evidence items of JSON answers, one an order; answers of every eighth order are broken."""
    item = F.struct("l_linenumber", "l_quantity", "l_returnflag")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("all"))
    result = F.transform("all", lambda x: F.struct(F.when(x["l_quantity"] % 4 == 0, " ").otherwise(F.concat(F.lit("title "), x["l_returnflag"])).alias("title"), F.when(x["l_linenumber"] % 2 == 0, F.concat(F.lit("text "), x["l_linenumber"].cast("string"))).alias("content"), F.concat(F.lit("text "), x["l_linenumber"].cast("string")).alias("snippet"), F.lit("u").alias("url"), (x["l_quantity"] / 40).alias("score")))
    answer = F.when(F.col("o_orderkey") % 8 == 0, "not JSON").otherwise(F.to_json(F.struct(result.alias("results"))))
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    return evidence.search_hits(rows.join(keys, "o_orderkey", "left_semi").select("o_orderkey", answer.alias("response"))).select("o_orderkey", F.col("_pos").cast("long").alias("_pos"), "title", "snippet", "score")


@query("""SELECT e.event_id AS id, e.event_type AS raw_text, coalesce(e.props, '') AS raw_image_desc, CASE WHEN e.event_id % 2 = 0 THEN 1 ELSE 0 END AS n_text, 0 AS n_bridge, CASE WHEN e.event_id % 3 = 0 THEN 2 ELSE 0 END AS n_evidence FROM events e""")
def fusion_contexts(spark, sf_dir):
    ev = F.col("event_id")
    states = table(spark, sf_dir, "events").select(ev.alias("id"), F.col("event_type").alias("text"), F.col("props").alias("image_desc"), F.when(ev % 2 == 0, F.array(F.struct(F.lit("x").alias("id")))).alias("text_examples"), F.when(ev % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("evidence"))
    c = F.col("fusion_context")
    return records.fusion_context(states).select("id", c["raw_text"].alias("raw_text"), c["raw_image_desc"].alias("raw_image_desc"), F.size(c["patterns"]["text"]).alias("n_text"), F.size(c["patterns"]["bridge"]).alias("n_bridge"), F.size(c["evidence"]).alias("n_evidence"))


@query("SELECT user_id, list(event_type ORDER BY event_id) AS history FROM events GROUP BY 1")
def trace_append(spark, sf_dir):
    """Each user's whole history, every event appended to what came before it."""
    event = F.struct("event_id", "event_type")
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(event)).alias("x"))
    grown = F.aggregate("x", F.lit(None).cast("array<string>"), lambda history, x: records.appended(history, x["event_type"]))
    return users.select("user_id", grown.alias("history"))
