"""Queries that run the functions of records, rules and evidence, and round trips through sources and sinks, over the test tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress

from pyspark.sql import functions as F

from eventweave.functions import spans, text
from eventweave.operators import corpus, errors, evidence, ordering, records, verify
from eventweave.operators import matching as m
from eventweave.operators.scoring import settle
from eventweave.plans.evaluation import samples
from eventweave.plans.registry import query, table
from eventweave.session import remove, scratch_path
from eventweave.sources import files, sinks
from eventweave.streaming import resume
from eventweave.streaming.events import EVENT, NodeLog

# round trips ------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def jsonl_round_trip(spark, sf_dir):
    """A table as JSON lines, and back."""
    path = scratch_path(spark, "lines") + ".jsonl"
    sinks.write_jsonl(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return files.read_json_documents(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("SELECT c_custkey, c_name FROM customer")
def wrapped_json(spark, sf_dir):
    """Files of one object each, with the records in an array under a key and elements that are no objects among them."""
    path = scratch_path(spark, "wrapped")
    rows = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 64).alias("g")).agg(F.collect_list(F.to_json(F.struct("c_custkey", "c_name"))).alias("x"))
    one = F.concat(F.lit('{"samples": null, "data": [3, '), F.array_join("x", ", "), F.lit(', "text"]}'))
    rows.select("g", one.alias("value")).write.partitionBy("g").text(path)
    return files.read_json_documents(spark, path, "c_custkey bigint, c_name string")


@query("SELECT vec_id AS row, label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id + 2000000, label FROM embeddings WHERE vec_id % 3 = 0")
def index_round_trip(spark, sf_dir):
    """A saved index, with more vectors added, its parts joined, and more added by two writers that began with the same snapshot; a refused one leaves it as it is."""
    root = scratch_path(spark, "index")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), "label", "embedding")
    sinks.save_index(rows, root, kind="text")
    sinks.add_to_index(rows.where("row % 2 = 0").withColumn("row", F.col("row") + 1000000), root)
    assert sinks.compact_index(spark, root)
    with ThreadPoolExecutor(2) as writers:
        more = [rows.where(f"row % 3 = 0 and row % 2 = {k}").withColumn("row", F.col("row") + 2000000) for k in (0, 1)]
        list(writers.map(lambda v: sinks.add_to_index(v, root), more))
    try:
        sinks.save_index(rows.where("false"), root)
    except ValueError:
        return files.load_index(spark, root).select("row", "label")
    raise AssertionError("an empty index was saved")


@query("SELECT user_id, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 GROUP BY 1")
def stream_resumed(spark, sf_dir):
    """Events that come in files of two batches, the second after a stop. Many come twice, in other files of a batch or in both, and some are among another run's results or errors; each of the rest is seen once."""
    src, out, ck = (scratch_path(spark, n) for n in ("in", "out", "checkpoint"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    done = [rows.where("event_id % 7 = 0").select("event_id"), rows.where("event_id % 11 = 0").select("event_id")]
    for part in ("event_id % 2 = 0", "event_id % 10 = 0", "event_id % 2 = 1 or event_id % 6 = 0", "event_id % 15 = 0"):
        rows.where(part).write.mode("append").json(src)
        if part[-3:] != "= 1":
            resume.evaluate_new(spark, src, "event_id bigint, user_id bigint", lambda d: d, out, ck, key="event_id", done=done).awaitTermination()
    seen = spark.read.parquet(out).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    remove(spark, src)
    return seen


def _mixed(spark, sf_dir):
    """Customers in a folder of files of different formats: by c_custkey % 6 an object that wraps records, lines, an array, lines of which some are broken, one record a file (under 60),
    and files that are cut off. Every file has its records in the order of their keys."""
    path = scratch_path(spark, "mixed")
    key = F.col("c_custkey")
    record = F.to_json(F.struct("c_custkey", "c_name"))
    form = (key % 6).cast("int")
    line = F.when((form == 3) & (key % 5 == 0), F.concat(F.lit("{"), F.col("c_name"))).when((form == 1) & (key % 7 == 0), F.concat(F.lit("["), key.cast("string"), F.lit("]"))).otherwise(record)
    rows = table(spark, sf_dir, "customer").where("c_custkey % 6 <> 4 or c_custkey < 60").select(form.alias("form"), F.when(form == 4, key).otherwise(key % 64).alias("g"), F.struct(key.alias("k"), line.alias("line")).alias("x"))
    each = rows.groupBy("form", "g").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]).alias("x"))
    many = F.array_join("x", ", ")
    text = (
        F.when(F.col("form") == 0, F.concat(F.lit('{"records": [3, '), many, F.lit("]}"))).when(F.col("form") == 2, F.concat(F.lit("[\n"), many, F.lit(', "text"]')))
        .when(F.col("form") == 5, F.concat(F.lit("["), many)).when(F.col("form") == 3, F.concat(F.lit("\n"), F.array_join("x", "\n\n"))).otherwise(F.array_join("x", "\n"))
    )
    each.select("form", "g", text.alias("value")).write.partitionBy("form", "g").text(path)
    return files.read_with_quarantine(spark, path, "c_custkey bigint, c_name string", "corpus")


@query("SELECT c_custkey, c_name FROM customer WHERE CASE c_custkey % 6 WHEN 1 THEN c_custkey % 7 <> 0 WHEN 3 THEN c_custkey % 5 <> 0 WHEN 4 THEN c_custkey < 60 WHEN 5 THEN false ELSE true END")
def mixed_corpus(spark, sf_dir):
    """The sound records of a folder of files of six formats, each file read by its own."""
    return _mixed(spark, sf_dir)[0]


@query("""WITH c AS (SELECT c_custkey AS k, c_name, c_custkey % 6 AS form, c_custkey % 64 AS g, row_number() OVER (PARTITION BY c_custkey % 6, c_custkey % 64 ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY c_custkey % 6, c_custkey % 64) AS n FROM customer)
SELECT form::INTEGER AS form, g::BIGINT AS g, i::BIGINT AS line, 'not an object' AS reason FROM c WHERE form = 1 AND k % 7 = 0 UNION ALL SELECT form, g, 2 * i, 'not JSON' FROM c WHERE form = 3 AND k % 5 = 0
UNION ALL SELECT DISTINCT form, g, 1, 'not an object' FROM c WHERE form = 0 UNION ALL SELECT DISTINCT form, g, n + 1, 'not an object' FROM c WHERE form = 2 UNION ALL SELECT DISTINCT form, g, 1, 'not JSON' FROM c WHERE form = 5""")
def mixed_corpus_quarantined(spark, sf_dir):
    """Where the broken records of such a folder stand, and what is wrong with them; as they were written aside."""
    path = scratch_path(spark, "quarantine")
    sinks.write_quarantine(_mixed(spark, sf_dir)[1], path)
    bad = spark.read.option("sep", "\t").option("header", "true").schema("file string, line bigint, reason string, value string").csv(path)
    part = lambda name: F.regexp_extract("file", f"/{name}=(\\d+)/", 1)
    return bad.select(part("form").cast("int").alias("form"), part("g").cast("bigint").alias("g"), "line", "reason")


@query("SELECT count(*) AS samples, count(*) FILTER (quality = 1) AS verified, count(*) FILTER (toxic = 1) AS with_issues, 0::BIGINT AS skipped FROM labels")
def results_recounted(spark, sf_dir):
    """Predictions, traces, errors, metrics and a summary of a run, and the counts that a resumed one begins with."""
    root = scratch_path(spark, "results")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.lit("p").alias("prediction"), F.lit("t").alias("trace"), (F.col("quality") == 1).alias("verified"), F.when(F.col("toxic") == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("issues"))
    sinks.write_results(rows, root)
    return sinks.recount(spark, root)


# tokens and texts ---------------------------------------------------------------------------------------------------------

_WORDS = "string_split(upper(l_returnflag) || ' ' || l_linestatus || ' ' || CAST(l_linenumber AS VARCHAR) || ' ' || l_returnflag || ' ' || l_linestatus, ' ')"


@query(f"""WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity, {_WORDS} AS w, [l_returnflag, l_linestatus] AS p FROM lineitem),
s AS (SELECT *, list_filter(range(0, 4), lambda i: w[i + 1] = p[1] AND w[i + 2] = p[2]) AS starts FROM w)
SELECT l_orderkey, l_linenumber, l_quantity, list_transform(starts, lambda i: i::INTEGER) AS starts, len(list_filter(range(0, 5), lambda i: w[i + 1] = l_linenumber::VARCHAR)) = 1 AS single FROM s""")
def phrase_starts(spark, sf_dir):
    """Where a phrase of two tokens begins in five, and whether a number stands there once."""
    number = F.col("l_linenumber").cast("string")
    words = F.array("l_returnflag", "l_linestatus", number, "l_returnflag", "l_linestatus")
    rows = table(spark, sf_dir, "lineitem").withColumn("w", words)
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", m.phrase_starts(F.col("w"), F.array("l_returnflag", "l_linestatus")).alias("starts"), spans.unique_span(F.col("w"), number).isNotNull().alias("single"))


@query("""WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
one AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS start FROM t),
two AS (SELECT doc_id, start, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM one WINDOW o AS (PARTITION BY doc_id ORDER BY start)),
g AS (SELECT doc_id, start, 1 AS size, x AS phrase FROM two UNION ALL SELECT doc_id, start, 2, x || ' ' || y FROM two WHERE y IS NOT NULL UNION ALL SELECT doc_id, start, 3, x || ' ' || y || ' ' || z FROM two WHERE z IS NOT NULL),
p AS (SELECT DISTINCT doc_id, phrase, size FROM g WHERE start % 40 = 0 AND size = start % 3 + 1)
SELECT doc_id, phrase, count(*) AS n, CAST(min(start) AS INTEGER) AS first FROM g JOIN p USING (doc_id, phrase, size) GROUP BY ALL""")
def phrase_places(spark, sf_dir):
    """How often, and where first, each document holds phrases of one to three of its own words, taken at every 40th place."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("w"))
    cut = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(40)), lambda i: F.slice("w", i + 1, i % 3 + 1))
    taken = docs.select("doc_id", F.posexplode(cut).alias("k", "phrase")).where(F.size("phrase") == F.col("k") * 40 % 3 + 1)
    found = m.phrase_places(docs, taken, "doc_id", "w", "phrase")
    return found.groupBy("doc_id", F.array_join("phrase", " ").alias("phrase")).agg(F.count("*").alias("n"), F.min("start").alias("first"))


@query("SELECT c_nationkey::VARCHAR AS node, c_nationkey % 4 <> 0 AS success, CASE WHEN c_nationkey % 4 <> 0 THEN count(*) END AS rows, CASE WHEN c_nationkey % 4 <> 0 THEN sum(c_custkey)::BIGINT END AS keys FROM customer GROUP BY c_nationkey")
def node_events(spark, sf_dir):
    """A node for each nation's customers; every fourth one fails. The events as they were written aside."""
    rows, path, log = table(spark, sf_dir, "customer"), scratch_path(spark, "events"), NodeLog()
    for nation in [r[0] for r in rows.select("c_nationkey").distinct().collect()]:  # 25 at most
        with suppress(ArithmeticError), log.node(str(nation)) as count:
            own = rows.where(F.col("c_nationkey") == nation)
            if nation % 4 == 0:
                raise ArithmeticError(f"nation {nation}")
            count(own.select(F.col("c_custkey").alias("k")), keys=F.sum("k")).write.format("noop").mode("overwrite").save()
    log.write(spark, path)
    return spark.read.schema(EVENT).json(path).select("node", "success", "rows", F.col("metrics.keys").alias("keys"))


@query("""WITH s AS (SELECT event_id, [event_id % 7, event_id % 5 + 9, event_id % 3 + 20] AS st, event_id % 23 AS a FROM events),
d AS (SELECT event_id, list_sort(list_transform(st, lambda x: {'d': abs(2 * x + 2 - (2 * a + 1)), 's': x})) AS far FROM s)
SELECT event_id, CASE WHEN far[1].d <> far[2].d THEN CAST(far[1].s AS INTEGER) END AS nearest FROM d""")
def nearest_span(spark, sf_dir):
    """The one of three spans whose middle is nearest to an anchor's; null on a tie."""
    at = lambda c: F.struct(c.cast("int").alias("start"), (c + 2).cast("int").alias("end"))
    ev, a = F.col("event_id"), F.col("event_id") % 23
    found = m.choose_nearest(F.array(at(ev % 7), at(ev % 5 + 9), at(ev % 3 + 20)), F.array(F.struct(a.cast("int").alias("start"), (a + 1).cast("int").alias("end"))))
    return table(spark, sf_dir, "events").select("event_id", found["start"].alias("nearest"))


@query("""SELECT event_id, event_type || ' seen' AS signal, CASE WHEN event_id % 2 = 0 THEN 'data:image/png;<redacted>' ELSE '/img/' || user_id END AS safe,
CASE WHEN event_id % 2 = 0 THEN 'image/png' END AS mime, 'Text: ' || event_type || chr(10) || 'Image: ' || coalesce(props, '') AS summary FROM events""")
def image_references(spark, sf_dir):
    """What a perception summary says of the image, image references that are safe to log, and kinds of inline images."""
    ref = F.when(F.col("event_id") % 2 == 0, F.lit("data:image/png;base64,AAAA")).otherwise(F.concat(F.lit("/img/"), F.col("user_id").cast("string")))
    summary = F.concat(F.lit("Text: x\nimage:  "), F.col("event_type"), F.lit(" seen \nMore: y"))
    return table(spark, sf_dir, "events").select("event_id", text.image_signal(summary).alias("signal"), text.redact_reference(ref).alias("safe"), files.inline_mime(ref).alias("mime"), records.perception_summary(F.col("event_type"), F.col("props")).alias("summary"))


_LINES = "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_quantity) AS n, l_returnflag AS f, CAST(l_quantity AS INTEGER) AS q FROM lineitem"


def _items(spark, sf_dir):
    item = F.struct("l_linenumber", "l_returnflag", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return rows.select("l_orderkey", F.transform("x", lambda x: F.struct(x["l_returnflag"].alias("f"), x["l_quantity"].cast("int").alias("q"))).alias("x"))


@query(f"""SELECT l_orderkey, string_agg('example ' || n || chr(10) || 'f: ' || f || CASE WHEN q % 2 = 0 THEN chr(10) || 'q: ' || q ELSE '' END, chr(10) || chr(10) ORDER BY n) FILTER (n <= 2) AS examples,
string_agg('{{"f":"' || f || '","q":' || q || '}}', chr(10) ORDER BY n) AS lines FROM ({_LINES}) GROUP BY 1""")
def rendered_examples(spark, sf_dir):
    """The first two items of an order as numbered blocks, and all as JSON lines."""
    rows = _items(spark, sf_dir)
    shown = F.transform("x", lambda x: F.struct(x["f"].alias("f"), F.when(x["q"] % 2 == 0, x["q"]).alias("q")))
    return rows.select("l_orderkey", records.rendered_examples(shown, ["f", "q"]).alias("examples"), records.json_lines(F.col("x")).alias("lines"))


# rules ----------------------------------------------------------------------------------------------------------------


_ARGS = "[{'role': CASE WHEN event_id % 3 = 0 THEN 'Place' ELSE 'Person' END, 'label': CASE event_id % 5 WHEN 0 THEN 'street' WHEN 1 THEN '' ELSE 'hall' END, 'boxed': event_id % 2 = 0, 'open': event_id % 7 < 4}]"


def _events(spark, sf_dir):
    ev = F.col("event_id")
    image = F.struct(F.when(ev % 3 == 0, "Place").otherwise("Person").alias("role"), F.when(ev % 5 == 0, "street").when(ev % 5 == 1, "").otherwise("hall").alias("label"), F.when(ev % 2 == 0, F.array(*[F.lit(float(k)) for k in range(4)])).alias("bbox"), F.when(ev % 7 < 4, "unresolved").otherwise("grounded").alias("grounding_status"))
    kind = F.when(F.col("event_type") == "click", "Justice:Arrest-Jail").when(F.col("event_type") == "view", "Life:Die").otherwise(F.col("event_type"))
    span = F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"))
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", kind.alias("event_type"), F.when(ev % 4 != 0, F.struct(F.lit("seized").alias("text"), F.lit("text").alias("modality"), span.alias("span"))).alias("trigger"),
        F.array(F.struct(F.lit("Person").alias("role"), F.lit("man").alias("text"), span.alias("span"))).alias("text_arguments"), F.array(image).alias("image_arguments"), "props",
    )


_T = "CASE event_type WHEN 'click' THEN 'Justice:Arrest-Jail' WHEN 'view' THEN 'Life:Die' ELSE event_type END"


@query(f"""SELECT event_id, CASE WHEN t NOT IN ('Justice:Arrest-Jail', 'Life:Die') THEN 'unsupported event_type: ' || t WHEN t = 'Life:Die' THEN 'text role not allowed: Person' END AS error FROM (SELECT event_id, {_T} AS t FROM events)""")
def validation_errors(spark, sf_dir):
    return verify.validation_error(_events(spark, sf_dir)).select("event_id", "error")


@query(f"""WITH a AS (SELECT event_id, {_T} AS t, {_ARGS}[1] AS a FROM events)
SELECT event_id, NOT (t = 'Justice:Arrest-Jail' AND a.role = 'Place' AND a.label = 'street') AS kept, a.label <> '' AND NOT a.boxed AND a.open AS asked, CASE WHEN a.label <> '' AND NOT a.boxed AND a.open THEN a.role || ': ' || a.label END AS query FROM a""")
def weak_places_and_requests(spark, sf_dir):
    """Whether an image argument survives the filter of weak places, and the request for its box if it still lacks one."""
    rows = _events(spark, sf_dir)
    kept = verify.drop_weak_places(rows).select("event_id", (F.size("image_arguments") > 0).alias("kept"))
    wanted = rows.select("event_id", verify.grounding_requests(F.col("image_arguments")).alias("r"))
    return kept.join(wanted, "event_id").select("event_id", "kept", (F.size("r") > 0).alias("asked"), F.try_element_at("r", F.lit(1))["grounding_query"].alias("query"))


@query("""SELECT event_id, list_filter([event_type, CASE WHEN user_id % 2 = 0 THEN 'role: ' || event_type END, CASE WHEN user_id % 3 = 0 THEN 'k' END], lambda x: x IS NOT NULL) AS phrases FROM
(SELECT *, 1 FROM events) WHERE user_id % 2 <> 0 UNION ALL
SELECT event_id, list_filter(['role: ' || event_type, event_type, CASE WHEN user_id % 3 = 0 THEN 'k' END], lambda x: x IS NOT NULL) FROM events WHERE user_id % 2 = 0""")
def candidate_queries(spark, sf_dir):
    """Up to three phrases for a detector: parts between pipes and what follows a colon, each once whatever its case."""
    u = F.col("user_id")
    asked = F.concat(F.when(u % 2 == 0, "role: ").otherwise(""), F.col("event_type"), F.lit(" || "), F.upper("event_type"), F.when(u % 3 == 0, "|k").otherwise("| "))
    return table(spark, sf_dir, "events").select("event_id", verify.candidate_queries(asked).alias("phrases"))


@query(f"""WITH a AS (SELECT event_id, event_id % 4 <> 0 AS trig, {_T} AS t, {_ARGS}[1] AS a FROM events)
SELECT event_id::VARCHAR AS id, t AS event_type, CASE WHEN trig THEN 0 END AS start, CASE WHEN NOT a.open AND a.boxed THEN 1 ELSE 0 END AS images FROM a""")
def prediction_records(spark, sf_dir):
    """Flat prediction records: only grounded image arguments with a box survive."""
    rows = verify.prediction_record(_events(spark, sf_dir).withColumn("id", F.col("event_id").cast("string")))
    return rows.select("id", "prediction.event_type", F.col("prediction.trigger.start").alias("start"), F.size("prediction.image_arguments").alias("images"))


@query(f"""WITH a AS (SELECT event_id, {_ARGS}[1] AS a, user_id FROM events)
SELECT event_id, 2 AS requests, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS grounded, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 2 END AS failed, CASE WHEN a.open THEN 0 ELSE 1 END AS applied, CASE WHEN a.open THEN 1 ELSE 0 END AS unresolved FROM a""")
def grounding_activity(spark, sf_dir):
    one = lambda s: F.struct(s.alias("grounding_status"))
    results = F.array(one(F.lit("failed")), one(F.when(F.col("user_id") % 2 == 0, "grounded").otherwise("failed")))
    rows = _events(spark, sf_dir).withColumn("a", verify.grounding_activity(F.col("image_arguments"), results))
    return rows.select("event_id", "a.*")


@query(f"""WITH a AS (SELECT event_id, user_id, {_T} AS t, event_id % 4 <> 0 AS trig FROM events)
SELECT event_id, user_id % 2 = 0 AND trig OR user_id % 2 = 1 AS text, user_id % 3 = 0 AND event_id % 5 > 1 OR user_id % 3 = 1 AND event_id % 5 = 0 AS image, user_id % 5 = 0 AS grounding, user_id % 7 = 0 AS external FROM a""")
def support_flags(spark, sf_dir):
    """Which sources share words or boxes with an event: its text, the image's description, grounded results, evidence."""
    u = F.col("user_id")
    rows = _events(spark, sf_dir).withColumns({
        "text": F.when(u % 2 == 0, "They Seized it").otherwise("a MAN ran"), "image_desc": F.when(u % 3 == 0, "a big hall").when(u % 3 == 1, "the street"),
        "grounding_results": F.when(u % 5 == 0, F.array(F.struct(F.lit("grounded").alias("grounding_status")))), "evidence": F.array(F.struct(F.when(u % 7 == 0, "man found").otherwise("on it").alias("title"), F.lit("x").alias("snippet"))),
    })
    return records.support_flags(rows).select("event_id", "support.*")


@query(f"""SELECT event_id::VARCHAR AS sample_id, CASE WHEN user_id % 2 = 0 THEN 'open_world' ELSE 'benchmark' END AS run_mode, user_id % 2 = 0 AND user_id % 3 = 0 AS effective_search_enabled, {_T} AS stage_a_output, NULL::VARCHAR AS stage_b_output,
CASE WHEN user_id % 2 = 0 AND user_id % 3 = 0 THEN props END AS evidence FROM events""")
def trace_records(spark, sf_dir):
    """An audit row a sample, and evidence, which only open-world runs with search may see."""
    mode, on = F.when(F.col("user_id") % 2 == 0, "open_world").otherwise("benchmark"), F.col("user_id") % 3 == 0
    states = _events(spark, sf_dir).withColumn("id", F.col("event_id").cast("string")).withColumn("stage_a_output", F.col("event_type"))
    traces = records.trace_records(states, mode, on).select("sample_id", "run_mode", "effective_search_enabled", "stage_a_output", "stage_b_output")
    seen = states.select(F.col("id").alias("sample_id"), evidence.open_search_only(F.col("props"), mode, on).alias("evidence"))
    return traces.join(seen, "sample_id")


@query("SELECT 'o' || o_orderkey AS sample_id, o_orderkey % 13 <> 0 AS predicted, CASE WHEN o_orderkey % 13 <> 0 THEN CASE WHEN o_custkey % 5 = 0 THEN '' WHEN o_custkey % 5 = 1 THEN 'Contact:Meet' END END AS said, o_orderkey % 3 <> 0 AS traced, CASE WHEN o_orderkey % 6 = 0 THEN 7::BIGINT END AS metric FROM orders")
def samples_joined(spark, sf_dir):
    """Gold samples with their last prediction, trace and metrics."""
    gold, pred, traces = samples(spark, sf_dir)
    metrics = table(spark, sf_dir, "orders").where("o_orderkey % 6 = 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("sample_id"), F.lit(7).cast("long").alias("issue_count"))
    rows = errors.joined(gold, pred, traces, metrics)
    said = F.col("prediction_record.prediction.event_type")
    return rows.select("sample_id", F.col("prediction_record").isNotNull().alias("predicted"), F.when(said.isin("", "Contact:Meet"), said).alias("said"), F.col("trace").isNotNull().alias("traced"), F.col("metrics.issue_count").alias("metric"))


@query("""WITH p AS (SELECT *, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS pos, count(*) OVER () AS n FROM part),
e AS (SELECT p_partkey, unnest(range(pos, CAST(ceil(n / 48.0) * 48 AS BIGINT), n)) AS place FROM p) SELECT p_partkey, CAST(place // 48 AS BIGINT) AS batch FROM e""")
def ratio_batches_wrapped(spark, sf_dir):
    """Batches of 48 neighbours by size, the last one filled with the first rows again."""
    return ordering.batches(table(spark, sf_dir, "part").select("p_partkey", "p_size"), 48, "p_size", "p_partkey", wrap=True).select("p_partkey", "batch")


_MAPPED = "CASE raw WHEN 'click' THEN 'Justice:Arrest-Jail' WHEN 'view' THEN 'Life:Die' END"


@query(f"""WITH r AS (SELECT event_id, lower(event_type) AS raw, CASE WHEN user_id % 6 = 0 THEN '' ELSE 'word ' || user_id END AS body, CASE WHEN event_id % 9 = 0 THEN '' ELSE 'seized' END AS trig FROM events), t AS (SELECT *, {_MAPPED} AS t FROM r)
SELECT event_id::VARCHAR AS id, t AS event_type, CASE WHEN t IS NULL THEN 'unmapped_event_type:' || raw WHEN body = '' THEN 'missing_raw_text' WHEN trig = '' THEN 'missing_trigger' END AS skip_reason,
CASE WHEN t IS NOT NULL AND body <> '' AND trig <> '' THEN t || ' seized ' || body || ' ' || t || ' seized' || CASE t WHEN 'Life:Die' THEN ' Victim man Victim man' ELSE ' Person man Person man' END END AS retrieval_text FROM t""")
def text_examples_normalized(spark, sf_dir):
    """Text examples of flat events: types and roles mapped, skipped rows with their reason."""
    types = spark.createDataFrame([("ace2005", "CLICK", "Justice:Arrest-Jail"), ("ace2005", "view", "Life:Die")], "dataset string, raw_type string, event_type string")
    roles = spark.createDataFrame([("ace2005", "Justice:Arrest-Jail", "who", "Person"), ("ace2005", "Life:Die", "Who", "Victim"), ("ace2005", "Life:Die", "where", "Nowhere")], "dataset string, event_type string, raw_role string, role string")
    arg = "array<struct<role:string,text:string,span:struct<start:int,end:int>>>"
    args = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(t).alias("text"), F.lit(None).cast("struct<start:int,end:int>").alias("span")) for r, t in (("WHO", "man"), ("where", "x"), ("who", " "))]).cast(arg)
    flat = table(spark, sf_dir, "events").select(
        F.lit("d").alias("doc_id"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("raw_type"), F.when(F.col("user_id") % 6 == 0, "").otherwise(F.concat(F.lit("word "), F.col("user_id").cast("string"))).alias("text"),
        F.when(F.col("event_id") % 9 == 0, "").otherwise("seized").alias("trigger_text"), args.alias("arguments"),
    )
    out = corpus.normalize_text_events(flat, types, roles, "ace2005")
    return out.select("id", "event_type", "skip_reason", F.when(F.col("skip_reason").isNull(), F.col("retrieval_text")).alias("retrieval_text"))


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN ['trigger', 'image_arguments[1]'] ELSE ['trigger', 'text_arguments[0].span', 'image_arguments[1]'] END AS paths FROM events")
def repair_paths(spark, sf_dir):
    """Field paths to repair, each once, in order."""
    one = lambda p: F.struct(p.alias("field_path"), F.lit("x").alias("issue_type"), F.lit("y").alias("suggested_action"))
    found = F.array(one(F.lit("trigger")), one(F.when(F.col("user_id") % 2 == 0, "trigger").otherwise("text_arguments[0].span")), one(F.lit("image_arguments[1]")))
    return settle(table(spark, sf_dir, "events"), {"d": found}).select("event_id", verify.target_paths(F.col("d")).alias("paths"))
