"""Queries over the test tables, one or more for each operator, with equivalent SQL.

The tables hold no extracted events, so operators run on columns that stand for their inputs; every query covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventweave import ontology as o
from eventweave.functions import bbox, text
from eventweave.operators import corpus, evidence, flat, ordering, phrases, vectors
from eventweave.operators import matching as m
from eventweave.operators.scoring import precision_recall
from eventweave.plans.registry import query
from eventweave.plans.registry import table as _t

_WS = r"[\p{Z}\x09-\x0d\x1c-\x1f\x85]"
_TOKEN = r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?|[^\p{L}\p{N}_\p{Z}\x09-\x0d\x1c-\x1f\x85]"


def _clean(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"


# vectors -------------------------------------------------------------------------------------------------------------

_PAIRS = "SELECT q.vec_id AS query_id, c.vec_id, c.label, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)"


def _search(spark: SparkSession, sf_dir: str, k: int, where=None) -> DataFrame:
    rows = _t(spark, sf_dir, "embeddings")
    return vectors.top_k(rows.where("vec_id % 50 = 0"), rows, k, "vec_id", "vec_id", "embedding", "embedding", where)


@query(f"SELECT query_id, rank, vec_id, round(s, 6) AS score FROM (SELECT *, CAST({_RANK} AS INTEGER) AS rank FROM ({_PAIRS})) WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    return _search(spark, sf_dir, 10).withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, rank, vec_id, round(s, 6) AS score FROM (SELECT *, CAST({_RANK} AS INTEGER) AS rank FROM ({_PAIRS} AND c.label = 3)) WHERE rank <= 10")
def vector_topk_filtered(spark, sf_dir):
    return _search(spark, sf_dir, 10, F.col("label") == 3).withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, rank, vec_id, round(s, 6) AS score FROM (SELECT *, CAST({_RANK} AS INTEGER) AS rank FROM ({_PAIRS})) WHERE rank <= 10 AND label = 3")
def vector_postfilter_topk(spark, sf_dir):
    labels = _t(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = _search(spark, sf_dir, 10).join(labels, "vec_id")
    return vectors.post_filter(hits, F.col("label") == 3).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


_PARITY = "SELECT *, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS index_name"


@query(f"""
WITH pairs AS ({_PAIRS}), own AS ({_PARITY}, row_number() OVER (PARTITION BY query_id, label % 2 ORDER BY s DESC, vec_id) AS r FROM pairs WHERE label IS NOT NULL),
merged AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, index_name, vec_id) AS INTEGER) AS rank FROM own WHERE r <= 5)
SELECT query_id, rank, index_name, vec_id, round(s, 6) AS score FROM merged WHERE rank <= 5""")
def multi_index_merge(spark, sf_dir):
    parts = [_search(spark, sf_dir, 5, F.col("label") % 2 == r).withColumn("index_name", F.lit(name)) for r, name in ((0, "even"), (1, "odd"))]
    return vectors.merge_hits(parts, 5, ["index_name", "vec_id"]).select("query_id", "rank", "index_name", "vec_id", F.round("score", 6).alias("score"))


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, (embedding::DOUBLE[])[1:16] AS h FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS a, sqrt(list_dot_product(h, h)) AS b FROM v)
SELECT vec_id, list_transform(e, lambda x: floor(x / CASE WHEN a = 0 THEN 1 ELSE a END * 100000 + 0.5) / 100000) AS unit, list_transform(h, lambda x: floor(x / CASE WHEN b = 0 THEN 1 ELSE b END * 100000 + 0.5) / 100000) AS cut FROM n""")
def vector_normalize(spark, sf_dir):
    short = lambda v: F.transform(v, lambda x: F.floor(x * 100000 + 0.5) / 100000)
    return _t(spark, sf_dir, "embeddings").select("vec_id", short(vectors.l2_normalize(F.col("embedding"))).alias("unit"), short(vectors.truncate(F.col("embedding"), 16)).alias("cut"))


@query("""SELECT count(*) AS rows, count(*) FILTER (len(embedding) <> 64 OR vec_id % 7 = 0) AS wrong_length, count(*) FILTER (vec_id % 7 <> 0 AND vec_id % 11 = 0) AS not_finite,
count(*) = (SELECT count(*) FROM embeddings) AS count_matches FROM embeddings WHERE vec_id % 13 <> 0""")
def vector_index_check(spark, sf_dir):
    """An index in which some vectors are cut short, some hold a component that is no number, and some are missing."""
    rows = _t(spark, sf_dir, "embeddings")
    v = F.col("embedding").cast("array<double>")
    odd = F.when(F.col("vec_id") % 7 == 0, F.slice(v, 1, 32)).when(F.col("vec_id") % 11 == 0, F.concat(F.slice(v, 1, 63), F.array(F.lit(float("nan"))))).otherwise(v)
    return vectors.check_index(rows.where("vec_id % 13 != 0").select(odd.alias("embedding")), 64, rows.count())


# text ----------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({_clean('text')}) AS clean_md5, CASE WHEN length({_clean('text')}) > 120 THEN substring({_clean('text')}, 1, 120) || '...' ELSE {_clean('text')} END AS preview FROM documents")
def clean_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("clean_md5"), text.preview(F.col("text")).alias("preview"))


@query(f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '{_TOKEN.replace("'", "''")}')) AS INTEGER) AS n_tokens FROM documents""")
def token_count(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(text.tokenize(F.col("text"))).alias("n_tokens"))


@query("SELECT doc_id, CAST(len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 2))) AS INTEGER) AS n_content FROM documents")
def content_tokens(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(text.content_tokens(F.col("text"))).alias("n_content"))


@query(f"SELECT doc_id, md5(lang || ' ' || source || CASE WHEN {_clean('text')} = '' THEN '' ELSE ' ' || {_clean('text')} END) AS retrieval_md5 FROM documents")
def retrieval_text(spark, sf_dir):
    parts = [text.text_part(F.col(c)) for c in ("lang", "source", "text")]
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.retrieval_text(*parts)).alias("retrieval_md5"))


_PLAIN = _clean(f"regexp_replace({_clean('text')}, '[^\\p{{L}}\\p{{N}}_\\p{{Z}}\\x09-\\x0d\\x1c-\\x1f\\x85:/.\\-]', ' ', 'g')")


@query(f"SELECT item_id, array_to_string(string_split({_PLAIN}, ' ')[1:12], ' ') AS query FROM benchmark")
def search_query(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", text.rewrite_query(F.col("text")).alias("query"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_extract(spark, sf_dir):
    obj = text.json_object(F.col("props"))
    return _t(spark, sf_dir, "events").select("event_id", F.from_json(obj, "k int")["k"].alias("k"))


@query("SELECT DISTINCT d.doc_id, b.item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def benchmark_containment(spark, sf_dir):
    return phrases.containing(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


@query("""SELECT event_id, CASE WHEN age <= 3 THEN 1.0 WHEN age <= 14 THEN 0.7 WHEN age <= 60 THEN 0.3 ELSE 0.1 END::DOUBLE AS recency
FROM (SELECT event_id, greatest(0.0, date_diff('microsecond', date_trunc('second', ts), TIMESTAMP '2024-01-20 00:00:00') / 86400000000.0) AS age FROM events)""")
def recency(spark, sf_dir):
    as_text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return _t(spark, sf_dir, "events").select("event_id", text.recency_score(as_text, F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("recency"))


_LIST = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda t: length(t) > 2))"


@query(f"""
WITH n AS (SELECT count(*) AS n FROM benchmark), q AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS r, item_id AS query_id, text AS query FROM benchmark),
items AS (SELECT d.doc_id, q.query_id, q.query, d.lang || ' ' || d.source AS source, split_part(d.text, chr(10), 1) AS title, d.text AS snippet, (d.doc_id % 100) / 100.0 AS score,
  strftime(DATE '2024-01-01' + CAST(d.doc_id % 90 AS INTEGER), '%Y-%m-%d') AS published FROM documents d, n JOIN q ON d.doc_id % n.n = q.r),
toks AS (SELECT *, {_LIST.format('query')} AS q, {_LIST.format('source')} AS s, {_LIST.format('title')} AS t, {_LIST.format('snippet')} AS p FROM items),
joined AS (SELECT *, list_distinct(list_concat(t, p)) AS b FROM toks),
ranked AS (SELECT doc_id, query_id, score,
  0.35::DOUBLE * CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, b)) / len(q)::DOUBLE END + 0.25::DOUBLE * CASE WHEN len(s) = 0 THEN 0 ELSE len(list_intersect(s, b)) / len(s)::DOUBLE END
  + 0.15::DOUBLE * CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, t)) / len(q)::DOUBLE END + 0.15::DOUBLE * score
  + 0.10::DOUBLE * (CASE WHEN DATE '2024-03-31' - published::DATE <= 3 THEN 1.0 WHEN DATE '2024-03-31' - published::DATE <= 14 THEN 0.7 WHEN DATE '2024-03-31' - published::DATE <= 60 THEN 0.3 ELSE 0.1 END)::DOUBLE AS rank_score
  FROM joined WHERE len(list_intersect(q, b)) > 0 OR len(list_intersect(s, b)) > 0)
SELECT query_id, rank, doc_id, round(rank_score, 6) AS rank_score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, score DESC, doc_id) AS INTEGER) AS rank FROM ranked WHERE rank_score >= 0.18) WHERE rank <= 3""")
def evidence_rerank(spark, sf_dir):
    bench = _t(spark, sf_dir, "benchmark")
    n = bench.count()
    asked = ordering.dense_positions(bench, "item_id").select("position", F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = _t(spark, sf_dir, "documents").withColumn("position", F.col("doc_id") % n).join(asked, "position")
    published = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")), "yyyy-MM-dd")
    items = docs.select("doc_id", "query_id", "query", F.concat_ws(" ", "lang", "source").alias("source"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("snippet"), ((F.col("doc_id") % 100) / 100.0).alias("score"), published.alias("published_at"), F.col("doc_id").alias("_pos"))
    return evidence.rerank(items, F.lit("2024-03-31 00:00:00").cast("timestamp"), k=3).select("query_id", "rank", "doc_id", F.round("rank_score", 6).alias("rank_score"))


# ontology ------------------------------------------------------------------------------------------------------------

_TYPES = [("click", "Contact:Phone-Write"), ("purchase", "Transaction:Transfer-Money"), ("signup", "Contact:Meet"), ("view", "Movement:Transport")]
_MAP = ", ".join(f"('{a}', '{b}')" for a, b in _TYPES)


def _type_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("web", a.upper(), b) for a, b in _TYPES], "dataset string, raw_type string, event_type string")


@query(f"SELECT event_id, e.event_type AS raw_type, m.t AS event_type FROM events e LEFT JOIN (VALUES {_MAP}) m(r, t) ON lower(trim(e.event_type)) = m.r")
def ontology_map(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("raw_type"))
    return corpus.map_event_types(rows, _type_map(spark), "web").select("event_id", "raw_type", "event_type")


@query(f"SELECT 'unmapped_event_type:' || e.event_type AS skip_reason, count(*) AS n FROM events e LEFT JOIN (VALUES {_MAP}) m(r, t) ON e.event_type = m.r WHERE m.t IS NULL GROUP BY 1")
def skip_reasons(spark, sf_dir):
    rows = corpus.map_event_types(_t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("raw_type")), _type_map(spark), "web")
    reason = F.when(F.col("event_type").isNull(), text.skip_reason("unmapped_event_type", F.col("raw_type")))
    return corpus.skip_counts(rows.withColumn("skip_reason", reason))


@query(f"""SELECT event_id, m.t AS event_type, CASE WHEN m.t = 'Transaction:Transfer-Money' THEN ['Giver'] WHEN m.t = 'Contact:Meet' THEN ['Participant'] ELSE [] END AS roles
FROM events e LEFT JOIN (VALUES {_MAP}) m(r, t) ON e.event_type = m.r""")
def role_map_semi(spark, sf_dir):
    args = F.array(*[F.struct(F.lit(r).alias("role"), F.lit("x").alias("text")) for r in ("Payer", "Guest", "Nobody")])
    rows = _t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("raw_type"), args.alias("arguments"))
    roles = [("web", "Transaction:Transfer-Money", "payer", "Giver"), ("web", "Contact:Meet", "guest", "Participant"), ("web", "Contact:Meet", "nobody", "Giver"), ("web", "Movement:Transport", "guest", "Place")]
    role_map = spark.createDataFrame(roles, "dataset string, event_type string, raw_role string, role string")
    typed = corpus.map_event_types(rows, _type_map(spark), "web")
    return corpus.map_roles(typed, role_map, "web").select("event_id", "event_type", F.transform("arguments", lambda a: a["role"]).alias("roles"))


_KINDS = "CASE event_id % 9 WHEN 0 THEN 'Movement:Transport' WHEN 1 THEN 'Conflict:Attack' WHEN 2 THEN 'Conflict:Demonstrate' WHEN 3 THEN 'Justice:Arrest-Jail' WHEN 4 THEN 'Contact:Phone-Write' WHEN 5 THEN 'Contact:Meet' WHEN 6 THEN 'Life:Die' WHEN 7 THEN 'Transaction:Transfer-Money' ELSE event_type END"


@query(f"""WITH r AS (SELECT event_type, count(*) AS n_roles, count(*) FILTER (visibility = 'strong') AS strong FROM (VALUES
('Movement:Transport','strong'),('Movement:Transport','strong'),('Movement:Transport','weak'),('Movement:Transport','weak'),('Movement:Transport','weak'),
('Conflict:Attack','strong'),('Conflict:Attack','strong'),('Conflict:Attack','strong'),('Conflict:Attack','weak'),('Conflict:Demonstrate','strong'),('Conflict:Demonstrate','strong'),('Conflict:Demonstrate','strong'),('Conflict:Demonstrate','weak'),
('Justice:Arrest-Jail','strong'),('Justice:Arrest-Jail','strong'),('Justice:Arrest-Jail','strong'),('Justice:Arrest-Jail','weak'),('Contact:Phone-Write','strong'),('Contact:Phone-Write','weak'),('Contact:Phone-Write','weak'),
('Contact:Meet','strong'),('Contact:Meet','weak'),('Life:Die','strong'),('Life:Die','strong'),('Life:Die','weak'),('Life:Die','weak'),('Transaction:Transfer-Money','strong'),('Transaction:Transfer-Money','weak'),('Transaction:Transfer-Money','weak')) v(event_type, visibility) GROUP BY 1),
e AS (SELECT event_id, {_KINDS} AS event_type FROM events) SELECT e.event_type, count(*) AS events, sum(coalesce(n_roles, 0))::BIGINT AS roles, sum(coalesce(strong, 0))::BIGINT AS strong FROM e LEFT JOIN r USING (event_type) GROUP BY 1""")
def ontology_roles(spark, sf_dir):
    """How many roles events of each type may have, and how many of them images show well; none where the ontology doesn't know the type."""
    events = _t(spark, sf_dir, "events").select("event_id", F.expr(_KINDS).alias("event_type"))
    rows = events.join(o.event_roles(spark), "event_type", "left")
    return rows.groupBy("event_type").agg(F.count_distinct("event_id").alias("events"), F.count("role").alias("roles"), F.count_if(F.col("visibility") == "strong").alias("strong"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'Justice:Arrest-Jail' WHEN 'purchase' THEN 'Transaction:Transfer-Money' WHEN 'signup' THEN 'Contact:Phone-Write' WHEN 'view' THEN 'Life:Die' ELSE 'error' END AS canonical,
CASE event_type WHEN 'click' THEN 'Person' WHEN 'purchase' THEN 'Giver' ELSE 'Place' END AS role FROM events""")
def canonical_names(spark, sf_dir):
    raw = F.when(F.col("event_type") == "click", "justice arrestjail").when(F.col("event_type") == "purchase", "TransactionTransferMoney").when(F.col("event_type") == "signup", " Writing ").when(F.col("event_type") == "view", "life:die").otherwise(F.col("event_type"))
    role = F.when(F.col("event_type") == "click", "detainee").when(F.col("event_type") == "purchase", "Giver").otherwise("Place")
    return _t(spark, sf_dir, "events").select("event_id", o.canonical_type(raw).alias("canonical"), o.canonical_role(role).alias("role"))


# records -------------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, coalesce(role, text) AS first_present, coalesce(nullif(trim(role), ''), '(none)') AS role_or_none FROM conversations")
def alias_coalesce(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", corpus.first_present(rows, "speaker", "role", "text").alias("first_present"), F.coalesce(F.nullif(text.truthy(F.col("role")), F.lit("")), F.lit("(none)")).alias("role_or_none"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins_dedupe(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "user_id", "event_id", "event_type")
    return m.last_wins(rows, "key", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def first_wins_lookup(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.concat_ws("|", "user_id", "event_type").alias("key"))
    return m.first_wins(rows, "key", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_anti_join(spark, sf_dir):
    return m.pending(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels").select("doc_id"), key="doc_id")


@query("SELECT conv_id, list(role ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1")
def ordered_dedupe(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(ordering.ordered_distinct(F.col("role"), F.col("turn")).alias("roles"))


@query("SELECT conv_id || '::event::' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS id, conv_id, role AS raw_type, length(text) AS n_chars FROM conversations")
def turn_flatten(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    event = F.transform("t", lambda x: F.struct(x["role"].alias("type"), x["text"].alias("text"), F.array().cast("array<struct<type:string,text:string>>").alias("args")))
    flat = corpus.flatten_ace(turns.select(F.col("conv_id").cast("string").alias("doc_id"), F.lit("").alias("text"), event.alias("event"), F.lit(0).alias("_pos")), "train")
    raw = turns.select(F.col("conv_id").cast("string").alias("doc_id"), F.posexplode("t").alias("i", "x")).select(F.concat_ws("::", "doc_id", F.lit("event"), F.col("i").cast("string")).alias("id"), F.length("x.text").cast("long").alias("n_chars"))
    return flat.join(raw, "id").select("id", F.col("doc_id").cast("long").alias("conv_id"), "raw_type", "n_chars")


@query("SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_size, p_partkey) - 1) // 32 AS BIGINT) AS batch FROM part")
def ratio_batches(spark, sf_dir):
    return ordering.batches(_t(spark, sf_dir, "part").select("p_partkey", "p_size"), 32, "p_size", "p_partkey").select("p_partkey", "batch")


# scores --------------------------------------------------------------------------------------------------------------

_RATED = "SELECT l.doc_id, d.lang, d.source, l.quality = 1 AS gold, d.n_chars > 1000 AS pred, l.toxic FROM labels l JOIN documents d USING (doc_id)"
_PRF = "tp, pred, gold, CASE WHEN pred > 0 THEN tp / pred::DOUBLE ELSE 0 END AS precision, CASE WHEN gold > 0 THEN tp / gold::DOUBLE ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2.0 * tp / (pred + gold) ELSE 0 END AS f1"
_SUMS = "count(*) FILTER (gold AND pred) AS tp, count(*) FILTER (pred) AS pred, count(*) FILTER (gold) AS gold"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


def _prf_sql(by: str, group: str, where: str = "true") -> str:
    inner = f"SELECT {by} {_SUMS} FROM ({_RATED}) WHERE {where} {group}"
    names = by.replace("grouping(lang, source) AS ", "")
    return f"SELECT {names} tp, pred, gold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM (SELECT {names} {_PRF} FROM ({inner}))"


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("n_chars") > 1000).alias("p"))
    rows = _t(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("g"), "toxic").join(docs, "doc_id")
    return rows.withColumns({"tp": (F.col("g") & F.col("p")).cast("int"), "pred": F.col("p").cast("int"), "gold": F.col("g").cast("int")})


def _prf(grouped) -> DataFrame:
    sums = grouped.agg(*[F.sum(c).alias(c) for c in ("tp", "pred", "gold")])
    keep = [c for c in sums.columns if c not in ("tp", "pred", "gold")]
    return _rounded(sums.select(*keep, "tp", "pred", "gold", *precision_recall(F.col("tp"), F.col("pred"), F.col("gold"))))


@query(_prf_sql("", ""))
def prf_micro(spark, sf_dir):
    return _prf(_rated(spark, sf_dir).groupBy())


@query(_prf_sql("lang,", "GROUP BY lang"))
def prf_by_type(spark, sf_dir):
    return _prf(_rated(spark, sf_dir).groupBy("lang"))


@query(_prf_sql("lang,", "GROUP BY lang", "toxic = 0"))
def prf_gated(spark, sf_dir):
    return _prf(_rated(spark, sf_dir).where("toxic = 0").groupBy("lang"))


@query(_prf_sql("lang, source,", "GROUP BY GROUPING SETS ((), (lang), (lang, source))"))
def prf_grouping_sets(spark, sf_dir):
    return _prf(_rated(spark, sf_dir).groupingSets([[], ["lang"], ["lang", "source"]], "lang", "source"))


@query("""SELECT l_orderkey, CAST(sum(least(g, p)) AS BIGINT) AS tp FROM (SELECT l_orderkey, v, count(*) FILTER (s = 0) AS g, count(*) FILTER (s = 1) AS p FROM
(SELECT l_orderkey, l_returnflag AS v, 0 AS s FROM lineitem UNION ALL SELECT l_orderkey, CASE l_linestatus WHEN 'O' THEN 'N' ELSE 'A' END, 1 FROM lineitem) GROUP BY 1, 2) GROUP BY 1""")
def multiset_tp(spark, sf_dir):
    sides = F.array(F.struct(F.lit(flat.GOLD).alias("side"), F.col("l_returnflag").alias("v")), F.struct(F.lit(flat.PRED).alias("side"), F.when(F.col("l_linestatus") == "O", "N").otherwise("A").alias("v")))
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(sides).alias("i")).select("l_orderkey", "i.*")
    return flat.shared_counts(items, "l_orderkey", ["v"])


# boxes and spans: the lines of an order are gold boxes (odd numbers) and predicted ones (even numbers) --------------------------------

_BOXES = """boxes AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY line, role, x, y, x2) AS n FROM
  (SELECT l_orderkey, l_linenumber AS line, l_returnflag AS role, l_quantity AS x, floor(l_discount * 100) * 2 AS y, l_quantity + 20 + floor(l_tax * 100) AS x2, floor(l_discount * 100) * 2 + 15 AS y2 FROM lineitem)),
pairs AS (SELECT p.l_orderkey, p.n AS pred, g.n AS gold, p.role AS pred_role, g.role AS gold_role, greatest(0, least(p.x2, g.x2) - greatest(p.x, g.x)) * greatest(0, least(p.y2, g.y2) - greatest(p.y, g.y)) AS inter,
  (p.x2 - p.x) * 15.0 AS pa, (g.x2 - g.x) * 15.0 AS ga FROM boxes p JOIN boxes g ON p.l_orderkey = g.l_orderkey AND p.n % 2 = 0 AND g.n % 2 = 1),
scored AS (SELECT *, CASE WHEN inter > 0 THEN inter / (pa + ga - inter) ELSE 0 END AS iou FROM pairs)"""
_QUALITY = """CASE WHEN iou >= 0.5 THEN 'matched' WHEN iou <= 0 THEN 'no_overlap' WHEN iou < 0.2 THEN 'weak_overlap' WHEN inter / ga >= 0.8 AND inter / pa < 0.6 THEN 'box_not_precise_enough_oversized'
WHEN inter / pa >= 0.8 AND inter / ga < 0.6 THEN 'box_not_precise_enough_undersized' ELSE 'box_not_precise_enough_shifted' END"""


def _numbered(item):
    """A group's items in order, numbered from 1 (lines of an order repeat their numbers)."""
    return F.transform(F.array_sort(F.collect_list(item)), lambda x, i: x.withField("n", (i + 1).cast("long")))


def _corners() -> list:
    x, y = F.col("l_quantity"), F.floor(F.col("l_discount") * 100) * 2
    return [x, y.cast("double"), x + 20 + F.floor(F.col("l_tax") * 100), (y + 15).cast("double")]


def _orders_with_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.array(*_corners())
    item = F.struct(F.col("l_linenumber").alias("n"), F.lit("t").alias("event_type"), F.col("l_returnflag").alias("role"), F.col("l_returnflag").alias("raw_role"), box.alias("bbox"))
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(_numbered(item).alias("all"))
    return rows.select("l_orderkey", F.filter("all", lambda b: b["n"] % 2 == 1).alias("gold"), F.filter("all", lambda b: b["n"] % 2 == 0).alias("pred"))


def _box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = m.pairs_where(F.col("pred"), F.col("gold"), lambda p, g: F.lit(True), lambda p, g: F.struct(p["n"].alias("pred"), g["n"].alias("gold"), p["role"].alias("pred_role"), g["role"].alias("gold_role"), bbox.iou(p["bbox"], g["bbox"]).alias("iou"), bbox.box_quality(p["bbox"], g["bbox"], 0.5, 0.2, 0.8, 0.6).alias("quality")))
    return _orders_with_boxes(spark, sf_dir).select("l_orderkey", F.explode(made).alias("r")).select("l_orderkey", "r.*")


@query(f"WITH {_BOXES} SELECT l_orderkey, pred, gold, round(iou, 9) AS iou, {_QUALITY} AS quality FROM scored WHERE iou > 0.5 OR iou > 0 AND pred_role = gold_role")
def iou_pairs(spark, sf_dir):
    """Boxes that share some area, met in strips; judged pair by pair in plain columns."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "role", *flat.CORNERS)
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("role"), *[v.alias(c) for c, v in zip(flat.CORNERS, _corners(), strict=True)])
    numbered = lines.withColumn("n", F.row_number().over(order).cast("long"))
    boxes = numbered.withColumn("side", F.when(F.col("n") % 2 == 1, flat.GOLD).otherwise(flat.PRED))
    pairs = flat.overlapping_boxes(boxes, ["l_orderkey"], ["n", "role"]).where("iou > 0.5 or pred_role = gold_role")
    quality = bbox.judged(F.col("iou"), F.col("cover"), F.col("purity"), 0.5, 0.2, 0.8, 0.6)
    return pairs.select("l_orderkey", F.col("pred_n").alias("pred"), F.col("gold_n").alias("gold"), F.round("iou", 9).alias("iou"), quality.alias("quality"))


@query(f"WITH {_BOXES} SELECT l_orderkey, pred, gold FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, pred ORDER BY iou DESC, gold) AS r FROM scored WHERE pred_role = gold_role) WHERE r = 1")
def iou_best_match(spark, sf_dir):
    rows = _orders_with_boxes(spark, sf_dir).select("l_orderkey", "gold", F.explode("pred").alias("p"))
    return rows.select("l_orderkey", F.col("p.n").alias("pred"), m.best_box(F.col("p"), F.col("gold"), same_role=True)["n"].alias("gold")).where("gold is not null")


_SPANS = """spans AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_quantity) AS n, l_returnflag AS role,
  CAST(l_quantity AS INTEGER) AS s, CAST(l_quantity AS INTEGER) + 3 * l_linenumber AS e FROM lineitem),
near AS (SELECT g.l_orderkey, p.n AS pred, g.n AS gold, p.role = g.role AS same_role, p.s = g.s AND p.e = g.e AS same_span, p.s <= g.s AND p.e >= g.e AND (p.s < g.s OR p.e > g.e) AS longer
FROM spans p JOIN spans g ON p.l_orderkey = g.l_orderkey AND p.n % 2 = 0 AND g.n % 2 = 1 AND greatest(p.s, g.s) < least(p.e, g.e))"""


def _orders_with_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_quantity").cast("int")
    item = F.struct(F.col("l_linenumber").alias("n"), F.lit("t").alias("event_type"), F.lit(None).cast("int").alias("trigger_start"), F.lit(None).cast("int").alias("trigger_end"), F.col("l_returnflag").alias("role"), start.alias("start"), (start + 3 * F.col("l_linenumber")).alias("end"))
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(_numbered(item).alias("all"))
    return rows.select("l_orderkey", F.filter("all", lambda b: b["n"] % 2 == 1).alias("gold"), F.filter("all", lambda b: b["n"] % 2 == 0).alias("pred"))


@query(f"WITH {_SPANS} SELECT l_orderkey, pred, gold, same_role FROM near")
def span_overlap(spark, sf_dir):
    made = m.pairs_where(F.col("pred"), F.col("gold"), lambda p, g: m.same_trigger(g, p) & m.spans_overlap(g, p), lambda p, g: F.struct(p["n"].alias("pred"), g["n"].alias("gold"), (p["role"] == g["role"]).alias("same_role")))
    return _orders_with_spans(spark, sf_dir).select("l_orderkey", F.explode(made).alias("r")).select("l_orderkey", "r.*")


@query("SELECT event_id, concat_ws(' ', event_type, props, CAST(user_id AS VARCHAR)) AS text_query, concat_ws(' ', event_type, CAST(user_id AS VARCHAR), props) AS image_query FROM events")
def layered_query(spark, sf_dir):
    states = _t(spark, sf_dir, "events").select("event_id", "event_type", F.col("props").alias("text"), F.col("user_id").cast("string").alias("image_desc"))
    return vectors.layered_queries(states).select("event_id", "text_query", "image_query")
