"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweave.llm import ann, block_max, bpe, collocations, cover_tree, elias_fano, line_dedup, minhash, packing, quality, sharding, vector_codes, warc
from eventweave.llm.scratch import scratch_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text, decode it again, and return digests of both."""
    return bpe.encode_texts(table(spark, sf_dir, "documents"), BYTE_BPE, decode=True).select(
        "doc_id",
        F.expr("length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op2_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token files and read every document back from them."""
    manifest = elias_fano.write_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "token-files"), WORD_BPE)
    return elias_fano.read_tokens(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens, each with the corpus's mixture of sources."""
    queues = packing.queue_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)
    return packing.pack(queues, BYTE_BPE).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


@query
def op3_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every vec_id that 50 divides, among all vectors."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score")


@query
def op5_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal bytes."""
    sharded = sharding.shard_by_splitters(table(spark, sf_dir, "documents"), 40)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return sharded.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op10_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC bundles and read every record back."""
    index = warc.write_warc(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.read_warc(spark, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of all documents, by a model fitted on labelled ones."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.grades_of(table(spark, sf_dir, "labels")))
    return quality.score(docs, model).select("doc_id", "expected_grade", "tail_1", "tail_2", "selected")


@query
def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label that are at least 0.93 alike, and their components."""
    return cover_tree.threshold_links(table(spark, sf_dir, "embeddings"), 0.93)


@query
def op8_min_max_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents and their components."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 75, 5)


@query
def op9_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that stand on 10 sites or more; whole copies that hold no other lines are left to deduplication."""
    return line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"), 10, spare="copies").select("doc_id", "text", "n_lines", "n_removed")


ORACLE["op9_site_spread"] = r"""
WITH numbered AS (SELECT doc_id, text, source, row_number() OVER () AS row FROM documents),
split AS (SELECT row, source, string_split(text, chr(10)) AS lines FROM numbered),
placed AS (SELECT row, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
common AS (SELECT trim(line, ' ') AS line FROM placed WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10),
marked AS (SELECT p.row, p.pos, p.line, c.line IS NOT NULL AS common FROM placed p LEFT JOIN common c ON trim(p.line, ' ') = c.line),
rebuilt AS (
  SELECT row, count(*) AS n_lines, count(*) FILTER (common) AS n_common, count(*) FILTER (trim(line, ' ') <> '') AS n_full,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT common), '') AS kept
  FROM marked GROUP BY row),
copied AS (SELECT text FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT doc_id) + count(*) FILTER (doc_id IS NULL) > 1),
judged AS (SELECT n.doc_id, n.text, r.n_lines, r.kept, coalesce(r.n_common, 0) > 0 AND NOT (r.n_common = r.n_full AND c.text IS NOT NULL) AS act, r.n_common
  FROM numbered n LEFT JOIN rebuilt r USING (row) LEFT JOIN copied c ON n.text = c.text)
SELECT doc_id, CASE WHEN act THEN kept ELSE text END AS text, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(CASE WHEN act THEN n_common ELSE 0 END AS INTEGER) AS n_removed FROM judged
"""


@query
def op11_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 vectors with the largest integer inner products for every vec_id that 50 divides, among all vectors."""
    return block_max.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE["op11_block_max"] = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by 8 codebooks of 16 entries."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _codes_sql(rounds: int) -> str:
    """Each round's assignments (a0 onwards) and entries (c1 onwards), then the codes by the last entries."""
    near = """a{n} AS MATERIALIZED (SELECT vec_id, part, entry, d FROM (
      SELECT *, row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) AS i FROM (
        SELECT x.vec_id, x.part, c.entry, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{n} c USING (part, pos) GROUP BY ALL)) WHERE i = 1)"""
    move = """c{m} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (
      SELECT part, entry, pos, (s - ((s % n) + n) % n) // n AS x FROM (
        SELECT part, entry, pos, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM x JOIN a{n} USING (vec_id, part) GROUP BY ALL)) m USING (part, entry, pos))"""
    steps = [part.format(n=n, m=n + 1) for n in range(rounds) for part in (near, move)] + [near.format(n=rounds)]
    return f"""
WITH kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, (i - 1) // (size // 8) AS part, (i - 1) % (size // 8) AS pos, CAST(floor(4096 * CAST(embedding[i] AS DOUBLE)) AS HUGEINT) AS x
  FROM (SELECT vec_id, embedding, len(embedding) AS size, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
c0 AS MATERIALIZED (SELECT part, entry, pos, x FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id) WHERE entry < 16),
{", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


ORACLE["op12_vector_codes"] = _codes_sql(6)


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of 2 to 3 words by how far their parts belong together."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLE["op13_collocations"] = r"""
WITH lowered AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?
-]')) AS piece FROM lowered),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda w: w <> '') AS w FROM pieces),
placed AS (SELECT lang, w, len(w) AS size, unnest(range(1, len(w) + 1)) AS i FROM split),
found AS (SELECT lang, unnest(list_transform(range(1, least(3, size - i + 1) + 1), lambda m: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM placed),
counted AS MATERIALIZED (SELECT lang, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM found GROUP BY lang, phrase),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE len(w) = 1 GROUP BY lang),
cand AS (SELECT lang, phrase, w, f AS a FROM counted WHERE len(w) > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, w, a, unnest(range(1, len(w))) AS k FROM cand),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM scored) WHERE i = 1),
inside AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM cand WHERE len(w) = 3),
around AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY lang, phrase),
left_over AS (SELECT lowest.* FROM lowest LEFT JOIN around USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank FROM left_over)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
