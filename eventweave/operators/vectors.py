"""Exact vector search: inner products, filters before ranking, merged indexes.

An index is a table (index_name, row, id, event_type, retrieval_text, embedding); the vector and its metadata share a row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def l2_normalize(v: Column) -> Column:
    """A vector of unit length; a zero vector stays as it is."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def truncate(v: Column, dims: int) -> Column:
    """The first dims components, of unit length."""
    return l2_normalize(F.slice(v, 1, dims))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def finite(v: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))


#: Rows of a corpus block and of a query block, on average, and of queries that are multiplied at once.
CORPUS_ROWS, QUERY_ROWS, STEP = 4096, 8192, 512


def _cell(k: int):
    """Each query's k best corpus rows of a block pair, by matrix products."""

    def best(corpus: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(corpus) and len(queries):
            rows = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
            ids, names, vectors, asked = corpus["id"].to_numpy(), queries["id"].to_numpy(), rows(corpus).T, rows(queries)
            for lo in range(0, len(asked), STEP):
                scores = asked[lo : lo + STEP] @ vectors
                bar = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
                q, c = np.nonzero(scores >= bar[:, None])
                order = np.lexsort((ids[c], -scores[q, c], q))
                q, c = q[order], c[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                q, c = q[keep], c[keep]
                found.append((names[lo + q], ids[c], scores[q, c]))
        return pa.table([np.concatenate(x) for x in zip(*found, strict=True)], ["query_id", "corpus_id", "score"])

    return best


def top_k(queries: DataFrame, corpus: DataFrame, k: int, query_id: str, corpus_id: str, query_vec: str, corpus_vec: str, where: Column | None = None) -> DataFrame:
    """(query_id, rank from 1, corpus_id, score): each query's k rows of the corpus with the largest inner products among those that
    pass ``where``, ties to the smaller id. Vectors that are null or hold null or non-finite components take no part on either side.

    The filter comes before the ranking and reaches the scan. Queries and corpus are dealt into blocks of bounded size; a pair of blocks is one
    matrix product that returns k rows a query at most, and one aggregation merges them. Nothing is broadcast or emitted pair by pair.
    """
    found = corpus if where is None else corpus.where(where)
    found = found.where(finite(F.col(corpus_vec))).select(F.col(corpus_id).cast("long").alias("id"), F.col(corpus_vec).cast("array<double>").alias("v"))
    asked = queries.where(finite(F.col(query_vec))).select(F.col(query_id).cast("long").alias("id"), F.col(query_vec).cast("array<double>").alias("v"))
    spread = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_corpus, n_queries = found.count(), asked.count()
    g, h = max(1, -(-n_corpus // CORPUS_ROWS), min(spread, -(-n_corpus // 256))), max(1, -(-n_queries // QUERY_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = found.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(g)).cast("int").alias("g"), every(h).alias("h"), F.size("v").alias("d"))
    right = asked.select("id", "v", every(g).alias("g"), F.pmod(F.xxhash64("id"), F.lit(h)).cast("int").alias("h"), F.size("v").alias("d"))
    hits = left.groupBy("g", "h", "d").cogroup(right.groupBy("g", "h", "d")).applyInArrow(_cell(k), "query_id long, corpus_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("corpus_id").alias(corpus_id), "score")


def post_filter(hits: DataFrame, where: Column) -> DataFrame:
    """A filter after ranking: fewer than k rows may be left, and ranks keep their gaps."""
    return hits.where(where)


def merge_hits(hits: list[DataFrame], k: int, tie: list[str]) -> DataFrame:
    """Hits (query_id, index_name, score, ...) of several indexes in one ranking of k a query, ranked anew."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *tie)
    both = reduce(DataFrame.unionByName, hits)
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def check_index(vectors: DataFrame, dims: int, expected: int | None = None) -> DataFrame:
    """One row of what is wrong with an index: rows, wrong lengths, non-finite components, and whether the count is as expected."""
    v = F.col("embedding")
    return vectors.agg(
        F.count("*").alias("rows"),
        F.count_if(F.coalesce(F.size(v), F.lit(-1)) != dims).alias("wrong_length"),
        F.count_if(~finite(v)).alias("not_finite"),
    ).withColumn("count_matches", F.lit(True) if expected is None else F.col("rows") == expected)


def with_metadata(hits: DataFrame, index_name: str) -> DataFrame:
    return hits.withColumn("retrieval", F.struct(F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"), F.lit(index_name).alias("index_name")))


def event_or_none(event_type: str) -> Column:
    """The demo layers' filter, for use after ranking: rows of a type or of none."""
    return F.coalesce(F.col("event_type"), F.lit("")).isin("", event_type)


#: How each layer of a layered retrieval composes its query from the text, the image description and the event type.
LAYERS = {"text": ("text", "image_desc"), "image": ("image_desc", "text"), "bridge": ("text", "image_desc")}


def layered_queries(states: DataFrame, event_type: str = "event_type") -> DataFrame:
    """states with one query string a layer."""
    out = states
    for layer, fields in LAYERS.items():
        parts = [F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("")) for c in (event_type, *fields) if c in states.columns]
        out = out.withColumn(f"{layer}_query", F.concat_ws(" ", *parts))
    return out


def retrieval_queries(states: DataFrame) -> DataFrame:
    """(query_id, event_type, text_query, image_query, bridge_query) of states (id, text, image_desc, event_type) for saved indexes.

    The text layer asks for the text alone, or else the type, or else the image; the image layer for text, image and type; the bridge for type, text and
    image. A state without any of them asks for nothing: its queries are null."""
    text, image, kind = (F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("")) for c in ("text", "image_desc", "event_type"))
    joined = lambda *parts: F.nullif(F.concat_ws(" ", *parts), F.lit(""))
    return states.select(F.col("id").alias("query_id"), F.coalesce(kind, F.lit("")).alias("event_type"), F.coalesce(text, kind, image).alias("text_query"), joined(text, image, kind).alias("image_query"), joined(kind, text, image).alias("bridge_query"))


#: The indexes that each layer searches, in the order in which their equal scores rank.
LAYER_INDEXES = {"text": ("ace_text", "maven_text"), "image": ("swig_text", "swig_image"), "bridge": ("bridge",)}


def _sized(rows: DataFrame, most: int, least: int, name: str) -> DataFrame:
    """(scope, name): into how many blocks each scope is dealt, of ``most`` rows at most; of ``least`` where that gives all the session's partitions work."""
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = F.count("*")
    return rows.groupBy("scope").agg(F.greatest(F.ceil(n / most), F.least(F.lit(spread), F.ceil(n / least))).cast("int").alias(name))


def scoped_top_k(queries: DataFrame, corpus: DataFrame, k: int, query_id: str, corpus_id: str, query_vec: str, corpus_vec: str, scope: str) -> DataFrame:
    """(query_id, rank from 1, corpus_id, score): like top_k(), each query among the rows of its own ``scope`` only; among all rows where its scope is null or empty.

    One search for all scopes: cells are keyed by scope and block, a row of the corpus is in its scope's cells and, if any query asks for all rows, in those of the whole corpus.
    Blocks are counted by aggregation, so a scope of any size has cells of bounded ones, and rows in scopes that nobody asks for go nowhere. A cell gives k rows a query at most;
    the window that merges them keeps k rows a query and task before it shuffles."""
    named = lambda df: F.nullif(F.trim(df[scope].cast("string")), F.lit(""))
    scoped = lambda c: F.concat(F.lit("="), c)
    asked = queries.where(finite(F.col(query_vec))).select(F.col(query_id).cast("long").alias("id"), F.coalesce(scoped(named(queries)), F.lit("*")).alias("scope"), F.col(query_vec).cast("array<double>").alias("v"))
    found = corpus.where(finite(F.col(corpus_vec))).select(F.col(corpus_id).cast("long").alias("id"), F.explode(F.array_compact(F.array(scoped(named(corpus)), F.lit("*")))).alias("scope"), F.col(corpus_vec).cast("array<double>").alias("v"))
    cells = _sized(found.select("scope"), CORPUS_ROWS, 256, "gs").join(_sized(asked.select("scope"), QUERY_ROWS, QUERY_ROWS, "hs"), "scope")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    size = F.size("v").alias("d")
    left = found.join(cells, "scope").select("id", "v", "scope", own("gs").alias("g"), every("hs").alias("h"), size)
    right = asked.join(cells, "scope").select("id", "v", "scope", every("gs").alias("g"), own("hs").alias("h"), size)
    hits = left.groupBy("scope", "g", "h", "d").cogroup(right.groupBy("scope", "g", "h", "d")).applyInArrow(_cell(k), "query_id long, corpus_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("corpus_id").alias(corpus_id), "score")


def typed_top_k(queries: DataFrame, index: DataFrame, name: str, k: int, id_col: str = "row") -> DataFrame:
    """Hits (query_id, index_name, row, score, rank) of one index, of each query's own event type; of all types where the query has none.

    The filter comes before the ranking. ``queries`` are (query_id, event_type, embedding)."""
    return scoped_top_k(queries, index, k, "query_id", id_col, "embedding", "embedding", "event_type").withColumn("index_name", F.lit(name))


def layered_retrieve(queries: dict[str, DataFrame], indexes: dict[str, DataFrame], k: dict[str, int] | int = 3) -> DataFrame:
    """(layer, query_id, rank, index_name, row, score): the k best hits of each layer, whose indexes are merged and ranked anew.

    ``queries`` has the encoded queries (query_id, event_type, embedding) of each index by its name, since image and text indexes take other encoders;
    indexes that don't exist or aren't asked give nothing. ``k`` by layer is at least 1."""
    out = []
    for layer, names in LAYER_INDEXES.items():
        n = max(1, (k.get(layer) or 3) if isinstance(k, dict) else k)
        parts = [typed_top_k(queries[name], indexes[name], name, n) for name in names if name in indexes and name in queries]
        if parts:
            order = F.element_at(F.create_map(*[F.lit(x) for pair in zip(names, range(len(names))) for x in pair]), F.col("index_name"))
            hits = merge_hits([x.withColumn("__order", order) for x in parts], n, ["__order", "row"]).drop("__order")
            out.append(hits.select(F.lit(layer).alias("layer"), "query_id", F.col("rank").cast("int").alias("rank"), "index_name", "row", "score"))
    if not out:
        raise ValueError("no index to search")
    return reduce(DataFrame.unionByName, out)


def layer_views(corpora: dict[str, DataFrame] | None, spark: SparkSession, prefix: str = "layer_") -> None:
    """The in-memory layers of a demo: a cached view for each corpus; None drops them all."""
    for layer in LAYERS:
        name = prefix + layer
        if spark.catalog.tableExists(name):
            spark.catalog.uncacheTable(name)
            spark.catalog.dropTempView(name)
        if corpora and layer in corpora:
            corpora[layer].createOrReplaceTempView(name)
            spark.catalog.cacheTable(name)


class IndexCache:
    """Saved indexes by configuration: one that has been loaded with the same settings isn't loaded again."""

    def __init__(self, load: Callable[..., DataFrame]):
        self.load, self.known = load, {}

    def get(self, spark: SparkSession, root: str, **settings: object) -> DataFrame:
        key = (root, *sorted(settings.items()))
        if key not in self.known:
            self.known[key] = self.load(spark, root)
        return self.known[key]
