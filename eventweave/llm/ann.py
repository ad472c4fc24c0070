"""Nearest neighbours by randomly rotated one-bit codes.

A vector of unit length is rotated at random and keeps the signs of its components: one bit for each dimension, with the scalar
``align``, the inner product of the rotated vector and its code. For a query q the inner product with the
code, divided by ``align``, estimates the cosine without bias, with an error of at most
``epsilon * sqrt((1 - align^2) / align^2 / (d - 1))`` but for a small chance. A rotated query is rounded to whole numbers of PLANES bits, so its inner product with a
code is a weighted sum of population counts of the code's words and the query's bit planes.

The search passes over the index twice. The first pass reads codes and scalars only, and gives the candidates with the best
estimates; their exact cosines make a bar for each query, below which its k nearest can't lie. The second pass reranks by exact cosine the candidates whose
upper bound reaches the bar. Candidates and queries are dealt into cells of a grid of bounded groups; a cell returns k rows for a query at most, and those are
merged by one aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventweave.llm.scratch import materialize, shuffle_partitions

#: Rows of a candidate group and of a query group, on average; bits of a rounded query; candidates of the first pass for each of the k asked for.
CANDIDATES, QUERIES, PLANES, FIRST = 16384, 1024, 6, 4


@lru_cache(maxsize=4)
def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def usable(column: str) -> F.Column:
    """Vectors that are not null, not zero, and hold only finite components."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long arrays as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def build_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 11) -> DataFrame:
    """The index: (vec_id, dims, embedding, code binary, align) for every usable vector. Nothing is fitted."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                v = matrix(part.column("embedding"))
                v /= np.abs(v).max(axis=1, keepdims=True)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                turned = v @ rotation(int(d), seed).T
                code = np.packbits(turned > 0, axis=1, bitorder="little")
                align = np.abs(turned).sum(axis=1) / math.sqrt(d)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("dims"), part.column("embedding"), pa.array([row.tobytes() for row in code], pa.binary()), pa.array(align)], ["vec_id", "dims", "embedding", "code", "align"])

    kept = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.size(vector_col).alias("dims"), F.col(vector_col).cast("array<double>").alias("embedding"))
    return kept.mapInArrow(encode, "vec_id long, dims int, embedding array<double>, code binary, align double")


class Codes:
    """Codes of a cell's candidates as 64-bit words, and the estimates of cosines with queries from them."""

    def __init__(self, codes: list[bytes], align: np.ndarray, dims: int, epsilon: float, seed: int):
        self.dims, self.seed = dims, seed
        width = -(-dims // 64) * 8
        packed = np.zeros((len(codes), width), np.uint8)
        packed[:, : -(-dims // 8)] = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        self.words = packed.view("<u8")
        self.ones = np.bitwise_count(self.words).sum(axis=1, dtype=np.int32)
        self.scale = 1 / (align * math.sqrt(dims))
        self.spread = np.maximum(0, 1 - align**2) / align**2 / max(1, dims - 1)
        self.epsilon = epsilon

    def estimates(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (rows) the estimated cosine of every candidate, and how far it may be off."""
        unit = queries / np.abs(queries).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        for q in unit @ rotation(self.dims, self.seed).T:
            low = q.min()
            step = max((q.max() - low) / ((1 << PLANES) - 1), 1e-12)
            whole = np.rint((q - low) / step).astype(np.uint8)
            inner = low * self.ones
            for k in range(PLANES):
                plane = np.zeros(self.words.shape[1] * 8, np.uint8)
                bits = np.packbits((whole >> k) & 1, bitorder="little")
                plane[: len(bits)] = bits
                inner += step * (1 << k) * np.bitwise_count(self.words & plane.view("<u8")).sum(axis=1, dtype=np.int32)
            # rounding spreads a component by step / sqrt(12), and as much the sum of all with signs over sqrt(dims)
            rounded = step * step / 12 * self.dims * self.scale**2
            yield (2 * inner - q.sum()) * self.scale, self.epsilon * np.sqrt(self.spread + rounded) + 1e-6


def _codes(cand: pa.Table, dims: int, epsilon: float, seed: int) -> Codes:
    return Codes(cand["code"].to_pylist(), cand["align"].to_numpy(), dims, epsilon, seed)


def best_estimates(cand: pa.Table, quer: pa.Table, n: int, epsilon: float, seed: int) -> pa.Table:
    """(query_id, vec_id, estimate) of the n candidates of a cell with each query's best estimates, by codes alone."""
    q = matrix(quer["embedding"].combine_chunks())
    codes, cid = _codes(cand, q.shape[1], epsilon, seed), cand["vec_id"].to_numpy()
    out = []
    for own, (guess, _) in zip(quer["vec_id"].to_numpy().tolist(), codes.estimates(q), strict=True):
        guess = np.where(cid == own, -np.inf, guess)
        top = np.argpartition(guess, -n)[-n:] if len(guess) > n else np.arange(len(guess))
        top = top[guess[top] > -np.inf]
        out.append((np.full(len(top), own), cid[top], guess[top]))
    return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], ["query_id", "vec_id", "estimate"])


def nearest_in_cell(cand: pa.Table, quer: pa.Table, k: int, epsilon: float, seed: int) -> tuple[pa.Table, int]:
    """(query_id, vec_id, score) of each query's k nearest candidates of a cell among those that its ``bar`` lets through, and how many were reranked."""
    q, c = (matrix(t["embedding"].combine_chunks()) for t in (quer, cand))
    codes, cid = _codes(cand, q.shape[1], epsilon, seed), cand["vec_id"].to_numpy()
    norm_c, out, reranked = np.sqrt((c * c).sum(axis=1)), [], 0
    for own, bar, v, (guess, slack) in zip(quer["vec_id"].to_numpy().tolist(), quer["bar"].to_numpy().tolist(), q, codes.estimates(q), strict=True):
        rows = np.flatnonzero((guess + slack >= bar) & (cid != own))
        reranked += len(rows)
        score = (c[rows] * v).sum(axis=1) / (norm_c[rows] * np.sqrt((v * v).sum()))
        order = np.lexsort((cid[rows], -score))[:k]
        out.append((np.full(len(order), own), cid[rows[order]], score[order]))
    return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"]), reranked


def search(index: DataFrame, queries: DataFrame, k: int = 5, epsilon: float = 1.9, seed: int = 11) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of each query's k nearest rows of the index by exact cosine; all if there are fewer.

    ``queries`` are rows of an index of the same seed. A query's own vec_id is no candidate; ties go to the smaller vec_id. Vectors are
    compared with those of the same length only. Null, zero and non-finite vectors and rows without an id are in no index. At least as many rows come back as the first pass has candidates for (FIRST * k), whatever
    epsilon is. Repeated rows of an id count as rows of their own; an empty table gives no rows. Nothing is broadcast: groups have bounded sizes at any scale.
    """
    spark = index.sparkSession
    n_cand, n_quer = index.count(), queries.count()
    cand_groups = max(-(-n_cand // CANDIDATES), min(shuffle_partitions(spark), -(-n_cand // 1024)), 1)
    query_groups = max(1, -(-n_quer // QUERIES))

    def cells(cand: DataFrame, quer: DataFrame, work, schema: str) -> DataFrame:
        g, h = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(cand_groups)).cast("int"), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(query_groups)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left, right = cand.select("*", g.alias("g"), every(query_groups).alias("h")), quer.select(*[F.col(c).alias(c) for c in quer.columns], every(cand_groups).alias("g"), h.alias("h"))
        names = [x.split()[0] for x in schema.split(", ")]
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), names[2]: pa.array([], pa.float64())})
        return left.groupBy("g", "h", "dims").cogroup(right.groupBy("g", "h", "dims")).applyInArrow(lambda a, b: work(a, b) if len(a) and len(b) else empty, schema)

    asked = queries.select("vec_id", "dims", "embedding")
    first = cells(index.select("vec_id", "dims", "code", "align"), asked, lambda a, b: best_estimates(a, b, FIRST * k, epsilon, seed), "query_id long, vec_id long, estimate double")
    likely = first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("estimate"), "vec_id"))).where(F.col("n") <= FIRST * k).select("query_id", "vec_id").distinct()
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x))
    cosine = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x) / (norm(F.col("u")) * norm(F.col("v")))
    vectors = index.select("vec_id", "dims", F.col("embedding").alias("v"))
    known = likely.join(vectors, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), "dims", F.col("embedding").alias("u")), ["query_id", "dims"])
    each = materialize(known.select("query_id", "vec_id", cosine.alias("s")).groupBy("query_id", "vec_id").agg(F.min("s").alias("s")), "first-pass")
    # the k-th best of some candidates is at most the k-th best of all
    bars = materialize(each.groupBy("query_id").agg(F.sort_array(F.collect_list("s"), False).alias("s")).select(F.col("query_id").alias("vec_id"), F.try_element_at("s", F.lit(k)).alias("bar")), "bars")
    barred = asked.join(bars, "vec_id", "left").select("vec_id", "dims", "embedding", (F.coalesce("bar", F.lit(-2.0)) - 1e-9).alias("bar"))
    found = materialize(cells(index, barred, lambda a, b: nearest_in_cell(a, b, k, epsilon, seed)[0], "query_id long, vec_id long, score double"), "second-pass")
    # the first pass's own scores count too, so that a query gets its rows whatever the bounds let through
    found = found.unionByName(each.join(found, ["query_id", "vec_id"], "left_anti").select("query_id", "vec_id", F.col("s").alias("score")))
    ordered = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Index all vectors and search for those that ``is_query`` (over the index's columns) picks."""
    index = materialize(build_codes(vectors, id_col, vector_col), "codes")
    return search(index, index.where(is_query), k)
