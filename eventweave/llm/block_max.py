"""Exact top-k by integer inner product, a block of documents at a time.

Components of a vector are its terms. Vectors are ordered so that alike ones stand together and cut into ranges of BLOCK; a block holds its vectors (the forward index) and each
term's largest and smallest value, from which sums over a query's terms bound every score in the block. A query takes blocks in the order of their bounds and stops at
the first bound below its k-th score.

Blocks form shards of bounded size, which have bounds of their own. A query is first answered in its most promising shard; its k-th score there is the bar
that other shards, then their blocks, have to reach. Queries travel to shards, so the index is moved once for each QUERIES queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventweave.llm.integers import LEAST, MOST, finite, pack, peak, stacked, whole
from eventweave.llm.scratch import materialize, shuffle_partitions

#: Vectors of a block; blocks that a query scores at first, four times as many at each further step.
BLOCK, STEP = 16, 4
#: Vectors and components of a shard at most, on average; queries that a shard meets at a time.
SHARD, COMPONENTS, QUERIES = 16384, 1 << 20, 8192
#: Queries and shards whose bounds are taken at a time.
ASKED, SUMMARIES = 1024, 256
#: Rows drawn (twice as many at most) to place the cuts that deal vectors to shards, and levels of cuts.
SAMPLE, LEVELS = 16384, 12

FOUND = "query long, query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(row, vec_id, dims, v) of usable vectors; ``row`` numbers them once they are stored."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            flat = column.flatten().to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(batch.column("dims").to_numpy())])
            packed = [pack(whole(flat[a:b], scale)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("dims"), pa.array(packed, pa.binary())], ["row", "vec_id", "dims", "v"])

    kept = vectors.where(finite(vector_col) & (F.size(vector_col) > 0) & F.col(id_col).isNotNull())
    named = kept.select(F.col(id_col).cast("long").alias("vec_id"), F.size(vector_col).alias("dims"), F.col(vector_col).cast("array<double>").alias("embedding"))
    return named.withColumn("row", F.monotonically_increasing_id()).mapInArrow(convert, "row long, vec_id long, dims int, v binary")


def halves(v: np.ndarray, levels: int) -> list[tuple[int, float]]:
    """Cuts (component, value) of a binary tree in the order of levels: at each node the widest component, at its median."""
    parts, cuts = [v.astype(np.float64)], []
    for _ in range(levels):
        parts, above = [], parts
        for part in above:
            spread = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(v.shape[1])
            axis = int(spread.argmax())
            at = float(np.median(part[:, axis])) if len(part) else 0.0
            cuts.append((axis, at))
            left = part[:, axis] <= at
            parts += [part[left], part[~left]]
    return cuts


def leaves(v: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    node, axes, at = np.zeros(len(v), np.int64), np.array([a for a, _ in cuts], np.int64), np.array([x for _, x in cuts])
    values, rows = v.astype(np.float64), np.arange(len(v))
    for _ in range(len(cuts).bit_length()):
        node = 2 * node + 1 + (values[rows, axes[node]] > at[node])
    return node - len(cuts)


def dealt(rows: DataFrame, n: int, size: int) -> DataFrame:
    """rows with (leaf, slice): vectors that the same cuts separate stand together, in as many slices as ``size`` vectors (or COMPONENTS components) each need."""
    levels = min(LEVELS, (max(1, -(-n // size)) - 1).bit_length())
    cuts, common = [], -1
    if levels:
        drawn = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < min(1.0, SAMPLE / n) * (1 << 30)).limit(2 * SAMPLE).select("dims", "v").collect()
        lengths = np.unique([r.dims for r in drawn], return_counts=True)
        if len(lengths[0]):
            common = int(lengths[0][lengths[1].argmax()])
            cuts = halves(stacked([r.v for r in drawn if r.dims == common], common), levels)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.zeros(len(batch), np.int32)
            same = np.flatnonzero(batch.column("dims").to_numpy() == common)
            if len(same) and cuts:
                leaf[same] = leaves(stacked(batch.column("v").take(pa.array(same)).to_pylist(), common), cuts)
            yield batch.append_column("leaf", pa.array(leaf))

    placed = rows.mapInArrow(place, "row long, vec_id long, dims int, v binary, leaf int")
    most = F.least(F.lit(size), F.greatest(F.lit(BLOCK), F.expr(f"{COMPONENTS} div dims")))
    # of such parts there are 2^LEVELS and one for each other length at most
    large = placed.groupBy("dims", "leaf").count().withColumn("slices", F.ceil(F.col("count") / most)).where("slices > 1").select("dims", "leaf", "slices")
    parts = placed.join(F.broadcast(large), ["dims", "leaf"], "left")
    return parts.withColumn("slice", F.coalesce(F.pmod(F.xxhash64("row"), F.col("slices")), F.lit(0)).cast("int")).drop("slices")


def ranges(v: np.ndarray) -> np.ndarray:
    """An order of the rows in which each run of BLOCK, from the first on, is narrow."""
    done, todo = [], [np.arange(len(v))]
    while todo:
        rows = todo.pop()
        if len(rows) <= BLOCK:
            done.append(rows)
            continue
        part = v[rows]
        axis = (part.max(axis=0) - part.min(axis=0)).argmax()
        middle = len(rows) // 2 // BLOCK * BLOCK or BLOCK
        order = np.argsort(part[:, axis], kind="stable")
        todo += [rows[order[middle:]], rows[order[:middle]]]
    return np.concatenate(done)


SHARDS = "dims int, leaf int, slice int, block int, ids binary, rows binary, forward binary, upper binary, lower binary"


def blocks_of(shard: pa.Table) -> pa.Table:
    """A row for each block of a shard, and one (block -1) with the bounds of all."""
    dims, leaf, part = (shard[c][0].as_py() for c in ("dims", "leaf", "slice"))
    v = stacked(shard["v"].to_pylist(), dims)
    order = ranges(v)
    v, ids, rows = v[order], shard["vec_id"].to_numpy()[order], shard["row"].to_numpy()[order]
    out = [(dims, leaf, part, -1, b"", b"", b"", pack(v.max(axis=0)), pack(v.min(axis=0)))]
    for block, a in enumerate(range(0, len(v), BLOCK)):
        part_v = v[a : a + BLOCK]
        out.append((dims, leaf, part, block, ids[a : a + BLOCK].tobytes(), rows[a : a + BLOCK].tobytes(), pack(part_v), pack(part_v.max(axis=0)), pack(part_v.min(axis=0))))
    kinds = [pa.int32()] * 4 + [pa.binary()] * 5
    return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in SHARDS.split(", ")])


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> tuple[DataFrame, DataFrame]:
    """(rows, shards), both stored: floor(scale * component) of every usable vector, and the blocks over them."""
    rows = materialize(quantized(vectors, id_col, vector_col, scale), "quantized")
    n = rows.count()
    size = min(SHARD, max(1024, -(-n // shuffle_partitions(rows.sparkSession))))
    return rows, materialize(dealt(rows, n, size).groupBy("dims", "leaf", "slice").applyInArrow(blocks_of, SHARDS), "blocks")


def exact_type(*arrays: np.ndarray) -> type:
    """A type in which inner products of rows of the arrays are exact."""
    if any(x.dtype == object for x in arrays):
        return object
    total = arrays[0].shape[-1] * np.prod([peak(x) for x in arrays], dtype=object)
    return np.float32 if total < 1 << 24 else np.float64 if total < 1 << 53 else object


def bounds_of(queries: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """For each query (rows) and block (columns) the largest score that the block can hold."""
    kind = exact_type(queries, np.maximum(np.abs(upper), np.abs(lower)))
    q, u, w = (x.astype(kind) for x in (queries, upper, lower))
    found = np.maximum(q, 0) @ u.T + np.minimum(q, 0) @ w.T
    return np.clip(found, LEAST, MOST) if kind is object else found


def search_shard(shard: pa.Table, asked: pa.Table, k: int) -> tuple[pa.Table, int]:
    """(query, query_id, vec_id, score) of each query's k best of a shard among those that reach its ``bar``, and how many vectors were scored."""
    shard = shard.filter(pa.compute.greater_equal(shard["block"], 0)).sort_by("block")
    dims = asked["dims"][0].as_py()
    queries = stacked(asked["v"].to_pylist(), dims)
    vectors, upper, lower = (stacked(shard[c].to_pylist(), dims) for c in ("forward", "upper", "lower"))
    ids, rows = (np.concatenate([np.frombuffer(x, np.int64) for x in shard[c].to_pylist()]) for c in ("ids", "rows"))
    kind = exact_type(queries, vectors)
    short = len(shard) * BLOCK - len(ids)
    forward = np.concatenate([vectors, np.zeros((short, vectors.shape[1]), vectors.dtype)]).astype(kind).reshape(len(shard), BLOCK, -1)
    ids, rows = (np.concatenate([x, np.full(short, -1)]).reshape(len(shard), BLOCK) for x in (ids, rows))
    out, scored = [], 0
    for row, own, bar, q, most in zip(asked["query"].to_pylist(), asked["query_id"].to_pylist(), asked["bar"].to_pylist(), queries.astype(kind), bounds_of(queries, upper, lower), strict=True):
        order = np.argsort(-most, kind="stable")
        best, at, step = [], 0, STEP
        while at < len(order) and (bar is None or most[order[at]] >= bar):
            take = order[at : at + step]
            take = take if bar is None else take[most[take] >= bar]
            score = forward[take].reshape(-1, forward.shape[2]) @ q
            score = np.clip(score, LEAST, MOST) if kind is object else score
            near, who = ids[take].ravel(), rows[take].ravel()
            keep = (who >= 0) & (who != row)
            keep = np.flatnonzero(keep if bar is None else keep & (score >= bar))
            scored += len(score)
            best = sorted(best + [(-int(score[i]), int(near[i]), int(who[i])) for i in keep])[:k]
            bar = -best[-1][0] if len(best) == k else bar
            at, step = at + step, step * 4
        out += [(row, own, v, -s) for s, v, _ in best]
    return pa.table([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 4)], ["query", "query_id", "vec_id", "score"]), scored


def search(rows: DataFrame, shards: DataFrame, is_query: F.Column, k: int = 5) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of the k rows with each query's largest inner products; all, if there are fewer.

    Queries are the ``rows`` that ``is_query`` picks; a query's own row is no candidate, another row of its id is. Ties go to the smaller vec_id. Vectors are compared
    with those of the same length only. Scores beyond a long are its ends. Repeated rows are rows of their own, as queries too.
    An empty table gives no rows.
    """
    spark = rows.sparkSession
    asked = rows.where(is_query).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "dims", "v")
    n_asked, n_shards = asked.count(), shards.where("block = -1").count()
    query_groups = max(-(-n_asked // ASKED), min(shuffle_partitions(spark), -(-n_asked // 128)), 1)
    shard_groups, turns = max(1, -(-n_shards // SUMMARIES)), max(1, -(-n_asked // QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt_by = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    summaries = shards.where("block = -1").select("dims", "leaf", "slice", "upper", "lower")

    def tables_of(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, pa.Table, pa.Table]:
        dims = a["dims"][0].as_py()
        q, upper, lower = (stacked(x.to_pylist(), dims) for x in (b["v"], a["upper"], a["lower"]))
        return bounds_of(q, upper, lower), a.select(["leaf", "slice"]), b

    def first_choice(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"query": pa.array([], pa.int64()), "bound": pa.array([], pa.int64()), "leaf": pa.array([], pa.int32()), "slice": pa.array([], pa.int32())})
        most, where, who = tables_of(a, b)
        at = most.argmax(axis=1)
        bound = pa.array([int(x) for x in most[np.arange(len(at)), at]], pa.int64())
        chosen = where.take(pa.array(at))
        return pa.table([who["query"], bound, chosen["leaf"], chosen["slice"]], ["query", "bound", "leaf", "slice"])

    def within_reach(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query", "query_id", "dims", "v", "bar", "leaf", "slice"]
        if not len(a) or not len(b):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32())], names)
        most, where, who = tables_of(a, b)
        bars = np.array([LEAST if x is None else x for x in who["bar"].to_pylist()], object if most.dtype == object else np.float64)
        reach = most >= bars[:, None]
        reach &= (np.array(who["leaf"])[:, None] != np.array(where["leaf"])) | (np.array(who["slice"])[:, None] != np.array(where["slice"]))
        q, s = np.nonzero(reach)
        return pa.table([*who.select(names[:5]).take(pa.array(q)).columns, *where.take(pa.array(s)).columns], names)

    def compared(queries: DataFrame, work, schema: str) -> DataFrame:
        left = summaries.withColumn("g", F.pmod(F.xxhash64("leaf", "slice"), F.lit(shard_groups)).cast("int")).withColumn("h", every(query_groups))
        right = queries.withColumn("h", dealt_by("query", query_groups)).withColumn("g", every(shard_groups))
        return left.groupBy("dims", "g", "h").cogroup(right.groupBy("dims", "g", "h")).applyInArrow(work, schema)

    def answered(queries: DataFrame) -> DataFrame:
        blocks = shards.where("block >= 0").withColumn("turn", every(turns))
        right = queries.withColumn("turn", dealt_by("query", turns))
        keys = ["dims", "leaf", "slice", "turn"]
        none = pa.table([pa.array([], pa.int64())] * 4, ["query", "query_id", "vec_id", "score"])
        return blocks.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: search_shard(a, b, k)[0] if len(a) and len(b) else none, FOUND)

    choice = compared(asked, first_choice, "query long, bound long, leaf int, slice int").groupBy("query").agg(F.max(F.struct("bound", "leaf", "slice")).alias("c"))
    chosen = materialize(asked.join(choice.select("query", "c.leaf", "c.slice"), "query"), "choices")
    first = materialize(answered(chosen.withColumn("bar", F.lit(None).cast("long"))), "first-found")
    bars = first.groupBy("query").agg(F.min("score").alias("bar"), F.count("*").alias("n")).where(F.col("n") >= k).select("query", "bar")
    reaching = compared(chosen.join(bars, "query", "left"), within_reach, "query long, query_id long, dims int, v binary, bar long, leaf int, slice int")
    found = first.unionByName(answered(reaching))
    ordered = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_products(vectors: DataFrame, is_query: F.Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Index all vectors and search for those that ``is_query`` (over vec_id) picks.

    Vectors that are null or hold null or non-finite components or none at all, and rows without an id, take no part; zero vectors do. Other columns may have any name."""
    rows, shards = build_index(vectors, id_col, vector_col, scale)
    return search(rows, shards, is_query, k)
