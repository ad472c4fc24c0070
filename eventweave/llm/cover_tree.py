"""Exact threshold pairs of embeddings by dual traversal of cover trees.

Vectors of a label are dealt to cells of near ones, and cells level by level into blocks of bounded size; each block gets a tree of
nested levels whose radii halve. Cells and blocks have covering radii too and are the tree's upper levels. Two nodes whose centres are further apart than their covering radii and the threshold distance hold no pair;
two nodes that lie within the threshold distance altogether hold nothing but pairs, which are counted without being listed. The same two bounds
apply to whole blocks first, so that only the block pairs between them are traversed. What remains is compared exactly.

On unit vectors a cosine of s is a distance of sqrt(2 - 2 s).
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventweave.llm.ann import matrix, usable
from eventweave.llm.graph import components, smallest_reached
from eventweave.llm.scratch import discard, materialize

#: Vectors in a block on average, pivots that a task holds at most, and rows of a part that share a copy of its pivots.
BLOCK_ROWS, PIVOTS, SPREAD = 1024, 4096, 1 << 16
#: Distances within this of a bound are left to the exact comparison.
SLACK = 1e-6
_DEPTH = 48


class CoverTree:
    """Nodes level by level: children of a node are contiguous, its points are contiguous in ``order``, and its centre is its first child's."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = np.asarray(vectors, np.float64)
        unit = self._unit()
        n = len(unit)
        self.order = np.arange(n)
        centre = [0]
        far = self._distance(unit, unit[0])
        radius, lo, hi, child = [float(far.max())], [0], [n], [(0, 0)]
        level, step = [0], max(float(far.max()), 1e-9)
        for depth in range(_DEPTH):
            step /= 2
            below: list[int] = []
            for node in level:
                if radius[node] == 0 or hi[node] - lo[node] == 1:
                    continue
                points = self.order[lo[node] : hi[node]]
                owner, seats = self._split(unit, points, centre[node], step if depth < _DEPTH - 1 else -1.0)
                by = np.argsort(owner, kind="stable")
                self.order[lo[node] : hi[node]] = points[by]
                ends = lo[node] + np.cumsum(np.bincount(owner, minlength=len(seats)))
                first = len(centre)
                for k, seat in enumerate(seats):
                    a = int(ends[k - 1]) if k else lo[node]
                    group = self.order[a : ends[k]]
                    same = bool((self.vectors[group] == self.vectors[seat]).all())
                    centre.append(seat)
                    radius.append(0.0 if same else float(self._distance(unit[group], unit[seat]).max()) + 1e-12)
                    lo.append(a)
                    hi.append(int(ends[k]))
                    child.append((0, 0))
                    below.append(len(centre) - 1)
                child[node] = (first, len(centre))
            level = below
            if not level:
                break
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.lo, self.hi, self.child = np.array(lo), np.array(hi), np.array(child)
        self._derive()

    def _unit(self) -> np.ndarray:
        unit = self.vectors / np.abs(self.vectors).max(axis=1, keepdims=True)
        return unit / np.linalg.norm(unit, axis=1, keepdims=True)

    def _derive(self) -> None:
        self.norm = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.seats = self._unit()[self.centre]

    def __getstate__(self) -> dict:
        """Vectors, as 32-bit floats where these are exact, and the nodes."""
        short = self.vectors.astype(np.float32)
        exact = bool((short == self.vectors).all())
        return {"vectors": short if exact else self.vectors, "radius": self.radius} | {k: getattr(self, k).astype(np.int32) for k in ("order", "centre", "lo", "hi", "child")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= {k: v.astype(np.float64 if k in ("vectors", "radius") else np.int64) for k, v in state.items()}
        self._derive()

    @staticmethod
    def _distance(points: np.ndarray, seat: np.ndarray) -> np.ndarray:
        delta = points - seat
        return np.sqrt((delta * delta).sum(axis=1))

    def _split(self, unit: np.ndarray, points: np.ndarray, seat: int, step: float) -> tuple[np.ndarray, list[int]]:
        """Seats of which every point is within step, the farthest point becoming the next; below 0 each point is a seat."""
        if step < 0:
            return np.arange(len(points)), points.tolist()
        seats = [seat]
        own = unit[points]
        best = self._distance(own, unit[seat])
        owner = np.zeros(len(points), np.int64)
        while (k := int(best.argmax())) >= 0 and best[k] > step:
            away = self._distance(own, own[k])
            closer = away < best
            owner[closer] = len(seats)
            best[closer] = away[closer]
            seats.append(int(points[k]))
        return owner, seats


def dual_traversal(a: CoverTree, b: CoverTree, cosine: float, itself: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each point of a and of b, and the component (0 ...) of each point of a and then b, among pairs with at least that cosine.

    With ``itself``, b is a: pairs of different points count once for each of them.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    gain_a, gain_b = np.zeros(len(a.order) + 1, np.int64), np.zeros(len(b.order) + 1, np.int64)
    shift = 0 if itself else len(a.order)
    left, right = [], []  # edges between places in a.order and (shifted) b.order

    def all_of(i: np.ndarray, j: np.ndarray) -> None:
        """Every point of a's nodes i links with every point of b's nodes j, pairwise."""
        na, nb = a.hi[i] - a.lo[i], b.hi[j] - b.lo[j]
        np.add.at(gain_a, a.lo[i], nb)
        np.add.at(gain_a, a.hi[i], -nb)
        if not itself:
            np.add.at(gain_b, b.lo[j], na)
            np.add.at(gain_b, b.hi[j], -na)
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            pa_, pb_ = np.arange(a.lo[x], a.hi[x]), shift + np.arange(b.lo[y], b.hi[y])
            left.extend((pa_, np.full(len(pb_), pa_[0])))
            right.extend((np.full(len(pa_), pb_[0]), pb_))

    def decide(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prune, count wholesale, compare leaves; returns the pairs that must be opened."""
        span = a.radius[i] + b.radius[j]
        near = d - span <= reach + SLACK
        i, j, d, span = i[near], j[near], d[near], span[near]
        whole = d + span <= reach - SLACK
        if whole.any():
            all_of(i[whole], j[whole])
        i, j, span = i[~whole], j[~whole], span[~whole]
        leaf = span == 0
        if leaf.any():
            x, y = i[leaf], j[leaf]
            va, vb = a.vectors[a.centre[x]], b.vectors[b.centre[y]]
            score = (va * vb).sum(axis=1) / (a.norm[a.centre[x]] * b.norm[b.centre[y]])
            hit = score >= cosine
            if hit.any():
                all_of(x[hit], y[hit])
        return i[~leaf], j[~leaf]

    def opened(t: CoverTree, node: int) -> np.ndarray:
        first, last = t.child[node]
        return np.arange(first, last) if last > first else np.array([node])

    root = np.zeros(1, np.int64)
    stack = [tuple(x) for x in zip(*map(np.ndarray.tolist, decide(root, root, np.sqrt(((a.seats[:1] - b.seats[:1]) ** 2).sum(axis=1)))), strict=True)]
    while stack:
        i, j = stack.pop()
        ci = opened(a, i) if a.radius[i] >= b.radius[j] else np.array([i])
        cj = opened(b, j) if b.radius[j] >= a.radius[i] else np.array([j])
        for k in range(0, len(ci), 512):
            rows = ci[k : k + 512]
            d = np.sqrt(np.maximum(0, 2 - 2 * (a.seats[rows] @ b.seats[cj].T)))
            x, y = np.nonzero(d - a.radius[rows][:, None] - b.radius[cj][None, :] <= reach + 1e-4)
            x, y = rows[x], cj[y]
            for m in range(0, len(x), 1 << 15):
                u, v = x[m : m + (1 << 15)], y[m : m + (1 << 15)]
                stack.extend(zip(*map(np.ndarray.tolist, decide(u, v, np.sqrt(((a.seats[u] - b.seats[v]) ** 2).sum(axis=1)))), strict=True))
    count_a, count_b = np.cumsum(gain_a)[:-1], np.cumsum(gain_b)[:-1]
    if itself:
        count_a = count_a - 1  # every point links with itself
    names = smallest_reached(shift + len(b.order), np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right]))
    back_a, back_b = np.empty(len(a.order), np.int64), np.empty(len(b.order), np.int64)
    back_a[a.order], back_b[b.order] = np.arange(len(a.order)), np.arange(len(b.order))
    return count_a[back_a], count_b[back_b], np.concatenate([names[back_a], names[shift + back_b]]) if not itself else names[back_a]


def _pivots(kept: DataFrame, rows: int) -> dict[tuple, np.ndarray]:
    """Sampled vectors by (label, dims): about one for each block, PIVOTS at most."""
    n = kept.count()
    rate = min(1 / rows, PIVOTS / 2 / max(1, n))
    drawn = kept.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 40)) < int(rate * (1 << 40))).select("label", "dims", "embedding").limit(PIVOTS).toArrow()
    found: dict[tuple, list] = {}
    for label, dims, vector in zip(drawn["label"].to_pylist(), drawn["dims"].to_pylist(), drawn["embedding"].to_pylist(), strict=True):
        found.setdefault((label, dims), []).append(vector)
    return {k: (m := np.array(sorted(v), np.float64)) / np.linalg.norm(m, axis=1, keepdims=True) for k, v in found.items()}


def _cells(kept: DataFrame, rows: int) -> DataFrame:
    """kept with ``cell``, stored: the nearest pivot of its label, -1 without any."""
    pivots = _pivots(kept, rows)

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims = batch.column("label").to_pylist(), batch.column("dims").to_pylist()
            near = np.full(batch.num_rows, -1, np.int64)
            groups: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(labels, dims, strict=True)):
                if key in pivots:
                    groups.setdefault(key, []).append(k)
            for key, at in groups.items():
                near[at] = (matrix(batch.column("embedding").take(pa.array(at))) @ pivots[key].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], [*batch.schema.names, "cell"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    return materialize(kept.mapInArrow(cell, kinds + ", cell long"), "cells")


def _divided(celled: DataFrame, rows: int) -> DataFrame:
    """celled with ``part``, the subdivision of its cell, level by level until parts have about ``rows`` rows.

    On each level parts of more than twice that many sample pivots of their own, PIVOTS at most, and deal their rows to the nearest one. A large part's rows are spread over tasks,
    each of which gets the pivots once, before the rows. Parts that pivots don't divide, since their vectors are all alike, are sliced by a hash.
    """
    by = ["label", "dims", "cell", "part"]
    kind = dict(celled.dtypes)["label"]
    now, level, before = celled.withColumn("part", F.lit(0).cast("long")), 0, None
    while True:
        sizes = now.groupBy(*by).agg(F.count("*").alias("size"))
        largest = sizes.agg(F.max("size")).first()[0] or 0
        sized = now.join(sizes, by)
        if largest <= 2 * rows or before is not None and largest > 0.9 * before:
            return sized.withColumn("slice", F.pmod(F.xxhash64("vec_id", F.lit(6)), F.ceil(F.col("size") / F.lit(2 * rows)).cast("long"))).drop("size")
        before, level = largest, level + 1
        spread = F.ceil(F.col("size") / F.lit(SPREAD)).cast("long")
        large = sized.where(F.col("size") > 2 * rows)
        chance = F.least(F.lit(1.0) / F.lit(rows), F.lit(float(PIVOTS)) / F.col("size"))
        drawn = large.where(F.pmod(F.xxhash64("vec_id", F.lit(100 + level)), F.lit(1 << 40)) < chance * F.lit(float(1 << 40)))
        pivots = drawn.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), spread - 1))).withColumn("member", F.lit(False))
        members = large.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(200 + level)), spread)).withColumn("member", F.lit(True))
        columns = [*by, "salt", "member", "vec_id", "embedding"]
        rows_ = pivots.select(columns).unionByName(members.select(columns)).repartition(*by, "salt").sortWithinPartitions(*by, "salt", "member", "vec_id")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, own = None, []
            for batch in batches:
                near = np.zeros(batch.num_rows, np.int64)
                keys = list(zip(*(batch.column(c).to_pylist() for c in (*by, "salt")), strict=True))
                member = batch.column("member").to_numpy(zero_copy_only=False)
                lo = 0
                while lo < len(keys):
                    hi = lo + 1
                    while hi < len(keys) and keys[hi] == keys[lo] and member[hi] == member[lo]:
                        hi += 1
                    part = matrix(batch.column("embedding").slice(lo, hi - lo))
                    if not member[lo]:
                        own = [*(own if at == keys[lo] else []), part / np.linalg.norm(part, axis=1, keepdims=True)]
                    elif at == keys[lo] and own:
                        near[lo:hi] = (part @ np.concatenate(own).T).argmax(axis=1)
                    at = keys[lo]
                    lo = hi
                names = ["label", "dims", "cell", "part", "vec_id", "embedding"]
                out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), pa.array(np.asarray(batch.column("part").to_numpy(zero_copy_only=False), np.int64) * PIVOTS + near), batch.column("vec_id"), batch.column("embedding")], names)
                yield out.filter(pa.array(member.astype(bool)))

        moved = rows_.mapInArrow(assign, f"label {kind}, dims int, cell long, part long, vec_id long, embedding array<double>")
        # a part of level n is a number of n digits to the base PIVOTS; those that stay go on with a 0
        stay = sized.where(F.col("size") <= 2 * rows).select("label", "dims", "cell", (F.col("part") * PIVOTS).alias("part"), "vec_id", "embedding")
        then = materialize(moved.unionByName(stay), "parts")
        if level > 1:
            discard(now)
        now = then


def _blocks(kept: DataFrame, rows: int) -> DataFrame:
    """A stored row for each block: (block, label, dims, cell, n, seat, radius, ids, tree)."""
    celled = _cells(kept, rows)
    dealt = _divided(celled, rows)

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        tree = CoverTree(matrix(table["embedding"].combine_chunks()))
        ids = table["vec_id"].to_pylist()
        own = {c: table[c].slice(0, 1) for c in ("label", "dims", "cell")}
        return pa.table(own | {"n": pa.array([len(ids)], pa.int64()), "seat": pa.array([tree.seats[0].tolist()], pa.list_(pa.float64())), "radius": [float(tree.radius[0])], "ids": pa.array([ids], pa.list_(pa.int64())), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    kind = dict(kept.dtypes)["label"]
    built = dealt.select("label", "dims", "cell", "part", "slice", "vec_id", "embedding").groupBy("label", "dims", "cell", "part", "slice").applyInArrow(build, f"label {kind}, dims int, cell long, n long, seat array<double>, radius double, ids array<bigint>, tree binary")
    # equal ids may stand in two blocks of different lengths or cells, so a block is known by a hash of all it holds
    out = materialize(built.withColumn("block", F.xxhash64("label", "dims", "ids", "tree")), "blocks")
    discard(celled)
    return out


def _apart(a: str, b: str) -> F.Column:
    """The distance of two seats."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def met_blocks(blocks: DataFrame, reach: float) -> DataFrame:
    """Pairs of blocks that may hold a pair within reach, and of a block with itself, each once: (block_x, block_y, n_x, n_y, first_x, first_y, whole).

    The top of the traversal: cells hold blocks and have covering radii of their own, PIVOTS cells at most, so pairs of cells are pruned first, and only cells that meet have their blocks
    compared, dealt by cell. ``whole``: all pairs of both are within reach.
    """
    heads = blocks.select("block", "label", "dims", "cell", "n", "seat", "radius", F.col("ids")[0].alias("first"))
    by = ["label", "dims", "cell"]
    centres = heads.groupBy(*by).agg(F.min_by("seat", "block").alias("centre"))
    balls = heads.join(centres, by).groupBy(*by).agg(F.first("centre").alias("centre"), F.max(_apart("centre", "seat") + F.col("radius")).alias("ball"))
    side = lambda df, names, c: df.select("label", "dims", *[F.col(n).alias(f"{n}_{c}") for n in names])
    cells = side(balls, ("cell", "centre", "ball"), "x").join(side(balls, ("cell", "centre", "ball"), "y"), ["label", "dims"]).where("cell_x <= cell_y")
    cells = materialize(cells.where(_apart("centre_x", "centre_y") - F.col("ball_x") - F.col("ball_y") <= reach + SLACK).select("label", "dims", "cell_x", "cell_y"), "cell-pairs")
    names = ("cell", "block", "n", "seat", "radius", "first")
    x, y = side(heads, names, "x"), side(heads, names, "y")
    pairs = cells.join(x, ["label", "dims", "cell_x"]).join(y, ["label", "dims", "cell_y"]).where("cell_x < cell_y or block_x <= block_y")
    span = F.col("radius_x") + F.col("radius_y")
    met = pairs.withColumn("apart", _apart("seat_x", "seat_y")).where(F.col("apart") - span <= reach + SLACK)
    return materialize(met.select("block_x", "block_y", "n_x", "n_y", "first_x", "first_y", (F.col("apart") + span <= reach - SLACK).alias("whole")), "block-pairs")


def threshold_links(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links are pairs of equal, non-null label with at least that cosine.

    Null and zero vectors, vectors with null or non-finite components and rows with a null label or id link with nothing; a null id has a null component and is
    kept. Vectors of different lengths never link. Rows that repeat an id count as vectors of their own that link with each other if near, and share their sums. An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    named = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("embedding"), vectors[label_col].alias("label"))
    kept = named.where(usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", "label", F.size("embedding").alias("dims"), "embedding")
    blocks = _blocks(kept, rows)
    met = met_blocks(blocks, math.sqrt(max(0.0, 2 - 2 * cosine)))

    # block pairs within reach altogether: counts and edges by block
    whole = met.where("whole")
    sides = whole.select(F.col("block_x").alias("block"), (F.col("n_y") - F.when(F.col("block_x") == F.col("block_y"), 1).otherwise(0)).alias("links"), F.col("first_y").alias("root"))
    sides = sides.unionByName(whole.where("block_x != block_y").select(F.col("block_y").alias("block"), F.col("n_x").alias("links"), F.col("first_x").alias("root")))
    sides = sides.groupBy("block").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("root").alias("other"))
    bulk = blocks.select("block", F.explode("ids").alias("vec_id")).join(sides, "block").select("vec_id", "links", "root")
    joined_roots = whole.select(F.col("first_x").alias("a"), F.col("first_y").alias("b"))

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("block_x", "block_y", "ids_x", "ids_y")}
                itself = row["block_x"] == row["block_y"]
                a = pickle.loads(batch.column("tree_x")[k].as_buffer())
                b = a if itself else pickle.loads(batch.column("tree_y")[k].as_buffer())
                links_a, links_b, names = dual_traversal(a, b, cosine, itself)
                ids = np.array(row["ids_x"] if itself else row["ids_x"] + row["ids_y"], np.int64)
                links = links_a if itself else np.concatenate([links_a, links_b])
                least = np.full(len(ids), np.iinfo(np.int64).max)
                np.minimum.at(least, names, ids)
                hit = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(least[names][hit])], ["vec_id", "links", "root"])

    # dealt by either block in turn: the second shuffle spreads the pairs over tasks
    x, y = (blocks.select(F.col("block").alias(f"block_{c}"), F.col("ids").alias(f"ids_{c}"), F.col("tree").alias(f"tree_{c}")).hint("merge") for c in "xy")
    full = met.where("not whole").select("block_x", "block_y").join(x, "block_x").join(y, "block_y")
    found = materialize(full.select("block_x", "block_y", "ids_x", "ids_y", "tree_x", "tree_y").mapInArrow(traverse, "vec_id long, links long, root long").unionByName(bulk), "links")
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    reached = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).unionByName(joined_roots))
    out = named.select("vec_id").join(counts, "vec_id", "left").join(reached.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
