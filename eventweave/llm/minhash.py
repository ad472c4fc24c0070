"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so 100 permutations
make 200 values with half the hash evaluations. 40 bands of 5 values propose candidates: a pair at the
threshold of 0.75 shares no band with a chance of 2e-5. Documents with equal shingle sets are one class from the start, and only its smallest
doc_id goes on.

Pairs of a bucket are never listed. First each member is compared with the bucket's smallest one, then in rounds those outside the
bucket's largest component with one of its members, the likeliest for each, while that links a tenth of them: work in proportion to
members, which gathers a bucket of mutual copies. Members that are still in another component than the bucket's largest are compared with all
others by blocks: by sketches first, and where these agree enough, on full sets within one task, which emits links between components only. So
no link that the bands propose is lost, and a bucket of n with few strays costs about n.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventweave.llm.graph import components, smallest_reached
from eventweave.llm.scratch import discard, materialize, small_batches
from eventweave.llm.textbuf import U64, mix, shingle_sets, text_chunks

PERMUTATIONS, BANDS, ROWS = 100, 40, 5
#: Rows of a block of a bucket, members that share a copy of their lead's text, and members of a part of a bucket, on average; rows and shingles of a block of texts.
BLOCK, CELL, SPREAD, TEXTS, SHINGLES = 512, 256, 1024, 256, 1 << 20
_rng = np.random.default_rng(8675309)
_SCALE = _rng.integers(0, 2**64, PERMUTATIONS, dtype=U64) | U64(1)
_SHIFT = _rng.integers(0, 2**64, PERMUTATIONS, dtype=U64)
_BAND = _rng.integers(0, 2**64, (BANDS, ROWS), dtype=U64) | U64(1)
_SALT = np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15)


def min_max(hashes: np.ndarray) -> np.ndarray:
    """Minimum and maximum of a set under each permutation, side by side."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, U64), np.zeros(PERMUTATIONS, U64)
    for lo in range(0, len(hashes), 512):
        moved = hashes[lo : lo + 512, None] * _SCALE + _SHIFT
        np.minimum(low, moved.min(axis=0), out=low)
        np.maximum(high, moved.max(axis=0), out=high)
    return np.stack([low, high], axis=1).ravel()


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One key for each band of each signature (rows)."""
    parts = mix(signatures).reshape(len(signatures), BANDS, ROWS)
    return mix((parts * _BAND).sum(axis=2, dtype=U64) + _SALT)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, sketch) of every row; empty sets have no digest and no bands. ``sketch`` has a byte of each value."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                sets = shingle_sets(part.column("text"), width)
                full = [k for k, s in enumerate(sets) if len(s)]
                table = np.stack([min_max(sets[k]) for k in full]) if full else np.zeros((0, 2 * PERMUTATIONS), U64)
                keys = band_keys(table).view(np.int64)
                bytes_ = (mix(table) & U64(255)).astype(np.uint8)
                digests, bands, sketches = [None] * len(sets), [[]] * len(sets), [None] * len(sets)
                for row, k in enumerate(full):
                    digests[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                    bands[k], sketches[k] = keys[row], bytes_[row].tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "digest", "bands", "sketch"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(sign, "doc_id long, n_shingles long, digest binary, bands array<bigint>, sketch binary")


def _floor(percent: int) -> float:
    """Agreeing values of which a pair at the threshold has fewer with a chance of 3e-7."""
    n, p = 2 * PERMUTATIONS, percent / 100
    return n * p - 5 * math.sqrt(n * p * (1 - p))


def likely(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches agree in as many bytes as a pair at the threshold does but for a chance of 3e-7, with that number as ``alike``."""
    n, floor, names = 2 * PERMUTATIONS, _floor(percent), pairs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, n) for c in ("x", "y"))
                alike = (x == y).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(alike, pa.int64())], [*names, "alike"]).filter(pa.array(alike >= floor))

    x, y = (signed.select(F.col("doc_id").alias(i), F.col("sketch").alias(s)) for i, s in (("a", "x"), ("b", "y")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.join(y, "b").join(x, "a").select(*names, "x", "y").mapInArrow(keep, f"{kinds}, alike long")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold, from rows (a, b, n): about n of them at most have that a.

    The members b of an a are dealt into cells of about CELL, and each cell gets the text of a once, before its members' texts.
    """

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leads = None, []
        for batch in batches:
            for part in text_chunks(batch, "text"):
                sets, found_a, found_b = shingle_sets(part.column("text"), width), [], []
                for a, cell, member, b, own in zip(*(part.column(c).to_pylist() for c in ("a", "cell", "member", "b")), sets, strict=True):
                    if at != (a, cell):
                        at, leads = (a, cell), []
                    if not member:
                        leads.append(own)
                    elif any(_reaches(lead, own, percent) for lead in leads):
                        found_a.append(a)
                        found_b.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    cells = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n") / F.lit(CELL), F.lit(1.0))))).cast("long")
    dealt = pairs.select("a", "b", (F.shiftleft(cells, 32) + F.pmod(F.xxhash64("b"), cells)).alias("cell"))
    leads = dealt.select("a", "cell").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "cell", F.lit(False).alias("member"), F.col("a").alias("b"), "text")
    members = dealt.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "cell", F.lit(True).alias("member"), "b", "text")
    rows = leads.unionByName(members).repartition("a", "cell").sortWithinPartitions("a", "cell", "member")
    return rows.mapInArrow(test, "a long, b long")


def _reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether the similarity of two sorted sets is at least percent / 100. Sizes alone may rule that out."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _by_cell(keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None]) -> Callable:
    """A mapInArrow function that gathers the rows of each cell, which follow each other, and gives them to work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in chain(batches, [None]):
            cuts = []
            if batch is not None:
                if not batch.num_rows:
                    continue
                names = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys], axis=1)
                cuts = (np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist()
                if at is not None and (names[0] != at).any():
                    cuts = [0, *cuts]
                at = names[-1]
            lo = 0
            for cut in cuts if batch is not None else [0]:
                if batch is not None and cut > lo:
                    held.append(batch.slice(lo, cut - lo))
                if held and (found := work(pa.Table.from_batches(held).combine_chunks())) is not None:
                    yield found
                held, lo = [], cut
            if batch is not None:
                held.append(batch.slice(lo))

    return run


def _cells(rows: DataFrame, group: str, blocks: str, strays: str, stray: str) -> DataFrame:
    """rows dealt into blocks of their group, repeated for each cell (lo, hi) of two blocks that has a block of strays: blocks 0 to ``strays`` - 1.

    ``blocks`` and ``strays`` name columns with the group's numbers of blocks of both kinds; ``stray`` says of which kind a row is.
    """
    own = F.when(F.col(stray), F.pmod(F.xxhash64("doc_id"), F.col(strays))).otherwise(F.col(strays) + F.pmod(F.xxhash64("doc_id"), F.greatest(F.col(blocks), F.lit(1))))
    dealt = rows.withColumn("block", own.cast("int"))
    last = F.when(F.col(stray), F.col(strays) + F.col(blocks) - 1).otherwise(F.col(strays) - 1)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))


def _likely_rows(cell: pa.Table, floor: float) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Pairs of rows of a cell that are in different components and whose sketches agree enough, as (row, row, agreeing bytes); and components and ids."""
    ids, comp, block = (cell[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "c", "block"))
    lo, hi = cell["lo"][0].as_py(), cell["hi"][0].as_py()
    sketch = np.frombuffer(b"".join(cell["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    found = []
    for k in range(0, len(left), 64):
        rows = left[k : k + 64]
        open_ = comp[rows][:, None] != comp[right][None, :]
        if lo == hi:
            open_ &= rows[:, None] < right[None, :]
        i, j = np.nonzero(open_)
        for m in range(0, len(i), 1 << 14):
            x, y = rows[i[m : m + (1 << 14)]], right[j[m : m + (1 << 14)]]
            alike = (sketch[x] == sketch[y]).sum(axis=1)
            hit = alike >= floor
            found.append((x[hit], y[hit], alike[hit]))
    return found, comp, ids


def likely_strays(at: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """(doc_id, c, label) of the members of buckets whose sketches agree enough with those of a member in another component.

    From rows (key, doc_id, c, stray, n_stray, n_main). Components that such pairs join, directly or through others of the same cell, have one label.
    """
    floor = _floor(percent)

    def compare(cell: pa.Table) -> pa.RecordBatch:
        found, comp, ids = _likely_rows(cell, floor)
        x, y = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
        names, number = np.unique(comp, return_inverse=True)
        label = names[smallest_reached(len(names), number[x], number[y])]
        rows = np.unique(np.concatenate([x, y]))
        return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(comp[rows]), pa.array(label[number[rows]])], ["doc_id", "c", "label"])

    blocks, strays = (F.ceil(F.col(n) / F.lit(BLOCK)).cast("int") for n in ("n_main", "n_stray"))
    rows = at.withColumn("blocks", blocks).withColumn("strays", strays).join(heads.select("doc_id", "sketch"), "doc_id")
    cells = _cells(rows, "key", "blocks", "strays", "stray").select("key", "lo", "hi", "block", "doc_id", "c", "sketch")
    return cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_by_cell(["key", "lo", "hi"], compare), "doc_id long, c long, label long")


def confirmed_in_groups(members: DataFrame, heads: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) that join the components of each group as all links between its members would, from rows (g, doc_id, c).

    A group's texts are dealt into blocks of bounded rows and shingles, and a task compares two blocks: the likeliest pairs first, on full
    sets, and only pairs whose components are not joined yet in that cell. All but the members of the largest component meet everyone.
    """
    floor = _floor(percent)

    def compare(cell: pa.Table) -> pa.RecordBatch:
        found, comp, ids = _likely_rows(cell, floor)
        x, y, alike = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1, 2))
        rows = np.unique(np.concatenate([x, y]))
        sets: dict[int, np.ndarray] = {}
        for part in text_chunks(pa.RecordBatch.from_arrays([cell["text"].combine_chunks().take(pa.array(rows)) if len(rows) else pa.array([], pa.string()), pa.array(rows)], ["text", "row"]), "text"):
            sets |= zip(part.column("row").to_pylist(), shingle_sets(part.column("text"), width), strict=True)
        above: dict[int, int] = {}

        def top(c: int) -> int:
            while (up := above.get(c, c)) != c:
                above[c] = above.get(up, up)
                c = up
            return c

        order = np.argsort(-alike, kind="stable")
        found_a, found_b = [], []
        for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
            p, q = top(int(comp[i])), top(int(comp[j]))
            if p != q and _reaches(sets[i], sets[j], percent):
                above[q] = p
                found_a.append(int(ids[i]))
                found_b.append(int(ids[j]))
        return pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    sized = members.join(heads.select("doc_id", "n_shingles", "sketch"), "doc_id")
    sums = sized.groupBy("g", "c").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    main = sums.groupBy("g").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.max(F.struct("n", "c"))["n"].alias("n_main"), F.max_by("s", F.struct("n", "c")).alias("s_main"), F.sum("n").alias("n"), F.sum("s").alias("s"))

    def blocks(n: F.Column, s: F.Column) -> F.Column:
        return F.greatest(F.ceil(n / F.lit(TEXTS)), F.ceil(s / F.lit(SHINGLES))).cast("int")

    main = main.select("g", "main", blocks(F.col("n_main"), F.col("s_main")).alias("blocks"), blocks(F.col("n") - F.col("n_main"), F.col("s") - F.col("s_main")).alias("strays"))
    rows = sized.join(main, "g").withColumn("stray", F.col("c") != F.col("main"))
    cells = _cells(rows, "g", "blocks", "strays", "stray").select("g", "lo", "hi", "block", "doc_id", "c", "sketch")
    full = cells.join(texts, "doc_id").repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi")
    return full.mapInArrow(_by_cell(["g", "lo", "hi"], compare), "a long, b long")


def _salted(members: DataFrame) -> DataFrame:
    """Members (key, doc_id, n) with ``salt``, which deals a bucket's into parts of about SPREAD."""
    return members.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.ceil(F.col("n") / F.lit(SPREAD)).cast("long")))


def _for_each_salt(buckets: DataFrame) -> DataFrame:
    """Rows (key, n) of buckets, one for each part."""
    return buckets.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.lit(SPREAD)).cast("long") - 1)))


def _open_buckets(members: DataFrame, reached: DataFrame) -> DataFrame:
    """Members (key, doc_id, n, c) of the buckets that hold several components."""
    at = members.join(reached.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("c"))
    several = at.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.max("n").alias("n")).where("x != y").select("key", "n")
    return materialize(_salted(at).join(_for_each_salt(several).drop("n"), ["key", "salt"], "left_semi").drop("salt"), "open-buckets")


def _leaders(at: DataFrame, turn: int) -> DataFrame:
    """at with its buckets' largest component ``main``, a member of it drawn by a hash, ``anchor``, and its number of members ``n_main``."""
    sums = at.groupBy("key", "c").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("h"), "doc_id"))["doc_id"].alias("anchor"), F.max("n").alias("n"))
    lead = sums.groupBy("key").agg(F.max(F.struct("m", "c", "anchor")).alias("x"), F.max("n").alias("n"))
    lead = _for_each_salt(lead.select("key", "n", F.col("x.c").alias("main"), F.col("x.anchor").alias("anchor"), F.col("x.m").alias("n_main"))).drop("n")
    return _salted(at).join(lead, ["key", "salt"]).drop("salt")


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Documents link when the Jaccard similarity of their sets of ``width``-word shingles is at least ``percent`` / 100; component_id is the
    smallest doc_id reached by links. Texts without words, null texts among them, link with nothing. Rows with a null doc_id link with
    nothing, have a null component_id and are kept. Rows that repeat a doc_id with other texts count as one document in links,
    but a text with the shingles of a smaller doc_id's counts as that one's. Very long texts are hashed whole, a block of shingles at a time. An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    signed = materialize(signatures(docs, id_col, text_col, width), "signatures")
    usable = signed.where("digest is not null and doc_id is not null")
    # rows of one digest have one shingle set, so one sketch and the same bands
    heads = materialize(usable.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch")).alias("x")).select("digest", "x.*"), "heads")

    in_bands = heads.select("doc_id", F.explode("bands").alias("key"))
    buckets = in_bands.groupBy("key").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n")).where("n > 1")
    members = materialize(in_bands.join(buckets, "key").select("key", "doc_id", "lead", "n"), "members")
    # a lead has at most BANDS buckets of n members
    first = members.where("doc_id != lead").groupBy(F.col("lead").alias("a"), F.col("doc_id").alias("b")).agg(F.max("n").alias("n"))
    links = materialize(confirmed(likely(first, heads, percent), texts, percent, width), "links")
    reached = components(links)
    at = _open_buckets(members.where("n > 2").select("key", "doc_id", "n"), reached)
    discard(members)

    def join_up(links: DataFrame) -> None:
        nonlocal reached, at
        reached = components(reached.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
        before, at = at, _open_buckets(at.select("key", "doc_id", "n"), reached)
        discard(before)

    for turn in count():
        # strays with a member of their bucket's largest component, each with the likeliest of its buckets'
        pairs = _leaders(at, turn).where("c != main").groupBy(F.col("anchor").alias("a"), F.col("doc_id").alias("b")).agg(F.max("n").alias("n"))
        best = likely(pairs, heads, percent).groupBy("b").agg(F.max_by(F.struct("a", "n"), F.struct("alike", "a")).alias("x")).select("x.a", "b", "x.n")
        best = materialize(best, "strays")
        tried = best.count()
        links = materialize(confirmed(best, texts, percent, width), "links") if tried else best.select("a", "b")
        linked = links.count() if tried else 0
        if linked:
            join_up(links)
        if linked * 10 < tried or not linked:
            break

    led = _leaders(at, 0).withColumns({"n_stray": F.col("n") - F.col("n_main"), "stray": F.col("c") != F.col("main")})
    rest = materialize(likely_strays(led, heads, percent), "likely-strays")
    if not rest.isEmpty():
        groups = components(rest.select(F.col("c").alias("a"), F.col("label").alias("b"))).withColumnRenamed("node", "c")
        grouped = rest.select("doc_id", "c").distinct().join(groups, "c", "left").select(F.coalesce("component", "c").alias("g"), "doc_id", "c")
        more = materialize(confirmed_in_groups(materialize(grouped, "stray-groups"), heads, texts, percent, width), "links")
        if not more.isEmpty():
            reached = components(reached.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    discard(at)

    named = heads.join(reached.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("digest", F.coalesce("component", "doc_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))
