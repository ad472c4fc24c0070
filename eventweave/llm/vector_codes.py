"""Vectors as a few bytes: each of several consecutive parts is replaced by the index of its nearest codebook entry.

Vectors become blocks of whole numbers stored by component, so a part's distances to all its entries accumulate component by component over whole columns. In every round
each block adds its parts to 64-bit sums and counts of the entries they are nearest to; RDD.treeAggregate merges those tensors, whose size depends on the codebooks alone, through a tree of
tasks, and the driver divides. Blocks are read from the shared folder in each round, so a lost executor costs its own tasks only.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from eventweave.llm.integers import LEAST, MOST, finite, peak, whole
from eventweave.llm.scratch import discard, materialize

#: Magnitudes below this are computed in 64 bits, others in Python's integers; and so many vectors' sums fit 64 bits.
SMALL, MANY = 1 << 24, 1 << 38

#: Codebooks of each vector length: for each part an array (entries, components).
Codebooks = dict[int, list[np.ndarray]]


def cuts(dims: int, parts: int) -> list[tuple[int, int]]:
    """Consecutive parts, equal if their number divides dims."""
    bounds = [i * dims // parts for i in range(parts + 1)]
    return list(zip(bounds[:-1], bounds[1:], strict=True))


def narrowed(values: np.ndarray) -> np.ndarray:
    """Small numbers as int64, others as Python's integers, with which sums and squares are exact."""
    return values.astype(np.int64) if peak(values) < SMALL else values.astype(object)


def columns_of(flat: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """Whole numbers by component (rows) and vector (columns)."""
    return narrowed(np.ascontiguousarray(whole(flat, scale).reshape(-1, dims).T))


def assign(block: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry of each column, ties to the lower, and the squared distance to it."""
    kind = np.int64 if block.dtype != object and entries.dtype != object else object
    total = np.zeros((len(entries), block.shape[1]), kind)
    for component, values in zip(block, entries.T, strict=True):
        off = component[None, :] - values[:, None]
        total += off * off
    code = total.argmin(axis=0)
    return code, total[code, np.arange(len(code))]


def tally(sums: dict, block: np.ndarray, books: Codebooks) -> dict:
    """Add a block's parts to the sums and counts of their nearest entries."""
    dims = len(block)
    if dims not in sums:
        sums[dims] = [(np.zeros(b.shape, np.int64), np.zeros(len(b), np.int64)) for b in books[dims]]
    for p, ((a, b), entries) in enumerate(zip(cuts(dims, len(books[dims])), books[dims], strict=True)):
        total, count = sums[dims][p]
        code, _ = assign(block[a:b], entries)
        if block.dtype == object or count.sum() > MANY:
            total = total.astype(object)
        np.add.at(total, code, block[a:b].T)
        np.add.at(count, code, 1)
        sums[dims][p] = total, count
    return sums


def merged(left: dict, right: dict) -> dict:
    for dims, tensors in right.items():
        if dims in left:
            many = any(a[1].sum() + b[1].sum() > MANY for a, b in zip(left[dims], tensors, strict=True))
            wide = (lambda x: x.astype(object)) if many else (lambda x: x)
            left[dims] = [(wide(a) + wide(c), b + d) for (a, b), (c, d) in zip(left[dims], tensors, strict=True)]
        else:
            left[dims] = tensors
    return left


def moved(books: Codebooks, sums: dict) -> Codebooks:
    """Each entry at the mean of its parts, rounded down; entries that nothing is nearest to stay."""
    out = {}
    for dims, entries in books.items():
        out[dims] = []
        for book, (total, count) in zip(entries, sums.get(dims, [(b, np.zeros(len(b), np.int64)) for b in entries]), strict=True):
            used = np.maximum(count, 1)[:, None]
            mean = total // (used.astype(object) if total.dtype == object else used)
            wide = object if object in (mean.dtype, book.dtype) else np.int64
            out[dims].append(narrowed(np.where((count > 0)[:, None], mean.astype(wide), book.astype(wide))))
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    kept = vectors.where(finite(vector_col))
    return kept.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.size(vector_col).alias("dims"), F.col(vector_col).cast("array<double>").alias("embedding"))


def _lengths(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """A batch's vectors length by length: the length, the rows and the components one after the other."""
    dims = batch.column("dims").to_numpy()
    for d in np.unique(dims).tolist():
        part = batch.filter(pa.array(dims == d))
        yield d, part, part.column("embedding").flatten().to_numpy(zero_copy_only=False)


def column_blocks(kept: DataFrame, scale: int) -> DataFrame:
    """(dims, n, small, block): whole numbers of the vectors of a batch, by component."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part, flat in _lengths(batch):
                block = columns_of(flat, d, scale) if d else np.zeros((0, len(part)), np.int64)
                small = block.dtype != object
                data = block.astype("<i4").tobytes() if small else pickle.dumps(block)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (d, len(part), small, data)], ["dims", "n", "small", "block"])

    return kept.select("dims", "embedding").mapInArrow(convert, "dims long, n long, small boolean, block binary")


def as_block(row: Row) -> np.ndarray:
    return np.frombuffer(row.block, "<i4").astype(np.int64).reshape(row.dims, row.n) if row.small else pickle.loads(bytes(row.block))


def train(kept: DataFrame, blocks: RDD, parts: int, entries: int, rounds: int, scale: int) -> Codebooks:
    """Codebooks of each vector length, from blocks of whole numbers and the vectors with the smallest ids."""
    smallest = Window.partitionBy("dims").orderBy(F.asc_nulls_last("vec_id"), "embedding")
    start = kept.select("vec_id", "dims", "embedding").withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= entries).orderBy("dims", "n").collect()
    books: Codebooks = {}
    for dims in {r.dims for r in start}:
        flat = np.array([x for r in start if r.dims == dims for x in r.embedding], np.float64)
        first = columns_of(flat, dims, scale).T if dims else np.zeros((sum(r.dims == 0 for r in start), 0), np.int64)
        books[dims] = [narrowed(first[:, a:b]) for a, b in cuts(dims, parts)]
    for _ in range(rounds):
        now = books
        books = moved(now, blocks.treeAggregate({}, lambda sums, block, now=now: tally(sums, block, now), merged))
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of the entries' components in decimal by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every usable vector.

    Components become floor(scale * x). A part's codebook starts as that part of the vectors with the smallest ids (fewer than ``entries``, if there are fewer vectors; rows that share an id
    go by their components; null ids come last) and takes ``rounds`` of moving each entry to the mean of the parts nearest to it, rounded down; unused entries stay. ``code`` has two hex digits a part (as many as 256 entries need).
    Vectors that are null or hold null or non-finite components are dropped. Vectors of each length have codebooks of their own, the driver holds one set a length; a length that
    ``parts`` doesn't divide is cut as evenly as it can be. ``label_error`` is the sum over equal labels, nulls together. Numbers beyond 64 bits are exact inside, and at the ends of a long in the result.
    Repeated rows are rows of their own. An empty table gives no rows. Other columns may have any name.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    kept = usable(vectors, id_col, vector_col, label_col)
    stored = materialize(column_blocks(kept, scale), "columns")
    books = train(kept, stored.rdd.map(as_block), parts, entries, rounds, scale)
    discard(stored)
    names = {dims: digest(own) for dims, own in books.items()}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part, flat in _lengths(batch):
                block = columns_of(flat, d, scale) if d else np.zeros((0, len(part)), np.int64)
                codes, errors = zip(*(assign(block[a:b], own) for (a, b), own in zip(cuts(d, parts), books[d], strict=True)), strict=True)
                text = [bytes(row).hex() for row in np.stack(codes, axis=1).astype(np.uint8)]
                error = [min(int(x), MOST) for x in sum(errors)]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(text), pa.array(error, pa.int64()), pa.array([names[d]] * len(part))], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    kinds = dict(kept.dtypes)
    coded = materialize(kept.mapInArrow(encode, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, codebooks_sha256 string"), "codes")
    return with_sums(coded).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


def with_sums(coded: DataFrame) -> DataFrame:
    """Stored rows with ``label_error``. Sums of labels with more than a thousandth of the rows are broadcast, a thousand at most, so that no label's rows meet in a task."""
    total = F.least(F.greatest(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LEAST)), F.lit(MOST)).cast("long")
    sums = coded.groupBy("label").agg(total.alias("sum"), F.count("*").alias("rows")).withColumnRenamed("label", "of")
    many = F.col("rows") > max(64, coded.count() // 1000)
    same = F.col("label").eqNullSafe(F.col("of"))
    marked = coded.join(F.broadcast(sums.where(many).select("of", F.col("sum").alias("label_error"))), same, "left").drop("of")
    rest = marked.where("label_error is null").drop("label_error").join(sums.where(~many).select("of", F.col("sum").alias("label_error")), same).drop("of")
    return rest.unionByName(marked.where("label_error is not null"))
