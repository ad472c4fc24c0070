"""Token files: one id array per file, document boundaries in Elias-Fano form.

A non-decreasing sequence of n values below u keeps ``l = log2(u / n)`` low bits of each value packed side by side, and
the high parts in unary: one bit per value in a vector of n + (u >> l) bits. Positions of every 512th one are
sampled as 32-bit numbers, so value i is found by a jump, a popcount scan within that range and one packed read.
That is about l + 2 bits a document instead of 64.

File layout: ids (2 or 4 bytes each, little-endian), the sequence of document ends, the sequence of document
numbers less the smallest, and a footer of fixed size that gives the lengths of these parts.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventweave.llm.pretokens import id_width, library_encoder
from eventweave.llm.scratch import filesystem, materialize, small_batches
from eventweave.llm.textbuf import binary_cells, text_chunks

SELECT_STEP = 512
_MAGIC = b"EFTOKEN1"
_FOOTER = struct.Struct("<IIQQqQQQ8s")
_HEAD = struct.Struct("<QQI")
#: Ids read from a file at once, unless one document has more.
READ_IDS = 1 << 20


class EliasFano:
    """A non-decreasing sequence of integers >= 0 with random access."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n == 0:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        if (values[1:] < values[:-1]).any():
            raise ValueError("values must not decrease")
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        bits = np.empty((n, low_bits), np.uint8)
        for k in range(low_bits):
            bits[:, k] = (values >> np.uint64(k)) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros(-(-(int(ones[-1]) + 1) // 64) * 64, np.uint8)
        upper[ones] = 1
        return cls(n, low_bits, np.packbits(bits.ravel(), bitorder="little"), np.packbits(upper, bitorder="little"), ones[::SELECT_STEP].astype(np.uint32))

    def select(self, i: int) -> int:
        """The position of one number i in the upper bits."""
        at, left = int(self.samples[i // SELECT_STEP]), i % SELECT_STEP
        words = self.high.view("<u8")
        w = at >> 6
        word = int(words[w]) >> (at & 63) << (at & 63)
        while (count := word.bit_count()) <= left:
            left -= count
            w += 1
            word = int(words[w])
        for _ in range(left):
            word &= word - 1
        return (w << 6) + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        bit = i * self.low_bits
        raw = int.from_bytes(self.low[bit >> 3 : (bit + self.low_bits + 7) >> 3].tobytes(), "little")
        return (self.select(i) - i << self.low_bits) | (raw >> (bit & 7)) & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        """All values, in order."""
        if self.n == 0:
            return np.zeros(0, np.uint64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        for k in range(self.low_bits):
            out |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return out

    def span(self, lo: int, hi: int) -> np.ndarray:
        """Values number lo up to hi, decoded between the selects of the first and the last."""
        if not 0 <= lo <= hi <= self.n:
            raise IndexError((lo, hi))
        if lo == hi:
            return np.zeros(0, np.uint64)
        first, last = self.select(lo), self.select(hi - 1)
        ones = np.flatnonzero(np.unpackbits(self.high[first >> 3 : (last >> 3) + 1], bitorder="little")) + (first >> 3 << 3)
        ones = ones[(ones >= first) & (ones <= last)]
        if len(ones) != hi - lo:
            raise ValueError("select samples don't fit the upper bits")
        out = (ones - np.arange(lo, hi)).astype(np.uint64) << np.uint64(self.low_bits)
        bit = lo * self.low_bits
        bits = np.unpackbits(self.low[bit >> 3 : (hi * self.low_bits + 7) >> 3], bitorder="little")[bit & 7 :][: len(ones) * self.low_bits].reshape(len(ones), self.low_bits)
        for k in range(self.low_bits):
            out |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return out

    def nbytes(self) -> int:
        return len(self.low) + len(self.high) + 4 * len(self.samples)

    def tobytes(self) -> bytes:
        return _HEAD.pack(self.n, len(self.high), self.low_bits) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def frombytes(cls, raw: bytes) -> EliasFano:
        n, high, low_bits = _HEAD.unpack_from(raw)
        low = (n * low_bits + 7) // 8
        a = _HEAD.size
        return cls(n, low_bits, np.frombuffer(raw, np.uint8, low, a), np.frombuffer(raw[a + low : a + low + high], np.uint8), np.frombuffer(raw[a + low + high :], np.uint32))


class TokenFile:
    """Random and sequential reads of one token file."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.width, self.nulls, self.n_docs, self.n_ids, self.first_doc, ids, ends, docs, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.ends = EliasFano.frombytes(self.file.read_at(ends, ids))
        self.docs = EliasFano.frombytes(self.file.read_at(docs, ids + ends))

    def ids(self, lo: int, hi: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((hi - lo) * self.width, lo * self.width), f"<u{self.width}").astype("<u4")

    def bounds(self, i: int) -> tuple[int, int]:
        """Start and end of document number i, by two selects."""
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def document(self, i: int) -> np.ndarray:
        return self.ids(*self.bounds(i))

    def doc_ids(self, lo: int, hi: int) -> list[int | None]:
        """The numbers of documents lo up to hi."""
        known = self.docs.span(max(0, lo - self.nulls), max(0, hi - self.nulls)).astype(np.int64) + self.first_doc
        return [None] * (hi - lo - len(known)) + known.tolist()

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first document, bounds of documents from there) of blocks between two select samples, cut at about READ_IDS ids."""
        for at in range(0, self.n_docs, SELECT_STEP):
            stop = min(at + SELECT_STEP, self.n_docs)
            bounds = np.append(self.bounds(at)[0], self.ends.span(at, stop).astype(np.int64))
            lo = 0
            while lo < stop - at:
                hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + READ_IDS, side="right")) - 1)
                yield at + lo, bounds[lo : hi + 1]
                lo = hi

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def write_token_file(uri: str, parts: Iterator[tuple[np.ndarray, np.ndarray, list[int | None]]], width: int) -> tuple[int, int]:
    """Write (ids, lengths, document numbers) parts, nulls first and then ascending; returns documents and ids."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    lengths, docs, nulls = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    with fs.open_output_stream(path, compression=None) as out:
        for ids, sizes, numbers in parts:
            out.write(np.ascontiguousarray(ids, f"<u{width}").tobytes())
            lengths.append(sizes)
            known = [x for x in numbers if x is not None]
            nulls += len(numbers) - len(known)
            docs.append(np.array(known, np.int64))
        ends, docs = np.cumsum(np.concatenate(lengths)), np.concatenate(docs)
        n_ids = int(ends[-1]) if len(ends) else 0
        first = int(docs[0]) if len(docs) else 0
        ends_raw, docs_raw = EliasFano.encode(ends).tobytes(), EliasFano.encode((docs - first).astype(np.uint64)).tobytes()
        out.write(ends_raw)
        out.write(docs_raw)
        out.write(_FOOTER.pack(width, nulls, len(ends), n_ids, first, n_ids * width, len(ends_raw), len(docs_raw), _MAGIC))
    return len(ends), n_ids


def write_tokens(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write token files in ascending document order; returns the manifest.

    Rows are range-partitioned on (id, text hash), sorted, and each partition becomes one file below
    ``out_dir``. Every document ends with ``end_id``; null and empty texts hold only that. Rows with a null id come first; rows with
    equal ids follow each other in the order of their texts. Other columns are ignored. The manifest has
    (shard, path, n_docs, n_ids, start): ``start`` counts the ids in all files before. A task writes under a name of its own
    and only the manifest, committed by Spark, says which files count, so repeated and lost tasks do no harm.
    """
    small_batches(docs.sparkSession)
    width = id_width(tokenizer_path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = library_encoder(tokenizer_path), TaskContext.get().partitionId()
        uri = f"{out_dir}/tokens-{shard:06d}-{uuid.uuid4().hex}.eft"

        def parts(first: pa.RecordBatch):
            for batch in chain([first], batches):
                for part in text_chunks(batch, "text", 2 << 20):
                    ids, bounds = encoder.encode(part.column("text"))
                    yield np.insert(ids, bounds[1:], end_id), np.diff(bounds) + 1, part.column("doc_id").to_pylist()

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        n_docs, n_ids = write_token_file(uri, parts(first), width)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": [uri], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    keyed = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    ordered = keyed.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    files = materialize(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return materialize(files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")), "token-manifest")


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids as little-endian unsigned 32-bit) of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with TokenFile(path) as file:
                    for lo, bounds in file.blocks():
                        numbers, ids = file.doc_ids(lo, lo + len(bounds) - 1), file.ids(int(bounds[0]), int(bounds[-1]))
                        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(base + bounds[:-1]), pa.array(np.diff(bounds)), binary_cells(ids, bounds - bounds[0])], ["doc_id", "start", "n_tokens", "ids"])

    files = max(1, manifest.count())
    return manifest.select("path", "start").repartition(files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
