"""Byte-pair encoding and decoding with a pair occurrence index.

``PairIndexBpe.encode_words`` takes all distinct pre-tokens that a batch needs, lays their symbols out in
one array with links to neighbours, and maps every mergeable pair to the positions where it occurs. Active
ranks are applied in ascending order: each occurrence that still holds is merged, and only the lists of the two
pairs next to it are extended. Positions that an earlier merge used up are recognised when their turn comes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventweave.llm.pretokens import BatchEncoder, split_fast, split_slow
from eventweave.llm.scratch import small_batches
from eventweave.llm.textbuf import binary_cells, text_chunks

#: Text bytes of which the distinct pre-tokens are indexed together.
INDEX_BYTES = 2 << 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class PairIndexBpe:
    """Merge ranks and token bytes of a byte-level vocabulary file."""

    def __init__(self, tokenizer_path: str):
        self.path = tokenizer_path
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_alphabet()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], np.int64)
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.size = size
        self.rank: dict[int, int] = {}
        self.left, self.right, self.made = [], [], []
        for merge in merges:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            key = vocab[a] * size + vocab[b]
            if key not in self.rank:
                self.rank[key] = len(self.made)
                self.left.append(vocab[a])
                self.right.append(vocab[b])
                self.made.append(vocab[a + b])
        keys = np.fromiter(self.rank.keys(), np.int64, len(self.rank))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.arange(len(keys))[order]
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        for token in spec["added_tokens"]:
            self.bytes_of[token["id"]] = token["content"].encode()

    def encode_words(self, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens end to end, and n + 1 bounds."""
        lengths = np.fromiter(map(len, contents), np.int64, len(contents))
        ends = np.cumsum(lengths)
        symbols = self.first[np.frombuffer(b"".join(contents), np.uint8)]
        n = len(symbols)
        inner = np.ones(n, bool)
        inner[ends[lengths > 0] - 1] = False
        at = np.flatnonzero(inner)
        pair = symbols[at] * self.size + symbols[at + 1]
        place = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        hit = self.keys[place] == pair
        at, rank = at[hit], self.ranks[place[hit]]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        active = rank[np.append(0, cuts)].tolist() if len(rank) else []
        index: dict[int, list[int]] = dict(zip(active, (x.tolist() for x in np.split(at, cuts)), strict=False))
        heapify(active)

        sym = symbols.tolist()
        after = np.arange(1, n + 1)
        after[~inner] = -1
        after = after.tolist()
        before = np.arange(-1, n - 1)
        before[(ends - lengths)[lengths > 0]] = -1
        before = before.tolist()
        ranks, size = self.rank, self.size
        while active:
            r = heappop(active)
            a, b, made = self.left[r], self.right[r], self.made[r]
            positions = index.pop(r)
            positions.sort()
            for p in positions:
                if sym[p] != a:
                    continue
                q = after[p]
                if q < 0 or sym[q] != b:
                    continue
                sym[p], sym[q] = made, -1
                nxt = after[p] = after[q]
                if nxt >= 0:
                    before[nxt] = p
                    k = ranks.get(made * size + sym[nxt])
                    if k is not None:
                        if k in index:
                            index[k].append(p)
                        else:
                            index[k] = [p]
                            heappush(active, k)
                prev = before[p]
                if prev >= 0:
                    k = ranks.get(sym[prev] * size + made)
                    if k is not None:
                        if k in index:
                            index[k].append(prev)
                        else:
                            index[k] = [prev]
                            heappush(active, k)
        final = np.array(sym, np.int64)
        alive = final >= 0
        return final[alive].astype(np.uint32), np.append(0, np.cumsum(alive))[np.append(0, ends)]

    def encode_text(self, text: str) -> np.ndarray:
        """The ids of one text, cut by the library's splitter."""
        parts = split_slow(text, self.path)
        ids, bounds = self.encode_words([p for p in parts if isinstance(p, bytes)])
        pieces = iter(np.split(ids, bounds[1:-1]))
        return np.concatenate([np.zeros(0, np.uint32), *(next(pieces) if isinstance(p, bytes) else np.array([p], np.uint32) for p in parts)])

    def decode(self, ids) -> str:
        """The text of ids; bytes that are not UTF-8 become the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(tokenizer_path: str) -> PairIndexBpe:
    return PairIndexBpe(tokenizer_path)


@lru_cache(maxsize=2)
def own_encoder(tokenizer_path: str) -> BatchEncoder:
    """One encoder for all tasks of a Python worker."""
    vocab = vocabulary(tokenizer_path)
    return BatchEncoder(tokenizer_path, split_fast, vocab.encode_words, vocab.encode_text)


def check_supported(tokenizer_path: str) -> None:
    """Refuse vocabulary files whose normaliser or splitter is not the plain byte-level one."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    split, model = spec["pre_tokenizer"] or {}, spec["model"]
    odd = spec["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space")
    if odd or model["type"] != "BPE" or model.get("byte_fallback") or model.get("end_of_word_suffix") or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError(f"{tokenizer_path} is not a plain byte-level BPE vocabulary")


def encode_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit) for every row of docs, whole texts.

    With ``decode``, the ids are decoded again in the same task, and the text is a third column. Null and empty texts have no ids;
    repeated rows are encoded each; other columns are ignored; rows with a null id are kept. Nothing is shuffled: a partition's rows are
    encoded where they are read.
    """
    small_batches(docs.sparkSession)
    check_supported(tokenizer_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vocab = own_encoder(tokenizer_path), vocabulary(tokenizer_path)
        for batch in batches:
            for part in text_chunks(batch, "text", INDEX_BYTES):
                ids, bounds = encoder.encode(part.column("text"))
                columns = [part.column("doc_id"), binary_cells(ids.astype("<u4"), bounds)]
                if decode:
                    columns.append(pa.array([vocab.decode(x.tolist()) for x in np.split(ids, bounds[1:-1])] if part.num_rows else [], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(encode, f"doc_id {kind}, ids binary" + ", text string" * decode)


def decode_ids(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """encoded (doc_id, ids) with the decoded text as a third column; special tokens are kept; null ids have a null text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer_path)
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                texts = [None if raw is None else vocab.decode(np.frombuffer(raw, "<u4").tolist()) for raw in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, ids binary, text string")
