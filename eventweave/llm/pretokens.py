"""Byte-level pre-tokens of whole batches, found with array operations.

The pattern is the public byte-level one (``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|...``); its matches
cover a text without gaps, so a batch of texts becomes one Arrow array of slices over one byte buffer, and
equal pre-tokens are encoded once. Texts with characters outside the fast classes take the library's own splitter.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from eventweave.llm.textbuf import lowered, release_freed_memory, text_buffer

# Fixed value: the splitter of public lower-casing vocabularies with word ends.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 4
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[[32, *range(9, 14)]] = SPACE
_CLASS[128:] = LETTER
@lru_cache(maxsize=8)
def added_tokens(tokenizer_path: str) -> dict[str, int]:
    with open(tokenizer_path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


@lru_cache(maxsize=8)
def load(tokenizer_path: str) -> Tokenizer:
    """The tokenizer, without truncation and padding."""
    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class FastChars(dict):
    """Which characters the fast splitters may see: ASCII, and what this tokenizer's own normaliser and splitter treat as letters.

    Each character is tried once: normalised, it must part from punctuation on both sides and stay in one piece with letters. That leaves out
    letters that are normalised to a letter and a mark, and those that other Unicode versions class otherwise.
    """

    def __init__(self, tokenizer_path: str):
        super().__init__()
        tokenizer = load(tokenizer_path)
        self.normalize = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str

    def __missing__(self, c: str) -> bool:
        made = self.normalize(c)
        n = len(made)
        fast = n > 0 and all(self.normalize(x + c + x) == x + made + x for x in "!a")
        fast = fast and [at for _, at in self.split(f"!{made}!")] == [(0, 1), (1, 1 + n), (1 + n, 2 + n)] and [at for _, at in self.split(f"a{made}a")] == [(0, 2 + n)]
        self[c] = c < "\x80" or fast
        return self[c]


@lru_cache(maxsize=8)
def fast_chars(tokenizer_path: str) -> FastChars:
    return FastChars(tokenizer_path)


def plain_rows(column: pa.Array, specials: tuple[str, ...], fast: FastChars) -> np.ndarray:
    """Which texts hold only fast characters and no added token."""
    texts = column.fill_null("").to_pylist()
    return np.array([t.isascii() or all(map(fast.__getitem__, set(t))) for t in texts], bool) & np.array([not any(s in t for s in specials) for t in texts], bool) if texts else np.zeros(0, bool)


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each byte, whether a text starts there (and after the end), and whether a run of a class or a text does."""
    n = len(data)
    kind = _CLASS[data]
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= text_start[:n]
    return kind, text_start, change


def split_fast(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of all pre-tokens in texts that lie end to end."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    kind, text_start, change = _runs(data, offsets)
    cut = change.copy()
    # a run of white space before a visible character gives up its last character
    visible = np.flatnonzero(change & (kind != SPACE) & ~text_start[:n])
    visible = visible[kind[visible - 1] == SPACE]
    cut[visible - 1] = True
    attached = visible[data[visible - 1] == 0x20]
    cut[attached] = False
    # contractions: an apostrophe that starts a pre-token and is a run of its own, before certain letters
    quote = np.flatnonzero((data == 0x27) & cut)
    quote = quote[(quote + 1 < n)]
    quote = quote[change[quote + 1] & (kind[quote + 1] == LETTER) & ~text_start[quote + 1]]
    if len(quote):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b = padded[quote + 1], padded[quote + 2]
        b = np.where(text_start[np.minimum(quote + 2, n)], 0, b)
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for found, length in ((quote[one], 1), (quote[two], 2)):
            cut[found + 1] = False
            rest = found + 1 + length
            rest = rest[rest < n]
            cut[rest[(kind[rest] == LETTER)]] = True
    return np.flatnonzero(cut)


def split_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of runs of one class, each with a space before it, for vocabularies that drop white space.

    An apostrophe alone stays with the letters after it, so that the library itself finds contractions.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    kind, text_start, change = _runs(data, offsets)
    cut = change.copy()
    visible = np.flatnonzero(change & (kind != SPACE) & ~text_start[:n])
    visible = visible[data[visible - 1] == 0x20]
    cut[visible - 1] = True
    cut[visible] = False
    quote = np.flatnonzero((data[:-1] == 0x27) & change[:-1])
    quote = quote[change[quote + 1] & (kind[quote + 1] == LETTER) & ~text_start[quote + 1]]
    cut[quote + 1] = False
    return np.flatnonzero(cut)


_splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def split_slow(text: str, tokenizer_path: str) -> list[bytes | int]:
    """Pre-tokens of one text by the library; added tokens come as their ids."""
    added = added_tokens(tokenizer_path)
    if not added:
        return [text[a:b].encode() for _, (a, b) in _splitter.pre_tokenize_str(text)]
    pieces = re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text)
    out: list[bytes | int] = []
    for piece in filter(None, pieces):
        out.extend([added[piece]] if piece in added else (piece[a:b].encode() for _, (a, b) in _splitter.pre_tokenize_str(piece)))
    return out


def distinct_slices(data: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, pa.Array]:
    """For slices that cover data from starts[0] to end: the number of each one's content, and the contents."""
    bounds = np.append(starts, end).astype(np.int32)
    array = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def ragged_take(values: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate values[offsets[i]:offsets[i+1]] for i in index; returns them and n + 1 bounds."""
    sizes = (offsets[1:] - offsets[:-1])[index]
    bounds = np.zeros(len(index) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    at = np.arange(bounds[-1]) + np.repeat(offsets[:-1][index] - bounds[:-1], sizes)
    return values[at], bounds


class BatchEncoder:
    """Token ids of whole texts, each distinct slice of a batch encoded once.

    ``encode_words`` turns a list of distinct byte strings into their ids end to end and n + 1 bounds; ``encode_text`` gives the ids of a text
    with characters or added tokens that the fast splitters leave out. Ids of up to ``capacity`` slices are kept in flat arrays for later
    batches, those that came first.
    """

    def __init__(self, tokenizer_path: str, split, encode_words, encode_text, lower: bool = False, capacity: int = 200_000):
        self.added, self.fast = tuple(added_tokens(tokenizer_path)), fast_chars(tokenizer_path)
        self.split, self.encode_words, self.encode_text, self.lower, self.capacity = split, encode_words, encode_text, lower, capacity
        self.known, self.ids, self.bounds = pa.array([], pa.binary()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, contents: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct slices end to end, and bounds."""
        place = pc.index_in(contents, value_set=self.known)
        missing = contents.filter(place.is_null())
        at = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        ids, bounds = self.ids, self.bounds
        if len(missing):
            fresh, cuts = self.encode_words(missing.to_pylist())
            at[at < 0] = len(self.known) + np.arange(len(missing))
            ids, bounds = np.concatenate([ids, fresh]), np.concatenate([bounds, bounds[-1] + cuts[1:]])
            room = min(len(missing), self.capacity - len(self.known))
            if room > 0:
                self.known = pa.concat_arrays([self.known, missing.slice(0, room)])
                self.bounds = bounds[: len(self.known) + 1].copy()
                self.ids = ids[: self.bounds[-1]].copy()
        return ragged_take(ids, bounds, at)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end as uint32, and n + 1 bounds."""
        release_freed_memory()
        fast = plain_rows(column, self.added, self.fast)
        if fast.all():
            return self._encode_fast(column)
        ids, sizes = [], np.zeros(len(column) + 1, np.int64)
        lo = 0
        while lo < len(column):
            hi = lo + 1
            while hi < len(column) and fast[hi] == fast[lo]:
                hi += 1
            if fast[lo]:
                part, bounds = self._encode_fast(column.slice(lo, hi - lo))
                ids.append(part)
                sizes[lo + 1 : hi + 1] = np.diff(bounds)
            else:
                for row in range(lo, hi):
                    ids.append(np.asarray(self.encode_text(column[row].as_py()), np.uint32))
                    sizes[row + 1] = len(ids[-1])
            lo = hi
        return np.concatenate(ids), np.cumsum(sizes)

    def _encode_fast(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_buffer(column)
        if self.lower:
            data = lowered(data)
        starts = self.split(data, offsets)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        index, contents = distinct_slices(data, starts, len(data))
        ids, bounds = ragged_take(*self._ids(contents), index)
        return ids, bounds[np.searchsorted(starts, offsets)]


def library_words(tokenizer_path: str):
    """encode_words by the tokenizers library: many slices in one call, apart by an added token."""
    tokenizer, added = load(tokenizer_path), added_tokens(tokenizer_path)
    apart, mark = next(iter(added.items()), (None, None))

    def encode(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts, sizes = [], [np.zeros(1, np.int64)]
        for lo in range(0, len(contents), 512):  # the library's results are large
            words_ = [w.decode() for w in contents[lo : lo + 512]]
            if apart is None:
                found = [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(words_, add_special_tokens=False)]
                parts.extend(found)
                sizes.append(np.array([len(x) for x in found], np.int64))
            else:
                ids = np.array(tokenizer.encode_batch_fast([apart.join(words_)], add_special_tokens=False)[0].ids, np.uint32)
                marks = np.flatnonzero(ids == mark)
                if len(marks) != len(words_) - 1:
                    raise ValueError("a slice holds an added token")
                parts.append(ids[ids != mark])
                sizes.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum(np.concatenate(sizes))

    return encode


@lru_cache(maxsize=4)
def library_encoder(tokenizer_path: str) -> BatchEncoder:
    """The library's ids of whole texts; one encoder for all tasks of a Python worker.

    Byte-level vocabularies without a normaliser work on pre-tokens; lower-casing ones with the pattern below, whose matches never join two classes of
    characters but for contractions, work on runs of a class.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec["pre_tokenizer"] or {}
    parts = split.get("pretokenizers", [split])
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec["normalizer"]
    classes = parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and parts[0].get("pattern") == {"Regex": WORD_PATTERN}
    lowers = any(x.get("type") == "Lowercase" for x in (spec["normalizer"] or {}).get("normalizers", []))
    if not plain and not (classes and lowers and not any(p.get("add_prefix_space") for p in parts)):
        raise ValueError(f"{tokenizer_path}: texts of this tokenizer can't be encoded by parts")
    whole = load(tokenizer_path)
    return BatchEncoder(tokenizer_path, split_fast if plain else split_words, library_words(tokenizer_path), lambda text: whole.encode(text, add_special_tokens=False).ids, lower=not plain)


def id_width(tokenizer_path: str) -> int:
    """Bytes that hold any id: 2 or 4."""
    return 2 if load(tokenizer_path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
