"""Collocations: phrases whose words stand together more often than they would by chance, counted with position bitmaps.

A task gathers texts of a language into bundles and numbers their words, with a gap between pieces, so no phrase crosses one. Every word of a bundle has a bitmap of its
positions, compressed to its bytes that aren't zero. A phrase's bitmap has the positions of its last word: shifted by one and ANDed with the bitmaps of the words in those
bytes it becomes the bitmaps of all phrases that are one word longer, and their population counts are the phrase's occurrences in the bundle. Phrases are extended depth first, from
a batch of first words to the longest phrases before the next batch. Counts are summed over bundles by aggregation.

A phrase can be frequent only if all pairs of neighbours in it are. A first pass counts pairs by hash, and those frequent enough make a filter of FILTER_BITS bits at most, which every task gets.
The filter only saves work: where it lets too much through, more phrases are counted and dropped by their sums.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventweave.llm.scratch import discard, materialize, small_batches

#: Bytes of text of a bundle; entries of first words' bitmaps that are extended together.
BUNDLE, BATCH = 12 << 20, 1 << 16
#: log2 of the filter's bits: least and most (32 MB), and bits for each pair below that.
FILTER_BITS, BITS_EACH = (15, 28), 16
#: Candidates of a language are ranked in so many parts before they meet.
PARTS = 64

#: Bytes that end words, and those that end pieces.
SPACES, ENDS = b" \t", b".,;:!?\n\x0b\x0c\r"

_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)], _KIND[list(ENDS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, and for each whether it begins a piece."""
    joined = pc.binary_join_element_wise(texts.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1]
    buf = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    kind = _KIND[buf]
    inside = kind == 0
    edges = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    begins = np.diff(piece, prepend=-1) != 0
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(_LOWER[buf[inside]])])
    return words, begins


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes with every bit depending on all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Bitmaps:
    """Position bitmaps of the words of a bundle: entries (word, byte, mask), those of a byte one after the other."""

    def __init__(self, words: pa.ChunkedArray, begins: np.ndarray):
        coded = words.combine_chunks().dictionary_encode()
        self.words, ids = coded.dictionary, coded.indices.to_numpy()
        place = np.arange(len(ids)) + np.cumsum(begins)
        key, bit = (place >> 3) * len(self.words) + ids, np.left_shift(np.uint8(1), (place & 7).astype(np.uint8))
        del coded, place
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.mask = np.bitwise_or.reduceat(bit[order], first)
        self.byte, self.word = np.divmod(key[first], len(self.words))
        self.start = np.searchsorted(self.byte, np.arange(self.byte[-1] + 3))
        self.counts = np.bincount(ids, minlength=len(self.words))

    def hashes(self, lang: str) -> np.ndarray:
        """A hash of each word and the language."""
        bounds = np.frombuffer(self.words.buffers()[1], np.int64)[self.words.offset : self.words.offset + len(self.words) + 1]
        data = np.frombuffer(self.words.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].astype(np.uint64) + np.uint64(1)
        size = np.diff(bounds)
        power = np.cumprod(np.concatenate([[1], np.full(size.max() - 1, 0x100000001B3)]).astype(np.uint64))
        inside = np.arange(len(data)) - np.repeat(bounds[:-1] - bounds[0], size)
        return mixed(np.add.reduceat(data * power[inside], bounds[:-1] - bounds[0]) + np.uint64(zlib.crc32(lang.encode())))

    def longer(self, owner: np.ndarray, byte: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """(owner, next word, byte, mask): each owner's bitmap, shifted by one position, ANDed with those of all words."""
        over = np.flatnonzero(mask >> 7)
        owner, byte = np.concatenate([owner, owner[over]]), np.concatenate([byte, byte[over] + 1])
        mask = np.concatenate([mask << 1, np.ones(len(over), np.uint8)])
        size = self.start[byte + 1] - self.start[byte]
        row = np.repeat(np.arange(len(byte)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[byte], size)
        both = mask[row] & self.mask[at]
        hit = np.flatnonzero(both)
        both, row, at = both[hit], row[hit], at[hit]
        return owner[row], self.word[at], byte[row], both

    def phrases(self, longest: int, allowed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, counts) of phrases of 2 to ``longest`` words, depth first; ``allowed`` tells which pairs (left, right) may stand in one."""
        order = np.argsort(self.word, kind="stable")
        bounds = np.searchsorted(self.word[order], np.arange(len(self.words) + 1))
        a = 0
        while a < len(self.words):
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + BATCH, "right")) - 1)
            rows = order[bounds[a] : bounds[b]]
            yield from self._deeper(np.arange(a, b)[:, None], self.word[rows] - a, self.byte[rows], self.mask[rows], longest, allowed)
            a = b

    def _deeper(self, known: np.ndarray, owner: np.ndarray, byte: np.ndarray, mask: np.ndarray, longest: int, allowed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        owner, word, byte, mask = self.longer(owner, byte, mask)
        phrase, own = np.unique(owner * len(self.words) + word, return_inverse=True)
        parent, last = np.divmod(phrase, len(self.words))
        keep = allowed(known[parent, -1], last)
        count = np.bincount(own, weights=np.bitwise_count(mask), minlength=len(phrase)).astype(np.int64)
        words = np.column_stack([known[parent], last])[keep]
        if not len(words):
            return
        yield words, count[keep]
        if words.shape[1] < longest:
            rows = np.flatnonzero(keep[own])
            yield from self._deeper(words, (np.cumsum(keep) - 1)[own[rows]], byte[rows], mask[rows], longest, allowed)


def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Bitmaps]]:
    """The texts of a task by language, in bundles of about BUNDLE bytes; a longer text is a bundle of its own."""
    held: dict[str, list] = {}
    size = 0

    def full() -> Iterator[tuple[str, Bitmaps]]:
        for lang, parts in held.items():
            words = pa.chunked_array([w for w, _ in parts], pa.large_binary())
            if len(words):
                yield lang, Bitmaps(words, np.concatenate([b for _, b in parts]))

    for batch in batches:
        coded = batch.column("lang").dictionary_encode()
        which = coded.indices.to_numpy()
        for i, lang in enumerate(coded.dictionary.to_pylist()):
            held.setdefault(lang, []).append(words_of(batch.column("text").take(pa.array(np.flatnonzero(which == i)))))
        size += batch.column("text").nbytes
        if size >= BUNDLE:
            yield from full()
            held, size = {}, 0
    yield from full()


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)


def frequent_pairs(texts: DataFrame, least: int) -> DataFrame:
    """(key), stored: hashes of pairs of neighbours of which there are at least ``least``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, maps in bundles(batches):
            h = maps.hashes(lang)
            for words, n in maps.phrases(2, lambda left, right: np.ones(len(left), bool)):
                yield pa.RecordBatch.from_arrays([pa.array(pair_hashes(h[words[:, 0]], h[words[:, 1]]).view(np.int64)), pa.array(n)], ["key", "n"])

    pairs = texts.mapInArrow(count, "key long, n long")
    return materialize(pairs.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key"), "frequent-pairs")


def pair_filter(keys: DataFrame) -> np.ndarray:
    """Bits of two places for each key, as bytes: BITS_EACH a key, but FILTER_BITS at most."""
    low, high = FILTER_BITS
    bits = min(high, max(low, (BITS_EACH * keys.count()).bit_length()))
    place = F.explode(F.array(*[F.shiftrightunsigned("key", n).bitwiseAND(F.lit((1 << bits) - 1)) for n in (0, 32)]))
    words = keys.select(place.alias("at")).groupBy(F.expr("at div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("at % 32768")).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in words.toLocalIterator():
        out[row.part * 4096 : (row.part + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def holds(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    last, found = np.uint64(len(filled) * 8 - 1), np.ones(len(keys), bool)
    for n in (0, 32):
        at = (keys >> np.uint64(n)) & last
        found &= (filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found


def phrase_counts(texts: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, phrase, f), stored: all phrases of up to ``longest`` words that occur at least ``least`` times, and each language's number of words under a null phrase."""
    keys = frequent_pairs(texts, least)
    filled = texts.sparkSession.sparkContext.broadcast(pair_filter(keys))
    discard(keys)
    names = ["lang", "phrase", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filled.value
        space = pa.scalar(b" ", pa.large_binary())
        for lang, maps in bundles(batches):
            h = maps.hashes(lang)
            known = lambda phrases, n: pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), phrases.cast(pa.binary()), pa.array(n)], names)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.nulls(1, pa.binary()), pa.array([maps.counts.sum()])], names)
            yield known(maps.words, maps.counts)
            for words, n in maps.phrases(longest, lambda left, right, h=h: holds(bits, pair_hashes(h[left], h[right]))):
                yield known(pc.binary_join_element_wise(*[maps.words.take(pa.array(w)) for w in words.T], space), n)

    counted = texts.mapInArrow(count, "lang string, phrase binary, n long").select("lang", F.col("phrase").cast("string").alias("phrase"), "n")
    return materialize(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("phrase").isNull() | (F.col("f") >= least)), "phrases")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words by score, then occurrences ``a``, then bytes.

    Texts are lower-cased (A to Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs. Phrases lie within pieces, and overlapping occurrences all count. ``n`` is
    the language's number of words. A phrase cut after k words has the score floor(10^6 a^2 / (l r)) with the occurrences l and r of its sides; the lowest cut counts, the first
    of equal ones. Phrases that lie in a longer candidate with at least half their occurrences are dropped. Counts are exact up to 10^15. A null language is ``und``; null, empty and wordless texts have no phrases; very long texts are taken whole;
    repeated rows count as often as they occur; an empty table gives no rows. Ids are not looked at and other columns may have any name.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text != ''")
    counted = phrase_counts(texts, longest, least)
    totals = counted.where("phrase is null").select("lang", F.col("f").alias("n"))
    known = counted.where("phrase is not null")
    cand = known.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w")).where(F.size("w") > 1)

    cut = cand.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    sides = cut.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("left"), F.expr("array_join(slice(w, k + 1, size(w)), ' ')").alias("right"))
    side = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = sides.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    wide = lambda c: f"cast({c} as decimal(16,0))"
    score = F.expr(f"(1000000 * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.*")

    inner = F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    around = cand.where(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = lowest.join(around, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * 50))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *keys).orderBy(*order))).where(F.col("rank") <= top)
    some = first(left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))), "part").drop("rank", "part")
    ranked = first(some).select("lang", "rank", "phrase", "a", "l", "r", "score")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
