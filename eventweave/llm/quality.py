"""Quality grades by ordinal cumulative-link regression.

One weight vector over hashed text features is shared by all grades, with ordered thresholds:
``P(grade >= j) = sigmoid(w.x - theta_j)``. That gives the expected grade and tail probabilities by which documents are selected.

Features of a whole text, each counted once: its distinct lower-cased words without punctuation at their ends, the distinct shapes of its words (letter
case, digits, punctuation, runs shortened), and levels of how often a word repeats the one before. Word hashes are computed over whole
batches with array operations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventweave.llm.scratch import small_batches
from eventweave.llm.textbuf import U64, is_space, lowered, slice_hashes, text_buffer, text_chunks, words

#: Hashed dimensions, the most labelled documents that are drawn for a fit, and bytes of a text that are hashed at once.
BITS, MAX_TRAIN, PART = 18, 20_000, 2 << 20
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = ord("A"), ord("a"), ord("9"), ord("a")
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SHAPE, _REPEAT = U64(0x51ED270B27220CA5), U64(0x2545F4914F6CDD1D)


def features(column: pa.Array, bits: int = BITS) -> list[np.ndarray]:
    """Sorted distinct feature numbers of each text. A text without words has none. A text longer than PART bytes is taken in parts that end between words."""
    data, offsets = text_buffer(column)
    shift = U64(64 - bits)
    out = []
    if not (np.diff(offsets) > PART).any():
        plain, shape, bounds = _hashes(data, offsets)
        same = np.append(False, plain[1:] == plain[:-1]) if len(plain) else np.zeros(0, bool)
        words_at, shapes_at = ((x >> shift).astype(np.int64) for x in (plain, shape))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            found = [words_at[lo:hi], shapes_at[lo:hi]]
            out.append(_numbers(found, hi - lo, int(same[lo + 1 : hi].sum()), shift))
        return out
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        found, n, repeats, last = [], 0, 0, None
        while lo < hi:
            part = data[lo : min(lo + PART, hi)]
            spaces = np.flatnonzero(is_space(part)) if lo + PART < hi else []
            if len(spaces):
                part = part[: spaces[-1] + 1]
            elif lo + PART < hi:  # a word of more than a part: up to where it ends
                rest = np.flatnonzero(is_space(data[lo:hi]))
                part = data[lo : lo + int(rest[0]) + 1] if len(rest) else data[lo:hi]
            plain, shape, _ = _hashes(part, np.array([0, len(part)]))
            if len(plain):
                repeats += int((plain[1:] == plain[:-1]).sum()) + (last is not None and last == plain[0])
                n, last = n + len(plain), plain[-1]
                found = [np.unique(np.concatenate([*found, (plain >> shift).astype(np.int64), (shape >> shift).astype(np.int64)]))]
            lo += len(part)
        out.append(_numbers(found, n, repeats, shift))
    return out


def _numbers(found: list[np.ndarray], n: int, repeats: int, shift: np.uint64) -> np.ndarray:
    """Feature numbers of a text of n words of which so many repeat the one before."""
    if not n:
        return np.zeros(0, np.int64)
    level = np.arange(math.ceil(repeats / max(1, n - 1) * 5) + 1, dtype=np.uint64)
    return np.unique(np.concatenate([*found, ((level * U64(0x9E3779B97F4A7C15) ^ _REPEAT) >> shift).astype(np.int64)]))


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end, plain and by shape, and where each text's words begin."""
    starts, ends, bounds = words(data, offsets)
    low, solid = lowered(data), _LETTERS[data]
    # words without punctuation at their ends
    n = len(data)
    at = np.arange(n)
    nxt = np.minimum.accumulate(np.where(solid, at, n)[::-1])[::-1] if n else at
    prv = np.maximum.accumulate(np.where(solid, at, -1)) if n else at
    a = np.minimum(nxt[starts], ends) if n else starts
    b = np.maximum(prv[ends - 1] + 1, a) if n else ends
    plain = slice_hashes(low, a, b)
    # shapes: one character of each run of the same class
    kind = _CLASS[data]
    lead = np.zeros(n, bool)
    lead[starts] = True
    keep = lead.copy()
    if n:
        keep[1:] |= kind[1:] != kind[:-1]
    inside = np.zeros(n + 1, np.int32)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    keep &= np.cumsum(inside[:n]) > 0
    upto = np.append(0, np.cumsum(keep))
    return plain, slice_hashes(kind[keep], upto[starts], upto[ends]) ^ _SHAPE, bounds


@dataclass
class CumulativeLink:
    """Weights and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... (columns) of each row of features."""
        score = np.array([self.weights[x].sum() for x in rows], np.float64)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def likelihood(params: np.ndarray, flat: np.ndarray, row: np.ndarray, grades: np.ndarray, n_grades: int, decay: float) -> tuple[float, np.ndarray]:
    """The mean negative log-likelihood of grades, with half of decay times the squared weights, and its gradient.

    ``params`` are the weights, the first threshold and the logarithms of the steps to the next ones; feature flat[i] is in text row[i].
    """
    n_used = len(params) - n_grades + 1
    w, steps = params[:n_used], np.exp(params[n_used + 1 :])
    theta = params[n_used] + np.append(0, np.cumsum(steps))
    n, each = max(1, len(grades)), np.arange(len(grades))
    score = np.bincount(row, w[flat], minlength=len(grades))
    # P(y >= j) with j = 0 and n_grades added: 1 and 0
    tail = np.concatenate([np.ones((len(grades), 1)), 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -60, 60))), np.zeros((len(grades), 1))], axis=1)
    slope = tail * (1 - tail)
    chance = np.maximum(tail[each, grades] - tail[each, grades + 1], 1e-12)
    up, down = slope[each, grades] / chance, slope[each, grades + 1] / chance
    by_theta = np.zeros(n_grades + 1)
    np.add.at(by_theta, grades, up / n)
    np.add.at(by_theta, grades + 1, -down / n)
    by_theta = by_theta[1:n_grades]
    by_weight = np.bincount(flat, ((down - up) / n)[row], minlength=n_used) + decay * w
    return float(-np.log(chance).sum() / n + decay * (w * w).sum() / 2), np.concatenate([by_weight, [by_theta.sum()], steps * by_theta[::-1].cumsum()[::-1][1:]])


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, bits: int = BITS, epochs: int = 300, rate: float = 0.1, decay: float = 1e-4, min_rows: int = 5, min_z: float | None = None) -> CumulativeLink:
    """Maximum likelihood by full-batch Adam, with a penalty on squared weights.

    Features of fewer than min_rows texts keep the weight 0, and so do those with which the mean grade moves by less than min_z standard
    errors, for each cut between grades: words that tell nothing about the grade can't add up to noise in long texts. By default
    min_z is what the largest of all these features would reach by chance, 2.5 at least. Thresholds are a first one and positive steps, so they stay ordered.
    """
    grades = np.asarray(grades, np.int64)
    sizes = np.array([len(x) for x in rows], np.int64)
    flat = np.concatenate([*rows, np.zeros(0, np.int32)])
    used, flat = np.unique(flat, return_inverse=True)
    flat = flat.astype(np.int32)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    count = np.bincount(flat, minlength=len(used))
    if min_z is None:
        min_z = max(2.5, float(np.sqrt(2 * np.log(max(1, (count >= min_rows).sum())))))
    telling = np.zeros(len(used), bool)
    for j in range(1, n_grades):
        off = (grades >= j) - (grades >= j).mean() if len(grades) else np.zeros(0)
        spread = np.sqrt(np.maximum(count * off.var() if len(off) else count, 1e-12))
        telling |= np.abs(np.bincount(flat, off[row], minlength=len(used))) >= min_z * spread
    frequent = (count >= min_rows) & telling
    keep = frequent[flat]
    place = np.cumsum(frequent) - 1
    row = row[keep]
    flat, used = place[flat[keep]].astype(np.int32), used[frequent]
    del keep
    share = np.array([(grades >= j).mean() for j in range(1, n_grades)]) if len(grades) else np.full(n_grades - 1, 0.5)
    share = np.clip(share, 1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(-np.log(share / (1 - share)))
    first, gaps = theta[0], np.log(np.maximum(np.diff(theta), 1e-2))
    params = np.concatenate([np.zeros(len(used)), [first], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, epochs + 1):
        _, grad = likelihood(params, flat, row, grades, n_grades, decay)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << bits, np.float32)
    weights[used] = params[: len(used)]
    return CumulativeLink(weights, params[len(used)] + np.append(0, np.cumsum(np.exp(params[len(used) + 1 :]))), bits)


def training_rows(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAIN) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of rated documents: all of them, or about max_rows drawn by a hash of their ids.

    ``ratings`` has (doc_id, grade). Only drawn ratings (12 bytes each, about max_rows of them) are joined with the documents, and only
    features come to the driver, 4 bytes for each distinct word or shape of a text. Rows with a null id or grade, and ratings of no document, don't count; of documents that
    repeat an id one text counts, always the same, once for each of its grades. Null and empty texts have no features.
    """
    small_batches(docs.sparkSession)
    rated = ratings.where("doc_id is not null and grade is not null").select("doc_id", F.col("grade").cast("int").alias("grade"))
    n = rated.count()
    if n > max_rows:
        rated = rated.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                found = [x.astype("<i4").tobytes() for x in features(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), pa.array(found, pa.binary())], ["doc_id", "grade", "features"])

    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    # one text for each rated id and grade, so that repeated ids don't add to the rows
    joined = texts.join(F.broadcast(rated.distinct()), "doc_id").groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    rows = joined.select("doc_id", "grade", "x.text").mapInArrow(extract, f"doc_id {kind}, grade int, features binary")
    table = rows.toArrow().sort_by([("doc_id", "ascending"), ("features", "ascending")])
    return [np.frombuffer(x, "<i4") for x in table["features"].to_pylist()], table["grade"].to_numpy()


def train(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, **columns) -> CumulativeLink:
    """The model of training_rows(). Without any usable rating all weights are 0 and every grade is as likely as the others' thresholds say; it selects nothing."""
    rows, grades = training_rows(docs, ratings, **columns)
    return fit(rows, grades, n_grades)


def score(docs: DataFrame, model: CumulativeLink, min_tail: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs with ``expected_grade``, ``tail_1`` ... (P(grade >= j)) and ``selected``: whether the last tail is at least min_tail.

    A null or empty text has no features and gets the model's base rates; it isn't selected. All rows are kept, repeated ones with
    equal scores; columns named like the new ones are replaced.
    """
    small_batches(docs.sparkSession)
    n_tails = len(model.thresholds)
    new = ["expected_grade", *(f"tail_{j}" for j in range(1, n_tails + 1)), "selected"]
    names = [c for c in docs.columns if c not in new]
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    whole = "text_"
    while whole in names:
        whole += "_"

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CumulativeLink(*shared.value)
        for batch in batches:
            for part in text_chunks(batch, whole):
                found = features(part.column(whole))
                tails = own.tails(found) if found else np.zeros((0, n_tails))
                keep = (tails[:, -1] >= min_tail) & np.array([len(x) > 0 for x in found], bool)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(tails.sum(axis=1)), *(pa.array(tails[:, j]) for j in range(n_tails)), pa.array(keep)], [*names, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names), "expected_grade double", *(f"{c} double" for c in new[1:-1]), "selected boolean"])
    return docs.select(*[docs[c] for c in names], docs[text_col].cast("string").alias(whole)).mapInArrow(grade, schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from quality and toxicity labels: 0 for toxic, 1 for low quality, 2 for good. Without the labels that decide, the grade is null.

    Toxic is lowest: a toxic word then only ever speaks for a lower grade, and one of them is enough. Between the others, toxic documents would have to keep above those of low
    quality however many such words they hold."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))
