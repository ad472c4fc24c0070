"""Block-at-a-time top-k, codebooks and collocations against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventweave.llm import block_max, collocations, integers, vector_codes

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<double>, label int, row long, dims string, code string, score string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, label, 7, "clash", "clash", "clash") for i, v, label in rows], VECTORS)


def fit(v) -> bool:
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def floors(v, scale):
    return [math.floor(Fraction(x) * scale) for x in v]


def awkward_vectors(rng, dims=8):
    """Null, broken, zero, huge, equal and repeated vectors, ids that repeat or lack, and labels that lack."""
    rows = [(i, [rng.uniform(-1, 1) for _ in range(dims)], None if i % 4 == 0 else i % 3) for i in range(120)]
    rows += [(200, None, 1), (201, [None] + [0.5] * (dims - 1), 1), (202, [NAN] + [0.5] * (dims - 1), 1), (203, [INF] + [0.5] * (dims - 1), 2), (204, [0.0] * dims, 2)]
    rows += [(250, [0.25] * dims, 5), (251, [0.25] * dims, 5), (300, [0.25] * dims, None), (300, [0.25] * dims, None), (350, [-0.3] * dims, 6)]
    return rows


# integers -------------------------------------------------------------------------------------------------------------


def test_whole_numbers_are_exact_and_survive_packing():
    values = np.array([0.1, -0.1, 3.0, -1e300, 1e300, 2.0**60 + 4096, -5e-324, 0.0])
    assert integers.whole(values, 4096).tolist() == floors(values.tolist(), 4096)
    assert integers.whole(values.reshape(2, 4), 256).tolist() == [floors(x, 256) for x in values.reshape(2, 4).tolist()]
    for x in (values, values[:1], values[[0, 5]], np.zeros(0)):
        exact = integers.whole(x, 256)
        assert integers.unpack(integers.pack(exact)).tolist() == exact.tolist()


# block-at-a-time top-k ------------------------------------------------------------------------------------------------


def best_products(rows, k=5):
    """(query_id, rank, vec_id, score) of every row whose id 50 divides."""
    kept = [(n, i, floors(v, 256)) for n, (i, v, _) in enumerate(rows) if fit(v) and v and i is not None]
    out = []
    for n, i, q in kept:
        if i % 50 == 0:
            scores = [(-max(integers.LEAST, min(integers.MOST, sum(a * b for a, b in zip(q, v, strict=True)))), j) for m, j, v in kept if m != n and len(v) == len(q)]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def products(spark, rows):
    found = block_max.top_products(table_of(spark, rows), F.col("vec_id") % 50 == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()))


def test_top_products_of_awkward_vectors(spark):
    rng = random.Random(3)
    rows = awkward_vectors(rng) + [(None, [1.0] * 8, 1), (400, [], 1), (401, [], 1), (450, [0.5] * 3, 1), (451, [0.25] * 3, 1)]
    assert products(spark, rows) == best_products(rows)
    huge = [(i, [rng.choice([1e30, -1e30, 1e12, 0.5]) for _ in range(8)], 0) for i in range(60)]
    assert products(spark, rows + huge) == best_products(rows + huge)
    assert products(spark, []) == []


def test_top_products_over_several_shards(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16))
    rows = [(i, (centres[i % 30] + 0.1 * rng.standard_normal(16)).tolist(), 0) for i in range(2600)]
    rows += [(3000 + i, [0.5] * 16, 0) for i in range(1300)]  # one vector a third of the rows
    shards = block_max.build_index(table_of(spark, rows))[1]
    assert shards.where("block = -1").count() > 2
    assert products(spark, rows) == best_products(rows)


def test_blocks_of_alike_vectors_are_passed_over():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((64, 16))
    v = integers.whole(centres[np.arange(4096) % 64] + 0.02 * rng.standard_normal((4096, 16)), 256)
    shard = pa.table({"dims": pa.array([16] * 4096, pa.int32()), "leaf": pa.array([0] * 4096, pa.int32()), "slice": pa.array([0] * 4096, pa.int32()), "row": range(4096), "vec_id": range(4096), "v": pa.array([integers.pack(x) for x in v], pa.binary())})
    asked = pa.table({"query": range(20), "query_id": range(20), "dims": pa.array([16] * 20, pa.int32()), "v": shard["v"][:20], "bar": pa.array([None] * 20, pa.int64())})
    found, scored = block_max.search_shard(block_max.blocks_of(shard), asked, 5)
    for q in range(20):
        scores = v @ v[q]
        scores[q] = -(1 << 60)
        want = np.lexsort((np.arange(4096), -scores))[:5]
        assert [r["vec_id"] for r in found.to_pylist() if r["query"] == q] == want.tolist()
    assert scored < 0.2 * 20 * 4096


# codebooks ------------------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{(vec_id, code, error, label_error, digest): how often} in Python's integers."""
    kept = [(i, label, floors(v, scale), v) for i, v, label in rows if fit(v)]
    out, sums = [], Counter()
    for dims in {len(v) for _, _, v, _ in kept}:
        own = [x for x in kept if len(x[2]) == dims]
        cut = [(p * dims // parts, (p + 1) * dims // parts) for p in range(parts)]
        first = sorted(own, key=lambda x: (x[0] is None, x[0] or 0, x[3]))[:entries]
        books = [[x[2][a:b] for x in first] for a, b in cut]
        far = lambda x, c: sum((s - t) ** 2 for s, t in zip(x, c, strict=True))
        near = lambda p, v: min((far(v[cut[p][0] : cut[p][1]], c), e) for e, c in enumerate(books[p]))
        for _ in range(rounds):
            for p, (a, b) in enumerate(cut):
                held = [[] for _ in books[p]]
                for x in own:
                    held[near(p, x[2])[1]].append(x[2][a:b])
                books[p] = [[sum(c) // len(h) for c in zip(*h, strict=True)] if h else old for h, old in zip(held, books[p], strict=True)]
        digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
        for i, label, v, _ in own:
            found = [near(p, v) for p in range(parts)]
            error = min(sum(d for d, _ in found), integers.MOST)
            sums[label] += error
            out.append((i, label, "".join(f"{e:02x}" for _, e in found), error, digest))
    return Counter((i, code, error, min(sums[label], integers.MOST), digest) for i, label, code, error, digest in out)


@pytest.mark.parametrize("case", ["awkward", "few", "huge", "lengths", "hot", "none"])
def test_codes_agree_with_plain_ones(spark, case):
    rng = random.Random(6)
    rows = awkward_vectors(rng, 16)
    if case == "few":
        rows = rows[:9]
    if case == "huge":
        rows += [(500 + i, [rng.choice([1e300, -1e9, 3e38, 0.25]) for _ in range(16)], 9) for i in range(8)]
    if case == "lengths":
        rows += [(600, [], 1), (601, [0.5] * 5, 1), (602, [0.25] * 5, 2), (None, [0.5] * 16, 1)]
    if case == "hot":
        rows += [(700 + i, [0.125] * 16, 77) for i in range(200)]
    if case == "none":
        rows = [(1, None, 1)]
    found = vector_codes.compress(table_of(spark, rows))
    got = Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found.collect())
    assert got == plain_codes(rows)


def test_sums_beyond_many_vectors_become_exact():
    left = {4: [(np.array([[1 << 62]]), np.array([vector_codes.MANY]))]}
    out = vector_codes.merged(left, {4: [(np.array([[1 << 62]]), np.array([1]))]})
    assert out[4][0][0].tolist() == [[1 << 63]]


# collocations ---------------------------------------------------------------------------------------------------------

PIECE, WORD = re.compile("[.,;:!?\n\x0b\x0c\r]"), re.compile("[^ \t]+")


def pieces(text):
    return [WORD.findall(p) for p in PIECE.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]


def plain_collocations(docs, longest=3, least=10, top=2000):
    count, out = {}, []
    for lang, text in docs:
        own = count.setdefault(lang or "und" if lang is None else lang, Counter())
        for words in pieces(text):
            for n in range(1, longest + 1):
                own.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    for lang, f in count.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        cand = {k: v for k, v in f.items() if len(k) > 1 and v >= least}
        inner = Counter()
        for k, v in cand.items():
            for m in range(2, len(k)):
                for i in range(len(k) - m + 1):
                    inner[k[i : i + m]] = max(inner[k[i : i + m]], v)
        rows = []
        for k, a in cand.items():
            if 100 * inner[k] >= 50 * a:
                continue
            score, cut = min((10**6 * a * a // (f[k[:i]] * f[k[i:]]), i) for i in range(1, len(k)))
            rows.append((-score, -a, " ".join(k).encode(), f[k[:cut]], f[k[cut:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def phrases(spark, docs, **how):
    rows = spark.createDataFrame([(1, text, lang, "clash", 5, "clash") for lang, text in docs], "doc_id long, text string, lang string, phrase string, n int, rank string")
    found = collocations.collocations(rows, **how)
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found.collect())


def made_texts(rng, n=400):
    words = ["the", "The", "a", "naïve", "Éa", "x\x1cy", "to", "be", "or", "n't", "中文", "new", "york", "city"]
    joins = [" ", "  ", "\t", " ", " ", ". ", ",", "\n", "! ", "\x0b"]
    texts = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(joins) for _ in range(rng.randrange(60)))
        texts.append((rng.choice(["en", "en", "en", None, "fr", "und", ""]), text + ("new york city hall " * 3 if rng.random() < 0.3 else "")))
    return [*texts, ("en", None), ("en", ""), ("zz", " .,\n"), (None, "one"), ("en", "aa " * 40), ("en", "aa aa"), ("en", "New York")]


@pytest.mark.parametrize("longest,least,top", [(3, 10, 2000), (2, 2, 5), (5, 3, 100)])
def test_collocations_agree_with_plain_ones(spark, longest, least, top):
    docs = made_texts(random.Random(7))
    assert phrases(spark, docs, longest=longest, least=least, top=top) == plain_collocations(docs, longest, least, top)


def test_collocations_of_long_repeated_and_no_texts(spark):
    rng = random.Random(8)
    long = " ".join(rng.choice(["of", "the", "sea", "wind", "and", "sky.", "far,"]) for _ in range(200_000))
    docs = [("en", long), ("en", "Of the sea")] + [("en", "wind and sky")] * 40
    assert phrases(spark, docs) == plain_collocations(docs)
    assert phrases(spark, []) == phrases(spark, [("en", None), (None, "")]) == []


def test_a_full_filter_changes_no_result(spark, monkeypatch):
    docs = made_texts(random.Random(9), 150)
    monkeypatch.setattr(collocations, "pair_filter", lambda keys: np.full(4096, 255, np.uint8))
    assert phrases(spark, docs) == plain_collocations(docs)


def test_bitmaps_find_all_words_and_pairs():
    rng = random.Random(10)
    texts = [t for _, t in made_texts(rng, 80) if t]
    words, begins = collocations.words_of(pa.array(texts))
    assert [w.decode() for w in words.to_pylist()] == [w for t in texts for p in pieces(t) for w in p]
    maps = collocations.Bitmaps(pa.chunked_array([words]), begins)
    every = lambda left, right: np.ones(len(left), bool)
    names = maps.words.to_pylist()
    found = {tuple(names[w].decode() for w in row): n for ids, counts in maps.phrases(4, every) for row, n in zip(ids.tolist(), counts.tolist(), strict=True)}
    want = Counter(tuple(p[i : i + n]) for t in texts for p in pieces(t) for n in (2, 3, 4) for i in range(len(p) - n + 1))
    assert found == want


def test_the_pair_filter_holds_every_key(spark):
    keys = np.random.default_rng(11).integers(-(1 << 63), 1 << 63, 3000)
    bits = collocations.pair_filter(spark.createDataFrame([(int(x),) for x in keys], "key long"))
    assert collocations.holds(bits, keys.view(np.uint64)).all()
    others = np.random.default_rng(12).integers(-(1 << 63), 1 << 63, 3000).view(np.uint64)
    assert collocations.holds(bits, others).mean() < 0.1


def test_batches_of_first_words_lose_nothing(monkeypatch):
    texts = [" ".join(random.Random(13).choice("abcdefgh") for _ in range(3000))]
    words, begins = collocations.words_of(pa.array(texts))
    maps = collocations.Bitmaps(pa.chunked_array([words]), begins)
    every = lambda left, right: np.ones(len(left), bool)
    count = lambda: sum(int(n.sum()) for _, n in maps.phrases(3, every))
    whole = count()
    monkeypatch.setattr(collocations, "BATCH", 50)
    assert count() == whole == sum(len(words) - n + 1 for n in (2, 3))


def test_a_bundle_takes_little_memory_while_its_phrases_are_counted():
    words = pa.array([b"%d" % k for k in np.random.default_rng(5).zipf(1.3, 400_000) % 50_000], pa.large_binary())
    begins = np.zeros(len(words), bool)
    begins[::12] = True
    tracemalloc.start()
    try:
        maps = collocations.Bitmaps(pa.chunked_array([words]), begins)
        assert sum(int(n.sum()) for _, n in maps.phrases(2, lambda left, right: np.ones(len(left), bool))) == (~begins[1:]).sum()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 << 20
