"""Operators against plain versions of their contracts, on the small tables and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import sys
import unicodedata
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

from eventweave.llm import ann, bpe, cover_tree, elias_fano, graph, line_dedup, minhash, packing, pretokens, quality, queries, sharding, textbuf, warc  # noqa: E402
from eventweave.llm.scratch import materialize, scratch_path  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = "".join(random.Random(1).choice(["word ", "Stone, ", "l'eau\n", "12 ", "naïve "]) for _ in range(60_000))
#: Texts that are null, empty, blank, of one word, very long, repeated, or full of rare characters.
TEXTS = [None, "", " \n\t", "one", "a b c d", "a b c d e", "A B C D E", "a b c d e", LONG, "x <|endoftext|> y", "don't WE'LL 's\n\n  é ½ 中文 \x1c 😀", "tail  "]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, ids string, selected int"


def awkward(spark):
    rows = [(i, t, None, None if i % 3 else f"s{i % 2}", None, "clash", "clash", None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, "a b c d e f", "en", "s1", 1, "clash", "clash", 0), (5, "a b c d e", "en", "s1", 1, "clash", "clash", 0)], DOCS)


def documents(name="documents", columns="doc_id, text"):
    return duckdb.sql(f"select {columns} from '{SF}/{name}.parquet'").fetchall()


# tokens ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoders_agree_with_the_library(name):
    path = queries.BYTE_BPE.replace("byte_bpe_50k.json", name)
    rng = random.Random(2)
    letters = "ab's tlvermdSD  \n\t.,1é<'’É½"
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 0x3000), rng.randrange(0x1F000, 0x1FAFF)])) for _ in range(30)) for _ in range(500)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    encoders = [pretokens.library_encoder(path)] + ([bpe.own_encoder(path)] if name.startswith("byte") else [])
    for encoder in encoders:
        for _ in range(2):  # the second time from the kept ids
            ids, bounds = encoder.encode(pa.array(texts))
            assert [x.tolist() for x in np.split(ids, bounds[1:-1])] == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_letter_is_encoded_as_by_the_library(name):
    path = queries.BYTE_BPE.replace("byte_bpe_50k.json", name)
    letters = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c)[0] in "LMN"]
    texts = [f"!{c}! x {c}a{c}'s 1{c}" for c in letters]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    fast = pretokens.fast_chars(path)
    assert sum(map(fast.__getitem__, letters)) > 100_000
    for encoder in [pretokens.library_encoder(path)] + ([bpe.own_encoder(path)] if name.startswith("byte") else []):
        ids, bounds = encoder.encode(pa.array(texts))
        wrong = [(hex(ord(c)), x.tolist(), y) for c, x, y in zip(letters, np.split(ids, bounds[1:-1]), want, strict=True) if x.tolist() != y]
        assert wrong == []


def test_overlapping_pairs_merge_from_the_left():
    own, library = bpe.vocabulary(queries.BYTE_BPE), Tokenizer.from_file(queries.BYTE_BPE)
    words = [b"aaaaaaa", b"!!!!!!!!!!!", b"", b"=====", b"ababababa", "ééééé".encode()]
    ids, bounds = own.encode_words(words)
    assert [x.tolist() for x in np.split(ids, bounds[1:-1])] == [library.encode(w.decode(), add_special_tokens=False).ids for w in words]


def test_bpe_round_trip(spark):
    library = Tokenizer.from_file(queries.BYTE_BPE)
    got = sorted(map(tuple, queries.op6_bpe_pair_index(spark, SF).collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((i, len(e.ids), sha(brute.le(e.ids)), sha(library.decode(e.ids, skip_special_tokens=False).encode())) for (i, _), e in zip(documents(), library.encode_batch([t or "" for _, t in documents()], add_special_tokens=False), strict=True))
    assert got == want
    rows = bpe.encode_texts(awkward(spark), queries.BYTE_BPE, decode=True).collect()
    assert sorted((r.text for r in rows), key=str) == sorted([t or "" for t in TEXTS] + ["a b c d e f", "a b c d e"], key=str)
    assert bpe.decode_ids(bpe.encode_texts(awkward(spark).limit(0), queries.BYTE_BPE), queries.BYTE_BPE).count() == 0
    with pytest.raises(ValueError):
        bpe.encode_texts(awkward(spark), queries.WORD_BPE)


def test_elias_fano_sequences():
    rng = random.Random(3)
    for n, top in ((0, 1), (1, 0), (5, 3), (700, 50), (3000, 10**6), (40, 2**50)):
        values = sorted(rng.randrange(top + 1) for _ in range(n))
        code = elias_fano.EliasFano.frombytes(elias_fano.EliasFano.encode(np.array(values, np.uint64)).tobytes())
        assert code.values().tolist() == values and [code[i] for i in range(n)] == values
    many = np.cumsum(np.full(100_000, 512, np.uint64))
    assert elias_fano.EliasFano.encode(many).nbytes() * 8 / 100_000 < 12
    with pytest.raises(ValueError):
        elias_fano.EliasFano.encode(np.array([2, 1], np.uint64))


def test_token_files(spark):
    library = Tokenizer.from_file(queries.WORD_BPE)
    at, want = 0, []
    for i, t in sorted(documents()):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), brute.crc(brute.le(ids))))
        at += len(ids)
    assert sorted(map(tuple, queries.op2_elias_fano_tokens(spark, SF).collect())) == want
    manifest = elias_fano.write_tokens(awkward(spark), scratch_path(spark, "t"), queries.WORD_BPE)
    rows = elias_fano.read_tokens(spark, manifest).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10, 11]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    one = manifest.orderBy("start").first()
    with elias_fano.TokenFile(one.path) as file:
        assert file.document(0).tolist() == np.frombuffer(rows[0].ids, "<u4").tolist()
        with pytest.raises(IndexError):
            file.bounds(file.n_docs)
    assert elias_fano.read_tokens(spark, elias_fano.write_tokens(awkward(spark).limit(0), scratch_path(spark, "t"), queries.WORD_BPE)).count() == 0


def test_token_files_are_read_through_select(spark):
    rng = random.Random(17)
    for n, top in ((1, 0), (700, 50), (3000, 10**6), (1500, 2**50)):
        values = sorted(rng.randrange(top + 1) for _ in range(n))
        code = elias_fano.EliasFano.encode(np.array(values, np.uint64))
        for lo, hi in [(0, n), (0, 0), (n, n), (n - 1, n)] + [sorted((rng.randrange(n + 1), rng.randrange(n + 1))) for _ in range(20)]:
            assert code.span(lo, hi).tolist() == values[lo:hi]
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(3000)] + [(None, "no id")], "doc_id long, text string")
    manifest = elias_fano.write_tokens(docs, scratch_path(spark, "t"), queries.WORD_BPE)
    rows = sorted(map(tuple, elias_fano.read_tokens(spark, manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == [None, *range(3000)]
    path = Path(manifest.orderBy("start").first().path.removeprefix("file://"))
    raw = bytearray(path.read_bytes())
    ids, ends = elias_fano._FOOTER.unpack(raw[-elias_fano._FOOTER.size :])[5:7]
    raw[ids + ends - 4 : ids + ends] = (int.from_bytes(raw[ids + ends - 4 : ids + ends], "little") + 9).to_bytes(4, "little")  # the last sample
    path.write_bytes(raw)
    try:
        wrong = sorted(map(tuple, elias_fano.read_tokens(spark, manifest).collect()), key=lambda r: r[1])
    except Exception:  # noqa: BLE001
        wrong = None
    assert wrong != rows


# packing and sharding ----------------------------------------------------------------------------------------------


def check_pieces(rows, window):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by_seq) == list(range(len(by_seq)))
    for k, parts in by_seq.items():
        at = 0
        for a, n in sorted(parts):
            assert a == at and n > 0
            at += n
        assert at == window or k == len(by_seq) - 1
    return by_doc


def test_packing_covers_every_id_once(spark):
    library = Tokenizer.from_file(queries.BYTE_BPE)
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in documents()}
    rows = queries.op4_mixture_packing(spark, SF).collect()
    for (i, total), parts in check_pieces(rows, 2048).items():
        assert total == len(want[i]) and [a for a, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1].tolist()]
        assert sum(n for _, n in parts) == total
    assert all(r.ids_crc32 == brute.crc(brute.le(want[r.doc_id][r.start : r.start + r.length])) for r in rows)
    assert {r.doc_id for r in rows} == set(want)


def test_windows_have_the_target_mixture(spark):
    docs = spark.createDataFrame([(i, "word " * 300, "abc"[i % 3]) for i in range(90)], "doc_id long, text string, source string")
    tokens = packing.queue_tokens(docs, queries.BYTE_BPE)
    rows = packing.pack(tokens, queries.BYTE_BPE, window=512, grain=8, targets={"a": 2, "b": 1, "c": 1}).collect()
    check_pieces(rows, 512)
    share = {}
    for r in rows:
        share.setdefault(r.sequence_id, {}).setdefault(r.source, []).append(r.length)
    for k in range(30):
        mix = {s: sum(v) for s, v in share[k].items()}
        assert abs(mix["a"] - 256) <= 4 and abs(mix["b"] - 128) <= 4 and abs(mix["c"] - 128) <= 4


def test_windows_of_the_query_have_the_shares_of_the_corpus(spark):
    path = SF.replace("0.001", "0.01")
    pieces = queries.op4_mixture_packing(spark, path).cache()
    total = dict(pieces.groupBy("source").agg(F.sum("length")).collect())
    full = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n = 2048").count()
    rows = packing.mixture(pieces).collect()
    shares = {s: n / sum(total.values()) for s, n in total.items()}
    assert len({r.sequence_id for r in rows}) in (full, full + 1) and len(total) == 20
    held = {}
    for r in rows:
        assert abs(r.share - shares[r.source]) < 1e-9
        held.setdefault(r.sequence_id, {})[r.source] = r.tokens
    # each source is off by a token, and at either end of a window by a token for each source
    off = [[abs(own.get(s, 0) - 2048 * share) for s, share in shares.items()] for k, own in held.items() if k < full]
    assert max(map(max, off)) <= 2 * len(shares) + 1 and sum(sorted(sum(off, []))[: len(off) * 16]) <= 2 * 16 * len(off)
    pieces.unpersist()


def test_packing_of_awkward_rows(spark):
    rows = packing.pack(packing.queue_tokens(awkward(spark), queries.BYTE_BPE), queries.BYTE_BPE, window=64).collect()
    check_pieces(rows, 64)
    few = packing.pack(packing.queue_tokens(awkward(spark), queries.BYTE_BPE, max_queues=1), queries.BYTE_BPE, window=64).collect()
    assert sum(r.length for r in few) == sum(r.length for r in rows) and len({r.source for r in few}) <= 2
    assert packing.pack(packing.queue_tokens(awkward(spark).limit(0), queries.BYTE_BPE), queries.BYTE_BPE).count() == 0


def test_sources_keep_names_and_shares_at_any_number(spark):
    rows = [(i, "word " * 11, f"site{i % 4199}" if i % 4199 else None) for i in range(4300)] + [(10_000 + i, "word " * 299, "big") for i in range(120)]
    source = {i: s for i, _, s in rows}
    tokens = packing.queue_tokens(spark.createDataFrame(rows, "doc_id long, text string, source string"), queries.BYTE_BPE)
    for targets in (None, {"big": 1}):
        out = packing.pack(tokens, queries.BYTE_BPE, window=1024, grain=8, targets=targets).collect()
        by_doc, big = check_pieces(out, 1024), {}
        assert all(r.source == source[r.doc_id] for r in out) and {i for i, _ in by_doc} == set(source)
        assert all(sum(n for _, n in parts) == total for (_, total), parts in by_doc.items())
        for r in out:
            big[r.sequence_id] = big.get(r.sequence_id, 0) + r.length * (r.source == "big")
        assert targets is None or all(big[k] > 0.9 * 1024 for k in range(30))
    with pytest.raises(ValueError):
        packing.pack(tokens, queries.BYTE_BPE, targets={"none of them": 1})


def test_sources_of_one_group_have_their_shares(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUPS", 3)
    library = Tokenizer.from_file(queries.BYTE_BPE)
    rows = [(i, f"number {i} " + "word " * (i % 400), f"s{i * i % 11}" if i % 13 else None) for i in range(600)]
    texts, source = {i: t for i, t, _ in rows}, {i: s for i, _, s in rows}
    tokens = packing.queue_tokens(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), queries.BYTE_BPE)
    assert tokens.select("queue").distinct().count() <= 3
    out = packing.pack(tokens, queries.BYTE_BPE, window=1024, grain=8).collect()
    full, mix = {}, {}
    for r in out:
        assert r.source == source[r.doc_id]
        full.setdefault(r.doc_id, []).append((r.start, r.ids))
        mix.setdefault(r.sequence_id, {}).setdefault(r.source, []).append(r.length)
    check_pieces(out, 1024)
    assert {i: b"".join(b for _, b in sorted(v)) for i, v in full.items()} == {i: brute.le([*library.encode(t, add_special_tokens=False).ids, 1]) for i, t in texts.items()}
    total = {s: sum(sum(m.get(s, [])) for m in mix.values()) for s in set(source.values())}
    whole = sum(total.values())
    for k in range(len(mix) - 2):
        assert all(abs(sum(mix[k].get(s, [])) - 1024 * n / whole) <= 64 for s, n in total.items())


def test_shards_are_even_and_gapless(spark):
    texts = dict(documents())
    rows = queries.op5_sampled_splitters(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r["size"] == len((texts[r.doc_id] or "").encode()) + 16 and r.text_crc32 == brute.crc((texts[r.doc_id] or "").encode()) for r in rows)
    by, size = {}, dict.fromkeys(range(40), 0)
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        size[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    even, most = sum(size.values()) / 40, max(r["size"] for r in rows)
    assert all(abs(x - even) <= most for x in size.values())


def test_rounds_go_on_until_only_single_keys_are_overfull(spark, monkeypatch):
    monkeypatch.setattr(sharding, "KEYS_PER_RANGE", 0.2)  # samples that miss most ranges
    rng = random.Random(6)
    rows = [(rng.randrange(-(2**62), 2**62), i, 10) for i in range(3000)] + [(5, i % 2, 400) for i in range(200)]
    keys = spark.createDataFrame(rows, "k1 long, k2 long, size long")
    total = sum(r[2] for r in rows)
    cuts = sharding.splitters(keys, total, 50)
    place = np.searchsorted(cuts, sharding.packed_keys(np.array([r[0] for r in rows]), np.array([r[1] for r in rows])), side="right")
    for k in set(place.tolist()):
        own = [r for r, p in zip(rows, place.tolist(), strict=True) if p == k]
        assert sum(r[2] for r in own) <= sharding.OVERFULL * total / 50 or len({r[:2] for r in own}) == 1


def test_hot_groups_are_cut_and_overfull_ranges_subdivided(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}", None) for i in range(4000)], "doc_id long, text string, shard string")
    monkeypatch.setattr(sharding, "KEYS_PER_RANGE", 1)
    rows = sharding.shard_by_splitters(docs, 8).collect()
    sizes = [sum(len(r.text) + 16 for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 50 and len(rows) == 4000
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(8))
    odd = sharding.shard_by_splitters(awkward(spark), 3)
    assert odd.count() == len(TEXTS) + 2 and odd.columns.count("shard") == 1
    assert sharding.shard_by_splitters(awkward(spark).limit(0), 3).count() == 0


# vectors -----------------------------------------------------------------------------------------------------------

BAD = [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0]]


def test_nearest_neighbours(spark):
    want = brute.nearest(documents("embeddings", "vec_id, embedding"), lambda i: i % 50 == 0)
    got = {}
    for r in sorted(queries.op3_one_bit_codes(spark, SF).collect()):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in want[q]} & {i for _, i, _ in got[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    exact = {(q, i): s for q, found in want.items() for i, s in found}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, found in got.items() for _, i, s in found if (q, i) in exact)
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, len(want[q]) + 1))
        assert found == sorted(found, key=lambda x: (-x[2], x[1]))
        if {i for _, i, _ in found} == {i for i, _ in want[q]}:
            assert [i for _, i, _ in found] == [i for i, _ in want[q]]


def test_few_candidates_are_reranked():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((40_000, 64))
    turned = v / np.linalg.norm(v, axis=1, keepdims=True) @ ann.rotation(64, 11).T
    code, align = np.packbits(turned > 0, axis=1, bitorder="little"), np.abs(turned).sum(axis=1) / 8
    cand = pa.table({"vec_id": np.arange(len(v)), "embedding": pa.array(list(v)), "code": [x.tobytes() for x in code], "align": align})
    ask = np.arange(0, len(v), 2000)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cosine = unit[ask] @ unit.T
    cosine[np.arange(len(ask)), ask] = -2
    nearest = np.argsort(-cosine, axis=1)[:, :5]
    asked = cand.take(pa.array(ask))
    first = ann.best_estimates(asked.take(pa.array([0])), asked, 20, 1.9, 11)
    assert len(first) == len(ask) - 1  # a query is no candidate of its own
    first = ann.best_estimates(cand, asked, 20, 1.9, 11).to_pandas()
    bars = [np.sort(cosine[k, first.vec_id[first.query_id == q]])[-5] for k, q in enumerate(ask)]
    found, reranked = ann.nearest_in_cell(cand, asked.append_column("bar", pa.array(bars)), 5, 1.9, 11)
    found = found.to_pandas()
    hits = sum(len(set(found.vec_id[found.query_id == q]) & set(nearest[k])) for k, q in enumerate(ask))
    assert reranked < 0.1 * len(ask) * len(v) and hits >= 0.98 * nearest.size


def test_nearest_of_awkward_vectors(spark):
    vecs = [(i, v) for i, v in enumerate(BAD)] + [(10, [1.0, 0.0, 0.0, 0.0]), (11, [2.0, 0.0, 0.0, 0.0]), (12, [2.0, 0.0, 0.0, 0.0]), (13, [0.0, 1.0, 0.0, 0.0]), (14, [1.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vecs], "vec_id long, embedding array<double>, code string")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, F.col("vec_id") == 10, 2).collect()]
    assert sorted(got) == [(10, 1, 11), (10, 2, 12)]
    assert [r.vec_id for r in ann.nearest(df, F.col("vec_id") == 10, 9).orderBy("rank").collect()] == [11, 12, 13]
    assert ann.nearest(df, F.col("vec_id") == 14, 3).count() == 0
    assert ann.nearest(df.limit(0), F.col("vec_id") == 10).count() == 0


def test_cover_tree_traversal():
    rng = np.random.default_rng(0)
    for _ in range(25):
        d, n, k = int(rng.integers(2, 6)), int(rng.integers(1, 50)), int(rng.integers(1, 50))
        base = rng.standard_normal((4, d))
        x, y = base[rng.integers(0, 4, n)] + rng.choice([0, 0.05, 0.5]) * rng.standard_normal((n, d)), base[rng.integers(0, 4, k)] + rng.choice([0, 0.1]) * rng.standard_normal((k, d))
        unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
        near = unit(x) @ unit(y).T >= 0.93
        a, b = cover_tree.CoverTree(x), cover_tree.CoverTree(y)
        left, right, _ = cover_tree.dual_traversal(a, b, 0.93, False)
        assert (left == near.sum(1)).all() and (right == near.sum(0)).all()
        own, _, names = cover_tree.dual_traversal(a, a, 0.93, True)
        alike = unit(x) @ unit(x).T >= 0.93
        np.fill_diagonal(alike, True)
        assert (own == alike.sum(1) - 1).all()


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_threshold_links(spark, sf):
    path = SF.replace("0.001", sf)
    rows = duckdb.sql(f"select vec_id, embedding, label from '{path}/embeddings.parquet'").fetchall()
    near, by = [], {}
    for i, v, label in rows:
        by.setdefault(label, []).append((i, np.array(v, float)))
    for label, own in by.items():
        v = np.stack([v for _, v in own])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(v @ v.T > 0.92, 1))
        near += [(own[x], own[y]) for x, y in zip(a.tolist(), b.tolist()) if label is not None and brute.cosine(own[x][1], own[y][1]) >= 0.93]
    names, count = brute.components({i for i, _, _ in rows}, [(x[0], y[0]) for x, y in near]), dict.fromkeys((i for i, _, _ in rows), 0)
    for x, y in near:
        count[x[0]] += 1
        count[y[0]] += 1
    assert sorted(map(tuple, queries.op7_cover_tree(spark, path).collect())) == sorted((i, count[i], names[i], names[i] == i) for i in count)


def test_links_of_awkward_vectors_and_many_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v, 1) for i, v in enumerate(BAD)]
    rows += [(100 + i, (np.eye(4)[i % 4] + 0.02 * rng.standard_normal(4)).tolist() if i % 5 else [1.0, 0.0, 0.0, 0.0], None if i % 11 == 0 else i % 2) for i in range(160)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    assert sorted(map(tuple, cover_tree.threshold_links(df, 0.93, rows=16).collect())) == brute.threshold_links(rows, 0.93)
    null = spark.createDataFrame([(None, [1.0], 1), (1, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, cover_tree.threshold_links(null).collect()), key=str) == [(1, 0, 1, True), (None, 0, None, True)]
    assert cover_tree.threshold_links(df.limit(0)).count() == 0


# documents ---------------------------------------------------------------------------------------------------------


def test_blocks_of_several_levels_hold_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((6, 8))
    rows = [(i, (centres[rng.integers(6)] + 0.4 * rng.standard_normal(8)).tolist() if i % 4 else centres[0].tolist(), i % 2) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute.threshold_links(rows, 0.93)
    assert len({r[2] for r in want}) > 20
    for pivots in (4096, 4):
        monkeypatch.setattr(cover_tree, "PIVOTS", pivots)
        monkeypatch.setattr(cover_tree, "SPREAD", 50)
        assert sorted(map(tuple, cover_tree.threshold_links(df, 0.93, rows=8).collect())) == want


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5100)]
    want = {k: v for k, v in brute.components({x for e in edges for x in e}, edges).items() if k != v}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_near_duplicates(spark, sf):
    path = SF.replace("0.001", sf)
    want = brute.near_duplicates(duckdb.sql(f"select doc_id, text from '{path}/documents.parquet'").fetchall())
    assert sorted(map(tuple, queries.op8_min_max_hashing(spark, path).collect())) == want


def test_chains_and_thresholds_of_near_duplicates(spark):
    rng = random.Random(9)
    rows, text = [], [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for i in range(60):  # each differs a little from the one before, the ends not alike at all
        rows.append((i, " ".join(text)))
        text = text[2:] + [f"w{rng.randrange(10**6)}" for _ in range(2)]
    base = [f"v{k}" for k in range(60)]
    for i in range(40):
        copy = list(base)
        for _ in range(i // 8):
            copy[rng.randrange(60)] = f"u{rng.randrange(10**6)}"
        rows.append((200 + i, " ".join(copy).upper() if i % 2 else "\n".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == brute.near_duplicates(rows)


def test_a_passage_in_all_documents_is_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(11)
    passage = " ".join(f"p{k}" for k in range(80))
    rows = [(i, passage + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(12 if i % 7 else 40))) for i in range(150)]
    rows += [(1000 + i, rows[i * 9][1] + (" tail" if i % 2 else "")) for i in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == brute.near_duplicates(rows)


def test_a_large_group_near_the_threshold(spark, monkeypatch):
    for name, size in (("BLOCK", 16), ("CELL", 8), ("SPREAD", 32), ("TEXTS", 8), ("SHINGLES", 2000)):
        monkeypatch.setattr(minhash, name, size)
    rng = random.Random(13)
    base = [f"v{k}" for k in range(200)]
    rows = []
    for i in range(240):  # copies of one text that are about 0.75 alike, some linked with few of the others
        copy = list(base)
        for _ in range(rng.choice([3, 5, 6, 7, 9])):
            copy[rng.randrange(200)] = f"u{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    want = brute.near_duplicates(rows)
    assert 1 < len({r[2] for r in want}) < 200
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == want


def test_near_duplicates_of_awkward_rows(spark):
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(awkward(spark)).collect()}
    assert {(0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 4, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False), (None, 2, None, True)} <= rows
    assert minhash.near_duplicates(awkward(spark).limit(0)).count() == 0


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(1)
    both, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (600, 200, 200))
    x, y = minhash.min_max(np.concatenate([both, a])), minhash.min_max(np.concatenate([both, b]))
    assert abs((x == y).mean() - 0.6) < 0.12


def test_shingles_follow_the_contract():
    texts = [t for t in TEXTS if t is not None] + ["Ab\x0bcd É é  x\ty z", "a\xa0b c d e f"]
    assert [len(s) for s in textbuf.shingle_sets(pa.array(texts))] == [len(brute.shingle_set(t)) for t in texts]


def test_boilerplate_lines_go(spark):
    rows = [(i, f"own line {i}\n menu \nmore own words {i}", f"site{i}") for i in range(12)] + [(50, "menu", "site1"), (51, None, "site1"), (52, "", None), (53, "menu\n\nfour five six seven", None), (None, "menu\nnull id and its own line", "site2"), (60, "rare\nwords of its own", "a"), (61, "rare\nother words", "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, n_removed string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.remove_boilerplate(df, 10).collect()}
    assert got[3] == ("own line 3\nmore own words 3", 3, 1)
    assert got[50] == ("", 1, 1) and got[51] == (None, 0, 0) and got[52] == ("", 1, 0)
    assert got[53] == ("\nfour five six seven", 3, 1) and got[None] == ("null id and its own line", 2, 1)
    assert got[60] == ("rare\nwords of its own", 2, 0)
    assert line_dedup.remove_boilerplate(df.limit(0), 10).count() == 0


def test_boilerplate_query_spares_whole_copies_only(spark):
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in queries.op9_site_spread(spark, SF.replace("0.001", "0.01")).collect()]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF.replace('0.001', '0.01')}/documents.parquet'")
    assert sorted(got) == sorted(con.execute(queries.ORACLE["op9_site_spread"]).fetchall())
    names = "k0 k1 k2 row removed copied place h1".split()
    odd = spark.createDataFrame([(i, f"menu line\nown {i}", f"s{i}", *names) for i in range(11)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    out = line_dedup.remove_boilerplate(odd, 10, spare="copies")
    assert out.columns == [*odd.columns, "n_lines", "n_removed"] and {r.text for r in out.collect()} == {f"own {i}" for i in range(11)} and {tuple(r)[3:11] for r in out.collect()} == {tuple(names)}


def test_pipeline_removes_boilerplate_whatever_its_share(spark):
    import corpus_pipeline

    menu = "\n".join(f"menu entry number {k} of the site" for k in range(4))
    rows = [(i, f"{menu}\nown {i}", f"site{i}", 0) for i in range(12)]  # nearly all boilerplate, but no copies
    rows += [(20, menu + "\n", "site1", 0), (21, menu + "\n", "site2", 0), (22, menu + "\n\n", "site3", 0)]  # a copied pair, and no copy
    rows += [(30, menu, "a", 0), (30, menu, "a", 0), (None, menu + " ", "a", 0), (None, menu + " ", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_boilerplate(spark, df, SF).collect()]
    want = [(i, f"own {i}") for i in range(12)] + [(20, menu + "\n"), (21, menu + "\n"), (22, "\n"), (30, ""), (30, ""), (None, menu + " "), (None, menu + " ")]
    assert sorted(got, key=str) == sorted(want, key=str)
    bare = [r.text for r in line_dedup.remove_boilerplate(df, spare="none").where("doc_id is null").collect()]
    assert bare == ["", ""]
    with pytest.raises(ValueError):
        line_dedup.remove_boilerplate(df, spare="share")


def test_spread_is_exact_at_the_threshold(spark):
    lines = spark.createDataFrame([(n, 0, f"s{k}") for n in (99, 100, 101, 150, 60) for k in range(n)] * 2, "h1 long, h2 long, site string")
    assert sorted(r.h1 for r in line_dedup.boilerplate_lines(lines, 100).collect()) == [100, 101, 150]


# quality -----------------------------------------------------------------------------------------------------------


def plain_features(text):
    words, shapes, prev, same = set(), set(), None, 0
    found = brute.WORD.findall(text)
    for w in found:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
        solid = lambda c: c.isascii() and c.isalnum() or not c.isascii()
        while low and not solid(low[0]):
            low = low[1:]
        while low and not solid(low[-1]):
            low = low[:-1]
        words.add(low)
        kinds = ["a" if not c.isascii() or c.islower() else "A" if c.isupper() else "9" if c.isdigit() else c for c in w]
        shapes.add("".join(k for n, k in enumerate(kinds) if n == 0 or kinds[n - 1] != k))
        same += low == prev
        prev = low
    return len(words), len(shapes), math.ceil(same / (len(found) - 1) * 5) + 1 if len(found) > 1 else 1


def test_features_count_words_shapes_and_repeats():
    texts = ["Hello, hello WORLD!! x1", "a a a a", "%%% ***", "naïve Élan\nends.", "word " * 2000 + "other"]
    assert [len(x) for x in quality.features(pa.array(texts), bits=40)] == [sum(plain_features(t)) for t in texts]
    assert [len(x) for x in quality.features(pa.array(["", None, " \n"]))] == [0, 0, 0]
    one = quality.features(pa.array(["b c", texts[0], "d"]))[1]
    assert one.tolist() == quality.features(pa.array([texts[0]]))[0].tolist()


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(8)
    row, flat = np.repeat(np.arange(30), 4), rng.integers(0, 6, 120)
    grades, params = rng.integers(0, 4, 30), rng.standard_normal(6 + 3)
    _, grad = quality.likelihood(params, flat, row, grades, 4, 0.1)
    for k in range(len(params)):
        step = np.eye(len(params))[k] * 1e-6
        slope = (quality.likelihood(params + step, flat, row, grades, 4, 0.1)[0] - quality.likelihood(params - step, flat, row, grades, 4, 0.1)[0]) / 2e-6
        assert abs(slope - grad[k]) < 1e-6


def test_fit_orders_grades():
    rows = [np.array([0, 1]), np.array([1]), np.array([0, 2]), np.array([2]), np.array([0, 1, 2]), np.array([1, 2])] * 20
    grades = np.array([2, 1, 0, 0, 2, 1] * 20)
    model = quality.fit(rows, grades, 3, bits=2, epochs=400, min_rows=1, min_z=0, decay=0)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(rows[:6])
    assert (tails[:, 0] >= tails[:, 1]).all() and tails[0, 1] > 0.8 and tails[3, 0] < 0.2


def test_quality_query_agrees_with_a_plain_fit(spark):
    rated = {i: 0 if x else 1 if q == 0 else 2 for i, q, x in duckdb.sql(f"select doc_id, quality, toxic from '{SF}/labels.parquet'").fetchall()}
    docs = dict(documents())
    found = dict(zip(docs, quality.features(pa.array(list(docs.values()), pa.string())), strict=True))
    ids = sorted(set(rated) & set(docs))
    weights, theta = brute.ordinal_fit([found[i] for i in ids], [rated[i] for i in ids], 3)
    for r in queries.op1_ordinal_quality(spark, SF).collect():
        score = sum(weights.get(x, 0.0) for x in found[r.doc_id].tolist())
        tails = [1 / (1 + math.exp(t - score)) for t in theta]
        assert np.allclose([r.tail_1, r.tail_2, r.expected_grade], [*tails, sum(tails)], atol=1e-4)
        assert r.selected == (len(found[r.doc_id]) > 0 and r.tail_2 >= 0.5)


def test_long_texts_have_the_features_of_their_parts(monkeypatch):
    texts = pa.array([LONG, None, "", "a a a b", " ".join(["x" * 500, "same", "same"] * 40), "y" * 3000])
    whole = quality.features(texts)
    monkeypatch.setattr(quality, "PART", 700)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, quality.features(texts), strict=True))


def test_held_out_grades():
    found = duckdb.sql("select text, quality, toxic from '/root/testdata/sf0.1/documents.parquet' join '/root/testdata/sf0.1/labels.parquet' using (doc_id) order by doc_id").fetchall()
    rows = quality.features(pa.array([t for t, _, _ in found]))
    grades = np.array([0 if x else 1 if q == 0 else 2 for _, q, x in found])
    model = quality.fit(rows[::2], grades[::2], 3)
    keep, held = model.tails(rows[1::2])[:, 1] >= 0.5, grades[1::2]
    assert keep[held == 2].mean() > 0.98 and keep[held == 1].mean() < 0.05 and keep[held == 0].mean() < 0.1


def test_scores_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (5, 1, 1), (8, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, quality.grades_of(labels))
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(TEXTS) + 2 and all(0 <= r.tail_2 <= r.tail_1 <= 1 for r in rows)
    assert {r.selected for r in rows if not (r.text or "").strip()} == {False}
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), quality.grades_of(labels))).count() == 0


# archives ----------------------------------------------------------------------------------------------------------


def test_warc_query(spark):
    assert sorted(map(tuple, queries.op10_seekable_warc(spark, SF).collect())) == brute.warc_rows(documents("pages", "page_id, html"))


def test_warc_of_awkward_pages(spark):
    rows = [(1, "http://a\r\nX: y", "same"), (0, None, "same"), (2, "u", None), (3, "u", ""), (4, "u", LONG), (5, "u", "WARC/1.1\r\n\r\nbody"), (6, "u", "same")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, frame string")
    index = warc.write_warc(df, scratch_path(spark, "w"))
    got = sorted(tuple(r)[:5] for r in warc.read_warc(spark, index).collect())
    assert got == brute.warc_rows([(i, t) for i, _, t in rows])
    place = index.where("page_id = 4").first()
    with warc.BundleReader(place.path) as bundle:
        record = next(warc.parse_records(bundle.record(place.frame, place.offset, place.length)))
    assert record["payload"].decode() == LONG
    late = warc.read_warc(spark, warc.write_warc(df, scratch_path(spark, "w"), min_bytes=5))
    assert {r.record_type for r in late.collect()} == {"response"}
    nulls = warc.write_warc(spark.createDataFrame([(None, "u", "same"), (7, "u", "same")], "page_id long, url string, html string"), scratch_path(spark, "w"))
    assert sorted(((r.page_id, r.refers_to) for r in warc.read_warc(spark, nulls).collect()), key=str) == [(7, None), (None, 7)]
    assert warc.read_warc(spark, warc.write_warc(df.limit(0), scratch_path(spark, "w"))).count() == 0


def test_warc_records_have_their_own_ids_and_are_fetched_by_page(spark):
    rows = [(i, f"http://x/{i}", "shared" if i % 2 else f"page {i}", "clash") for i in range(60)] + [(5, "http://x/5b", "other", "clash"), (5, "http://x/5c", "shared", "clash"), (None, None, "", "clash"), (None, None, None, "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    index = warc.write_warc(df, scratch_path(spark, "w"))
    found = warc.read_warc(spark, index).collect()
    assert sum(r.record_type == "revisit" for r in found) == 30 and {r.refers_to for r in found} == {None, 1}
    names = []
    for path in {r.path for r in index.collect()}:
        with warc.BundleReader(path) as bundle:
            names += [r["headers"]["warc-record-id"] for k in range(len(bundle.sizes)) for r in warc.parse_records(bundle.frame(k))]
    assert len(names) == len(set(names)) == len(rows)
    asked = spark.createDataFrame([(1,), (5,), (8,), (999,), (None,)], "page_id long")
    got = sorted(((r.page_id, r.record_type, r.payload and bytes(r.payload)) for r in warc.fetch(index, asked).collect()), key=lambda x: x[:2])
    assert got == sorted([(1, "response", b"shared"), (5, "revisit", None), (5, "response", b"other"), (5, "revisit", None), (8, "response", b"page 8")], key=lambda x: (x[0], x[1]))


def test_warc_records_are_read_through_the_index(spark):
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string")
    index = warc.write_warc(df, scratch_path(spark, "w"))
    assert sorted(r.page_id for r in warc.read_warc(spark, index).collect()) == list(range(20))
    one = F.col("page_id") == 7
    wrong = [index.where(~one), index.withColumn("page_id", F.when(one, 99).otherwise(F.col("page_id"))), index.withColumn("length", F.when(one, F.col("length") - 1).otherwise(F.col("length")))]
    wrong.append(index.withColumn("frame", F.when(one, 5).otherwise(F.col("frame"))))
    for bad in wrong:
        with pytest.raises(Exception, match="index|entry"):
            warc.read_warc(spark, bad).collect()


# pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    mid = "/root/testdata/sf0.01"  # with enough labels to learn from

    docs = spark.read.parquet(f"{mid}/documents.parquet")
    kept = materialize(corpus_pipeline.keep_good(spark, docs, mid), "p")
    labels = {i: (q, x) for i, q, x in duckdb.sql(f"select doc_id, quality, toxic from '{mid}/labels.parquet'").fetchall()}
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    clean, junk = [i for i, v in labels.items() if v == (1, 0)], [i for i, v in labels.items() if v[0] == 0]
    assert kept.columns == docs.columns and sum(i in ids for i in clean) >= 0.97 * len(clean) and sum(i in ids for i in junk) <= 0.1 * len(junk)
    lines = materialize(corpus_pipeline.drop_boilerplate(spark, kept, mid), "p")
    assert lines.columns == docs.columns and {r.doc_id for r in lines.collect()} == ids
    near = materialize(corpus_pipeline.drop_near_copies(spark, lines, mid), "p")
    want = {i for i, _, _, keep in brute.near_duplicates([(r.doc_id, r.text) for r in lines.collect()]) if keep}
    assert near.columns == docs.columns and sorted(r.doc_id for r in near.collect()) == sorted(want)
    rows = corpus_pipeline.run(spark, mid).collect()
    check_pieces(rows, 2048)
    assert {r.doc_id for r in rows} == want


def test_pipeline_stages_of_awkward_rows(spark):
    import corpus_pipeline

    extra = "row string, record string, component_id string, kept int, label double"
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    none = docs.where("false")
    for c in extra.split(", "):
        name, kind = c.split()
        docs, odd, none = (x.withColumn(name, F.lit("1").cast(kind)) for x in (docs, odd, none))
    both = docs.unionByName(odd).unionByName(odd)
    n_odd = odd.count()
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, both, SF)
        assert stage(spark, none, SF).count() == 0
        if name == "packing":
            rows = got.collect()
            check_pieces(rows, 2048)
            assert {r.doc_id for r in rows} == {r.doc_id for r in both.select("doc_id").collect()}
            continue
        assert got.columns == both.columns
        rows = got.collect()
        assert {(r.row, r.record, r.component_id, r.kept, r.label) for r in rows} == {("1", "1", "1", 1, 1.0)}
        if name == "quality classifier":
            assert not any(not (r.text or "").strip() for r in rows)
        elif name == "line dedup":
            assert len(rows) == both.count() and sum(r.text is None for r in rows) == 2
        else:
            assert sum(r.text is None for r in rows) == 1 and sum(r.doc_id is None for r in rows) == 2 and sum(r.text == LONG for r in rows) == 1
    assert n_odd == len(TEXTS) + 2
    short = docs.select("doc_id", "text", "source")
    assert corpus_pipeline.drop_boilerplate(spark, short, SF).columns == short.columns


def test_near_copies_go_by_row(spark):
    import corpus_pipeline

    rng = random.Random(13)
    words = lambda: [f"w{rng.randrange(10**6)}" for _ in range(60)]
    a, b, c, d, e = (" ".join(words()) for _ in range(5))
    rows = [(5, a), (5, b), (3, b), (7, c), (7, d), (6, d + " tail"), (8, e), (8, e), (None, e), (None, e), (9, None), (9, None), (None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string")
    got = corpus_pipeline.drop_near_copies(spark, df, SF)
    want = [(5, a), (3, b), (7, c), (6, d + " tail"), (8, e), (None, e), (None, e), (9, None), (None, None)]
    assert got.columns == df.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_batches_are_bounded_whatever_the_setting(spark):
    from eventweave.llm.scratch import small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    for given, then in (("64m", {"4194304", "4194304b"}), ("1m", {"1m", "1048576b"})):
        spark.conf.set(key, given)
        small_batches(spark)
        assert spark.conf.get(key) in then
    spark.conf.set(key, before)
