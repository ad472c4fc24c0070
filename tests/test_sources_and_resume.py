"""Files of mixed formats, index snapshots, image containers, scoped search and streams that resume by id."""

from __future__ import annotations

import json
import struct
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventweave.functions import images
from eventweave.operators import vectors
from eventweave.plans.corpora import _PIXELS
from eventweave.sources import files, sinks, snapshots
from eventweave.streaming import resume


def folder(tmp_path, **texts):
    root = tmp_path / "c [x]"
    root.mkdir()
    for name, text in texts.items():
        (root / name.replace("_", ".")).write_text(text)
    return str(root).replace("[", "\\[").replace("]", "\\]")


def test_each_file_is_read_by_its_own_format(spark, tmp_path):
    path = folder(tmp_path, a_json='{"records":[{"x":1},{"x":2}]}', b_json='{"x":3}\n{"x":4}\n', c_json='[{"x":5}]', d_jsonl='\n{"x":6}', e_json='\n\t{\n"records": \n[\n{"x":7}]\n}', f_json="", g_json='\n{"x":8}\n', h_json='\t\n [ {"x":9}]', i_json='\t{"x":10}\n\t\n {"x":11}')
    assert sorted(r.x for r in files.read_json_documents(spark, path, "x int", "corpus").collect()) == list(range(1, 12))
    with pytest.raises(ValueError):
        files.read_json_documents(spark, path, "x int", "corpus", fall_back=False)


def test_a_whole_file_is_not_parsed_again_for_each_element(spark, tmp_path):
    path = folder(tmp_path, a_json='{"records":[{"x":1},{"x":2}]}', b_json='{"records":[{"x":3}')
    plan = files.parsed_records(spark, path, "corpus")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    listed = next(i for i, line in enumerate(plan) if "Generate posexplode" in line)
    assert not [line for line in plan[:listed] if "text#" in line]


def test_bad_rows_are_set_aside_with_their_places(spark, tmp_path):
    texts = {"a_json": '{"records":[{"x":1}, 7, "s"]}', "b_json": '[8]\n{"x":2}\n\nbad\t{\n{"x":3} {"x":4}\n', "c_json": "[1, 2", "d_jsonl": 'x\n{"x":5}\n5\n', "e_json": '{"x":6} trailing', "f_json": "1, 2", "g_json": "1], [2"}
    path = folder(tmp_path, **texts)
    records, bad = files.read_with_quarantine(spark, path, "x int", "corpus")
    assert sorted(r.x for r in records.collect()) == [1, 2, 5]
    rows = {(r.file.rsplit("/", 1)[-1][0], r.line, r.reason) for r in bad.collect()}
    no, other = files.NOT_JSON, files.NOT_AN_OBJECT
    assert rows == {("a", 2, other), ("a", 3, other), ("b", 1, other), ("b", 4, no), ("b", 5, no), ("c", 1, no), ("d", 1, no), ("d", 3, other), ("e", 1, no), ("f", 1, no), ("g", 1, no)}
    sinks.write_quarantine(bad, str(tmp_path / "q"))
    again = spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "q"))
    assert sorted(map(str, (r.value for r in again.collect()))) == sorted(str(r.value).replace("\t", "\\t").replace("\n", "\\n") for r in bad.collect())
    whole = {(r.line, r.reason) for r in files.read_with_quarantine(spark, path, "x int", "samples")[1].collect()}
    assert (0, no) in whole


def test_line_numbers_go_on_over_splits(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text("".join(f'{{"x":{i}}}\n' if i % 10 else ("\n" if i % 20 else f"bad{i}\n") for i in range(200)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        records, bad = files.read_with_quarantine(spark, str(tmp_path / "h.jsonl"), "x int")
        assert records.count() == 180
        assert sorted((r.line, r.value) for r in bad.collect()) == [(i + 1, f"bad{i}") for i in range(0, 200, 20)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_vision_readers(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"jump_1.jpg": {"verb": "jump", "frames": [{"agent": "n1", "place": ""}, {"agent": "n2", "place": "n3"}], "bb": {"agent": [1, 2, 3, 4], "place": [-1, -1, -1, -1]}}, "b.jpg": {"verb": "sit", "frames": [], "bb": {}}}))
    got = {r.image: (r.verb, r.frame_length, [tuple(x) for x in r.roles]) for r in files.read_situations(spark, str(tmp_path / "t.json")).collect()}
    assert got == {"jump_1": ("jump", 1, [("agent", "n1", True), ("place", "", False)]), "b": ("sit", -1, [])}
    (tmp_path / "c.csv").write_text("person,0\ncar,1\n")
    (tmp_path / "l.txt").write_text("a.jpg\n\n b.jpg \n")
    assert [tuple(r) for r in files.read_class_list(spark, str(tmp_path / "c.csv")).collect()] == [("person", 0), ("car", 1)]
    assert [r.image for r in files.read_image_list(spark, str(tmp_path / "l.txt")).collect()] == ["a.jpg", "b.jpg"]


# snapshots ------------------------------------------------------------------------------------------------------------


def rows_of(spark, first, n, dims=2):
    return spark.createDataFrame([(first + i, [1.0] * dims) for i in range(n)], "row long, embedding array<float>")


def ids_of(spark, root):
    return sorted(r.row for r in files.load_index(spark, root).collect())


def test_a_name_is_taken_once(spark, tmp_path):
    path = str(tmp_path / "x" / "1.json")
    with ThreadPoolExecutor(6) as pool:
        won = list(pool.map(lambda i: snapshots.create_once(spark, path, f"{i}"), range(6)))
    assert sum(won) == 1 and (tmp_path / "x" / "1.json").read_text() == str(won.index(True))
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["1.json"]


def test_two_writers_keep_both_parts(spark, tmp_path):
    root = str(tmp_path / "ix")
    sinks.save_index(rows_of(spark, 0, 2), root)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: sinks.add_to_index(rows_of(spark, 10 * i, 2), root), range(1, 5)))
    assert ids_of(spark, root) == [0, 1, 10, 11, 20, 21, 30, 31, 40, 41]
    assert snapshots.numbers(spark, root) == [1, 2, 3, 4, 5]
    assert sinks.compact_index(spark, root) and len(files.read_manifest(spark, root)["parts"]) == 1
    assert len(ids_of(spark, root)) == 10 and len([p for p in (tmp_path / "ix").iterdir() if p.name.startswith("vectors")]) == 1
    assert not sinks.compact_index(spark, root)


def test_a_commit_starts_anew_from_a_faster_writer(spark, tmp_path):
    root, seen = str(tmp_path / "ix"), []

    def change(now):
        seen.append(now)
        if len(seen) == 1:
            snapshots.commit(spark, root, lambda _: {"parts": ["other"]})
        return {"parts": [*(now or {"parts": []})["parts"], "own"]}

    assert snapshots.commit(spark, root, change) == (2, {"parts": ["other", "own"]})
    assert seen == [None, {"parts": ["other"]}]


def test_joining_parts_spares_what_others_do(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "ix")
    sinks.save_index(rows_of(spark, 0, 1), root)
    sinks.add_to_index(rows_of(spark, 1, 1), root)
    checked = sinks._checked

    def meanwhile(action):
        def run(*args):
            monkeypatch.setattr(sinks, "_checked", checked)
            out = checked(*args)
            action()
            return out

        monkeypatch.setattr(sinks, "_checked", run)

    meanwhile(lambda: sinks.add_to_index(rows_of(spark, 7, 1), root))
    assert sinks.compact_index(spark, root) and ids_of(spark, root) == [0, 1, 7]
    meanwhile(lambda: sinks.save_index(rows_of(spark, 9, 2), root))
    assert not sinks.compact_index(spark, root) and ids_of(spark, root) == [9, 10]
    meanwhile(lambda: sinks.save_index(rows_of(spark, 9, 2, dims=3), root))
    with pytest.raises(ValueError, match="3 dimensions"):
        sinks.add_to_index(rows_of(spark, 1, 1), root)


def test_older_snapshots_stay_as_long_as_asked(spark, tmp_path):
    root = str(tmp_path / "ix")
    (tmp_path / "ix").mkdir()
    rows_of(spark, 0, 3).write.parquet(f"{root}/vectors-old")
    (tmp_path / "ix" / "build_info.json").write_text(json.dumps({"record_count": 3, "embedding_dim": 2, "parts": ["vectors-old"]}))
    assert ids_of(spark, root) == [0, 1, 2]
    sinks.add_to_index(rows_of(spark, 5, 1), root)
    assert ids_of(spark, root) == [0, 1, 2, 5]
    sinks.save_index(rows_of(spark, 8, 1), root, keep=2)
    assert ids_of(spark, root) == [8] and files.load_index(spark, root, 1).count() == 4
    snapshots.expire(spark, root)
    assert snapshots.numbers(spark, root) == [2] and not (tmp_path / "ix" / "vectors-old").exists()


# images ---------------------------------------------------------------------------------------------------------------

PNG, JPEG, GIF, WEBP, BMP = (bytes.fromhex(x) for x in _PIXELS)


@pytest.mark.parametrize("data", [PNG, JPEG, GIF, WEBP, BMP])
def test_an_image_is_whole_or_named_for_its_fault(data):
    assert images.fault(data) is None and images.fault(data + b"tail") is None
    cuts = {images.fault(data[:n]) for n in range(12, len(data))}
    assert cuts == {images.TRUNCATED}
    assert images.fault(data[1:]) == images.fault(b"") == images.fault(None) == images.UNKNOWN


def test_damage_inside_is_seen():
    for at in range(8, len(PNG)):
        assert images.fault(PNG[:at] + bytes([PNG[at] ^ 1]) + PNG[at + 1 :]) in (images.DAMAGED, images.TRUNCATED)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    assert images.fault(PNG[:33] + chunk(b"IEND", b"")) == images.DAMAGED  # no pixels
    assert images.fault(PNG[:8] + PNG[33:]) == images.DAMAGED  # no header
    assert images.fault(JPEG[:20] + b"\x00" + JPEG[21:]) == images.DAMAGED
    assert images.fault(JPEG[:2] + b"\xff\xd9") == images.DAMAGED  # ends before a frame
    assert images.fault(JPEG.replace(b"\x37\xff\x00\xff\xd9", b"\x37\xff\xd1\x11\xff\x00\xff\xff\xd9")) is None  # restarts and fill bytes
    assert images.fault(GIF[:19] + b"\x00" + GIF[20:]) == images.DAMAGED
    assert images.fault(GIF[:27] + b"\x3b") == images.DAMAGED  # no image
    assert images.fault(WEBP[:20] + b"\x00" + WEBP[21:]) == images.DAMAGED
    assert images.fault(BMP[:28] + b"\x07" + BMP[29:]) == images.DAMAGED
    assert images.fault(BMP[:22] + b"\x09" + BMP[23:]) == images.TRUNCATED  # more rows than pixels


# search and streams ---------------------------------------------------------------------------------------------------


def test_scoped_search_agrees_with_plain_ranking(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((700, 6)).round(2)
    scope = [None if i % 11 == 0 else " " if i % 13 == 0 else f"t{i % 4}" for i in range(700)]
    corpus = spark.createDataFrame([(i, s, x.tolist()) for i, (s, x) in enumerate(zip(scope, v, strict=True))] + [(900, "t1", None), (901, "t1", [float("nan")] * 6)], "row long, kind string, embedding array<double>")
    kinds = ["t0", "t1", " t1 ", "", None, "t9"]
    asked = spark.createDataFrame([(i, k, v[i].tolist()) for i, k in enumerate(kinds)], "query_id long, kind string, embedding array<double>")
    found = vectors.scoped_top_k(asked, corpus, 4, "query_id", "row", "embedding", "embedding", "kind").collect()
    for i, kind in enumerate(kinds):
        rows = [j for j in range(700) if not (kind or "").strip() or (scope[j] or "").strip() == kind.strip()]
        want = sorted(rows, key=lambda j: (-float(v[i] @ v[j]), j))[:4]
        assert [r.row for r in sorted((r for r in found if r.query_id == i), key=lambda r: r["rank"])] == want


def test_an_id_is_evaluated_once_over_files_runs_and_errors(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    put = lambda ids: spark.createDataFrame([(i,) for i in ids], "id string").coalesce(1).write.mode("append").json(src)
    results, errors = (spark.createDataFrame([(i,) for i in ids], "id string") for ids in (["z", None], ["y", ""]))

    def run(**how):
        resume.evaluate_new(spark, src, "id string", lambda d: d, out, ck, 1, "id", [results, errors], **how).awaitTermination()
        return sorted(str(r.id) for r in spark.read.parquet(out).collect())

    put(["a", "b", "a", None, "z", " b "])
    put(["a", "c", "", None, "y"])
    assert [x.strip() for x in run()] == ["", "None", "None", "a", "b", "c"]
    put(["c", "d", "a", None])
    assert [x.strip() for x in run()] == ["", "None", "None", "None", "a", "b", "c", "d"]


def test_samples_that_are_not_asked_for_keep_their_keys(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    put = lambda *rows: spark.createDataFrame(rows, "id string, ready boolean").coalesce(1).write.mode("append").json(src)
    for rows in ([("a", False), ("b", True)], [("a", True), ("b", True)]):
        put(*rows)
        resume.evaluate_new(spark, src, "id string, ready boolean", lambda d: d, out, ck, key="id", where=F.col("ready")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b"]
