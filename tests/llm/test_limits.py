"""Arithmetic beyond 64 bits, and searches whose bounds let nothing through."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventweave.llm import ann, packing, scratch, sharding


def plain_served(schedule, queue, rounds):
    share = Fraction(int(schedule.units[queue]), schedule.base)
    return min(int(schedule.total[queue]), int(schedule.window * share * rounds / schedule.grain) * schedule.grain)


@pytest.mark.parametrize("totals", [[6e13, 4e13], [1e15, 3e14, 5], [2.0**51, 1, 0]])
@pytest.mark.parametrize("weights", [None, [1.0, 1e-6, 1e-6]])
@pytest.mark.parametrize("grain", [1, 16])
def test_schedules_are_exact_at_any_size(totals, weights, grain):
    totals = np.array(totals)
    weight = totals if weights is None else np.array(weights[: len(totals)])
    schedule = packing.Schedule(totals, weight, 2048, grain)
    for queue, total in enumerate(totals.astype(int).tolist()):
        for place in {0, total // 3, total - 1} if total else ():
            turn = int(schedule.round_of(np.array([queue]), np.array([place]))[0])
            assert 0 <= turn
            before, after = (int(schedule.served(np.array([r]))[0, queue]) for r in (turn, turn + 1))
            assert before == plain_served(schedule, queue, turn) and after == plain_served(schedule, queue, turn + 1)
            assert before <= place < after or after == total


def test_a_schedule_that_cannot_be_exact_is_refused():
    with pytest.raises(ValueError, match="64 bits"):
        packing.Schedule(np.array([2.0**60, 1]), np.array([1.0, 1.0]), 2048, 1)


def test_many_shards_of_many_bytes(spark):
    total, n = 10**14, 10**6
    rows = spark.createDataFrame([(b, 1000) for b in (0, 10**8 - 501, 10**8 - 500, 9 * 10**13, total - 1000)], "begin long, size long")
    assert [r[0] for r in rows.select(sharding.shard_at(total, n)).collect()] == [0, 0, 1, 900_000, n - 1]


def test_every_query_gets_its_rows_whatever_the_bounds(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((2100, 24))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    index = scratch.materialize(ann.build_codes(df), "codes")
    found = ann.search(index, index.where(F.col("vec_id") % 50 == 0), 5, epsilon=0.0).collect()
    assert len(found) == 42 * 5 and len({(r.query_id, r.vec_id) for r in found}) == len(found)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for r in found:
        assert abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-12


def test_shared_folders_on_s3_have_an_arrow_file_system(monkeypatch):
    asked = []
    seen = type("Fs", (), {"FileSystem": type("F", (), {"from_uri": staticmethod(lambda uri: asked.append(uri))})})
    monkeypatch.setattr(scratch, "pafs", seen)
    for uri in ("s3a://bucket/x", "s3n://bucket/x", "s3://bucket/x", "file:/x", "hdfs://h/x"):
        scratch.filesystem(uri)
    assert asked == ["s3://bucket/x"] * 3 + ["file:///x", "hdfs://h/x"]
