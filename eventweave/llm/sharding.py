"""Sharding by sampled splitters.

Keys are sampled with a chance in proportion to the size of their records, so quantiles of the sample cut the
corpus into key ranges of about equal bytes. Exact totals of all ranges follow; a range that turns out overfull is
subdivided by splitters from a denser sample of its own keys, until no range of several keys is overfull. There are many more ranges than shards. With the exact bytes before each range,
a task that sorts its ranges knows the place of every record among all bytes, and the shard
follows from that place: shards are consecutive key ranges of equal bytes to within one record.

The key is (text hash, doc_id): equal texts lie next to each other, and a group of copies larger than a range is cut by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventweave.llm.scratch import discard, materialize, shuffle_partitions, small_batches

#: Ranges for each shard at least, bytes of a range at most about, sampled keys for each range, and bytes that a task sorts on average at most.
RANGES_PER_SHARD, RANGE_BYTES, KEYS_PER_RANGE, TASK_BYTES = 16, 128 << 20, 8, 128 << 20
#: A range is overfull beyond this multiple of an even share.
OVERFULL = 2.0


def packed_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Two signed 64-bit columns as 16-byte strings of the same order."""
    out = np.empty((len(first), 2), ">u8")
    out[:, 0] = first.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    out[:, 1] = second.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.view("S16").ravel()


def with_range(keyed: DataFrame, splitters: np.ndarray, only: np.ndarray | None = None, task: np.ndarray | None = None) -> DataFrame:
    """keyed with the number of splitters at or below its (k1, k2) as ``range``; rows of the ranges ``only``, if given, and with what ``task`` holds for their range."""
    names, new = keyed.columns, ["range"] if task is None else ["range", "task"]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = packed_keys(batch.column("k1").to_numpy(zero_copy_only=False), batch.column("k2").to_numpy(zero_copy_only=False))
            ranges = np.searchsorted(splitters, keys, side="right").astype(np.int64)
            made = [pa.array(ranges)] if task is None else [pa.array(ranges), pa.array(task[ranges])]
            out = pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, *new])
            yield out if only is None else out.filter(pa.array(np.isin(ranges, only)))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema), "range long", "task int"][: len(names) + len(new)])
    return keyed.mapInArrow(locate, schema)


def _sampled(keys: DataFrame, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys kept with chance min(1, size * rate), and the size that each stands for. A hash decides, so retries agree."""
    chance = F.col("size") * F.lit(rate)
    draw = F.pmod(F.xxhash64("k1", "k2", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = keys.where(draw < chance).select("k1", "k2", F.greatest(F.col("size").cast("double"), F.lit(1 / rate)).alias("w")).toArrow()
    found = packed_keys(rows["k1"].to_numpy(), rows["k2"].to_numpy())
    order = np.argsort(found, kind="stable")
    return found[order], rows["w"].to_numpy()[order]


def _quantiles(keys: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    """Those of the sorted keys that cut them into parts of equal weight; at most parts - 1, all different."""
    if not len(keys) or parts < 2:
        return np.zeros(0, "S16")
    upto = np.cumsum(weights)
    return np.unique(keys[np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts)])


def splitters(keys: DataFrame, total: int, n_ranges: int, seed: int = 7) -> np.ndarray:
    """Boundaries of about n_ranges ranges of (k1, k2, size) rows with equal bytes.

    The driver gets about n_ranges * KEYS_PER_RANGE keys of 24 bytes in the first round, whatever the number of rows, and fewer in each one after it: at 100 TB,
    800,000 ranges and 6.4 million keys, of which the splitters, 13 MB, go to the tasks. Rounds end when only ranges of a single key are overfull; each cuts every other overfull range.
    """
    share = max(1.0, total / n_ranges)
    found = _quantiles(*_sampled(keys, KEYS_PER_RANGE / share, seed), n_ranges)
    for extra in count(1):
        sizes = with_range(keys, found).groupBy("range").agg(F.sum("size").alias("size"), F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi"))
        over = sizes.where((F.col("size") > OVERFULL * share) & (F.col("lo") != F.col("hi"))).select("range", "size", "hi.k1", "hi.k2").toArrow().sort_by("range")  # n_ranges / OVERFULL rows at most
        if not len(over):
            return found
        ranges, high = over["range"].to_numpy(), packed_keys(over["k1"].to_numpy(), over["k2"].to_numpy())
        dense, weights = _sampled(with_range(keys, found, ranges).select("k1", "k2", "size"), KEYS_PER_RANGE * 2 / share, seed + extra)
        place = np.searchsorted(found, dense, side="right")
        begin, end = np.searchsorted(place, ranges), np.searchsorted(place, ranges, side="right")
        # the largest key of a range parts it from the others if the sample doesn't
        new = [_quantiles(dense[a:b], weights[a:b], 1 + int(size / share)) for a, b, size in zip(begin, end, over["size"].to_pylist(), strict=True)]
        found = np.unique(np.concatenate([found, high, *new]))


def shard_at(total: int, n_shards: int) -> F.Column:
    """The shard of the record whose middle is ``begin`` + ``size`` / 2 of total bytes. Products of places and shards can pass 64 bits, so they are decimals."""
    return F.least(F.lit(n_shards - 1), F.expr(f"cast(cast(begin + size div 2 as decimal(19,0)) * cast({n_shards} as decimal(10,0)) div cast({max(1, total)} as decimal(19,0)) as int)"))


def shard_by_splitters(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """docs with ``shard`` (0 to n_shards - 1), ``slot`` (gapless from 0 in each shard) and ``shard_bytes_at``, stored.

    A record's size is its UTF-8 bytes (none for a null text, all of a very long one) and ``overhead``. Shards differ in bytes by about one record at most. Null ids
    sort first; rows that are equal in key are cut like others, since places and not keys decide, but one task places them all. No rows: an empty result. Columns of
    docs that are named like the three new ones are replaced.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("shard", "slot", "shard_bytes_at")]
    size = (F.coalesce(F.octet_length(docs[text_col].cast("string")), F.lit(0)) + F.lit(overhead)).cast("long")
    id_key = docs[id_col].cast("long") if dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(docs[id_col])
    record = docs.select(F.xxhash64(docs[text_col]).alias("k1"), F.coalesce(id_key, F.lit(-(2**63))).alias("k2"), size.alias("size"), F.struct(*[docs[c] for c in names]).alias("record"))
    keys = materialize(record.select("k1", "k2", "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    cuts = splitters(keys, total, max(n_shards * RANGES_PER_SHARD, -(-total // RANGE_BYTES)))
    sizes = with_range(keys, cuts).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    # 24 bytes a range come to the driver and go to the tasks that place records
    at = sizes.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("r")).toArrow()
    first_byte, first_row = np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1, np.int64)
    discard(keys)
    first_byte[at["range"].to_numpy()], first_row[at["range"].to_numpy()] = at["b"].to_numpy(), at["r"].to_numpy()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, byte, row = -1, 0, 0  # the range at hand, and its bytes and rows so far
        for batch in batches:
            n = batch.num_rows
            ranges, sizes = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("range", "size"))
            lead = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])) if n else np.zeros(0, np.int64)
            upto = np.cumsum(sizes) - sizes
            start = np.repeat(lead, np.diff(np.append(lead, n)))
            begin, rank = first_byte[ranges] + upto - upto[start], first_row[ranges] + np.arange(n) - start
            if n and ranges[0] == last:  # goes on from the batch before
                begin[start == 0] += byte
                rank[start == 0] += row
            if n:
                last, byte, row = int(ranges[-1]), int(begin[-1] + sizes[-1] - first_byte[ranges[-1]]), int(rank[-1] + 1 - first_row[ranges[-1]])
            yield pa.RecordBatch.from_arrays([batch.column("record"), pa.array(begin), pa.array(rank), batch.column("size")], ["record", "begin", "rank", "size"])

    kind = record.schema["record"].dataType.simpleString()
    # each task gets ranges that follow each other and have even bytes together
    tasks = max(shuffle_partitions(docs.sparkSession), -(-total // TASK_BYTES))
    task = np.minimum(first_byte.astype(np.float64) * tasks / max(1, total), tasks - 1).astype(np.int32)
    dealt = with_range(record, cuts, task=task).repartitionById(tasks, "task").sortWithinPartitions("range", "k1", "k2")
    placed = dealt.mapInArrow(place, f"record {kind}, begin long, rank long, size long")
    shard = shard_at(total, n_shards).alias("shard")
    stored = materialize(placed.select("record", shard, "rank", "begin"), "shards")
    first = stored.groupBy("shard").agg(F.min("rank").alias("first_rank"))  # n_shards rows
    return stored.join(F.broadcast(first), "shard").select("record.*", "shard", (F.col("rank") - F.col("first_rank")).alias("slot"), F.col("begin").alias("shard_bytes_at"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its records in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
