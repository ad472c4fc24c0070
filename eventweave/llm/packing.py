"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of tokens in document order. In every round a queue earns its share of one window,
spends the whole tokens of what it has earned, and carries the rest as its deficit. A queue that runs dry leaves its
turns to the others. The served tokens follow each other without gaps and are cut into windows, so only the last
window can need padding. Documents are cut freely, so no queue is ever more than a token behind its share, and a window is off a round by what all queues
carry: a token for each of them at most.

What queue s has been given before round r is ``A_s(r) = min(T_s, g * floor(L * a_s * r / (b * g)))`` for a window of
L tokens, share a_s / b, grain g (1 here) and T_s tokens in all: the deficits up to any round are known without
replaying the rounds before it, so partitions place their own documents alone and still agree on every window.

More than GROUPS sources are served in two levels: sources are dealt to GROUPS queues by hash, and inside its queue each source
is a queue again, with its own share of what the queue is given, in whole grains of several tokens and in rounds of about a grain a source, so that documents
aren't cut into single tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventweave.llm.pretokens import id_width, library_encoder
from eventweave.llm.scratch import discard, filesystem, materialize, scratch_path, small_batches
from eventweave.llm.textbuf import binary_cells, text_chunks

#: Shares are multiples of about 1 / 2**18.
SHARE_UNITS = 1 << 18
#: Tokens in all that 64 bits hold places of, with products taken in parts.
MOST_TOKENS = 1 << 52
#: Queues of the outer level, whose schedule every task holds.
GROUPS = 4096
_TOKENS = "doc_id long, queue string, source string, ids binary, n_tokens long, local_start long, local_rank long, part long"


class Schedule:
    """Closed form of the rounds of queues with the given tokens and weights."""

    def __init__(self, total: np.ndarray, weight: np.ndarray, window: int, grain: int):
        self.total = np.asarray(total, np.int64)
        share = weight / weight.sum() if weight.sum() > 0 else np.full(len(weight), 1 / max(1, len(weight)))
        self.units = np.maximum(1, np.rint(share * SHARE_UNITS)).astype(np.int64)
        self.base = int(self.units.sum())
        self.window, self.grain = window, grain
        tokens = sum(map(int, self.total))
        if tokens > MOST_TOKENS or window * int(self.units.max(initial=1)) * self.base * grain >= 1 << 62:
            raise ValueError(f"a schedule of {tokens} tokens, {len(self.total)} queues and windows of {window} doesn't fit 64 bits")

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """A_s(r) for all queues (columns) and the given rounds (rows)."""
        gain, need = self.window * self.units[None, :], self.base * self.grain
        # gain * rounds // need, the rounds in whole multiples of need and a rest
        many, rest = np.divmod(rounds[:, None], need)
        many = np.minimum(many, self.total[None, :] // (gain * self.grain) + 1)  # beyond that a queue is dry
        earned = (gain * many + gain * rest // need) * self.grain
        return np.minimum(self.total[None, :], earned)

    def round_of(self, queue: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The round in which a queue's token is served."""
        need, gain = self.base * self.grain, self.window * self.units[queue]
        many, rest = np.divmod(position // self.grain + 1, gain)
        return need * many - (-need * rest // gain) - 1

    def turns(self, queue: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For documents at the given places of their queues: (document, start in it, length, position among all that is served) of what each round takes."""
        first, last = self.round_of(queue, start), self.round_of(queue, start + length - 1)
        count = last - first + 1
        doc = np.repeat(np.arange(len(queue)), count)
        rounds = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[doc]
        found, back = np.unique(rounds, return_inverse=True)
        lo_at, hi_at, at = (np.empty(len(rounds), np.int64) for _ in range(3))
        order = np.argsort(back, kind="stable")
        step = max(1, (1 << 20) // len(self.units))
        for k in range(0, len(found), step):  # a block of rounds at a time
            part = order[np.searchsorted(back, k, sorter=order) : np.searchsorted(back, k + step, sorter=order)]
            now, then = self.served(found[k : k + step]), self.served(found[k : k + step] + 1)
            turn = np.cumsum(then - now, axis=1) - (then - now) + now.sum(axis=1)[:, None]
            row, col = back[part] - k, queue[doc[part]]
            lo_at[part], hi_at[part], at[part] = now[row, col], then[row, col], turn[row, col]
        a = np.maximum(start[doc], lo_at)
        b = np.minimum(start[doc] + length[doc], hi_at)
        keep = b > a
        doc, a, b, at = doc[keep], a[keep], b[keep], (at + a - lo_at)[keep]
        return doc, a - start[doc], b - a, at

    def pieces(self, queue: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """turns(), cut at the ends of windows."""
        doc, a, size, at = self.turns(queue, start, length)
        b = a + size
        windows = (at + b - a - 1) // self.window - at // self.window + 1
        row = np.repeat(np.arange(len(doc)), windows)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        left = np.maximum(at[row], (at[row] // self.window + nth) * self.window)
        right = np.minimum(at[row] + (b - a)[row], (at[row] // self.window + nth + 1) * self.window)
        return doc[row], a[row] + left - at[row], right - left, left


class TwoLevels:
    """The schedule of groups of sources, and inside each group that of its sources. A group of one source is served as that source.

    Groups are in memory, GROUPS at most. The sources of groups with several are read from a stored table when a task comes to the group.
    """

    def __init__(self, groups: list, totals: np.ndarray, weights: np.ndarray, sizes: np.ndarray, path: str | None, window: int, grain: int):
        """Tokens, weight and number of sources of each group; path: the table (queue, source, n, w) of the sources of groups with several."""
        self.place, self.names = {g: k for k, g in enumerate(groups)}, groups
        self.sizes, self.path, self.grain, self.window = sizes, path, grain, window
        self.outer = Schedule(totals, weights, window, 1)
        self._inner: tuple[int, Schedule] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_inner": None}

    def inner(self, group: int) -> Schedule:
        """The schedule inside a group; the last one is kept, since tasks read documents in the order of groups."""
        if self._inner is None or self._inner[0] != group:
            files, path = filesystem(self.path)
            own = ds.dataset(path, filesystem=files, format="parquet", exclude_invalid_files=False).to_table(columns=["source", "n", "w"], filter=ds.field("queue") == self.names[group])
            own = own.sort_by([("source", "ascending")])
            # nulls first, as in the queues
            order = np.argsort(~own["source"].is_null().to_numpy(zero_copy_only=False), kind="stable")
            turn = min(self.window, self.grain * len(own))
            self._inner = group, Schedule(own["n"].to_numpy()[order], own["w"].to_numpy()[order], turn, self.grain)
        return self._inner[1]

    def pieces(self, group: np.ndarray, rank: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For documents at the given places of their sources: (document, start in it, length, global position) of pieces, by document and start."""
        found = []
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            if self.sizes[g] == 1:
                found.append((rows, np.zeros(len(rows), np.int64), length[rows], start[rows]))
            else:
                doc, a, size, at = self.inner(g).turns(rank[rows], start[rows], length[rows])
                # what one turn ends with and the next begins with may follow each other in the group
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + size[:-1])
                lead = np.flatnonzero(new)
                found.append((rows[doc[lead]], a[lead], np.add.reduceat(size, lead) if len(lead) else size, at[lead]))
        doc, a, size, at = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        piece, skip, cut, position = self.outer.pieces(group[doc], at, size)
        order = np.lexsort(((a[piece] + skip), doc[piece]))
        piece, skip, cut, position = piece[order], skip[order], cut[order], position[order]
        return doc[piece], a[piece] + skip, cut, position


def queue_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 1, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", max_queues: int | None = None) -> DataFrame:
    """Encode whole texts and lay them out as queues: a stored table with each document's place in its queue's part.

    Rows are range-partitioned on (queue, source, id, text hash): a hot source is spread over many partitions. Every document ends with ``end_id``;
    null and empty texts hold only that, and very long ones are cut by windows like others. Repeated rows are documents of their own, rows without an id come first, and other columns are
    ignored, whatever their names. A null source is a source of its own. At any number of sources each keeps its share and name. Only a caller
    that gives ``max_queues`` has more sources than that merged by hash into that many, named 'queue N'; pack() then takes no targets by source.
    """
    small_batches(docs.sparkSession)
    width = id_width(tokenizer_path)
    source = docs[source_col].cast("string")

    def more_than(n: int) -> bool:
        return docs.select(source.alias("q")).distinct().limit(n + 1).count() > n

    def dealt(n: int) -> F.Column:
        return F.concat(F.lit("queue "), F.pmod(F.xxhash64(source), F.lit(n)).cast("string"))

    if max_queues is not None and more_than(max_queues):
        source = dealt(max_queues)
    queue = dealt(GROUPS) if more_than(GROUPS) else source

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part_no = library_encoder(tokenizer_path), TaskContext.get().partitionId()
        at_queue, at_source, rank, given = (), (), 0, 0  # the source at hand, its number among its queue's in this part, and its tokens so far
        for batch in batches:
            for part in text_chunks(batch, "text", 2 << 20):
                ids, bounds = encoder.encode(part.column("text"))
                sizes = np.diff(bounds) + 1
                full = np.insert(ids, bounds[1:], end_id).astype(f"<u{width}")
                starts, ranks = [], []
                for q, s, n in zip(part.column("queue").to_pylist(), part.column("source").to_pylist(), sizes.tolist(), strict=True):
                    if q != at_queue:
                        at_queue, at_source, rank, given = q, s, 0, 0
                    elif s != at_source:
                        at_source, rank, given = s, rank + 1, 0
                    starts.append(given)
                    ranks.append(rank)
                    given += n
                cells = binary_cells(full, np.append(0, np.cumsum(sizes)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("queue"), part.column("source"), cells, pa.array(sizes), pa.array(starts, pa.int64()), pa.array(ranks, pa.int64()), pa.array([part_no] * len(starts), pa.int64())],
                    ["doc_id", "queue", "source", "ids", "n_tokens", "local_start", "local_rank", "part"],
                )

    keyed = docs.select(docs[id_col].cast("long").alias("doc_id"), queue.alias("queue"), source.alias("source"), docs[text_col].cast("string").alias("text"))
    ordered = keyed.repartitionByRange("queue", "source", "doc_id", F.xxhash64("text")).sortWithinPartitions("queue", "source", "doc_id", "text")
    return materialize(ordered.mapInArrow(encode, _TOKENS), "queues")


def two_levels(tokens: DataFrame, window: int, grain: int, targets: dict | None) -> TwoLevels:
    """The schedule of the sources in tokens: three numbers a group come to the driver, GROUPS groups at most unless the queues are the caller's own."""
    sums = tokens.groupBy("queue", "source").agg(F.sum("n_tokens").alias("n"))
    weight = F.col("n").cast("double")
    if targets:
        given = tokens.sparkSession.createDataFrame([(q, float(w)) for q, w in targets.items()], "target string, weight double")
        sums, weight = sums.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("target")), "left"), F.coalesce("weight", F.lit(0.0))
    sums = materialize(sums.select("queue", "source", "n", weight.alias("w")), "sources")
    rows = sums.groupBy("queue").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("size")).orderBy("queue").toArrow()
    weights = rows["w"].to_numpy()
    if targets and len(weights) and not weights.sum() > 0:
        raise ValueError("no target has the name of a source of the documents and a weight")
    sizes = rows["size"].to_numpy()
    path = None
    if len(sizes) and sizes.max() > 1:
        path = scratch_path(tokens.sparkSession, "schedule")
        sums.repartitionByRange("queue").sortWithinPartitions("queue", "source").write.parquet(path)
    discard(sums)
    return TwoLevels(rows["queue"].to_pylist(), rows["n"].to_numpy().astype(np.int64), weights, sizes, path, window, grain)


def mixture(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """(sequence_id, source, tokens, share, off) of pieces from pack(): each source's tokens in each window, its share of all tokens, and by how much of the window the two differ.

    Sources that a window lacks have no row there; the last window counts by what it holds."""
    sums = pieces.groupBy("sequence_id", "source").agg(F.sum("length").alias("tokens"))
    total = sums.groupBy("source").agg((F.sum("tokens") / F.sum(F.sum("tokens")).over(Window.partitionBy())).alias("share"))  # a row for each source
    held = sums.groupBy("sequence_id").agg(F.sum("tokens").alias("held"))
    both = sums.join(held, "sequence_id").join(total.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return both.select("sequence_id", "source", "tokens", "share", F.abs(F.col("tokens") / F.col("held") - F.col("share")).alias("off"))


def pack(tokens: DataFrame, tokenizer_path: str, window: int = 2048, grain: int = 16, targets: dict | None = None) -> DataFrame:
    """(doc_id, source, start, length, ids, doc_tokens, sequence_id, offset) for every piece of the queues from queue_tokens().

    ``grain`` is what sources inside a group are served at once. ``targets`` gives token weights by source; without it each window has the corpus's own proportions, and all queues end together. With it,
    queues that run dry leave their turns to the others, and every token is still packed; targets of which none fits a source are an error. ``ids`` are little-endian unsigned 32-bit.
    No documents give no pieces.
    """
    small_batches(tokens.sparkSession)
    width = id_width(tokenizer_path)
    by_part = tokens.groupBy("queue", "source", "part").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("queue", "source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = by_part.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), (F.dense_rank().over(Window.partitionBy("queue").orderBy("source")) - 1).alias("rank"))
    # partitions are ranges of sources, so only the first queue and source of each may have begun before it: a row a partition at most
    begun = placed.groupBy("queue", "part").agg(F.max("base").cast("long").alias("base"), F.min("rank").cast("long").alias("ranks")).where("base > 0 or ranks > 0")
    schedule = two_levels(tokens, window, grain, targets)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                yield from one(batch.slice(k, 512))

    def one(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        group = np.array([schedule.place[q] for q in part.column("queue").to_pylist()], np.int64)
        rank, start, length = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rank", "start", "n_tokens"))
        doc, at, size, position = schedule.pieces(group, rank, start, length)
        raw = b"".join(part.column("ids").to_pylist())
        ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
        cells = binary_cells(ids, np.append(0, np.cumsum(size)))  # pieces come in the order of documents and places
        index = pa.array(doc)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(index), part.column("source").take(index), pa.array(at), pa.array(size), cells, pa.array(length[doc]), pa.array(position // window), pa.array(position % window)],
            ["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    t, b = tokens.alias("t"), F.broadcast(begun).alias("b")
    on = F.col("t.queue").eqNullSafe(F.col("b.queue")) & (F.col("t.part") == F.col("b.part"))
    start = F.col("local_start") + F.when(F.col("local_rank") == 0, F.coalesce("base", F.lit(0))).otherwise(0)
    rank = F.col("local_rank") + F.coalesce("ranks", F.lit(0))
    placed = t.join(b, on, "left").select("t.doc_id", "t.queue", "source", "ids", "n_tokens", start.alias("start"), rank.alias("rank"))
    return placed.mapInArrow(place, "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
