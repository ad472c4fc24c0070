"""Events of a run's nodes, failed ones too: name, success, rows, milliseconds, whatever else was counted, and the error."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

EVENT = "node string, success boolean, rows bigint, latency_ms double, metrics map<string,bigint>, error string"
#: Seconds that a node's counts may come late.
PATIENCE = 10.0


def _counts(seen: Observation) -> dict[str, int]:
    """What was counted; nothing if no action has used the rows."""
    found: list[dict] = []
    waiting = threading.Thread(target=lambda: found.append(seen.get), daemon=True)
    waiting.start()
    waiting.join(PATIENCE)
    return found[0] if found else {}


class NodeLog(StreamingQueryListener):
    """Collects events: of blocks of code by node(), and, once it is added to a session's streams, of every batch and failure of streaming queries."""

    def __init__(self) -> None:
        self.events: list[dict] = []

    def _add(self, node: str, success: bool, rows: int | None, latency_ms: float, metrics: dict[str, int] | None = None, error: str | None = None) -> None:
        self.events.append({"node": node, "success": success, "rows": rows, "latency_ms": round(latency_ms, 3), "metrics": metrics or {}, "error": error and error.strip().splitlines()[0][:500]})

    @contextmanager
    def node(self, name: str) -> Iterator[Callable[..., DataFrame]]:
        """A block that is one node. It gets a function that counts the rows of a frame, and named aggregates of them, while an action in the block uses it. A failure is logged and goes on."""
        began, used = time.perf_counter(), []

        def count(rows: DataFrame, **metrics: Column) -> DataFrame:
            used.append(Observation())
            return rows.observe(used[-1], F.count(F.lit(1)).alias("rows"), *[F.coalesce(v.cast("bigint"), F.lit(0)).alias(k) for k, v in metrics.items()])

        passed = lambda: 1000 * (time.perf_counter() - began)
        try:
            yield count
        except Exception as failed:
            self._add(name, False, None, passed(), error=f"{type(failed).__name__}: {failed}")
            raise
        took, sums = passed(), {}
        for seen in used:
            for k, v in _counts(seen).items():
                sums[k] = sums.get(k, 0) + v
        self._add(name, True, sums.pop("rows", None), took, sums)

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        self._add(p.name or str(p.id), True, p.numInputRows, float(p.durationMs.get("triggerExecution", 0)), {"batch": p.batchId})

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        if event.exception:
            self._add(str(event.id), False, None, 0.0, error=event.exception)

    def write(self, spark: SparkSession, path: str) -> None:
        """Append the events to JSON lines, and forget them."""
        gone, self.events = self.events, []
        if gone:
            spark.createDataFrame([tuple(e.values()) for e in gone], EVENT).coalesce(1).write.mode("append").option("ignoreNullFields", "false").json(path)
