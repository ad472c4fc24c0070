"""Incremental evaluation as a stream of files: every sample is scored once, and a restarted run goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their keys in RocksDB, whose memory doesn't grow with them."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def known_ids(*done: DataFrame) -> DataFrame:
    """(id): the ids in the first columns of results and of errors, each once; empty and null ones are left out."""
    each = [d.select(F.trim(d[d.columns[0]].cast("string")).alias("id")) for d in done]
    return reduce(DataFrame.unionByName, each).where("id != ''").distinct()


def once(stream: DataFrame, key: str, done: Iterable[DataFrame] = ()) -> DataFrame:
    """The first row of each key that comes, now or in any later batch, unless ``done`` (results and errors of other runs) has it already.

    Keys are compared as trimmed text and kept in the stream's state, which its checkpoint holds: a restart or a repeated batch knows them. Rows without a key can't
    be told apart and all stay. Of equal keys in one batch one row stays, whichever comes first."""
    own = F.nullif(F.trim(F.col(key).cast("string")), F.lit(""))
    rows = stream.withColumn("__key", own)
    if done := tuple(done):
        rows = rows.join(known_ids(*done).withColumnRenamed("id", "__done"), F.col("__key") == F.col("__done"), "left_anti")
    # a row without a key is a key of its own
    named = rows.withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col("__key")), F.expr("uuid()")))
    return named.dropDuplicates(["__key"]).drop("__key")


def evaluate_new(
    spark: SparkSession,
    samples: str,
    schema: StructType | str,
    process: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    files_per_batch: int = 64,
    key: str | None = None,
    done: Iterable[DataFrame] = (),
    where: Column | None = None,
) -> StreamingQuery:
    """Process JSON files under ``samples`` that no earlier run with this checkpoint has seen; results are appended to Parquet under ``out``.

    With a ``key``, a sample whose key came before is left out, in whatever file and run it came; ``done`` are results and errors of runs with other checkpoints, whose
    first columns are keys that count as seen. ``where`` picks the samples that are evaluated at all, so that others don't use up their keys. A batch that is repeated after a
    failure replaces its own part of the output, so every sample counts once. A checkpoint belongs to one key."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(samples)
    rows = stream if where is None else stream.where(where)
    rows = rows if key is None else once(rows, key, done)

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _state_on_disk(spark):
        return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
