"""Shared intermediate storage (of the session module), Arrow batches and file systems."""

from __future__ import annotations

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

from eventweave.session import discard, materialize, scratch_path, shared_dir

__all__ = ["discard", "filesystem", "materialize", "scratch_path", "shared_dir", "shuffle_partitions", "small_batches"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound the bytes of the Arrow batches that this session sends to Python; a row of more bytes is a batch of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= size:
        spark.conf.set(key, str(size))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI and the path in it; ``file:/x`` and ``file:///x`` are both accepted, and Spark's other names of S3."""
    for name in ("s3a://", "s3n://"):
        if uri.startswith(name):
            uri = "s3://" + uri[len(name) :]
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)
