"""Session helpers: packages on workers, and shared intermediate storage.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, which the driver and every executor can reach, so a lost executor never takes intermediate
rows with it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a local master without that setting."""
    global _local_dir
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="eventweave-")
    return _local_dir


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Bytes that Spark expects of the rows of a bucket.
BUCKET = 2**20


def buckets(rows: DataFrame) -> int:
    """How many buckets hold rows: as many as a shuffle has partitions at most, and fewer for small tables, though one for each core."""
    spark = rows.sparkSession
    expected = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, expected // BUCKET))


def dealt(df: DataFrame, key: str, n: int) -> DataFrame:
    """df, whose last shuffle dealt its rows by key, marked so that materialize() keeps them so, in n buckets."""
    df._dealt_by = (key, n)
    return df


def dealt_by(df: DataFrame) -> tuple[str, int] | None:
    """The key and the buckets that df is marked with, if it is."""
    return getattr(df, "_dealt_by", None)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later stages restart from the files. What is marked by dealt() is read without another shuffle by its key."""
    path = scratch_path(df.sparkSession, tag)
    if by := dealt_by(df):
        out = _bucketed(df, path, *by)
    else:
        df.write.parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _bucketed(df: DataFrame, path: str, key: str, n: int) -> DataFrame:
    """df written in n buckets of a key. Only a table can tell of buckets; its name goes once it is read, its files stay."""
    spark, name = df.sparkSession, f"spark_catalog.default.dealt_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialized frame that nothing reads any more."""
    if path := getattr(df, "_scratch_path", None):
        remove(df.sparkSession, path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from the place where the driver found it."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def registered(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return query(spark, sf_dir)

    return run
