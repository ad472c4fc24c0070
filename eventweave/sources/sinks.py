"""Writers of records, indexes and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweave.session import remove
from eventweave.sources import snapshots
from eventweave.sources.files import read_manifest


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_quarantine(rows: DataFrame, path: str) -> None:
    """Bad rows, as of read_with_quarantine(), as tab-separated text with a header; tabs and line ends in them are escaped."""
    plain = [F.replace(F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")).alias(c) if kind == "string" else F.col(c) for c, kind in rows.dtypes]
    rows.select(*plain).write.mode("overwrite").option("sep", "\t").option("header", "true").option("quote", "\u0000").csv(path)


def _checked(vectors: DataFrame, root: str, dims: int | None) -> tuple[str, int, int]:
    """Write vectors to a folder of their own below root; its name, rows and dims. Refused ones leave nothing behind."""
    spark, part = vectors.sparkSession, f"vectors-{uuid.uuid4().hex}"
    vectors.write.parquet(f"{root}/{part}")
    v = F.col("embedding")
    odd = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    n, wrong, low, high = spark.read.parquet(f"{root}/{part}").agg(F.count("*"), F.count_if(odd), F.min(F.size(v)), F.max(F.size(v))).first()
    if not n or wrong or low != high or dims not in (None, low):
        remove(spark, f"{root}/{part}")
        raise ValueError(f"{root}: {n} rows, {wrong} of them not finite, lengths {low} to {high} where {dims or 'one'} is wanted")
    return part, n, low


def save_index(vectors: DataFrame, root: str, dims: int | None = None, keep: int = 1, **info: object) -> None:
    """A new index: vectors and a snapshot that names them. Refuses an empty index, vectors of another length than dims (or each other) and components that aren't finite.

    The vectors are written aside and checked; only then a snapshot names them. Of older snapshots ``keep - 1`` stay for readers that are still at work, the vectors of the others go."""
    spark = vectors.sparkSession
    part, n, dims = _checked(vectors, root, dims)
    snapshots.commit(spark, root, lambda now: {"record_count": n, "embedding_dim": dims} | info | {"parts": [part]})
    snapshots.expire(spark, root, keep)


def add_to_index(vectors: DataFrame, root: str) -> None:
    """More vectors for a saved index, of its length; those that are there stay as they are. Of several writers at once each adds its own."""
    spark = vectors.sparkSession
    part, n, dims = _checked(vectors, root, read_manifest(spark, root)["embedding_dim"])

    def grown(now: dict | None) -> dict:
        if now is None or now["embedding_dim"] != dims:
            remove(spark, f"{root}/{part}")
            raise ValueError(f"{root}: the index changed to {now and now['embedding_dim']} dimensions, {dims} were to be added")
        return now | {"record_count": now["record_count"] + n, "parts": [*now["parts"], part]}

    snapshots.commit(spark, root, grown)


def compact_index(spark: SparkSession, root: str, rows_per_file: int = 1 << 20, keep: int = 1) -> bool:
    """Write the parts of an index as one; what other writers add meanwhile stays beside it. False, and no change, if there is nothing to join or the index was replaced meanwhile."""
    manifest = read_manifest(spark, root)
    old = manifest["parts"]
    if len(old) < 2:
        return False
    rows = spark.read.parquet(*[f"{root}/{part}" for part in old])
    part, n, _ = _checked(rows.repartition(max(1, -(-manifest["record_count"] // rows_per_file))), root, manifest["embedding_dim"])
    if n != manifest["record_count"]:
        remove(spark, f"{root}/{part}")
        raise ValueError(f"{root}: {n} rows, {manifest['record_count']} in the manifest")

    class Replaced(Exception):
        """The parts that were joined are no longer part of the index."""

    def joined(now: dict | None) -> dict:
        if now is None or not set(old) <= set(now["parts"]):
            raise Replaced
        return now | {"parts": [part, *(p for p in now["parts"] if p not in old)]}

    try:
        snapshots.commit(spark, root, joined)
    except Replaced:
        remove(spark, f"{root}/{part}")
        return False
    snapshots.expire(spark, root, keep)
    return True


def write_report(report: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_results(results: DataFrame, root: str) -> None:
    """Predictions, traces, errors (of samples with issues), metrics and a summary row, from one cached pass over results
    (id, prediction, trace, verified, issues)."""
    results = results.persist()
    try:
        write_jsonl(results.select("id", "prediction", "verified", "issues"), f"{root}/predictions")
        write_jsonl(results.select(F.col("id").alias("sample_id"), "trace"), f"{root}/trace")
        write_jsonl(results.where(F.size("issues") > 0).select(F.col("id").alias("sample_id"), "issues"), f"{root}/errors")
        write_jsonl(results.select(F.col("id").alias("sample_id"), "verified", F.size("issues").alias("issue_count")), f"{root}/per_sample_metrics")
        write_report(progress(results), f"{root}/summary")
    finally:
        results.unpersist()


def progress(results: DataFrame, skipped: int = 0) -> DataFrame:
    """Counts of samples, verified ones, those with issues, and those that a resumed run skipped."""
    return results.agg(F.count("*").alias("samples"), F.count_if("verified").alias("verified"), F.count_if(F.size("issues") > 0).alias("with_issues")).withColumn("skipped", F.lit(skipped).cast("long"))


def recount(spark: SparkSession, root: str) -> DataFrame:
    """progress() of what runs have written below root so far, for one that resumes."""
    done = spark.read.schema("id string, verified boolean, issues array<string>").json(f"{root}/predictions")
    return progress(done.withColumn("issues", F.coalesce("issues", F.array())))


def write_analysis(summary: DataFrame, cases: DataFrame, root: str) -> None:
    """An error summary as one JSON file, and its cases a line each."""
    write_report(summary, f"{root}/error_summary")
    write_jsonl(cases, f"{root}/error_cases")
