"""From raw documents to packed training sequences.

Stages, in order: documents of low quality or with toxic text go; boilerplate lines go; of each group of near
duplicates the smallest doc_id stays; what is left is packed. Each stage's rows are written as Parquet and read again.

Any column may be null, and columns beyond doc_id, text and source are carried along whatever their names. Empty tables go through all stages. Long texts are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweave.llm import line_dedup, minhash, packing, quality
from eventweave.llm.scratch import materialize

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely than not of the highest grade, by a model fitted on labelled documents among docs.

    Null and empty texts have no features and go. Repeated rows have equal scores, so all of them stay or go. Without any usable label nothing is selected."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, quality.grades_of(labels))
    return quality.score(docs, model).where("selected").select(*[f"`{c}`" for c in docs.columns])


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on 10 sites or more; copies that hold no other lines are left to the next stage.

    ``n_chars``, if there is such a column, follows the text. Null and empty texts stay as they are, rows without a source add to no line's sites, and repeated rows stay."""
    cleaned = line_dedup.remove_boilerplate(docs, 10, spare="copies")
    if "n_chars" in docs.columns:
        counted = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", counted)
    return cleaned.select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates. Rows without a doc_id stay, all of them.

    Texts are judged one by one: rows of one doc_id with several texts are documents of their own, and rows equal in doc_id and text are one. Texts without words,
    null ones among them, are no duplicates of each other.
    """
    record = F.struct(*[docs[c] for c in docs.columns]).alias("record")
    named = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("h"), record).where("doc_id is not null")
    distinct = named.repartitionByRange("doc_id", "h").dropDuplicates(["doc_id", "h", "text"]).sortWithinPartitions("doc_id", "h")
    # partitions are ranges of doc_id, so numbers of rows are in the order of doc_id
    rows = materialize(distinct.select("record", F.monotonically_increasing_id().alias("row")), "rows")
    judged = minhash.near_duplicates(rows.select("row", F.col("record.text").alias("text")), 75, 5, id_col="row")
    gone = judged.where("not kept").select(F.col("doc_id").alias("row"))
    return rows.join(gone, "row", "left_anti").select("record.*").unionByName(docs.where("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with the token ids of each piece.

    Every row is a document; null and empty texts are an end token each, and a null source is a source of its own."""
    return packing.pack(packing.queue_tokens(docs, BYTE_BPE), BYTE_BPE)


STAGES = [("quality classifier", keep_good), ("line dedup", drop_boilerplate), ("MinHash near-dedup", drop_near_copies), ("packing", pack)]

#: The classifier's fit has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
