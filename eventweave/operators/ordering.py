"""Global positions without one sorted task, and batches of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventweave.session import materialize


def dense_positions(rows: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """rows with their 0-based place in a total order: range partitions, their sizes, and places within each.

    Rows are dealt once and stored, so that sizes and places are of the same partitions. Only the sizes (a row for each partition) are summed in one place."""
    dealt = materialize(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "positions")
    local = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("n"))
    starts = sizes.select(F.col("__p").alias("__q"), F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    return local.join(starts, F.col("__p") == F.col("__q")).withColumn(name, (F.col("__s") + F.col("__n") - 1).cast("long")).drop("__p", "__q", "__n", "__s")


def batches(rows: DataFrame, size: int, *order: str, wrap: bool = False) -> DataFrame:
    """rows with the number of their batch of ``size`` neighbours in the order. The last batch may be short, or with ``wrap``
    is filled with the first rows again, in the order, as often as it takes."""
    placed = dense_positions(rows, *order, name="__at")
    if wrap:
        placed = placed.crossJoin(F.broadcast(rows.agg(F.count("*").alias("__all"))))
        placed = placed.withColumn("__at", F.explode(F.expr(f"sequence(__at, (__all + {size - 1}) div {size} * {size} - 1, __all)"))).drop("__all")
    return placed.withColumn("batch", F.expr(f"__at div {size}")).drop("__at")


def ordered_distinct(values, pos):
    """Distinct values in the order of their first positions: an aggregate over rows of a group."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("pos"), values.alias("value")))), lambda x: x["value"]))
