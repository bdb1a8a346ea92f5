"""Running sums and neighbours over ordered rows, without one task per group.

Rows are range-partitioned on the keys and the order, so a group may lie in many
partitions; what goes from one partition to the next is one carry for the group that
runs on.  Windows then cover what a partition holds of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import join_null_safe
from ..session import scratch_path


def running(df: DataFrame, keys: list[str], order: str, value: str, total: str, following: str) -> DataFrame:
    """``df`` with ``total``, the sum of ``value`` up to each row, and ``following``, the next row's ``order``.

    Rows of a group (``keys``, NULL is a key) are ordered by ``order``, which is unique in it.
    The ranged rows are written once: their partition number must not change between
    the carries and the rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "running")
    ranged = df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    parts = ranged.groupBy("_part", *keys).agg(F.sum(value).alias("_sum"), F.min(order).alias("_head"))
    by_part = Window.partitionBy(*keys).orderBy("_part")            # a group's partitions
    parts = parts.select("_part", *keys, F.sum("_sum").over(by_part.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
                         F.lead("_head").over(by_part).alias("_after"))
    # only the first and the last group of a partition can go beyond it
    carry = parts.where("_before IS NOT NULL OR _after IS NOT NULL")
    within = Window.partitionBy("_part", *keys).orderBy(order)
    rows = ranged.withColumns({total: F.sum(value).over(within), following: F.lead(order).over(within)})
    rows = join_null_safe(rows, F.broadcast(carry), ["_part", *keys], "left")     # two rows a partition at most
    return rows.withColumns({
        total: F.col(total) + F.coalesce("_before", F.lit(0)),
        following: F.coalesce(following, "_after")}).drop("_part", "_before", "_after")
