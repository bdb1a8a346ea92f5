"""Facets of all institution pickers at once, from a bitmap index.

The index holds, for every value of every picker's column, the positions of the institutions
that have it as bitmaps of 32,768 positions (a bucket).  A picker offers the values that the other
pickers' choices leave: the bitmaps of a picker's chosen values are united, the unions of the
other four pickers are intersected, and each value's bitmap is intersected with that; the bits
left are the count shown beside the value.  Buckets are independent, so a query reads and combines
a few kilobytes per bucket and value instead of the institutions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import in_list
from ..params import AccessParams
from ..plans.acquire import dense_index

# ---- Fixed values: the pickers' columns and the snapshot fields that hold their choices ----
PICKERS = (("size", "sizes"), ("sector", "sectors"), ("degree_level", "degree_levels"),
           ("degree_types", "degree_types"), ("carnegie", "carnegie"))


def bitmap_index(schools: DataFrame) -> DataFrame:
    """``dimension, value, bucket, bits``: one bitmap per picker value and bucket of positions.

    Positions follow ``school_id``, which is unique.  A NULL is a value of its own.
    """
    placed = dense_index(schools.select("school_id", *[c for c, _ in PICKERS]), "school_id", "place")
    values = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c, _ in PICKERS])
    placed = placed.select("place", F.explode(values).alias("v"))
    return (placed.groupBy("v.dimension", "v.value", F.bitmap_bucket_number("place").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")))


def chosen(index: DataFrame, p: AccessParams) -> DataFrame:
    """``dimension, bucket, bits``: the institutions that each picker's choice keeps.

    ``carnegie=None`` keeps all.  A picker without a match in a bucket has no row there.
    """
    keep = F.lit(False)
    for column, field in PICKERS:
        choice = getattr(p, field)
        keep = keep | ((F.col("dimension") == column) & (F.lit(True) if choice is None else in_list("value", choice)))
    return index.where(keep).groupBy("dimension", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def facet_counts(index: DataFrame, p: AccessParams) -> DataFrame:
    """``dimension, value, n_schools, chosen``: every value of every picker, with the number of
    institutions it has among those the other pickers leave (0 where none)."""
    every = F.array(*[F.lit(c) for c, _ in PICKERS])
    others = (chosen(index, p).withColumn("facet", F.explode(F.array_except(every, F.array("dimension"))))
              .groupBy("facet", "bucket").agg(F.bitmap_and_agg("bits").alias("left"), F.count(F.lit(1)).alias("n"))
              .where(F.col("n") == len(PICKERS) - 1)             # all others have institutions in the bucket
              .select(F.col("facet").alias("dimension"), "bucket", "left"))
    both = (index.join(others, ["dimension", "bucket"])
            .select("dimension", "value", "bucket", F.explode(F.array("bits", "left")).alias("bits"))
            .groupBy("dimension", "value", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n")))
    listed = index.select("dimension", "value", F.lit(0).cast("bigint").alias("n")).distinct()
    counts = (both.select("dimension", "value", "n").unionByName(listed)
              .groupBy("dimension", "value").agg(F.sum("n").alias("n_schools")))
    picked = F.lit(False)
    for column, field in PICKERS:
        choice = getattr(p, field)
        picked = picked | ((F.col("dimension") == column) & (F.lit(True) if choice is None else in_list("value", choice)))
    return counts.withColumn("chosen", picked)
