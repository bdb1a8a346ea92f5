"""Connected components over an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum (summed per task first) and a join back, so a
node with a third of all edges costs no task more than its share: the minima
have one row a node; they are broadcast up to ``MOST_BROADCAST_NODES`` counted
rows, and beyond that the adaptive skew join splits a node's edges.  Every step's
edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, materialise

MOST_BROADCAST_NODES = 500_000       # two longs a row
ROWS_A_FILE = 200_000


def _star(edges: DataFrame, rows: int, large: bool) -> DataFrame:
    """One large-star or small-star step on ``a < b`` edges.

    Large: a node's larger neighbours go to the smallest of the node and its
    neighbours.  Small: a node and its smaller neighbours go to the smallest.
    """
    files = 2 * rows // ROWS_A_FILE + 1
    down = edges.select(F.col("b").alias("v"), F.col("a").alias("u"))
    near = down.unionByName(edges.select(F.col("a").alias("v"), F.col("b").alias("u"))) if large else down
    near = near.coalesce(files)
    low = near.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")).coalesce(files)
    linked = near.join(broadcast_if(low, 2 * rows, MOST_BROADCAST_NODES), "v")
    if large:
        out = linked.where("u > v").select(F.col("m").alias("a"), F.col("u").alias("b"))
    else:
        out = linked.select(F.col("m").alias("a"), F.col("u").alias("b")).unionByName(
            low.select(F.col("m").alias("a"), F.col("v").alias("b")))
    return materialise(edges.sparkSession, _tidy(out.coalesce(files)), "components", files)


def _tidy(edges: DataFrame) -> DataFrame:
    return (edges.where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _summary(edges: DataFrame) -> tuple:
    """Two edge tables are the same when their counts and hash sums are."""
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
                    F.bit_xor(F.xxhash64("b", "a")).alias("x")).first()
    return row["n"], row["h"], row["x"]


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """``node, component`` for every node of ``edges`` (long columns ``a, b``).

    ``component`` is the smallest node reachable.  Ends when a round changes
    nothing; the number of rounds grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    current = materialise(spark, _tidy(edges), "components", files)
    before = _summary(current)
    while before[0]:
        current = _star(_star(current, before[0], large=True), before[0], large=False)
        after = _summary(current)
        if after == before:
            break
        before = after
    # stars: every node hangs at its component's smallest
    return (current.select(F.col("b").alias("node"), F.col("a").alias("component"))
            .unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()))
