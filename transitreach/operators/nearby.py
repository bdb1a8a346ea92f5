"""Points within a crow-fly distance of others, by cells of the distance's size.

Both sides are placed in cubes with an edge of the distance.  The smaller side is put into its
own and the 26 touching cubes, a constant number of copies, and meets the other on the cube, an
ordinary equi-join; only what it meets is measured.  A cube that holds many points is a hot join key, which
the adaptive skew join splits; ``salt`` splits it beforehand where many centres share such a cube too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import earth_cell, great_circle_miles


def crow_flies(df: DataFrame, lat: str, lon: str, centre_lat: str, centre_lon: str, name: str = "crow_flies") -> DataFrame:
    """Each row's distance in miles from its centre."""
    return df.withColumn(name, great_circle_miles(lat, lon, centre_lat, centre_lon))


def within_distance(centres: DataFrame, points: DataFrame, miles: float, salt: int = 1) -> DataFrame:
    """``centre_id, point_id, miles`` of every centre and point at most ``miles`` apart.

    Both tables have ``id, lat, lng`` in degrees.  A row without a coordinate is near nothing;
    repeated ids give their pairs again.
    """
    placed = points.where("lat IS NOT NULL AND lng IS NOT NULL").select(
        F.col("id").alias("point_id"), F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"),
        *[c.alias(n) for c, n in zip(earth_cell("lat", "lng", miles), "xyz")],
        F.pmod(F.xxhash64("id", "lat", "lng"), F.lit(salt)).cast("int").alias("s"))
    steps = [F.array(*[F.lit(k).cast("bigint") for k in (-1, 0, 1)])] * 3
    around = centres.where("lat IS NOT NULL AND lng IS NOT NULL").select(
        F.col("id").alias("centre_id"), F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"),
        *[c.alias(n) for c, n in zip(earth_cell("lat", "lng", miles), ("x0", "y0", "z0"))])
    ring = F.flatten(F.transform(steps[0], lambda i: F.flatten(F.transform(steps[1], lambda j: F.transform(
        steps[2], lambda k: F.struct((F.col("x0") + i).alias("x"), (F.col("y0") + j).alias("y"), (F.col("z0") + k).alias("z")))))))
    around = around.withColumn("cell", F.explode(ring)).select("centre_id", "c_lat", "c_lng", "cell.*")
    around = around.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    met = around.join(placed, ["x", "y", "z", "s"]).withColumn("miles", great_circle_miles("c_lat", "c_lng", "p_lat", "p_lng"))
    return met.where(F.col("miles") <= F.lit(float(miles))).select("centre_id", "point_id", "miles")
