"""Polygon files: round trips, pruning, splits, foreign files and the errors that the docstring names."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitreach.functions.geo import multipolygon_centroid
from transitreach.sources import shapefile as S

SCHEMA = "geoid string, n bigint, area double, flag boolean, day date, geometry array<array<array<struct<x:double,y:double>>>>"


def box(x, y, w, h, clockwise=True):
    x, y, w, h = map(float, (x, y, w, h))
    ring = [(x, y), (x, y + h), (x + w, y + h), (x + w, y), (x, y)]
    return ring if clockwise else ring[::-1]


def normal(polygons):
    """Rings as sorted edges without direction, so turned rings compare equal."""
    def edges(ring):
        return sorted(sorted(e) for e in zip(map(tuple, ring), map(tuple, ring[1:])))

    return sorted([edges(p[0]), sorted(map(edges, p[1:]))] for p in polygons or ())


@pytest.fixture(scope="module")
def source(spark):
    S.register(spark)
    return spark


def test_round_trip_of_types_holes_islands_and_nulls(source, tmp_path):
    rows = [("a", 1, 0.1, True, None, [[box(0, 0, 4, 2), box(1, .5, 1, 1)]]),
            ("é" * 127, -2**63, -1.2345678901234567e-308, False, None, [[box(0, 0, 4, 2)], [box(10, 0, 2, 2), box(10.5, .5, 1, 1)]]),
            (None, None, None, None, None, None), ("none", 2**63 - 1, 1e300, None, None, []),
            ("nested", 0, 0.0, True, None, [[box(0, 0, 9, 9), box(1, 1, 7, 7)], [box(2, 2, 3, 3), box(3, 3, 1, 1)]]),
            ("a", 1, 0.1, True, None, [[box(0, 0, 4, 2, False), box(1, .5, 1, 1, True)]])]
    df = source.createDataFrame(rows, SCHEMA).withColumn("day", F.to_date(F.lit("2024-02-29")))
    path = str(tmp_path / "out")
    df.repartition(3).write.format("shapefile").mode("append").save(path)
    back = source.read.format("shapefile").load(path)
    assert back.schema.simpleString() == df.schema.simpleString()

    def plain(rows):
        return sorted(((r.geoid, r.n, r.area, r.flag, str(r.day), repr(normal(r.geometry))) for r in rows), key=repr)

    assert plain(back.collect()) == plain(df.collect())
    assert not [f for f in os.listdir(path) if f.startswith("_staging")]


def test_overwrite_replaces_and_append_adds(source, tmp_path):
    path = str(tmp_path / "out")
    one = source.createDataFrame([("a", [[box(0, 0, 1, 1)]])], "geoid string, geometry " + S.MULTIPOLYGON.simpleString())
    for mode, n in (("append", 1), ("append", 2), ("overwrite", 1)):
        one.coalesce(1).write.format("shapefile").mode(mode).save(path)
        assert source.read.format("shapefile").load(path).count() == n


def test_ranges_of_records_and_rolled_files_lose_nothing(source, tmp_path):
    path = str(tmp_path / "out")
    df = source.range(1000).select(F.col("id").cast("string").alias("geoid"), F.expr(
        "array(array(transform(array(0, 1, 2, 0), k -> struct(double(id + k) AS x, double(k * k) AS y))))").alias("geometry"))
    df.coalesce(1).write.format("shapefile").mode("append").option("filebytes", 20_000).save(path)
    assert len([f for f in os.listdir(path) if f.endswith(".shp")]) > 3
    back = source.read.format("shapefile").option("splitbytes", 5_000).load(path)
    assert back.rdd.getNumPartitions() > 12
    assert sorted(int(r.geoid) for r in back.collect()) == list(range(1000))
    assert back.where("geometry[0][0][0].x = double(geoid)").count() == 1000


def test_only_the_table_is_read_without_geometry(source, tmp_path):
    path = str(tmp_path / "out")
    df = source.createDataFrame([("a", [[box(0, 0, 1, 1)]])], "geoid string, geometry " + S.MULTIPOLYGON.simpleString())
    df.coalesce(1).write.format("shapefile").mode("append").save(path)
    shp = next(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".shp"))
    data = bytearray(open(shp, "rb").read())
    struct.pack_into("<i", data, 108, 3)                     # a type that cannot be decoded
    open(shp, "wb").write(data)
    assert source.read.format("shapefile").schema("geoid string, other double").load(path).collect() == [("a", None)]
    with pytest.raises(Exception, match="no polygons"):
        source.read.format("shapefile").load(path).collect()


def test_empty_tables_and_folders(source, tmp_path):
    path = str(tmp_path / "out")
    kinds = "geoid string, geometry " + S.MULTIPOLYGON.simpleString()
    source.createDataFrame([], kinds).coalesce(1).write.format("shapefile").mode("append").save(path)
    back = source.read.format("shapefile").load(path)
    assert back.columns == ["geoid", "geometry"] and back.count() == 0
    (tmp_path / "bare").mkdir()
    assert source.read.format("shapefile").schema(kinds).load(str(tmp_path / "bare")).count() == 0


@pytest.mark.parametrize("rows, kinds, message", [
    ([("x" * 255, None)], "geoid string", "255 bytes"), ([("a", None)], "elevenbytes string", "at most 10")])
def test_what_the_table_cannot_hold_is_an_error_and_leaves_nothing(source, tmp_path, rows, kinds, message):
    path = str(tmp_path / "out")
    df = source.createDataFrame(rows, f"{kinds}, geometry {S.MULTIPOLYGON.simpleString()}")
    with pytest.raises(Exception, match=message):
        df.coalesce(1).write.format("shapefile").mode("append").save(path)
    assert not os.path.isdir(path) or not os.listdir(path)


def test_projected_coordinates_are_an_error(source, tmp_path):
    path = str(tmp_path / "out")
    df = source.createDataFrame([("a", [[box(0, 0, 1, 1)]])], "geoid string, geometry " + S.MULTIPOLYGON.simpleString())
    df.coalesce(1).write.format("shapefile").mode("append").save(path)
    prj = next(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".prj"))
    open(prj, "w").write('PROJCS["NAD_1983_StatePlane"]')
    with pytest.raises(Exception, match="projected"):
        source.read.format("shapefile").load(path).collect()


def test_centroid_weighs_polygons_by_area_and_holes_negative(source):
    rng = np.random.default_rng(7)
    rows, expected = [], []
    for i in range(30):
        parts, m, s = [], np.zeros(2), 0.0
        for j in range(rng.integers(1, 4)):
            x, y, w, h = 20 * j + rng.random(), rng.random(), 2 + rng.random(), 2 + rng.random()
            rings = [box(x, y, w, h, bool(rng.integers(2)))]
            m += w * h * np.array([x + w / 2, y + h / 2])
            s += w * h
            if rng.integers(2):
                rings.append(box(x + .5, y + .5, 1, 1, bool(rng.integers(2))))
                m -= np.array([x + 1, y + 1])
                s -= 1
            parts.append(rings)
        rows.append((i, parts))
        expected.append(m / s)
    df = source.createDataFrame(rows, "i int, geometry " + S.MULTIPOLYGON.simpleString())
    got = df.orderBy("i").select(multipolygon_centroid(F.col("geometry")).alias("c")).collect()
    assert np.allclose([(r.c.x, r.c.y) for r in got], expected)
