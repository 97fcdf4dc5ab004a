"""Distances with known values, and the edges of the globe."""

import math

from pyspark.sql import functions as F

from tessera.functions import geo


def test_spheroid_distances_with_known_values(spark):
    """A degree of longitude on the equator, a quarter of a meridian, and a pair of points of the surveyors' classical example."""
    equator = math.radians(1) * geo.HALF_AXIS
    d = lambda a, b, x, y: spark.range(1).select(geo.spheroid(f"{a}e0", f"{b}e0", f"{x}e0", f"{y}e0")).first()[0]
    assert abs(d(0.0, 0.0, 0.0, 1.0) - equator) < 1e-3
    assert abs(d(0.0, 0.0, 90.0, 0.0) - 10001965.729) < 1e-2
    assert d(12.5, 30.0, 12.5, 30.0) == 0
    # 50 03 58.76 N 5 42 53.10 W to 58 38 38.48 N 3 04 12.34 W
    assert abs(d(50.06632222222222, -5.714750000000000, 58.64402222222222, -3.070094444444444) - 969954.114) < 0.2


def test_edges_of_the_globe(spark):
    rows = spark.createDataFrame([(0.0, 180.0, 0.0, -180.0), (90.0, 10.0, 90.0, -120.0), (-90.0, 0.0, -90.0, 77.0)], "a double, b double, c double, d double")
    got = rows.select(geo.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("m"), geo.spheroid("a", "b", "c", "d").alias("s")).collect()
    assert all(r.m < 1e-6 and r.s < 1e-6 for r in got)
    box = geo.box_around(0.0, 179.9, 50_000.0)
    assert box[1] > box[3] and geo.box_around(89.9, 0.0, 50_000.0)[1:4:2] == (-180.0, 180.0)
    on_the_edge = spark.range(1).select(geo.in_box(F.lit(10.0), F.lit(180.0), 10.0, 170.0, 20.0, -170.0)).first()[0]
    assert on_the_edge
