"""Box, radius, neighbour and distance queries on points derived from `customer`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions.numbers import half_up
from tessera.sources.tables import spread, table

_POINT = """SELECT c_custkey AS id, CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE CAST(CAST((c_custkey * 7919) % 180001 AS DOUBLE) / 1000 - 90 AS DOUBLE) END AS lat,
  CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE CAST(CAST((c_custkey * 104729) % 360001 AS DOUBLE) / 1000 - 180 AS DOUBLE) END AS lon FROM customer"""
#: Centres, boxes (south, west, north, east) and radii in metres.
CENTRES = {"new_york": (40.7128, -74.006), "mumbai": (19.076, 72.8777), "reykjavik": (64.1466, -21.9426), "london": (51.5074, -0.1278), "antimeridian": (0.0, 180.0), "north_pole": (90.0, 0.0)}
BOXES = {"b1": (40.4, -74.3, 41.0, -73.6), "b2": (35.0, -10.0, 60.0, 30.0), "b3": (8.0, 68.0, 23.0, 80.0), "b4": (-60.0, -130.0, 70.0, 150.0), "b5": (-60.0, 170.0, 70.0, -170.0), "b6": (80.0, -180.0, 90.0, 180.0)}
SPHEROID_CENTRES = {n: CENTRES[n] for n in ("mumbai", "reykjavik", "london")}
RADII = {"d1": ("new_york", 10000.0), "d2": ("mumbai", 500000.0), "d3": ("reykjavik", 2000000.0), "d4": ("mumbai", 5000000.0), "d5": ("antimeridian", 5000000.0), "d6": ("london", 1000.0), "d7": ("north_pole", 100000.0)}


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(_POINT)


def _box(name):
    return lambda spark, sf_dir: points(spark, sf_dir).filter(geo.in_box(F.col("lat"), F.col("lon"), *BOXES[name])).select("id")


def _radius(name):
    return lambda spark, sf_dir: geo.within(points(spark, sf_dir), "lat", "lon", CENTRES[RADII[name][0]], RADII[name][1]).select("id")


def _knn(centre, k):
    return lambda spark, sf_dir: geo.nearest(points(spark, sf_dir), "lat", "lon", CENTRES[centre], k, "id").select("id", half_up("metres", 3).alias("metres"))


#: Distances on the spheroid are asked for up to here; towards the antipode the iteration may not settle.
SPHEROID_REACH = 15_000_000.0


def spheroid_distances(spark, sf_dir):
    """Metres on the spheroid from three centres to the points that are not near their antipodes."""
    p = spread(points(spark, sf_dir).filter("lat IS NOT NULL"))
    near = {n: geo.haversine(F.col("lat"), F.col("lon"), F.lit(a), F.lit(b)) <= SPHEROID_REACH for n, (a, b) in SPHEROID_CENTRES.items()}
    return p.select("id", *[F.when(near[n], half_up(geo.spheroid(f"{a}e0", f"{b}e0", "lat", "lon"), 3)).alias(f"to_{n}") for n, (a, b) in SPHEROID_CENTRES.items()])


def spheroid_radius(spark, sf_dir):
    """Points within 2,000 km of a centre on the spheroid; a box that holds a slightly larger circle of the sphere prunes."""
    (a, b), metres = CENTRES["reykjavik"], RADII["d3"][1]
    near = points(spark, sf_dir).filter(geo.in_box(F.col("lat"), F.col("lon"), *geo.box_around(a, b, metres * 1.01)))
    return near.filter(geo.spheroid(f"{a}e0", f"{b}e0", "lat", "lon") <= metres).select("id")


def planar_knn(spark, sf_dir):
    return points(spark, sf_dir).filter("lat IS NOT NULL").withColumn("d2", geo.planar_square(F.col("lat"), F.col("lon"), CENTRES["london"])).orderBy("d2", "id").limit(10).select("id")


def distances(spark, sf_dir):
    p = points(spark, sf_dir).filter("lat IS NOT NULL")
    return p.select("id", *[half_up(geo.haversine(F.col("lat"), F.col("lon"), F.lit(a), F.lit(b)), 3).alias(f"to_{n}") for n, (a, b) in CENTRES.items()])


def kth_distance(spark, sf_dir):
    """Distance of rank 10 and how many of all points share it."""
    p, centre = points(spark, sf_dir), CENTRES["mumbai"]
    ten = geo.nearest(p, "lat", "lon", centre, 10, "id").select(half_up("metres", 1).alias("metres"))
    tenth = ten.agg(F.max("metres").alias("tenth"), F.count("*").alias("n")).filter("n = 10").select("tenth")
    every = p.filter("lat IS NOT NULL AND lon IS NOT NULL").select(half_up(geo.haversine(F.col("lat"), F.col("lon"), F.lit(centre[0]), F.lit(centre[1])), 1).alias("metres"))
    return every.join(F.broadcast(tenth), F.col("metres") == F.col("tenth")).groupBy("tenth").agg(F.count("*").alias("ties"))


def construction_checks(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.agg(F.count("*").alias("n_rows"), F.count("lat").alias("with_point"), F.count_if(F.col("lat").isNull() != F.col("lon").isNull()).alias("half"), F.count_if(F.abs("lat") > 90).alias("bad_lat"), F.count_if(F.abs("lon") > 180).alias("bad_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"))


def dms(spark, sf_dir):
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return k.select("id", geo.from_dms(F.col("id") % 90, F.col("id") % 60, F.col("id") % 59).alias("degrees"))


_HAV = lambda a, b: f"2 * {geo.RADIUS}::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({a}::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * cos(radians({a}::DOUBLE)) * pow(sin(radians({b}::DOUBLE - lon) / 2), 2))))"
_R = lambda x, n: f"CAST(round(CAST({x} AS DECIMAL(38,10)), {n}) AS DECIMAL(28,{n}))"


def _box_sql(s, w, n, e):
    lon = f"lon BETWEEN {w} AND {e}" if w <= e else f"(lon >= {w} OR lon <= {e})"
    return f"SELECT id FROM p WHERE lat BETWEEN {s} AND {n} AND {lon}"


QUERIES = {f"gis_box_{k}": _box(k) for k in BOXES} | {f"gis_radius_{k}": _radius(k) for k in RADII} | {f"gis_knn_{c}": _knn(c, 10) for c in ("mumbai", "antimeridian", "north_pole")}
QUERIES |= {f"gis_{f.__name__}": f for f in (planar_knn, distances, spheroid_distances, spheroid_radius, kth_distance, construction_checks, dms)}
_SQL = {f"gis_box_{k}": _box_sql(*v) for k, v in BOXES.items()} | {f"gis_radius_{k}": f"SELECT id FROM p WHERE {_HAV(*CENTRES[c])} <= {r}" for k, (c, r) in RADII.items()}
_SQL |= {f"gis_knn_{c}": f"SELECT id, {_R('metres', 3)} AS metres FROM (SELECT id, {_HAV(*CENTRES[c])} AS metres FROM p WHERE lat IS NOT NULL ORDER BY metres, id LIMIT 10)" for c in ("mumbai", "antimeridian", "north_pole")}
_DUCK_LOOP, _DUCK_BIND = f"list_reduce(list_concat([{{start}}], list_transform(range({geo.TURNS}), lambda z: 0e0)), lambda lam, turn: {{step}})", "list_transform([{value}], lambda lam: {body})[1]"
_SPH = lambda a, b: geo.spheroid_sql(f"{a}e0", f"{b}e0", "lat", "lon", _DUCK_LOOP, _DUCK_BIND)
_SQL |= {
    "gis_spheroid_distances": "SELECT id, " + ", ".join(f"CASE WHEN {_HAV(*v)} <= {SPHEROID_REACH} THEN {_R(_SPH(*v), 3)} END AS to_{n}" for n, v in SPHEROID_CENTRES.items()) + " FROM p WHERE lat IS NOT NULL",
    "gis_spheroid_radius": f"SELECT id FROM p WHERE lat IS NOT NULL AND {_HAV(*CENTRES['reykjavik'])} <= 3000000 AND {_SPH(*CENTRES['reykjavik'])} <= {RADII['d3'][1]}",
    "gis_planar_knn": "SELECT id FROM p WHERE lat IS NOT NULL ORDER BY (lat - 51.5074::DOUBLE) * (lat - 51.5074::DOUBLE) + (lon + 0.1278::DOUBLE) * (lon + 0.1278::DOUBLE), id LIMIT 10",
    "gis_distances": "SELECT id, " + ", ".join(f"{_R(_HAV(*v), 3)} AS to_{n}" for n, v in CENTRES.items()) + " FROM p WHERE lat IS NOT NULL",
    "gis_kth_distance": f"SELECT tenth, count(*) AS ties FROM (SELECT {_R(_HAV(*CENTRES['mumbai']), 1)} AS m FROM p WHERE lat IS NOT NULL) JOIN (SELECT {_R(_HAV(*CENTRES['mumbai']), 1)} AS tenth FROM p WHERE lat IS NOT NULL ORDER BY 1 LIMIT 1 OFFSET 9) ON m = tenth GROUP BY tenth",
    "gis_construction_checks": "SELECT count(*) AS n_rows, count(lat) AS with_point, count(*) FILTER (WHERE (lat IS NULL) <> (lon IS NULL)) AS half, count(*) FILTER (WHERE abs(lat) > 90) AS bad_lat, count(*) FILTER (WHERE abs(lon) > 180) AS bad_lon, min(lat) AS min_lat, max(lon) AS max_lon FROM p",
    "gis_dms": "SELECT c_custkey AS id, CAST(round(CAST(CAST((c_custkey % 90) * 3600 + (c_custkey % 60) * 60 + c_custkey % 59 AS DOUBLE) / 3600 AS DECIMAL(28,12)), 7) AS DECIMAL(10,7)) AS degrees FROM customer",
}
ORACLE = {k: f"WITH p AS ({_POINT}) {v}" for k, v in _SQL.items()}
