"""Points on a sphere: distances, boxes, neighbours. A box is tested before any distance, as plain ranges that reach the scan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: mean radius of the Earth in metres.
RADIUS = 6371008.7714


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres; 0 between the two names of the antimeridian and of a pole."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return F.lit(2 * RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


#: Half axis in metres and flattening of the Earth's spheroid.
HALF_AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
#: Turns of the iteration below; short of the antipode it settles to a tenth of a millimetre in fewer than twelve.
TURNS = 12


def _spheroid_parts(lat1: str, lat2: str, lam: str) -> dict[str, str]:
    """SQL of the angles on the auxiliary sphere, for the difference of longitude `lam` on it; the same text for any engine."""
    u = lambda lat: f"atan({1 - FLATTENING!r}e0 * tan(radians({lat})))"
    s1, c1, s2, c2 = f"sin({u(lat1)})", f"cos({u(lat1)})", f"sin({u(lat2)})", f"cos({u(lat2)})"
    across = f"sqrt(pow({c2} * sin({lam}), 2) + pow({c1} * {s2} - {s1} * {c2} * cos({lam}), 2))"
    along = f"({s1} * {s2} + {c1} * {c2} * cos({lam}))"
    azimuth = f"({c1} * {c2} * sin({lam}) / nullif({across}, 0e0))"
    squared = f"(1e0 - pow({azimuth}, 2))"
    middle = f"({along} - coalesce(2e0 * {s1} * {s2} / nullif({squared}, 0e0), 0e0))"
    return {"across": across, "along": along, "arc": f"atan2({across}, {along})", "azimuth": azimuth, "squared": squared, "middle": middle}


def spheroid_sql(lat1: str, lon1: str, lat2: str, lon2: str, loop: str, bind: str) -> str:
    """Metres on the spheroid between two points, by fixed turns of the classical inverse iteration. `loop` is the engine's fold of the
    start {start} with the step {step} over the variable lam, and `bind` works out {body} with lam as {value}. Points near each
    other's antipode may not settle."""
    start, f = f"radians({lon2} - ({lon1}))", f"{FLATTENING!r}e0"
    p = _spheroid_parts(lat1, lat2, "lam")
    c = f"({f} / 16e0 * {p['squared']} * (4e0 + {f} * (4e0 - 3e0 * {p['squared']})))"
    step = f"{start} + coalesce((1e0 - {c}) * {f} * {p['azimuth']} * ({p['arc']} + {c} * {p['across']} * ({p['middle']} + {c} * {p['along']} * (2e0 * pow({p['middle']}, 2) - 1e0))), 0e0)"
    settled = loop.format(start=start, step=step)
    b = HALF_AXIS * (1 - FLATTENING)
    k = f"({p['squared']} * {(HALF_AXIS**2 - b**2) / b**2!r}e0)"
    big = f"(1e0 + {k} / 16384e0 * (4096e0 + {k} * (-768e0 + {k} * (320e0 - 175e0 * {k}))))"
    small = f"({k} / 1024e0 * (256e0 + {k} * (-128e0 + {k} * (74e0 - 47e0 * {k}))))"
    m, x, y = p["middle"], p["across"], p["along"]
    inner = f"({y} * (2e0 * pow({m}, 2) - 1e0) - {small} / 6e0 * {m} * (4e0 * pow({x}, 2) - 3e0) * (4e0 * pow({m}, 2) - 3e0))"
    metres = f"coalesce({b!r}e0 * {big} * ({p['arc']} - {small} * {x} * ({m} + {small} / 4e0 * {inner})), 0e0)"
    return bind.format(value=settled, body=metres)


SPARK_LOOP, SPARK_BIND = f"aggregate(sequence(1, {TURNS}), {{start}}, (lam, turn) -> {{step}})", "get(transform(array({value}), lam -> {body}), 0)"


def spheroid(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    """Metres on the spheroid; the arguments are SQL."""
    return F.expr(spheroid_sql(lat1, lon1, lat2, lon2, SPARK_LOOP, SPARK_BIND))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """west > east means a box over the antimeridian."""
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & across


def margins(lat: float, metres: float) -> tuple[float, float]:
    """(degrees of latitude, of longitude) that a circle needs at most; 180 where it holds a pole."""
    d = math.degrees(metres / RADIUS) * 1.000001
    if abs(lat) + d >= 90:
        return d, 180.0
    return d, math.degrees(math.asin(min(1.0, math.sin(math.radians(d)) / math.cos(math.radians(lat))))) * 1.000001


def box_around(lat: float, lon: float, metres: float) -> tuple[float, float, float, float]:
    """south, west, north, east of a box that holds the circle; west > east over the antimeridian."""
    dy, dx = margins(lat, metres)
    if dx >= 180:
        return max(-90.0, lat - dy), -180.0, min(90.0, lat + dy), 180.0
    west, east = lon - dx, lon + dx
    return max(-90.0, lat - dy), west + 360 if west < -180 else west, min(90.0, lat + dy), east - 360 if east > 180 else east


def within(points: DataFrame, lat: str, lon: str, centre: tuple[float, float], metres: float) -> DataFrame:
    """Points at most `metres` away, nulls left out; the box prunes, the distance decides."""
    near = points.filter(in_box(F.col(lat), F.col(lon), *box_around(*centre, metres)))
    return near.filter(haversine(F.col(lat), F.col(lon), F.lit(centre[0]), F.lit(centre[1])) <= metres)


def nearest(points: DataFrame, lat: str, lon: str, centre: tuple[float, float], k: int, tie: str) -> DataFrame:
    """The k nearest with their distance; a top-k in each task, then of those."""
    d = haversine(F.col(lat), F.col(lon), F.lit(centre[0]), F.lit(centre[1]))
    return points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("metres", d).orderBy("metres", tie).limit(k)


def planar_square(lat: Column, lon: Column, centre: tuple[float, float]) -> Column:
    return (lat - centre[0]) * (lat - centre[0]) + (lon - centre[1]) * (lon - centre[1])


def from_dms(degrees: Column, minutes: Column, seconds: Column) -> Column:
    """Degrees with 7 digits from degrees, minutes and seconds."""
    total = degrees.cast("decimal(18,8)") * 3600 + minutes.cast("decimal(18,8)") * 60 + seconds.cast("decimal(18,8)")
    return F.round((total / F.lit(3600).cast("decimal(10,0)")).cast("decimal(28,12)"), 7).cast("decimal(10,7)")
