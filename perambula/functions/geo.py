"""Geographic column expressions: distances, bearings, projections, geometry text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perambula import schema
from perambula.functions.clean import col, pick

EARTH_KM = 6371.0
METRES_PER_DEGREE = 111_000.0
_NUMBER = r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"


def wkt_point(geometry: Column | str) -> tuple[Column, Column]:
    """(lon, lat) of the first POINT in a text; null where there is none."""
    pattern = rf"(?i)POINT\s*\(\s*{_NUMBER}\s+{_NUMBER}\s*\)"
    return tuple(F.regexp_extract(col(geometry), pattern, k).try_cast("double") for k in (1, 2))


def any_point(geometry: Column | str) -> tuple[Column, Column]:
    """(lon, lat) of `POINT (lon lat)` or `(lat, lon)`."""
    g = F.trim(col(geometry))
    lon, lat = wkt_point(g)
    pair = rf"^\(?\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\)?$"
    other_lat, other_lon = (F.regexp_extract(g, pair, k).try_cast("double") for k in (1, 2))
    is_point = F.upper(g).startswith("POINT")
    return F.when(is_point, lon).otherwise(other_lon), F.when(is_point, lat).otherwise(other_lat)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing(dx: Column, dy: Column, names: list[str] = schema.COMPASS, legacy: bool = False) -> Column:
    """Compass sector of a step east dx and north dy. legacy: with the axes mixed up."""
    angle = F.degrees(F.atan2(dy, dx) if legacy else F.atan2(dx, dy))
    return pick(names, F.pmod(F.floor((F.pmod(angle + 360, F.lit(360.0)) + 22.5) / 45), F.lit(8)).cast("int"))


def lv95(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Swiss coordinates (east, north) by the published approximation, to about a metre."""
    y = (lon * 3600 - 26782.5) / 10000
    x = (lat * 3600 - 169028.66) / 10000
    east = 2600072.37 + 211455.93 * y - 10938.51 * y * x - 0.36 * y * x * x - 44.54 * y * y * y
    north = 1200147.07 + 308807.95 * x + 3745.25 * y * y + 76.63 * x * x - 194.56 * y * y * x + 119.79 * x * x * x
    return east, north


def planar(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def cell(coordinate: Column, metres: float) -> Column:
    """Grid cell of a coordinate in degrees."""
    return F.floor(coordinate / (metres / METRES_PER_DEGREE)).cast("long")


def ring_centroid(ring: Column | str) -> tuple[Column, Column]:
    """(x, y) centroid of a closed ring array<struct<x,y>> by the shoelace formula."""
    r = col(ring)
    pairs = F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(p["a"], p["b"]))
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    area = total(cross) / 2
    return total(lambda a, b: (a["x"] + b["x"]) * cross(a, b)) / (6 * area), total(lambda a, b: (a["y"] + b["y"]) * cross(a, b)) / (6 * area)


def to_lv95(df: DataFrame, x: str, y: str, declared: int | None = None) -> DataFrame:
    """df with x, y in Swiss coordinates. An undeclared system is told by the median of x (one action)."""
    code = declared
    if code not in (2056, 4326):
        middle = df.agg(F.median(x)).first()[0]
        code = 4326 if middle is not None and -180 < middle < 180 else 2056
    if code == 2056:
        return df
    east, north = lv95(F.col(x), F.col(y))
    return df.withColumns({x: east, y: north})

