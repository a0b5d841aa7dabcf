"""The k nearest points of interest of each location, and their texts.

Two exact strategies. `broadcast` compares all pairs in one pass and is used only while ids and coordinates
of the points of interest are few and small enough to be sent to every task (both are measured). `grid`
joins on cells: points are dealt to square cells that hold a few times k points on average, a location meets
its own and the eight cells around, and is done if its k-th neighbour is no further than the cells surely
reach; the rest goes on with doubled cells, until the cells reach everything. Names and categories join the
k nearest only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perambula import schema
from perambula.functions import clean, geo, text
from perambula.operators.mobility import first_by

#: Points of interest, and bytes of their ids and coordinates, up to which they are broadcast.
BROADCAST_ROWS = 2_000
BROADCAST_BYTES = 1 << 20
#: Points of a cell on average, as a multiple of k.
CELL_POINTS = 4


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("location_id").orderBy("metres", "id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.withColumn("metres", geo.planar(F.col("x") - F.col("lx"), F.col("y") - F.col("ly")))


def knn_broadcast(locations: DataFrame, points: DataFrame, k: int) -> DataFrame:
    return _ranked(_pairs(locations.join(F.broadcast(points), F.lit(True))), k)


def _bounds(df: DataFrame, x: str, y: str) -> tuple:
    """(rows, least x, largest x, least y, largest y)."""
    return tuple(df.agg(F.count("*"), F.min(x), F.max(x), F.min(y), F.max(y)).first())


def knn_grid(locations: DataFrame, points: DataFrame, k: int, size: float | None = None) -> DataFrame:
    n, *box = _bounds(points, "x", "y")
    asked, *other = _bounds(locations, "lx", "ly")
    if not n or not asked:
        return _ranked(_pairs(locations.join(points, F.lit(False))), k)
    k = min(k, n)
    extent = max(max(box[1], other[1]) - min(box[0], other[0]), max(box[3], other[3]) - min(box[2], other[2]))
    size = size or ((box[1] - box[0]) * (box[3] - box[2]) * CELL_POINTS * k / n) ** 0.5 or extent or 1.0
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    every = Window.partitionBy("location_id")
    done, rest = None, locations
    while True:
        at = lambda c, s=size: F.floor(F.col(c) / s).cast("long")
        dealt = points.withColumns({"cx": at("x"), "cy": at("y")})
        visits = rest.withColumn("step", F.explode(steps)).withColumns({"cx": at("lx") + F.col("step.a"), "cy": at("ly") + F.col("step.b")}).drop("step")
        found = _ranked(_pairs(visits.join(dealt, ["cx", "cy"]).drop("cx", "cy")), k)
        whole = F.lit(True) if size >= extent else (F.count("*").over(every) == k) & (F.max("metres").over(every) <= size)
        found = found.withColumn("whole", whole).where("whole").drop("whole").checkpoint()
        done = found if done is None else done.unionByName(found)
        if size >= extent:
            return done
        rest = rest.join(found.where("rank = 1").select("location_id"), "location_id", "left_anti")
        if rest.isEmpty():
            return done
        size *= 2


def few(points: DataFrame) -> bool:
    """May ids and coordinates be broadcast?"""
    some = points.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.sum(F.octet_length(F.col("id").cast("string")) + 16)).first()
    return some[0] <= BROADCAST_ROWS and (some[1] or 0) <= BROADCAST_BYTES


def knn(locations: DataFrame, pois: DataFrame, k: int, strategy: str | None = None, size: float | None = None) -> DataFrame:
    """(location_id, lx, ly, id, name, category, x, y, metres, rank), k rows a location; ties by id, which is unique."""
    points = pois.select("id", "x", "y").dropna(subset=["x", "y"])
    locations = locations.select("location_id", F.col("x").alias("lx"), F.col("y").alias("ly")).dropna()
    strategy = strategy or ("broadcast" if few(points) else "grid")
    near = knn_broadcast(locations, points, k) if strategy == "broadcast" else knn_grid(locations, points, k, size)
    return near.join(pois.select("id", "name", "category"), "id").select("location_id", "lx", "ly", "id", "name", "category", "x", "y", "metres", "rank")


def distinct_locations(df: DataFrame, *order) -> DataFrame:
    """One row of coordinates a location, the first in the order."""
    return first_by(df, ["location_id"], *(order or ("lon", "lat")))


def poi_context(locations: DataFrame, pois: DataFrame, top_k: int = 5, buffer: int = 3, digits: int = 3, strategy: str | None = None) -> DataFrame:
    """(location_id, rank, id, name, category, km, direction).

    The buffer * top_k nearest are found first; then those of no known category go, and top_k of the rest stay.
    """
    near = knn(locations, pois, buffer * top_k, strategy).drop("rank")
    kind = F.lower("category")
    w = Window.partitionBy("location_id").orderBy("metres", "id")
    kept = near.where(F.col("category").isNotNull() & ~kind.isin("unknown", "others")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    return kept.select(
        "location_id", "rank", "id", "name", "category", F.bround(F.col("metres") / 1000, digits).alias("km"), geo.bearing(F.col("x") - F.col("lx"), F.col("y") - F.col("ly")).alias("direction")
    )


def context_text(context: DataFrame, sentence: bool = False, digits: int = 3) -> DataFrame:
    """(location_id, nearby_places): the texts of a location in order of distance, separated by semicolons."""
    make = text.poi_sentence if sentence else text.poi_text
    said = make(F.col("km"), F.col("direction"), F.col("category"), F.col("name"), digits=digits)
    rows = context.select("location_id", "rank", said.alias("said")).where("said is not null")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "said")))
    return rows.groupBy("location_id").agg(F.concat_ws("; ", ordered["said"]).alias("nearby_places"))


def attach_context(df: DataFrame, locations: DataFrame, pois: DataFrame, top_k: int = 5, strategy: str | None = None) -> DataFrame:
    """df with nearby_places, null where a location has none; found once for each location."""
    return df.join(context_text(poi_context(locations, pois, top_k, strategy=strategy)), "location_id", "left")


def build_pois(*layers: DataFrame) -> DataFrame:
    """(id, name, code, category, x, y) of all layers: rows with a place, classified, numbered from 0 in a declared order."""
    parts = []
    for layer in layers:
        kind = next((c for c in ("fclass", "type") if c in layer.columns), None)
        part = layer.withColumn("category", clean.category(kind) if kind else F.lit("Unknown"))
        part = part.withColumns({c: F.lit(None).cast("string") for c in ("name", "code") if c not in part.columns})
        parts.append(part.where("x is not null and y is not null").select("name", F.col("code").cast("string").alias("code"), "category", "x", "y"))
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    return numbered(df, "category", "name", "code", "x", "y").select("id", "name", "code", "category", "x", "y")


def osm_pois(layers: dict[str, DataFrame]) -> DataFrame:
    """Points of interest of exported OpenStreetMap layers by name; absent layers are left out.

    Natural points stay without trees, natural areas are beaches only, traffic points and areas are parking
    only. Area layers have a closed ring of points, and stand at its centroid.
    """
    rules = {
        "natural": F.col("fclass") != "tree",
        "natural_areas": F.col("fclass") == "beach",
        "traffic": F.col("fclass").isin(*schema.PARKING),
        "traffic_areas": F.col("fclass").isin(*schema.PARKING),
    }
    kept = []
    for name, layer in layers.items():
        part = layer.where(rules[name]) if name in rules and "fclass" in layer.columns else layer
        if "ring" in part.columns:
            x, y = geo.ring_centroid("ring")
            part = part.withColumns({"x": x, "y": y}).drop("ring")
        kept.append(part)
    return build_pois(*kept)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """With id 0, 1, ... in order. The sort stays in parallel; the driver gets one count a partition."""
    placed = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", 33)
    before, total = {}, 0
    for k, n in sorted(tuple(r) for r in placed.groupBy(part).count().collect()):
        before[k] = total
        total += n
    first = F.create_map(*[F.lit(x) for pair in (before or {0: 0}).items() for x in pair])
    return placed.withColumn("id", (first[part] + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_at")
