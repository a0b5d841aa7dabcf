"""Readers of GeoPackages and shapefiles: a file is a task, and each feature a row.

Both formats are read from Spark's binary files by their published layouts: a GeoPackage is a SQLite
database whose geometries are well-known binary behind a short head, a shapefile is a list of shapes (.shp)
beside a table of their attributes (.dbf).
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perambula.functions import geo

FEATURES = "layer string, kind string, x double, y double, ring array<struct<x: double, y: double>>, srs int, attributes map<string, string>"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_ARROW = pa.schema([("layer", pa.string()), ("kind", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("ring", pa.list_(_POINT)), ("srs", pa.int32()), ("attributes", pa.map_(pa.string(), pa.string()))])
#: Rows that a reader hands on together.
ROWS = 4096


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist(held, _ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, _ARROW)


def _points(raw: bytes, at: int, n: int, order: str, width: int = 2) -> list[dict]:
    flat = struct.unpack_from(f"{order}{n * width}d", raw, at)
    return [{"x": flat[k], "y": flat[k + 1]} for k in range(0, len(flat), width)]


def well_known(raw: bytes) -> dict:
    """kind, and x and y of a point or the outer ring of a polygon; other kinds and empty shapes have neither."""
    order = "<" if raw[0] else ">"
    (code,) = struct.unpack_from(f"{order}I", raw, 1)
    width = 2 + (code // 1000 in (1, 2)) + 2 * (code // 1000 == 3)
    found = {"kind": {1: "Point", 3: "Polygon"}.get(code % 1000, "Other"), "x": None, "y": None, "ring": None}
    if found["kind"] == "Point":
        p = _points(raw, 5, 1, order)[0]
        if p["x"] == p["x"]:  # an empty point is not a number
            found |= p
    elif found["kind"] == "Polygon" and struct.unpack_from(f"{order}I", raw, 5)[0]:
        found["ring"] = _points(raw, 13, struct.unpack_from(f"{order}I", raw, 9)[0], order, width)
    return found


def _package(raw: bytes, layer: str | None) -> Iterator[dict]:
    database = sqlite3.connect(":memory:")
    database.deserialize(raw)
    database.row_factory = sqlite3.Row
    for table, column in database.execute("SELECT table_name, column_name FROM gpkg_geometry_columns").fetchall():
        if layer in (None, table):
            quoted = '"' + table.replace('"', '""') + '"'
            for row in database.execute(f"SELECT * FROM {quoted}"):
                shape, found = row[column], {"kind": None, "x": None, "y": None, "ring": None, "srs": None}
                if shape:
                    order = "<" if shape[3] & 1 else ">"
                    envelope = (0, 32, 48, 48, 64)[shape[3] >> 1 & 7]
                    found = well_known(shape[8 + envelope :]) | {"srs": struct.unpack_from(f"{order}i", shape, 4)[0]}
                yield {"layer": table, **found, "attributes": [(k, None if row[k] is None else str(row[k])) for k in row.keys() if k != column]}  # noqa: SIM118


def _shapes(raw: bytes) -> Iterator[dict]:
    at = 100
    while at < len(raw):
        (words,) = struct.unpack_from(">i", raw, at + 4)
        at += 8
        (code,) = struct.unpack_from("<i", raw, at)
        found = {"kind": {0: None, 1: "Point", 11: "Point", 21: "Point", 5: "Polygon", 15: "Polygon", 25: "Polygon"}.get(code, "Other"), "x": None, "y": None, "ring": None}
        if found["kind"] == "Point":
            found |= _points(raw, at + 4, 1, "<")[0]
        elif found["kind"] == "Polygon":
            parts, points = struct.unpack_from("<2i", raw, at + 36)
            last = struct.unpack_from("<i", raw, at + 48)[0] if parts > 1 else points
            found["ring"] = _points(raw, at + 44 + 4 * parts, last, "<")
        yield found
        at += 2 * words


def _records(raw: bytes, charset: str) -> Iterator[list]:
    (n,), (head, width) = struct.unpack_from("<I", raw, 4), struct.unpack_from("<2H", raw, 8)
    fields, at = [], 32
    while raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode(charset), raw[at + 16]))
        at += 32
    for k in range(n):
        at, row = head + k * width + 1, []
        for name, size in fields:
            row.append((name, raw[at : at + size].decode(charset, "replace").strip(" \0") or None))
            at += size
        yield row


def _files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path)


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """(layer, kind, x, y, ring, srs, attributes) of all features of the packages in a folder, or of one layer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                yield from _batches(_package(raw.as_py(), layer))

    return _files(spark, path, "gpkg").select("content").mapInArrow(run, FEATURES)


def read_shapefiles(spark: SparkSession, path: str, srs: int = 4326, charset: str = "utf-8") -> DataFrame:
    """As read_geopackage of all shapefiles in a folder; the layer is the file's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, shapes, records in zip(*batch.columns, strict=True):
                pairs = zip(_shapes(shapes.as_py()), _records(records.as_py(), charset), strict=True)
                yield from _batches({"layer": name.as_py(), **shape, "srs": srs, "attributes": row} for shape, row in pairs)

    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("name")
    folder = F.regexp_extract("path", r"^(.*)\.[^./]+$", 1).alias("stem")
    shapes = _files(spark, path, "shp").select(folder, stem, F.col("content").alias("shapes"))
    records = _files(spark, path, "dbf").select(folder, F.col("content").alias("records"))
    return shapes.join(records, "stem").select("name", "shapes", "records").mapInArrow(run, FEATURES)


def points(features: DataFrame, *names: str) -> DataFrame:
    """x, y and the named attributes of features with a place: points, and polygons at their centroids."""
    x, y = geo.ring_centroid("ring")
    at = lambda c, centre: F.coalesce(F.col(c), F.when(F.size("ring") > 2, centre)).alias(c)
    pick = lambda n: F.col("attributes").getItem(n).alias(n)
    kept: list[Column] = [pick(n) for n in names]
    return features.select(at("x", x), at("y", y), *kept).where("x is not null and y is not null")
