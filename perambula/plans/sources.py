"""Queries of sources, sinks and cleaning: derived tables written in a source's format, read back and compared."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perambula import schema
from perambula.functions import clean, geo, text
from perambula.operators import evaluate, features, inference, mobility, nearest
from perambula.plans import fixtures as fx
from perambula.plans.fixtures import CLASSES_SQL, SLICED, STAY, SURVEY_SQL, r6
from perambula.plans.mobility import BY, query, sliced
from perambula.session import scratch
from perambula.sources import files

HEAD = "user_id,location_id,started_at,finished_at,act_duration,length,geometry,mode"


def with_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array([HEAD])], ["value"])
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])


# Files ---------------------------------------------------------------------------------------


@query(
    "WITH e AS (SELECT *, event_id % 10 AS k FROM events) SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(event_id AS VARCHAR) AS location_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started,"
    " CASE WHEN k <> 5 THEN CAST(event_id % 97 * 5 AS DOUBLE) END AS act_duration, CASE WHEN k <> 5 THEN round_even(event_id % 97 * 5 / 60::DOUBLE, 1) END AS act_duration_h,"
    " CASE WHEN k <> 2 THEN round_even((event_id * 37 % 10000 * 10 + 7) / 1000::DOUBLE, 1) END AS length_km,"
    " CASE WHEN k IN (2, 6) THEN NULL WHEN k = 7 THEN 8.5 ELSE round_even(8.40003::DOUBLE + event_id % 1000 * 0.0002::DOUBLE, 4) END AS lon, CASE WHEN k IN (2, 6) THEN NULL WHEN k = 7 THEN 47.0 ELSE round_even(47.30003::DOUBLE + event_id % 1000 * 0.0001::DOUBLE, 4) END AS lat,"
    " CASE WHEN k IN (2, 8) THEN 'unknown' ELSE lower(event_type) END AS mode, isodow(ts) - 1 AS dow, hour(ts) AS hour_bin, strftime(ts, '%Y-%m-%d') AS date FROM e WHERE k NOT IN (3, 4, 9)"
)
def staypoints_csv(spark, sf):
    """A staypoint file with bad times, missing users, bad numbers, long and short lines, read and cleaned."""
    e = fx.read(spark, sf, "events")
    i = F.col("event_id")
    k = i % 10
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    point = F.format_string("POINT (%.5f %.5f)", F.lit(8.40003) + i % 1000 * F.lit(0.0002), F.lit(47.30003) + i % 1000 * F.lit(0.0001))
    first = [F.when(k == 4, "").otherwise(F.col("user_id").cast("string")), i.cast("string"), F.when(k == 3, "not-a-date").otherwise(at), at, F.when(k == 5, "abc").otherwise((i % 97 * 5).cast("string"))]
    rest = [(i * 37 % 10000 * 10 + 7).cast("string"), F.when(k == 6, '"LINESTRING (1 1, 2 2)"').when(k == 7, "point(8.5e0 4.7e1)").otherwise(point), F.when(k == 8, "").otherwise(F.upper("event_type"))]
    lines = e.select(F.when(k == 2, F.concat_ws(",", *first)).otherwise(F.concat_ws(",", *first, *rest, F.when(k == 9, "one too many"))).alias("value"))
    path = scratch(spark, "staypoints")
    lines.mapInArrow(with_head, "value string").write.text(path)
    got = mobility.clean_staypoints(files.read_staypoints_csv(spark, path))
    return got.select("user_id", "location_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started"), "act_duration", "act_duration_h", "length_km", "lon", "lat", "mode", "dow", "hour_bin", F.date_format("date", "yyyy-MM-dd").alias("date"))


@query("SELECT p_partkey, p_name, p_type, p_size, p_retailprice FROM part")
def csv_round_trip(spark, sf):
    path = scratch(spark, "csv")
    files.write_csv(fx.read(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice"), path)
    return files.read_csv(spark, path)


def _predictions(spark, sf):
    """JSON lines written once, appended to, and spoilt by empty and broken lines."""
    path = scratch(spark, "predictions")
    c = fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("user_id"), F.lower("c_mktsegment").alias("age_group"), F.when(F.col("c_custkey") % 3 == 0, None).otherwise(F.lit("é \"x\"")).alias("gender"), F.array(F.lit("a"), F.col("c_name")).alias("prediction_rationale"))
    files.write_jsonl(c.where("k % 2 = 0").drop("k"), path)
    files.append_jsonl(c.where("k % 2 = 1").drop("k"), path)
    spoilt = F.when(F.col("k") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit('{"user_id": "x'), F.col("user_id")))
    c.where("k % 7 = 0").select(spoilt.alias("value")).write.mode("append").text(path)
    return path


@query("SELECT CAST(c_custkey AS VARCHAR) AS user_id, lower(c_mktsegment) AS age_group, CASE WHEN c_custkey % 3 <> 0 THEN 'é \"x\"' END AS gender, 'a|' || c_name AS rationale FROM customer")
def jsonl_round_trip(spark, sf):
    return files.read_jsonl(spark, _predictions(spark, sf)).select("user_id", "age_group", "gender", F.concat_ws("|", "prediction_rationale").alias("rationale"))


@query("SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS user_id FROM customer")
def done_users(spark, sf):
    return files.done_users(spark, _predictions(spark, sf))


@query("SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'a; ' || c_name AS prediction_rationale FROM customer")
def csv_snapshot(spark, sf):
    source, path = _predictions(spark, sf), scratch(spark, "snapshot")
    made = files.snapshot_csv(spark, source, path) and not files.snapshot_csv(spark, source + "-absent", path + "-absent")
    columns = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.PREDICTIONS.fields])
    return files.read_csv(spark, path, columns).where(F.lit(made)).select("user_id", "prediction_rationale")


@query("SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'User: ' || c_custkey || chr(10) || chr(10) || 'Mobility evidence:' || chr(10) || c_name || chr(10) || chr(10) || c_mktsegment AS prompt FROM customer")
def prompt_file(spark, sf):
    lines = F.concat_ws("\n\n", "c_name", "c_mktsegment")
    path = scratch(spark, "prompts")
    files.write_prompts(fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), text.prompt("c_custkey", lines).alias("prompt")), path)
    return files.read_prompts(spark, path)


@query("SELECT 'Block ' || c_custkey || chr(10) || c_name AS prompt FROM customer")
def prompt_blocks(spark, sf):
    path = scratch(spark, "blocks")
    block = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" \n\n" + "=" * 80 + "\n\n"), F.format_string("Block %d\n%s", "c_custkey", "c_name"))).otherwise(F.format_string("Block %d\n%s", "c_custkey", "c_name"))
    fx.read(spark, sf, "customer").select(F.concat(block, F.lit("\n\n\n" + "=" * 85 + "\n")).alias("value")).write.text(path)
    return files.read_blocks(spark, path)


@query("SELECT CAST(c_custkey AS VARCHAR) AS user_id, CASE c_custkey % 3 WHEN 2 THEN c_name ELSE c_name || chr(10) || 'second line' END AS prompt FROM customer")
def headed_prompts(spark, sf):
    c = fx.read(spark, sf, "customer")
    k = F.col("c_custkey")
    headed, tabbed = scratch(spark, "headed"), scratch(spark, "tabbed")
    head = F.when(k % 3 == 0, F.format_string("===USER_%d===", k)).otherwise(F.format_string("USER_%d:", k))
    c.where(k % 3 < 2).select(F.concat(head, F.lit("\n"), "c_name", F.lit("\nsecond line\n")).alias("value")).write.text(headed)
    c.where(k % 3 == 2).select(F.concat(k.cast("string"), F.lit("\t"), "c_name").alias("value")).write.text(tabbed)
    return files.read_headed_prompts(spark, headed).unionByName(files.read_headed_prompts(spark, tabbed))


@query(
    "WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) SELECT 'User: ' || o_custkey AS asked, 'O orderstatus: ' || lower(o_orderstatus) || chr(10) || 'O orderpriority: ' || lower(trim(o_orderpriority)) AS answer FROM f WHERE r = 1"
)
def training_files(spark, sf):
    """Chat records in a train and a test file, read back: every user is in one of the two."""
    o = fx.read(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    users = o.select("user_id", F.concat(F.lit(" User: "), F.col("user_id").cast("string")).alias("prompt")).distinct()
    path = scratch(spark, "training")
    inference.write_training(inference.chat_records(users, o, ["o_orderstatus", "o_orderpriority"], order="o_orderkey"), path)
    columns = T.StructType([schema.CHAT["messages"]])
    both = files.read_jsonl(spark, f"{path}/train", columns).unionByName(files.read_jsonl(spark, f"{path}/test", columns))
    return both.select(F.col("messages")[1]["content"].alias("asked"), F.col("messages")[2]["content"].alias("answer"))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 2 = 1")
def poi_file(spark, sf):
    """A table of points of interest that is only replaced on demand."""
    p, path = fx.pois(spark, sf), scratch(spark, "pois")
    files.write_pois(p, path)
    try:
        files.write_pois(p, path)
        refused = False
    except Exception as e:  # noqa: BLE001
        refused = "already exists" in str(e)
    files.write_pois(p.where("id % 2 = 1"), path, force=True)
    return files.read_parquet(spark, path).where(F.lit(refused)).select("id", "name")


@query("SELECT p_name AS name, CAST(p_partkey AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0")
def layer_points(spark, sf):
    """A layer's points: other geometries and rows without a place go, and an absent layer is empty."""
    k, path = F.col("p_partkey"), scratch(spark, "layer")
    kind = F.when(k % 3 == 0, "Point").when(k % 3 == 1, "Polygon").otherwise("LineString")
    shape = F.when(k % 5 == 0, None).otherwise(F.format_string("POINT (%d %d)", k, "p_size"))
    fx.read(spark, sf, "part").select(F.col("p_name").alias("name"), kind.alias("geom_type"), shape.alias("geometry")).write.parquet(path)
    columns = schema.struct(name=T.StringType(), x=T.DoubleType(), y=T.DoubleType())
    return files.read_layer(spark, path, columns).select("name", "x", "y").unionByName(files.read_layer(spark, path + "-absent", columns))


@query("SELECT * FROM (VALUES ('s_suppkey', 'bigint', 5), ('s_name', 'string', 5), ('s_nationkey', 'int', 5), ('s_acctbal', 'double', 5)) AS t(\"column\", type, shown)")
def inspected(spark, sf):
    types, first = files.inspect(fx.read(spark, sf, "supplier"))
    return spark.createDataFrame([(c, t, len(first)) for c, t in types], "column string, type string, shown int")


# Cleaning ------------------------------------------------------------------------------------


@query(
    "WITH c AS (SELECT c_custkey AS k, c_custkey % 5 AS f FROM customer) SELECT k, CASE f WHEN 0 THEN 8.0::DOUBLE + k / 1000.0::DOUBLE WHEN 1 THEN 8.0::DOUBLE + k / 1000.0::DOUBLE WHEN 2 THEN 85.0 END AS lon, CASE f WHEN 0 THEN 47.0 - k / 1000.0::DOUBLE WHEN 1 THEN 47.0 - k / 1000.0::DOUBLE WHEN 2 THEN -4.7 END AS lat,"
    " CASE WHEN f IN (0, 2) THEN 'point' ELSE '-' END AS kind FROM c"
)
def geometry_forms(spark, sf):
    k = F.col("c_custkey")
    lon, lat = (F.format_string("%.3f", x) for x in (F.lit(8.0) + k / 1000, F.lit(47.0) - k / 1000))
    shape = F.when(k % 5 == 0, F.concat(F.lit(" POINT ("), lon, F.lit(" "), lat, F.lit(")"))).when(k % 5 == 1, F.concat(F.lit("("), lat, F.lit(", "), lon, F.lit(")")))
    shape = shape.when(k % 5 == 2, "point(8.5e1 -4.7E0)").when(k % 5 == 3, "LINESTRING (1 1, 2 2)")
    g = fx.read(spark, sf, "customer").select(k.alias("k"), shape.alias("g"))
    lon, lat = geo.any_point("g")
    return g.select("k", lon.alias("lon"), lat.alias("lat"), clean.geometry_type(F.coalesce("g", F.lit(""))).alias("kind"))


@query(
    "SELECT CAST(c_custkey AS VARCHAR) AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 8.1234::DOUBLE WHEN c_custkey % 3 = 1 THEN 8.5::DOUBLE END AS lon, CASE WHEN c_custkey % 3 = 0 THEN 47.4321::DOUBLE WHEN c_custkey % 3 = 1 THEN 47.0::DOUBLE END AS lat,"
    " CASE WHEN c_custkey % 2 = 0 THEN '-' ELSE 'car' END AS mode FROM customer"
)
def existing_coordinates(spark, sf):
    """Coordinates that are there count before those of the geometry; modes have another default."""
    k = F.col("c_custkey")
    raw = fx.read(spark, sf, "customer").select(
        k.cast("string").alias("user_id"), F.lit("a").alias("location_id"), F.lit("2024-01-01 00:00:00").alias("started_at"),
        F.when(k % 3 == 0, "8.123411").alias("lon"), F.when(k % 3 == 0, "47.432099").alias("lat"), F.when(k % 3 == 1, "POINT (8.5 47)").when(k % 3 == 0, "POINT (1 2)").alias("geometry"),
        clean.mode(F.when(k % 2 == 1, "CAR"), "-").alias("mode"),
    )
    return mobility.clean_staypoints(raw).select("user_id", "lon", "lat", "mode")


_KINDS = ["church", "mosque", "park", "zoo", "supermarket", "books", "airport", "taxi", "atm", "library", "kindergarten", "school", "hotel", "pub", "tree", "Pub", None]


@query(
    "WITH p AS (SELECT p_partkey AS id, p_partkey % 17 AS k FROM part) SELECT id, CASE WHEN k <= 1 THEN 'Civic' WHEN k <= 3 THEN 'Entertainment' WHEN k <= 5 THEN 'Shopping' WHEN k <= 7 THEN 'Transportation' WHEN k <= 9 THEN 'Services' WHEN k <= 11 THEN 'Schools' WHEN k <= 13 THEN 'Residential' ELSE 'Others' END AS category FROM p"
)
def fclass_categories(spark, sf):
    kind = F.get(F.array(*[F.lit(x) for x in _KINDS]), (F.col("p_partkey") % 17).cast("int"))
    return fx.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), clean.category(kind).alias("category"))


@query(
    "WITH p AS (SELECT p_partkey AS k, p_name AS name, p_partkey % 4 AS f FROM part), a AS (SELECT CASE WHEN f = 1 THEN 'Entertainment' ELSE 'Others' END AS category, name, CAST(k AS DOUBLE) AS x, 0.0::DOUBLE AS y FROM p WHERE f <> 0"
    " UNION ALL SELECT 'Entertainment', name || ' area', k + 1.0::DOUBLE, 1.0::DOUBLE FROM p WHERE f = 1 UNION ALL SELECT 'Others', name || ' parking', CAST(k AS DOUBLE), 5.0::DOUBLE FROM p WHERE f IN (2, 3) UNION ALL SELECT 'Unknown', s_name, CAST(s_suppkey AS DOUBLE), 9.0::DOUBLE FROM supplier)"
    " SELECT row_number() OVER (ORDER BY category, name, x, y) - 1 AS id, category, name, x, y FROM a"
)
def osm_layers(spark, sf):
    """Layers with their rules and areas at their centroids, classified and numbered."""
    p = fx.read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), (F.col("p_partkey") % 4).cast("int").alias("f"))
    pick = lambda *names: F.get(F.array(*[F.lit(x) for x in names]), F.col("f")).alias("fclass")
    x, zero = F.col("k").cast("double").alias("x"), F.lit(0.0).alias("y")
    corner = lambda a, b: F.struct((F.col("k") + a).cast("double").alias("x"), F.lit(float(b)).alias("y"))
    square = F.array(corner(0, 0), corner(2, 0), corner(2, 2), corner(0, 2), corner(0, 0)).alias("ring")
    layers = {
        "natural": p.select(pick("tree", "beach", "cliff", "cave"), "name", x, zero),
        "natural_areas": p.select(pick("tree", "beach", "cliff", "cave"), F.concat("name", F.lit(" area")).alias("name"), square),
        "traffic": p.select(pick("crossing", "stop", "parking", "parking_bicycle"), F.concat("name", F.lit(" parking")).alias("name"), x, F.lit(5.0).alias("y")),
        "plain": fx.read(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("double").alias("x"), F.lit(9.0).alias("y")),
    }
    return nearest.osm_pois(layers).select("id", "category", "name", "x", "y")


@query(f"WITH {SURVEY_SQL} SELECT participant_id, income, gender FROM survey WHERE coalesce(lower(income) NOT LIKE '%prefer not%', true) AND coalesce(lower(gender) NOT LIKE '%prefer not%', true)")
def refused_labels(spark, sf):
    s = fx.survey(spark, sf)
    return s.where(~clean.refused("income") & ~clean.refused("gender")).select("participant_id", "income", "gender")


@query("SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS name, o_orderkey AS k FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderkey % 10 = 0")
def trimmed_ids(spark, sf):
    pad = lambda c, a, b: F.concat(F.lit(a), F.col(c).cast("string"), F.lit(b))
    c = clean.trimmed(fx.read(spark, sf, "customer").select(pad("c_custkey", "\t ", " \n").alias("user_id"), F.col("c_name").alias("name")), "user_id")
    o = clean.trimmed(fx.read(spark, sf, "orders").where("o_orderkey % 10 = 0").select(pad("o_custkey", " ", "").alias("user_id"), F.col("o_orderkey").alias("k")), "user_id")
    return clean.only(c.join(o, "user_id"), ["user_id", "absent", "name", "k"])


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 60, 1) + 0.0 AS hours, floor(l_linenumber / 3) * 3 AS block, coalesce(CAST(round_even(l_quantity / 7 * 10, 0) AS BIGINT), 0) AS minutes, floor((l_quantity - 25) / (200 / 111000.0::DOUBLE)) AS cell FROM lineitem"
)
def number_rules(spark, sf):
    """Hours, blocks of hours, whole minutes and grid cells of quantities."""
    q = F.col("l_quantity")
    return fx.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", clean.hours(q).alias("hours"), clean.hour_block("l_linenumber", 3).alias("block"), clean.whole_minutes(q / 7 * 10).alias("minutes"), geo.cell(q - 25, 200).alias("cell"))


# Places --------------------------------------------------------------------------------------


@query(
    "SELECT p_partkey AS id, ['North','North-East','East','South-East','South','South-West','West','North-West'][CAST(floor((fmod(degrees(atan2(p_partkey % 50 - 25.0, p_size - 25.0)) + 360, 360) + 22.5) / 45) AS BIGINT) % 8 + 1] AS legacy FROM part WHERE p_size <> 25 OR p_partkey % 50 <> 25"
)
def legacy_bearing(spark, sf):
    p = fx.read(spark, sf, "part").where("p_size <> 25 or p_partkey % 50 <> 25")
    return p.select(F.col("p_partkey").alias("id"), geo.bearing(F.col("p_size") - 25.0, F.col("p_partkey") % 50 - 25.0, legacy=True).alias("legacy"))


@query(
    f"WITH {STAY}, d AS (SELECT DISTINCT location_id, lon, lat FROM stay), g AS (SELECT location_id, (lon*3600 - 26782.5)/10000 AS y, (lat*3600 - 169028.66)/10000 AS x FROM d),"
    " p AS (SELECT location_id, round_even(2600072.37 + 211455.93*y - 10938.51*y*x - 0.36*y*x*x - 44.54*y*y*y, 3) AS x, round_even(1200147.07 + 308807.95*x + 3745.25*y*y + 76.63*x*x - 194.56*y*y*x + 119.79*x*x*x, 3) AS y FROM g)"
    " SELECT 'degrees' AS system, * FROM p UNION ALL SELECT 'swiss', * FROM p"
)
def crs_inferred(spark, sf):
    """Coordinates whose system is told by their median, once in degrees and once in metres already."""
    d = fx.staypoints(spark, sf).select("location_id", F.col("lon").alias("x"), F.col("lat").alias("y")).distinct()
    once = geo.to_lv95(d, "x", "y")
    twice = geo.to_lv95(once, "x", "y")
    both = once.withColumn("system", F.lit("degrees")).unionByName(twice.withColumn("system", F.lit("swiss")))
    return both.select("system", "location_id", F.bround("x", 3).alias("x"), F.bround("y", 3).alias("y"))


@query(
    "WITH p AS (SELECT p_partkey AS id, p_partkey % 100 AS location_id, p_name AS name, p_partkey % 7 AS c, p_size / 8.0::DOUBLE AS km FROM part), s AS (SELECT id, location_id, km, regexp_replace(regexp_replace(printf('%.3f', km), '0+$', ''), '\\.$', '.0') || ' km to the ' || CASE WHEN id % 2 = 0 THEN 'north-east' ELSE 'south' END || ': ' ||"
    " CASE WHEN c = 0 AND id % 3 = 0 THEN 'point of interest' WHEN c = 0 THEN name WHEN id % 3 = 0 THEN 'Civic' ELSE 'Civic ' || name END AS said FROM p) SELECT location_id, string_agg(said, '; ' ORDER BY km, id) AS nearby FROM s GROUP BY 1"
)
def poi_sentences(spark, sf):
    k = F.col("p_partkey")
    item = F.struct((F.col("p_size") / 8.0).alias("km"), k.alias("id"), F.when(k % 2 == 0, "North-East").otherwise("South").alias("direction"), F.when(k % 7 > 0, "Civic").otherwise("-").alias("category"), F.when(k % 3 > 0, F.col("p_name")).alias("name"))
    rows = fx.read(spark, sf, "part").groupBy((k % 100).alias("location_id")).agg(F.collect_list(item).alias("items"))
    return rows.select("location_id", F.concat_ws("; ", text.poi_sentences("items")).alias("nearby"))


# Features ------------------------------------------------------------------------------------


@query(f"WITH {SLICED} SELECT user_id, slice, {r6('sqrt(coalesce(var_samp(distance), 0.0))')} AS rog_trips FROM sliced GROUP BY 1, 2")
def gyration_of_trips(spark, sf):
    return features.gyration_of_trips(sliced(spark, sf), BY)


@query(
    f"WITH {STAY}, {SURVEY_SQL}, n AS (SELECT user_id, count(*) AS trips, {r6('sum(distance) / count(DISTINCT date)')} AS distance_per_day FROM stay GROUP BY 1) SELECT user_id, trips, distance_per_day, gender, income FROM n JOIN survey ON user_id = participant_id"
)
def features_survey(spark, sf):
    s = fx.staypoints(spark, sf)
    table = features.rates(s, ["user_id"]).join(s.groupBy("user_id").agg(F.count("*").alias("trips")), "user_id")
    survey = fx.survey(spark, sf)
    return table.join(survey, table["user_id"] == survey["participant_id"]).select("user_id", "trips", "distance_per_day", "gender", "income")


# Prompts and answers -------------------------------------------------------------------------

_MONTH = "['click','error','purchase','signup','view']"


@query("SELECT c_custkey AS user_id, 'User: ' || c_custkey || chr(10) || chr(10) || 'Mobility record for one week in Switzerland:' AS head, c_name AS last, CASE c_custkey % 3 WHEN 0 THEN 'Mobility sequence:' ELSE 'Mobility evidance:' END AS evidence, 5 AS dashes FROM customer")
def task_prompts(spark, sf):
    """The three task texts: how they begin, what stands before the evidence, and how many list marks they have."""
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, text.prompt(k, "c_name", "income")).when(k % 3 == 1, text.prompt(k, "c_name", "age")).otherwise(text.prompt(k, "c_name", "all"))
    lines = F.split(said, "\n")
    marks = F.size(F.filter(lines, lambda x: x.startswith("-") | x.startswith("1. ")))
    return fx.read(spark, sf, "customer").select(k.alias("user_id"), F.concat_ws("\n", F.slice(lines, 1, 3)).alias("head"), F.element_at(lines, -1).alias("last"), F.element_at(lines, -2).alias("evidence"), marks.alias("dashes"))


@query(
    "WITH d AS (SELECT doc_id, text, regexp_replace(text, '^[ \\t\\n\\x0b\\f\\r]+', '') AS t FROM documents), w AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE len(regexp_extract_all(t, '[^ \\t\\n\\x0b\\f\\r]+')) END AS n FROM d)"
    " SELECT doc_id, n > 76 AS truncated, least(n, 76) AS words FROM w"
)
def context_truncated(spark, sf):
    """Documents cut to what 400 tokens leave beside 300 new ones."""
    d = fx.read(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    cut = inference.truncate_to_context(d, 400, 300)
    return cut.select("doc_id", "truncated", F.size(F.filter(F.split("prompt", "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "")).alias("words"))


@query(
    "WITH c AS (SELECT conv_id, turn, role, text FROM conversations) SELECT conv_id, turn, CASE WHEN role = 'user' THEN array_to_string(string_split(text, ' ')[1:20], ' ') ELSE text END AS content FROM c"
)
def truncated_turns(spark, sf):
    c = fx.read(spark, sf, "conversations")
    records = c.select("conv_id", "turn", F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"))
    return inference.truncate_user_turn(records, 20).select("conv_id", "turn", F.col("messages")[0]["content"].alias("content"))


@query(
    "SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'because ' || c_name WHEN 1 THEN c_name || chr(10) || 'so' ELSE '' END AS rationale, CASE c_custkey % 3 WHEN 0 THEN 'Gender: ' || c_mktsegment WHEN 1 THEN 'a: 1' || chr(10) || 'b: 2' || chr(10) || 'c: 3' || chr(10) || 'd: ' || c_mktsegment ELSE c_name END AS prediction FROM customer"
)
def rationale_split(spark, sf):
    k = F.col("c_custkey")
    marked = F.concat(F.lit("because "), "c_name", F.lit("\n---PREDICTION---\nGender: "), "c_mktsegment", F.lit("\n"))
    lined = F.concat("c_name", F.lit("\n\nso\n \na: 1\nb: 2\n\nc: 3\nd: "), "c_mktsegment")
    said = F.when(k % 3 == 0, marked).when(k % 3 == 1, lined).otherwise(F.col("c_name"))
    return fx.read(spark, sf, "customer").select(k.alias("k"), text.rationale_and_prediction(said).alias("x")).select("k", "x.rationale", "x.prediction")


@query("SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '{\"a\": {\"b\": ' || c_custkey || '}}' WHEN 1 THEN '{\"a\": 1}' END AS found FROM customer")
def greedy_json(spark, sf):
    k = F.col("c_custkey")
    said = F.when(k % 4 == 0, F.concat(F.lit('so {"a": {"b": '), k.cast("string"), F.lit("}} ok"))).when(k % 4 == 1, '{"a": 1}').when(k % 4 == 2, "{no} {nor}").otherwise("none")
    return fx.read(spark, sf, "customer").select(k.alias("k"), text.greedy_json(said).alias("found"))


@query(
    f"WITH {CLASSES_SQL} SELECT 'class' AS field, count(*) AS n, count(*) FILTER (coalesce(t, '') = coalesce(p, '')) AS \"right\", {r6('count(*) FILTER (coalesce(t, chr(32)) = coalesce(p, chr(32))) / count(*)')} AS accuracy, count(*) FILTER (p IS NULL) AS empty FROM cls"
)
def answer_accuracy(spark, sf):
    c = fx.classes(spark, sf)
    return evaluate.answer_accuracy(c.withColumn("p", F.upper("p")), {"class": ("t", "p")})


# Answers of many forms -----------------------------------------------------------------------

_SAID = ["", " ", "Male", "male, I think", "FEMALE", "f", "other", "Other gender", "prefer not to say", "non-binary", "18-24", "25-34 years", "65", "65+", "0-17", "2", "5 or more", "5+", "1 or 2", ">16000", "16000+", "16001", "4001-8000 CHF", "<4000", "8001", "12001-16000", "none", "x", None]
_LIST = "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in _SAID) + "]"


def _allowed_sql(field: str) -> str:
    values = "[" + ", ".join(f"'{x}'" for x in schema.ALLOWED[field]) + "]"
    return f"CASE WHEN v = '' THEN NULL WHEN list_contains({values}, v) THEN v ELSE list_filter({values}, lambda a: contains(v, a) OR contains(a, v))[1] END"


@query(
    f"WITH p AS (SELECT c_custkey AS k, {_LIST}[c_custkey % {len(_SAID)} + 1] AS said FROM customer), s AS (SELECT k, replace(replace(replace(replace(replace(lower(trim(coalesce(said, ''))), 'prefer not to say', 'female'), 'other', 'male'), '5 or more', '5+'), '>16000', '16001+'), '16000+', '16001+') AS v FROM p)"
    + " SELECT k, " + ", ".join(f"coalesce({_allowed_sql(f)}, '{d}') AS {f}, {_allowed_sql(f)} IS NULL AS {f}_defaulted" for f, d in schema.DEFAULTS.items()) + " FROM s"
)
def validated_fields(spark, sf):
    """Each field made valid from answers of many forms."""
    k = F.col("c_custkey")
    said = F.get(F.array(*[F.lit(x) for x in _SAID]), (k % len(_SAID)).cast("int"))
    made = fx.read(spark, sf, "customer").select(k.alias("k"), *[text.allowed_answer(said, f).alias(f"_{f}") for f in schema.DEFAULTS])
    return made.select("k", *[c for f in schema.DEFAULTS for c in (F.col(f"_{f}.value").alias(f), F.col(f"_{f}.defaulted").alias(f"{f}_defaulted"))])


# What stands around a JSON object, the object with %d for a number, and the number that is read of it.
_FORMS = [
    ('{"a": %d}', True), ('so {"a": 0} and {"a": %d} end', True), ("{'a': %d}", True), ("{a: %d}", True), ('{"a": %d,}', True), ('{"x": {"a": %d}}', True), ('{"a": %d', False), ("nothing %d", False),
    ('[{"a": %d}]', True), ('{"a": [%d,]}', False), ('{"a": %d} {broken', True), ('{"a": %d} {not json either: }', True), ("```json\n{\"a\": %d}\n```", True), ('{"a" %d}', False), ("{ a : %d , }", True), ('{"b": %d}', False),
]


@query("SELECT c_custkey AS k, CASE WHEN list_contains([" + ", ".join(str(i) for i, (_, ok) in enumerate(_FORMS) if ok) + f"], c_custkey % {len(_FORMS)}) THEN CAST(c_custkey AS VARCHAR) END AS a FROM customer")
def json_forms(spark, sf):
    k = F.col("c_custkey")
    said = F.get(F.array(*[F.format_string(form, k) for form, _ in _FORMS]), (k % len(_FORMS)).cast("int"))
    found = F.get_json_object(text.recovered_json(said), "$.a")
    return fx.read(spark, sf, "customer").select(k.alias("k"), F.when(found.rlike(r"^\d+$"), found).alias("a"))
