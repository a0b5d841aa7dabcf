"""The test tables as mobility tables, in Spark and, as common table expressions, in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a model may have said to a customer's prompt; the same text in both dialects.
ANSWER = """CASE c_custkey % 8
 WHEN 0 THEN '{"age_group": "26-35", "gender": "female", "income_level": "4001-8000", "household_size": "2"}'
 WHEN 1 THEN 'so: {age_group: "36-45", gender: "male", household_size: "3",}'
 WHEN 2 THEN 'income between 4,001 and 8,000 CHF; age 18-25, male, 1 person'
 WHEN 3 THEN '8001–12000 a month, other, aged 46-55'
 WHEN 4 THEN 'more than 16000'
 WHEN 5 THEN '{"age_group": "66+", "household_income_level": "12001-16000"}'
 WHEN 6 THEN 'no idea'
 ELSE 'between 4000 and 9000, female' END"""

# Income and other survey answers of a customer.
SURVEY = """SELECT c_custkey AS participant_id,
 CASE c_custkey % 7 WHEN 0 THEN '4 000 CHF or less' WHEN 1 THEN '4 001 - 8 000 CHF' WHEN 2 THEN '8 001 - 12 000 CHF' WHEN 3 THEN '12 001 - 16 000 CHF'
  WHEN 4 THEN 'More than 16 000 CHF' WHEN 5 THEN 'Prefer not to say' END AS income,
 CASE WHEN c_custkey % 11 = 0 THEN 'thirty' WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(15 + c_custkey % 60 AS {string}) END AS age,
 CASE WHEN c_custkey % 9 = 8 THEN 'two' ELSE CAST(c_custkey % 9 AS {string}) END AS household_size,
 CASE c_custkey % 6 WHEN 0 THEN 'M' WHEN 1 THEN 'woman' WHEN 2 THEN ' Female ' WHEN 3 THEN 'diverse' WHEN 4 THEN 'prefer not' END AS gender
 FROM customer"""

# True and predicted classes of a customer.
CLASSES = """SELECT c_custkey AS user_id,
 CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 'c' || CAST(c_custkey % 4 AS {string}) END AS t,
 CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'c' || CAST(c_custkey % 5 AS {string}) ELSE 'c' || CAST(c_custkey % 4 AS {string}) END AS p
 FROM customer"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str, table: str = "customer") -> DataFrame:
    read(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(text.replace("{string}", "STRING"))


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, SURVEY)


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CLASSES)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, f"SELECT c_custkey AS user_id, {ANSWER} AS text FROM customer")


def staypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.select(
        "event_id",
        "user_id",
        F.col("ts").alias("started_at"),
        F.expr("timestampadd(MICROSECOND, cast(bround(value * 60000000) as bigint), ts)").alias("finished_at"),
        F.col("value").alias("act_duration"),
        (F.col("value") / 10).alias("distance"),
        F.col("event_type").alias("mode"),
        F.col("k").alias("location_id"),
        (F.lit(8.45) + F.col("k") % 10 * F.lit(0.01)).alias("lon"),
        (F.lit(47.30) + F.floor(F.col("k") / 10) * F.lit(0.01)).alias("lat"),
        F.to_date("ts").alias("date"),
        F.weekday("ts").alias("dow"),
        F.hour("ts").alias("hour_bin"),
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(location_id, x, y), one row a location, in metres on a plane."""
    e = read(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("location_id")).distinct()
    return e.select("location_id", (F.col("location_id") % 10 * 1000.0).alias("x"), (F.floor(F.col("location_id") / 10) * 1000.0).alias("y"))


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    kind = F.substring_index("p_type", " ", 1)
    named = F.when(kind == "STANDARD", "Others").when(kind == "ECONOMY", None).otherwise(F.initcap(F.lower(kind)))
    key = F.col("p_partkey")
    return p.select(key.alias("id"), F.col("p_name").alias("name"), named.alias("category"), ((key * 37) % 997 * 10.0).alias("x"), ((key * 53) % 991 * 10.0).alias("y"))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"])
    k = F.col("s_suppkey")
    road = F.when(k % 7 == 0, "-").when(k % 11 == 0, "None").otherwise(F.col("s_name"))
    return rows.select((k % 100).alias("location_id"), k.alias("suppkey"), road.alias("road"), F.col("n_name").alias("city"), (8000 + k % 90).cast("string").alias("postcode"))


# DuckDB --------------------------------------------------------------------------------------

STAY = """stay AS (SELECT event_id, user_id, ts AS started_at, ts + to_microseconds(CAST(round_even(value*60000000, 0) AS BIGINT)) AS finished_at, value AS act_duration, value/10 AS distance,
 event_type AS mode, k AS location_id, 8.45::DOUBLE + k % 10 * 0.01::DOUBLE AS lon, 47.30::DOUBLE + floor(k/10) * 0.01::DOUBLE AS lat, CAST(ts AS DATE) AS date, isodow(ts)-1 AS dow, hour(ts) AS hour_bin
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
SLICED = STAY + """, sliced AS (SELECT *, unnest(['all', CASE WHEN dow < 5 THEN 'weekday' ELSE 'weekend' END]) AS slice FROM
 (SELECT *, round_even(lon,3) AS lon_r, round_even(lat,3) AS lat_r, printf('%.3f', round_even(lat,3)) || ',' || printf('%.3f', round_even(lon,3)) AS place FROM stay))"""
LOC = "loc AS (SELECT DISTINCT location_id, location_id % 10 * 1000.0::DOUBLE AS lx, floor(location_id/10) * 1000.0::DOUBLE AS ly FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS location_id FROM events))"
POI = """poi AS (SELECT p_partkey AS id, p_name AS name, CASE split_part(p_type,' ',1) WHEN 'STANDARD' THEN 'Others' WHEN 'ECONOMY' THEN NULL ELSE upper(substr(p_type,1,1)) || lower(substr(split_part(p_type,' ',1),2)) END AS category,
 (p_partkey*37) % 997 * 10.0::DOUBLE AS x, (p_partkey*53) % 991 * 10.0::DOUBLE AS y FROM part)"""
ADDRESS = """adr AS (SELECT location_id, CASE WHEN road IN ('None','none','','-','nan') THEN NULL ELSE road END AS road, city, postcode FROM
 (SELECT s_suppkey % 100 AS location_id, CASE WHEN s_suppkey % 7 = 0 THEN '-' WHEN s_suppkey % 11 = 0 THEN 'None' ELSE s_name END AS road, n_name AS city, CAST(8000 + s_suppkey % 90 AS VARCHAR) AS postcode,
  row_number() OVER (PARTITION BY s_suppkey % 100 ORDER BY s_suppkey) AS rn FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE rn = 1)"""
SURVEY_SQL = "survey AS (" + SURVEY.replace("{string}", "VARCHAR") + ")"
CLASSES_SQL = "cls AS (" + CLASSES.replace("{string}", "VARCHAR") + ")"
ANSWERS_SQL = f"ans AS (SELECT c_custkey AS user_id, {ANSWER} AS text FROM customer)"


def r6(x: str) -> str:
    return f"round_even({x}, 6) + 0.0"


def even(c: Column, digits: int) -> Column:
    """As the oracles' round_even: the scaled double goes to the nearest whole number. F.bround rounds its shortest decimal."""
    return F.when(F.abs(c) < 1e300, F.rint(c * 10.0**digits) / 10.0**digits).otherwise(c)


def out(df: DataFrame) -> DataFrame:
    """Whole numbers as long, doubles rounded to six places and without a negative zero."""
    made = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = df[f.name]
        made.append(c.cast("long").alias(f.name) if kind in ("int", "smallint", "tinyint") else (even(c.cast("double"), 6) + F.lit(0.0)).alias(f.name) if kind in ("double", "float") else c)
    return df.select(*made)
