"""Readers and writers: staypoint CSV, JSON lines, prompt files, Parquet layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perambula import schema
from perambula.functions import geo
from perambula.functions.clean import strip
from perambula.functions.text import SEPARATOR, prompt_user

CORRUPT = "_corrupt"


def read_staypoints_csv(spark: SparkSession, path: str, columns: T.StructType = schema.STAYPOINTS_RAW, separator: str = ",") -> DataFrame:
    """All strings. Lines with too many fields are skipped; short lines are kept, their missing fields null."""
    full = T.StructType([*columns.fields, T.StructField(CORRUPT, T.StringType())])
    df = spark.read.schema(full).option("header", True).option("sep", separator).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path)
    # separators outside of quotes: an even number of quotes comes after them
    fields = F.size(F.split(F.col(CORRUPT), rf"{separator}(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"))
    return df.where(F.col(CORRUPT).isNull() | (fields <= len(columns.fields))).drop(CORRUPT)


def read_csv(spark: SparkSession, path: str, columns: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(columns).csv(path) if columns else reader.option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_layer(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """An exported layer (x, y or geometry, fclass or type, name, code): points only; an absent file is an empty layer."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], columns)
    df = spark.read.parquet(path)
    if "geometry" in df.columns and "x" not in df.columns:
        x, y = geo.wkt_point("geometry")
        df = df.withColumns({"x": x, "y": y}).drop("geometry")
    if "geom_type" in df.columns:
        df = df.where(F.col("geom_type") == "Point")
    return df.where("x is not null and y is not null")


def read_jsonl(spark: SparkSession, path: str, columns: T.StructType = schema.PREDICTIONS) -> DataFrame:
    """Rows that can be read; empty and broken lines are left out."""
    full = T.StructType([*columns.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    return rows.where(f"r.{CORRUPT} is null").select([F.col(f"r.{f.name}") for f in columns.fields])


def done_users(spark: SparkSession, path: str) -> DataFrame:
    """(user_id) of what a JSON lines file already holds, as text."""
    rows = spark.read.text(path).select(F.get_json_object(F.when(F.try_parse_json("value").isNotNull(), F.col("value")), "$.user_id").alias("user_id"))
    return rows.where("user_id is not null").distinct()


def read_prompts(spark: SparkSession, path: str, separator: str = SEPARATOR) -> DataFrame:
    """(user_id, prompt) of a file of prompts separated by a line of 80 equals signs; empty ones are left out."""
    blocks = spark.read.option("lineSep", separator).text(path).select(strip("value").alias("prompt"))
    return blocks.where("prompt <> ''").select(prompt_user("prompt").alias("user_id"), "prompt")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(prompt) of a file cut where a line of 80 or more equals signs stands between empty lines."""
    whole = spark.read.text(path, wholetext=True)
    parts = whole.select(F.explode(F.split("value", r"\n{2,}={80,}\n{2,}")).alias("part")).select(strip("part").alias("prompt"))
    return parts.where("prompt <> ''")


def read_headed_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, prompt) of a file with `===USER_id===` or `USER_id:` heads; else of lines `id<tab>prompt`."""
    whole = spark.read.text(path, wholetext=True)
    head = r"(?m)^(?:===USER_\S+?===|USER_\S+?:)[ \t]*$"
    parts = F.arrays_zip(F.regexp_extract_all("value", F.lit(head), F.lit(0)).alias("head"), F.slice(F.split("value", head), F.lit(2), F.lit(2**31 - 1)).alias("text"))
    first = whole.where(F.col("value").rlike(head)).select(F.inline(parts).alias("head", "text"))
    first = first.select(F.regexp_replace("head", r"^(?:===)?USER_|(?:===|:)[ \t]*$", "").alias("user_id"), strip("text").alias("prompt"))
    tabbed = whole.where(~F.col("value").rlike(head)).select(F.explode(F.split("value", r"\r?\n")).alias("line")).where(F.col("line").contains("\t"))
    return first.unionByName(tabbed.select(strip(F.substring_index("line", "\t", 1)).alias("user_id"), strip(F.expr("substring(line, instr(line, '\t') + 1)")).alias("prompt")))


# Writers -------------------------------------------------------------------------------------


def _mode(force: bool) -> str:
    return "overwrite" if force else "errorifexists"


def write_csv(df: DataFrame, path: str, force: bool = True) -> None:
    df.write.mode(_mode(force)).option("header", True).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def write_jsonl(df: DataFrame, path: str, force: bool = True) -> None:
    df.write.mode(_mode(force)).json(path)


def snapshot_csv(spark: SparkSession, source: str, path: str, columns: T.StructType = schema.PREDICTIONS) -> bool:
    """JSON lines as CSV, lists joined; False if there is nothing to read."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(source)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return False
    df = read_jsonl(spark, source, columns)
    flat = [F.concat_ws("; ", f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in columns.fields]
    write_csv(df.select(*flat), path)
    return True


def write_pois(df: DataFrame, path: str, force: bool = False) -> None:
    """Points of interest as Parquet; refuses to replace a table unless forced."""
    df.write.mode(_mode(force)).parquet(path)


def write_prompts(df: DataFrame, path: str, order: str = "user_id", separator: str = SEPARATOR) -> None:
    """Prompts in order of user, each followed by a separator between empty lines; part files follow the order."""
    df.orderBy(order).select(F.concat("prompt", F.lit(f"\n\n{separator}\n")).alias("value")).write.mode("overwrite").text(path)


def write_chat(df: DataFrame, path: str, force: bool = True) -> None:
    df.select("messages").write.mode(_mode(force)).json(path)


def union_layers(*layers: DataFrame) -> DataFrame:
    """All rows; columns that a layer lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


def inspect(df: DataFrame, n: int = 5) -> tuple[list[tuple[str, str]], list]:
    """Column names and types, and the first rows."""
    return df.dtypes, df.limit(n).collect()
