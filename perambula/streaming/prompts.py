"""An incremental form of the prompt stage: new prompt files are answered once and appended as JSON lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from perambula.functions.clean import strip
from perambula.functions.text import SEPARATOR, prompt_user
from perambula.operators import inference
from perambula.sources import files


def watch_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (user_id, prompt) from the prompt files that come into a folder."""
    blocks = spark.readStream.option("lineSep", SEPARATOR).text(folder).select(strip("value").alias("prompt"))
    return blocks.where("prompt <> ''").select(prompt_user("prompt").alias("user_id"), "prompt")


def answer_prompts(spark: SparkSession, folder: str, out: str, checkpoint: str, predictor: Callable = inference.rule_predictor) -> StreamingQuery:
    """Answers what has come, once, and ends: run again for what comes later. A user is answered once."""

    def write(batch: DataFrame, _: int) -> None:
        fs = spark._jvm.org.apache.hadoop.fs.Path(out)
        there = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
        done = files.done_users(spark, out) if there else spark.createDataFrame([], "user_id string")
        new = inference.todo(batch.groupBy("user_id").agg(F.min("prompt").alias("prompt")), done)
        files.append_jsonl(inference.parsed(inference.predict(new, predictor)), out)

    return watch_prompts(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_activity(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stays, users and minutes for each hour and mode of a stream of staypoints; rows later than `late` are left out."""
    w = events.withWatermark("started_at", late).groupBy(F.window("started_at", "1 hour"), "mode")
    made = w.agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"), F.sum("act_duration").alias("minutes"))
    return made.select(F.col("window.start").alias("hour"), "mode", "n", "users", "minutes")
