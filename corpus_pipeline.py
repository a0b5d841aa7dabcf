"""The corpus pipeline: quality rules, SimHash near-dedup, substring dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir), is written as Parquet, and the next stage reads that table. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perambula.llm import phrases, quality, queries, simhash
from perambula.llm.common import write_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, as they are.

    Rows are judged one by one, whatever their ids: repeated rows share a verdict. A null or empty text has
    no words and goes.
    """
    trusted = quality.trusted_documents(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality_rules(docs, trusted).where("kept").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that with the smallest id, and one row of it.

    Only ids that go, or that several rows have, are looked at: all other rows pass an anti-join. Of rows that
    share an id one stays for each group that the id is first of: that with the least hash, then the least
    text. Rows without an id are nobody's copy and stay. Null and empty texts are one group.
    """
    found = simhash.near_duplicates(docs.select("doc_id", "text")).where("doc_id is not null")
    first = F.col("doc_id") == F.col("component_id")
    ids = found.groupBy("doc_id").agg(F.bool_or(first).alias("first"), F.count("*").alias("n"))
    ids = write_table(ids.where("not first or n > 1"), "ids")
    kept = docs.join(ids, "doc_id", "left_anti")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"), F.struct(*docs.columns).alias("doc"))
    rows = rows.join(ids.where("first"), "doc_id", "left_semi")
    fps = simhash.fingerprints(rows.select("digest", "text"), id_col="digest").distinct().select(F.col("doc_id").alias("digest"), "fp")
    rows = rows.join(fps, "digest").join(found.where(first).select("doc_id", "fp", "root").distinct(), ["doc_id", "fp"])
    rank = F.row_number().over(Window.partitionBy("doc_id", "root").orderBy("digest", "doc"))
    return kept.select(docs.columns).unionByName(rows.withColumn("rank", rank).where("rank = 1").select("doc.*"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words that a smaller document has; texts with nothing left go.

    What stays is cut out of the text, white space included; texts without such passages, null ones too, and
    all other columns stay as they are, but n_chars is that of the cut text.
    """
    rest = [c for c in docs.columns if c != "text"]
    marked = docs.select("doc_id", "text", F.struct(*rest).alias("rest"), F.col("text").isNull().alias("no_text"))
    found = phrases.remove_repeated_passages(marked, carry=["rest", "no_text"])
    cut = F.size("spans") > 0
    kept = found.where(~cut | (F.col("kept_text") != ""))
    made = {c: F.col(f"row.rest.`{c}`") for c in docs.columns if c != "text"}
    made["text"] = F.when(~F.col("row.no_text"), F.col("cut_text"))
    if "n_chars" in made:
        made["n_chars"] = F.when(cut, F.length("cut_text")).otherwise(made["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[made[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the permitted lengths, with their documents; null and empty texts are their end mark."""
    return queries.sequences(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("best-fit packing", pack),
]

#: The stages hash with XXH64 and pack greedily, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_table(docs, f"stage{k}")
    return docs
