"""Tables about labels: frequencies, missing values, accuracy, confusion, class reports, id sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perambula.functions.clean import plain_number


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """(value, n), the most frequent first, nulls included."""
    return df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value"))


def frequencies(df: DataFrame, **variables: str) -> DataFrame:
    """(Variable, Category, Count, Percentage) of several columns; percentages as text with one decimal."""
    parts = []
    for label, c in variables.items():
        counts = df.groupBy(F.col(c).alias("Category")).agg(F.count("*").alias("Count"))
        total = df.agg(F.count("*").alias("total"))
        share = F.bround(F.col("Count") * 100 / F.col("total"), 1)
        parts.append(counts.join(F.broadcast(total), F.lit(True)).select(F.lit(label.replace("_", " ")).alias("Variable"), "Category", "Count", F.concat(plain_number(share, 1), F.lit("%")).alias("Percentage")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def missing(df: DataFrame) -> DataFrame:
    """(column, missing, percent) of every column, in one pass."""
    n = F.greatest(F.count("*"), F.lit(1))
    row = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("missing"), F.bround(F.count_if(F.col(c).isNull()) * 100 / n, 2).alias("percent")) for c in df.columns]).alias("all"))
    return row.select(F.inline("all"))


def confusion(df: DataFrame, truth: str, predicted: str, values: list[str], share: bool = False) -> DataFrame:
    """A row a true class, a column a predicted class; share: of the row."""
    rows = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    n = F.count("*")
    cells = [F.count_if(F.col(predicted) == v) for v in values]
    made = [(F.bround(c / n, 6) if share else c).alias(f"pred_{v}") for c, v in zip(cells, values, strict=True)]
    return rows.groupBy(F.col(truth).alias("true_class")).agg(*made)


def accuracy(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(field, n, covered, coverage, accuracy, accuracy_missing_equal): the last counts pairs that both miss as equal.

    Accuracy is over rows where both are there, and 0 if there are none.
    """
    parts = []
    for field, (t, p) in pairs.items():
        both = F.col(t).isNotNull() & F.col(p).isNotNull()
        right = F.count_if(both & (F.col(t) == F.col(p)))
        covered = F.count_if(both)
        n = F.greatest(F.count("*"), F.lit(1))
        same = F.count_if(F.coalesce(F.col(t), F.lit("")) == F.coalesce(F.col(p), F.lit("")))
        parts.append(F.struct(F.lit(field).alias("field"), F.count("*").alias("n"), covered.alias("covered"), F.bround(covered / n, 6).alias("coverage"), F.bround(right / F.greatest(covered, F.lit(1)), 6).alias("accuracy"), F.bround(same / n, 6).alias("accuracy_missing_equal")))
    return df.agg(F.array(*parts).alias("all")).select(F.inline("all"))


def answer_accuracy(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(field, n, right, accuracy, empty): over all rows, in any case of letters; a missing answer is an empty text, and counted."""
    parts = []
    said = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    n = F.greatest(F.count("*"), F.lit(1))
    for field, (t, p) in pairs.items():
        right = F.count_if(said(t) == said(p))
        parts.append(F.struct(F.lit(field).alias("field"), F.count("*").alias("n"), right.alias("right"), F.bround(right / n, 6).alias("accuracy"), F.count_if(said(p) == "").alias("empty")))
    return df.agg(F.array(*parts).alias("all")).select(F.inline("all"))


def majority(df: DataFrame, c: str) -> DataFrame:
    """(share): that of the most frequent class among rows that have one."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    return counts.agg(F.bround(F.max("n") / F.sum("n"), 6).alias("majority_share"))


def paired(truth: DataFrame, predicted: DataFrame, fields: list[str], key: str = "user_id") -> DataFrame:
    """Inner join of truth and predictions, each field as <field>_true and <field>_pred."""
    t = truth.select(key, *[F.col(f).alias(f"{f}_true") for f in fields])
    return t.join(predicted.select(key, *[F.col(f).alias(f"{f}_pred") for f in fields]), key)


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(class, precision, recall, f1, support) of each class, then accuracy, macro and weighted averages; empty cases are 0."""
    rows = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).select(F.col(truth).cast("string").alias("t"), F.col(predicted).cast("string").alias("p"))
    both = rows.select(F.explode(F.array(F.struct(F.col("t").alias("class"), F.lit(1).alias("s"), F.lit(0).alias("q"), (F.col("t") == F.col("p")).cast("int").alias("h")), F.struct(F.col("p").alias("class"), F.lit(0).alias("s"), F.lit(1).alias("q"), F.lit(0).alias("h")))).alias("x"))
    per = both.groupBy("x.class").agg(F.sum("x.s").alias("support"), F.sum("x.q").alias("said"), F.sum("x.h").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    per = per.withColumns({"precision": ratio(F.col("hit"), F.col("said")), "recall": ratio(F.col("hit"), F.col("support"))})
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ["precision", "recall", "f1"]
    total = F.sum("support")
    mean = per.agg(
        F.struct(F.lit("accuracy").alias("class"), *[ratio(F.sum("hit"), total).alias(c) for c in names], total.alias("support")).alias("a"),
        F.struct(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names], total.alias("support")).alias("b"),
        F.struct(F.lit("weighted avg").alias("class"), *[ratio(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in names], total.alias("support")).alias("c"),
    )
    means = mean.select(F.explode(F.array("a", "b", "c")).alias("x")).select("x.*")
    table = per.select("class", *names, "support").unionByName(means)
    return table.select("class", *[F.bround(c, 6).alias(c) for c in names], F.col("support").cast("long").alias("support"))


def class_weights(df: DataFrame, c: str) -> DataFrame:
    """(class, n, weight): n of all over classes times n of the class."""
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("class")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.join(F.broadcast(whole), F.lit(True)).select("class", "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def length_stats(df: DataFrame, length: Column, over: tuple = (1024, 2048, 4096, 8192)) -> DataFrame:
    """Count, mean, extremes, exact percentiles, and how many are over some limits."""
    at = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    rows = df.select(length.cast("double").alias("x"))
    many = [F.percentile("x", q).alias(f"p{round(q * 100)}") for q in at]
    return rows.agg(F.count("x").alias("n"), F.bround(F.avg("x"), 6).alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"), *many, *[F.count_if(F.col("x") > k).alias(f"over_{k}") for k in over])


def missing_ids(wanted: DataFrame, there: DataFrame, c: str) -> DataFrame:
    """Distinct ids of one table that the other doesn't have."""
    return wanted.select(c).distinct().join(there.select(c), c, "left_anti")


def hash_ranked(df: DataFrame, stratum: str, key: str, seed: int) -> DataFrame:
    """With _rank, from 1 by the hash of key and seed within a stratum, and _total, the stratum's rows.

    Rows are ranked within 4096 ranges of hashes and counted before each, so that no stratum is sorted in
    one task.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    rows = df.withColumns({"_hash": h, "_range": F.shiftright(h, 52)})
    counts = rows.groupBy(F.col(stratum).alias("_of"), F.col("_range").alias("_in")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_of")
    counts = counts.withColumns({"_before": F.sum("_n").over(w.orderBy("_in")) - F.col("_n"), "_total": F.sum("_n").over(w)}).drop("_n")
    own = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum, "_range").orderBy("_hash", key)))
    found = own.join(counts, own[stratum].eqNullSafe(counts["_of"]) & (own["_range"] == counts["_in"]))
    return found.withColumn("_rank", F.col("_rank") + F.col("_before")).select(*df.columns, "_rank", "_total")


def split(df: DataFrame, share: float = 0.2, seed: int = 42, key: str = "user_id", stratum: str | None = None) -> DataFrame:
    """With `part`, test or train: of each stratum, the rows with the least hash of key and seed are the test part."""
    if not stratum:  # no order of all rows: the hash itself decides
        h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000))
        return df.withColumn("part", F.when(h < int(share * 1_000_000), F.lit("test")).otherwise(F.lit("train")))
    part = F.when(F.col("_rank") <= F.round(F.col("_total") * share), F.lit("test")).otherwise(F.lit("train"))
    return hash_ranked(df, stratum, key, seed).withColumn("part", part).drop("_rank", "_total")
