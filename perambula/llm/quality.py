"""Quality rules: base counts of each text, then a hashed n-gram log-likelihood ratio.

Words and pairs of words are hashed into a fixed number of features. Two multinomials over the features
are compared: that of the whole corpus, counted over every document, and that of trusted documents. A
document's score is the mean over its features of log(p_trusted / p_corpus); documents at or above a
threshold stay. All trusted documents are scored by a target that leaves out their own fold, too; where few
labels make these scores low, all scores are raised, so that the threshold is at a low quantile of them.

Everything is made of DataFrame functions. One partial aggregate with a row per feature is shuffled, and the
driver holds a weight per feature and fold (FEATURES of them, whatever the corpus); scoring is a map over the
documents, written to a table that the verdict is read from.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perambula.llm.common import write_table

FEATURES = 8192
#: Mean log ratio from which a document stays.
THRESHOLD = -0.045
#: Ids of trusted documents that are broadcast; more are joined by a shuffle.
BROADCAST_MOST = 2_000_000
#: Counts that the corpus distribution adds to those of the target, as a share of these.
PRIOR_SHARE = 0.1
#: Folds of the trusted documents, and the share of them that may fall below the threshold when scored by the other folds.
FOLDS, QUANTILE = 8, 0.005
#: Steps of a score that the quantile is first looked for in.
STEP = 1 / 1024
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SPACE = r" \t\n\u000B\u000C\r"
_SPACES = "\\x20\\x09-\\x0D"


def hold(value: Column) -> Column:
    """The value, made once: filters and projections above can't be merged into its level, where they would
    repeat its expression, and once per element inside a lambda."""
    return F.when(F.spark_partition_id() >= 0, value)


def words_of(text: str) -> Column:
    """Maximal runs of characters other than space and \\t to \\r."""
    bare = F.expr(f"trim(BOTH '{SPACE}' FROM {text})")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{_SPACES}]+"))


def repeat_words(words: str) -> Column:
    """How many words lie in a 3-word window whose words occur as a window twice or more.

    Windows are sorted by hash with their place in the low bits; neighbours of equal hash are repeats.
    """
    last = f"size({words}) - 3"
    hashes = f"transform(sequence(0, {last}), i -> xxhash64({words}[i], {words}[i+1], {words}[i+2]))"
    low = f"(shiftleft(1L, length(bin(size({words})))) - 1L)"
    same = "(s[{0}] & ~{low}) = (x & ~{low}) and t[cast(s[{0}] & {low} as int)] = t[cast(x & {low} as int)]"
    repeats = (
        f"sort_array(filter(transform(s, (x, j) -> if((j > 0 and {same.format('j-1', low=low)}) or (j < {last} and {same.format('j+1', low=low)}), x & {low}, -1L)), p -> p >= 0))"
    )
    covered = "3L + aggregate(transform(q, (p, j) -> if(j = 0, 0L, least(3L, p - q[j-1]))), 0L, (a, b) -> a + b)"
    found = f"transform(array({repeats}), q -> if(size(q) = 0, 0L, {covered}))[0]"
    placed = f"sort_array(transform(t, (h, i) -> (h & ~{low}) | cast(i as bigint)))"
    per_text = f"if(size(array_distinct(t)) = size(t), 0L, transform(array({placed}), s -> {found})[0])"
    return F.expr(f"if(size({words}) < 3, 0L, transform(array({hashes}), t -> {per_text})[0])")


def base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with struct column `rules`: words and the base counts. Null text: no words."""
    text = F.coalesce(docs[text_col], F.lit(""))
    df = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), text.alias("body"))
    df = df.select("doc", "body", hold(words_of("body")).alias("words"))
    lines = F.filter(F.split("body", "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    df = df.select(
        "doc",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("body", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        hold(lines).alias("lines"),
        hold(repeat_words("words")).alias("n_repeat_words"),
    )
    dup = (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.select("doc", "words", "n_words", "word_chars", "n_symbols", dup, "n_repeat_words", hold(failed).alias("base_failed"))


def features(words: str = "words", n: int = FEATURES) -> Column:
    """The hashed words and pairs of words of a text, in order."""
    one = f"transform({words}, w -> cast(pmod(xxhash64(w), {n}L) as int))"
    two = f"transform(sequence(0, size({words}) - 2), i -> cast(pmod(xxhash64({words}[i], {words}[i+1]), {n}L) as int))"
    return F.expr(f"if(size({words}) < 2, {one}, concat({one}, {two}))")


def fold_of(trusted_id: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), trusted_id), F.lit(FOLDS)).cast("int")


def log_ratios(target: list[int], share: list[float]) -> list[float]:
    """log(p_target / p_corpus) of each feature, the target smoothed by PRIOR_SHARE; all the least possible if it is empty."""
    prior = PRIOR_SHARE * (sum(target) or 1)
    total = sum(target) or 1
    return [math.log((t + prior * p) / (total + prior) / p) for t, p in zip(target, share, strict=True)]


def trusted_ids(trusted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(trusted_id), each once, to be broadcast if they are few."""
    ids = write_table(trusted.select(trusted[id_col].cast("long").alias("trusted_id")).where("trusted_id is not null").distinct(), "trusted")
    return F.broadcast(ids) if ids.count() <= BROADCAST_MOST else ids


def fit(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = FEATURES) -> tuple[list[float], list[float]]:
    """log(p_trusted / p_corpus) of each feature; and those without a fold, fold by fold. No trusted document: all 0."""
    rows = docs.select(docs[id_col].cast("long").alias("i"), F.coalesce(docs[text_col], F.lit("")).alias("body")).select("i", hold(words_of("body")).alias("words"))
    rows = rows.select("i", hold(features()).alias("fs")).join(ids, F.col("i") == F.col("trusted_id"), "left")
    exploded = rows.select(F.explode("fs").alias("f"), F.when(F.col("trusted_id").isNotNull(), fold_of("trusted_id")).alias("fold"))
    counts = exploded.groupBy("f").agg(F.count("*").alias("r"), *[F.count_if(F.col("fold") == k).alias(f"t{k}") for k in range(FOLDS)])
    raw, folds = [0] * n, [[0] * n for _ in range(FOLDS)]
    for f, r, *ts in counts.collect():  # n rows at most
        raw[f] = r
        for k, t in enumerate(ts):
            folds[k][f] = t
    total, target = sum(raw), [sum(ts) for ts in zip(*folds, strict=True)]
    if not sum(target):
        return [0.0] * n, [0.0] * n * FOLDS
    share = [(r + 1) / (total + n) for r in raw]
    others = [w for own in folds for w in log_ratios([t - o for t, o in zip(target, own, strict=True)], share)]
    return log_ratios(target, share), others


def low_quantile(scores: DataFrame, c: str, share: float = QUANTILE) -> float | None:
    """The least value that at least this share of the column's values don't exceed; exact, null ones left out.

    The driver holds a count for each step of the values, and one step's values up to the wanted one.
    """
    step = F.floor(F.col(c) / STEP).alias("step")
    counts = sorted(scores.where(F.col(c).isNotNull()).groupBy(step).agg(F.count("*").alias("n")).collect())
    left = math.ceil(share * sum(r.n for r in counts))
    for at, n in counts:
        if left <= n:
            inside = scores.where(F.floor(F.col(c) / STEP) == at).groupBy(c).agg(F.count("*").alias("n"))
            below = inside.withColumn("upto", F.sum("n").over(Window.orderBy(c)))
            return below.where(F.col("upto") >= left).agg(F.min(c)).first()[0]
        left -= n
    return None


def _table(weight: list[float]) -> str:
    return "cast(split('" + ",".join(f"{w:.6g}" for w in weight) + "', ',') as array<double>)"


def _mean(fs: Column, table: str) -> Column:
    return F.aggregate(fs, F.lit(0.0), lambda a, x: a + F.get(F.expr(table), x)) / F.size(fs)


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """Per row of docs: struct `doc` (its columns, or those of carry), the base counts, base_failed, score, kept.

    kept: not base_failed, and score >= threshold. The score is raised where fewer than 1 - QUANTILE of the
    trusted documents, each scored without its fold, would reach the threshold: few labels reject little.
    Null and empty texts fail the base rules. Null ids are judged like others but never trusted; repeated
    rows count each time; extra columns, whatever their names, stay within `doc`.
    An empty corpus or target gives score 0.
    """
    ids = trusted_ids(trusted, id_col)
    weight, others = fit(docs, ids, id_col, text_col)
    rows = docs.select(F.struct(*[docs[c] for c in carry or docs.columns]).alias("row"), docs[text_col].alias("text"), docs[id_col].cast("long").alias("i"))
    rows = rows.join(ids, F.col("i") == F.col("trusted_id"), "left").select("row", "text", F.when(F.col("trusted_id").isNotNull(), fold_of("trusted_id")).alias("fold"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    df = base(rows, "text").select(F.col("doc.row").alias("doc"), F.col("doc.fold").alias("fold"), *counts, hold(F.when(~F.col("base_failed"), features())).alias("fs"))
    own = F.transform("fs", lambda f: f + F.col("fold") * FEATURES)
    held = F.when(F.col("fold").isNotNull() & F.col("fs").isNotNull(), _mean(own, _table(others)))
    df = write_table(df.select("doc", *counts, F.when(F.col("fs").isNotNull(), _mean(F.col("fs"), _table(weight))).alias("score"), held.alias("held")), "scores")
    raised = 0.0
    if any(weight):
        low = low_quantile(df, "held")
        raised = max(0.0, threshold - (math.log(PRIOR_SHARE / (1 + PRIOR_SHARE)) if low is None else low))
    df = df.select("doc", *counts, (F.col("score") + F.lit(raised)).alias("score"))
    return df.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)))


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Ids of labelled documents of good quality that are not toxic."""
    return labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")
