"""The language-model stage: what is still to do, a predictor over partitions, answers, training records.

A predictor is a function from a list of prompts to a list of answers. Loading weights, GPUs and fine-tuning
are its business; `rule_predictor` is a deterministic one for tests and dry runs.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perambula import schema
from perambula.functions import labels, text
from perambula.functions.clean import refused
from perambula.operators import evaluate
from perambula.operators.mobility import first_by
from perambula.sources import files

SYSTEM = "You analyse mobility. From one week of stays of a resident, predict age group, household size, gender and income level."
MOST_CHARACTERS = 28_000


def todo(prompts: DataFrame, done: DataFrame, most: int = MOST_CHARACTERS) -> DataFrame:
    """Prompts with a user that is not done, no longer than the guard."""
    named = prompts.where(F.col("user_id").isNotNull() & (F.length("prompt") <= most))
    return named.join(done.select(F.col("user_id").cast("string").alias("_done")), F.col("user_id").cast("string") == F.col("_done"), "left_anti")


def messages(prompt: str = "prompt", system: str = SYSTEM, answer: str | None = None) -> F.Column:
    """The turns of a chat, with the answer for training."""
    turns = [("system", F.lit(system)), ("user", F.trim(prompt))] + ([("assistant", F.col(answer))] if answer else [])
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns])


def rule_predictor(prompts: list[str]) -> list[str]:
    """Answers by fixed rules on the evidence, with reasons before the JSON."""
    out = []
    for p in prompts:
        late = p.count("\n22:") + p.count("\n23:") + p.count("\n00:")
        age = "18-24" if late > 3 else "35-44"
        income = "8001-12000" if " car " in p else "4001-8000"
        out.append(f'Late events: {late}.\n{{"age_group": "{age}", "gender": "female", "household_size": "2", "household_income_level": "{income}"}}')
    return out


def predict(prompts: DataFrame, predictor: Callable[[list[str]], list[str]], batch: int = 16, timeout: float = 300.0, cooldown: tuple[int, float] = (0, 0.0), back_off: float = 0.0) -> DataFrame:
    """(user_id, text, error): failures and timeouts fill `error` and do not end the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = ThreadPoolExecutor(1)
        asked = 0
        for rows in batches:
            users, texts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            said: list[tuple[str | None, str | None]] = []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    said += [(x, None) for x in pool.submit(predictor, part).result(timeout * len(part))]
                except Exception as e:  # noqa: BLE001  any failure of a model is a row
                    said += [(None, type(e).__name__)] * len(part)
                    pool = ThreadPoolExecutor(1)
                    time.sleep(back_off)
                before, asked = asked, asked + len(part)
                if cooldown[0] and asked // cooldown[0] > before // cooldown[0]:  # a multiple was reached
                    time.sleep(cooldown[1])
            yield pa.RecordBatch.from_arrays([pa.array(users, pa.string()), pa.array([a for a, _ in said], pa.string()), pa.array([e for _, e in said], pa.string())], ["user_id", "text", "error"])

    return prompts.select(F.col("user_id").cast("string").alias("user_id"), "prompt").mapInArrow(run, "user_id string, text string, error string")


def parsed(answers: DataFrame, answer: str = "text") -> DataFrame:
    """With the recovered fields, made valid; what could not be read keeps its raw output and says so."""
    df = answers.withColumn("_json", text.recovered_json(answer))
    for field in schema.ALLOWED:
        fixed = text.allowed_answer(F.get_json_object("_json", f"$.{field}"), field)
        df = df.withColumn(field, F.when(F.col("_json").isNotNull(), fixed["value"])).withColumn(f"{field}_defaulted", F.when(F.col("_json").isNotNull(), fixed["defaulted"]))
    failed = F.when(F.col("_json").isNull(), F.lit("json_parse_failed"))
    df = df.withColumn("raw_output", F.when(F.col("_json").isNull(), F.col(answer)))
    return df.withColumn("error", F.coalesce("error", failed) if "error" in answers.columns else failed).drop("_json")


def chat_records(prompts: DataFrame, truth: DataFrame, wanted: list[str], user: str = "user_id", order: str | None = None) -> DataFrame:
    """(user_id, messages): prompts of users whose labels are all there and say something.

    The first row of a user counts, by the order column, or else by the labels themselves; labels of several
    rows are never mixed.
    """
    known = first_by(truth, [user], *([order] if order else wanted)).select(user, *wanted)
    rows = prompts.join(known.dropna(subset=wanted), user)
    for c in wanted:
        rows = rows.where(~refused(c))
    labelled = rows.withColumn("_label", text.label_text(**{c: labels.trained(c, c) for c in wanted}))
    return labelled.select(user, messages("prompt", answer="_label").alias("messages"))


def truncate_user_turn(records: DataFrame, most_words: int) -> DataFrame:
    """Only the user's turn is cut, to so many words in all."""
    cut = lambda m: F.when(m["role"] == "user", F.concat_ws(" ", F.slice(F.split(m["content"], " "), 1, most_words))).otherwise(m["content"])
    return records.withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), cut(m).alias("content"))))


def truncate_to_context(prompts: DataFrame, context: int = 32_768, new_tokens: int = 2_048, per_word: float = 1.3, c: str = "prompt") -> DataFrame:
    """With prompts cut at the end to what the context leaves beside the new tokens, and `truncated`.

    Tokens are estimated by words; white space before the cut stays as it is. A predictor with a tokenizer
    of its own may cut more exactly.
    """
    most = max(0, int((context - new_tokens) / per_word))
    parts = F.split(F.col(c), r"(?<=\s)(?=\S)")
    short = F.regexp_replace(F.concat_ws("", F.slice(parts, 1, most)), r"\s+$", "")
    long = F.size(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")) > most
    return prompts.withColumns({"truncated": F.coalesce(long, F.lit(False)), c: F.when(long, short).otherwise(F.col(c))})


def write_training(records: DataFrame, path: str, share: float = 0.2, seed: int = 42, user: str = "user_id") -> None:
    """Chat records as JSON lines in path/train and path/test; which, a hash of the user says."""
    parts = evaluate.split(records, share, seed, user)
    for part in ("train", "test"):
        files.write_chat(parts.where(F.col("part") == part), f"{path}/{part}")
