"""Text expressions: evidence lines, prompts, prompt cleaning, answers of language models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perambula import schema
from perambula.functions.clean import col, day_name, null_if_sentinel, pick, plain_number, strip, whole_minutes

SEPARATOR = "=" * 80


# Evidence ------------------------------------------------------------------------------------


def address(parts: list[Column | str], separator: str, default: str) -> Column:
    """The clean parts that there are, joined."""
    joined = F.concat_ws(separator, *[null_if_sentinel(p) for p in parts])
    return F.when(joined == "", F.lit(default)).otherwise(joined)


def first_items(text: Column | str, n: int = 3) -> Column:
    """The first n items of a list separated by semicolons, trimmed; null text gives the empty text."""
    items = F.transform(F.split(col(text), ";"), strip)
    return F.concat_ws("; ", F.slice(items, 1, n))


def nearby(text: Column | str, n: int = 3, legacy: bool = False) -> Column:
    """What stands near a place; legacy: the first n characters of the list instead of its items."""
    return F.substring(first_items(text, 10_000), 1, n) if legacy else first_items(text, n)


def poi_text(km: Column, direction: Column, category: Column, name: Column, digits: int = 3) -> Column:
    """`0.12km North Shopping Name`; null if there is neither a category nor a name."""
    c, n = null_if_sentinel(category), null_if_sentinel(name)
    text = F.concat_ws(" ", F.concat(plain_number(km, digits), F.lit("km")), direction, c, n)
    return F.when(c.isNull() & n.isNull(), None).otherwise(text)


def poi_sentences(items: Column | str, default: str = "point of interest", digits: int = 3) -> Column:
    """The sentences of an array of (km, direction, category, name) structs as an array, nearest first."""
    return F.transform(F.array_sort(col(items)), lambda x: poi_sentence(x["km"], x["direction"], x["category"], x["name"], default, digits))


def poi_sentence(km: Column, direction: Column, category: Column, name: Column, default: str = "point of interest", digits: int = 3) -> Column:
    """`0.12 km to the north: Shopping Name`."""
    label = F.concat_ws(" ", null_if_sentinel(category), null_if_sentinel(name))
    return F.concat(plain_number(km, digits), F.lit(" km to the "), F.lower(direction), F.lit(": "), F.when(label == "", F.lit(default)).otherwise(label))


def compact_line(legacy: bool = False) -> Column:
    """`08:30 Mon | Road City 8000 | walk 12min | nearby`, from started_at, dow, road, city, postcode, mode, duration, nearby_places."""
    near = nearby("nearby_places", 3, legacy)
    base = F.concat(
        F.date_format("started_at", "HH:mm"),
        F.lit(" "),
        F.coalesce(day_name("dow", legacy=legacy), F.lit("?")),
        F.lit(" | "),
        address(["road", "city", "postcode"], " ", "unknown"),
        F.lit(" | "),
        F.lower(F.coalesce("mode", F.lit("nan" if legacy else "unknown"))),
        F.lit(" "),
        whole_minutes("duration").cast("string"),
        F.lit("min"),
    )
    return F.when(near == "", base).otherwise(F.concat(base, F.lit(" | "), near))


def coordinate_line() -> Column:
    """`At 08:30, on weekday 0 (hour block 8), the user was at coordinates …`."""
    postcode = null_if_sentinel("postcode")
    where = address(["road", "neighbourhood", "city"], ", ", "unknown address")
    return F.concat(
        F.lit("At "), F.date_format("started_at", "HH:mm"),
        F.lit(", on weekday "), F.coalesce("dow", F.lit(-1)).cast("string"),
        F.lit(" (hour block "), F.coalesce("hour_bin", F.lit(-1)).cast("string"),
        F.lit("), the user was at coordinates ("), plain_number(F.bround("lat", 4), 4), F.lit(", "), plain_number(F.bround("lon", 4), 4),
        F.lit("). The address is "), where, F.coalesce(F.concat(F.lit(", postcode "), postcode), F.lit("")),
        F.lit(". The transport mode was "), F.lower(F.coalesce("mode", F.lit("unknown"))),
        F.lit(", with an activity duration of "), whole_minutes("duration").cast("string"),
        F.lit(" minutes. Nearby places include: "), F.coalesce("nearby_places", F.lit("no nearby places listed")), F.lit("."),
    )


def travel_line() -> Column:
    """`At 08:30 (Monday, morning), the user traveled by walk to …`; hour_bin is a day part from 0 to 5."""
    postcode = null_if_sentinel("postcode")
    where = address(["road", "neighbourhood", "city"], ", ", "unknown address")
    label = pick(schema.DAY_PARTS, F.col("hour_bin"))
    name = F.coalesce(day_name("dow", schema.LONG_DAYS), F.lit("unknown"))
    minutes = F.coalesce(F.bround("duration").cast("int").cast("string"), F.lit("unknown"))
    near = F.when(strip(F.coalesce("nearby_places", F.lit(""))) == "", F.lit("no nearby places listed")).otherwise(F.col("nearby_places"))
    return F.concat(
        F.lit("At "), F.date_format("started_at", "HH:mm"), F.lit(" ("), name, F.coalesce(F.concat(F.lit(", "), label), F.lit("")), F.lit("), the user traveled by "),
        F.coalesce(null_if_sentinel(F.lower("mode")), F.lit("unknown")), F.lit(" to "), where, F.coalesce(F.concat(F.lit(" (postcode "), postcode, F.lit(")")), F.lit("")),
        F.lit(" (coordinates: "), plain_number(F.bround("lat", 4), 4), F.lit(", "), plain_number(F.bround("lon", 4), 4),
        F.lit("), staying for approximately "), minutes, F.lit(" minutes. The surrounding area features "), near, F.lit("."),
    )


def spent_line() -> Column:
    """`On At 08:30 (Monday, morning), the user spent 60 min at … (47.37, 8.54). arriving by walk. Nearby places include ….`; hour_bin is a day part from 0 to 5."""
    postcode = null_if_sentinel("postcode")
    where = address(["road", "neighbourhood", "city"], ", ", "unknown address")
    label = pick(schema.SHORT_DAY_PARTS, F.col("hour_bin"))
    name = F.coalesce(day_name("dow", schema.LONG_DAYS), F.lit("unknown day"))
    spent = F.coalesce(F.concat(F.bround("duration").cast("int").cast("string"), F.lit(" min")), F.lit("unknown duration"))
    near = F.when(strip(F.coalesce("nearby_places", F.lit(""))) == "", F.lit("no nearby places listed")).otherwise(F.col("nearby_places"))
    return F.concat(
        F.lit("On At "), F.date_format("started_at", "HH:mm"), F.lit(" ("), name, F.coalesce(F.concat(F.lit(", "), label), F.lit("")), F.lit("), the user spent "), spent,
        F.lit(" at "), where, F.coalesce(F.concat(F.lit(" (postcode "), postcode, F.lit(")")), F.lit("")),
        F.lit(" ("), plain_number(F.bround("lat", 4), 4), F.lit(", "), plain_number(F.bround("lon", 4), 4),
        F.lit("). arriving by "), F.coalesce(null_if_sentinel(F.lower("mode")), F.lit("unknown")), F.lit(". Nearby places include "), near, F.lit("."),
    )


#: Style to (line expression, head of a day with the date as %s).
STYLES = {
    "compact": (compact_line, "[%s]"),
    "coordinates": (coordinate_line, "Date: %s"),
    "travel": (travel_line, "--- Date: %s ---"),
    "spent": (spent_line, "--- Date: %s ---"),
}


def prompt(user: Column | str, lines: Column | str, task: str | None = None) -> Column:
    """The evidence of one user, after the text of a task: the name of one in schema.TASKS, or a text of one's own."""
    head = schema.TASKS.get(task, f"{task}\n\nMobility evidence:\n") if task else "Mobility evidence:\n"
    return F.concat(F.lit("User: "), col(user).cast("string"), F.lit("\n\n" + head), col(lines))


def approximate_tokens(text: Column | str) -> Column:
    return F.size(F.split(F.trim(F.regexp_replace(col(text), r"\s+", " ")), " ")) * 1.3


def clean_prompt(text: Column | str) -> Column:
    """Without rule lines, second-level headers and the example block; at most one empty line in a row."""
    t = F.regexp_replace(col(text), r"(?m)^\s*---\s*$", "")
    t = F.regexp_replace(t, r"(?m)^\s*## .*?$", "")
    t = F.regexp_replace(t, r"(?s)## Example:.*?---", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def prompt_user(text: Column | str) -> Column:
    """The id after `User:`; null if there is none."""
    return F.nullif(F.regexp_extract(col(text), r"User:\s*(\S+)", 1), F.lit(""))


# Answers -------------------------------------------------------------------------------------


def recovered_json(text: Column | str) -> Column:
    """The last flat JSON object in an answer, as JSON text; null if none can be read.

    Trailing commas are dropped; failing that, bare keys and single quotes become double-quoted.
    """
    candidates = F.reverse(F.regexp_extract_all(col(text), F.lit(r"(\{[^{}]*\})"), F.lit(1)))

    def read(c: Column) -> Column:
        strict = F.regexp_replace(c, r",\s*([}\]])", "$1")
        loose = F.replace(F.regexp_replace(strict, r"(?<!\")(\b[a-zA-Z_]\w*\b)(?!\")\s*:", '"$1":'), F.lit("'"), F.lit('"'))
        return F.coalesce(F.to_json(F.try_parse_json(strict)), F.to_json(F.try_parse_json(loose)))

    return F.get(F.filter(F.transform(candidates, read), lambda x: x.isNotNull()), F.lit(0))


def greedy_json(text: Column | str) -> Column:
    """What stands from the first to the last brace, if it is JSON; else null."""
    found = F.regexp_extract(col(text), r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def allowed_answer(value: Column | str, field: str) -> Column:
    """(value, defaulted) struct: an allowed value, the first that contains it or is in it, or the default."""
    allowed, default = schema.ALLOWED[field], schema.DEFAULTS[field]
    v = F.lower(strip(F.coalesce(col(value).cast("string"), F.lit(""))))
    # Synonyms of allowed answers.
    for old, new in (("prefer not to say", "female"), ("other", "male"), ("5 or more", "5+"), (">16000", "16001+"), ("16000+", "16001+")):
        v = F.replace(v, F.lit(old), F.lit(new))

    def judge(v: Column) -> Column:
        close = F.get(F.filter(F.array(*[F.lit(a) for a in allowed]), lambda a: v.contains(a) | a.contains(v)), F.lit(0))
        known = F.when(v == "", None).when(v.isin(*allowed), v).otherwise(close)
        return F.struct(F.coalesce(known, F.lit(default)).alias("value"), known.isNull().alias("defaulted"))

    return F.get(F.transform(F.array(v), judge), F.lit(0))  # the text is made once


def answer_lines(text: Column | str) -> Column:
    """Map of the `key: value` lines of an answer; a later line with the same key wins."""
    lines = F.filter(F.split(strip(text), r"\r?\n"), lambda x: x.contains(":"))
    entry = F.transform(lines, lambda x: F.struct(_key(F.regexp_extract(x, "^([^:]*):", 1)).alias("key"), F.regexp_extract(x, "(?s)^[^:]*:(.*)$", 1).alias("value")))
    keys = F.array_distinct(F.transform(entry, lambda x: x["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.lower(strip(F.element_at(F.filter(entry, lambda x: x["key"] == k), -1)["value"]))))


def _key(text: Column) -> Column:
    return F.replace(F.lower(strip(text)), F.lit(" "), F.lit("_"))


def rationale_and_prediction(text: Column | str) -> Column:
    """(rationale, prediction) struct: cut at the marker, else the last four lines that aren't empty are the prediction."""
    t = col(text)
    lines = F.filter(F.split(strip(t), r"\r?\n"), lambda x: strip(x) != "")
    n = F.size(lines)
    marked = t.contains("---PREDICTION---")
    parts = F.split(t, "---PREDICTION---")
    return F.struct(
        F.when(marked, strip(F.get(parts, F.lit(0)))).otherwise(F.concat_ws("\n", F.slice(lines, F.lit(1), F.greatest(n - 4, F.lit(0))))).alias("rationale"),
        F.when(marked, strip(F.get(parts, F.lit(1)))).otherwise(F.concat_ws("\n", F.slice(lines, F.greatest(n - 3, F.lit(1)), F.lit(4)))).alias("prediction"),
    )


def label_text(**labels: Column | str) -> Column:
    """`Age group: …` lines, one for each label, named in sentence case."""
    return F.concat_ws("\n", *[F.concat(F.lit(k.replace("_", " ").capitalize() + ": "), col(c).cast("string")) for k, c in labels.items()])
