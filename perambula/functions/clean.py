"""Column expressions that coerce and clean staypoint fields. Failures become null, never errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perambula import schema


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with the value made once however often make uses it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(c), r"^[\s ]+|[\s ]+$", "")


def utc(c: Column | str) -> Column:
    return F.try_to_timestamp(col(c))


def number(c: Column | str) -> Column:
    return col(c).try_cast("double")


def hours(minutes: Column | str) -> Column:
    return F.bround(col(minutes) / 60, 1)


def kilometres(metres: Column | str) -> Column:
    return F.bround(col(metres) / 1000, 1)


def whole_minutes(c: Column | str) -> Column:
    """Half-even, null as 0."""
    return F.coalesce(F.bround(col(c)), F.lit(0.0)).cast("int")


def hour_block(hour: Column | str, width: int = 1) -> Column:
    return (F.floor(col(hour) / width) * width).cast("int")


def null_if_sentinel(c: Column | str) -> Column:
    """Trimmed; null for none, nan, - and the empty text in any case."""
    t = strip(c)
    return F.when(F.lower(t).isin("none", "nan", "-", ""), None).otherwise(t)


def null_if_placeholder(c: Column | str) -> Column:
    """Null for exactly None, none, -, nan and the empty text."""
    return F.when(col(c).isin("None", "none", "", "-", "nan"), None).otherwise(col(c))


def mode(c: Column | str, default: str = "unknown") -> Column:
    return F.lower(F.coalesce(col(c), F.lit(default)))


def day_part(hour: Column | str) -> Column:
    """0 to 5: from 0, 4, 11, 14, 19 and 21 o'clock."""
    h = col(hour)
    return F.when(h <= 3, 0).when(h <= 10, 1).when(h <= 13, 2).when(h <= 18, 3).when(h <= 20, 4).otherwise(5)


def pick(names: list[str], index: Column) -> Column:
    """The name at a 0-based index; null outside."""
    return F.get(F.array(*[F.lit(x) for x in names]), index)


def day_name(dow: Column | str, names: list[str] = schema.DAYS, legacy: bool = False) -> Column:
    """legacy: the index counts from Sunday, so that every label is a day early, and null is Sunday."""
    d = col(dow)
    if legacy:
        return pick([names[6], *names[:6]], F.coalesce(d, F.lit(0)))
    return pick(names, d)


def category(fclass: Column | str, fallback: Column | str | None = None) -> Column:
    """Category of a feature class, Others if it is unknown; Unknown if there is no class column."""
    known = F.create_map(*[F.lit(x) for pair in sorted(schema.CATEGORY_OF.items()) for x in pair])
    named = known[col(fclass)]
    return F.coalesce(named, known[col(fallback)], F.lit("Others")) if fallback is not None else F.coalesce(named, F.lit("Others"))


def duration_column(df: DataFrame) -> str | None:
    """The first column whose name is that of a duration."""
    return next((c for c in df.columns if c.lower() in schema.DURATION_NAMES), None)


def only(df: DataFrame, names: list[str]) -> DataFrame:
    """Those of the named columns that there are."""
    return df.select(*[c for c in names if c in df.columns])


def trimmed(df: DataFrame, *names: str) -> DataFrame:
    """df with ids as text without white space at their ends."""
    return df.withColumns({c: strip(F.col(c).cast("string")) for c in names})


def geometry_type(geometry: Column | str, default: str = "-") -> Column:
    """`point` for a text that holds one, else the default."""
    return F.when(col(geometry).rlike(r"(?i)POINT\s*\("), F.lit("point")).otherwise(F.lit(default))


def refused(c: Column | str) -> Column:
    """Labels that say nothing: prefer not to say, unknown. False for null."""
    v = F.lower(col(c))
    return F.coalesce(v.contains("prefer not") | v.contains("unknown"), F.lit(False))


def plain_number(c: Column, digits: int) -> Column:
    """A number as text with up to so many decimals, one at least, and never in powers of ten."""
    text = F.format_string(f"%.{digits}f", c)
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ".0")
