"""Staypoint operators: cleaning, week samples, addresses, evidence lines, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perambula.functions import clean, geo, text


def clean_staypoints(raw: DataFrame, digits: int = 4) -> DataFrame:
    """Raw staypoints (all strings) to typed rows; rows without user, start or location go."""
    df = raw
    for name in ("finished_at", "act_duration", "length", "geometry", "mode", "lon", "lat"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    lon, lat = geo.wkt_point("geometry")
    df = df.withColumns(
        {
            "started_at": clean.utc("started_at"),
            "finished_at": clean.utc("finished_at"),
            "act_duration": clean.number("act_duration"),
            "length": clean.number("length"),
            "lon": F.bround(F.coalesce(clean.number("lon"), lon), digits),
            "lat": F.bround(F.coalesce(clean.number("lat"), lat), digits),
            "mode": clean.mode("mode"),
        }
    ).dropna(subset=["user_id", "started_at", "location_id"])
    return add_time(df).withColumns({"act_duration_h": clean.hours("act_duration"), "length_km": clean.kilometres("length")})


def add_time(df: DataFrame, at: str = "started_at") -> DataFrame:
    """With date, dow (0 is Monday) and hour_bin."""
    return df.withColumns({"date": F.to_date(at), "dow": F.weekday(at), "hour_bin": F.hour(at)})


def week_starts(df: DataFrame, days: int = 7, user: str = "user_id", date: str = "date") -> DataFrame:
    """(user, start): every day from which so many days in a row have a row."""
    w = Window.partitionBy(user).orderBy(date)
    distinct = df.select(user, date).where(F.col(date).isNotNull()).distinct()
    islands = distinct.withColumn("island", F.date_sub(F.col(date), F.row_number().over(w)))
    ahead = Window.partitionBy(user, "island").orderBy(date).rowsBetween(0, days - 1)
    return islands.withColumn("n", F.count("*").over(ahead)).where(F.col("n") == days).select(user, F.col(date).alias("start"))


def pick_start(starts: DataFrame, how: str = "hash", seed: int = 42, user: str = "user_id") -> DataFrame:
    """One start a user: `first`, or by a hash of user and seed, the same on every run."""
    found = starts.groupBy(user).agg(F.array_sort(F.collect_list("start")).alias("all"))
    at = F.lit(0) if how == "first" else F.pmod(F.xxhash64(F.col(user), F.lit(seed)), F.size("all")).cast("int")
    return found.select(user, F.get("all", at).alias("start"))


def sample_week(df: DataFrame, how: str = "hash", seed: int = 42, days: int = 7, user: str = "user_id") -> DataFrame:
    """The rows of one run of days for each user that has one."""
    start = pick_start(week_starts(df, days, user), how, seed, user)
    inside = F.col("date").between(F.col("start"), F.date_add("start", days - 1))
    return df.join(start, user).where(inside).drop("start")


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in a declared order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def cap_events(df: DataFrame, n: int = 40, user: str = "user_id", at: str = "started_at", tie: str | None = None) -> DataFrame:
    """The first n events of each user."""
    w = Window.partitionBy(user).orderBy(at, *([tie] if tie else []))
    return df.withColumn("event_no", F.row_number().over(w)).where(F.col("event_no") <= n)


ADDRESS = ["road", "neighbourhood", "city", "postcode", "country"]


def attach_address(df: DataFrame, cache: DataFrame, key: str = "location_id", order: str | None = None) -> DataFrame:
    """Left join with the first address of each key; only address columns that the cache has come along."""
    names = [c for c in ADDRESS if c in cache.columns]
    known = first_by(cache, [key], *([order] if order else names)).select(key, *[clean.null_if_placeholder(c).alias(c) for c in names])
    return df.drop(*[c for c in names if c in df.columns]).join(known, key, "left")


def attach_address_at(df: DataFrame, cache: DataFrame, digits: int = 4) -> DataFrame:
    """As attach_address by rounded coordinates, which are joined as whole numbers."""
    scale = 10**digits
    at = lambda c: F.bround(F.col(c) * scale).cast("long")
    keyed = cache.withColumn("_at", F.concat_ws(",", at("lon").cast("string"), at("lat").cast("string"))).drop("lon", "lat")
    return attach_address(df.withColumn("_at", F.concat_ws(",", at("lon").cast("string"), at("lat").cast("string"))), keyed, "_at").drop("_at")


def evidence(df: DataFrame, style: str = "compact", max_events: int = 40, user: str = "user_id", legacy: bool = False) -> DataFrame:
    """(user, n_events, first_date, dates, lines): one text of lines a user, in order of time, with a head for every day."""
    for name in ("road", "neighbourhood", "city", "postcode", "nearby_places", "mode"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    if "duration" not in df.columns:
        named = clean.duration_column(df)
        df = df.withColumn("duration", F.col(named).cast("double") if named else F.lit(None).cast("double"))
    line, head = text.STYLES[style]
    made = line(legacy) if style == "compact" else line()
    w = Window.partitionBy(user).orderBy("started_at", "location_id")
    capped = cap_events(df.where(F.col("started_at").isNotNull()), max_events, user, tie="location_id")
    day = F.date_format("started_at", "yyyy-MM-dd")
    fresh = F.coalesce(F.lag(day).over(w) != day, F.lit(True))
    rows = capped.withColumn("_day", day).withColumn("_fresh", fresh).withColumn("_line", made)
    rows = rows.withColumn("_text", F.when(F.col("_fresh"), F.concat(F.format_string(head, "_day"), F.lit("\n"), F.col("_line"))).otherwise(F.col("_line")))
    grouped = rows.groupBy(user).agg(
        F.count("*").alias("n_events"),
        F.array_sort(F.collect_set("_day")).alias("dates"),
        F.array_sort(F.collect_list(F.struct("event_no", "_text"))).alias("_lines"),
    )
    return grouped.select(user, "n_events", "dates", F.concat_ws("\n", F.col("_lines._text")).alias("lines"))


def prompts(df: DataFrame, style: str = "compact", max_events: int = 40, user: str = "user_id", task: str | None = None) -> DataFrame:
    """(user, n_events, date, prompt): date is the list of the prompt's days."""
    return evidence(df, style, max_events, user).select(user, "n_events", F.col("dates").alias("date"), text.prompt(user, "lines", task).alias("prompt"))
