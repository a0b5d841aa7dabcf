"""Mobility features of each user: temporal, spatial, motif, mode, space-time and unicity.

Input is staypoints with user_id, started_at, finished_at, lon, lat, mode and, optionally, distance.
Features over all days, weekdays and weekends are made in one pass by exploding each row to its slices.
`assemble` deals the rows to their users once; every grouping, window and join by user then stays where the
rows are, and only unicity, which compares users, shuffles again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from perambula.functions import geo

TINY = 1e-10
SLICES = ["all", "weekday", "weekend"]
PLACE_DIGITS = 3


def slices(df: DataFrame) -> DataFrame:
    """Every row twice: in `all` and in `weekday` or `weekend`."""
    kind = F.when(F.weekday("started_at") < 5, F.lit("weekday")).otherwise(F.lit("weekend"))
    return df.withColumn("slice", F.explode(F.array(F.lit("all"), kind)))


def places(df: DataFrame, digits: int = PLACE_DIGITS) -> DataFrame:
    """With lon_r and lat_r, and place, a text key of both."""
    df = df.withColumns({"lon_r": F.bround("lon", digits), "lat_r": F.bround("lat", digits)})
    return df.withColumn("place", F.concat_ws(",", F.format_string(f"%.{digits}f", "lat_r"), F.format_string(f"%.{digits}f", "lon_r")))


def counted(df: DataFrame, by: list[str], *keys: str) -> DataFrame:
    """(by, keys, n, p): how often each key occurs, and its share."""
    counts = df.groupBy(*by, *keys).agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def bits(p: str = "p") -> Column:
    """Aggregate of shares: their Shannon entropy in bits, with log2(p + 1e-10) as usual for it here."""
    return -F.sum(F.col(p) * F.log2(F.col(p) + TINY))


def entropy(df: DataFrame, by: list[str], key: str, name: str = "entropy") -> DataFrame:
    return counted(df, by, key).groupBy(*by).agg(bits().alias(name))


def moves(df: DataFrame, by: list[str], tie: str = "location_id") -> DataFrame:
    """Origin and destination of consecutive stays in order of time."""
    w = Window.partitionBy(*by).orderBy("started_at", tie)
    return df.withColumn("to_place", F.lead("place").over(w)).where(F.col("to_place").isNotNull()).withColumn("move", F.concat_ws(">", "place", "to_place"))


def od_entropy(df: DataFrame, by: list[str]) -> DataFrame:
    return entropy(moves(df, by), by, "move", "od_entropy")


def motifs(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, date, motif): each day's matrix of transitions, rows sorted, as JSON; days with one visit have none."""
    visits = df.groupBy(*by, F.to_date("started_at").alias("date")).agg(F.array_sort(F.collect_list(F.struct("started_at", "location_id", "place"))).alias("v"))
    visits = visits.where(F.size("v") >= 2).withColumn("keys", F.col("v.place"))
    visits = visits.withColumn("nodes", F.array_sort(F.array_distinct("keys")))
    pairs = F.expr("transform(slice(keys, 1, size(keys) - 1), (k, i) -> named_struct('o', k, 'd', keys[i + 1]))")
    visits = visits.withColumn("pairs", pairs)
    matrix = F.expr("array_sort(transform(nodes, a -> transform(nodes, b -> size(filter(pairs, p -> p.o = a and p.d = b)))))")
    return visits.select(*by, "date", F.to_json(matrix).alias("motif"))


def motif_features(df: DataFrame, by: list[str], top: int = 3) -> DataFrame:
    """Number of motifs, and the shares of days that the most frequent ones have."""
    counts = motifs(df, by).groupBy(*by, "motif").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("n"), "motif")), "days": F.sum("n").over(w)})
    shares = [F.coalesce(F.max(F.when(F.col("rank") == k, F.col("n") / F.col("days"))), F.lit(0.0)).alias(f"motif_top{k}_ratio") for k in range(1, top + 1)]
    return ranked.groupBy(*by).agg(F.count("*").alias("n_motif_types"), *shares)


RHYTHMS = (3, 8, 24)


def temporal_columns() -> list[Column]:
    """Aggregates: days, hours, shares of weekdays and peaks, and a count for each hour that `rhythm` reads."""
    hour, weekday = F.hour("started_at"), F.weekday("started_at") < 5
    n = F.greatest(F.count("*"), F.lit(1))
    work = F.greatest(F.count_if(weekday), F.lit(1))
    return [
        F.count("*").alias("n_stays"),
        F.size(F.collect_set(hour)).cast("long").alias("n_hours"),
        F.size(F.collect_set(F.to_date("started_at"))).cast("long").alias("n_days"),
        (F.count_if(weekday) / n).alias("weekday_ratio"),
        (F.count_if(~weekday) / n).alias("weekend_ratio"),
        (F.count_if(weekday & hour.between(6, 9)) / work).alias("morning_peak_ratio"),
        (F.count_if(weekday & hour.between(16, 19)) / work).alias("evening_peak_ratio"),
        *[F.count_if(hour == h).alias(f"_hour{h}") for h in range(24)],
    ]


def rhythm(entropies: bool) -> dict[str, Column]:
    """Shares of the day's equal parts, or their entropies, from the counts of hours."""
    made = {}
    share = lambda q, k: reduce(lambda a, b: a + b, [F.col(f"_hour{h}") for h in range(24) if h * q // 24 == k]) / F.col("n_stays")
    for q in RHYTHMS:
        if entropies:
            made[f"rhythm_q{q}_entropy"] = -reduce(lambda a, b: a + b, [share(q, k) * F.log2(share(q, k) + TINY) for k in range(q)])
        else:
            made |= {f"rhythm_q{q}_{k}": share(q, k) for k in range(q)}
    return made


def _without_hours(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_hour")]


def temporal(df: DataFrame, by: list[str]) -> DataFrame:
    made = df.groupBy(*by).agg(*temporal_columns())
    return made.select(*_without_hours(made), *[c.alias(n) for n, c in rhythm(False).items()])


def rhythm_entropy(df: DataFrame, by: list[str]) -> DataFrame:
    made = df.groupBy(*by).agg(*temporal_columns())
    return made.select(*by, *[c.alias(n) for n, c in rhythm(True).items()])


def microseconds() -> Column:
    return F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("finished_at"))


def seconds() -> Column:
    return microseconds() / 1e6


def with_means(df: DataFrame, by: list[str]) -> DataFrame:
    """With the mean point (clat, clon) and, of stays of positive length, d, their mean and number."""
    w = Window.partitionBy(*by)
    df = df.withColumn("d", F.when(seconds() > 0, seconds()))
    return df.withColumns(centre(w) | {"d_mean": F.avg("d").over(w), "d_n": F.count("d").over(w)})


def steady_sum(c: Column, over: Callable[[Column], Column] = lambda x: x) -> Column:
    """The sum, the same in whatever order rows come; null if a value or the sum is too large.

    Whole numbers are added: of 2**-26, and of what these leave of 2**-66.
    """
    high = F.rint(c * 2.0**26)
    high, low = high.try_cast("bigint"), F.rint((c * 2.0**26 - high) * 2.0**40).try_cast("bigint")
    return F.when(over(F.count(high)) == over(F.count(c)), over(F.try_sum(high)) / 2.0**26 + over(F.try_sum(low)) / 2.0**66)


def centre(w: WindowSpec) -> dict[str, Column]:
    """clat and clon: the mean point of rows that have both."""
    there = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    both = {c: F.when(there, F.col(c)) for c in ("lat", "lon")}
    return {f"c{k}": F.coalesce(steady_sum(c, lambda x: x.over(w)) / F.count(c).over(w), F.avg(c).over(w)) for k, c in both.items()}


def fragmentation_column() -> Column:
    value = F.avg(F.abs(F.col("d") - F.col("d_mean")) / (F.col("d_mean") + TINY))
    return F.when(F.max("d_n") > 1, value).otherwise(F.lit(0.0)).alias("time_fragmentation")


def fragmentation(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean relative deviation of stay durations from their mean; 0 for fewer than two of positive length."""
    return with_means(df, by).where("d is not null").groupBy(*by).agg(fragmentation_column())


def distance_columns(c: str = "distance") -> list[Column]:
    return [
        F.count(c).alias("n_trips"), F.sum(c).alias("total_km"), F.avg(c).alias("mean_km"), F.max(c).alias("max_km"), F.min(c).alias("min_km"),
        F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std_km"), (F.max(c) - F.min(c)).alias("range_km"),
    ]


def distance_stats(df: DataFrame, by: list[str], c: str = "distance") -> DataFrame:
    return df.groupBy(*by).agg(*distance_columns(c))


def gyration_column() -> Column:
    d = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    return F.when(F.count(d) < 2, F.lit(0.0)).otherwise(F.sqrt(F.avg(d * d))).alias("rog_km")


def gyration(df: DataFrame, by: list[str]) -> DataFrame:
    """Radius of gyration in km about the mean point; 0 for fewer than two points."""
    w = Window.partitionBy(*by)
    rows = df.where("lon is not null and lat is not null").withColumns({"clat": F.avg("lat").over(w), "clon": F.avg("lon").over(w)})
    return rows.groupBy(*by).agg(gyration_column())


def gyration_of_trips(df: DataFrame, by: list[str], c: str = "distance") -> DataFrame:
    """The older measure: the spread of trip lengths."""
    return df.groupBy(*by).agg(F.sqrt(F.coalesce(F.var_samp(c), F.lit(0.0))).alias("rog_trips"))


def ends(points: DataFrame, by: list[str], row: str, along: str) -> DataFrame:
    """Of points that share `row` those first and last `along`; all points of groups that are not `near`."""
    w = Window.partitionBy(*by, row)
    return points.withColumns({"_first": F.min(along).over(w), "_last": F.max(along).over(w)}).where(~F.col("near") | F.col(along).isin(F.col("_first"), F.col("_last"))).drop("_first", "_last")


def farthest(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, diameter_km) of all distinct points (lat_r, lon_r), pair by pair.

    Where no two points of a group are more than 90 degrees apart, balls are convex, and from wherever one looks the
    farthest point of a parallel, and of a meridian, is one of its ends; points between ends form no pairs there.
    """
    w = Window.partitionBy(*by)
    half = lambda c: F.pow(F.sin(F.radians(F.max(c).over(w) - F.min(c).over(w)) / 2), 2)
    span = F.greatest(F.max("lat_r").over(w) - F.min("lat_r").over(w), F.max("lon_r").over(w) - F.min("lon_r").over(w))
    near = (half("lat_r") + half("lon_r") < 0.5) & (span < 90) & (F.min("lat_r").over(w) >= -90) & (F.max("lat_r").over(w) <= 90)
    outer = ends(ends(points.select(*by, "lat_r", "lon_r", near.alias("near")), by, "lat_r", "lon_r"), by, "lon_r", "lat_r")
    listed = outer.withColumn("all", F.collect_list(F.struct("lat_r", "lon_r")).over(w))
    pairs = listed.select(*by, "lat_r", "lon_r", F.explode("all").alias("o"))
    return pairs.groupBy(*by).agg(F.max(geo.haversine_km(F.col("lat_r"), F.col("lon_r"), F.col("o.lat_r"), F.col("o.lon_r"))).alias("diameter_km"))


def diameter(df: DataFrame, by: list[str]) -> DataFrame:
    """Largest distance between two of a user's distinct places."""
    return farthest(df.where("lon is not null and lat is not null").select(*by, "lat_r", "lon_r").distinct(), by)


def moment(u: Column, v: Column, plain: Column) -> Column:
    """Sample covariance of distances from the mean, 0 if one of them doesn't vary; the plain one where they are too large."""
    both = u.isNotNull() & v.isNotNull()
    n, flat = F.count(F.when(both, 1)), [F.min(F.when(both, c)) == F.max(F.when(both, c)) for c in (u, v)]
    off = F.sum(F.when(both, u)) * F.sum(F.when(both, v)) / n if u is v else F.lit(0.0)  # rows that lack the other coordinate
    return F.coalesce(F.when(n > 1, F.when(flat[0] | flat[1], F.lit(0.0)).otherwise((steady_sum(u * v) - off) / (n - 1))), plain)


def moment_columns() -> list[Column]:
    """Aggregates of rows with clat and clon, the mean point of those that have both coordinates."""
    lat, lon = F.col("lat") - F.col("clat"), F.col("lon") - F.col("clon")
    return [
        F.count("lat").alias("_n"),
        moment(lat, lat, F.var_samp("lat")).alias("_a"),
        moment(lon, lon, F.var_samp("lon")).alias("_c"),
        moment(lat, lon, F.covar_samp("lat", "lon")).alias("_b"),
    ]


def passed_moment_columns() -> list[Column]:
    """Aggregates as `moment_columns`, by Welford's pass over rows as they come: what a SQL engine's own do, to the last bit."""
    return [F.count("lat").alias("_n"), F.covar_samp("lat", "lat").alias("_a"), F.covar_samp("lon", "lon").alias("_c"), F.covar_samp("lon", "lat").alias("_b")]


def ellipse_columns() -> dict[str, Column]:
    """Of moments of (lat, lon)."""
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    half, root = (a + c) / 2, F.sqrt(F.pow((a - c) / 2, 2) + b * b)
    e1, e2 = F.sqrt(F.greatest(half + root, F.lit(0.0))), F.sqrt(F.greatest(half - root, F.lit(0.0)))
    theta = F.degrees(F.atan2(2 * b, a - c) / 2)
    some = F.col("_n") >= 3
    return {
        "ellipse_area": F.when(some, F.pi() * e1 * e2).otherwise(F.lit(0.0)),
        "ellipse_eccentricity": F.when(some & (e1 > 0), F.sqrt(F.greatest(1 - F.pow(e2 / e1, 2), F.lit(0.0)))).otherwise(F.lit(0.0)),
        "ellipse_direction": F.when(some, F.when(theta < 0, theta + 180).otherwise(theta)).otherwise(F.lit(0.0)),
    }


def ellipse(df: DataFrame, by: list[str], order: str | None = None) -> DataFrame:
    """Area, eccentricity and direction of the standard ellipse of (lat, lon); 0 for fewer than three points.

    The direction is that of the long axis in degrees from the latitude axis, its longitude part not negative.
    Where the covariance is zero but for the coordinates' rounding its sign decides between 0 and 180, so moments
    don't depend on the order of rows, or are those of one pass in the given order.
    """
    if order:
        moments = df.repartition(*by).sortWithinPartitions(*by, order).groupBy(*by).agg(*passed_moment_columns())
    else:
        moments = df.withColumns(centre(Window.partitionBy(*by))).groupBy(*by).agg(*moment_columns())
    return moments.select(*by, *[c.alias(n) for n, c in ellipse_columns().items()])


def mode_features(df: DataFrame, by: list[str], modes: list[str]) -> DataFrame:
    """Counts and shares of the named modes, their number, entropy and the largest share."""
    own = lambda m, c: F.coalesce(F.sum(F.when(F.col("mode") == m, F.col(c))), F.lit(0))
    counts = [own(m, "n").cast("long").alias(f"mode_{m}_count") for m in modes]
    shares = [own(m, "p").cast("double").alias(f"mode_{m}_ratio") for m in modes]
    return counted(df, by, "mode").groupBy(*by).agg(*counts, *shares, F.count("mode").alias("mode_diversity"), bits().alias("mode_entropy"), F.max("p").alias("mode_dominant_ratio"))


def stays(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, lat_r, lon_r, seconds, lat, lon, rank): time at each place, the longest first.

    Time is added in whole microseconds, so places of equal time tie in whatever order their rows come.
    """
    spent = F.coalesce(F.greatest(microseconds(), F.lit(0)), F.lit(0))
    rows = df.where("lon_r is not null and lat_r is not null").groupBy(*by, "lat_r", "lon_r").agg((F.sum(spent) / 1e6).alias("seconds"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    w = Window.partitionBy(*by).orderBy(F.desc("seconds"), "lat_r", "lon_r")
    return rows.withColumn("rank", F.row_number().over(w))


def top_columns(k: int = 2) -> list[Column]:
    return [F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"top{r}_{c}") for r in range(1, k + 1) for c in ("lat", "lon")]


def top_stays(df: DataFrame, by: list[str], k: int = 2) -> DataFrame:
    return stays(df, by).where(F.col("rank") <= k).groupBy(*by).agg(*top_columns(k))


def long_stays(df: DataFrame, by: list[str]) -> DataFrame:
    """The two longest stays, and k2_rog_ratio, in one pass over the ranked stays."""
    w = Window.partitionBy(*by)
    two = F.col("rank") <= 2
    mean = lambda c: F.avg(F.when(two, F.col(c))).over(w)
    rows = stays(df, by).withColumns({"clat": F.avg("lat").over(w), "clon": F.avg("lon").over(w), "tlat": mean("lat"), "tlon": mean("lon")})
    whole = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    near = F.when(two, geo.haversine_km(F.col("lat"), F.col("lon"), F.col("tlat"), F.col("tlon")))
    ratio = F.sqrt(F.avg(near * near)) / (F.sqrt(F.avg(whole * whole)) + TINY)
    return rows.groupBy(*by).agg(*top_columns(), F.when(F.count("*") < 2, F.lit(0.0)).otherwise(ratio).alias("k2_rog_ratio"))


def k2_gyration(df: DataFrame, by: list[str]) -> DataFrame:
    """Gyration of the two longest stays over that of all places; 0 for fewer than two."""
    return long_stays(df, by).select(*by, "k2_rog_ratio")


def unicity(df: DataFrame, user: str = "user_id", metres: tuple = (200, 500), widths: tuple = (2, 3, 4)) -> DataFrame:
    """1 if no other user has the same set of cells of the longest stays, for each cell size and number of stays."""
    rows = stays(df, [user]).where(F.col("rank") <= max(widths))
    sizes = F.explode(F.array(*[F.lit(m) for m in metres])).alias("metres")
    cells = rows.select(user, "rank", "lat", "lon", sizes)
    size = F.col("metres") / geo.METRES_PER_DEGREE
    cells = cells.withColumn("cell", F.concat_ws(":", F.floor(F.col("lat") / size), F.floor(F.col("lon") / size)))
    lists = cells.groupBy(user, "metres").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cell"))), lambda x: x["cell"]).alias("cells"))
    sets = lists.withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths]))).select(
        user, "metres", "width", F.concat_ws("|", F.array_sort(F.array_distinct(F.slice("cells", F.lit(1), F.col("width"))))).alias("set")
    )
    alone = sets.groupBy("metres", "width", "set").agg(F.count("*").alias("n"))
    flags = sets.join(alone, ["metres", "width", "set"]).withColumn("alone", (F.col("n") == 1).cast("int"))
    pick = lambda m, w: F.max(F.when((F.col("metres") == m) & (F.col("width") == w), F.col("alone"))).alias(f"unicity_{m}_w{w}")
    return flags.groupBy(user).agg(*[pick(m, w) for m in metres for w in widths])


def rates(df: DataFrame, by: list[str], c: str = "distance") -> DataFrame:
    days = F.greatest(F.size(F.collect_set(F.to_date("started_at"))), F.lit(1))  # beside count_distinct sums would be made by day first
    return df.groupBy(*by).agg((F.count("*") / days).alias("trips_per_day"), (F.coalesce(F.sum(c), F.lit(0.0)) / days).alias("distance_per_day"))


def by_user(df: DataFrame, user: str, columns: list[str]) -> DataFrame:
    """The named columns, dealt to users, in a plan whose shuffle is the same whatever is read of it.

    Columns are packed by day above the shuffle, so that readers of some can't prune it to shuffles of their own.
    """
    rest = [c for c in columns if c != user]
    dealt = places(df.select(user, *rest)).repartition(user)
    packed = dealt.groupBy(user, F.to_date("started_at")).agg(F.collect_list(F.struct(*[c for c in dealt.columns if c != user])).alias("rows"))
    return packed.select(user, F.inline("rows"))


def assemble(df: DataFrame, modes: list[str], user: str = "user_id", tie: str = "location_id", order: str | None = None) -> DataFrame:
    """One wide row a user, names prefixed by the slice; what a user lacks is 0.

    Means and sums of distances, and the moments of ellipses, are made in the given order, if any.

    Rows are dealt to users once; each family of features is then made wide on its own, and families join by
    user where they are.
    """
    by, far = [user, "slice"], "distance" in df.columns
    base = by_user(df, user, list(dict.fromkeys(["started_at", "finished_at", "lon", "lat", "mode", tie] + (["distance"] if far else []) + ([order] if order else []))))
    sliced = slices(base)
    in_order = lambda x, *keys: x.sortWithinPartitions(*keys, order) if order else x
    moments = passed_moment_columns() if order else moment_columns()
    found = counted(sliced, by, "place", "lat_r", "lon_r")
    plain = with_means(in_order(sliced, *by), by).groupBy(*by).agg(*temporal_columns(), fragmentation_column(), gyration_column(), *moments, *(distance_columns() if far else []))
    plain = plain.withColumns(rhythm(False) | rhythm(True) | ellipse_columns())
    names = [*temporal_names(), "time_fragmentation", "rog_km", "diameter_km", *ellipse_columns(), "od_entropy", "n_motif_types"]
    names += [f"motif_top{k}_ratio" for k in (1, 2, 3)] + [f"mode_{m}_{c}" for c in ("count", "ratio") for m in modes]
    names += ["mode_diversity", "mode_entropy", "mode_dominant_ratio", "place_entropy", "n_places"]
    names += ["n_trips", "total_km", "mean_km", "max_km", "min_km", "std_km", "range_km"] if far else []
    where = found.groupBy(*by).agg(bits().alias("place_entropy"), F.count("place").alias("n_places"))
    apart = farthest(found.where("lon_r is not null and lat_r is not null"), by)
    wide, place = [], {}
    for k, part in enumerate((plain, where, apart, od_entropy(sliced, by), motif_features(sliced, by), mode_features(sliced, by, modes))):
        own = [c for c in part.columns if c in names]
        wide.append(part.groupBy(user).agg(*[F.first(F.when(F.col("slice") == s, F.struct(*own)), True).alias(f"{s}_{k}") for s in SLICES]))
        place |= dict.fromkeys(own, k)
    extra = [long_stays(base, [user]), unicity(base, user)] + ([rates(in_order(base, user), [user])] if far else [])
    whole = reduce(lambda a, b: a.join(b, user, "left"), [*wide, *extra])
    last = [c for e in extra for c in e.columns if c != user]
    return whole.select(user, *[F.col(f"{s}_{place[c]}.{c}").alias(f"{s}_{c}") for s in SLICES for c in names], *last).na.fill(0)


def temporal_names() -> list[str]:
    """Names of the temporal features, in order."""
    first = ["n_stays", "n_hours", "n_days", "weekday_ratio", "weekend_ratio", "morning_peak_ratio", "evening_peak_ratio"]
    return first + [f"rhythm_q{q}_{k}" for q in RHYTHMS for k in range(q)] + [f"rhythm_q{q}_entropy" for q in RHYTHMS]
