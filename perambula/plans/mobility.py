"""Queries of staypoints: weeks, evidence, addresses, nearest places, features; with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from perambula.functions import clean, geo
from perambula.operators import evaluate, features, mobility, nearest
from perambula.plans import fixtures as fx
from perambula.plans.fixtures import ADDRESS, LOC, POI, SLICED, STAY, out, r6
from perambula.plans.registry import ORACLES, QUERIES

BY = ["user_id", "slice"]
MODES = ["click", "error", "purchase", "signup", "view"]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: out(f(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def sliced(spark, sf):
    return features.slices(features.places(fx.staypoints(spark, sf)))


# Weeks ---------------------------------------------------------------------------------------

_STARTS = STAY + """, d AS (SELECT DISTINCT user_id, date FROM stay), i AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY user_id ORDER BY date) AS INTEGER) AS island FROM d),
 s AS (SELECT user_id, date AS start FROM (SELECT *, count(*) OVER (PARTITION BY user_id, island ORDER BY date ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS n FROM i) WHERE n = 7)"""


@query(f"WITH {_STARTS} SELECT user_id, start FROM s")
def week_valid_starts(spark, sf):
    return mobility.week_starts(fx.staypoints(spark, sf))


@query(f"WITH {_STARTS}, f AS (SELECT user_id, min(start) AS start FROM s GROUP BY 1) SELECT event_id, user_id, date FROM stay JOIN f USING (user_id) WHERE date BETWEEN start AND start + 6")
def week_first_sample(spark, sf):
    return mobility.sample_week(fx.staypoints(spark, sf), how="first").select("event_id", "user_id", "date")




@query(
    "WITH d AS (SELECT DISTINCT o_custkey AS user_id, CAST(o_orderdate AS DATE) AS date FROM orders), i AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY user_id ORDER BY date) AS INTEGER) AS island FROM d)"
    " SELECT user_id, date AS start FROM (SELECT *, count(*) OVER (PARTITION BY user_id, island ORDER BY date ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS n FROM i) WHERE n = 2"
)
def order_islands(spark, sf):
    o = fx.read(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("date"))
    return mobility.week_starts(o, days=2)


@query(
    f"WITH {STAY} SELECT dow, CASE WHEN hour_bin <= 3 THEN 0 WHEN hour_bin <= 10 THEN 1 WHEN hour_bin <= 13 THEN 2 WHEN hour_bin <= 18 THEN 3 WHEN hour_bin <= 20 THEN 4 ELSE 5 END::BIGINT AS day_part, count(*) AS n FROM stay GROUP BY 1, 2"
)
def dow_hour_profile(spark, sf):
    s = fx.staypoints(spark, sf)
    return s.groupBy("dow", clean.day_part("hour_bin").alias("day_part")).agg(F.count("*").alias("n"))


@query(f"WITH {STAY} SELECT user_id, event_no, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY started_at, event_id) AS event_no FROM stay) WHERE event_no <= 40")
def event_cap_top40(spark, sf):
    return mobility.cap_events(fx.staypoints(spark, sf), 40, tie="event_id").select("user_id", "event_no", "event_id")


# Evidence ------------------------------------------------------------------------------------

_CONTEXT = f"""{LOC}, {POI}, near AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY metres, id) AS r1 FROM (SELECT *, sqrt((x-lx)*(x-lx)+(y-ly)*(y-ly)) AS metres FROM loc, poi)),
 ctx AS (SELECT location_id, id, name, category, round_even(metres/1000, 3) AS km, ['North','North-East','East','South-East','South','South-West','West','North-West'][CAST(floor((fmod(degrees(atan2(x-lx, y-ly)) + 360, 360) + 22.5) / 45) AS BIGINT) % 8 + 1] AS direction,
  row_number() OVER (PARTITION BY location_id ORDER BY metres, id) AS rank FROM near WHERE r1 <= 15 AND category IS NOT NULL AND lower(category) NOT IN ('unknown', 'others'))"""
_NUM = "regexp_replace(regexp_replace(printf('%.3f', km), '0+$', ''), '\\.$', '.0')"
_TEXT = f"txt AS (SELECT location_id, string_agg({_NUM} || 'km ' || direction || ' ' || category || ' ' || name, '; ' ORDER BY rank) AS nearby_places FROM ctx WHERE rank <= 5 GROUP BY 1)"
_LINES = f"""{_STARTS}, {ADDRESS}, {_CONTEXT}, {_TEXT}, f AS (SELECT user_id, min(start) AS start FROM s GROUP BY 1),
 wk AS (SELECT stay.*, road, city, postcode, nearby_places FROM stay JOIN f USING (user_id) LEFT JOIN adr USING (location_id) LEFT JOIN txt USING (location_id) WHERE date BETWEEN start AND start + 6),
 ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY started_at, location_id) AS event_no FROM wk),
 ln AS (SELECT *, strftime(started_at, '%Y-%m-%d') AS day, strftime(started_at, '%H:%M') || ' ' || ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][dow+1] || ' | ' ||
  CASE WHEN concat_ws(' ', road, city, postcode) = '' THEN 'unknown' ELSE concat_ws(' ', road, city, postcode) END || ' | ' || mode || ' ' || CAST(CAST(round_even(act_duration, 0) AS INTEGER) AS VARCHAR) || 'min' ||
  CASE WHEN nearby_places IS NULL THEN '' ELSE ' | ' || array_to_string(string_split(nearby_places, '; ')[1:3], '; ') END AS line FROM ev WHERE event_no <= 40),
 hd AS (SELECT *, CASE WHEN lag(day) OVER (PARTITION BY user_id ORDER BY event_no) = day THEN line ELSE '[' || day || ']' || chr(10) || line END AS txt FROM ln),
 ed AS (SELECT user_id, count(*) AS n_events, array_to_string(list_sort(list_distinct(list(day))), ',') AS dates, string_agg(txt, chr(10) ORDER BY event_no) AS lines FROM hd GROUP BY 1)"""


def enriched_week(spark, sf):
    """The flagship plan: first week, address, places near, in one lazy graph."""
    week = mobility.sample_week(fx.staypoints(spark, sf), how="first")
    addressed = mobility.attach_address(week, fx.addresses(spark, sf), order="suppkey")
    return nearest.attach_context(addressed, fx.locations(spark, sf), fx.pois(spark, sf))


@query(f"WITH {_LINES} SELECT user_id, n_events, dates, lines FROM ed")
def compact_tokens(spark, sf):
    return mobility.evidence(enriched_week(spark, sf)).select("user_id", "n_events", F.concat_ws(",", "dates").alias("dates"), "lines")


@query(f"WITH {_LINES} SELECT user_id, n_events, 'User: ' || user_id || chr(10) || chr(10) || 'Mobility evidence:' || chr(10) || lines AS prompt FROM ed")
def user_prompts(spark, sf):
    return mobility.prompts(enriched_week(spark, sf)).select("user_id", "n_events", "prompt")


_N4 = "regexp_replace(regexp_replace(printf('%.4f', round_even({0}, 4)), '0+$', ''), '\\.$', '.0')"


@query(
    f"WITH {STAY}, {ADDRESS}, ev AS (SELECT stay.*, road, city, postcode, row_number() OVER (PARTITION BY user_id ORDER BY started_at, location_id) AS event_no FROM stay LEFT JOIN adr USING (location_id)),"
    " ln AS (SELECT *, strftime(started_at, '%Y-%m-%d') AS day, 'At ' || strftime(started_at, '%H:%M') || ', on weekday ' || dow || ' (hour block ' || hour_bin || '), the user was at coordinates (' || "
    + _N4.format("lat") + " || ', ' || " + _N4.format("lon") + " || '). The address is ' || CASE WHEN concat_ws(', ', road, city) = '' THEN 'unknown address' ELSE concat_ws(', ', road, city) END || coalesce(', postcode ' || postcode, '') ||"
    " '. The transport mode was ' || mode || ', with an activity duration of ' || CAST(CAST(round_even(act_duration, 0) AS INTEGER) AS VARCHAR) || ' minutes. Nearby places include: no nearby places listed.' AS line FROM ev WHERE event_no <= 50),"
    " hd AS (SELECT *, CASE WHEN lag(day) OVER (PARTITION BY user_id ORDER BY event_no) = day THEN line ELSE 'Date: ' || day || chr(10) || line END AS txt FROM ln)"
    " SELECT user_id, count(*) AS n_events, string_agg(txt, chr(10) ORDER BY event_no) AS lines FROM hd GROUP BY 1"
)
def sentence_tokens(spark, sf):
    rows = mobility.attach_address(fx.staypoints(spark, sf), fx.addresses(spark, sf), order="suppkey")
    return mobility.evidence(rows, "coordinates", 50).select("user_id", "n_events", "lines")


# Addresses and places ------------------------------------------------------------------------


@query(f"WITH {STAY}, {ADDRESS} SELECT event_id, location_id, road, city, postcode FROM stay LEFT JOIN adr USING (location_id)")
def address_attach(spark, sf):
    return mobility.attach_address(fx.staypoints(spark, sf), fx.addresses(spark, sf), order="suppkey").select("event_id", "location_id", "road", "city", "postcode")


@query(f"WITH {STAY}, {ADDRESS} SELECT event_id, road, city FROM stay LEFT JOIN adr USING (location_id)")
def address_attach_coordinates(spark, sf):
    at = lambda k: {"lon": F.lit(8.45) + k % 10 * F.lit(0.01), "lat": F.lit(47.30) + F.floor(k / 10) * F.lit(0.01)}
    cache = mobility.first_by(fx.addresses(spark, sf), ["location_id"], "suppkey").withColumns(at(F.col("location_id"))).drop("location_id", "suppkey")
    return mobility.attach_address_at(fx.staypoints(spark, sf), cache).select("event_id", "road", "city")


@query(f"WITH {POI} SELECT category, count(*) AS n FROM poi GROUP BY 1")
def poi_category_counts(spark, sf):
    return fx.pois(spark, sf).groupBy("category").agg(F.count("*").alias("n"))


@query(f"WITH {POI} SELECT row_number() OVER (ORDER BY category NULLS FIRST, name NULLS FIRST, x, y) - 1 AS id, name, category FROM poi")
def poi_numbered(spark, sf):
    return nearest.numbered(fx.pois(spark, sf).drop("id"), "category", "name", "x", "y").select("id", "name", "category")


@query(f"WITH {_CONTEXT} SELECT location_id, rank, id, {r6('km')} AS km, direction FROM ctx WHERE rank <= 5")
def knn_poi_topk(spark, sf):
    return nearest.poi_context(fx.locations(spark, sf), fx.pois(spark, sf)).select("location_id", "rank", "id", "km", "direction")


@query(f"WITH {LOC}, {POI} SELECT location_id, rank, id FROM (SELECT location_id, id, row_number() OVER (PARTITION BY location_id ORDER BY sqrt((x-lx)*(x-lx)+(y-ly)*(y-ly)), id) AS rank FROM loc, poi) WHERE rank <= 10")
def knn_grid(spark, sf):
    return nearest.knn(fx.locations(spark, sf), fx.pois(spark, sf), 10, "grid").select("location_id", "rank", "id")


@query(f"WITH {_CONTEXT}, {_TEXT} SELECT location_id, nearby_places FROM txt")
def knn_poi_text(spark, sf):
    return nearest.context_text(nearest.poi_context(fx.locations(spark, sf), fx.pois(spark, sf)))


@query("SELECT p_partkey AS id, ['N','NE','E','SE','S','SW','W','NW'][CAST(floor((fmod(degrees(atan2(p_size - 25.0, p_partkey % 50 - 25.0)) + 360, 360) + 22.5) / 45) AS BIGINT) % 8 + 1] AS sector FROM part")
def compass_bearing(spark, sf):
    from perambula.schema import COMPASS_SHORT

    p = fx.read(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), geo.bearing(F.col("p_size") - 25.0, F.col("p_partkey") % 50 - 25.0, COMPASS_SHORT).alias("sector"))


@query(
    f"WITH {STAY}, d AS (SELECT DISTINCT location_id, (lon*3600 - 26782.5)/10000 AS y, (lat*3600 - 169028.66)/10000 AS x FROM stay)"
    " SELECT location_id, round_even(2600072.37 + 211455.93*y - 10938.51*y*x - 0.36*y*x*x - 44.54*y*y*y, 3) AS east, round_even(1200147.07 + 308807.95*x + 3745.25*y*y + 76.63*x*x - 194.56*y*y*x + 119.79*x*x*x, 3) AS north FROM d"
)
def lv95_project(spark, sf):
    d = fx.staypoints(spark, sf).select("location_id", "lon", "lat").distinct()
    east, north = geo.lv95(F.col("lon"), F.col("lat"))
    return d.select("location_id", F.bround(east, 3).alias("east"), F.bround(north, 3).alias("north"))


_HAV = "2*6371.0*asin(sqrt(least(pow(sin((radians({2})-radians({0}))/2),2) + cos(radians({0}))*cos(radians({2}))*pow(sin(radians({3}-{1})/2),2), 1.0)))"


@query(
    f"WITH {SLICED}, m AS (SELECT user_id, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM sliced WHERE slice = 'all' WINDOW w AS (PARTITION BY user_id ORDER BY started_at, event_id))"
    f" SELECT user_id, {r6('sum(' + _HAV.format('lat', 'lon', 'lat2', 'lon2') + ')')} AS travelled_km, {r6('max(' + _HAV.format('lat', 'lon', 'lat2', 'lon2') + ')')} AS longest_km FROM m WHERE lat2 IS NOT NULL GROUP BY 1"
)
def haversine_stats(spark, sf):
    w = Window.partitionBy("user_id").orderBy("started_at", "event_id")
    s = fx.staypoints(spark, sf).withColumns({"lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w)}).where("lat2 is not null")
    d = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return s.groupBy("user_id").agg(F.sum(d).alias("travelled_km"), F.max(d).alias("longest_km"))


# Features ------------------------------------------------------------------------------------


@query(f"WITH {SLICED} SELECT user_id, slice, count(*) AS n, count(DISTINCT place) AS n_places, count(DISTINCT date) AS n_days FROM sliced GROUP BY 1, 2")
def slices_all_wd_we(spark, sf):
    return sliced(spark, sf).groupBy(*BY).agg(F.count("*").alias("n"), F.count_distinct("place").alias("n_places"), F.count_distinct("date").alias("n_days"))


@query(
    f"WITH {SLICED}, c AS (SELECT user_id, slice, avg(lat) AS clat, avg(lon) AS clon FROM sliced GROUP BY 1, 2), d AS (SELECT user_id, slice, {_HAV.format('lat', 'lon', 'clat', 'clon')} AS d FROM sliced JOIN c USING (user_id, slice))"
    f" SELECT user_id, slice, {r6('CASE WHEN count(*) < 2 THEN 0.0 ELSE sqrt(avg(d*d)) END')} AS rog_km FROM d GROUP BY 1, 2"
)
def radius_gyration(spark, sf):
    return features.gyration(sliced(spark, sf), BY)


@query(
    f"WITH {SLICED}, p AS (SELECT DISTINCT user_id, slice, lat_r, lon_r FROM sliced), q AS (SELECT a.user_id, a.slice, max({_HAV.format('a.lat_r', 'a.lon_r', 'b.lat_r', 'b.lon_r')}) AS d FROM p a JOIN p b ON a.user_id = b.user_id AND a.slice = b.slice GROUP BY 1, 2)"
    f" SELECT user_id, slice, {r6('d')} AS diameter_km FROM q"
)
def hull_diameter(spark, sf):
    return features.diameter(sliced(spark, sf), BY)


@query(
    f"WITH {SLICED}, m AS (SELECT user_id, slice, count(*) AS n, coalesce(var_samp(lat),0) AS a, coalesce(var_samp(lon),0) AS c, coalesce(covar_samp(lat,lon),0) AS b FROM sliced GROUP BY 1, 2),"
    " e AS (SELECT *, sqrt(greatest((a+c)/2 + sqrt(pow((a-c)/2,2)+b*b), 0.0)) AS e1, sqrt(greatest((a+c)/2 - sqrt(pow((a-c)/2,2)+b*b), 0.0)) AS e2, degrees(atan2(2*b, a-c)/2) AS th FROM m)"
    f" SELECT user_id, slice, {r6('CASE WHEN n >= 3 THEN pi()*e1*e2 ELSE 0.0 END')} AS ellipse_area, {r6('CASE WHEN n >= 3 AND e1 > 0 THEN sqrt(greatest(1-pow(e2/e1,2),0.0)) ELSE 0.0 END')} AS ellipse_eccentricity,"
    " round_even(CASE WHEN n >= 3 THEN CASE WHEN th < 0 THEN th+180 ELSE th END ELSE 0.0 END, 3) + 0.0 AS ellipse_direction FROM e"
)
def ellipse(spark, sf):
    return features.ellipse(sliced(spark, sf), BY, "event_id").withColumn("ellipse_direction", fx.even(F.col("ellipse_direction"), 3))


_ENTROPY = "c AS (SELECT user_id, slice, {0} AS k, count(*) AS n FROM {1} GROUP BY 1, 2, 3), e AS (SELECT user_id, slice, n / sum(n) OVER (PARTITION BY user_id, slice) AS p FROM c)"


@query(f"WITH {SLICED}, {_ENTROPY.format('place', 'sliced')} SELECT user_id, slice, {r6('-sum(p*log2(p+1e-10))')} AS entropy FROM e GROUP BY 1, 2")
def location_entropy(spark, sf):
    return features.entropy(sliced(spark, sf), BY, "place")


_MOVES = "mv AS (SELECT *, place || '>' || lead(place) OVER (PARTITION BY user_id, slice ORDER BY started_at, location_id) AS move FROM sliced), mw AS (SELECT * FROM mv WHERE move IS NOT NULL)"


@query(f"WITH {SLICED}, {_MOVES}, {_ENTROPY.format('move', 'mw')} SELECT user_id, slice, {r6('-sum(p*log2(p+1e-10))')} AS od_entropy FROM e GROUP BY 1, 2")
def od_entropy(spark, sf):
    return features.od_entropy(sliced(spark, sf), BY)


_MOTIF = f"""{STAY}, pl AS (SELECT user_id, date, started_at, location_id, printf('%.3f', round_even(lat,3)) || ',' || printf('%.3f', round_even(lon,3)) AS place FROM stay),
 v AS (SELECT user_id, date, list(place ORDER BY started_at, location_id) AS ks FROM pl GROUP BY 1, 2 HAVING count(*) >= 2),
 nd AS (SELECT *, list_sort(list_distinct(ks)) AS ns, list_zip(ks[1:-2], ks[2:]) AS ps FROM v),
 mo AS (SELECT user_id, date, CAST(to_json(list_sort(list_transform(ns, lambda a: list_transform(ns, lambda b: len(list_filter(ps, lambda p: p[1] = a AND p[2] = b)))))) AS VARCHAR) AS motif FROM nd)"""


@query(f"WITH {_MOTIF} SELECT user_id, date, motif FROM mo")
def motif_hash(spark, sf):
    return features.motifs(features.places(fx.staypoints(spark, sf)), ["user_id"])


@query(
    f"WITH {_MOTIF}, c AS (SELECT user_id, motif, count(*) AS n FROM mo GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, motif) AS rk, sum(n) OVER (PARTITION BY user_id) AS days FROM c)"
    + " SELECT user_id, count(*) AS n_motif_types, " + ", ".join(f"{r6(f'coalesce(max(CASE WHEN rk = {k} THEN n/days END), 0.0)')} AS motif_top{k}_ratio" for k in (1, 2, 3)) + " FROM k GROUP BY 1"
)
def motif_ratios(spark, sf):
    return features.motif_features(features.places(fx.staypoints(spark, sf)), ["user_id"])


@query(
    f"WITH {SLICED} SELECT user_id, slice, count(*) AS n_stays, count(DISTINCT hour_bin) AS n_hours, count(DISTINCT date) AS n_days, "
    + ", ".join(
        [r6("count(*) FILTER (dow < 5) / count(*)") + " AS weekday_ratio", r6("count(*) FILTER (dow >= 5) / count(*)") + " AS weekend_ratio", r6("count(*) FILTER (dow < 5 AND hour_bin BETWEEN 6 AND 9) / greatest(count(*) FILTER (dow < 5), 1)") + " AS morning_peak_ratio",
         r6("count(*) FILTER (dow < 5 AND hour_bin BETWEEN 16 AND 19) / greatest(count(*) FILTER (dow < 5), 1)") + " AS evening_peak_ratio"]
        + [r6(f"avg(CASE WHEN floor(hour_bin*{q}/24) = {k} THEN 1.0 ELSE 0.0 END)") + f" AS rhythm_q{q}_{k}" for q in (3, 8, 24) for k in range(q)]
    ) + " FROM sliced GROUP BY 1, 2"
)
def temporal_rhythm(spark, sf):
    return features.temporal(sliced(spark, sf), BY)


@query()  # its oracle is in plans/wide.py
def rhythm_entropy(spark, sf):
    return features.rhythm_entropy(sliced(spark, sf), BY)


@query(
    f"WITH {SLICED}, d AS (SELECT user_id, slice, (epoch_us(finished_at) - epoch_us(started_at))/1e6 AS d FROM sliced), m AS (SELECT *, avg(d) OVER w AS mean, count(*) OVER w AS n FROM d WHERE d > 0 WINDOW w AS (PARTITION BY user_id, slice))"
    f" SELECT user_id, slice, {r6('CASE WHEN max(n) > 1 THEN avg(abs(d-mean)/(mean+1e-10)) ELSE 0.0 END')} AS time_fragmentation FROM m GROUP BY 1, 2"
)
def time_fragmentation(spark, sf):
    return features.fragmentation(sliced(spark, sf), BY)


@query(
    f"WITH {SLICED}, g AS (SELECT user_id, slice, mode, count(*) AS n FROM sliced GROUP BY 1, 2, 3), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id, slice) AS p FROM g) SELECT user_id, slice, "
    + ", ".join([f"CAST(coalesce(sum(n) FILTER (mode = '{m}'), 0) AS BIGINT) AS mode_{m}_count" for m in MODES] + [r6(f"coalesce(sum(p) FILTER (mode = '{m}'), 0.0)") + f" AS mode_{m}_ratio" for m in MODES])
    + f", count(*) AS mode_diversity, {r6('-sum(p*log2(p+1e-10))')} AS mode_entropy, {r6('max(p)')} AS mode_dominant_ratio FROM p GROUP BY 1, 2"
)
def mode_features(spark, sf):
    return features.mode_features(sliced(spark, sf), BY, MODES)


@query(
    f"WITH {SLICED} SELECT user_id, slice, count(distance) AS n_trips, {r6('sum(distance)')} AS total_km, {r6('avg(distance)')} AS mean_km, {r6('max(distance)')} AS max_km, {r6('min(distance)')} AS min_km,"
    f" {r6('coalesce(stddev_samp(distance), 0.0)')} AS std_km, {r6('max(distance) - min(distance)')} AS range_km FROM sliced GROUP BY 1, 2"
)
def distance_stats(spark, sf):
    return features.distance_stats(sliced(spark, sf), BY)


@query(f"WITH {STAY} SELECT user_id, {r6('count(*) / count(DISTINCT date)')} AS trips_per_day, {r6('sum(distance) / count(DISTINCT date)')} AS distance_per_day FROM stay GROUP BY 1")
def rates(spark, sf):
    return features.rates(fx.staypoints(spark, sf), ["user_id"])


_STAYS = f"""{SLICED}, sd AS (SELECT user_id, lat_r, lon_r, sum(greatest((epoch_us(finished_at) - epoch_us(started_at))/1e6, 0.0)) AS seconds, avg(lat) AS lat, avg(lon) AS lon FROM sliced WHERE slice = 'all' GROUP BY 1, 2, 3),
 sk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(seconds, 6) DESC, lat_r, lon_r) AS rank FROM sd)"""


@query(f"WITH {_STAYS} SELECT user_id, " + ", ".join(f"{r6(f'max({c}) FILTER (rank = {k})')} AS top{k}_{c}" for k in (1, 2) for c in ("lat", "lon")) + " FROM sk WHERE rank <= 2 GROUP BY 1")
def stay_top2(spark, sf):
    return features.top_stays(features.places(fx.staypoints(spark, sf)), ["user_id"])


_ROG = "SELECT user_id, sqrt(avg(d*d)) AS r FROM (SELECT a.user_id, " + _HAV.format("lat", "lon", "clat", "clon") + " AS d FROM {0} a JOIN (SELECT user_id, avg(lat) AS clat, avg(lon) AS clon FROM {0} GROUP BY 1) c ON a.user_id = c.user_id) GROUP BY 1"


@query(
    f"WITH {_STAYS}, two AS (SELECT * FROM sk WHERE rank <= 2), r2 AS ({_ROG.format('two')}), ra AS ({_ROG.format('sk')}), n AS (SELECT user_id, count(*) AS n FROM sk GROUP BY 1)"
    f" SELECT n.user_id, {r6('CASE WHEN n < 2 THEN 0.0 ELSE r2.r/(ra.r+1e-10) END')} AS k2_rog_ratio FROM n JOIN r2 USING (user_id) JOIN ra USING (user_id)"
)
def k2_rog(spark, sf):
    return features.k2_gyration(features.places(fx.staypoints(spark, sf)), ["user_id"])


@query(
    f"WITH {_STAYS}, z AS (SELECT user_id, m, rank, floor(lat/(m/111000.0)) || ':' || floor(lon/(m/111000.0)) AS cell FROM (SELECT *, unnest([200, 500]) AS m FROM sk WHERE rank <= 4)),"
    " l AS (SELECT user_id, m, list(cell ORDER BY rank) AS cs FROM z GROUP BY 1, 2), t AS (SELECT user_id, m, w, array_to_string(list_sort(list_distinct(cs[1:w])), '|') AS st FROM (SELECT *, unnest([2, 3, 4]) AS w FROM l)),"
    " u AS (SELECT *, CAST(count(*) OVER (PARTITION BY m, w, st) = 1 AS BIGINT) AS one FROM t) SELECT user_id, " + ", ".join(f"max(one) FILTER (m = {m} AND w = {w}) AS unicity_{m}_w{w}" for m in (200, 500) for w in (2, 3, 4)) + " FROM u GROUP BY 1"
)
def unicity(spark, sf):
    return features.unicity(features.places(fx.staypoints(spark, sf)))


@query("WITH o AS (SELECT 'lineitem' AS layer, l_suppkey AS id, CAST(NULL AS VARCHAR) AS name FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier) SELECT layer, count(*) AS n, count(name) AS named FROM o GROUP BY 1")
def union_layers(spark, sf):
    from perambula.sources.files import union_layers as union

    a = fx.read(spark, sf, "lineitem").where("l_quantity > 45").select(F.lit("lineitem").alias("layer"), F.col("l_suppkey").alias("id"))
    b = fx.read(spark, sf, "supplier").select(F.lit("supplier").alias("layer"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return union(a, b).groupBy("layer").agg(F.count("*").alias("n"), F.count("name").alias("named"))


@query("SELECT l_suppkey, rank, l_orderkey, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_quantity) AS rank FROM lineitem) WHERE rank <= 5")
def top_lines_by_supplier(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_partkey", "l_quantity")
    rows = fx.read(spark, sf, "lineitem").withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return rows.select("l_suppkey", "rank", "l_orderkey", "l_partkey", "l_extendedprice")


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1")
def id_anti(spark, sf):
    gone = fx.read(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return fx.read(spark, sf, "events").join(gone, "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def id_semi(spark, sf):
    wanted = fx.read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return fx.read(spark, sf, "events").join(wanted, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def id_set_diff(spark, sf):
    return evaluate.missing_ids(fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), fx.read(spark, sf, "events"), "user_id")
