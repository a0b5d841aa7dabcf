"""The wide feature table and the two stages of a run, with oracles put together from those of their parts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from perambula.functions import clean
from perambula.operators import features, inference, mobility
from perambula.plans import fixtures as fx
from perambula.plans.fixtures import ADDRESS, SLICED, STAY, r6
from perambula.plans.mobility import _LINES, _N4, MODES, enriched_week, query
from perambula.plans.registry import ORACLES

# Sentences -----------------------------------------------------------------------------------

_DAYS = "['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][dow + 1]"
_PART = "CASE WHEN hour_bin <= 3 THEN 'midnight' WHEN hour_bin <= 10 THEN '{0}' WHEN hour_bin <= 13 THEN 'morning' WHEN hour_bin <= 18 THEN 'afternoon' WHEN hour_bin <= 20 THEN 'evening' ELSE 'night' END"
_WHERE = "CASE WHEN concat_ws(', ', road, city) = '' THEN 'unknown address' ELSE concat_ws(', ', road, city) END || coalesce(' (postcode ' || postcode || ')', '')"
_MINUTES = "CAST(CAST(round_even(act_duration, 0) AS INTEGER) AS VARCHAR)"


def _said(line: str) -> str:
    return (
        f"WITH {STAY}, {ADDRESS}, ev AS (SELECT stay.*, road, city, postcode, row_number() OVER (PARTITION BY user_id ORDER BY started_at, location_id) AS event_no FROM stay LEFT JOIN adr USING (location_id)),"
        f" ln AS (SELECT *, strftime(started_at, '%Y-%m-%d') AS day, {line} AS line FROM ev WHERE event_no <= 40),"
        " hd AS (SELECT *, CASE WHEN lag(day) OVER (PARTITION BY user_id ORDER BY event_no) = day THEN line ELSE '--- Date: ' || day || ' ---' || chr(10) || line END AS txt FROM ln)"
        " SELECT user_id, count(*) AS n_events, string_agg(txt, chr(10) ORDER BY event_no) AS lines FROM hd GROUP BY 1"
    )


def _addressed(spark, sf):
    return mobility.attach_address(fx.staypoints(spark, sf), fx.addresses(spark, sf), order="suppkey").withColumn("hour_bin", clean.day_part("hour_bin"))


_HEAD = "strftime(started_at, '%H:%M') || ' (' || " + _DAYS + " || ', ' || "
_AT = _N4.format("lat") + " || ', ' || " + _N4.format("lon")


@query(_said("'At ' || " + _HEAD + _PART.format("working hours in the early morning") + " || '), the user traveled by ' || mode || ' to ' || " + _WHERE + " || ' (coordinates: ' || " + _AT + " || '), staying for approximately ' || " + _MINUTES + " || ' minutes. The surrounding area features no nearby places listed.'"))
def travel_tokens(spark, sf):
    return mobility.evidence(_addressed(spark, sf), "travel", 40).select("user_id", "n_events", "lines")


@query(_said("'On At ' || " + _HEAD + _PART.format("early morning") + " || '), the user spent ' || " + _MINUTES + " || ' min at ' || " + _WHERE + " || ' (' || " + _AT + " || '). arriving by ' || mode || '. Nearby places include no nearby places listed.'"))
def spent_tokens(spark, sf):
    return mobility.evidence(_addressed(spark, sf), "spent", 40).select("user_id", "n_events", "lines")


# The second stage ----------------------------------------------------------------------------

_LATE = " + ".join(f"(length(lines) - length(replace(lines, chr(10) || '{h}:', ''))) // 4" for h in ("22", "23", "00"))


@query(
    f"WITH {_LINES}, p AS (SELECT user_id, chr(10) || lines AS lines FROM ed WHERE length('User: ' || user_id || chr(10) || chr(10) || 'Mobility evidence:' || chr(10) || lines) <= 28000)"
    f" SELECT CAST(user_id AS VARCHAR) AS user_id, CASE WHEN {_LATE} > 3 THEN '18-24' ELSE '35-44' END AS age_group, 'female' AS gender, '2' AS household_size, CASE WHEN contains(lines, ' car ') THEN '8001-12000' ELSE '4001-8000' END AS household_income_level, CAST(NULL AS VARCHAR) AS error FROM p"
)
def predicted_answers(spark, sf):
    """The whole second stage: prompts, a predictor, recovered and validated answers."""
    p = mobility.prompts(enriched_week(spark, sf)).select("user_id", "prompt")
    said = inference.predict(inference.todo(p, spark.createDataFrame([], "user_id string")), inference.rule_predictor)
    return inference.parsed(said).select("user_id", "age_group", "gender", "household_size", "household_income_level", "error")


# Features ------------------------------------------------------------------------------------

_DAY_MOTIFS = f"""{SLICED}, v AS (SELECT user_id, slice, date, list(place ORDER BY started_at, location_id) AS ks FROM sliced GROUP BY 1, 2, 3 HAVING count(*) >= 2),
 nd AS (SELECT *, list_sort(list_distinct(ks)) AS ns, list_zip(ks[1:-2], ks[2:]) AS ps FROM v),
 mo AS (SELECT user_id, slice, date, CAST(to_json(list_sort(list_transform(ns, lambda a: list_transform(ns, lambda b: len(list_filter(ps, lambda p: p[1] = a AND p[2] = b)))))) AS VARCHAR) AS motif FROM nd),
 c AS (SELECT user_id, slice, motif, count(*) AS n FROM mo GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, slice ORDER BY n DESC, motif) AS rk, sum(n) OVER (PARTITION BY user_id, slice) AS days FROM c)"""
_MOTIFS = f"WITH {_DAY_MOTIFS} SELECT user_id, slice, count(*) AS n_motif_types, " + ", ".join(f"{r6(f'coalesce(max(CASE WHEN rk = {k} THEN n/days END), 0.0)')} AS motif_top{k}_ratio" for k in (1, 2, 3)) + " FROM k GROUP BY 1, 2"
_RHYTHM = "WITH " + SLICED + "".join(
    f", c{q} AS (SELECT user_id, slice, CAST(floor(hour_bin*{q}/24) AS BIGINT) AS k, count(*) AS n FROM sliced GROUP BY 1, 2, 3), e{q} AS (SELECT user_id, slice, n / sum(n) OVER (PARTITION BY user_id, slice) AS p FROM c{q}),"
    f" r{q} AS (SELECT user_id, slice, {r6('-sum(p*log2(p+1e-10))')} AS rhythm_q{q}_entropy FROM e{q} GROUP BY 1, 2)"
    for q in (3, 8, 24)
) + " SELECT user_id, slice, rhythm_q3_entropy, rhythm_q8_entropy, rhythm_q24_entropy FROM r3 JOIN r8 USING (user_id, slice) JOIN r24 USING (user_id, slice)"
ORACLES["rhythm_entropy"] = _RHYTHM
_SLICED_PARTS = [ORACLES[x] for x in ("temporal_rhythm", "time_fragmentation", "radius_gyration", "hull_diameter", "ellipse", "od_entropy", "mode_features", "distance_stats")] + [
    _RHYTHM,
    _MOTIFS,
    ORACLES["location_entropy"].replace("AS entropy FROM", "AS place_entropy FROM"),
    ORACLES["slices_all_wd_we"].replace("count(*) AS n,", "").replace(", count(DISTINCT date) AS n_days", ""),
]
_USER_PARTS = [ORACLES[x] for x in ("stay_top2", "k2_rog", "unicity", "rates")]


def _wide_names() -> tuple[list[str], list[str]]:
    """Names of features by slice, and of those of a user."""
    sliced = [*features.temporal_names(), "time_fragmentation", "rog_km", "diameter_km", "ellipse_area", "ellipse_eccentricity", "ellipse_direction", "od_entropy", "n_motif_types"]
    sliced += [f"motif_top{k}_ratio" for k in (1, 2, 3)] + [f"mode_{m}_{c}" for c in ("count", "ratio") for m in MODES] + ["mode_diversity", "mode_entropy", "mode_dominant_ratio"]
    sliced += ["place_entropy", "n_places", "n_trips", "total_km", "mean_km", "max_km", "min_km", "std_km", "range_km"]
    user = [f"top{k}_{c}" for k in (1, 2) for c in ("lat", "lon")] + ["k2_rog_ratio"] + [f"unicity_{m}_w{w}" for m in (200, 500) for w in (2, 3, 4)] + ["trips_per_day", "distance_per_day"]
    return sliced, user


def _wide_sql() -> str:
    sliced, user = _wide_names()
    joined = " ".join([f"({_SLICED_PARTS[0]}) s0"] + [f"LEFT JOIN ({sql}) s{k} USING (user_id, slice)" for k, sql in enumerate(_SLICED_PARTS) if k])
    picked = ", ".join(f"coalesce(max({c}) FILTER (slice = '{s}'), 0) AS {s}_{c}" for s in features.SLICES for c in sliced)
    more = " ".join(f"LEFT JOIN ({sql}) u{k} USING (user_id)" for k, sql in enumerate(_USER_PARTS))
    names = [f"{s}_{c}" for s in features.SLICES for c in sliced]
    return f"SELECT user_id, {', '.join(names)}, {', '.join(f'coalesce({c}, 0) AS {c}' for c in user)} FROM (SELECT user_id, {picked} FROM {joined} GROUP BY 1) w {more}"


@query(_wide_sql())
def feature_table(spark, sf):
    """All features of all users; the ellipses' directions to three places, as they hang on differences of small numbers."""
    table = features.assemble(fx.staypoints(spark, sf), MODES, order="event_id")
    return table.withColumns({c: fx.even(F.col(c), 3) for c in table.columns if re.search("ellipse_direction$", c)})
