"""Hand-made rows for every branch that the tables do not reach."""

from __future__ import annotations

import datetime as dt
import math
import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from perambula import schema
from perambula.functions import clean, geo, labels, text
from perambula.operators import evaluate, features, inference, learn, mobility, nearest
from perambula.sources import files
from perambula.streaming import prompts as stream


def values(spark, rows, expression, kind="string"):
    """The expression of column x over some rows."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


HEAD = "user_id,location_id,started_at,finished_at,act_duration,length,geometry,mode\n"


def test_staypoints_csv(spark, tmp_path):
    path = tmp_path / "sp.csv"
    good = "u1,a,2024-01-01 08:00:00,2024-01-01 09:30:00,90,12345,POINT (8.54171 47.37689),CAR\n"
    path.write_text(
        HEAD + good
        + "u1,a,2024-01-01 10:00:00,,15,,point(8.5e0 4.7e1),\n"
        + "u1,a,not-a-date,,1,1,,walk\n"
        + ",a,2024-01-01 10:00:00,,1,1,,walk\n"
        + "u2,b,2024-01-02 10:00:00,,abc,1,\"LINESTRING (1 1, 2 2)\",walk\n"
        + "u3,b,2024-01-02 10:00:00,,1,1,,walk,one too many\n"
        + "u4,b,2024-01-02 10:00:00,,1\n"
    )
    df = mobility.clean_staypoints(files.read_staypoints_csv(spark, str(path)))
    got = {(r.user_id, r.act_duration): r for r in df.collect()}
    assert {k[0] for k in got} == {"u1", "u2", "u4"}
    a = got["u1", 90.0]
    assert (a.lon, a.lat, a.act_duration_h, a.length_km, a.mode, a.dow, a.hour_bin) == (8.5417, 47.3769, 1.5, 12.3, "car", 0, 8)
    b = got["u1", 15.0]
    assert (b.act_duration_h, b.lon, b.lat, b.mode) == (0.2, 8.5, 47.0, "unknown")
    assert got["u2", None].lon is None
    assert got["u4", 1.0].geometry is None


def days(*numbers):
    return [dt.date(2024, 1, n) for n in numbers]


def test_week_sample(spark):
    users = {"six": days(*range(1, 7)), "seven": days(*range(1, 8)), "eight": days(*range(1, 9)), "gap": days(1, 2, 3, 4, 6, 7, 8), "two": days(1, 2, 3, *range(10, 19)), "twice": days(1, 1, *range(2, 8))}
    df = spark.createDataFrame([(u, d) for u, ds in users.items() for d in ds], "user_id string, date date")
    starts: dict = {}
    for u, d in mobility.week_starts(df).collect():
        starts.setdefault(u, []).append(d.day)
    assert {u: sorted(x) for u, x in starts.items()} == {"seven": [1], "eight": [1, 2], "two": [10, 11, 12], "twice": [1]}
    sample = mobility.sample_week(df)
    assert sorted(r.user_id for r in sample.collect()) == sorted(r.user_id for r in mobility.sample_week(df.repartition(3)).collect())


def test_nearest_places(spark):
    at = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    pois = [(i, f"n{i}", "Shopping", float(x), float(y)) for i, (x, y) in enumerate(at)]
    df = spark.createDataFrame(pois, "id long, name string, category string, x double, y double")
    home = spark.createDataFrame([("home", 0.0, 0.0)], "location_id string, x double, y double")
    rows = {r.id: r.direction for r in nearest.poi_context(home, df, 8).collect()}
    assert [rows[i] for i in range(8)] == schema.COMPASS
    mostly = [(i, None if i == 13 else "-" if i == 12 else f"n{i}", None if i == 14 else "Others" if i < 11 else "Civic", 100.0 + i, 0.0) for i in range(15)]
    far = [(i, "far", "Civic", 9000.0, 0.0) for i in range(15, 20)]
    df = spark.createDataFrame(mostly + far, "id long, name string, category string, x double, y double")
    assert [r.id for r in nearest.poi_context(home, df, 5).orderBy("rank").collect()] == [11, 12, 13]
    said = nearest.context_text(nearest.poi_context(home, df, 5)).first().nearby_places
    assert said == "0.111km East Civic n11; 0.112km East Civic; 0.113km East Civic"
    both = [sorted((r.location_id, r.rank, r.id) for r in nearest.knn(home, df, 7, s, 3.0).collect()) for s in ("broadcast", "grid")]
    assert both[0] == both[1] and len(both[0]) == 7
    assert nearest.knn(home, df.limit(2), 7, "grid", 3.0).count() == 2  # fewer places than k


def test_swiss_coordinates(spark):
    lon, lat = 8 + 43 / 60 + 49.79 / 3600, 46 + 2 / 60 + 38.87 / 3600
    df = spark.createDataFrame([(lon, lat)], "x double, y double")
    r = geo.to_lv95(df, "x", "y").first()
    assert abs(r.x - 2699999.76) < 0.01 and abs(r.y - 1099999.97) < 0.01
    assert geo.to_lv95(geo.to_lv95(df, "x", "y"), "x", "y").first().x == r.x
    ring = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)],)], "r array<struct<x:double,y:double>>")
    assert ring.select(*geo.ring_centroid("r")).first() == (1.0, 1.0)


def test_address_cache(spark):
    sp = spark.createDataFrame([("a",), ("b",)], "location_id string")
    cache = spark.createDataFrame([("a", 2, "second", "x"), ("a", 1, "None", "-")], "location_id string, k int, road string, city string")
    rows = {r.location_id: (r.road, r.city) for r in mobility.attach_address(sp, cache, order="k").collect()}
    assert rows == {"a": (None, None), "b": (None, None)}
    assert values(spark, [" Main ", "NaN", "-", " ", None], clean.null_if_sentinel) == ["Main", None, None, None, None]


def stay(user, day, hour, lon, lat, minutes=60, mode="walk"):
    start = dt.datetime(2024, 1, day, hour)
    return (user, str(lon), start, start + dt.timedelta(minutes=minutes), lon, lat, mode, 1.0)


@pytest.fixture(scope="module")
def stays(spark):
    rows = [
        stay("one", 1, 8, 8.5, 47.0),
        *[stay("back", 1, h, 8.5 if h % 2 else 8.6, 47.0) for h in (7, 8, 9, 10)],
        *[stay("back", 2, h, 8.5 if h % 2 else 8.6, 47.0) for h in (7, 8, 9, 10)],
        stay("back", 3, 7, 8.5, 47.0),
        stay("twin1", 1, 7, 8.7, 47.0, 30), stay("twin1", 1, 9, 8.8, 47.2, 60),
        stay("twin2", 1, 7, 8.7, 47.0, 30), stay("twin2", 1, 9, 8.8, 47.2, 60),
        stay("late", 1, 9, 8.1, 47.0, -30), stay("late", 1, 12, 8.2, 47.0, 30),
    ]
    return features.places(spark.createDataFrame(rows, "user_id string, location_id string, started_at timestamp, finished_at timestamp, lon double, lat double, mode string, distance double"))


def by_user(df):
    return {r.user_id: r.asDict() for r in df.collect()}


def test_features(stays):
    by = ["user_id"]
    assert by_user(features.gyration(stays, by))["one"]["rog_km"] == 0
    assert abs(by_user(features.entropy(stays, by, "place"))["one"]["entropy"] + math.log2(1 + 1e-10)) < 1e-12
    moved = {(r.user_id, r.move): r.n for r in features.moves(stays.where("user_id = 'back' and day(started_at) = 1"), by).groupBy("user_id", "move").agg(F.count("*").alias("n")).collect()}
    assert sorted(moved.values()) == [1, 2]
    motif = features.motifs(stays, by).where("user_id = 'back'").collect()
    assert len(motif) == 2 and motif[0].motif == motif[1].motif == "[[0,2],[1,0]]"
    assert by_user(features.motif_features(stays, by))["back"]["motif_top1_ratio"] == 1
    alone = by_user(features.unicity(stays))
    assert alone["twin1"]["unicity_200_w2"] == 0 and alone["back"]["unicity_200_w2"] == 1
    assert by_user(features.stays(stays, by).where("lon_r = 8.1"))["late"]["seconds"] == 0
    assert by_user(features.fragmentation(stays, by))["late"]["time_fragmentation"] == 0
    wide = by_user(features.assemble(stays, ["walk", "car"]))
    assert wide["one"]["weekend_n_stays"] == 0 and wide["one"]["all_mode_walk_count"] == 1
    assert abs(sum(wide["back"][f"all_rhythm_q24_{k}"] for k in range(24)) - 1) < 1e-12
    assert by_user(features.ellipse(stays, by))["twin1"]["ellipse_area"] == 0
    assert by_user(features.diameter(stays, by))["one"]["diameter_km"] == 0
    assert by_user(features.gyration_of_trips(stays, by))["one"]["rog_trips"] == 0


def haversine(a, b):
    (y1, x1), (y2, x2) = [[math.radians(v) for v in p] for p in (a, b)]
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(h, 1)))


def test_diameter_of_many_places(spark):
    """All places count, however many: dense and loose ones, across the date line, at a pole and all over the globe."""
    rng = random.Random(5)
    of = lambda n, lats, lons, digits: {(round(rng.uniform(*lats), digits), round(rng.uniform(*lons), digits)) for _ in range(n)}
    users = {
        "grid": {(47 + i / 1000, 8 + j / 1000) for i in range(25) for j in range(30)},
        "disc": {p for p in of(900, (46, 48), (7, 10), 2) if math.hypot(p[0] - 47, (p[1] - 8.5) / 1.5) < 0.9},
        "loose": of(400, (30, 70), (-20, 40), 3),
        "dateline": of(400, (-20, 20), (150, 179.999), 3) | of(100, (-20, 20), (-179.999, -150), 3),
        "pole": of(400, (80, 90), (-180, 180), 3),
        "globe": of(400, (-90, 90), (-180, 180), 3),
        "antipodes": of(300, (-1, 1), (0, 2), 3) | {(0.5, -179.0)},
    }
    rows = [(u, *p) for u, points in users.items() for p in points]
    found = by_user(features.diameter(spark.createDataFrame(rows, "user_id string, lat double, lon double").selectExpr("*", "lat as lat_r", "lon as lon_r"), ["user_id"]))
    for user, points in users.items():
        assert len(points) > 200
        assert math.isclose(found[user]["diameter_km"], max(haversine(a, b) for a in points for b in points), rel_tol=1e-12), user


@pytest.fixture(scope="module")
def tied_stays(spark):
    """Places of equal time, whose sums in floating seconds (0.1 + 0.2 and 0.3) differ."""
    def of(user, lat, *tenths):
        start = dt.datetime(2024, 1, 1, 8)
        return [(user, str(lat), start, start + dt.timedelta(milliseconds=100 * t), 8.5, lat, "walk", 1.0) for t in tenths]

    rows = of("a", 47.1, 3) + of("a", 47.2, 1, 2) + of("a", 47.9, 9) + of("b", 47.1, 3) + of("b", 47.9, 9)
    return features.places(spark.createDataFrame(rows, "user_id string, location_id string, started_at timestamp, finished_at timestamp, lon double, lat double, mode string, distance double"))


def test_equal_stays_rank_by_place(tied_stays):
    top = by_user(features.top_stays(tied_stays, ["user_id"]))["a"]
    assert (top["top1_lat"], top["top2_lat"]) == (47.9, 47.1)


def test_equal_stays_gyration(tied_stays):
    assert abs(by_user(features.k2_gyration(tied_stays, ["user_id"]))["a"]["k2_rog_ratio"] - 0.4 / math.sqrt((0.3**2 + 0.2**2 + 0.5**2) / 3)) < 1e-6


def test_equal_stays_unicity(tied_stays):
    assert {u: r["unicity_200_w2"] for u, r in by_user(features.unicity(tied_stays)).items()} == {"a": 0, "b": 0}


#: Places of two users' weekends whose covariance is zero but for the coordinates' rounding, and its direction by exact fractions.
ROUNDED = [((4, 78, 92, 94, 73, 4, 54, 95, 69, 19, 44, 11, 60, 69), 0.0), ((6, 36, 2, 76, 56, 63, 0, 92, 69, 81, 34, 87, 81, 91, 60, 21), 180.0)]


@pytest.fixture(scope="module")
def rounded_stays(spark):
    """(user_id, ...) in 40 orders of each of ROUNDED's; user_id ends in the number of its places."""
    rows = []
    for n, (places, _) in enumerate(ROUNDED):
        for order in range(40):
            mixed = sorted(places, key=lambda k: hash((order, k)))
            rows += [(f"{order}-{n}", dt.datetime(2024, 1, 1, 8, i), dt.datetime(2024, 1, 1, 8, i + 1), 8.45 + k % 10 * 0.01, 47.30 + k // 10 * 0.01, "walk", k) for i, k in enumerate(mixed)]
    return spark.createDataFrame(rows, "user_id string, started_at timestamp, finished_at timestamp, lon double, lat double, mode string, location_id long").repartition(7).cache()


def test_ellipse_direction_in_any_order(rounded_stays):
    found = {(r.user_id[-1], round(r.ellipse_direction, 3)) for r in features.ellipse(rounded_stays, ["user_id"]).collect()}
    assert found == {(str(n), d) for n, (_, d) in enumerate(ROUNDED)}


def test_ellipse_of_large_and_missing_coordinates(spark):
    far = [("far", 1e16 * x, 1e16 * y) for x, y in ((0, 0), (1, 1), (3, 2))]
    rows = [*far, *[("half", float(x), None) for x in range(3)], *[("some", x, y) for x, y in ((1.0, 1.0), (2.0, 3.0), (4.0, 4.0), (9.0, None))]]
    stays = spark.createDataFrame(rows, "user_id string, lat double, lon double").withColumns(features.centre(Window.partitionBy("user_id")))
    made = by_user(stays.groupBy("user_id").agg(*features.moment_columns(), F.var_samp("lat").alias("a"), F.covar_samp("lat", "lon").alias("b")))
    assert made["half"]["_b"] is None and made["half"]["_n"] == 3
    for user in ("far", "some"):
        assert math.isclose(made[user]["_a"], made[user]["a"]) and math.isclose(made[user]["_b"], made[user]["b"])


def test_assembled_direction_in_any_order(rounded_stays):
    found = {(r.user_id[-1], round(r.weekday_ellipse_direction, 3)) for r in features.assemble(rounded_stays, ["walk"]).collect()}
    assert found == {(str(n), d) for n, (_, d) in enumerate(ROUNDED)}


def test_many_headed_prompts(spark, tmp_path):
    """A file of many heads is read in one pass: cut once a prompt, this one takes minutes."""
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "x").write_text("".join(f"===USER_{k}===\nprompt {k}\n" if k % 2 else f"USER_{k}:\nprompt {k}\n===USER_odd:\n" for k in range(20_000)))
    began = time.monotonic()
    got = {r.user_id: r.prompt for r in files.read_headed_prompts(spark, str(folder)).collect()}
    assert time.monotonic() - began < 60
    assert got == {str(k): f"prompt {k}" if k % 2 else f"prompt {k}\n===USER_odd:" for k in range(20_000)}


def test_geometry_forms(spark):
    df = spark.createDataFrame([("(47.3, 8.5)",), ("POINT (8.5 47.3)",), ("x",)], "g string")
    lon, lat = geo.any_point("g")
    assert [tuple(r) for r in df.select(lon, lat).collect()] == [(8.5, 47.3), (8.5, 47.3), (None, None)]


def test_model_answers(spark):
    said = [
        '{"age_group": "35-44"}',
        'because.\n{"age_group": "18-24"} then {"age_group": "25-34"}',
        "{'age_group': '45-54',}",
        "{age_group: '55-64', ok: true}",
        '{"a": {"age_group": "65+"}}',
        "nothing",
    ]
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(said)], "user_id string, text string")
    rows = {r.user_id: r for r in inference.parsed(df).collect()}
    assert [rows[str(i)].age_group for i in range(6)] == ["35-44", "25-34", "45-54", "55-64", "65+", None]
    assert rows["5"].error == "json_parse_failed" and rows["5"].raw_output == "nothing" and rows["0"].error is None
    assert rows["0"].gender == "male" and rows["0"].gender_defaulted is True
    got = values(spark, ["5 or more", ">16000", "16000+", ""], lambda x: text.allowed_answer(x, "household_income_level")["value"])
    assert got[1:] == ["16001+", "16001+", "4001-8000"]
    assert values(spark, ["5 or more"], lambda x: text.allowed_answer(x, "household_size")["value"]) == ["5+"]


def test_incomes(spark):
    said = ["between 4,001 and 8,000 CHF", "8001–12000", "more than 16000", "between 4000 and 8000", "12'", '{"income_level": ">=16000"}', '{"income_level": "x"}', "about <4000", None]
    df = spark.createDataFrame(list(enumerate(said)), "i int, text string")
    assert [r.income for r in labels.with_income(df, "text").orderBy("i").collect()] == ["4001-8000", "8001-12000", ">16000", None, None, ">16000", "x", "<4000", None]
    assert values(spark, ["<4000", "4000-8000 chf", "16001+", "?"], labels.evaluated_income) == ["<4000", "4001-8000", ">16000", None]


def test_ages_and_households(spark):
    said = ["18-24", "25-44", "45-66", "67+", "30", "x", None]
    assert values(spark, said, labels.evaluated_age) == ["18-25", "26-35", "46-55", "66+", "26-35", None, None]
    assert values(spark, said, lambda x: labels.evaluated_age(x, legacy=True)) == ["18-25", "18-25", "36-45", "66+", "26-35", None, None]
    assert values(spark, ["5+", "7", "4", "4.5", "0", "2 persons", "more than 5", "x"], labels.evaluated_household) == ["5+", "5+", "4", None, None, "2", "5+", None]
    assert values(spark, ["M", "woman", "diverse", "none", None, "Prefer not"], labels.survey_gender) == ["Male", "Female", "Non-binary / Diverse", "Non-binary / Diverse", "Unknown", "Prefer not to say"]
    assert values(spark, ["17", "18", "34.9", "65", "thirty", None], labels.survey_age) == ["<18", "18–24", "25–34", "65+", "thirty", "Unknown"]
    assert values(spark, ["0", "1", "4", "7", "two", None], labels.survey_household) == ["5 + persons", "1 person", "4 persons", "5 + persons", "two", "Unknown"]


def test_response_lines(spark):
    said = "Age group: 61+\nHousehold size: 5\nNote: a: b\nage group: 25-44"
    m = values(spark, [said], text.answer_lines)[0]
    assert m == {"age_group": "25-44", "household_size": "5", "note": "a: b"}
    assert values(spark, ["why\n---PREDICTION---\nx: 1"], lambda x: text.rationale_and_prediction(x)["prediction"]) == ["x: 1"]
    r = values(spark, ["r1\n\nr2\na: 1\nb: 2\nc: 3\nd: 4"], text.rationale_and_prediction)[0]
    assert (r.rationale, r.prediction) == ("r1\nr2", "a: 1\nb: 2\nc: 3\nd: 4")


def test_prompt_files(spark, tmp_path):
    df = spark.createDataFrame([("u1", "User: u1\n\ntext"), ("u2", "User: u2\n\nmore")], "user_id string, prompt string")
    files.write_prompts(df, str(tmp_path / "p"))
    back = files.read_prompts(spark, str(tmp_path / "p"))
    assert sorted((r.user_id, r.prompt) for r in back.collect()) == [("u1", "User: u1\n\ntext"), ("u2", "User: u2\n\nmore")]
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x").write_text("one\n\n" + "=" * 85 + "\n\n \n\n" + "=" * 80 + "\n\ntwo\n")
    assert [r.prompt for r in files.read_blocks(spark, str(tmp_path / "b")).collect()] == ["one", "two"]
    (tmp_path / "h").mkdir()
    (tmp_path / "h/x").write_text("===USER_a1===\nfirst\n\nUSER_b2:\nsecond\n")
    assert [(r.user_id, r.prompt) for r in files.read_headed_prompts(spark, str(tmp_path / "h")).collect()] == [("a1", "first"), ("b2", "second")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x").write_text("a1\tfirst\nb2\tsecond\n")
    assert [(r.user_id, r.prompt) for r in files.read_headed_prompts(spark, str(tmp_path / "t")).collect()] == [("a1", "first"), ("b2", "second")]
    messy = "---\n## Head\nkeep\n\n\n\n\nthis\n## Example: x\ny ---\nend"
    assert values(spark, [messy], text.clean_prompt) == ["keep\n\nthis\n\ny ---\nend"]


def test_jsonl_and_resume(spark, tmp_path):
    out = tmp_path / "done"
    out.mkdir()
    (out / "a.json").write_text('{"user_id": "u1", "gender": "male"}\n\n{"user_id": "u2"\n')
    assert [r.user_id for r in files.done_users(spark, str(out)).collect()] == ["u1"]
    assert [r.gender for r in files.read_jsonl(spark, str(out)).collect()] == ["male"]
    prompts = spark.createDataFrame([("u1", "x"), ("u3", "y"), (None, "z"), ("u4", "w" * 30_000)], "user_id string, prompt string")
    assert [r.user_id for r in inference.todo(prompts, files.done_users(spark, str(out))).collect()] == ["u3"]
    assert files.snapshot_csv(spark, str(out), str(tmp_path / "csv")) and not files.snapshot_csv(spark, str(tmp_path / "no"), str(tmp_path / "c2"))
    pois = spark.createDataFrame([(1,)], "id int")
    files.write_pois(pois, str(tmp_path / "poi"))
    with pytest.raises(Exception, match="already exists"):
        files.write_pois(pois, str(tmp_path / "poi"))
    files.write_pois(pois, str(tmp_path / "poi"), force=True)


def test_predictor_failures_are_rows(spark):
    def fails(prompts):
        raise ValueError("no")

    df = spark.createDataFrame([("u1", "x")], "user_id string, prompt string")
    assert inference.predict(df, fails).first() == ("u1", None, "ValueError")
    slow = inference.predict(df, lambda p: __import__("time").sleep(3) or p, timeout=0.2).first()
    assert slow.error == "TimeoutError"


def test_stream_answers_each_user_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.txt").write_text(f"User: u1\n\nx\n\n{'=' * 80}\n\nUser: u2\n\ny")
    for extra in (None, "User: u1\n\nagain"):
        if extra:
            (source / "2.txt").write_text(extra)
        stream.answer_prompts(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.user_id for r in files.done_users(spark, str(tmp_path / "out")).collect()) == ["u1", "u2"]
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_chat_records(spark):
    p = spark.createDataFrame([("a", " hello "), ("b", "x"), ("c", "y")], "user_id string, prompt string")
    gt = spark.createDataFrame([("a", "65+", ">16000"), ("b", "18-24", "Prefer not to say"), ("c", None, "<4000")], "user_id string, age_group string, income_level string")
    rows = inference.chat_records(p, gt, ["age_group", "income_level"]).collect()
    assert [r.user_id for r in rows] == ["a"]
    turns = [(m.role, m.content) for m in rows[0].messages]
    assert turns[1:] == [("user", "hello"), ("assistant", "Age group: 67+\nIncome level: 16001+")]


def test_osm_layers(spark):
    points = "fclass string, name string, x double, y double"
    natural = spark.createDataFrame([("tree", "t", 0.0, 0.0), ("beach", "b", 1.0, 1.0)], points)
    traffic = spark.createDataFrame([("parking", "p", 2.0, 2.0), ("crossing", "c", 3.0, 3.0)], points)
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    areas = spark.createDataFrame([("beach", "area", square), ("cliff", "no", square)], "fclass string, name string, ring array<struct<x:double,y:double>>")
    rows = {r.name: (r.category, r.x) for r in nearest.osm_pois({"natural": natural, "traffic": traffic, "natural_areas": areas}).collect()}
    assert rows == {"b": ("Entertainment", 1.0), "p": ("Others", 2.0), "area": ("Entertainment", 1.0)}


def test_greedy_json(spark):
    assert values(spark, ['x {"a": {"b": 1}} y', "{no", "none", None], text.greedy_json) == ['{"a": {"b": 1}}', None, None, None]


def test_split_and_scaling(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0], float(i)) for i in range(100)], "user_id long, c string, x double")
    rows = evaluate.split(df, 0.2, stratum="c").groupBy("c", "part").count().collect()
    assert sorted((r.c, r.part, r["count"]) for r in rows) == [("a", "test", 13), ("a", "train", 53), ("b", "test", 7), ("b", "train", 27)]
    z = learn.zscores(spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, k double"), ["x", "k"]).orderBy("x").collect()
    assert abs(z[0].x + 1.0690449676496976) < 1e-12 and z[0].k == 0


def test_layers(spark):
    a = spark.createDataFrame([("park", "P", 1.0, 2.0), ("xyz", "Q", 1.0, None)], "fclass string, name string, x double, y double")
    b = spark.createDataFrame([("R", 3.0, 4.0)], "name string, x double, y double")
    rows = [(r.id, r.name, r.category) for r in nearest.build_pois(a, b).orderBy("id").collect()]
    assert rows == [(0, "P", "Entertainment"), (1, "R", "Unknown")]
    assert len(schema.CATEGORY_OF) == 65 and values(spark, ["pub", "tree", None], clean.category) == ["Residential", "Others", "Others"]


def test_hourly_activity_stream(spark, tmp_path):
    rows = [("u1", "2024-01-01 08:10:00", "walk", 5.0), ("u2", "2024-01-01 08:50:00", "walk", 7.0), ("u1", "2024-01-01 12:00:00", "car", 1.0), ("u3", "2024-01-01 08:00:00", "walk", 9.0), ("u1", "2024-01-01 20:00:00", "car", 1.0)]
    columns = "user_id string, started_at timestamp, mode string, act_duration double"
    source = tmp_path / "events"
    for k, part in enumerate((rows[:3], rows[3:4], rows[4:])):  # the fourth row comes too late
        df = spark.createDataFrame(part, "user_id string, started_at string, mode string, act_duration double")
        df.select("user_id", F.to_timestamp("started_at").alias("started_at"), "mode", "act_duration").coalesce(1).write.parquet(f"{source}/{k}")
        events = spark.readStream.schema(columns).option("recursiveFileLookup", True).parquet(str(source))
        out = stream.hourly_activity(events).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(r.hour.hour, r["mode"]): (r.n, r.users, r.minutes) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[8, "walk"] == (2, 2, 12.0) and got[12, "car"] == (1, 1, 1.0) and (20, "car") not in got


def test_models(spark):
    rows = [(i, float(i % 2) + (i % 7) * 0.01, float(i % 5), "ab"[i % 2], i % 6 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id long, x double, noise double, c string, validation boolean")
    df = learn.weighted(learn.index_labels(learn.assembled(df, ["x", "noise"]), "c"), "c").checkpoint()
    best = learn.grid_search(df, learn.random_forest, {"numTrees": [2], "maxDepth": [1, 2]}, folds=2)
    assert len(best) == 2 and best[0][0] > 0.9
    model = learn.random_forest(numTrees=3, maxDepth=2).fit(df)
    assert learn.importances(model, ["x", "noise"])[0][0] == "x"
    assert learn.macro_f1(learn.boosted(3, 2).fit(df).transform(df)) > 0.9
    table = learn.compare({"forest": learn.random_forest(numTrees=2, maxDepth=2)}, df, df).first()
    assert table.macro_f1 > 0.9 and table.overfit is False


def test_knn_metrics(spark):
    train = spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [5.0, 5.0], "b")], "id long, vector array<double>, label string")
    test = spark.createDataFrame([(9, [4.0, 4.0]), (8, [0.0, 0.4])], "id long, vector array<double>")
    for metric in ("euclidean", "manhattan"):
        assert {r.id: r.predicted for r in learn.knn_classify(train, test, 1, metric=metric).collect()} == {9: "b", 8: "a"}
    assert {r.id: r.predicted for r in learn.knn_classify(train, test, 3, weighted=True).collect()} == {9: "b", 8: "a"}


def wkb(*xy, polygon=False):
    import struct

    if polygon:
        return struct.pack("<BIII", 1, 3, 1, len(xy)) + b"".join(struct.pack("<2d", *p) for p in xy)
    return struct.pack("<BI2d", 1, 1, *xy[0])


SQUARE = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]


def test_geopackage(spark, tmp_path):
    import sqlite3
    import struct

    from perambula.sources import layers

    db = sqlite3.connect(tmp_path / "a.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("CREATE TABLE pois (fid INTEGER, geom BLOB, fclass TEXT, name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('pois', 'geom')")
    head = lambda flags, srs: b"GP\0" + bytes([flags]) + struct.pack("<i", srs)
    rows = [(1, head(1, 2056) + wkb((8.5, 47.0)), "park", "é"), (2, head(3, 2056) + bytes(32) + wkb(*SQUARE, polygon=True), "beach", None), (3, None, "x", "no place"), (4, head(1, 2056) + wkb((float("nan"), float("nan"))), "x", "empty")]
    db.executemany("INSERT INTO pois VALUES (?, ?, ?, ?)", rows)
    db.commit()
    db.close()
    found = layers.read_geopackage(spark, str(tmp_path), "pois")
    assert [(r.layer, r.kind, r.srs) for r in found.collect()] == [("pois", "Point", 2056), ("pois", "Polygon", 2056), ("pois", None, None), ("pois", "Point", 2056)]
    assert [tuple(r) for r in layers.points(found, "fclass", "name").collect()] == [(8.5, 47.0, "park", "é"), (1.0, 1.0, "beach", None)]
    assert layers.read_geopackage(spark, str(tmp_path), "absent").count() == 0


def test_shapefiles(spark, tmp_path):
    import struct

    from perambula.sources import layers

    ring = struct.pack("<i4d2ii", 5, 0, 0, 2, 2, 1, len(SQUARE), 0) + b"".join(struct.pack("<2d", *p) for p in SQUARE)
    shapes = [struct.pack("<i2d", 1, 8.5, 47.0), ring, struct.pack("<i", 0)]
    body = b"".join(struct.pack(">2i", k + 1, len(x) // 2) + x for k, x in enumerate(shapes))
    (tmp_path / "pois.shp").write_bytes(struct.pack(">i", 9994) + bytes(96) + body)
    field = lambda name, size: name.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([size]) + bytes(15)
    records = b"".join(b" " + a.encode().ljust(8) + b.encode().ljust(6) for a, b in (("park", "P"), ("beach", "ö"), ("x", "")))
    records = records.replace("ö     ".encode(), "ö    ".encode())
    (tmp_path / "pois.dbf").write_bytes(bytes(4) + struct.pack("<I2H", 3, 97, 15) + bytes(20) + field("fclass", 8) + field("name", 6) + b"\r" + records)
    found = layers.read_shapefiles(spark, str(tmp_path))
    assert sorted((str(r.kind), r.layer, r.srs) for r in found.collect()) == [("None", "pois", 4326), ("Point", "pois", 4326), ("Polygon", "pois", 4326)]
    assert sorted(tuple(r) for r in layers.points(found, "fclass", "name").collect()) == [(1.0, 1.0, "beach", "ö"), (8.5, 47.0, "park", "P")]


def test_models_and_scalers_are_kept(spark, tmp_path):
    rows = [(i, float(i % 2) + (i % 7) * 0.01, float(i % 5), "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "user_id long, x double, noise double, c string")
    scaled = learn.zscores(df, ["x", "noise"])
    learn.save_scaler(df, ["x", "noise"], f"file://{tmp_path}/scaler")
    again = learn.zscores(df, ["x", "noise"], saved=spark.read.parquet(f"file://{tmp_path}/scaler"))
    assert scaled.orderBy("user_id").collect() == again.orderBy("user_id").collect()
    made = learn.weighted(learn.index_labels(learn.assembled(scaled, ["x", "noise"]), "c"), "c")
    model = learn.random_forest(numTrees=2, maxDepth=2).fit(made)
    learn.save_model(model, f"file://{tmp_path}/model")
    kept = learn.load_model(spark, f"file://{tmp_path}/model")
    pick = lambda m: [r.prediction for r in m.transform(made).orderBy("user_id").collect()]
    assert pick(kept) == pick(model)


def test_first_row_of_a_user_counts_whole(spark):
    p = spark.createDataFrame([("a", "hello")], "user_id string, prompt string")
    gt = spark.createDataFrame([("a", 1, "65+", "<4000"), ("a", 2, "18-24", ">16000")], "user_id string, k int, age_group string, income_level string")
    for order, want in (("k", "Age group: 67+\nIncome level: <4000"), (None, "Age group: 18-24\nIncome level: 16001+")):
        assert inference.chat_records(p, gt, ["age_group", "income_level"], order=order).first().messages[2].content == want


def test_cooldown_at_multiples(spark, monkeypatch):
    slept = []
    monkeypatch.setattr(inference, "time", type("Clock", (), {"sleep": slept.append}))
    df = spark.createDataFrame([(str(i), "x") for i in range(80)], "user_id string, prompt string").coalesce(1)
    asked = []

    class Rows:  # the plan's function, called here
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            import pyarrow as pa

            batch = pa.RecordBatch.from_pydict({"user_id": [r.user_id for r in df.collect()], "prompt": ["x"] * 80})
            return list(run(iter([batch])))

    inference.predict(Rows(), lambda p: asked.append(len(p)) or p, batch=16, cooldown=(20, 7.0))
    assert asked == [16] * 5 and slept == [7.0] * 4  # at 32, 48, 64 and 80 of 20, 40, 60 and 80
