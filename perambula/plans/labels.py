"""Queries of labels, answers, evaluation, datasets and models; with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from perambula.functions import labels, text
from perambula.functions.clean import day_part
from perambula.operators import evaluate, inference, learn
from perambula.plans import fixtures as fx
from perambula.plans.fixtures import ANSWERS_SQL, CLASSES_SQL, SURVEY_SQL, r6
from perambula.plans.mobility import query

# Survey --------------------------------------------------------------------------------------

_INC = """CASE WHEN income IS NULL THEN 'Unknown' WHEN income = 'Prefer not to say' THEN income WHEN income = '4 000 CHF or less' THEN '<4,000 CHF' WHEN income LIKE '4 001%' THEN '4,001 – 8,000 CHF'
 WHEN income LIKE '8 001%' THEN '8,001 – 12,000 CHF' WHEN income LIKE '12 001%' THEN '12,001 – 16,000 CHF' ELSE '>16,000 CHF' END"""
_AGE = """CASE WHEN age IS NULL THEN 'Unknown' WHEN TRY_CAST(age AS DOUBLE) IS NULL THEN age WHEN CAST(age AS DOUBLE) < 18 THEN '<18' WHEN CAST(age AS DOUBLE) <= 24 THEN '18–24' WHEN CAST(age AS DOUBLE) <= 34 THEN '25–34'
 WHEN CAST(age AS DOUBLE) <= 44 THEN '35–44' WHEN CAST(age AS DOUBLE) <= 54 THEN '45–54' WHEN CAST(age AS DOUBLE) <= 64 THEN '55–64' ELSE '65+' END"""
_HH = """CASE WHEN household_size IS NULL THEN 'Unknown' WHEN household_size = '1' THEN '1 person' WHEN household_size IN ('2','3','4') THEN household_size || ' persons' WHEN TRY_CAST(household_size AS DOUBLE) IS NOT NULL THEN '5 + persons' ELSE household_size END"""
_SEX = """CASE WHEN gender IS NULL THEN 'Unknown' WHEN lower(trim(gender)) IN ('male','m','man') THEN 'Male' WHEN lower(trim(gender)) IN ('female','f','woman') THEN 'Female' WHEN gender LIKE '%non%' OR gender LIKE '%diverse%' THEN 'Non-binary / Diverse'
 WHEN gender LIKE '%prefer%' THEN 'Prefer not to say' ELSE trim(gender) END"""


def categorized(spark, sf):
    s = fx.survey(spark, sf)
    return s.select(
        "participant_id", labels.survey_income("income").alias("income_cat"), labels.survey_age("age").alias("age_group"), labels.survey_household("household_size").alias("hh_cat"), labels.survey_gender("gender").alias("gender_cat")
    )


@query(f"WITH {SURVEY_SQL} SELECT participant_id, {_INC} AS income_cat, {_AGE} AS age_group, {_HH} AS hh_cat, {_SEX} AS gender_cat FROM survey")
def survey_bins(spark, sf):
    return categorized(spark, sf)


@query(
    f"WITH {SURVEY_SQL}, o AS (SELECT participant_id, CASE WHEN income = '4 000 CHF or less' THEN '0_<4000' WHEN income LIKE '4 001%' THEN '1_4001-8000' WHEN income LIKE '8 001%' THEN '2_8001-12000' WHEN income LIKE '12 001%' THEN '3_12001-16000' WHEN income LIKE 'More%' THEN '4_>16001' END AS income_5 FROM survey)"
    " SELECT *, CASE WHEN income_5 < '2' THEN '0_Low' WHEN income_5 < '3' THEN '1_Mid' WHEN income_5 IS NOT NULL THEN '2_High' END AS income_3 FROM o"
)
def income_classes(spark, sf):
    o = fx.survey(spark, sf).select("participant_id", labels.ordered_income("income").alias("income_5"))
    return o.withColumn("income_3", labels.three_incomes("income_5"))


_PCT = "regexp_replace(regexp_replace(printf('%.1f', round_even(n*100/sum(n) OVER (PARTITION BY v), 1)), '0+$', ''), '\\.$', '.0') || '%'"


@query(
    f"WITH {SURVEY_SQL}, u AS (SELECT 'Gender' AS v, {_SEX} AS c FROM survey UNION ALL SELECT 'Age Group', {_AGE} FROM survey UNION ALL SELECT 'Household Income', {_INC} FROM survey UNION ALL SELECT 'Household Size', {_HH} FROM survey),"
    f' g AS (SELECT v, c, count(*) AS n FROM u GROUP BY 1, 2) SELECT v AS "Variable", c AS "Category", n AS "Count", {_PCT} AS "Percentage" FROM g'
)
def demo_freq_table(spark, sf):
    return evaluate.frequencies(categorized(spark, sf), Gender="gender_cat", Age_Group="age_group", Household_Income="income_cat", Household_Size="hh_cat")


@query(
    f"WITH {SURVEY_SQL}, u AS (SELECT DISTINCT user_id FROM events) SELECT user_id, participant_id, income FROM u LEFT JOIN survey ON user_id = participant_id"
)
def survey_left_join(spark, sf):
    u, s = fx.read(spark, sf, "events").select("user_id").distinct(), fx.survey(spark, sf)
    return u.join(s, u["user_id"] == s["participant_id"], "left").select("user_id", "participant_id", "income")


@query(
    f"WITH {SURVEY_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing, round_even(count(*) FILTER ({c} IS NULL)*100/count(*), 2) + 0.0 AS percent FROM survey" for c in ("participant_id", "income", "age", "household_size", "gender"))
)
def missing_report(spark, sf):
    return evaluate.missing(fx.survey(spark, sf))


@query(f"WITH {SURVEY_SQL}, g AS (SELECT gender AS class, count(*) AS n FROM survey WHERE gender IS NOT NULL GROUP BY 1) SELECT class, n, {r6('sum(n) OVER () / (count(*) OVER () * n)')} AS weight FROM g")
def class_weights(spark, sf):
    return evaluate.class_weights(fx.survey(spark, sf), "gender")


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1")
def value_counts(spark, sf):
    return evaluate.value_counts(fx.read(spark, sf, "part"), "p_brand")


# Answers -------------------------------------------------------------------------------------

_J = "CASE WHEN json_valid(text) THEN json_extract_string(text, '$.{0}') END"
_BIN = "CASE WHEN {1} <= 4000 THEN '<4000' WHEN {0} >= 4001 AND {1} <= 8000 THEN '4001-8000' WHEN {0} >= 8001 AND {1} <= 12000 THEN '8001-12000' WHEN {0} >= 12001 AND {1} <= 16000 THEN '12001-16000' WHEN {1} >= 16000 THEN '>16000' END"


def _pair(pattern: str) -> str:
    return _BIN.format(*[f"CAST(regexp_extract(plain, '{pattern}', {k}) AS BIGINT)" for k in (1, 2)])


_BETWEEN, _DASHED = "between\\s*(\\d{3,5})\\s*and\\s*(\\d{3,5})", "(\\d{1,2}\\d{3})\\s*[-–]\\s*(\\d{1,2}\\d{3})"
_ANSWERED = f"""{ANSWERS_SQL}, j AS (SELECT *, {_J.format('age_group')} AS a, {_J.format('gender')} AS g, coalesce({_J.format('income_level')}, {_J.format('household_income_level')}) AS i, {_J.format('household_size')} AS h FROM ans),
 k AS (SELECT user_id, lower(coalesce(a, text)) AS a, lower(coalesce(g, text)) AS g, lower(coalesce(i, text)) AS i, lower(coalesce(h, text)) AS h, replace(replace(lower(coalesce(i, text)), 'chf', ''), ',', '') AS plain FROM j)"""


@query(
    f"WITH {_ANSWERED} SELECT user_id, CASE " + " ".join(f"WHEN contains(a, '{x}') THEN '{x}'" for x in ("18-25", "26-35", "36-45", "46-55", "56-65", "66+")) + " WHEN regexp_matches(a, '(\\d{2})\\s*[-–]\\s*(\\d{2})') THEN regexp_extract(a, '(\\d{2})\\s*[-–]\\s*(\\d{2})', 1) || '-' || regexp_extract(a, '(\\d{2})\\s*[-–]\\s*(\\d{2})', 2) END AS age_group,"
    " CASE WHEN contains(g, 'female') THEN 'female' WHEN contains(g, 'male') THEN 'male' WHEN contains(g, 'other') THEN 'other' END AS gender,"
    f" CASE WHEN regexp_matches(plain, 'more\\s+than\\s+16000') THEN '>16000' WHEN regexp_matches(plain, '{_BETWEEN}') THEN {_pair(_BETWEEN)} WHEN regexp_matches(plain, '{_DASHED}') THEN {_pair(_DASHED)} END AS income,"
    " CASE " + " ".join(f"WHEN contains(h, '{d}') THEN '{d}'" for d in "1234") + " WHEN contains(h, '5') THEN '5+' END AS household_size FROM k"
)
def answers_extracted(spark, sf):
    return labels.answered(fx.answers(spark, sf)).select("user_id", "age_group", "gender", "income", "household_size")


@query(
    f"WITH {ANSWERS_SQL} SELECT user_id, CASE c_mod WHEN 0 THEN '26-35' WHEN 1 THEN '36-45' WHEN 5 THEN '66+' END AS age_group, c_mod IN (0, 1, 5) AS parsed FROM (SELECT user_id, user_id % 8 AS c_mod FROM ans)"
)
def json_recover(spark, sf):
    a = fx.answers(spark, sf).withColumn("j", text.recovered_json("text"))
    return a.select("user_id", F.get_json_object("j", "$.age_group").alias("age_group"), F.col("j").isNotNull().alias("parsed"))


@query(
    "SELECT c_custkey AS user_id, CASE c_custkey % 6 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN 'male' WHEN 3 THEN 'female' WHEN 4 THEN 'non-binary' ELSE 'male' END AS gender, c_custkey % 6 = 5 AS defaulted FROM customer"
)
def validate_fix(spark, sf):
    c = fx.read(spark, sf, "customer")
    said = F.get(F.array(*[F.lit(x) for x in ("Other", "prefer not to say", "M male", "Female ", "non-binary person", "")]), (F.col("c_custkey") % 6).cast("int"))
    return c.select(F.col("c_custkey").alias("user_id"), text.allowed_answer(said, "gender").alias("x")).select("user_id", F.col("x.value").alias("gender"), F.col("x.defaulted").alias("defaulted"))


@query(
    "WITH t AS (SELECT c_custkey AS user_id, c_custkey % 5 AS a, c_custkey % 3 AS h FROM customer) SELECT user_id, CASE a WHEN 0 THEN '67+' WHEN 1 THEN '18-24' WHEN 2 THEN '67+' WHEN 3 THEN '25-44' ELSE '45-66' END AS age_group, CASE h WHEN 0 THEN '5+' WHEN 1 THEN '2' ELSE '3' END AS household_size, '16001+' AS income_level FROM t"
)
def parse_response(spark, sf):
    key = F.col("c_custkey")
    age = F.get(F.array(*[F.lit(x) for x in ("61+", "18-24", "65+", "25-44", "45-66")]), (key % 5).cast("int"))
    size = F.get(F.array(*[F.lit(x) for x in ("5", "2", "3")]), (key % 3).cast("int"))
    said = F.concat(F.lit("Age group: 0-17\nHousehold size: "), size, F.lit("\nIncome level: >16000\nage group:  "), age, F.lit(" \n\nno pair here"))
    lines = fx.read(spark, sf, "customer").select(key.alias("user_id"), text.answer_lines(said).alias("m"))
    return lines.select("user_id", *[labels.trained(k, F.col("m")[k]).alias(k) for k in ("age_group", "household_size", "income_level")])


@query("SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 3 THEN '4+' ELSE CAST(c_custkey % 4 AS VARCHAR) END AS children, CASE c_custkey % 4 WHEN 3 THEN '26-35' WHEN 2 THEN '46-55' WHEN 1 THEN '18-25' ELSE '66+' END AS age_group FROM customer")
def training_labels(spark, sf):
    k = F.col("c_custkey") % 4
    counts = [F.when(k == 3, "4").otherwise("0"), F.when(k == 2, "2").otherwise(None), F.when(k == 1, "1").otherwise("x")]
    range_ = F.get(F.array(*[F.lit(x) for x in ("67+", "18-24", "45-66", "25-44")]), k.cast("int"))
    return fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), labels.children(*counts).alias("children"), labels.evaluated_age(range_).alias("age_group"))


# Evaluation ----------------------------------------------------------------------------------


@query(
    f"WITH {CLASSES_SQL} SELECT 'class' AS field, count(*) AS n, count(*) FILTER (t IS NOT NULL AND p IS NOT NULL) AS covered, {r6('count(*) FILTER (t IS NOT NULL AND p IS NOT NULL) / count(*)')} AS coverage,"
    f" {r6('count(*) FILTER (t = p) / count(*) FILTER (t IS NOT NULL AND p IS NOT NULL)')} AS accuracy, {r6('count(*) FILTER (t IS NOT DISTINCT FROM p) / count(*)')} AS accuracy_missing_equal FROM cls"
)
def label_eval_accuracy(spark, sf):
    return evaluate.accuracy(fx.classes(spark, sf), {"class": ("t", "p")})


@query(f"WITH {CLASSES_SQL}, g AS (SELECT t, count(*) AS n FROM cls WHERE t IS NOT NULL GROUP BY 1) SELECT {r6('max(n)/sum(n)')} AS majority_share FROM g")
def majority_baseline(spark, sf):
    return evaluate.majority(fx.classes(spark, sf), "t")


_C = [f"c{k}" for k in range(5)]


@query(f"WITH {CLASSES_SQL} SELECT t AS true_class, " + ", ".join(f"count(*) FILTER (p = '{c}') AS pred_{c}" for c in _C) + " FROM cls WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY 1")
def confusion_counts(spark, sf):
    return evaluate.confusion(fx.classes(spark, sf), "t", "p", _C)


@query(f"WITH {CLASSES_SQL} SELECT t AS true_class, " + ", ".join(r6(f"count(*) FILTER (p = '{c}')/count(*)") + f" AS pred_{c}" for c in _C) + " FROM cls WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY 1")
def confusion_norm(spark, sf):
    return evaluate.confusion(fx.classes(spark, sf), "t", "p", _C, share=True)


@query(
    f"WITH {CLASSES_SQL}, b AS (SELECT t, p FROM cls WHERE t IS NOT NULL AND p IS NOT NULL), l AS (SELECT DISTINCT t AS c FROM b UNION SELECT DISTINCT p FROM b),"
    " m AS (SELECT c, (SELECT count(*) FROM b WHERE t = c) AS s, (SELECT count(*) FROM b WHERE p = c) AS q, (SELECT count(*) FROM b WHERE t = c AND p = c) AS h FROM l),"
    " r AS (SELECT c, s, h, CASE WHEN q > 0 THEN h/q ELSE 0.0 END AS pr, CASE WHEN s > 0 THEN h/s ELSE 0.0 END AS re FROM m), f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2*pr*re/(pr+re) ELSE 0.0 END AS f1 FROM r),"
    " u AS (SELECT c AS class, pr AS precision, re AS recall, f1, s AS support FROM f UNION ALL SELECT 'accuracy', sum(h)/sum(s), sum(h)/sum(s), sum(h)/sum(s), sum(s) FROM f UNION ALL SELECT 'macro avg', avg(pr), avg(re), avg(f1), sum(s) FROM f"
    " UNION ALL SELECT 'weighted avg', sum(pr*s)/sum(s), sum(re*s)/sum(s), sum(f1*s)/sum(s), sum(s) FROM f)"
    f" SELECT class, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, CAST(support AS BIGINT) AS support FROM u"
)
def f1_report(spark, sf):
    return evaluate.class_report(fx.classes(spark, sf), "t", "p")


@query(
    "SELECT quality AS true_class, count(*) FILTER (toxic = 0) AS pred_0, count(*) FILTER (toxic = 1) AS pred_1 FROM labels GROUP BY 1"
)
def label_confusion(spark, sf):
    return evaluate.confusion(fx.read(spark, sf, "labels"), "quality", "toxic", ["0", "1"])


@query(f"WITH {CLASSES_SQL}, {ANSWERS_SQL} SELECT c.user_id, c.t AS class_true, d.p AS class_pred FROM cls c JOIN cls d ON c.user_id = d.user_id WHERE c.user_id % 2 = 0 AND d.user_id % 3 = 0")
def truth_prediction_join(spark, sf):
    c = fx.classes(spark, sf)
    truth = c.where("user_id % 2 = 0").select("user_id", F.col("t").alias("class"))
    return evaluate.paired(truth, c.where("user_id % 3 = 0").select("user_id", F.col("p").alias("class")), ["class"])


@query(
    "WITH k AS (SELECT c_custkey AS user_id, c_custkey % 6 AS k FROM customer) SELECT user_id, CASE k WHEN 0 THEN 'female' WHEN 1 THEN 'male' WHEN 2 THEN 'other' END AS gender,"
    " CASE k WHEN 0 THEN '<4000' WHEN 1 THEN '4001-8000' WHEN 2 THEN '8001-12000' WHEN 3 THEN '12001-16000' WHEN 4 THEN '>16000' END AS income,"
    " CASE k WHEN 0 THEN '5+' WHEN 1 THEN '3' WHEN 2 THEN '5+' WHEN 4 THEN '2' END AS household_size, CASE k WHEN 0 THEN '18-25' WHEN 1 THEN '26-35' WHEN 2 THEN '66+' WHEN 3 THEN '36-45' END AS age_group FROM k"
)
def normalized_labels(spark, sf):
    k = F.col("c_custkey") % 6

    def said(*x: str):
        return F.when(k == 0, x[0]).when(k == 1, x[1]).when(k == 2, x[2]).when(k == 3, x[3]).when(k == 4, x[4]).otherwise(x[5])

    answers = fx.read(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"),
        said(" Female", "m", "non-binary", "unknown", "", "x").alias("gender"),
        said("less than 4000", "4000-8000", "8001-12000 CHF", "12001-16000", "more than 16000", "none").alias("income"),
        said("more than 5", "3.0", "7", "0", "2 persons", "n/a").alias("household_size"),
        said("18-24", "28", "67+", "36 - 40", "old", "").alias("age_group"),
    )
    made = {"gender": labels.evaluated_gender, "income": labels.evaluated_income, "household_size": labels.evaluated_household, "age_group": labels.evaluated_age}
    return answers.select("user_id", *[f(c).alias(c) for c, f in made.items()])


# Prompts and records -------------------------------------------------------------------------


@query(
    "WITH d AS (SELECT CAST(length(text) AS DOUBLE) AS x FROM documents) SELECT count(x) AS n, " + r6("avg(x)") + " AS mean, min(x) AS least, max(x) AS most, "
    + ", ".join(r6(f"quantile_cont(x, {q})") + f" AS p{round(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + ", " + ", ".join(f"count(*) FILTER (x > {k}) AS over_{k}" for k in (1024, 2048, 4096, 8192)) + " FROM d"
)
def token_length_stats(spark, sf):
    return evaluate.length_stats(fx.read(spark, sf, "documents"), F.length("text"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) <= 28000")
def prompt_guard(spark, sf):
    d = fx.read(spark, sf, "documents").select(F.col("doc_id").alias("user_id"), F.col("text").alias("prompt"))
    none = spark.createDataFrame([], "user_id string")
    return inference.todo(d, none).select(F.col("user_id").alias("doc_id"), F.length("prompt").cast("long").alias("n"))


@query(
    r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^[ \t]*---[ \t]*$', '', 'gm'), '^[ \t]*## .*$', '', 'gm'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s ]+', ''), '[\s ]+$', '')) AS cleaned FROM documents"
)
def prompt_clean(spark, sf):
    return fx.read(spark, sf, "documents").select("doc_id", F.md5(text.clean_prompt("text")).alias("cleaned"))


@query("SELECT conv_id AS user_id, count(*) AS n_turns, count(*) FILTER (role = 'system') AS n_system FROM conversations WHERE conv_id % 3 <> 0 GROUP BY 1")
def resume_anti(spark, sf):
    c = fx.read(spark, sf, "conversations").select(F.col("conv_id").alias("user_id"), F.col("text").alias("prompt"), "role")
    done = c.where("user_id % 3 = 0").select("user_id").distinct()
    left = inference.todo(c, done, 1 << 30)
    return left.groupBy("user_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "system").alias("n_system"))


@query(
    "WITH f AS (SELECT o_custkey AS user_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 11 = 0 THEN 'Prefer not to say' ELSE o_orderpriority END AS priority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)"
    " SELECT user_id, len(['system','user','assistant'])::BIGINT AS n, 'Status: ' || lower(status) || chr(10) || 'Priority: ' || lower(trim(priority)) AS answer FROM f WHERE r = 1 AND status IS NOT NULL AND lower(priority) NOT LIKE '%prefer not%'"
)
def chat_records(spark, sf):
    """Users with many rows of labels, of which the first counts, whole."""
    k = F.col("o_orderkey")
    o = fx.read(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), k, F.when(k % 7 != 0, F.col("o_orderstatus")).alias("status"), F.when(k % 11 == 0, "Prefer not to say").otherwise(F.col("o_orderpriority")).alias("priority"))
    p = o.select("user_id").distinct().select("user_id", F.concat(F.lit("User: "), F.col("user_id").cast("string")).alias("prompt"))
    made = inference.chat_records(p, o, ["status", "priority"], order="o_orderkey")
    return made.select("user_id", F.size("messages").alias("n"), F.col("messages")[2]["content"].alias("answer"))


@query("SELECT doc_id, round_even(len(string_split(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), ' ')) * 1.3::DOUBLE, 6) + 0.0 AS tokens FROM documents")
def approximate_tokens(spark, sf):
    return fx.read(spark, sf, "documents").select("doc_id", text.approximate_tokens("text").cast("double").alias("tokens"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) END AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'a; b; c' ELSE 'a' END AS nearby FROM customer")
def prompt_fields(spark, sf):
    key = F.col("c_custkey")
    said = F.when(key % 2 == 0, F.concat(F.lit("User:  "), key.cast("string"), F.lit("\n\nMobility evidence:\nx"))).otherwise(F.lit("no id"))
    places = F.when(key % 3 == 0, F.lit(" a;b ; c;d")).otherwise(F.lit("a"))
    return fx.read(spark, sf, "customer").select(key.alias("k"), text.prompt_user(said).alias("user_id"), text.nearby(places).alias("nearby"))


# Models --------------------------------------------------------------------------------------


_AXES = [f"c{k}" for k in range(64)]


@query(
    "WITH e AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS {c}" for k, c in enumerate(_AXES)) + " FROM embeddings) SELECT vec_id, "
    + ", ".join(r6(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1)") + f" AS {c}" for c in _AXES) + " FROM e"
)
def zscore(spark, sf):
    e = fx.read(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(_AXES)])
    return learn.zscores(e, _AXES)


@query("SELECT c_custkey AS user_id, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS label_index FROM customer")
def label_index(spark, sf):
    c = fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return learn.index_labels(c, "c_mktsegment").select("user_id", "label_index")


@query(
    "WITH tr AS (SELECT * FROM embeddings WHERE vec_id % 5 <> 0), te AS (SELECT * FROM embeddings WHERE vec_id % 5 = 0),"
    " n AS (SELECT te.vec_id AS q, tr.label, row_number() OVER (PARTITION BY te.vec_id ORDER BY list_distance(te.embedding::DOUBLE[], tr.embedding::DOUBLE[]), tr.vec_id) AS rk FROM te, tr),"
    " v AS (SELECT q, CAST(label AS VARCHAR) AS label, count(*) AS n FROM n WHERE rk <= 5 GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, label) AS rk FROM v) SELECT q AS id, label AS predicted FROM b WHERE rk = 1"
)
def knn_classifier(spark, sf):
    e = fx.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return learn.knn_classify(e.where("id % 5 <> 0"), e.where("id % 5 = 0"))


@query("SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(round(count(*) * 0.2) AS BIGINT) AS n_test FROM embeddings GROUP BY 1")
def split_stratified(spark, sf):
    parts = evaluate.split(fx.read(spark, sf, "embeddings"), 0.2, 42, "vec_id", "label")
    return parts.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("part") == "test").alias("n_test"))


def _labelled(spark, sf):
    """User features with a class from the market segment, split by a hash."""
    s = fx.staypoints(spark, sf)
    table = s.groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.avg("act_duration").alias("minutes"), *[F.avg((day_part("hour_bin") == k).cast("double")).alias(f"part_{k}") for k in range(6)])
    c = fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    columns = [x for x in table.columns if x != "user_id"]
    rows = learn.weighted(learn.index_labels(learn.assembled(table.join(c, "user_id"), columns), "segment"), "segment")
    rows = evaluate.hash_ranked(rows, "segment", "user_id", 7).withColumn("validation", F.col("_rank") % 7 == 0).drop("_rank", "_total")
    return evaluate.split(rows, 0.2, 42, "user_id", "segment").checkpoint(), columns


@query()
def model_comparison(spark, sf):
    """Random forest, boosted trees and the approximated RBF machine, with accuracy, F1 and an overfitting mark."""
    rows, columns = _labelled(spark, sf)
    mapped = learn.fourier_features(rows, len(columns), 32)
    trees = {"random_forest": learn.random_forest(numTrees=10, maxDepth=4), "boosted": learn.boosted(3, 2)}
    forest = learn.compare(trees, rows.where("part = 'train'"), rows.where("part = 'test'"))
    svm = learn.compare({"rbf_svm": learn.rbf_svm(10)}, mapped.where("part = 'train'"), mapped.where("part = 'test'"))
    return forest.unionByName(svm)
