import pytest
from pyspark.sql import functions as F

from recollex.functions import text
from recollex.operators import context, refine


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_maxsim_rerank_leaves_the_tail(spark):
    rows = [("q", "a", 0.9, [[0.0, 1.0]]), ("q", "b", 0.8, [[1.0, 0.0]]), ("q", "c", 0.7, [[1.0, 0.0]]), ("q", "d", 0.6, [])]
    df = spark.createDataFrame(rows, "q string, r string, score double, d array<array<double>>").withColumn("t", F.array(F.array(F.lit(1.0), F.lit(0.0))))
    got = [r.r for r in refine.maxsim_rerank(df, "q", "r", "t", "d", top=2).orderBy(F.desc("score")).collect()]
    assert got == ["b", "a", "c", "d"]


def test_context_names_lift_only_vague_questions(spark):
    rows = [("v", "Any tips?", "m1", "s2", 2, "Bought a Powerbank for Lisbon"), ("v", "Any tips?", "m2", "s1", 1, "Charging the powerbank"), ("v", "Any tips?", "m3", None, None, None), ("f", "What is the port?", "m1", "s2", 2, "Bought a Powerbank for Lisbon")]
    df = spark.createDataFrame(rows, "q string, t string, r string, s string, o int, c string").withColumn("score", F.lit(0.0))
    names = refine.context_entities(df, "q", "s", "o", "c", "r", sessions=1)
    assert {r.q: r.names for r in names.collect()}["v"] == ["Bought", "Powerbank", "Lisbon"]
    got = {(r.q, r.r): round(r.score, 3) for r in refine.context_boost(df, names, "q", "t", "c").collect()}
    assert got == {("v", "m1"): 0.036, ("v", "m2"): 0.012, ("v", "m3"): 0.0, ("f", "m1"): 0.0}


def test_preference_and_feedback(spark):
    df = spark.createDataFrame([("q", "Any tips?", "a", "I love tea. I prefer green tea.", 1), ("q", "Any tips?", "b", "Tea is hot", 2), ("q", "Any tips?", "c", None, 3)], "q string, t string, r string, c string, rank int").withColumn("score", F.lit(0.0))
    got = {r.r: r.score for r in refine.preference_boost(df, "q", "t", "c", [F.asc("rank")]).collect()}
    assert got["a"] == pytest.approx(0.03) and got["b"] == got["c"] == 0.0
    assert refine.feedback_terms(df, "q", "c", docs=2, most=1).first().terms == ["tea"]


def test_date_filter_needs_enough_rows(spark):
    df = spark.sql("SELECT 'q' AS q, id AS r, date_add(date'2024-01-01', cast(id AS int)) AS day FROM range(10)")
    target = F.lit("2024-01-01").cast("date")
    assert refine.date_filter(df, "q", "day", target, least=4).count() == 4
    assert refine.date_filter(df, "q", "day", target, least=5).count() == 10


def test_access_effects_and_answers(spark):
    ranked = spark.createDataFrame([("q1", "a", 1), ("q2", "a", 2), ("q1", "b", 9)], "q string, id string, rank int")
    m = spark.createDataFrame([("a", 0.0, None), ("b", 0.0, 1)], "id string, storage_strength double, access_count int")
    r = refine.access_effects(ranked, m, "id", F.lit("2024-01-01").cast("timestamp")).collect()
    assert [(x.id, x.accesses, round(x.storage_strength, 6), x.access_count) for x in r] == [("a", 2, 0.9, 2)]
    df = spark.createDataFrame([("The Red car!", "red CAR"), ("", "x"), (None, "x"), ("a", "b")], "p string, g string")
    assert [x[0] for x in df.select(refine.substring_match(F.col("p"), F.col("g"))).collect()] == [True, False, False, False]


def test_pool_rankers(spark):
    df = spark.createDataFrame([("q", "a", "Meet Anna at 42", 1), ("q", "b", "anna", 2), ("q", "c", None, 3)], "q string, r string, c string, pool_pos int")
    got = [r.r for r in context.ranked(df, "q", "r", context.entity_overlap(F.lit("Where did Anna put 42?"), F.col("c"))).orderBy("rank").collect()]
    assert got[:2] == ["a", "b"]
    nearness = spark.sql("SELECT date'2024-01-03' AS d, cast(null AS date) AS n").select(context.date_nearness(F.col("d"), F.lit("2024-01-01").cast("date")), context.date_nearness(F.col("n"), F.lit("2024-01-01").cast("date"))).first()
    assert tuple(nearness) == (-2, -36500)
    assert spark.sql("SELECT '[user]: a [ASSISTANT]: b' AS c").select(text.is_exchange(F.col("c"))).first()[0] is True
