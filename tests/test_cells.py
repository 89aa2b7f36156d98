"""Searches in which questions meet the rows of their group in cells."""

import math
import random

import pyspark.sql.functions as F
import pytest

from recollex.operators import fusion, retrieval


def test_grouped_searches_leave_other_groups_alone(spark, monkeypatch):
    """No block of questions goes to the driver and meets all rows; the results are those of comparing every two."""
    monkeypatch.setattr(retrieval, "_blocks", lambda *_: pytest.fail("met all rows"))
    chance = random.Random(5)
    words = ["red", "blue", "lantern", "harbour", "seven", "x"]
    rows = [(f"r{i:03}", chance.choice(["a", "b", "c", None]), " ".join(chance.choices(words, k=5)), [chance.random() for _ in range(3)]) for i in range(90)]
    asked = [(f"q{i}", chance.choice(["a", "b", "d", None]), " ".join(chance.choices(words, k=3)), [chance.random() for _ in range(3)]) for i in range(12)]
    q, r = spark.createDataFrame(asked, "q string, g string, t string, v array<double>"), spark.createDataFrame(rows, "id string, g string, t string, v array<double>")
    sees = [(a, b) for a in asked for b in rows if a[1] is None or a[1] == b[1]]

    def best(value, least):
        out = set()
        for a in asked:
            own = sorted((-round(value(x, y), 9), y[0]) for x, y in sees if x == a and value(x, y) > least)[:4]
            out |= {(a[0], y, n + 1) for n, (_, y) in enumerate(own)}
        return out

    def cosine(x, y):
        size = lambda v: sum(c * c for c in v) ** 0.5
        return sum(a * b for a, b in zip(x[3], y[3], strict=True)) / size(x[3]) / size(y[3])

    def alike(x, y):
        one, two = set(retrieval._py_trigrams(x[2])), set(retrieval._py_trigrams(y[2]))
        return len(one & two) / len(one | two)

    near = retrieval.nearest(q, "q", "v", r, "id", "v", 4, group="g")
    assert {(x.q, x.id, x["rank"]) for x in near.collect()} == best(cosine, -2)
    same = retrieval.trigram_matches(q, "q", "t", r, "id", "t", 0.1, 4, "g")
    assert {(x.q, x.id, x["rank"]) for x in same.collect()} == best(alike, 0.1)


def test_equal_to_nine_digits_goes_to_the_smaller_row(spark):
    rows = spark.createDataFrame([("b", "g", [1.0, 0.0]), ("a", "g", [1.0, 1e-5]), ("c", "g", [1.0])], "id string, g string, v array<double>").coalesce(1)
    q = spark.createDataFrame([("q", "g", [1.0, 0.0]), ("s", "g", [2.0])], "q string, g string, w array<double>")
    found = {(r.q, r.id) for r in retrieval.nearest(q, "q", "w", rows, "id", "v", 1, group="g").collect()}
    assert found == {("q", "a"), ("s", "c")}


def test_diversity_by_hand(spark):
    rows = [("q", "a", 3.0, "s", "one two"), ("q", "b", 2.9, "s", "one two"), ("q", "c", 1.0, None, "three"), ("p", "d", 1.0, "s", None)]
    df = spark.createDataFrame(rows, "q string, id string, score double, s string, content string").repartition(3)
    got = [(r.q, r.id, r["rank"]) for r in fusion.diversify(df, "q", "id", "content", "s", 2).orderBy("q", "rank").collect()]
    assert got == [("p", "d", 1), ("q", "a", 1), ("q", "b", 2)]
    assert {r.id for r in fusion.diversify(df, "q", "id", "content", "s", 2, trade=0.3).where(F.col("q") == "q").collect()} == {"a", "c"}


def test_bm25_and_trigrams_without_groups_meet_rows_in_cells(spark, monkeypatch):
    """Common words alone bring no row, repeated texts come in the order of their rows, and all is as by adding up every score."""
    monkeypatch.setattr(retrieval, "_blocks", lambda *_: pytest.fail("met all rows"))
    chance = random.Random(9)
    words, shares = ["the", "of", "in", "lantern", "harbour", "seven", "quartz", "zebra"], [30, 20, 15, 4, 3, 3, 1, 1]
    rows = [(f"r{i:03}", " ".join(chance.choices(words, shares, k=chance.randint(1, 9)))) for i in range(300)] + [("r900", None), ("r901", ""), ("r902", "zebra zebra"), ("r903", "zebra zebra")]
    asked = [(f"q{i:02}", " ".join(chance.choices(words, k=4))) for i in range(20)] + [("q90", None), ("q91", "?"), ("q92", "unknown")]
    q, r = spark.createDataFrame(asked, "q string, t string"), spark.createDataFrame(rows, "id string, t string").repartition(3)
    texts = {i: (t or "").split() for i, t in rows}
    mean = sum(map(len, texts.values())) / len(texts)

    def score(words_asked, own):
        out = 0.0
        for w in words_asked:
            df, tf = sum(w in t for t in texts.values()), own.count(w)
            out += math.log((len(texts) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(own) / mean))
        return out

    want = set()
    for key, t in asked:
        scored = sorted((-round(score((t or "").split(), own), 6), i) for i, own in texts.items() if set(own) & set((t or "").split()))
        want |= {(key, i, n + 1, -s) for n, (s, i) in enumerate(scored[:7])}
    for sizes in ((40, 6), (131072, 8192)):
        monkeypatch.setattr(retrieval, "BM25_ROWS", sizes[0])
        monkeypatch.setattr(retrieval, "BM25_QUERIES", sizes[1])
        assert {(x.q, x.id, x["rank"], round(x.score, 6)) for x in retrieval.bm25(q, "q", "t", r, "id", "t", 7).collect()} == want
    assert [x.id for x in retrieval.trigram_matches(q.where("q = 'q00'").withColumn("t", F.lit("zebra")), "q", "t", r.where("id > 'r9'"), "id", "t", 0.1, 5).orderBy("rank").collect()] == ["r902", "r903"]
