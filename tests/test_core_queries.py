import os

import pytest

import __spark_entry__
from recollex.plans import core_queries, more_queries, recall_queries, store_queries, timestamp_queries
from tests.compare import connection, rows_of, sql_rows

SMALL = "/root/testdata/sf0.001"
MODULES = (core_queries, more_queries, recall_queries, store_queries, timestamp_queries)
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
ORACLES = {n: q for m in MODULES for n, q in m.ORACLES.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are missing")


@pytest.fixture(scope="module")
def duck():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SMALL)) == sql_rows(duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_do_not_depend_on_partitions(spark, name):
    """Queries without SQL give rows, and the same whatever the number of partitions; their operators have tests of their own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = rows_of(QUERIES[name](spark, SMALL))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        two = rows_of(QUERIES[name](spark, SMALL).repartition(3))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one == two and (one or name in MAY_BE_EMPTY)


#: No vectors of the smallest table are near enough.
MAY_BE_EMPTY = {"o145_clusters"}


def test_every_query_is_registered():
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", ["o102_recall", "o98_recall_with_feedback"])
def test_recall_gives_ten_different_rows_a_question(spark, name):
    rows = QUERIES[name](spark, SMALL).toPandas()
    per = rows.groupby("question_id")
    assert per.id.nunique().max() <= 10 and not rows.duplicated(["question_id", "rank"]).any() and not rows.duplicated(["question_id", "id"]).any()
    assert (per["rank"].max() == per.size()).all()
