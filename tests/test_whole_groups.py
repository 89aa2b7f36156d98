import pyarrow as pa

from recollex.runtime import whole_groups


def test_groups_come_whole_whatever_the_batches(spark):
    """Groups that end within a batch, span several or fill one are each seen once and whole."""
    sizes = {"a": 1, "b": 7, "c": 3, "d": 2, "e": 4}
    df = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "k string")

    def judge(table: pa.Table) -> pa.Table:
        keys = table.column("k").to_pylist()
        seen = sorted(set(keys))
        return pa.table({"k": seen, "n": pa.array([keys.count(k) for k in seen], pa.int64())})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted((r.k, r.n) for r in whole_groups(df, "k", judge, "k string, n long").collect())
        assert whole_groups(df.limit(0), "k", judge, "k string, n long").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(sizes.items())


def test_steps_of_a_recall_in_one_pass(spark):
    """The names of the latest sessions are the same from the pool before its scores, and the usual day is that of the first ten."""
    from pyspark.sql import functions as F

    from recollex.operators import recall

    rows = [(f"m{i:02}", i, "any tips?", f"about Lantern{i % 3} and more", f"s{i % 3}", i % 3, None) for i in range(1, 13)]
    pool = spark.createDataFrame([("q", *r, 1.0 / r[1]) for r in rows], "query string, id string, pos int, question string, content string, session_id string, ordinal int, day date, score double")
    base = pool.withColumn("score", F.lit(0.0))
    plain = lambda df: sorted((r.id, round(r.score, 9)) for r in df.collect())
    assert plain(recall.in_context(pool, base)) == plain(recall.in_context(pool)) != plain(pool)

    asked = pool.withColumns({"question": F.lit("how many days ago? it broke"), "day": F.date_add(F.lit("2024-01-01").cast("date"), F.when(F.col("pos") > 10, 300).when(F.col("pos") % 3 == 0, 40).otherwise(F.col("pos") * 90)), "reference": F.lit("2024-02-20").cast("date")})
    lifted = {r.id for r in recall.near_in_time(asked, F.current_timestamp()).where("score > 1.0D / pos + 1e-9").collect()}
    assert lifted == {"m03", "m06", "m09"}
