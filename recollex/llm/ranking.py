"""One ranking from several differently-scaled scores by reciprocal rank fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollex.runtime import stored


def _clean(df: DataFrame, query: str, item: str, scores: Sequence[str]) -> DataFrame:
    """One row a candidate: repeated rows fall together; of several scores of one kind the best counts; NaN is missing."""
    best = [F.max(F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double"))).alias(s) for s in scores]
    return df.select(query, item, *scores).groupBy(query, item).agg(*best)


def _windowed_ranks(candidates: DataFrame, query: str, scores: Sequence[str]) -> DataFrame:
    ranks = {f"rank_{s}": F.rank().over(Window.partitionBy(query).orderBy(F.col(s).desc_nulls_last())) for s in scores}
    return candidates.withColumns(ranks)


def _spread_ranks(candidates: DataFrame, query: str, scores: Sequence[str], partitions: int) -> DataFrame:
    """The same ranks for queries of any size: each score is range-partitioned and counted, no task holds a whole query.

    Equal scores are counted together first, so that ties don't make a hot range.
    """
    ranked = candidates
    for s in scores:
        values = candidates.groupBy(query, s).agg(F.count(F.lit(1)).alias("_n"))
        laid = stored(
            values.repartitionByRange(partitions, F.col(query), F.col(s).desc_nulls_last()).withColumn("_part", F.spark_partition_id()), "score-ranges"
        )
        per_part = laid.groupBy(query, "_part").agg(F.sum("_n").alias("_sum"))
        before = Window.partitionBy(query).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = per_part.select(query, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
        inside = Window.partitionBy(query, "_part").orderBy(F.col(s).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
        offsets = offsets.withColumnsRenamed({query: "_oq", "_part": "_op"})
        placed = laid.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        placed = placed.join(offsets, F.col(query).eqNullSafe(F.col("_oq")) & (F.col("_part") == F.col("_op")))
        placed = placed.select(F.col(query).alias("_q"), F.col(s).alias("_s"), (F.col("_before") + F.col("_inside") + 1).cast("int").alias(f"rank_{s}"))
        ranked = ranked.join(placed, F.col(query).eqNullSafe(F.col("_q")) & F.col(s).eqNullSafe(F.col("_s"))).drop("_q", "_s")
    return ranked


def fuse_rankings(df: DataFrame, query: str, item: str, scores: Sequence[str], k: int = 60, hot_rows: int = 500_000) -> DataFrame:
    """``(query, item, rank_<score>..., rrf)`` for every candidate of every query.

    Each score ranks the candidates on its own (higher is better, ties share the
    better rank, a missing score ranks behind every present one), and
    ``rrf = sum 1/(k + rank)``.  Only ranks enter, so neither range nor
    distribution of a score matters.  Repeated rows count once; a candidate all
    of whose scores are missing still ranks; null query and item values form
    groups of their own; an empty table gives an empty result; other columns are
    ignored.  Queries with more than ``hot_rows`` rows are ranked by ranges
    spread over all tasks instead of one window.
    """
    candidates = _clean(df, query, item, scores)
    sizes = df.groupBy(query).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows).select(F.col(query).alias("_hot"))
    if sizes.isEmpty():
        ranked = _windowed_ranks(candidates, query, scores)
    else:
        same = F.col(query).eqNullSafe(F.col("_hot"))
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranked = _windowed_ranks(candidates.join(sizes, same, "left_anti"), query, scores).unionByName(
            _spread_ranks(candidates.join(sizes, same, "left_semi"), query, scores, parts)
        )
    rrf = sum((1.0 / (F.lit(k) + F.col(f"rank_{s}")) for s in scores), F.lit(0.0))
    return ranked.select(query, item, *[f"rank_{s}" for s in scores], rrf.alias("rrf"))


def best_candidate(ranking: DataFrame, query: str, item: str) -> DataFrame:
    """The first candidate of each query; equal sums go to the smaller item."""
    top = ranking.groupBy(query).agg(F.min(F.struct((-F.col("rrf")).alias("r"), F.col(item).alias("i"))).alias("_t"))
    return top.select(query, F.col("_t.i").alias(item))
