"""Fusing ranked lists and re-scoring candidates; every step is a function of its own."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollex.functions.text import how_many_in, is_exchange, rank_tokens, rerank_tokens, word_runs
from recollex.runtime import whole_groups


def weighted_rrf(lists: list[tuple[DataFrame, float | Column]], query: str, row: str, k: int = 60) -> DataFrame:
    """``(query, row, score)``: the sum over lists of weight / (k + rank); each list is (query, row, rank)."""
    parts = None
    for ranked, weight in lists:
        w = weight if isinstance(weight, Column) else F.lit(float(weight))
        part = ranked.select(query, row, (w / (F.lit(k) + F.col("rank"))).alias("_s"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(query, row).agg(F.sum("_s").alias("score"))


def keyword_rerank(df: DataFrame, query_text: str, content: str, score: str = "score", tf_weight: float = 0.15, phrase_weight: float = 0.10) -> DataFrame:
    """Adds word and phrase agreement to the score, capped at 1; a query without words changes nothing, a null content agrees in nothing."""
    df = df.withColumns({"_q": rerank_tokens(F.col(query_text)), "_c": F.coalesce(rerank_tokens(F.col(content)), F.array().cast("array<string>"))})
    hits = F.aggregate(F.array_distinct("_q"), F.lit(0), lambda s, w: s + F.least(F.lit(2), F.size("_c") - F.size(F.array_remove("_c", w))))
    tf = F.try_divide(hits.cast("double"), (2 * F.size(F.array_distinct("_q"))).cast("double"))
    phrases = F.concat(word_runs(F.col("_q"), 2), word_runs(F.col("_q"), 3))
    shares = F.try_divide(how_many_in(phrases, F.lower(F.col(content))).cast("double"), F.size(phrases).cast("double"))
    raised = F.least(F.lit(1.0), F.col(score) + tf_weight * F.coalesce(tf, F.lit(0.0)) + phrase_weight * F.coalesce(shares, F.lit(0.0)))
    return df.withColumn(score, F.when(F.size("_q") > 0, raised).otherwise(F.col(score))).drop("_q", "_c")


def turn_pair_boost(df: DataFrame, query: str, content: str, order: list[Column], top: int = 10, boost: float = 0.008) -> DataFrame:
    """Lifts complete exchanges among the first ``top`` of each query."""
    complete = is_exchange(F.col(content))
    place = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    return df.withColumn("_p", place).withColumn("score", F.col("score") + F.when((F.col("_p") <= top) & complete, boost).otherwise(0.0)).drop("_p")


def temporal_boost(df: DataFrame, day: str, target: Column, reference: Column, boost: float = 0.015) -> DataFrame:
    """A Gaussian lift for days near the target, wide for far targets; lifts of 0.001 or less and undated rows are left out."""
    sigma = F.when(F.abs(F.datediff(reference, target)) > 25, 30.0).otherwise(3.5)
    near = F.exp(-0.5 * F.pow(F.datediff(F.col(day), target) / sigma, F.lit(2.0)))
    return df.withColumn("score", F.col("score") + F.when(boost * near > 0.001, boost * near).otherwise(0.0))


def recency_boost(df: DataFrame, query: str, ordinal: str, boost: float = 0.015) -> DataFrame:
    most = F.max(F.coalesce(F.col(ordinal), F.lit(0))).over(Window.partitionBy(query))
    return df.withColumn("score", F.col("score") + F.coalesce(F.try_divide(boost * F.coalesce(F.col(ordinal), F.lit(0)), most), F.lit(0.0)))


def near_tie_reorder(df: DataFrame, query: str, rank: str, keys: list[Column], eps: float = 0.005) -> DataFrame:
    """Renumbers ``rank``: the leading rows within ``eps`` of the first row's score go by ``keys``, highest first; ties and all others keep their order."""
    whole = Window.partitionBy(query)
    top = F.max(F.when(F.col(rank) == 1, F.col("score"))).over(whole)
    far = F.max((top - F.col("score") > eps).cast("int")).over(whole.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("_top", top).withColumn("_far", far)
    order = Window.partitionBy(query).orderBy("_far", *[F.when(F.col("_far") == 0, k).desc_nulls_last() for k in keys], "_old")
    return marked.withColumn("_old", F.col(rank)).withColumn(rank, F.row_number().over(order)).drop("_top", "_far", "_old")


def diversify(df: DataFrame, query: str, row: str, content: str, group: str, limit: int, trade: float = 0.7, cap: int = 2, rank: str | None = None, whole: str | None = None) -> DataFrame:
    """Greedy maximal marginal relevance: ``(query, row, rank, score)``, ``limit`` a query.

    Relevance is the score scaled to 0..1, redundancy the highest token overlap
    with what is chosen; a group over its cap counts as full overlap, a null
    group is one of its own.  Ties go by ``rank`` if given, else by score and
    row.  Queries whose column ``whole`` is true come out whole in that order.  A
    query's candidates come from bounded lists, so one task holds one small pool.
    """
    schema = f"{query} {dict(df.dtypes)[query]}, {row} {dict(df.dtypes)[row]}, rank int, score double"

    def overlaps(bags: list[list[str]]) -> np.ndarray:
        """Shared tokens as a share of all tokens, of every two bags."""
        places: dict[str, int] = {}
        at = [[places.setdefault(w, len(places)) for w in bag] for bag in bags]
        size = np.array([len(x) for x in at], np.float64)
        held = np.zeros((len(bags), max(1, len(places))), np.float32)
        held[np.repeat(np.arange(len(bags)), size.astype(np.int64)), np.array([i for x in at for i in x], np.int64)] = 1.0
        shared = (held @ held.T).astype(np.float64)
        union = size[:, None] + size[None, :] - shared
        return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)

    def choose(score: np.ndarray, groups: list, bags: list[list[str]]) -> list[int]:
        low, high = score.min(), score.max()
        relevance = (score - low) / max(high - low, 1e-10)
        alike, worst, count, chosen = overlaps(bags), np.zeros(len(score)), {}, []
        full, left = np.zeros(len(score), bool), np.ones(len(score), bool)
        number = np.unique(groups, return_inverse=True)[1]
        for _ in range(min(limit, len(score))):
            value = trade * relevance - (1 - trade) * np.where(full, 1.0, worst)
            pick = int(np.argmax(np.where(left, value, -np.inf)))
            left[pick] = False
            chosen.append(pick)
            count[number[pick]] = count.get(number[pick], 0) + 1
            if count[number[pick]] >= cap:
                full |= number == number[pick]
            worst = np.maximum(worst, alike[pick])
        return chosen

    def judge(pools: pa.Table) -> pa.Table:
        # The rows of a query are together; within it they go by rank.
        keys, number = {}, []
        for q in pools.column(query).to_pylist():
            number.append(keys.setdefault(q, len(keys)))
        number = np.array(number, np.int64)
        score = pools.column("score").to_numpy()
        order = np.lexsort((pools.column("_rank").to_numpy(), number))
        groups, bags, whole = pools.column(group).to_pylist(), pools.column("_tokens").to_pylist(), pools.column("_whole").to_pylist()
        kept, ranks = [], []
        for part in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
            at = part.tolist()
            if not whole[at[0]]:
                own = [f"g{groups[i]}" if groups[i] is not None else f"r{i}" for i in at]
                at = [at[i] for i in choose(score[part], own, [bags[i] or [] for i in at])]
            kept += at
            ranks += range(1, len(at) + 1)
        at = pa.array(kept, pa.int64())
        return pa.table([pools.column(query).take(at), pools.column(row).take(at), pa.array(ranks, pa.int32()), pools.column("score").take(at)], names=[query, row, "rank", "score"])

    place = F.col(rank).cast("long") if rank else F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), row)).cast("long")
    slim = df.select(
        query, row, F.col("score").cast("double").alias("score"), F.col(group).cast("string").alias(group), F.array_distinct(rank_tokens(F.col(content))).alias("_tokens"),
        place.alias("_rank"), (F.coalesce(F.col(whole), F.lit(False)) if whole else F.lit(False)).alias("_whole"),
    )
    return whole_groups(slim, query, judge, schema)
