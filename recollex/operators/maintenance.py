"""Compaction of a memory store: fading, clusters and their merging, conflicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollex.functions.scores import retrievability
from recollex.operators.retrieval import similarity_pairs


def fading(memories: DataFrame, as_of: Column, kept_kinds: tuple[str, ...] = ("decision", "procedure"), least: float = 0.05, min_days: float = 7.0, base: float = 1.0) -> DataFrame:
    """Live, unpinned memories older than ``min_days`` outside the kept kinds whose retrievability has sunk below ``least``."""
    age = (F.unix_micros(as_of) - F.unix_micros("created_at")) / 86_400_000_000.0
    r = retrievability(F.coalesce("last_accessed", "created_at"), F.coalesce("storage_strength", F.lit(0.0)).cast("double"), as_of, base)
    open_ = ~F.coalesce("obsolete", F.lit(False)) & ~F.coalesce("pinned", F.lit(False)) & ~F.coalesce(F.lower("kind"), F.lit("")).isin(*kept_kinds)
    return memories.where(open_ & (age > min_days)).withColumn("retrievability", r).where(F.col("retrievability") < least)


def clusters(rows: DataFrame, key: str, vector: str, group: str, at: str, least: float = 0.88, members: int = 8, min_members: int = 3, neighbours: int = 20) -> DataFrame:
    """``(group, cluster_id, key)``: greedy clusters, oldest pivots first, of at most ``members``.

    Spark finds the pairs over the threshold inside the groups and keeps the
    closest ``neighbours`` of each row; only these few go to the greedy pass of a group.
    """
    pairs = similarity_pairs(rows, key, vector, least, group=group)
    both = pairs.select(F.col("a").alias("_p"), F.col("b").alias("_n"), "cosine").unionByName(pairs.select(F.col("b").alias("_p"), F.col("a").alias("_n"), "cosine"))
    order = Window.partitionBy("_p").orderBy(F.col("cosine").desc(), "_n")
    near = both.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= neighbours)
    info = rows.select(F.col(key).alias("_p"), F.col(group).alias("_g"), F.col(at).alias("_t"))
    adjacent = near.join(info, "_p").groupBy("_g", "_t", "_p").agg(F.sort_array(F.collect_list(F.struct("_r", "_n"))).alias("_near"))

    def greedy(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["_t", "_p"])
        used, out = set(), []
        for pivot, near_ in zip(pool["_p"], pool["_near"], strict=True):
            if pivot in used:
                continue
            free = [x["_n"] for x in near_ if x["_n"] not in used]
            if len(free) >= min_members - 1:
                chosen = [pivot, *free[: members - 1]]
                used.update(chosen)
                out += [(pivot, c) for c in chosen]
        first = pool["_g"].iloc[0]
        return pd.DataFrame({group: [first] * len(out), "cluster_id": [a for a, _ in out], key: [b for _, b in out]})

    kinds = dict(rows.dtypes)
    return adjacent.groupBy("_g").applyInPandas(greedy, f"{group} {kinds[group]}, cluster_id {kinds[key]}, {key} {kinds[key]}")


def merged(members: DataFrame, group: str = "cluster_id") -> DataFrame:
    """One row a cluster: distinct contents joined newest first, tags united, highest confidence, most frequent kind, newest subject."""
    newest = lambda c: F.sort_array(F.collect_list(F.struct("created_at", "confidence", F.col(c).alias("v"))), asc=False)
    kinds = members.groupBy(group, "kind").agg(F.count(F.lit(1)).alias("n"))
    top = kinds.groupBy(group).agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"))
    one = members.groupBy(group).agg(
        newest("content").alias("_c"), newest("subject").alias("_s"), F.max("confidence").alias("confidence"),
        F.sort_array(F.array_distinct(F.concat(F.flatten(F.collect_list("tags")), F.array(F.lit("consolidated"))))).alias("tags"), F.count(F.lit(1)).alias("members"),
    )
    texts = F.transform("_c", lambda x: F.trim(x["v"]))
    distinct = F.filter(F.sequence(F.lit(1), F.size("_t")), lambda i: F.array_position(F.transform("_t", lambda t: F.lower(t)), F.lower(F.element_at("_t", i))) == i)
    kept = F.transform(distinct, lambda i: F.element_at("_t", i.cast("int")))
    content = F.when(F.size(kept) == 1, F.element_at(kept, 1)).otherwise(F.concat(F.lit("Consolidated from "), F.col("members").cast("string"), F.lit(" memories:\n- "), F.array_join(kept, "\n- ")))
    return one.withColumn("_t", texts).select(group, content.alias("content"), F.get("_s", F.lit(0))["v"].alias("subject"), "confidence", "tags", "members").join(top, group)


def conflicts(rows: DataFrame, key: str, vector: str, kind: str, at: str, confidence: str, least: float = 0.85, gap_days: float = 7.0) -> DataFrame:
    """``(newer, older, cosine, obsolete_older)``: for each row the closest older row of its kind, more than ``gap_days`` before, over ``least``."""
    info = lambda side: rows.select(F.col(key).alias(side), F.col(kind).alias(f"_k_{side}"), F.unix_micros(at).alias(f"_t_{side}"), F.col(confidence).cast("double").alias(f"_c_{side}"))
    pairs = similarity_pairs(rows, key, vector, least, group=kind)
    both = pairs.select(F.col("a").alias("newer"), F.col("b").alias("older"), "cosine").unionByName(pairs.select(F.col("b").alias("newer"), F.col("a").alias("older"), "cosine"))
    told = both.join(info("newer"), "newer").join(info("older"), "older").where((F.col("_k_newer") == F.col("_k_older")) & (F.col("_t_newer") - F.col("_t_older") > gap_days * 86_400_000_000))
    order = Window.partitionBy("newer").orderBy(F.round("cosine", 9).desc(), "older")
    return told.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("newer", "older", "cosine", (F.coalesce("_c_newer", F.lit(0.0)) >= F.coalesce("_c_older", F.lit(0.0))).alias("obsolete_older"))
