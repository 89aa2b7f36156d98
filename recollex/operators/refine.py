"""Optional steps of a recall: late-interaction reranking, context and preference lifts, feedback terms, hard date filter, access effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollex.functions.features import context_words
from recollex.functions.scores import maxsim, strength_after
from recollex.functions.text import QUERY_STOP_WORDS, how_many_in, is_vague, rank_tokens

# How a first-person preference and a question for advice begin.
LIKES = r"(?i)\bI\s+(?:love|prefer|like|use|always|usually|recommend|enjoy|find|tend\s+to|try\s+to|often|never|hate|dislike|avoid)\b"
ADVICE = r"(?i)\b(?:any\s+(?:tips|advice|suggestions|ideas|recommendations)|what\s+(?:should|would|do)\s+(?:I|you)|how\s+(?:should|do)\s+I|do\s+you\s+(?:think|know|remember|recall))\b"


def maxsim_rerank(df: DataFrame, query: str, row: str, query_tokens: str, doc_tokens: str, top: int = 20) -> DataFrame:
    """Reorders the first ``top`` of each query by late interaction and leaves the tail; the score becomes (n - place) / n."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), row))
    df = df.withColumn("_p", place)
    value = F.when(F.col("_p") <= top, maxsim(F.col(query_tokens), F.col(doc_tokens)))
    df = df.withColumn("_m", value)
    order = Window.partitionBy(query).orderBy(F.when(F.col("_p") <= top, 0).otherwise(1), F.desc_nulls_last("_m"), "_p")
    n = F.count(F.lit(1)).over(Window.partitionBy(query))
    return df.withColumn("_r", F.row_number().over(order)).withColumn("score", (n - F.col("_r") + 1) / n).drop("_p", "_m", "_r")


def context_entities(df: DataFrame, query: str, session: str, ordinal: str, content: str, place: str, sessions: int = 2, most: int = 5) -> DataFrame:
    """``(query, names)``: words that name things in the first memory, by ``place``, of each of the latest sessions of a pool, the first ``most``."""
    first = df.where(F.col(session).isNotNull()).groupBy(query, session).agg(F.max(F.coalesce(F.col(ordinal), F.lit(0))).alias("_o"), F.min(place).alias("_p"), F.min_by(content, place).alias("_c"))
    latest = first.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("_o"), "_p"))).where(F.col("_n") <= sessions)
    joined = latest.groupBy(query).agg(F.array_join(F.sort_array(F.collect_list(F.struct("_n", "_c")))["_c"], " ").alias("_t"))
    return joined.select(query, context_words(F.col("_t"), most).alias("names"))


def context_boost(df: DataFrame, names: DataFrame, query: str, query_text: str, content: str, boost: float = 0.012) -> DataFrame:
    """Lifts memories that hold the context's names, for vague questions only."""
    told = df.join(names, query, "left")
    wanted = F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda w: F.lower(w))
    return told.withColumn("score", F.col("score") + F.when(is_vague(F.col(query_text)), boost * how_many_in(wanted, F.lower(F.col(content)))).otherwise(0.0)).drop("names")


def preference_boost(df: DataFrame, query: str, query_text: str, content: str, order: list[Column], top: int = 20, boost: float = 0.015) -> DataFrame:
    """Lifts first-person preferences among the first ``top``, for vague questions that ask for advice."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    asked = is_vague(F.col(query_text)) & F.col(query_text).rlike(ADVICE)
    signs = F.coalesce(F.regexp_count(F.col(content), F.lit(LIKES)), F.lit(0))
    return df.withColumn("_p", place).withColumn("score", F.col("score") + F.when((F.col("_p") <= top) & asked, boost * signs).otherwise(0.0)).drop("_p")


def feedback_terms(df: DataFrame, query: str, content: str, docs: int = 5, most: int = 8) -> DataFrame:
    """``(query, terms)``: words of three letters or more in most of the first ``docs`` contents, for a second search."""
    words = F.array_distinct(F.filter(rank_tokens(F.col(content)), lambda w: (F.length(w) >= 3) & ~w.isin(*QUERY_STOP_WORDS)))
    counted = df.where(F.col("rank") <= docs).select(query, F.explode(words).alias("term")).groupBy(query, "term").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy(query).orderBy(F.desc("df"), "term")
    kept = counted.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return kept.groupBy(query).agg(F.sort_array(F.collect_list(F.struct("_n", "term")))["term"].alias("terms"))


def date_filter(df: DataFrame, query: str, day: str, target: Column, days: float = 3.5, least: int = 10) -> DataFrame:
    """Keeps rows within ``days`` of the target where at least ``least`` of the query are; else all."""
    near = F.coalesce(F.abs(F.datediff(F.col(day), target)) <= days, F.lit(False))
    n = F.count_if(F.col("_near")).over(Window.partitionBy(query))
    return df.withColumn("_near", near).withColumn("_n", n).where(F.col("_near") | (F.col("_n") < least)).drop("_near", "_n")


def access_effects(ranked: DataFrame, memories: DataFrame, row: str, as_of: Column, first: int = 5) -> DataFrame:
    """``(row, accesses, storage_strength, retrieval_strength, access_count, last_accessed)``: the state of memories after the first results of all queries were read."""
    read = ranked.where(F.col("rank") <= first).groupBy(row).agg(F.count(F.lit(1)).alias("accesses"))
    m = memories.select(row, "storage_strength", "access_count")
    return read.join(m, row).select(
        row, "accesses", strength_after(F.coalesce("storage_strength", F.lit(0.0)), F.col("accesses")).alias("storage_strength"), F.lit(1.0).alias("retrieval_strength"),
        (F.coalesce("access_count", F.lit(0)) + F.col("accesses")).cast("int").alias("access_count"), as_of.alias("last_accessed"),
    )


def project_status(memories: DataFrame, projects: DataFrame) -> DataFrame:
    """One row a project: its counts, its latest session, how many live memories of each kind."""
    live = ~F.coalesce(F.col("obsolete"), F.lit(False))
    kinds = memories.where(live).groupBy("project_id", F.coalesce(F.lower(F.trim("kind")), F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    by_kind = kinds.groupBy("project_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    counts = memories.groupBy("project_id").agg(F.count(F.lit(1)).alias("memories"), F.count_if(live).alias("live"), F.max_by(F.when(F.col("session_id").isNotNull(), F.col("session_id")), F.when(F.col("session_id").isNotNull(), F.struct("created_at", "id"))).alias("last_session"))
    return projects.select(F.col("id").alias("project_id"), "name").join(counts, "project_id", "left").join(by_kind, "project_id", "left")


def substring_match(predicted: Column, gold: Column) -> Column:
    """Whether one answer holds the other, signs and case left out; false where one is empty."""
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    p, g = clean(predicted), clean(gold)
    return F.coalesce((p != "") & (g != "") & (F.contains(p, g) | F.contains(g, p)), F.lit(False))
