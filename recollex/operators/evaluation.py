"""Retrieval metrics over ranked runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranking_metrics(run: DataFrame, relevant: DataFrame, query: str, row: str, k: int) -> DataFrame:
    """``(query, recall, precision, ndcg, any_hit, all_hit)`` at k for every query with a relevant row.

    ``run`` is (query, row, rank from 1), ``relevant`` is (query, row, gain > 0), one row a pair.
    The ideal order is that of all relevant rows.
    """
    hits = run.where(F.col("rank") <= k).join(relevant, [query, row]).groupBy(query).agg(F.count(F.lit(1)).alias("hits"), F.sum(F.col("gain") / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    gains = relevant.groupBy(query).agg(F.sort_array(F.collect_list(F.col("gain").cast("double")), asc=False).alias("g"))
    best = F.slice("g", 1, k)
    ideal = F.aggregate(F.zip_with(best, F.sequence(F.lit(1), F.size(best)), lambda g, i: g / F.log2(i + 1.0)), F.lit(0.0), lambda s, x: s + x)
    joined = gains.select(query, F.size("g").alias("n"), ideal.alias("ideal")).join(hits, query, "left")
    found = F.coalesce("hits", F.lit(0))
    return joined.select(
        query, (found / F.col("n")).alias("recall"), (found / F.lit(float(k))).alias("precision"), F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)).alias("ndcg"),
        (found > 0).alias("any_hit"), (found >= F.least(F.col("n"), F.lit(k))).alias("all_hit"),
    )


def retrieved_metrics(run: DataFrame, relevant: DataFrame, query: str, row: str, k: int) -> DataFrame:
    """``(query, recall_any, recall_all, ndcg)`` at k for every query with a relevant row; the ideal order is that of what was retrieved."""
    wanted = relevant.select(query, row).distinct()
    hits = run.where(F.col("rank") <= k).join(wanted, [query, row]).groupBy(query).agg(F.count(F.lit(1)).alias("hits"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    told = wanted.groupBy(query).agg(F.count(F.lit(1)).alias("n")).join(hits, query, "left")
    found = F.coalesce("hits", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), found)), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return told.select(query, (found > 0).cast("double").alias("recall_any"), (found >= F.col("n")).cast("double").alias("recall_all"), F.when(found > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def session_of(corpus_id: Column) -> Column:
    """The session of a turn-level id such as s_turn_4; other ids are sessions themselves."""
    return F.regexp_replace(corpus_id, r"^(.*)_turn_.*$", "$1")


def evidence_sessions(evidence: Column) -> Column:
    """Distinct sessions that dialogue ids such as D3:7 lie in; others name none."""
    numbers = F.filter(F.transform(evidence, lambda e: F.regexp_extract(e, r"^D(\d+):", 1)), lambda n: n != "")
    return F.array_distinct(F.transform(numbers, lambda n: F.concat(F.lit("session_"), n)))


def source_ids(written: Column) -> Column:
    """Distinct ids of a JSON list, or of a JSON object of lists and numbers; none where there are none."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_replace(F.coalesce(written, F.lit("")), r'"(?:[^"\\]|\\.)*"', ""), F.lit(r"-?\d+"), 0), lambda x: x.cast("long")))


def numbered_facts(context: Column) -> Column:
    """The facts of a list '0. ...' a line each, else its paragraphs."""
    facts = F.filter(F.transform(F.regexp_extract_all(context, F.lit(r"(?m)^\d+\.[ \t]+(.+)$"), 1), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.filter(F.transform(F.split(context, "\n\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(facts) > 0, facts).otherwise(parts)


def normal_tokens(text: Column) -> Column:
    """Answer tokens: without commas, lower-case articles and 'and', and ASCII punctuation, then in lower case."""
    bare = F.regexp_replace(F.regexp_replace(text, ",", ""), r"\b(?:a|an|the|and)\b", " ")
    return F.filter(F.split(F.lower(F.regexp_replace(bare, r"[!-/:-@\[-`{-~]", "")), r"\s+"), lambda w: w != "")


def token_f1(predicted: Column, gold: Column) -> Column:
    """Harmonic mean of precision and recall over the common tokens, repeats counted; 1 if both are empty, 0 if one is."""
    p, g = normal_tokens(predicted), normal_tokens(gold)
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda s, w: s + F.least(count(p, w), count(g, w)))
    return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(2.0 * common / (F.size(p) + F.size(g)))


def evidence_recall(found: Column, evidence: Column) -> Column:
    """Share of the evidence that was found; 1 where there is none."""
    return F.when(F.size(evidence) > 0, F.size(F.array_intersect(found, evidence)) / F.size(F.array_distinct(evidence))).otherwise(1.0)


def compare_runs(before: DataFrame, after: DataFrame, query: str, hit: str) -> DataFrame:
    """Questions gained and lost between two runs of (query, hit)."""
    both = before.select(query, F.col(hit).alias("b")).join(after.select(query, F.col(hit).alias("a")), query)
    return both.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("b")).alias("hits_before"), F.count_if(F.col("a")).alias("hits_after"), F.count_if(~F.col("b") & F.col("a")).alias("gained"), F.count_if(F.col("b") & ~F.col("a")).alias("lost"))
