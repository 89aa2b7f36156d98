"""Bundles for a prompt: text within a budget, memories of linked entities, rankers of a candidate pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollex.functions.text import how_many_in, numbers_in, proper_nouns


def within_budget(df: DataFrame, query: str, order: list[Column], content: str, budget_chars: int, most: int = 1500) -> DataFrame:
    """Rows of each query in order while their lines fit; long contents are cut to ``most`` with an ellipsis, the last line is cut if over 20 characters remain."""
    line = F.when(F.length(content) > most, F.concat(F.substring(content, 1, most - 3), F.lit("…"))).otherwise(F.col(content))
    df = df.withColumn("line", line)
    before = F.coalesce(F.sum(F.length("line") + 1).over(Window.partitionBy(query).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("_left", F.lit(budget_chars) - before)
    fits = F.length("line") + 1 <= F.col("_left")
    return df.where(fits | (F.col("_left") > 20)).withColumn("line", F.when(fits, F.col("line")).otherwise(F.expr("substring(line, 1, cast(_left as int) - 1)"))).drop("_left")


def linked_memories(entities: DataFrame, links: DataFrame, memories: DataFrame, each: int = 5) -> DataFrame:
    """``(entity, id)``: the newest live memories of each entity, ``each`` at most; entities, links and memories are (entity), (entity, id), (id, obsolete, created_at)."""
    live = memories.where(~F.coalesce("obsolete", F.lit(False))).select("id", "created_at")
    met = links.join(entities.select("entity").distinct(), "entity", "left_semi").join(live, "id")
    order = Window.partitionBy("entity").orderBy(F.desc("created_at"), "id")
    return met.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).select("entity", "id")


def ranked(df: DataFrame, query: str, row: str, key: Column) -> DataFrame:
    """``(query, row, rank)`` of a candidate pool by a descending key, ties in pool order, else by row."""
    tie = F.col("pool_pos") if "pool_pos" in df.columns else F.col(row)
    return df.select(query, row, F.row_number().over(Window.partitionBy(query).orderBy(key.desc_nulls_last(), tie)).alias("rank"))


def entity_overlap(query_text: Column, content: Column) -> Column:
    """How many of a question's names and numbers stand in the content."""
    wanted = F.array_distinct(F.concat(F.transform(proper_nouns(query_text), lambda w: F.lower(w)), numbers_in(query_text)))
    return how_many_in(wanted, F.lower(content))


def date_nearness(day: Column, target: Column) -> Column:
    """Minus the days between; undated rows rank as a hundred years off."""
    return -F.coalesce(F.abs(F.datediff(day, target)), F.lit(36500))
