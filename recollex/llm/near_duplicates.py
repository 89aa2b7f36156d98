"""Groups of near-duplicate records over a whole collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.llm.alike import CELL, alike_pairs, components, distinct_sets, word_hashes
from recollex.runtime import stored


def near_duplicate_groups(df: DataFrame, key: str, text: str, num: int = 7, den: int = 10, cell: int = CELL) -> DataFrame:
    """``(key, class_id, links, group_id)``: one row for every row of ``df`` with a word in its text.

    Two texts are linked if they share at least num/den of their distinct words;
    groups are the connected components.  Rows with the same word set form one
    class, ``links`` counts the other classes a class is linked to, and
    ``group_id`` is the class_id of one class of the group, the same for all.  Rows without a word
    (null, blank, signs only) are alike to nothing and left out.  Repeated rows
    come out each; an empty table gives no rows; other columns are ignored.
    Links are found exactly by anchor-point covering (``alike``).
    """
    worded = df.select(F.col(key), word_hashes(F.col(text)).alias("words"))
    sets = distinct_sets(worded, "words").withColumn("flag", F.lit(0).cast("byte"))
    pairs = stored(alike_pairs(sets.select("rid", "flag", "words"), num, den, cell), "alike-pairs")
    groups = components(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("rid")).groupBy("rid").agg(F.count(F.lit(1)).alias("links"))
    classes = sets.select("rid", "set_hash_1", "set_hash_2").join(groups, "rid", "left").join(degree, "rid", "left")
    hashed = worded.where(F.size("words") > 0).select(key, F.xxhash64("words").alias("set_hash_1"), F.xxhash64(F.lit(1), "words").alias("set_hash_2"))
    return hashed.join(classes, ["set_hash_1", "set_hash_2"]).select(
        key, F.col("rid").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("group", "rid").alias("group_id")
    )


def grouped_pairs(groups: DataFrame, key: str, first: str, second: str, block: int = 2048) -> DataFrame:
    """Every two different keys of one group, the smaller first.

    Members of a group are dealt into blocks of about ``block``, and every pair of
    blocks meets on a key of its own, so that no task has a whole large group.
    """
    member = groups.select("group_id", F.col(key))
    sizes = member.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("group_id", F.ceil(F.col("_n") / block).cast("int").alias("_b"))
    dealt = member.join(sizes, "group_id").select("group_id", key, F.pmod(F.xxhash64(key), F.col("_b")).cast("int").alias("_own"), F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_other"))
    one = dealt.select("group_id", F.col("_own").alias("_x"), F.col("_other").alias("_y"), F.col(key).alias(first))
    two = dealt.select("group_id", F.col("_other").alias("_x"), F.col("_own").alias("_y"), F.col(key).alias(second))
    return one.join(two, ["group_id", "_x", "_y"]).where(F.col(first) < F.col(second)).select(first, second)
