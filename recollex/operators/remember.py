"""Storing a batch of memories: what repeats an older or earlier one is blocked, and conflicts are surfaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.functions.features import distinctive_words
from recollex.operators.dedup import hamming_pairs, nouns_diverge, with_simhash
from recollex.operators.retrieval import nearest
from recollex.runtime import drop_stored, stored


def remembered(batch: DataFrame, existing: DataFrame, key: str, content: str, order: str, most_bits: int = 3) -> DataFrame:
    """``(key, blocked_by, stored)`` for every row of a batch, taken in ``order`` (unique, rising).

    A row is blocked by an existing row, or by an earlier row of the batch that
    was stored itself, whose fingerprint lies within ``most_bits`` and whose
    distinctive words don't diverge; ``blocked_by`` is such a row.  Texts without
    tokens block nothing.  Rows of equal fingerprint and words are one class,
    whose first row decides (the others are blocked by it, or by what blocks it),
    so a crowd of copies makes no links; classes meet on bands.  Who was stored
    is settled in rounds over the few linked classes, each round for all whose
    earlier neighbours are settled.
    """
    side = lambda df, rank, old: with_simhash(df, key, content).join(df.select(key, F.col(content).alias("_c"), rank.alias("_at")), key).select(
        F.col(key).alias("k"), "simhash", distinctive_words(F.col("_c")).alias("w"), F.col("_at"), F.lit(old).alias("old")
    )
    all_rows = stored(side(batch, F.col(order).cast("long"), False).unionByName(side(existing, F.lit(-1).cast("long"), True)).where("simhash <> 0").withColumn("_words", F.xxhash64(F.array_sort("w"))), "remembered")
    first = all_rows.groupBy("simhash", "_words").agg(F.min(F.struct("_at", "k", "old")).alias("_f"), F.any_value("w").alias("w"))
    rows = stored(first.select("simhash", "_words", "w", F.col("_f._at").alias("_at"), F.col("_f.k").alias("k"), F.col("_f.old").alias("old")), "remember-classes")
    near = hamming_pairs(rows, "k", "simhash", most_bits).select("bits_a", "bits_b")
    same = rows.select("simhash").distinct().select(F.col("simhash").alias("bits_a"), F.col("simhash").alias("bits_b"))
    bits = near.unionByName(near.select(F.col("bits_b").alias("bits_a"), F.col("bits_a").alias("bits_b"))).unionByName(same)
    before = rows.drop("_words").withColumnsRenamed({"k": "kb", "simhash": "bits_b", "w": "wb", "_at": "tb", "old": "ob"})
    links = rows.where("NOT old").withColumnRenamed("simhash", "bits_a").join(bits, "bits_a").join(before, "bits_b")
    links = stored(links.where((F.col("tb") < F.col("_at")) & ~nouns_diverge(F.col("w"), F.col("wb"))).select("k", "kb", "ob"), "remember-links")
    # state: true stored, false blocked, null open
    state = stored(rows.where("NOT old").select("k").join(links.select("k").distinct().withColumn("linked", F.lit(True)), "k", "left").select("k", F.when(F.col("linked").isNull(), F.lit(True)).alias("kept"), F.lit(None).cast(dict(rows.dtypes)["k"]).alias("by")), "remember-state")
    while not state.where("kept IS NULL").isEmpty():
        told = links.join(state.select(F.col("k").alias("kb"), F.col("kept").alias("s")), "kb", "left").withColumn("s", F.when(F.col("ob"), F.lit(True)).otherwise(F.col("s")))
        seen = told.groupBy("k").agg(F.min(F.when(F.col("s"), F.col("kb"))).alias("blocker"), F.max(F.col("s").isNull()).alias("open"))
        settled = F.when(F.col("open"), F.lit(None).cast("boolean")).otherwise(F.col("blocker").isNull())
        after = stored(
            state.join(seen, "k", "left").select("k", F.coalesce("kept", settled).alias("kept"), F.when(F.col("kept").isNull() & ~F.col("open"), F.col("blocker")).otherwise(F.col("by")).alias("by")), "remember-state"
        )
        drop_stored(state)
        state = after
    fate = rows.join(state.select("k", "kept", "by"), "k", "left").select("simhash", "_words", F.col("k").alias("_first"), "by")
    judged = all_rows.where("NOT old").select("k", "simhash", "_words").join(fate, ["simhash", "_words"])
    blocked = judged.select(F.col("k").alias(key), F.when(F.col("k") == F.col("_first"), F.col("by")).otherwise(F.coalesce("by", "_first")).alias("blocked_by"))
    return batch.select(key).join(blocked, key, "left").select(key, "blocked_by", F.col("blocked_by").isNull().alias("stored"))


def semantic_repeats(batch: DataFrame, existing: DataFrame, key: str, content: str, vector: str, group: str = "project_id", least: float = 0.92, each: int = 3) -> DataFrame:
    """``(key, blocked_by, cosine)``: rows of a batch whose nearest existing rows, of their group, mean the same.

    Of the ``each`` nearest with a cosine of ``least`` or more the first counts
    whose distinctive words don't diverge.  Rows that supersede another (a column
    ``supersedes`` that isn't null) are never blocked; rows without a vector
    match nothing; a null group sees all.
    """
    asked = batch.where(F.col("supersedes").isNull()) if "supersedes" in batch.columns else batch
    asked = asked.select(F.col(key).alias("_k"), F.col(vector).alias("_q"), group, distinctive_words(F.col(content)).alias("_w"))
    near = nearest(asked, "_k", "_q", existing, key, vector, each, least=least, group=group)
    told = near.join(asked.select("_k", "_w"), "_k").join(existing.select(key, distinctive_words(F.col(content)).alias("_e")), key)
    same = told.where(~F.coalesce(nouns_diverge(F.col("_w"), F.col("_e")), F.lit(False)))
    first = same.groupBy("_k").agg(F.min(F.struct("rank", F.col(key).alias("by"), "cosine")).alias("_f"))
    return first.select(F.col("_k").alias(key), F.col("_f.by").alias("blocked_by"), F.col("_f.cosine").alias("cosine"))


def surfaced_conflicts(batch: DataFrame, existing: DataFrame, key: str, vector: str, kinds: tuple[str, ...] = ("fact", "decision"), least: float = 0.80, each: int = 3) -> DataFrame:
    """``(key, conflicts)``: for new rows of some kinds the (cosine, id) of the nearest existing rows of that kind, best first.

    Rows of a project see that project, rows of none see all; rows that supersede
    another surface nothing.
    """
    kind = F.lower(F.trim("kind"))
    asked = batch.where(kind.isin(*kinds) & F.col("supersedes").isNull()).select(F.col(key).alias("_k"), F.col(vector).alias("_q"), "project_id", kind.alias("_kind"))
    rows = existing.where(kind.isin(*kinds)).select(key, vector, "project_id", kind.alias("_kind"))
    both = F.concat_ws("\x1f", "project_id", "_kind")
    own = nearest(asked.where("project_id IS NOT NULL").withColumn("_both", both), "_k", "_q", rows.where("project_id IS NOT NULL").withColumn("_both", both), key, vector, each, least=least, group="_both")
    all_ = nearest(asked.where("project_id IS NULL"), "_k", "_q", rows, key, vector, each, least=least, group="_kind")
    met = own.unionByName(all_)
    return met.groupBy(F.col("_k").alias(key)).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "cosine", F.col(key).alias("id")))), lambda x: F.struct(x["cosine"].alias("cosine"), x["id"].alias("id"))).alias("conflicts"))
