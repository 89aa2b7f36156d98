"""The recall of memories for questions: ranked lists, their fusion, and every step of re-scoring in its order.

All questions are answered together.  ``candidates`` gives each question a
bounded pool; every later step is a function from pool to pool and a window over
one question's rows, so a pool is shuffled once.  A pool has the columns

``query, id, pos, question, content, session_id, ordinal, day, reference, target,
last_accessed, storage_strength, score``

where ``pos`` is the place in the pool (from 1), ``day`` the day a memory speaks
of, ``reference`` the day of the question (null if unknown) and ``target`` the
day that the question means, counted from it.  Ties keep the order of the pool.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from recollex.functions import scores, text
from recollex.functions.features import date_terms, hashing_embedder, preference_terms
from recollex.operators import context, fulltext, fusion, refine, retrieval
from recollex.runtime import stored, whole_groups

@dataclass(frozen=True)
class Settings:
    """Weights of the ranked lists and switches of the steps."""

    limit: int = 10
    vector: float = 1.0
    keyword: float = 0.75
    bm25: float = 0.5
    entity: float = 0.3
    date: float = 0.6
    recency: float = 0.2
    turn_pair: float = 0.15
    feedback: bool = False
    date_filter: bool = False

    @property
    def fetch(self) -> int:
        return max(3 * self.limit, 30)


def memory_vectors(memories: DataFrame, keep: list[str]) -> DataFrame:
    """The text vectors of a store: subject first, content last, dates and preferences of the content to be found by at full weight."""
    named = memories.withColumns({"_dates": date_terms(F.col("content")), "_wishes": preference_terms(F.col("content"))})
    return fulltext.text_vectors(named, keep, {"subject": "A", "content": "D"}, {"_dates": "A", "_wishes": "A"})


def word_lists(questions: DataFrame, memories: DataFrame, fetch: int, vectors: DataFrame | None = None) -> DataFrame:
    """``(query, id, rank)`` by full text, best weight first, then confidence, then newest; by trigrams of the content for questions that match nothing.

    ``questions`` is (query, question, project_id), a null project sees all;
    ``memories`` are live ones.
    """
    vectors = vectors if vectors is not None else stored(memory_vectors(memories, ["id", "project_id", "confidence", "created_at"]), "text-vectors")
    order = [F.col("confidence").desc_nulls_last(), F.col("created_at").desc_nulls_last()]
    found = stored(fulltext.search(questions, "query", "question", vectors, "id", fetch, order, "project_id").select("query", "id", "rank"), "word-list")
    rest = questions.join(found.select("query").distinct(), "query", "left_anti")
    alike = retrieval.trigram_matches(rest, "query", "question", memories, "id", "content", 0.1, fetch, "project_id").select("query", "id", "rank")
    return found.unionByName(alike)


def vector_lists(questions: DataFrame, memories: DataFrame, fetch: int, embed=None) -> DataFrame:
    """``(query, id, rank)`` by cosine of embeddings; ``memories`` may have a column ``embedding``, else contents are embedded."""
    embed = embed or hashing_embedder()
    rows = memories if "embedding" in memories.columns else memories.withColumn("embedding", embed(F.col("content")))
    asked = questions.withColumn("_v", embed(F.col("question")))
    return retrieval.nearest(asked, "query", "_v", rows, "id", "embedding", fetch, group="project_id").select("query", "id", "rank")


def candidates(by_vector: DataFrame, by_words: DataFrame, questions: DataFrame, memories: DataFrame, ordinals: DataFrame) -> DataFrame:
    """The pool: rows of both lists, each once, those by vector first; scores are 0.

    ``questions`` is (query, question, reference), ``memories`` has the columns of
    a pool and tags and created_at, ``ordinals`` is (session_id, ordinal).  The
    ranks in the lists stay as ``_v`` and ``_f`` until ``fused`` takes them.
    """
    both = by_vector.select("query", "id", F.col("rank").alias("v"), F.lit(None).cast("int").alias("w")).unionByName(by_words.select("query", "id", F.lit(None).cast("int").alias("v"), F.col("rank").alias("w")))
    once = both.groupBy("query", "id").agg(F.min("v").alias("v"), F.min("w").alias("w"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("v").asc_nulls_last(), "w"))
    placed = once.select("query", "id", place.alias("pos"), F.col("v").alias("_v"), F.col("w").alias("_f"))
    known = memories.select("id", "content", "session_id", text.memory_date(F.col("content"), F.col("tags"), F.col("created_at")).alias("day"), "last_accessed", "storage_strength")
    pool = placed.join(questions.select("query", "question", "reference"), "query").join(known, "id").join(ordinals, "session_id", "left")
    return pool.withColumns({"target": text.target_date(F.col("question"), F.col("reference")), "score": F.lit(0.0)})


def _by_query() -> Window:
    return Window.partitionBy("query")


def _place(*keys: Column) -> Column:
    return F.row_number().over(_by_query().orderBy(*keys, "pos"))


def bm25_places(pool: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Adds ``bm25``, the score with statistics of the pool alone, and ``bm25_place``; repeated words of a question count as often as they occur."""
    kind = StructType([*pool.schema.fields, StructField("bm25", DoubleType())])

    def judge(pools: pa.Table) -> pa.Table:
        values, held = np.zeros(pools.num_rows), [_words(t) for t in pools.column("content").to_pylist()]
        keys, questions = pools.column("query").to_pylist(), pools.column("question").to_pylist()
        edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for low, high in zip(edges, edges[1:], strict=False):
            own, asked = held[low:high], Counter(_words(questions[low]))
            size = np.array([len(t) for t in own], np.float64)
            flat = k1 * (1 - b + b * size / max(size.mean(), 1e-9))
            for word, times in asked.items():
                tf = np.array([t.count(word) for t in own], np.float64)
                df = np.count_nonzero(tf)
                if df:
                    values[low:high] += times * np.log((len(own) - df + 0.5) / (df + 0.5) + 1.0) * tf * (k1 + 1) / (tf + flat)
        return pools.append_column("bm25", pa.array(values))

    return whole_groups(pool, "query", judge, kind).withColumn("bm25_place", _place(F.round("bm25", 9).desc()))


def _words(of: str | None) -> list[str]:
    """``text.rank_tokens`` in Python."""
    return [w for w in re.split("[^a-z0-9]+", of.lower()) if len(w) > 1] if of else []


def fused(pool: DataFrame, by_vector: DataFrame | None = None, by_words: DataFrame | None = None, s: Settings = Settings()) -> DataFrame:
    """The score: weight / (60 + place) over vectors, full text, BM25, names, dates (where the question means one) and exchanges; without lists, the pool has their ranks as ``_v`` and ``_f``."""
    weighted = pool
    if by_vector is not None:
        weighted = weighted.join(by_vector.select("query", "id", F.col("rank").alias("_v")), ["query", "id"], "left").join(by_words.select("query", "id", F.col("rank").alias("_f")), ["query", "id"], "left")
    weighted = bm25_places(weighted)
    by_name = _place(context.entity_overlap(F.col("question"), F.col("content")).desc())
    by_day = _place(context.date_nearness(F.col("day"), F.col("target")).desc())
    by_pair = _place(text.is_exchange(F.col("content")).desc())
    part = lambda weight, place: F.coalesce(weight / (60 + place), F.lit(0.0))
    total = (
        part(F.lit(s.vector), F.col("_v")) + part(text.keyword_weight(F.col("question"), s.keyword), F.col("_f")) + part(F.lit(s.bm25), F.col("bm25_place"))
        + part(F.lit(s.entity), by_name) + F.when(F.col("target").isNotNull(), part(F.lit(s.date), by_day)).otherwise(0.0) + part(F.lit(s.turn_pair), by_pair)
    )
    return weighted.withColumn("score", total).drop("_v", "_f", "bm25", "bm25_place")


def name_boost(pool: DataFrame, boost: float = 0.004) -> DataFrame:
    """Lifts memories by the question's names that they hold."""
    names = F.transform(text.proper_nouns(F.col("question")), lambda w: F.lower(w))
    return pool.withColumn("score", F.col("score") + boost * text.how_many_in(names, F.lower(F.col("content"))))


def decayed(pool: DataFrame, as_of: Column) -> DataFrame:
    """Scores times what use and time leave of a memory."""
    r = scores.retrievability(F.col("last_accessed"), F.coalesce("storage_strength", F.lit(0.0)).cast("double"), as_of)
    return pool.withColumn("score", F.col("score") * scores.decay_boost(r))


def recent_first(pool: DataFrame, s: Settings = Settings(), boost: float = 0.015) -> DataFrame:
    """For questions that want the latest: one more ranked list, by session, and a lift in proportion to the session's number."""
    wanted = F.coalesce(text.wants_recent(F.col("question")), F.lit(False)) & (F.max(F.col("ordinal").isNotNull()).over(_by_query()))
    number = F.coalesce("ordinal", F.lit(0))
    share = F.coalesce(F.try_divide(number.cast("double"), F.max(number).over(_by_query()).cast("double")), F.lit(0.0))
    return pool.withColumn("score", F.col("score") + F.when(wanted, s.recency / (60 + _place(number.desc())) + boost * share).otherwise(0.0))


def in_context(pool: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """For vague questions, lifts what speaks of the things that the latest sessions of the pool are about; ``base``, the pool before its scores, spares making them again."""
    vague = (pool if base is None else base).where(text.is_vague(F.col("question")))
    told = vague.where("ordinal IS NOT NULL").select("query").distinct()
    names = refine.context_entities(vague, "query", "session_id", "ordinal", "content", "pos").join(told, "query", "left_semi")
    return refine.context_boost(pool, names, "query", "question", "content")


def liked(pool: DataFrame) -> DataFrame:
    """Lifts first-person preferences for vague questions that ask for advice."""
    return refine.preference_boost(pool, "query", "question", "content", [F.col("score").desc(), F.col("pos")])


def near_in_time(pool: DataFrame, as_of: Column) -> DataFrame:
    """Lifts memories near the day a question means; for 'how long ago' the most frequent day among the first ten (the best placed of equals)."""
    latest = F.coalesce("reference", F.max("day").over(_by_query()), F.to_date(as_of))
    top = F.row_number().over(_by_query().orderBy(F.col("score").desc(), "pos"))
    placed = pool.withColumns({"_ref": latest, "_top": top})
    counts = (F.col("_top") <= 10) & F.col("day").isNotNull() & F.coalesce(text.asks_interval(F.col("question")), F.lit(False))
    same = Window.partitionBy("query", "day")
    placed = placed.withColumn("_t", F.when(counts, F.col("_top")))
    often = F.when(F.col("_t").isNotNull(), F.struct(F.count("_t").over(same).alias("n"), (-F.min("_t").over(same)).alias("t")))
    modal = F.max_by("day", "_often").over(_by_query())
    meant = placed.withColumn("_often", often).withColumn("_modal", modal).withColumn("_target", F.coalesce(text.target_date(F.col("question"), F.col("_ref")), "_modal"))
    return fusion.temporal_boost(meant, "day", F.col("_target"), F.col("_ref")).drop("_ref", "_top", "_t", "_often", "_modal", "_target")


def pairs_first(pool: DataFrame) -> DataFrame:
    """Lifts complete exchanges among the first ten."""
    return fusion.turn_pair_boost(pool, "query", "content", [F.col("score").desc(), F.col("pos")])


def ordered(pool: DataFrame) -> DataFrame:
    """Adds ``rank``: by score, the earlier session first among equals (none counts as the first), then the greater id."""
    order = _by_query().orderBy(F.round("score", 12).desc(), F.coalesce("ordinal", F.lit(0)).asc(), F.col("id").desc())
    return pool.withColumn("rank", F.row_number().over(order))


def spread(ranked: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Diversity of sessions and words for questions that don't count things; those keep all their rows."""
    chosen = fusion.diversify(ranked.withColumn("_counts", text.is_counting(F.col("question"))), "query", "id", "content", "session_id", s.limit, rank="rank", whole="_counts")
    return ranked.drop("rank", "score").join(chosen, ["query", "id"])


def untied(ranked: DataFrame, eps: float = 0.005) -> DataFrame:
    """Orders the leading near ties by the question's word pairs, share of words and numbers, then by nearness in time or by session."""
    words, body = text.rank_tokens(F.col("question")), F.lower(F.col("content"))
    own = F.array_distinct(F.coalesce(text.rank_tokens(F.col("content")), F.array().cast("array<string>")))
    asked = F.array_distinct(words)
    keys = [
        text.how_many_in(F.array_distinct(text.word_runs(words, 2)), body),
        F.round(F.size(F.array_intersect(asked, own)) / F.greatest(F.size(asked), F.lit(1)), 12),
        text.how_many_in(text.numbers_in(F.col("question")), F.col("content")),
        F.when(F.col("target").isNotNull(), F.coalesce(-F.abs(F.datediff("day", "target")), F.lit(-9999))).otherwise(F.coalesce("ordinal", F.lit(0))),
    ]
    return fusion.near_tie_reorder(ranked, "query", "rank", keys, eps)


def recall(questions: DataFrame, memories: DataFrame, ordinals: DataFrame, as_of: Column, s: Settings = Settings(), embed=None) -> DataFrame:
    """``(query, id, rank, score)``: the ``limit`` best memories of every question.

    ``questions`` is (query, question, project_id, reference); ``memories`` is a
    store, obsolete rows are left out; ``ordinals`` is (session_id, ordinal).  Null
    questions get nothing, questions of a project see that project's memories,
    repeated questions must differ in their key.  Steps that are off by default:
    a second full-text search with words of the first results, for vague
    questions (``feedback``), and the filter by day (``date_filter``), which here
    comes before diversity, where it can still take effect.
    """
    live = memories.where(~F.coalesce("obsolete", F.lit(False)))
    asked = questions.where(F.col("question").isNotNull())
    by_vector = stored(vector_lists(asked, live, s.fetch, embed), "vector-list")
    vectors = stored(memory_vectors(live, ["id", "project_id", "confidence", "created_at"]), "text-vectors")
    by_words = stored(word_lists(asked, live, s.fetch, vectors), "word-lists")
    base = stored(candidates(by_vector, by_words, asked, live, ordinals), "pool")
    pool = decayed(name_boost(fused(base, s=s)), as_of)
    pool = in_context(recent_first(fusion.keyword_rerank(pool, "question", "content"), s), base)
    if s.feedback:
        pool = with_feedback(stored(pool, "pool"), asked, live, vectors, ordinals, s)
    pool = ordered(pairs_first(near_in_time(liked(pool), as_of)))
    if s.date_filter:
        near = refine.date_filter(pool.where("target IS NOT NULL"), "query", "day", F.col("target"), least=s.limit).drop("rank")
        pool = ordered(near.unionByName(pool.where("target IS NULL").drop("rank")))
    return untied(spread(stored(pool, "ranked-pool"), s)).where(F.col("rank") <= s.limit).select("query", "id", "rank", "score")


def with_feedback(pool: DataFrame, questions: DataFrame, live: DataFrame, vectors: DataFrame, ordinals: DataFrame, s: Settings, weight: float = 0.3) -> DataFrame:
    """The pool of vague questions widened by what the frequent words of its first five rows find, any of them."""
    top = pool.where(text.is_vague(F.col("question"))).withColumn("rank", F.row_number().over(_by_query().orderBy(F.col("score").desc(), "pos")))
    terms = refine.feedback_terms(top, "query", "content")
    wider = questions.join(terms.where(F.size("terms") > 0), "query").withColumn("question", F.concat_ws(" or ", "question", F.array_join("terms", " or ")))
    found = stored(fulltext.search(wider, "query", "question", vectors, "id", s.fetch, [F.col("confidence").desc_nulls_last(), F.col("created_at").desc_nulls_last()], "project_id"), "feedback-list")
    more = found.select("query", "id", (weight / (60 + F.col("rank"))).alias("_more"))
    lifted = pool.join(more, ["query", "id"], "left").withColumn("score", F.col("score") + F.coalesce("_more", F.lit(0.0))).drop("_more")
    fresh = found.join(pool.select("query", "id"), ["query", "id"], "left_anti").select("query", "id", "rank")
    new = candidates(fresh, fresh, questions, live, ordinals).join(more, ["query", "id"]).withColumn("score", F.col("_more")).withColumn("pos", F.col("pos") + 2 * s.fetch).drop("_more")
    return lifted.unionByName(new.select(*lifted.columns))
