"""Queries of the recall pipeline: the whole of it, and each step over a fixed pool beside the same in SQL.

The fixed pool holds, for each question of a project, the newest thirty live
memories of that project.  Questions and memories get the wordings that the steps
look for (advice, recency, counting, relative days, exchanges, preferences), by
the length of their text, so that every step has something to do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollex.functions import features, text
from recollex.operators import context, fusion, recall, refine, timestamps
from recollex.plans.core_queries import _TOKENS, AS_OF, _as_of, _live, _t, o128_session_ordinals

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


_WORDINGS = ["{q}", "any tips?", "latest: {q}", "how many times: {q}", "{q} 10 days ago", "{q} last friday", "how many days ago? {q}", "what should I recommend"]
_PAIR = ("[USER]: ", "\n[ASSISTANT]: I prefer that. I always use it.")
_REFERENCE = "2025-05-20"


def _ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o128_session_ordinals(spark, sf_dir).groupBy("session_id").agg(F.max("session_ordinal").alias("ordinal"))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    worded = F.element_at(F.array(*[F.replace(F.lit(w), F.lit("{q}"), F.col("question")) for w in _WORDINGS]), F.length("question") % len(_WORDINGS) + 1)
    q = _t(spark, sf_dir, "lme_questions").select(F.col("question_id").alias("query"), worded.alias("question"), "project_id")
    size = F.length("content") % 4
    said = F.when(size == 0, F.concat(F.lit(_PAIR[0]), F.col("content"), F.lit(_PAIR[1]))).when(size == 1, F.concat(F.lit("I love "), F.col("content"))).otherwise(F.col("content"))
    newest = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created_at"), "id"))
    m = _live(_t(spark, sf_dir, "memories")).where("project_id IS NOT NULL").withColumn("pos", newest).where("pos <= 30")
    m = m.select("project_id", "id", "pos", said.alias("content"), "session_id", text.memory_date(F.col("content"), F.col("tags"), F.col("created_at")).alias("day"), "last_accessed", "storage_strength")
    pool = q.where("question IS NOT NULL").join(m, "project_id").join(_ordinals(spark, sf_dir), "session_id", "left").drop("project_id")
    reference = F.lit(_REFERENCE).cast("date")
    return pool.withColumns({"reference": reference, "target": text.target_date(F.col("question"), reference), "score": 1.0 / (60 + F.col("pos"))})


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _target(q: str, ref: str) -> str:
    n = lambda unit: f"TRY_CAST(nullif(regexp_extract(lower({q}), '(\\d{{1,6}})\\s+{unit}s?\\s+ago', 1), '') AS INTEGER)"
    day = f"nullif(regexp_extract(lower({q}), '\\blast\\s+({'|'.join(text.WEEKDAYS)})\\b', 1), '')"
    back = f"((isodow({ref}) - list_position({_list(list(text.WEEKDAYS))}, {day})) % 7 + 7) % 7"
    return f"""CAST({ref} - CAST(coalesce({n('day')}, CASE WHEN regexp_matches(lower({q}), '\\byesterday\\b') THEN 1 END, {n('week')} * 7, CASE WHEN regexp_matches(lower({q}), '\\blast\\s+week\\b') THEN 7 END,
      {n('month')} * 30, CASE WHEN regexp_matches(lower({q}), '\\blast\\s+month\\b') THEN 30 END, CASE WHEN {day} IS NOT NULL THEN CASE WHEN {back} = 0 THEN 7 ELSE {back} END END) AS INTEGER) AS DATE)"""


_DAY = "coalesce(TRY_CAST(nullif(regexp_extract(content, '\\[Date:\\s*(\\d{4}-\\d{2}-\\d{2})\\]', 1), '') AS DATE), CAST(created_at AT TIME ZONE 'UTC' AS DATE))"
_POOL = f"""WITH s AS (SELECT session_id, max(ordinal) AS ordinal FROM (SELECT session_id, row_number() OVER (PARTITION BY coalesce(project_id, '::global::') ORDER BY started, session_id) AS ordinal
    FROM (SELECT project_id, session_id, min(epoch_us(created_at)) AS started FROM memories WHERE session_id IS NOT NULL GROUP BY project_id, session_id)) GROUP BY session_id),
  n AS (SELECT project_id, id, session_id, last_accessed, storage_strength, {_DAY} AS day, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS pos,
    CASE length(content) % 4 WHEN 0 THEN '{_PAIR[0]}' || content || chr(10) || '{_PAIR[1][1:]}' WHEN 1 THEN 'I love ' || content ELSE content END AS content
    FROM memories WHERE NOT coalesce(obsolete, false) AND project_id IS NOT NULL QUALIFY pos <= 30),
  q AS (SELECT question_id AS query, project_id, replace(list_extract({_list(_WORDINGS)}, CAST(1 + length(question) % {len(_WORDINGS)} AS INTEGER)), '{{q}}', question) AS question FROM lme_questions WHERE question IS NOT NULL),
  pool AS (SELECT query, id, pos, question, content, n.session_id, s.ordinal, day, DATE '{_REFERENCE}' AS reference, {_target('question', f"DATE '{_REFERENCE}'")} AS target, last_accessed, storage_strength, 1.0::DOUBLE / (60 + pos) AS score
    FROM q JOIN n USING (project_id) LEFT JOIN s ON s.session_id = n.session_id)"""


def _rank(key: str, tie: str = "pos") -> str:
    return f"CAST(row_number() OVER (PARTITION BY query ORDER BY {key}, {tie}) AS INTEGER)"


def _in(wanted: str, body: str) -> str:
    return f"coalesce(len(list_filter({wanted}, lambda w: contains({body}, w))), 0)"


def _matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')"


_NAMES = f"list_distinct(list_filter(regexp_extract_all(question, '\\b([A-Z][a-z]+)\\b', 1), lambda w: NOT list_contains({_list(text.COMMON_CAPITALS)}, w)))"
_LOWER_NAMES = f"list_transform({_NAMES}, lambda w: lower(w))"
_NUMBERS = "list_distinct(regexp_extract_all(question, '\\b\\d+(?:[.,]\\d+)?\\b'))"
_ENTITY = _in(f"list_distinct(list_concat({_LOWER_NAMES}, {_NUMBERS}))", "lower(content)")
_IS_PAIR = "coalesce(regexp_matches(content, '(?i)\\[USER\\]:') AND regexp_matches(content, '(?i)\\[ASSISTANT\\]:'), false)"
_RERANK = "list_filter(string_split_regex(lower({c}), '[^a-z0-9_]+'), lambda w: length(w) > 1 AND NOT list_contains(" + _list(text.RERANK_STOP_WORDS) + ", w))"
_RUNS = "list_transform(range(1, greatest(1, len({w}) - {n} + 2)), lambda i: array_to_string(list_slice({w}, i, i + {n} - 1), ' '))"
_NOUNS = f"len(list_filter(regexp_extract_all(question, '\\b([a-zA-Z]{{3,}})\\b', 1), lambda w: NOT list_contains({_list(text.QUERY_STOP_WORDS)}, lower(w))))"
_VAGUE = f"CASE WHEN {_matches('question', text.FACTUAL)} THEN false WHEN {_matches('question', text.VAGUE)} THEN {_NOUNS} < 2 ELSE len(list_filter(string_split_regex(question, '\\s+'), lambda w: w <> '')) <= 4 AND {_NOUNS} < 1 END"
_RECENT = f"({_matches('question', text.RECENCY)} AND NOT {_matches('question', text.SPECIFIC_TIME)})"


def _scored(df: DataFrame) -> DataFrame:
    return df.select("query", "id", F.round("score", 9).alias("score"))


def _place(df: DataFrame, *keys: Column) -> DataFrame:
    return df.select("query", "id", F.row_number().over(Window.partitionBy("query").orderBy(*keys, "pos")).alias("place"))


_POOL_BM25 = f"""{_POOL}, d AS (SELECT query, id, pos, coalesce({_TOKENS.format(c='content')}, []) AS t, {_TOKENS.format(c='question')} AS w FROM pool),
  z AS (SELECT query, count(*) AS docs, avg(len(t)) AS mean FROM d GROUP BY query),
  x AS (SELECT query, id, pos, len(t) AS n, w, unnest(list_distinct(w)) AS term, t FROM d),
  y AS (SELECT query, id, pos, n, term, len(list_filter(w, lambda a: a = term)) AS times, len(list_filter(t, lambda a: a = term)) AS tf FROM x),
  f AS (SELECT query, term, count(*) FILTER (tf > 0) AS df FROM y GROUP BY query, term),
  b AS (SELECT query, id, sum(times * ln((docs - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / greatest(mean, 1e-9)))) FILTER (tf > 0) AS bm25 FROM y JOIN f USING (query, term) JOIN z USING (query) GROUP BY query, id)"""


@query(f"{_POOL_BM25} SELECT query, id, round(coalesce(bm25, 0.0), 6) AS bm25, {_rank('round(coalesce(bm25, 0.0), 9) DESC')} AS place FROM pool LEFT JOIN b USING (query, id)")
def o84_pool_bm25(spark, sf_dir):
    return recall.bm25_places(_pool(spark, sf_dir)).select("query", "id", F.round("bm25", 6).alias("bm25"), F.col("bm25_place").alias("place"))


@query(f"{_POOL} SELECT query, id, {_rank(f'{_ENTITY} DESC')} AS place FROM pool")
def o85_entity_ranks(spark, sf_dir):
    return _place(_pool(spark, sf_dir), context.entity_overlap(F.col("question"), F.col("content")).desc())


@query(f"{_POOL} SELECT query, id, {_rank('coalesce(abs(day - target), 36500)')} AS place FROM pool WHERE target IS NOT NULL")
def o86_date_ranks(spark, sf_dir):
    return _place(_pool(spark, sf_dir).where("target IS NOT NULL"), context.date_nearness(F.col("day"), F.col("target")).desc())


@query(f"{_POOL} SELECT query, id, {_rank('coalesce(ordinal, 0) DESC')} AS place FROM pool")
def o87_session_ranks(spark, sf_dir):
    return _place(_pool(spark, sf_dir), F.coalesce("ordinal", F.lit(0)).desc())


@query(f"{_POOL} SELECT query, id, {_rank(f'{_IS_PAIR} DESC')} AS place FROM pool")
def o88_exchange_ranks(spark, sf_dir):
    return _place(_pool(spark, sf_dir), text.is_exchange(F.col("content")).desc())


_WISH = "(?i)\\b(?:recommend|suggest|prefer|like|enjoy|want|looking|interested)\\b"
_KEYWORD = f"""CASE WHEN {_matches('question', text.FACTUAL)} THEN 0.75 WHEN {_matches('question', text.VAGUE)} AND {_NOUNS} < 2 THEN 0.75 * 0.3
  WHEN len(string_split_regex(question, '\\s+')) <= 12 AND {_matches('question', _WISH)} AND {_NOUNS} < 2 THEN 0.75 * 0.5 ELSE 0.75 END"""


@query(
    f"""{_POOL_BM25}, r AS (SELECT query, id, pos, question, target, {_rank('round(coalesce(bm25, 0.0), 9) DESC')} AS p_bm25, {_rank(f'{_ENTITY} DESC')} AS p_name,
          {_rank('coalesce(abs(day - target), 36500)')} AS p_day, {_rank(f'{_IS_PAIR} DESC')} AS p_pair FROM pool LEFT JOIN b USING (query, id))
        SELECT query, id, round(CASE WHEN pos <= 20 THEN 1.0 / (60 + pos) ELSE 0 END + CASE WHEN pos > 10 THEN {_KEYWORD} / (60 + 31 - pos) ELSE 0 END + 0.5 / (60 + p_bm25) + 0.3 / (60 + p_name)
          + CASE WHEN target IS NOT NULL THEN 0.6 / (60 + p_day) ELSE 0 END + 0.15 / (60 + p_pair), 9) AS score FROM r"""
)
def o90_rrf(spark, sf_dir):
    """Six ranked lists fused; those by vector and by words are fixed here: the first twenty of the pool, and the last twenty from the end."""
    pool = _pool(spark, sf_dir)
    by_vector, by_words = pool.where("pos <= 20").select("query", "id", F.col("pos").alias("rank")), pool.where("pos > 10").select("query", "id", (31 - F.col("pos")).alias("rank"))
    return _scored(recall.fused(pool, by_vector, by_words))


@query(f"{_POOL} SELECT query, id, round(score + 0.004 * {_in(_LOWER_NAMES, 'lower(content)')}, 9) AS score FROM pool")
def o91_name_boost(spark, sf_dir):
    return _scored(recall.name_boost(_pool(spark, sf_dir)))


_DAYS = f"greatest(0.0::DOUBLE, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_accessed)) / 86400000000.0::DOUBLE)"


@query(f"{_POOL} SELECT query, id, round(score * (0.3 + 0.9 * CASE WHEN last_accessed IS NULL OR {_DAYS} < 0.001 THEN 1.0 ELSE exp(-{_DAYS} / (1.0 + coalesce(CAST(storage_strength AS DOUBLE), 0.0))) END), 9) AS score FROM pool")
def o92_decayed(spark, sf_dir):
    return _scored(recall.decayed(_pool(spark, sf_dir), _as_of()))


@query(
    f"""{_POOL}, t AS (SELECT *, {_RERANK.format(c='question')} AS w, coalesce({_RERANK.format(c='content')}, []) AS c FROM pool),
        p AS (SELECT *, list_concat(CASE WHEN len(w) >= 2 THEN {_RUNS.format(w='w', n=2)} ELSE [] END, CASE WHEN len(w) >= 3 THEN {_RUNS.format(w='w', n=3)} ELSE [] END) AS runs FROM t)
        SELECT query, id, round(CASE WHEN len(w) = 0 THEN score ELSE least(1.0, score + 0.15 * coalesce(list_sum(list_transform(list_distinct(w), lambda a: least(2, len(list_filter(c, lambda b: b = a))))) / (2.0 * len(list_distinct(w))), 0)
          + 0.10 * coalesce({_in('runs', 'lower(content)')} / nullif(len(runs), 0)::DOUBLE, 0)) END, 9) AS score FROM p"""
)
def o93_keyword_rerank(spark, sf_dir):
    return _scored(fusion.keyword_rerank(_pool(spark, sf_dir), "question", "content"))


@query(
    f"""{_POOL}, r AS (SELECT *, {_rank('coalesce(ordinal, 0) DESC')} AS place, max(coalesce(ordinal, 0)) OVER (PARTITION BY query) AS top, bool_or(ordinal IS NOT NULL) OVER (PARTITION BY query) AS told FROM pool)
        SELECT query, id, round(score + CASE WHEN {_RECENT} AND told THEN 0.2 / (60 + place) + 0.015 * coalesce(coalesce(ordinal, 0)::DOUBLE / nullif(top, 0), 0) ELSE 0 END, 9) AS score FROM r"""
)
def o95_recent_first(spark, sf_dir):
    """The recency list (O-95) and the recency boost (O-96), for questions that want the latest."""
    return _scored(recall.recent_first(_pool(spark, sf_dir)))


_CONTEXT_STOP = _list(sorted({*features.PLAIN_WORDS, *text.QUERY_STOP_WORDS}))


@query(
    f"""{_POOL}, f AS (SELECT query, session_id, max(ordinal) AS o, min(pos) AS p, arg_min(content, pos) AS c FROM pool WHERE session_id IS NOT NULL GROUP BY query, session_id),
        l AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY coalesce(o, 0) DESC, p) AS n FROM f QUALIFY n <= 2),
        j AS (SELECT query, string_agg(c, ' ' ORDER BY n) AS t FROM l GROUP BY query HAVING query IN (SELECT query FROM pool WHERE ordinal IS NOT NULL)),
        k AS (SELECT query, list_filter(regexp_extract_all(t, '\\b([A-Z][a-z]+(?:[A-Z][a-z]+)+|[A-Z]{{2,}}|[a-zA-Z][\\w\\-]{{3,}})\\b', 1), lambda w: NOT list_contains({_CONTEXT_STOP}, lower(w))) AS w FROM j),
        e AS (SELECT query, list_slice(list_filter(list_transform(w, lambda x: lower(x)), lambda x, i: list_position(list_transform(w, lambda y: lower(y)), x) = i), 1, 5) AS names FROM k)
        SELECT query, id, round(score + CASE WHEN {_VAGUE} THEN 0.012 * {_in('names', 'lower(content)')} ELSE 0 END, 9) AS score FROM pool LEFT JOIN e USING (query)"""
)
def o97_context_boost(spark, sf_dir):
    return _scored(recall.in_context(_pool(spark, sf_dir)))


@query(
    f"""{_POOL}, r AS (SELECT *, {_rank('score DESC')} AS place FROM pool)
        SELECT query, id, round(score + CASE WHEN place <= 20 AND {_VAGUE} AND {_matches('question', refine.ADVICE)} THEN 0.015 * coalesce(len(regexp_extract_all(content, '{refine.LIKES}')), 0) ELSE 0 END, 9) AS score FROM r"""
)
def o99_preference_boost(spark, sf_dir):
    return _scored(recall.liked(_pool(spark, sf_dir)))


@query(
    f"""{_POOL}, r AS (SELECT *, {_rank('score DESC')} AS place FROM pool),
        d AS (SELECT query, day, count(*) AS n, min(place) AS p FROM r WHERE place <= 10 AND day IS NOT NULL AND {_matches('question', text.INTERVAL)} GROUP BY query, day),
        m AS (SELECT query, arg_max(day, (n, -p)) AS modal FROM d GROUP BY query),
        t AS (SELECT pool.*, coalesce(target, modal) AS meant FROM pool LEFT JOIN m USING (query)),
        g AS (SELECT *, 0.015 * exp(-0.5 * pow((day - meant) / CASE WHEN abs(reference - meant) > 25 THEN 30.0 ELSE 3.5 END, 2)) AS lift FROM t)
        SELECT query, id, round(score + CASE WHEN lift > 0.001 THEN lift ELSE 0 END, 9) AS score FROM g"""
)
def o100_temporal_boost(spark, sf_dir):
    return _scored(recall.near_in_time(_pool(spark, sf_dir), _as_of()))


@query(f"{_POOL}, r AS (SELECT *, {_rank('score DESC')} AS place FROM pool) SELECT query, id, round(score + CASE WHEN place <= 10 AND {_IS_PAIR} THEN 0.008 ELSE 0 END, 9) AS score FROM r")
def o101_exchange_boost(spark, sf_dir):
    return _scored(recall.pairs_first(_pool(spark, sf_dir)))


@query(f"{_POOL} SELECT query, id, {_rank('round(round(score, 2), 12) DESC, coalesce(ordinal, 0)', 'id DESC')} AS rank FROM pool")
def o102_final_order(spark, sf_dir):
    """The last sort, with scores rounded so that ties occur."""
    return recall.ordered(_pool(spark, sf_dir).withColumn("score", F.round("score", 2))).select("query", "id", "rank")


@query(
    f"""{_POOL}, w AS (SELECT *, CAST(pos AS INTEGER) AS rank, {_TOKENS.format(c='question')} AS t, coalesce({_TOKENS.format(c='content')}, []) AS c FROM pool),
        k AS (SELECT query, id, rank, score, {_in("list_distinct(CASE WHEN len(t) >= 2 THEN " + _RUNS.format(w="t", n=2) + " ELSE [] END)", "lower(content)")} AS a,
            round(len(list_intersect(list_distinct(t), list_distinct(c))) / greatest(len(list_distinct(t)), 1)::DOUBLE, 12) AS b, {_in(_NUMBERS, 'content')} AS n,
            CASE WHEN target IS NOT NULL THEN coalesce(-abs(day - target), -9999) ELSE coalesce(ordinal, 0) END AS r,
            max(score) FILTER (rank = 1) OVER (PARTITION BY query) - score > 0.005 AS far FROM w),
        g AS (SELECT *, max(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY rank ROWS UNBOUNDED PRECEDING) AS rest FROM k)
        SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY rest, CASE WHEN rest = 0 THEN a END DESC NULLS LAST, CASE WHEN rest = 0 THEN b END DESC NULLS LAST, CASE WHEN rest = 0 THEN n END DESC NULLS LAST,
          CASE WHEN rest = 0 THEN r END DESC NULLS LAST, rank) AS INTEGER) AS rank FROM g"""
)
def o104_near_ties(spark, sf_dir):
    return recall.untied(_pool(spark, sf_dir).withColumn("rank", F.col("pos"))).select("query", "id", "rank")


@query(
    f"""{_POOL}, f AS (SELECT *, coalesce(abs(day - target) <= 60, false) AS near FROM pool WHERE target IS NOT NULL), g AS (SELECT *, count(*) FILTER (near) OVER (PARTITION BY query) AS kept FROM f)
        SELECT query, id FROM g WHERE near OR kept < 3"""
)
def o105_date_filter(spark, sf_dir):
    pool = _pool(spark, sf_dir).where("target IS NOT NULL")
    return refine.date_filter(pool, "query", "day", F.col("target"), days=60, least=3).select("query", "id")


@query(
    f"""{_POOL}, l AS (SELECT query, id, pos, CASE WHEN length(content) > 1500 THEN substring(content, 1, 1497) || '…' ELSE content END AS line FROM pool WHERE content IS NOT NULL),
        r AS (SELECT *, 2000 - coalesce(sum(length(line) + 1) OVER (PARTITION BY query ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM l)
        SELECT query, id, CASE WHEN length(line) + 1 <= room THEN line ELSE substring(line, 1, CAST(room AS INTEGER) - 1) END AS line FROM r WHERE length(line) + 1 <= room OR room > 20"""
)
def o142_prompt_lines(spark, sf_dir):
    pool = _pool(spark, sf_dir).where("content IS NOT NULL")
    return context.within_budget(pool, "query", [F.asc("pos")], "content", 2000).select("query", "id", "line")


def _asked(spark, sf_dir) -> DataFrame:
    q = timestamps.normalise_timestamps(_t(spark, sf_dir, "lme_questions"), "question_date", "locale", "time_zone", "_us")
    return q.select(F.col("question_id").alias("query"), "question", "project_id", F.to_date(F.timestamp_micros("_us")).alias("reference"))


@query()
def o102_recall(spark, sf_dir):
    """The whole pipeline for every question: six lists, all steps in order, ten memories a question."""
    found = recall.recall(_asked(spark, sf_dir), _t(spark, sf_dir, "memories"), _ordinals(spark, sf_dir), _as_of())
    return found.select(F.col("query").alias("question_id"), "id", "rank", F.round("score", 9).alias("score"))


@query()
def o98_recall_with_feedback(spark, sf_dir):
    """Recall with the second search and the filter by day, which are off by default."""
    found = recall.recall(_asked(spark, sf_dir), _t(spark, sf_dir, "memories"), _ordinals(spark, sf_dir), _as_of(), recall.Settings(feedback=True, date_filter=True))
    return found.select(F.col("query").alias("question_id"), "id", "rank", F.round("score", 9).alias("score"))


@query()
def o106_access_effects(spark, sf_dir):
    """The state of every memory after the first five results of all questions were read."""
    found = recall.recall(_asked(spark, sf_dir), _t(spark, sf_dir, "memories"), _ordinals(spark, sf_dir), _as_of())
    return refine.access_effects(found, _t(spark, sf_dir, "memories"), "id", _as_of()).drop("last_accessed")
