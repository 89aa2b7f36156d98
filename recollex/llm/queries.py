"""Registered queries of the operators in this folder, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.llm import history, leaks, near_duplicates, packing, ranking, reading, splitting, threads

SCORES = ("original_score", "keyword_boost", "final_score")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class, number of links and group of every memory with words."""
    return near_duplicates.near_duplicate_groups(_table(spark, sf_dir, "memories"), "id", "content")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of memories in one group."""
    return near_duplicates.grouped_pairs(p1_groups(spark, sf_dir), "id", "memory_id_a", "memory_id_b")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks not to be stored again."""
    return history.repeated_chunks(_table(spark, sf_dir, "import_chunks"), "chunk_id", "content", _table(spark, sf_dir, "memories"), "content")


def p3_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true ``chunks_deduplicated`` of each batch beside the reported one."""
    chunks, batches = _table(spark, sf_dir, "import_chunks"), _table(spark, sf_dir, "import_batches")
    counted = p3_found(spark, sf_dir).join(chunks.select("chunk_id", "batch_no"), "chunk_id").groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"))
    return batches.join(counted, "batch_no", "left").select("batch_no", F.col("chunks_deduplicated").alias("reported"), F.coalesce("n", F.lit(0)).alias("chunks_deduplicated"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that come out in more than one piece."""
    pieces = splitting.split_items(_table(spark, sf_dir, "import_chunks"), "chunk_id", "content", limit=800, overlap=100)
    return pieces.where("chunk_index = 0 AND n_pieces > 1").select("chunk_id")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_items(_table(spark, sf_dir, "import_chunks"), "chunk_id", "content", limit=800, overlap=100)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations to drop."""
    return threads.dropped_threads(_table(spark, sf_dir, "beam_turns"), _table(spark, sf_dir, "lme_questions"))


def p5_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = threads.turn_messages(_table(spark, sf_dir, "beam_turns")).unionByName(threads.session_messages(_table(spark, sf_dir, "lme_questions")))
    return threads.rebuilt_threads(messages)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate of each query that comes first."""
    fused = ranking.fuse_rankings(_table(spark, sf_dir, "rerank_results"), "query_id", "memory_id", SCORES)
    return ranking.best_candidate(fused, "query_id", "memory_id")


def p6_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.fuse_rankings(_table(spark, sf_dir, "rerank_results"), "query_id", "memory_id", SCORES)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text or piece."""
    return packing.pack_texts(_table(spark, sf_dir, "documents"), "doc_id", "text", capacity=2048)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that must be split."""
    return packing.split_documents(p7_containers(spark, sf_dir), "doc_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat passages of test items, and whether they hold the item's answer."""
    return leaks.leaked_items(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "eval_items"), "item_id", "text", "answer")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and leaked item."""
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and school grade of every document with prose."""
    return reading.reading_levels(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "reading_labels"), "grade")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents of grade 13 or above."""
    return reading.demanding_documents(p9_levels(spark, sf_dir), "doc_id")


_P6_RANKS = """
WITH c AS (SELECT query_id, memory_id, max(original_score) AS original_score, max(keyword_boost) AS keyword_boost, max(final_score) AS final_score
           FROM rerank_results GROUP BY query_id, memory_id),
     r AS (SELECT query_id, memory_id,
                  CAST(rank() OVER (PARTITION BY query_id ORDER BY original_score DESC NULLS LAST) AS INTEGER) AS rank_original_score,
                  CAST(rank() OVER (PARTITION BY query_id ORDER BY keyword_boost DESC NULLS LAST) AS INTEGER) AS rank_keyword_boost,
                  CAST(rank() OVER (PARTITION BY query_id ORDER BY final_score DESC NULLS LAST) AS INTEGER) AS rank_final_score
           FROM c)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p3_found": p3_found,
    "p3_batches": p3_batches,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_threads": p5_threads,
    "p6_found": p6_found,
    "p6_ranking": p6_ranking,
    "p7_found": p7_found,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_found": p9_found,
    "p9_levels": p9_levels,
}

# Brute force over word sets; groups by following links.
_WORD_SET = "list_sort(list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')))"
_P1_GROUPS = f"""
WITH RECURSIVE m AS (SELECT id, {_WORD_SET.format(c="content")} AS w FROM memories WHERE content IS NOT NULL),
  x AS (SELECT id, len(w) AS n, unnest(w) AS t FROM m),
  l AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.t = b.t AND a.id <> b.id AND 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n)
        GROUP BY a.id, b.id HAVING 17 * count(*) >= 7 * (any_value(a.n) + any_value(b.n))),
  r AS (SELECT DISTINCT a AS s, a AS e FROM l UNION SELECT r.s, l.b FROM r JOIN l ON l.a = r.e)
"""
_P5_MESSAGES = """
WITH raw AS (SELECT conversation_id AS thread_id, true AS numbered, id AS pos, role, content FROM beam_turns),
  s AS (SELECT unnest(haystack_session_ids) AS thread_id, unnest(haystack_sessions) AS m FROM lme_questions),
  nested AS (SELECT thread_id, false AS numbered, CAST(g AS BIGINT) AS pos, m[g].role AS role, m[g].content AS content FROM (SELECT thread_id, m, unnest(range(1, len(m) + 1)) AS g FROM s)),
  u AS (SELECT * FROM raw UNION ALL SELECT * FROM nested),
  c AS (SELECT thread_id, numbered, pos, content,
          CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'bot', 'model') THEN 'assistant' WHEN lower(trim(role)) = 'system' THEN 'system' END AS role,
          coalesce(regexp_matches(content, '[^\\s\\x{00a0}\\x{200b}-\\x{200d}\\x{2060}\\x{feff}]'), false) AS visible, lower(trim(role)) AS said FROM u),
  d AS (SELECT DISTINCT thread_id, numbered, pos, coalesce(role, said) AS said, role, content, visible FROM c),
  t AS (SELECT thread_id, bool_or(numbered) AND (max(pos) - min(pos) + 1 <> count(DISTINCT pos) OR count(*) <> count(DISTINCT pos))
          OR NOT bool_or(visible) OR bool_or(role IS NULL) OR NOT coalesce(bool_or(role = 'user'), false) AS bad FROM d GROUP BY thread_id),
  f AS (SELECT thread_id, role, lead(role) OVER w AS next_role, lead(visible) OVER w AS next_visible FROM d WHERE role IS DISTINCT FROM 'system' WINDOW w AS (PARTITION BY thread_id ORDER BY pos)),
  g AS (SELECT thread_id FROM f WHERE role = 'user' AND NOT coalesce(next_role = 'assistant' AND next_visible, false))
"""

# Chunk by chunk: what is accepted so far is carried along.
_P3_CASES = f"""
WITH RECURSIVE m AS (SELECT DISTINCT {_WORD_SET.format(c="content")} AS w FROM memories WHERE content IS NOT NULL),
  c AS (SELECT chunk_id, {_WORD_SET.format(c="content")} AS w, row_number() OVER (ORDER BY chunk_id) AS n FROM import_chunks WHERE content IS NOT NULL),
  mx AS (SELECT w, len(w) AS k, unnest(w) AS t FROM m),
  cx AS (SELECT chunk_id, len(w) AS k, unnest(w) AS t FROM c),
  old AS (SELECT DISTINCT chunk_id FROM (SELECT chunk_id, mx.w FROM cx JOIN mx ON cx.t = mx.t AND 10 * least(cx.k, mx.k) >= 7 * greatest(cx.k, mx.k)
          GROUP BY chunk_id, mx.w HAVING 17 * count(*) >= 7 * any_value(cx.k + mx.k))),
  l AS (SELECT a.chunk_id AS before, b.chunk_id AS after FROM cx a JOIN cx b ON a.t = b.t AND a.chunk_id < b.chunk_id AND 10 * least(a.k, b.k) >= 7 * greatest(a.k, b.k)
        GROUP BY a.chunk_id, b.chunk_id HAVING 17 * count(*) >= 7 * any_value(a.k + b.k)),
  g AS (SELECT after, list(before) AS befores FROM l GROUP BY after),
  todo AS MATERIALIZED (SELECT c.chunk_id, c.n, old.chunk_id IS NOT NULL AS known, coalesce(befores, []) AS befores
           FROM c LEFT JOIN old ON old.chunk_id = c.chunk_id LEFT JOIN g ON g.after = c.chunk_id),
  r AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS accepted, CAST(NULL AS BIGINT) AS chunk_id, false AS repeated
        UNION ALL
        SELECT todo.n, CASE WHEN todo.known OR list_has_any(todo.befores, r.accepted) THEN r.accepted ELSE list_append(r.accepted, todo.chunk_id) END,
               todo.chunk_id, todo.known OR list_has_any(todo.befores, r.accepted)
        FROM r JOIN todo ON todo.n = r.n + 1),
  cases AS (SELECT chunk_id FROM r WHERE repeated)
"""

ORACLES: dict[str, str] = {
    "p3_found": _P3_CASES + "SELECT chunk_id FROM cases",
    "p3_batches": _P3_CASES + """
SELECT b.batch_no, b.chunks_deduplicated AS reported, count(cases.chunk_id) AS chunks_deduplicated
FROM import_batches b LEFT JOIN import_chunks i ON i.batch_no = b.batch_no LEFT JOIN cases ON cases.chunk_id = i.chunk_id GROUP BY b.batch_no, b.chunks_deduplicated""",
    "p1_found": _P1_GROUPS + "SELECT DISTINCT s AS memory_id_a, e AS memory_id_b FROM r WHERE s < e",
    "p5_found": _P5_MESSAGES + """
SELECT thread_id FROM t WHERE bad UNION SELECT thread_id FROM g UNION SELECT thread_id FROM s WHERE m IS NULL OR len(m) = 0""",
    "p4_found": "SELECT chunk_id FROM import_chunks WHERE length(content) > 800",
    "p6_found": _P6_RANKS + """
SELECT query_id, memory_id FROM (
  SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id
    ORDER BY 1.0/(60+rank_original_score) + 1.0/(60+rank_keyword_boost) + 1.0/(60+rank_final_score) DESC, memory_id) AS n FROM r) WHERE n = 1""",
    "p6_ranking": _P6_RANKS + """
SELECT query_id, memory_id, rank_original_score, rank_keyword_boost, rank_final_score,
       0.0::DOUBLE + 1.0::DOUBLE/(60+rank_original_score) + 1.0::DOUBLE/(60+rank_keyword_boost) + 1.0::DOUBLE/(60+rank_final_score) AS rrf FROM r""",
}
