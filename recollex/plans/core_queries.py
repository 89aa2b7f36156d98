"""Queries over the memory store, with SQL that gives the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollex.functions import scores, text
from recollex.operators import dedup, evaluation, graph, maintenance, retrieval, store
from recollex.sources import text_files
from recollex.streaming import activity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Times are compared with this one, never with the clock.
AS_OF = "2026-01-01 00:00:00"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")

_AS_OF_US = "epoch_us(TIMESTAMP '2026-01-01 00:00:00')"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _live(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("obsolete", F.lit(False)))


# --- scans and filters -------------------------------------------------------


@query("SELECT id, project_id, lower(trim(kind)) AS kind, content FROM memories WHERE id = (SELECT min(id) FROM memories)")
def o01_point_lookup(spark, sf_dir):
    m = _t(spark, sf_dir, "memories")
    return m.join(m.agg(F.min("id").alias("id")), "id", "left_semi").select("id", "project_id", F.lower(F.trim("kind")).alias("kind"), "content")


@query("SELECT id, name, row_number() OVER (ORDER BY updated_at DESC, id) AS place FROM projects")
def o02_projects(spark, sf_dir):
    return _t(spark, sf_dir, "projects").select("id", "name", F.row_number().over(Window.orderBy(F.desc("updated_at"), "id")).cast("long").alias("place"))


@query("SELECT id, project_id FROM memories WHERE NOT coalesce(obsolete, false) ORDER BY created_at DESC, id LIMIT 50 OFFSET 50")
def o03_recent_page(spark, sf_dir):
    return _live(_t(spark, sf_dir, "memories")).orderBy(F.desc("created_at"), "id").offset(50).limit(50).select("id", "project_id")


@query("SELECT id, epoch_us(created_at) AS created_us FROM memories WHERE NOT coalesce(obsolete, false) AND lower(trim(kind)) = 'decision'")
def o05_by_kind(spark, sf_dir):
    return _live(_t(spark, sf_dir, "memories")).where(F.lower(F.trim("kind")) == "decision").select("id", F.unix_micros("created_at").alias("created_us"))


@query("SELECT id FROM memories WHERE pinned AND NOT coalesce(obsolete, false)")
def o06_pinned(spark, sf_dir):
    return _live(_t(spark, sf_dir, "memories")).where("pinned").select("id")


@query(f"SELECT id, access_count FROM memories WHERE NOT coalesce(obsolete, false) AND {_AS_OF_US} - epoch_us(created_at) > 7 * 86400000000 ORDER BY access_count NULLS FIRST, created_at, id LIMIT 5000")
def o08_old_memories(spark, sf_dir):
    """The first 5 000 candidates for fading: least read, then oldest."""
    old = _live(_t(spark, sf_dir, "memories")).where(F.unix_micros(_as_of()) - F.unix_micros("created_at") > 7 * 86_400_000_000)
    return old.orderBy("access_count", "created_at", "id").limit(5000).select("id", "access_count")


@query("SELECT id FROM memories WHERE list_has_all(coalesce(tags, []), ['cache'])")
def o44_tag_containment(spark, sf_dir):
    return _t(spark, sf_dir, "memories").where(store.has_all_tags(F.col("tags"), ["cache"])).select("id")


@query("SELECT id, substring(content, 1, 200) AS excerpt, round(CAST(confidence AS DOUBLE), 3) AS confidence FROM memories")
def o51_shaped_rows(spark, sf_dir):
    return _t(spark, sf_dir, "memories").select("id", F.substring("content", 1, 200).alias("excerpt"), F.round(F.col("confidence").cast("double"), 3).alias("confidence"))


@query("SELECT coalesce(version_of, id) AS root, id, coalesce(version, 1) AS version FROM memories")
def o176_version_chains(spark, sf_dir):
    return store.version_chains(_t(spark, sf_dir, "memories"))


@query("SELECT root, max(version) AS version, arg_max(id, (version, id)) AS id FROM (SELECT coalesce(version_of, id) AS root, id, coalesce(version, 1) AS version FROM memories) GROUP BY root")
def o176_latest_versions(spark, sf_dir):
    chains = store.version_chains(_t(spark, sf_dir, "memories"))
    return chains.groupBy("root").agg(F.max("version").alias("version"), F.max_by("id", F.struct("version", "id")).alias("id"))


@query("SELECT user_id, event_type, value, epoch_us(ts) AS ts_us FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def o28_latest_state(spark, sf_dir):
    log = _t(spark, sf_dir, "events").select("user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.struct("ts", "event_id").alias("seq"))
    return store.latest(log, "user_id", "seq").select("user_id", "event_type", "value", "ts_us")


@query(
    """SELECT project_id, session_id, row_number() OVER (PARTITION BY coalesce(project_id, '::global::') ORDER BY started, session_id) AS session_ordinal
       FROM (SELECT project_id, session_id, min(epoch_us(created_at)) AS started FROM memories WHERE session_id IS NOT NULL GROUP BY project_id, session_id)"""
)
def o128_session_ordinals(spark, sf_dir):
    s = _t(spark, sf_dir, "memories").where("session_id IS NOT NULL").groupBy("project_id", "session_id").agg(F.min(F.unix_micros("created_at")).alias("started"))
    return store.session_ordinals(s, "session_id", "project_id", "started").select("project_id", "session_id", F.col("session_ordinal").cast("long").alias("session_ordinal"))


# --- roll-ups ----------------------------------------------------------------


@query("SELECT count(*) AS memories, count(*) FILTER (NOT coalesce(obsolete, false)) AS live, count(DISTINCT project_id) AS projects, count(simhash) AS fingerprints FROM memories")
def o117_counts(spark, sf_dir):
    return _t(spark, sf_dir, "memories").agg(
        F.count(F.lit(1)).alias("memories"), F.count_if(~F.coalesce("obsolete", F.lit(False))).alias("live"), F.countDistinct("project_id").alias("projects"), F.count("simhash").alias("fingerprints")
    )


@query("SELECT coalesce(lower(trim(kind)), 'none') AS kind, count(*) AS n, round(avg(CAST(confidence AS DOUBLE)), 6) AS confidence FROM memories WHERE NOT coalesce(obsolete, false) GROUP BY 1")
def o119_by_kind(spark, sf_dir):
    return _live(_t(spark, sf_dir, "memories")).groupBy(F.coalesce(F.lower(F.trim("kind")), F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("confidence").cast("double")), 6).alias("confidence"))


@query("SELECT p.name, count(*) AS n FROM memories m JOIN projects p ON m.project_id = p.id WHERE NOT coalesce(m.obsolete, false) GROUP BY p.name")
def o120_by_project(spark, sf_dir):
    # Pre-aggregated, so the hot project is one row before the join.
    counted = _live(_t(spark, sf_dir, "memories")).groupBy("project_id").agg(F.count(F.lit(1)).alias("c"))
    projects = _t(spark, sf_dir, "projects").select(F.col("id").alias("project_id"), "name")
    return counted.join(projects, "project_id").groupBy("name").agg(F.sum("c").alias("n"))


@query("SELECT strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n FROM memories WHERE epoch_us(TIMESTAMP '2025-06-01 00:00:00') - epoch_us(created_at) BETWEEN 0 AND 7 * 86400000000 GROUP BY 1")
def o121_daily(spark, sf_dir):
    """Memories a day over the seven days before a given instant, the end of the data."""
    back = F.unix_micros(F.lit("2025-06-01 00:00:00").cast("timestamp")) - F.unix_micros("created_at")
    return _t(spark, sf_dir, "memories").where(back.between(0, 7 * 86_400_000_000)).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT project_id, max(epoch_us(last_accessed)) AS last_us, CAST(sum(coalesce(access_count, 0)) AS BIGINT) AS heat FROM memories GROUP BY project_id")
def o122_heat(spark, sf_dir):
    return _t(spark, sf_dir, "memories").groupBy("project_id").agg(F.max(F.unix_micros("last_accessed")).alias("last_us"), F.sum(F.coalesce("access_count", F.lit(0))).cast("long").alias("heat"))


@query("SELECT p.name, coalesce(lower(trim(m.kind)), 'none') AS kind, count(*) AS n FROM memories m JOIN projects p ON m.project_id = p.id GROUP BY ROLLUP(p.name, coalesce(lower(trim(m.kind)), 'none'))")
def o124_rollup(spark, sf_dir):
    m = _t(spark, sf_dir, "memories").select("project_id", F.coalesce(F.lower(F.trim("kind")), F.lit("none")).alias("kind")).groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("c"))
    joined = m.join(_t(spark, sf_dir, "projects").select(F.col("id").alias("project_id"), "name"), "project_id")
    return joined.rollup("name", "kind").agg(F.sum("c").alias("n"))


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS window_start_us, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def o158_activity_totals(spark, sf_dir):
    return activity.activity_totals(_t(spark, sf_dir, "events"), "1 hour").withColumn("value", F.round("value", 4))


@query("SELECT user_id, count(*) AS accesses, max(epoch_us(ts)) AS last_us FROM events GROUP BY user_id")
def o160_access_states(spark, sf_dir):
    return activity.access_states(_t(spark, sf_dir, "events"), "user_id").drop("strength")


# --- scores ------------------------------------------------------------------

_RETRIEVABILITY = f"""CASE WHEN last_accessed IS NULL OR greatest(0.0::DOUBLE, ({_AS_OF_US} - epoch_us(last_accessed)) / 86400000000.0::DOUBLE) < 0.001 THEN 1.0::DOUBLE
  ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, exp(-greatest(0.0::DOUBLE, ({_AS_OF_US} - epoch_us(last_accessed)) / 86400000000.0::DOUBLE) / (1.0::DOUBLE + CAST(storage_strength AS DOUBLE))))) END"""


@query(f"SELECT id, round({_RETRIEVABILITY}, 9) AS r, round(0.3 + 0.9 * {_RETRIEVABILITY}, 9) AS boost FROM memories")
def o78_decay(spark, sf_dir):
    r = scores.retrievability(F.col("last_accessed"), F.col("storage_strength").cast("double"), _as_of())
    return _t(spark, sf_dir, "memories").select("id", F.round(r, 9).alias("r"), F.round(scores.decay_boost(r), 9).alias("boost"))


@query(
    """SELECT id, round(list_reduce(list_prepend(CAST(storage_strength AS DOUBLE), list_transform(range(coalesce(access_count, 0)), lambda x: 0.0::DOUBLE)), lambda s, x: s + 0.5 / (1.0 + 0.5 * s)), 6) AS strength FROM memories"""
)
def o80_strength(spark, sf_dir):
    return _t(spark, sf_dir, "memories").select("id", F.round(scores.strength_after(F.col("storage_strength"), F.col("access_count")), 6).alias("strength"))


@query(
    """WITH w AS (SELECT id, unnest(list_filter(string_split_regex(lower(content), '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> '')) AS w FROM memories WHERE content IS NOT NULL),
       h AS (SELECT id, md5_number_lower(w) AS b, md5(w) AS m FROM w),
       v AS (SELECT id, CAST(concat('0x', m[15:16], m[13:14], m[11:12], m[9:10], m[7:8], m[5:6], m[3:4], m[1:2]) AS UBIGINT) AS b FROM h),
       c AS (SELECT id, i, 2 * sum((b >> i) & 1) > count(*) AS bit FROM v, range(64) r(i) GROUP BY id, i),
       s AS (SELECT id, sum(CASE WHEN bit THEN (CASE WHEN i = 63 THEN -9223372036854775808 ELSE (1::HUGEINT << CAST(i AS INTEGER)) END) ELSE 0 END) AS x FROM c GROUP BY id)
       SELECT m.id, CAST(coalesce(s.x, 0) AS BIGINT) AS simhash FROM memories m LEFT JOIN s ON m.id = s.id"""
)
def o81_simhash(spark, sf_dir):
    return dedup.with_simhash(_t(spark, sf_dir, "memories"), "id", "content")


@query(
    """WITH p AS (SELECT DISTINCT simhash AS b FROM memories WHERE simhash IS NOT NULL)
       SELECT x.b AS bits_a, y.b AS bits_b, CAST(bit_count(xor(x.b, y.b)) AS INTEGER) AS distance FROM p x JOIN p y ON x.b < y.b WHERE bit_count(xor(x.b, y.b)) <= 3"""
)
def o83_hamming_pairs(spark, sf_dir):
    return dedup.hamming_pairs(_t(spark, sf_dir, "memories"), "id", "simhash", 3)


# --- retrieval ---------------------------------------------------------------

_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@query(
    f"""SELECT q.vec_id AS query, e.vec_id, round({_COS.format(a='q.embedding', b='e.embedding')}, 6) AS cosine,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS.format(a='q.embedding', b='e.embedding')}, 9) DESC, e.vec_id) AS rank
        FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id QUALIFY rank <= 10"""
)
def o53_nearest(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    near = retrieval.nearest(q, "query", "v", e, "vec_id", "embedding", 10, skip_self=True)
    return near.select("query", "vec_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT x.vec_id AS a, y.vec_id AS b, round({_COS.format(a='x.embedding', b='y.embedding')}, 6) AS cosine FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE {_COS.format(a='x.embedding', b='y.embedding')} > 0.35")
def o56_similarity_graph(spark, sf_dir):
    return retrieval.similarity_pairs(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.35).withColumn("cosine", F.round("cosine", 6))


_TOKENS = "list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda x: length(x) > 1)"
_GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda x: x <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
_BM25 = f"""WITH d AS (SELECT id, {_TOKENS.format(c='content')} AS t FROM memories),
  i AS (SELECT w, id, count(*) AS tf, any_value(n) AS n FROM (SELECT id, len(t) AS n, unnest(t) AS w FROM d) GROUP BY w, id),
  s AS (SELECT count(*) AS docs, avg(len(coalesce(t, []))) AS avg_n FROM d),
  f AS (SELECT w, count(*) AS df FROM i GROUP BY w),
  q AS (SELECT question_id, w, count(*) AS times FROM (SELECT question_id, unnest({_TOKENS.format(c='question')}) AS w FROM lme_questions) GROUP BY question_id, w),
  x AS (SELECT question_id, id, sum(times * ln((docs - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg_n))) AS score
        FROM q JOIN f USING (w) JOIN i USING (w), s GROUP BY question_id, id),
  b AS (SELECT question_id, id, score, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 6) DESC, id) AS rank FROM x)"""


def _questions(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "lme_questions").select("question_id", "question")


@query(_BM25 + " SELECT question_id, id, round(score, 4) AS score, rank FROM b WHERE rank <= 30")
def o84_bm25(spark, sf_dir):
    m = _t(spark, sf_dir, "memories").select("id", "content")
    return retrieval.bm25(_questions(spark, sf_dir), "question_id", "question", m, "id", "content", 30).select("question_id", "id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


_TRI = f"""g AS (SELECT id, {_GRAMS.format(c='subject')} AS g FROM memories WHERE subject IS NOT NULL),
  h AS (SELECT question_id, {_GRAMS.format(c='question')} AS g FROM lme_questions),
  c AS (SELECT question_id, id, count(*) AS n FROM (SELECT question_id, unnest(g) AS t FROM h) JOIN (SELECT id, unnest(g) AS t FROM g) USING (t) GROUP BY question_id, id),
  y AS (SELECT question_id, id, n / (len(h.g) + len(g.g) - n) AS sim FROM c JOIN h USING (question_id) JOIN g USING (id)),
  z AS (SELECT question_id, id, sim, row_number() OVER (PARTITION BY question_id ORDER BY round(sim, 9) DESC, id) AS rank FROM y WHERE sim > 0.1)"""


@query("WITH " + _TRI + " SELECT question_id, id, round(sim, 6) AS similarity, rank FROM z WHERE rank <= 30")
def o64_trigram(spark, sf_dir):
    m = _t(spark, sf_dir, "memories").select("id", "subject")
    found = retrieval.trigram_matches(_questions(spark, sf_dir), "question_id", "question", m, "id", "subject", 0.1, 30)
    return found.select("question_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(
    """SELECT question_id, regexp_matches(question, '(?i)\\b(?:how\\s+many|how\\s+much|count(?:ed)?|total(?:\\s+number)?(?:\\s+of)?|number\\s+of|sum\\s+of|tally|aggregate|all\\s+(?:the\\s+)?(?:times?|instances?|occasions?|events?))\\b') AS counting,
       len(list_filter(regexp_extract_all(question, '[A-Za-z0-9_]+'), lambda x: regexp_full_match(x, '[A-Za-z]{3,}'))) AS words FROM lme_questions"""
)
def o70_intents(spark, sf_dir):
    words = F.filter(F.regexp_extract_all("question", F.lit("[A-Za-z0-9_]+"), 0), lambda w: w.rlike("^[A-Za-z]{3,}$"))
    return _questions(spark, sf_dir).select("question_id", text.is_counting(F.col("question")).alias("counting"), F.size(words).cast("long").alias("words"))


@query("SELECT id, coalesce(TRY_CAST(nullif(regexp_extract(content, '\\[Date:\\s*(\\d{4}-\\d{2}-\\d{2})\\]', 1), '') AS DATE), CAST(created_at AT TIME ZONE 'UTC' AS DATE))::VARCHAR AS day FROM memories")
def o171_memory_dates(spark, sf_dir):
    return _t(spark, sf_dir, "memories").select("id", text.memory_date(F.col("content"), F.col("tags"), F.col("created_at")).cast("string").alias("day"))


@query(
    """SELECT project_id, w AS term, count(*) AS df FROM (SELECT project_id, unnest(list_distinct(list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda x: length(x) >= 3))) AS w FROM memories)
       GROUP BY project_id, w QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY count(*) DESC, w) <= 8"""
)
def o173_frequent_terms(spark, sf_dir):
    words = F.explode(F.array_distinct(F.filter(F.split(F.lower("content"), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)))
    counted = _t(spark, sf_dir, "memories").select("project_id", words.alias("term")).groupBy("project_id", "term").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("project_id").orderBy(F.desc("df"), "term")
    return counted.withColumn("n", F.row_number().over(order)).where("n <= 8").drop("n")


# --- graph -------------------------------------------------------------------

_EDGES = """SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem"""


def _edges(spark, sf_dir) -> DataFrame:
    def link(table, a, x, b, y):
        return _t(spark, sf_dir, table).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))

    parts = [("nation", "n", "n_nationkey", "r", "n_regionkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("lineitem", "p", "l_partkey", "s", "l_suppkey")]
    edges = None
    for part in parts:
        edges = link(*part) if edges is None else edges.unionByName(link(*part))
    return edges.distinct()


@query(
    f"""WITH RECURSIVE e AS ({_EDGES}), x AS (SELECT DISTINCT src AS seed, src AS node, 0 AS depth FROM e
         UNION SELECT x.seed, e.dst, x.depth + 1 FROM x JOIN e ON e.src = x.node WHERE x.depth < 3)
       SELECT seed, node, min(depth) AS depth FROM x WHERE node <> seed GROUP BY seed, node"""
)
def o137_explore(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.explore(edges, edges.select(F.col("src").alias("seed")).distinct(), 3)


@query(f"WITH e AS ({_EDGES}) SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node")
def o123_degrees(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


# --- compaction --------------------------------------------------------------


@query(
    f"""SELECT id FROM memories WHERE NOT coalesce(obsolete, false) AND NOT coalesce(pinned, false) AND coalesce(lower(kind), '') NOT IN ('decision', 'procedure')
        AND {_AS_OF_US} - epoch_us(created_at) > 7 * 86400000000
        AND exp(-greatest(0.0::DOUBLE, ({_AS_OF_US} - epoch_us(coalesce(last_accessed, created_at))) / 86400000000.0::DOUBLE) / (1.0 + coalesce(CAST(storage_strength AS DOUBLE), 0.0))) < 0.05"""
)
def o144_fading(spark, sf_dir):
    return maintenance.fading(_t(spark, sf_dir, "memories"), _as_of()).select("id")


def _vectors(spark, sf_dir) -> DataFrame:
    """Vectors with the attributes that compaction needs; labels stand for kinds."""
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("vec_id") * 86_400_000_000)
    return _t(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label", at.alias("at"), ((F.col("vec_id") % 7) / 7.0).alias("confidence"))


@query()
def o145_clusters(spark, sf_dir):
    return maintenance.clusters(_vectors(spark, sf_dir), "vec_id", "embedding", "label", "at", least=0.35)


@query(
    f"""WITH p AS (SELECT n.vec_id AS newer, o.vec_id AS older, {_COS.format(a='n.embedding', b='o.embedding')} AS c FROM embeddings n JOIN embeddings o ON n.label = o.label AND n.vec_id - o.vec_id > 7)
        SELECT newer, older, round(c, 6) AS cosine, (newer % 7) / 7.0 >= (older % 7) / 7.0 AS obsolete_older FROM p WHERE c > 0.3
        QUALIFY row_number() OVER (PARTITION BY newer ORDER BY round(c, 9) DESC, older) = 1"""
)
def o148_conflicts(spark, sf_dir):
    found = maintenance.conflicts(_vectors(spark, sf_dir), "vec_id", "embedding", "label", "at", "confidence", least=0.3)
    return found.withColumn("cosine", F.round("cosine", 6))


@query()
def o146_merged_sessions(spark, sf_dir):
    m = _live(_t(spark, sf_dir, "memories")).where("session_id IS NOT NULL").withColumnRenamed("session_id", "cluster_id")
    return maintenance.merged(m.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))))


# --- ingestion ---------------------------------------------------------------


@query()
def o150_paragraph_chunks(spark, sf_dir):
    return text_files.paragraph_chunks(_t(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    """WITH s AS (SELECT unnest(haystack_session_ids) AS sid, unnest(haystack_sessions) AS m FROM lme_questions),
       t AS (SELECT sid, unnest(range(len(m))) AS pos, unnest(m) AS x FROM s WHERE m IS NOT NULL),
       u AS (SELECT sid, pos, lower(trim(x.role)) AS role, x.content AS content FROM t),
       l AS (SELECT *, lead(role) OVER w AS nr, lead(content) OVER w AS nc, lag(role) OVER w AS pr FROM u WINDOW w AS (PARTITION BY sid ORDER BY pos))
       SELECT sid AS thread, pos, CASE WHEN role = 'user' AND nr = 'assistant' THEN '[USER]: ' || content || chr(10) || '[ASSISTANT]: ' || nc
         WHEN role = 'user' THEN '[USER]: ' || content WHEN role = 'assistant' AND coalesce(pr, '') <> 'user' THEN '[ASSISTANT]: ' || content END AS exchange
       FROM l WHERE exchange IS NOT NULL"""
)
def o154_turn_pairs(spark, sf_dir):
    sessions = _t(spark, sf_dir, "lme_questions").select(F.explode(F.arrays_zip("haystack_session_ids", "haystack_sessions")).alias("s"))
    turns = sessions.select(F.col("s.haystack_session_ids").alias("thread"), F.posexplode("s.haystack_sessions").alias("pos", "m"))
    turns = turns.select("thread", F.col("pos").cast("long").alias("pos"), F.lower(F.trim("m.role")).alias("role"), F.col("m.content").alias("content"))
    return text_files.exchanges(turns, ["thread"], "pos", "role", "content")


# --- evaluation --------------------------------------------------------------


@query(
    """WITH r AS (SELECT query_id, memory_id, max(final_score) AS f, max(keyword_boost) AS k FROM rerank_results GROUP BY 1, 2),
       run AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY f DESC NULLS LAST, memory_id) AS rank FROM r),
       rel AS (SELECT query_id, memory_id FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC NULLS LAST, memory_id) <= 5),
       h AS (SELECT query_id, count(*) AS hits, sum(1.0 / log2(rank + 1)) AS dcg FROM run JOIN rel USING (query_id, memory_id) WHERE rank <= 10 GROUP BY query_id),
       n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id)
       SELECT query_id, round(coalesce(hits, 0) / n, 9) AS recall, round(coalesce(hits, 0) / 10.0, 9) AS precision,
         round(coalesce(dcg, 0) / (SELECT sum(1.0 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n), 9) AS ndcg, coalesce(hits, 0) > 0 AS any_hit, coalesce(hits, 0) >= least(n, 10) AS all_hit
       FROM n LEFT JOIN h USING (query_id)"""
)
def o162_metrics(spark, sf_dir):
    r = _t(spark, sf_dir, "rerank_results").groupBy("query_id", "memory_id").agg(F.max("final_score").alias("f"), F.max("keyword_boost").alias("k"))
    by = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(c).desc_nulls_last(), "memory_id"))
    run = r.select("query_id", "memory_id", by("f").alias("rank"))
    relevant = r.select("query_id", "memory_id", by("k").alias("n")).where("n <= 5").select("query_id", "memory_id", F.lit(1.0).alias("gain"))
    m = evaluation.ranking_metrics(run, relevant, "query_id", "memory_id", 10)
    return m.select("query_id", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "ndcg")], "any_hit", "all_hit")
