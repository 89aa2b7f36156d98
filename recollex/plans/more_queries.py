"""Further queries of the core: full text, features, rankers, sessions, entities, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollex.functions import features
from recollex.operators import context, fulltext, graph, refine, remember, retrieval, store
from recollex.plans.core_queries import _COS, _EDGES, _edges, _t

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query("SELECT id FROM memories WHERE content IS NOT NULL AND simhash IS NULL AND NOT coalesce(obsolete, false)")
def o07_backfill_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "memories").where("content IS NOT NULL AND simhash IS NULL AND NOT coalesce(obsolete, false)").select("id")


@query("SELECT project_id, arg_max(session_id, (created_at, id)) AS session_id, epoch_us(max(created_at)) AS at_us FROM memories WHERE session_id IS NOT NULL GROUP BY project_id")
def o10_last_session(spark, sf_dir):
    m = _t(spark, sf_dir, "memories").where("session_id IS NOT NULL")
    return m.groupBy("project_id").agg(F.max_by("session_id", F.struct("created_at", "id")).alias("session_id"), F.max(F.unix_micros("created_at")).alias("at_us"))


@query("SELECT count(*) AS n, count(*) FILTER (supersedes IN (SELECT id FROM memories)) AS known FROM memories WHERE supersedes IS NOT NULL")
def o25_superseded(spark, sf_dir):
    m = _t(spark, sf_dir, "memories")
    s = m.where("supersedes IS NOT NULL").select("supersedes")
    told = s.join(m.select(F.col("id").alias("supersedes"), F.lit(True).alias("there")), "supersedes", "left")
    return told.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("there", F.lit(False))).alias("known"))


@query("SELECT id FROM memories WHERE id NOT IN (SELECT supersedes FROM memories WHERE supersedes IS NOT NULL) AND NOT coalesce(obsolete, false)")
def o30_without_superseded(spark, sf_dir):
    m = _t(spark, sf_dir, "memories")
    return m.where(~F.coalesce("obsolete", F.lit(False))).select("id").join(m.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("id")), "id", "left_anti")


@query("SELECT a.project_id, a.kind FROM (SELECT DISTINCT project_id, lower(trim(kind)) AS kind FROM memories) a JOIN (SELECT DISTINCT project_id, lower(trim(kind)) AS kind FROM import_chunks) b ON a.project_id IS NOT DISTINCT FROM b.project_id AND a.kind IS NOT DISTINCT FROM b.kind")
def o46_null_safe_join(spark, sf_dir):
    a, b = (_t(spark, sf_dir, t).select("project_id", F.lower(F.trim("kind")).alias("kind")).distinct() for t in ("memories", "import_chunks"))
    b = b.withColumnsRenamed({"project_id": "p", "kind": "k"})
    return a.join(b, F.col("project_id").eqNullSafe(F.col("p")) & F.col("kind").eqNullSafe(F.col("k")), "left_semi")


@query(f"SELECT q.vec_id AS query, e.vec_id, round({_COS.format(a='q.embedding', b='e.embedding')}, 6) AS cosine FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id WHERE cosine >= 0.3 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS.format(a='q.embedding', b='e.embedding')}, 9) DESC, e.vec_id) <= 3")
def o54_semantic_duplicates(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    near = retrieval.nearest(q, "query", "v", e, "vec_id", "embedding", 3, least=0.3, skip_self=True)
    return near.select("query", "vec_id", F.round("cosine", 6).alias("cosine")).where("cosine >= 0.3")


@query()
def o58_embedded_memories(spark, sf_dir):
    return _t(spark, sf_dir, "memories").select("id", features.hashing_embedder()(F.col("content")).alias("embedding"))


_WORDS = "list_distinct(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda x: x <> ''))"


@query(
    f"""WITH q AS (SELECT DISTINCT subject AS q, {_WORDS.format(c='subject')} AS w FROM memories WHERE subject IS NOT NULL AND len({_WORDS.format(c='subject')}) > 0),
        m AS (SELECT id, {_WORDS.format(c="coalesce(subject, '')")} AS s, {_WORDS.format(c="coalesce(content, '')")} AS c FROM memories),
        x AS (SELECT q, id, list_sum(list_transform(w, lambda t: CASE WHEN list_contains(s, t) THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END)) AS score FROM q JOIN m ON list_has_all(list_concat(s, c), w))
        SELECT q, id, round(score, 6) AS score FROM x QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) <= 20"""
)
def o63_fulltext(spark, sf_dir):
    m = _t(spark, sf_dir, "memories").select("id", "subject", "content")
    q = m.where("subject IS NOT NULL").select(F.col("subject").alias("q")).distinct().withColumn("words", F.col("q"))
    vectors = fulltext.text_vectors(m, ["id"], {"subject": "A", "content": "D"}, stemmed=False)
    found = fulltext.search(q, "q", "words", vectors, "id", 20, stemmed=False)
    return found.select("q", "id", F.round("score", 6).alias("score"))


@query()
def o65_date_terms(spark, sf_dir):
    return _t(spark, sf_dir, "memories").select("id", features.date_terms(F.col("content")).alias("terms"))


@query("SELECT project_id, max(n) AS n, arg_max(kind, (n, kind)) AS kind FROM (SELECT project_id, lower(trim(kind)) AS kind, count(*) AS n FROM memories WHERE kind IS NOT NULL GROUP BY 1, 2) GROUP BY project_id")
def o126_main_kind(spark, sf_dir):
    n = _t(spark, sf_dir, "memories").where("kind IS NOT NULL").groupBy("project_id", F.lower(F.trim("kind")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("project_id").agg(F.max("n").alias("n"), F.max_by("kind", F.struct("n", "kind")).alias("kind"))


@query("SELECT id FROM memories WHERE project_id IS NULL OR project_id IN (SELECT min(id) FROM projects)")
def o127_readable(spark, sf_dir):
    m = _t(spark, sf_dir, "memories")
    first = _t(spark, sf_dir, "projects").agg(F.min("id")).first()[0]
    return m.where(store.may_read(F.col("project_id"), "agent", [first])).select("id")


@query(f"WITH e AS ({_EDGES}) SELECT e.src, e.dst FROM e WHERE src IN (SELECT 'n' || n_nationkey FROM nation) AND dst IN (SELECT 'r' || r_regionkey FROM region)")
def o139_induced_edges(spark, sf_dir):
    nodes = _t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node")).unionByName(_t(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node")))
    return graph.induced(_edges(spark, sf_dir), nodes, "node").select("src", "dst")


@query("SELECT m.project_id AS entity, m.id FROM memories m WHERE m.project_id IS NOT NULL AND NOT coalesce(m.obsolete, false) QUALIFY row_number() OVER (PARTITION BY m.project_id ORDER BY m.created_at DESC, m.id) <= 5")
def o110_linked_memories(spark, sf_dir):
    m = _t(spark, sf_dir, "memories")
    links = m.where("project_id IS NOT NULL").select(F.col("project_id").alias("entity"), "id")
    return context.linked_memories(links.select("entity"), links, m)


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 100")
def o147_newest_events(spark, sf_dir):
    order = Window.partitionBy("event_type").orderBy(F.desc("event_id"))
    return _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.row_number().over(order).alias("n")).where("n <= 100").drop("n")


@query("SELECT user_id, sid, min(epoch_us(ts)) AS start_us, count(*) AS n FROM (SELECT user_id, ts, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sid FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, sid")
def o23_sessions_from_gaps(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _t(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.withColumn("fresh", F.when(F.col("us") - F.lag("us").over(order) <= 1_800_000_000, 0).otherwise(1))
    e = e.withColumn("sid", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "sid").agg(F.min("us").alias("start_us"), F.count(F.lit(1)).alias("n"))


_HALF = "list_dot_product(CAST(list_slice(q.embedding, {a}, {b}) AS DOUBLE[]), CAST(list_slice(e.embedding, {c}, {d}) AS DOUBLE[]))"
_MAXSIM = " + ".join("greatest(" + ", ".join(_HALF.format(a=a, b=a + 31, c=c, d=c + 31) for c in (1, 33)) + ")" for a in (1, 33))


@query(
    f"""WITH n AS (SELECT q.vec_id AS query, e.vec_id, {_MAXSIM} AS m, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS.format(a='q.embedding', b='e.embedding')}, 9) DESC, e.vec_id) AS place
          FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id QUALIFY place <= 30),
        r AS (SELECT query, vec_id, count(*) OVER (PARTITION BY query) AS n, row_number() OVER (PARTITION BY query ORDER BY place > 20, CASE WHEN place <= 20 THEN m END DESC NULLS LAST, place) AS r FROM n)
        SELECT query, vec_id, round((n - r + 1) / n::DOUBLE, 9) AS score FROM r"""
)
def o60_maxsim_rerank(spark, sf_dir):
    """The nearest vectors of each query, reordered by late interaction of halves of the vectors."""
    e = _t(spark, sf_dir, "embeddings")
    halves = lambda c: F.array(F.slice(c, 1, 32), F.slice(c, 33, 32))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    near = retrieval.nearest(q, "query", "v", e, "vec_id", "embedding", 30, skip_self=True).withColumn("score", F.col("cosine"))
    both = near.join(e.select("vec_id", halves(F.col("embedding")).alias("dt")), "vec_id").join(q.select("query", halves(F.col("v")).alias("qt")), "query")
    return refine.maxsim_rerank(both, "query", "vec_id", "qt", "dt").select("query", "vec_id", F.round("score", 9).alias("score"))


@query(
    """SELECT p.id AS project_id, p.name, count(m.id) AS memories, count(m.id) FILTER (NOT coalesce(m.obsolete, false)) AS live,
       arg_max(m.session_id, (m.created_at, m.id)) FILTER (m.session_id IS NOT NULL) AS last_session FROM projects p LEFT JOIN memories m ON m.project_id = p.id GROUP BY 1, 2"""
)
def o143_project_status(spark, sf_dir):
    s = refine.project_status(_t(spark, sf_dir, "memories"), _t(spark, sf_dir, "projects"))
    return s.select("project_id", "name", F.coalesce("memories", F.lit(0)).alias("memories"), F.coalesce("live", F.lit(0)).alias("live"), "last_session")


@query("SELECT question_id, coalesce(length(q) > 0 AND length(a) > 0 AND (contains(q, a) OR contains(a, q)), false) AS hit FROM (SELECT question_id, trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) AS q, trim(regexp_replace(lower(answer), '[^a-z0-9]+', ' ', 'g')) AS a FROM lme_questions)")
def o166_substring_match(spark, sf_dir):
    return _t(spark, sf_dir, "lme_questions").select("question_id", refine.substring_match(F.col("question"), F.col("answer")).alias("hit"))


@query()
def o155_remembered_chunks(spark, sf_dir):
    """Chunks taken one after the other into the store of memories: which are stored, which are blocked and by what."""
    batch = _t(spark, sf_dir, "import_chunks").select(F.col("chunk_id").cast("string").alias("id"), "content", "chunk_id")
    return remember.remembered(batch, _t(spark, sf_dir, "memories").select("id", "content"), "id", "content", "chunk_id")
