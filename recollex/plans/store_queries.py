"""Queries over the life of a store: sessions, entities and their links, bundles, corpora, evaluation, approximate search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollex.functions import features, text
from recollex.operators import ann, dedup, evaluation, knowledge, recall, retrieval, store, timestamps
from recollex.plans.core_queries import _BM25, _COS, _TRI, _as_of, _live, _questions, _t
from recollex.plans.recall_queries import _KEYWORD, _POOL, _RECENT, _VAGUE, _list, _matches, _pool
from recollex.sources import corpora

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


# --- scans and rows ----------------------------------------------------------


@query("SELECT id, epoch_us(created_at) AS created_us FROM memories WHERE NOT coalesce(obsolete, false) ORDER BY created_at, id LIMIT 10000")
def o04_export_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(_t(spark, sf_dir, "memories")).orderBy("created_at", "id").limit(10_000).select("id", F.unix_micros("created_at").alias("created_us"))


_SESSIONS = "SELECT session_id, min(project_id) AS project_id, min(created_at) AS started_at, max(created_at) AS last_at, count(*) AS memories FROM memories WHERE session_id IS NOT NULL GROUP BY session_id"
_OPEN_FROM = "2025-04-01 00:00:00"
_NEW_FROM = "2023-02-01 00:00:00"


@query(f"SELECT session_id, epoch_us(started_at) AS started_us FROM ({_SESSIONS}) WHERE epoch_us(last_at) >= epoch_us(TIMESTAMP '{_OPEN_FROM}') AND epoch_us(TIMESTAMP '2025-06-01 00:00:00') - epoch_us(started_at) > 24 * 3600000000")
def o09_open_sessions(spark, sf_dir):
    """Sessions still in use in the last two months of the data count as open; those begun more than a day before its end come out."""
    s = store.sessions_of(_t(spark, sf_dir, "memories")).withColumn("ended_at", F.when(F.col("last_at") < F.lit(_OPEN_FROM).cast("timestamp"), F.col("last_at")))
    return store.open_sessions(s, F.lit("2025-06-01 00:00:00").cast("timestamp"), 24.0).select("session_id", F.unix_micros("started_at").alias("started_us"))


@query("""SELECT id, nullif(project_id, '__global__') AS project_id, coalesce(tags, []) AS tags, coalesce(version, 1) AS version, coalesce(access_count, 0) AS access_count, coalesce(CAST(retrieval_strength AS DOUBLE), 1.0) AS retrieval_strength,
  coalesce(obsolete, false) AS obsolete, coalesce(pinned, false) AS pinned FROM memories""")
def o50_typed_rows(spark, sf_dir):
    return store.typed_memories(_t(spark, sf_dir, "memories")).select("id", "project_id", "tags", "version", "access_count", F.col("retrieval_strength").cast("double").alias("retrieval_strength"), "obsolete", "pinned")


@query("SELECT id, kind, coalesce(CAST(to_json(tags) AS VARCHAR), '[]') AS tags, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS created_at FROM memories")
def o52_plain_rows(spark, sf_dir):
    return store.plain_rows(_t(spark, sf_dir, "memories").select("id", "kind", "tags", "created_at"))


@query("SELECT id, CAST(row_number() OVER (ORDER BY retrieval_strength DESC NULLS LAST, confidence DESC NULLS LAST, created_at DESC, id) AS INTEGER) AS place FROM memories ORDER BY place LIMIT 100")
def o131_many_keys(spark, sf_dir):
    top = _t(spark, sf_dir, "memories").orderBy(F.desc_nulls_last("retrieval_strength"), F.desc_nulls_last("confidence"), F.desc("created_at"), "id").limit(100)
    order = Window.orderBy(F.desc_nulls_last("retrieval_strength"), F.desc_nulls_last("confidence"), F.desc("created_at"), "id")  # a hundred rows
    return top.select("id", F.row_number().over(order).alias("place"))


@query(_BM25 + ", " + _TRI + """, both_lists AS (SELECT question_id, id, rank, 1 AS list FROM b WHERE rank <= 30 UNION ALL SELECT question_id, id, rank, 2 FROM z WHERE rank <= 30),
  once AS (SELECT * FROM both_lists QUALIFY row_number() OVER (PARTITION BY question_id, id ORDER BY list, rank) = 1)
  SELECT question_id, id, list, CAST(row_number() OVER (PARTITION BY question_id ORDER BY list, rank) AS INTEGER) AS pos FROM once""")
def o135_first_wins(spark, sf_dir):
    m = _t(spark, sf_dir, "memories")
    one = retrieval.bm25(_questions(spark, sf_dir), "question_id", "question", m, "id", "content", 30).select("question_id", "id", "rank", F.lit(1).alias("list"))
    two = retrieval.trigram_matches(_questions(spark, sf_dir), "question_id", "question", m, "id", "subject", 0.1, 30).select("question_id", "id", "rank", F.lit(2).alias("list"))
    first = one.unionByName(two).groupBy("question_id", "id").agg(F.min(F.struct("list", "rank")).alias("f"))
    return first.select("question_id", "id", F.col("f.list").alias("list"), F.row_number().over(Window.partitionBy("question_id").orderBy("f.list", "f.rank")).alias("pos"))


# --- state -------------------------------------------------------------------


@query("SELECT name FROM projects UNION SELECT upper(name) FROM projects WHERE upper(name) NOT IN (SELECT name FROM projects)")
def o21_created_projects(spark, sf_dir):
    p = _t(spark, sf_dir, "projects").select("name", "description")
    again = p.unionByName(p.withColumn("name", F.upper("name")))
    return store.created(p, again, "name").select("name")


@query("SELECT id, CASE WHEN description = '' THEN NULL ELSE path END AS path, CASE WHEN description = '' THEN true ELSE persistent_memories END AS persistent_memories FROM projects")
def o22_assigned_projects(spark, sf_dir):
    p = _t(spark, sf_dir, "projects")
    changes = p.select("id", F.lit(None).cast("string").alias("path"), F.lit(True).alias("persistent_memories"))
    return store.assigned(p, changes, "id", F.col("description") == "").select("id", "path", "persistent_memories")


@query(
    f"""WITH s AS ({_SESSIONS}), o AS (SELECT *, row_number() OVER (PARTITION BY coalesce(project_id, '::global::') ORDER BY started_at, session_id) AS n FROM s WHERE epoch_us(started_at) < epoch_us(TIMESTAMP '{_NEW_FROM}')),
        l AS (SELECT project_id, max(n) AS top FROM o GROUP BY project_id)
        SELECT s.session_id, coalesce(top, 0) + row_number() OVER (PARTITION BY s.project_id ORDER BY started_at, session_id) AS session_ordinal FROM s LEFT JOIN l ON s.project_id IS NOT DISTINCT FROM l.project_id
        WHERE epoch_us(started_at) >= epoch_us(TIMESTAMP '{_NEW_FROM}')"""
)
def o23_next_ordinals(spark, sf_dir):
    s = store.sessions_of(_t(spark, sf_dir, "memories"))
    early = F.col("started_at") < F.lit(_NEW_FROM).cast("timestamp")
    known = store.session_ordinals(s.where(early), "session_id", "project_id", "started_at")
    return store.numbered_sessions(known, s.where(~early)).select("session_id", F.col("session_ordinal").cast("long").alias("session_ordinal"))


@query("SELECT id, id IN (SELECT supersedes FROM memories WHERE supersedes IS NOT NULL) OR coalesce(obsolete, false) AS obsolete FROM memories WHERE supersedes IS NULL UNION ALL SELECT id, coalesce(obsolete, false) FROM memories WHERE supersedes IS NOT NULL")
def o25_stored_memories(spark, sf_dir):
    """The memories that supersede others stored into those that don't."""
    m = _t(spark, sf_dir, "memories").select("id", "supersedes", "obsolete")
    after = store.stored_memories(m.where("supersedes IS NULL"), m.where("supersedes IS NOT NULL"))
    return after.select("id", F.coalesce("obsolete", F.lit(False)).alias("obsolete"))


@query(f"SELECT s.session_id, p.name, s.memories FROM ({_SESSIONS}) s LEFT JOIN projects p ON s.project_id = p.id")
def o108_sessions_with_projects(spark, sf_dir):
    p = _t(spark, sf_dir, "projects").select(F.col("id").alias("project_id"), "name")
    return store.sessions_of(_t(spark, sf_dir, "memories")).join(p, "project_id", "left").select("session_id", "name", "memories")


# --- entities ----------------------------------------------------------------

_GRAPH = """WITH e AS (SELECT min(id) AS id, subject AS name, 'subject' AS kind, project_id FROM memories WHERE subject IS NOT NULL GROUP BY subject, project_id),
  k AS (SELECT m.id AS memory_id, e.id AS entity_id FROM memories m JOIN e ON m.subject = e.name AND m.project_id IS NOT DISTINCT FROM e.project_id),
  f AS (SELECT DISTINCT a.entity_id AS src, b.entity_id AS dst FROM memories m JOIN k a ON a.memory_id = m.id JOIN k b ON b.memory_id = m.supersedes)"""


def _graph(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, links): subjects of memories, which of them follow each other, and which memory has which."""
    m = _t(spark, sf_dir, "memories")
    entities = m.where("subject IS NOT NULL").groupBy(F.col("subject").alias("name"), "project_id").agg(F.min("id").alias("id")).select("id", "name", F.lit("subject").alias("kind"), "project_id")
    own = entities.select(F.col("id").alias("entity_id"), "name", F.col("project_id").alias("_p"))
    links = m.join(own, (F.col("subject") == F.col("name")) & F.col("project_id").eqNullSafe(F.col("_p"))).select(F.col("id").alias("memory_id"), "entity_id")
    before = links.select(F.col("memory_id").alias("supersedes"), F.col("entity_id").alias("dst"))
    relations = m.where("supersedes IS NOT NULL").select(F.col("id").alias("memory_id"), "supersedes").join(links, "memory_id").join(before, "supersedes").select(F.col("entity_id").alias("src"), "dst", F.lit("follows").alias("relation")).distinct()
    return entities, relations, links


@query(_GRAPH + """, p AS (SELECT DISTINCT m.subject AS src_name, lower(trim(m.kind)) AS dst_name, m.project_id FROM memories m WHERE m.subject IS NOT NULL AND m.kind IS NOT NULL AND m.project_id IS NOT NULL)
  SELECT a.name AS src_name, 'follows' AS relation, b.name AS dst_name, count(*) AS n FROM f JOIN e a ON a.id = f.src JOIN e b ON b.id = f.dst GROUP BY a.name, b.name
  UNION ALL SELECT src_name, 'is a', dst_name, count(*) FROM p GROUP BY src_name, dst_name""")
def o35_related(spark, sf_dir):
    """Subjects related to their kinds by name; the kinds become entities."""
    entities, relations, _ = _graph(spark, sf_dir)
    m = _t(spark, sf_dir, "memories").where("subject IS NOT NULL AND kind IS NOT NULL AND project_id IS NOT NULL")
    wanted = m.select(F.col("subject").alias("src_name"), F.lit("is a").alias("relation"), F.lower(F.trim("kind")).alias("dst_name"), "project_id").distinct()
    grown, edges = knowledge.related(entities, relations, wanted)
    names = lambda side: grown.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"))
    return edges.join(names("src"), "src").join(names("dst"), "dst").groupBy("src_name", "relation", "dst_name").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT name, count(*) AS n FROM (SELECT id AS memory_id, subject AS name, project_id FROM memories WHERE subject IS NOT NULL
  UNION SELECT id, unnest(tags), project_id FROM memories WHERE project_id IS NOT NULL) WHERE name IS NOT NULL GROUP BY name""")
def o36_linked(spark, sf_dir):
    """Memories linked to the entities that their tags name, beside their subjects."""
    entities, _, links = _graph(spark, sf_dir)
    m = _t(spark, sf_dir, "memories")
    wanted = m.where("project_id IS NOT NULL").select(F.col("id").alias("memory_id"), F.explode("tags").alias("name"), "project_id").where("name IS NOT NULL")
    grown, more = knowledge.linked(entities, links, wanted)
    return more.join(grown.select(F.col("id").alias("entity_id"), "name"), "entity_id").groupBy("name").agg(F.countDistinct("memory_id").alias("n"))


@query(_GRAPH + """, g AS (SELECT entity_id FROM k GROUP BY entity_id HAVING count(*) = 1) SELECT e.id, count(DISTINCT k.memory_id) AS links, count(DISTINCT f.src || f.dst) AS edges FROM e LEFT JOIN k ON k.entity_id = e.id
  LEFT JOIN f ON f.src = e.id AND f.dst NOT IN (SELECT entity_id FROM g) WHERE e.id NOT IN (SELECT entity_id FROM g) GROUP BY e.id""")
def o37_without(spark, sf_dir):
    """Entities of a single memory deleted with their links and edges."""
    entities, relations, links = _graph(spark, sf_dir)
    gone = links.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(F.col("entity_id").alias("id"))
    kept, edges, bridge = knowledge.without(entities, relations, links, gone)
    n_links = bridge.groupBy(F.col("entity_id").alias("id")).agg(F.countDistinct("memory_id").alias("links"))
    n_edges = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("edges"))
    return kept.select("id").join(n_links, "id", "left").join(n_edges, "id", "left").select("id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("edges", F.lit(0)).alias("edges"))


@query(_GRAPH + " SELECT k.memory_id, e.name FROM k JOIN e ON e.id = k.entity_id")
def o109_entities_of_memories(spark, sf_dir):
    entities, _, links = _graph(spark, sf_dir)
    return knowledge.entities_of(links, entities).select("memory_id", F.explode("entities").alias("e")).select("memory_id", "e.name")


@query(_GRAPH + ", o AS (SELECT id FROM memories WHERE coalesce(obsolete, false)) SELECT memory_id, entity_id FROM k WHERE memory_id NOT IN (SELECT id FROM o)")
def o30_purged_links(spark, sf_dir):
    return store.purged(_t(spark, sf_dir, "memories"), _graph(spark, sf_dir)[2])[1]


@query(
    """SELECT (SELECT count(*) FROM projects) AS projects, (SELECT count(*) FROM memories) AS memories, (SELECT count(*) FROM memories WHERE coalesce(obsolete, false)) AS obsolete, (SELECT count(DISTINCT session_id) FROM memories) AS sessions,
       (SELECT count(*) FROM (SELECT DISTINCT subject, project_id FROM memories WHERE subject IS NOT NULL)) AS entities, (SELECT count(*) FROM memories WHERE subject IS NOT NULL) AS links, (SELECT count(*) FROM embeddings) AS vectors"""
)
def o118_table_counts(spark, sf_dir):
    entities, _, links = _graph(spark, sf_dir)
    m = _t(spark, sf_dir, "memories")
    counts = {
        "projects": _t(spark, sf_dir, "projects"), "memories": m, "obsolete": m.where("coalesce(obsolete, false)"), "sessions": m.where("session_id IS NOT NULL").select("session_id").distinct(),
        "entities": entities, "links": links, "vectors": _t(spark, sf_dir, "embeddings"),
    }
    out = None
    for name, df in counts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out.agg(*[F.sum(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in counts])


# --- bundles -----------------------------------------------------------------


@query(
    """WITH m AS (SELECT project_id, lower(trim(kind)) AS kind, id, created_at, pinned FROM memories WHERE NOT coalesce(obsolete, false) AND project_id IS NOT NULL),
       k AS (SELECT project_id, kind AS section, id, row_number() OVER (PARTITION BY project_id, kind ORDER BY created_at DESC, id) AS place FROM m WHERE kind IN ('decision', 'issue', 'procedure', 'preference')),
       p AS (SELECT project_id, 'pinned' AS section, id, row_number() OVER (PARTITION BY project_id ORDER BY created_at, id) AS place FROM m WHERE pinned)
       SELECT project_id, section, CAST(place AS INTEGER) AS place, id FROM (SELECT * FROM k WHERE place <= CASE WHEN section = 'decision' THEN 20 ELSE 10 END UNION ALL SELECT * FROM p)"""
)
def o141_session_bundles(spark, sf_dir):
    """What a session of each project begins with, one row an entry."""
    bundle = knowledge.session_bundle(_t(spark, sf_dir, "projects"), _t(spark, sf_dir, "memories"), None)
    entries = bundle.select("project_id", F.explode("sections").alias("section", "ids"))
    return entries.select("project_id", "section", F.posexplode("ids").alias("p", "id")).select("project_id", "section", (F.col("p") + 1).alias("place"), "id")


@query(
    f"""{_POOL}, r AS (SELECT query, question, id, pos, score FROM pool WHERE pos <= 15),
        e AS (SELECT min(id) AS id, subject AS name, project_id FROM memories WHERE subject IS NOT NULL GROUP BY subject, project_id),
        k AS (SELECT m.id AS memory_id, m.created_at, m.obsolete, e.id AS entity_id, e.name FROM memories m JOIN e ON m.subject = e.name AND m.project_id IS NOT DISTINCT FROM e.project_id),
        a AS (SELECT r.query, m.subject AS name FROM r JOIN memories m USING (id) WHERE pos <= 5 AND m.subject IS NOT NULL UNION SELECT r.query, k.name FROM r JOIN k ON k.memory_id = r.id WHERE pos <= 5
              UNION SELECT query, w FROM (SELECT DISTINCT query, unnest(string_split_regex(question, '\\s+')) AS w FROM r) WHERE length(w) > 2),
        x AS (SELECT DISTINCT a.query, e.id AS entity_id FROM a JOIN e USING (name)),
        newest AS (SELECT entity_id, memory_id FROM k WHERE NOT coalesce(obsolete, false) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, memory_id) <= 5)
        SELECT query, id, round(score, 9) AS score, 'recall' AS source FROM r
        UNION ALL SELECT DISTINCT x.query, newest.memory_id, 0.5, 'graph' FROM x JOIN newest USING (entity_id) WHERE (x.query, newest.memory_id) NOT IN (SELECT (query, id) FROM r)"""
)
def o140_deep_context(spark, sf_dir):
    """Deep context over a fixed recall, the newest fifteen of the question's project."""
    pool = _pool(spark, sf_dir).where("pos <= 15")
    entities, _, links = _graph(spark, sf_dir)
    recalled = pool.select("query", "id", F.col("pos").alias("rank"), "score")
    found = knowledge.deep_context(recalled, pool.select("query", "question").distinct(), _t(spark, sf_dir, "memories"), entities, links)
    return found.withColumn("score", F.round("score", 9))


# --- features with SQL -------------------------------------------------------


@query(f"SELECT question_id, {_VAGUE} AS vague, {_RECENT} AS recent, {_matches('question', text.INTERVAL)} AS interval, {_KEYWORD}::DOUBLE AS keyword_weight FROM lme_questions WHERE question IS NOT NULL")
def o69_vague_questions(spark, sf_dir):
    q = F.col("question")
    asked = _questions(spark, sf_dir).where("question IS NOT NULL")
    return asked.select("question_id", text.is_vague(q).alias("vague"), text.wants_recent(q).alias("recent"), text.asks_interval(q).alias("interval"), text.keyword_weight(q, 0.75).alias("keyword_weight"))


_KEEP_FIRST = "list_filter({w}, lambda x, i: list_position({w}, x) = i)"


@query(f"WITH n AS (SELECT id, list_filter(regexp_extract_all(content, '\\b([A-Z][a-z]+)\\b', 1), lambda w: NOT list_contains({_list(text.COMMON_CAPITALS)}, w)) AS w FROM memories) SELECT id, {_KEEP_FIRST.format(w='w')} AS nouns FROM n")
def o75_proper_nouns(spark, sf_dir):
    return _t(spark, sf_dir, "memories").select("id", text.proper_nouns(F.col("content")).alias("nouns"))


@query(
    f"""WITH s AS (SELECT id, list_filter(string_split_regex(content, '[.!?\\n]+'), lambda s: regexp_matches(s, '{features.PREFERENCE}')) AS s FROM memories),
        w AS (SELECT id, list_filter(flatten(list_transform(s, lambda x: regexp_extract_all(x, '\\b([A-Za-z0-9][\\w\\-]{{2,}})\\b', 1))), lambda w: NOT list_contains({_list(features.PLAIN_WORDS)}, lower(w))) AS w FROM s),
        l AS (SELECT id, w, list_transform(w, lambda x: lower(x)) AS l FROM w)
        SELECT id, coalesce(list_slice(list_filter(w, lambda x, i: list_position(l, lower(x)) = i), 1, 20), []) AS terms FROM l"""
)
def o76_preference_terms(spark, sf_dir):
    return _t(spark, sf_dir, "memories").select("id", features.preference_terms(F.col("content")).alias("terms"))


_ANSWER = "list_filter(string_split_regex(lower(regexp_replace(regexp_replace(replace({c}, ',', ''), '\\b(?:a|an|the|and)\\b', ' ', 'g'), '[!-/:-@\\[-`{{-~]', '', 'g')), '\\s+'), lambda w: w <> '')"


@query(
    f"""WITH t AS (SELECT question_id, {_ANSWER.format(c='question')} AS p, {_ANSWER.format(c='answer')} AS g FROM lme_questions),
        c AS (SELECT *, list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))) AS n FROM t)
        SELECT question_id, round(CASE WHEN p IS NULL OR g IS NULL THEN NULL WHEN len(p) = 0 OR len(g) = 0 THEN CASE WHEN len(p) = len(g) THEN 1.0 ELSE 0.0 END ELSE 2.0 * coalesce(n, 0) / (len(p) + len(g)) END, 9) AS f1 FROM c"""
)
def o165_answer_f1(spark, sf_dir):
    q = _t(spark, sf_dir, "lme_questions")
    both = F.col("question").isNotNull() & F.col("answer").isNotNull()
    return q.select("question_id", F.when(both, F.round(evaluation.token_f1(F.col("question"), F.col("answer")), 9)).alias("f1"))


_DISTINCTIVE = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(content), '\\b([a-z0-9][a-z0-9_\\-]{{2,}})\\b', 1), lambda w: NOT list_contains({_list(text.ENTITY_STOP_WORDS)}, w))))"
_SPACE = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_CLASSES = f"""WITH w AS (SELECT id, unnest(list_filter(string_split_regex(lower(content), '{_SPACE}'), lambda x: x <> '')) AS w FROM memories WHERE content IS NOT NULL),
  h AS (SELECT id, md5(w) AS m FROM w),
  v AS (SELECT id, CAST(concat('0x', m[15:16], m[13:14], m[11:12], m[9:10], m[7:8], m[5:6], m[3:4], m[1:2]) AS UBIGINT) AS b FROM h),
  c AS (SELECT id, i, 2 * sum((b >> i) & 1) > count(*) AS bit FROM v, range(64) r(i) GROUP BY id, i),
  s AS (SELECT id, sum(CASE WHEN bit THEN (CASE WHEN i = 63 THEN -9223372036854775808 ELSE (1::HUGEINT << CAST(i AS INTEGER)) END) ELSE 0 END) AS x FROM c GROUP BY id),
  t AS (SELECT m.id, CAST(coalesce(s.x, 0) AS BIGINT) AS simhash, {_DISTINCTIVE} AS words FROM memories m LEFT JOIN s ON m.id = s.id WHERE content IS NOT NULL),
  k AS (SELECT id, simhash, words, min(id) OVER (PARTITION BY simhash, words) AS class FROM t)"""


@query(_CLASSES + " SELECT id, class, simhash FROM k")
def o170_duplicate_classes(spark, sf_dir):
    """The class of every memory in ``o170_divergent_duplicates``."""
    return dedup.fingerprint_classes(_t(spark, sf_dir, "memories"), "id", "content").select("id", "class", "simhash")


@query(
    _CLASSES + """, d AS (SELECT DISTINCT class, simhash, words FROM k),
  p AS (SELECT a.class AS class_a, b.class AS class_b, a.simhash AS bits_a, b.simhash AS bits_b, CAST(bit_count(xor(a.simhash, b.simhash)) AS INTEGER) AS distance, a.words AS wa, b.words AS wb,
          len(list_intersect(a.words, b.words)) AS n FROM d a JOIN d b ON a.class < b.class WHERE bit_count(xor(a.simhash, b.simhash)) <= 3)
  SELECT class_a, class_b, bits_a, bits_b, distance, len(wa) > 0 AND len(wb) > 0 AND n / greatest(len(wa) + len(wb) - n, 1)::DOUBLE < 0.3 AS diverge FROM p"""
)
def o170_divergent_duplicates(spark, sf_dir):
    """Pairs of classes of memories whose fingerprints are near or equal, and whether their distinctive words differ all the same."""
    return dedup.divergent_pairs(dedup.fingerprint_classes(_t(spark, sf_dir, "memories"), "id", "content"))


# --- vectors -----------------------------------------------------------------


@query(
    f"""SELECT q.vec_id AS query, e.vec_id, round({_COS.format(a='q.embedding', b='e.embedding')}, 6) AS cosine FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0 AND {_COS.format(a='q.embedding', b='e.embedding')} >= 0.2
        QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS.format(a='q.embedding', b='e.embedding')}, 9) DESC, e.vec_id) <= 3"""
)
def o55_conflict_candidates(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"), "label")
    near = retrieval.nearest(q, "query", "v", e, "vec_id", "embedding", 3, least=0.2, skip_self=True, group="label")
    return near.select("query", "vec_id", F.round("cosine", 6).alias("cosine"))


@query(
    f"""WITH n AS (SELECT * FROM embeddings ORDER BY vec_id DESC LIMIT 100)
        SELECT x.vec_id AS a, y.vec_id AS b, round({_COS.format(a='x.embedding', b='y.embedding')}, 3) AS cosine FROM n x JOIN n y ON x.vec_id < y.vec_id WHERE {_COS.format(a='x.embedding', b='y.embedding')} > 0.2
        ORDER BY round({_COS.format(a='x.embedding', b='y.embedding')}, 9) DESC, a, b LIMIT 1000"""
)
def o56_newest_graph(spark, sf_dir):
    """The graph of the newest hundred vectors, at most a thousand edges."""
    newest = _t(spark, sf_dir, "embeddings").orderBy(F.desc("vec_id")).limit(100)
    pairs = retrieval.similarity_pairs(newest, "vec_id", "embedding", 0.2).orderBy(F.round("cosine", 9).desc(), "a", "b").limit(1000)
    return pairs.withColumn("cosine", F.round("cosine", 3))


@query(
    """WITH p AS (SELECT a.label AS a, a.vec_id, max(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS best FROM embeddings a JOIN embeddings b ON b.label = a.label + 1 GROUP BY a.label, a.vec_id)
       SELECT a, a + 1 AS b, round(sum(best), 6) AS score FROM p GROUP BY a"""
)
def o59_maxsim(spark, sf_dir):
    """Late interaction of all vectors of each label with all those of the next label."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("label").alias("a"), "vec_id", "embedding")
    scored = retrieval.maxsim_scores(e, e.withColumn("a", F.col("a") - 1), "a", "vec_id", "embedding")
    return scored.select("a", (F.col("a") + 1).alias("b"), F.round("score", 6).alias("score"))


@query()
def o57_cell_search(spark, sf_dir):
    """The approximate nearest of every twentieth vector among all, from an index by cells."""
    e = _t(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    return ann.neighbours(ann.build(e, "vec_id", "embedding"), q, "query", "v", 10, skip_self=True).select("query", F.col("key").alias("vec_id"), F.round("cosine", 6).alias("cosine"), "rank")


# --- ingestion and corpora ---------------------------------------------------

_PARTS = "list_filter(string_split_regex(lower(source_file), '[/\\\\]+'), lambda p: p <> '')"
_SUFFIX = "regexp_extract(list_extract(string_split_regex(lower(source_file), '[/\\\\]+'), -1), '[^.](\\.[^.]+)$', 1)"
_ROOM = (
    "CASE " + " ".join(f"WHEN list_has_any({_PARTS}, {_list(words)}) THEN '{name}'" for name, words in corpora.ROOMS.items())
    + f" WHEN list_contains({_list(list(corpora.CODE))}, {_SUFFIX}) THEN 'code' WHEN list_contains({_list(list(corpora.TEXT))}, {_SUFFIX}) THEN 'docs' WHEN list_contains({_list(list(corpora.SETTINGS))}, {_SUFFIX}) THEN 'config' ELSE 'general' END"
)


@query(f"SELECT chunk_id, CASE WHEN source_file IS NOT NULL THEN {_ROOM} END AS room FROM import_chunks")
def o151_rooms(spark, sf_dir):
    return _t(spark, sf_dir, "import_chunks").select("chunk_id", corpora.room(F.col("source_file")).alias("room"))


_TURNS = """WITH s AS (SELECT question_id, unnest(haystack_session_ids) AS sid, unnest(haystack_sessions) AS m, unnest(haystack_dates) AS date FROM lme_questions),
  t AS (SELECT question_id, sid, date, unnest(range(len(m))) AS n, unnest(m) AS x FROM s WHERE m IS NOT NULL AND sid IS NOT NULL),
  u AS (SELECT question_id, sid, date, n, lower(trim(x.role)) AS role, x.content AS content FROM t)"""


@query(
    _TURNS + """, l AS (SELECT *, lead(role) OVER w AS nr, lead(content) OVER w AS nc, lag(role) OVER w AS pr FROM u WINDOW w AS (PARTITION BY sid ORDER BY n)),
  p AS (SELECT sid AS thread, n, CASE WHEN role = 'user' AND nr = 'assistant' THEN 'User: ' || content || chr(10) || chr(10) || 'Assistant: ' || nc WHEN role = 'user' THEN 'User: ' || content
    WHEN role = 'assistant' AND coalesce(pr, '') <> 'user' THEN 'Assistant: ' || content END AS chunk FROM l)
  SELECT thread, CAST(row_number() OVER (PARTITION BY thread ORDER BY n) - 1 AS INTEGER) AS chunk_index, chunk FROM p WHERE length(chunk) >= 50"""
)
def o153_chat_chunks(spark, sf_dir):
    turns = corpora.question_sessions(_t(spark, sf_dir, "lme_questions")).where("session_id IS NOT NULL").select(F.col("session_id").alias("thread"), F.posexplode("messages").alias("n", "m"))
    turns = turns.select("thread", "n", F.lower(F.trim("m.role")).alias("role"), F.col("m.content").alias("content"))
    return corpora.chat_chunks(turns, "thread", "n", "role", "content")


_DATED = "CASE WHEN coalesce(date, '') <> '' THEN '[Date: ' || date || ']' || chr(10) ELSE '' END || "


@query(
    _TURNS + """, v AS (SELECT * FROM u WHERE regexp_matches(coalesce(content, ''), '[^\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200d}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}]')), l AS (SELECT *, lead(role) OVER w AS nr, lead(content) OVER w AS nc, lag(role) OVER w AS pr FROM v WINDOW w AS (PARTITION BY question_id, sid, date ORDER BY n))
  SELECT question_id, sid || '_turn_' || n AS corpus_id, """ + _DATED + """ CASE WHEN role = 'user' AND nr = 'assistant' THEN '[USER]: ' || content || chr(10) || '[ASSISTANT]: ' || nc WHEN role = 'user' THEN '[USER]: ' || content
    WHEN role = 'assistant' AND coalesce(pr, '') <> 'user' THEN '[ASSISTANT]: ' || content END AS content FROM l WHERE role = 'user' OR (role = 'assistant' AND coalesce(pr, '') <> 'user')"""
)
def o20_corpus_pairs(spark, sf_dir):
    return corpora.corpus(_t(spark, sf_dir, "lme_questions"), "pair").select("question_id", "corpus_id", "content")


@query(_TURNS + " SELECT question_id, sid AS corpus_id, " + _DATED + " string_agg(content, chr(10) ORDER BY n) AS content FROM u WHERE role = 'user' AND regexp_matches(coalesce(content, ''), '[^\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200d}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}]') GROUP BY question_id, sid, date")
def o20_corpus_sessions(spark, sf_dir):
    return corpora.corpus(_t(spark, sf_dir, "lme_questions"), "session").select("question_id", "corpus_id", "content")


@query(
    """WITH q AS (SELECT sample_id, unnest(range(len(qa))) AS question_no, unnest(qa) AS q FROM locomo_samples)
       SELECT sample_id, CAST(question_no AS INTEGER) AS question_no, coalesce(len(list_distinct(list_filter(list_transform(q.evidence, lambda e: regexp_extract(e, '^D(\\d+):', 1)), lambda n: n <> ''))), 0) AS sessions FROM q"""
)
def o168_evidence_sessions(spark, sf_dir):
    q = corpora.dialogue_questions(_t(spark, sf_dir, "locomo_samples"))
    return q.select("sample_id", "question_no", F.coalesce(F.size(evaluation.evidence_sessions(F.col("evidence"))), F.lit(0)).cast("long").alias("sessions"))


@query(
    """WITH k AS (SELECT sample_id, conversation, unnest(json_keys(conversation)) AS k FROM locomo_samples WHERE json_valid(conversation)),
       s AS (SELECT sample_id, k, from_json(json_extract(conversation, '$."' || k || '"'), '[{"dia_id":"VARCHAR","speaker":"VARCHAR","text":"VARCHAR"}]') AS t FROM k WHERE regexp_full_match(k, 'session_\\d+')),
       u AS (SELECT sample_id, k, unnest(range(len(t))) AS n, unnest(t) AS t FROM s)
       SELECT sample_id, CAST(substring(k, 9) AS INTEGER) AS session_no, CAST(n AS INTEGER) AS turn_no, t.dia_id AS dia_id, t.speaker AS speaker, t.text AS text FROM u"""
)
def o20_dialogue_turns(spark, sf_dir):
    return corpora.dialogue_turns(_t(spark, sf_dir, "locomo_samples"))


@query()
def o157_imported_documents(spark, sf_dir):
    """Documents as files of a project: chunks with subject and tags."""
    d = _t(spark, sf_dir, "documents").where("text IS NOT NULL")
    return corpora.import_chunks(d.select(F.concat_ws("/", F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.col("text").alias("content")))


# --- evaluation --------------------------------------------------------------


@query(
    """WITH r AS (SELECT query_id, memory_id, max(final_score) AS f, max(keyword_boost) AS k FROM rerank_results GROUP BY 1, 2),
       run AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY f DESC NULLS LAST, memory_id) AS rank FROM r),
       rel AS (SELECT query_id, memory_id FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC NULLS LAST, memory_id) <= 5),
       h AS (SELECT query_id, count(*) AS hits, sum(1.0 / log2(rank + 1)) AS dcg FROM run JOIN rel USING (query_id, memory_id) WHERE rank <= 10 GROUP BY query_id),
       n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id)
       SELECT query_id, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_any, CASE WHEN coalesce(hits, 0) >= n THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_all,
         round(coalesce(dcg / (SELECT sum(1.0 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= hits), 0), 9) AS ndcg FROM n LEFT JOIN h USING (query_id)"""
)
def o161_retrieved_metrics(spark, sf_dir):
    r = _t(spark, sf_dir, "rerank_results").groupBy("query_id", "memory_id").agg(F.max("final_score").alias("f"), F.max("keyword_boost").alias("k"))
    by = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(c).desc_nulls_last(), "memory_id"))
    run, relevant = r.select("query_id", "memory_id", by("f").alias("rank")), r.select("query_id", "memory_id", by("k").alias("n")).where("n <= 5")
    return evaluation.retrieved_metrics(run, relevant, "query_id", "memory_id", 10).withColumn("ndcg", F.round("ndcg", 9))


def haystack_recall(spark, sf_dir) -> DataFrame:
    """``(query_id, row_id, rank)``: each question against the exchanges of its own haystack, mapped to sessions, each session once."""
    q = _t(spark, sf_dir, "lme_questions")
    rows = corpora.corpus(q, "pair").withColumns({"created_at": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("session_no") * 86_400), "project_id": F.col("question_id")})
    none = lambda kind: F.lit(None).cast(kind)
    memories = rows.select(
        F.col("corpus_id").alias("id"), "content", "session_id", "project_id", none("string").alias("subject"), none("array<string>").alias("tags"), F.lit(1.0).alias("confidence"), "created_at",
        none("timestamp").alias("last_accessed"), F.lit(0.0).alias("storage_strength"), F.lit(False).alias("obsolete"),
    )
    asked = timestamps.normalise_timestamps(q, "question_date", "locale", "time_zone", "_us").select(F.col("question_id").alias("query"), "question", F.col("question_id").alias("project_id"), F.to_date(F.timestamp_micros("_us")).alias("reference"))
    ordinals = corpora.question_sessions(q).where("session_id IS NOT NULL").select("session_id", F.col("session_no").alias("ordinal")).distinct()
    found = recall.recall(asked, memories, ordinals, _as_of())
    best = found.groupBy(F.col("query").alias("query_id"), evaluation.session_of(F.col("id")).alias("row_id")).agg(F.min("rank").alias("_r"))
    return best.select("query_id", "row_id", F.row_number().over(Window.partitionBy("query_id").orderBy("_r", "row_id")).alias("rank"))


@query()
def o178_evaluated_recall(spark, sf_dir):
    """Recall of the sessions that hold the answer, by kind of question and over all (kind null), at 1 and 5."""
    q = _t(spark, sf_dir, "lme_questions")
    relevant = q.select(F.col("question_id").alias("query_id"), F.explode("answer_session_ids").alias("row_id"))
    run = haystack_recall(spark, sf_dir)
    kinds = q.select(F.col("question_id").alias("query_id"), F.coalesce("question_type", F.lit("none")).alias("question_type"))
    out = None
    for k in (1, 5):
        told = evaluation.retrieved_metrics(run, relevant, "query_id", "row_id", k).join(kinds, "query_id")
        part = told.rollup("question_type").agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("questions"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall_any", "recall_all", "ndcg")])
        out = part if out is None else out.unionByName(part)
    return out
