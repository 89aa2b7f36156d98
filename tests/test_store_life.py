import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollex.operators import ann, fulltext, knowledge, recall, retrieval, store
from recollex.sources import archive, corpora, text_files


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ENTITIES = [("e1", "Cache", "file", None), ("e2", "Cache", "file", "p"), ("e3", "Node", "file", "q")]


def graph(spark):
    entities = spark.createDataFrame(ENTITIES, "id string, name string, kind string, project_id string")
    relations = spark.createDataFrame([("e1", "e2", "uses"), ("e3", "e3", "is")], "src string, dst string, relation string")
    links = spark.createDataFrame([("m1", "e1"), ("m2", "e2"), ("m2", "e3")], "memory_id string, entity_id string")
    return entities, relations, links


def test_names_resolve_to_their_project_first(spark):
    entities, _, _ = graph(spark)
    named = spark.createDataFrame([("Cache", "p"), ("Cache", "z"), ("Cache", None), ("Node", "p"), ("Node", None), (None, "p"), ("Cache", "p")], "name string, project_id string")
    assert values(knowledge.resolved(entities, named)) == sorted([("Cache", "p", "e2"), ("Cache", "z", "e1"), ("Cache", None, "e1"), ("Node", "p", None), ("Node", None, "e3")], key=repr)


def test_relate_link_and_delete(spark):
    entities, relations, links = graph(spark)
    wanted = spark.createDataFrame([("Cache", "uses", "Disk", "p"), ("Cache", "uses", "Disk", "p"), ("Cache", "uses", "Cache", "p")], "src_name string, relation string, dst_name string, project_id string")
    grown, edges = knowledge.related(entities, relations, wanted)
    assert grown.count() == 4 and edges.count() == 4 and grown.where("kind = 'concept'").select("name", "project_id").collect()[0] == ("Disk", "p")
    again, more = knowledge.related(grown, edges, wanted)
    assert values(again) == values(grown) and values(more) == values(edges)
    grown, bridge = knowledge.linked(entities, links, spark.createDataFrame([("m1", "Cache", None), ("m9", "New", "p"), ("m9", "New", "p")], "memory_id string, name string, project_id string"))
    assert bridge.count() == 4 and grown.count() == 4
    kept, edges, bridge = knowledge.without(entities, relations, links, spark.createDataFrame([("e2",), ("e2",), ("zz",)], "id string"))
    assert [r.id for r in kept.orderBy("id").collect()] == ["e1", "e3"] and values(edges) == [("e3", "e3", "is")] and values(bridge) == [("m1", "e1"), ("m2", "e3")]
    assert {r.memory_id: [e.name for e in r.entities] for r in knowledge.entities_of(links, entities).collect()} == {"m1": ["Cache"], "m2": ["Cache", "Node"]}


def test_pseudo_entities_become_links(spark):
    entities = spark.createDataFrame([("e1", "Cache", "file", None), ("x1", "memory:m1", "concept", None), ("x2", "memory:gone", "concept", None)], "id string, name string, kind string, project_id string")
    relations = spark.createDataFrame([("x1", "e1", "about"), ("x2", "e1", "about"), ("x1", "x2", "about")], "src string, dst string, relation string")
    none = spark.createDataFrame([], "memory_id string, entity_id string")
    kept, links, left = knowledge.from_pseudo(entities, none, relations, spark.createDataFrame([("m1",)], "id string"))
    assert [r.id for r in kept.collect()] == ["e1"] and values(links) == [("m1", "e1")] and left.count() == 0


def test_bundles_by_tier(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    rows = [(f"d{i}", "p", "Decision ", i == 3, False, t(i), "s1") for i in range(1, 25)] + [("i1", "p", "issue", False, False, t(2), "s2"), ("i2", "p", "issue", False, True, t(3), None), ("x", None, None, None, None, t(1), None)]
    m = spark.createDataFrame(rows, "id string, project_id string, kind string, pinned boolean, obsolete boolean, created_at timestamp, session_id string")
    projects = spark.createDataFrame([("p", "one"), ("q", "two")], "id string, name string")
    recalled = spark.createDataFrame([("p", "d9", 2), ("p", "i1", 1)], "project_id string, id string, rank int")
    got = {tier: {r.project_id: r for r in knowledge.session_bundle(projects, m, recalled, tier).collect()} for tier in ("L0", "L1", "L2", "full")}
    assert got["L0"]["p"].sections == {} and got["L0"]["p"].last_session == "s1" and got["full"]["q"].sections == {}
    assert set(got["L1"]["p"].sections) == {"decision", "pinned"} and got["L1"]["p"].sections["decision"] == [f"d{i}" for i in range(24, 4, -1)] and got["L1"]["p"].sections["pinned"] == ["d3"]
    assert got["L2"]["p"].sections["issue"] == ["i1"] and got["full"]["p"].sections["relevant"] == ["i1", "d9"]


def test_updates_may_set_null_and_only_where_allowed(spark):
    state = spark.createDataFrame([("a", "x", 1), ("b", "y", None)], "id string, v string, n int")
    changes = spark.createDataFrame([("a", None), ("b", None), ("z", "q")], "id string, v string")
    assert values(store.assigned(state, changes, "id")) == [("a", None, 1), ("b", None, None)]
    assert values(store.assigned(state, changes, "id", F.col("n") == 1)) == [("a", None, 1), ("b", "y", None)]
    log = spark.createDataFrame([("m", datetime.datetime(2024, 1, 1), "c" * 300)], "memory_id string, accessed_at timestamp, context string")
    assert len(store.logged(log.limit(0), log).first().context) == 200


def test_cells_reach_the_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    vectors = centres[rng.integers(0, 40, 3000)] + 0.35 * rng.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [1.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    q = df.where("id % 20 = 0 AND id < 3000").select(F.col("id").alias("q"), F.col("v").alias("w"))
    index = ann.build(df, "id", "v", cells=32)
    before, ann.BLOCK = ann.BLOCK, 50
    split = ann.build(df, "id", "v", cells=32)
    ann.BLOCK = before
    exact = {(r.q, r.id) for r in retrieval.nearest(q, "q", "w", df, "id", "v", 10, skip_self=True).collect()}
    found = {(r.q, r.key) for r in ann.neighbours(index, q, "q", "w", 10, skip_self=True).collect()}
    assert split.blocks.max() > 1 and values(ann.neighbours(split, q, "q", "w", 10, skip_self=True)) == values(ann.neighbours(index, q, "q", "w", 10, skip_self=True))
    assert len(found & exact) / len(exact) >= 0.9 and index.probes < 32 and index.recall >= 0.95
    assert ann.neighbours(ann.build(df.limit(0), "id", "v"), q, "q", "w").count() == 0


def memories(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    rows = [
        ("a", "p", "s1", "The Kestrel cache runs on port 5432", "kestrel", t(1), False), ("b", "p", "s2", "Kestrel databases were moved on May 1st, 2022", None, t(2), False),
        ("c", "q", "s3", "The Kestrel cache of another project", None, t(3), False), ("d", "p", "s1", "Kestrel cache is gone", None, t(4), True), ("e", "p", None, None, None, t(5), False), ("f", None, "s4", "kestral cachee", None, t(6), False),
    ]
    m = spark.createDataFrame(rows, "id string, project_id string, session_id string, content string, subject string, created_at timestamp, obsolete boolean")
    return m.withColumns({"tags": F.array().cast("array<string>"), "confidence": F.lit(1.0), "last_accessed": F.lit(None).cast("timestamp"), "storage_strength": F.lit(0.0)})


def test_recall_of_a_project(spark):
    q = spark.createDataFrame([("q1", "Where does the Kestrel cache run?", "p", None), ("q2", "kestral cachee", None, None), ("q3", None, "p", None), ("q4", "2022-05-01", "p", None)], "query string, question string, project_id string, reference date")
    ordinals = spark.createDataFrame([("s1", 1), ("s2", 2)], "session_id string, ordinal int")
    as_of = F.lit("2024-02-01").cast("timestamp")
    for s in (recall.Settings(limit=3), recall.Settings(limit=3, feedback=True, date_filter=True)):
        got = {}
        for r in recall.recall(q, memories(spark), ordinals, as_of, s).orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append(r.id)
        assert got["q1"][0] == "a" and set(got["q1"]) == {"a", "b"} and got["q2"][0] == "f" and "d" not in got["q2"] and "q3" not in got
        assert got["q4"][0] == "b"  # by the date that is written otherwise
    assert recall.recall(q.limit(0), memories(spark), ordinals, as_of).count() == 0


def test_words_fall_back_to_trigrams_only_without_a_match(spark):
    q = spark.createDataFrame([("x", "databases moved", "p"), ("y", "kestrl cach", "p")], "query string, question string, project_id string")
    live = memories(spark).where("NOT obsolete")
    got = {}
    for r in recall.word_lists(q, live, 10).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.id)
    assert got["x"] == ["b"] and got["y"][0] == "a"
    assert fulltext.lexemes("moved") == ["move"]


def test_rooms_and_chunks(spark):
    paths = ["src/api/user.py", "a/b/readme.md", "tests/api/x.py", "x/y.tf", ".github/ci.yml", "main.go", "conf.toml", None, "C:\\ui\\a.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(corpora.room(F.col("p"))).collect()] == ["backend", "docs", "backend", "general", "config", "code", "config", None, "frontend"]
    talk = [("t", 0, "assistant", "hello " * 10), ("t", 1, "user", "question " * 8), ("t", 2, "assistant", "answer"), ("t", 3, "user", "short"), ("u", 0, "user", None)]
    m = spark.createDataFrame(talk, "thread string, n int, role string, content string")
    got = corpora.chat_chunks(m, "thread", "n", "role", "content").orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.chunk[:9], "\n\nAssistant: answer" in r.chunk) for r in got] == [(0, "Assistant", False), (1, "User: que", True)]
    files = spark.createDataFrame([("a/ui/x.md", "p" * 60)], "path string, content string")
    assert [(r.subject, r.tags) for r in corpora.import_chunks(files).collect()] == [("x.md", ["source:x.md", "room:frontend"])]


def test_paragraph_chunks_equal_a_loop(spark):
    import random

    rng = random.Random(2)
    texts = ["\n\n".join("w" * rng.choice((10, 60, 300, 900)) for _ in range(rng.randrange(8))) for _ in range(40)] + [None, "", " \n\n "]

    def loop(t):
        out, cur = [], ""
        for p in (x.strip() for x in (t or "").split("\n\n")):
            if not p:
                continue
            if cur and len(cur) + len(p) + 2 > 800:
                if len(cur) >= 50:
                    out.append(cur)
                cur = (cur[-100:] + "\n\n" if len(cur) > 100 else "") + p
            else:
                cur = cur + "\n\n" + p if cur else p
        return out + [cur] if len(cur) >= 50 else out

    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in text_files.paragraph_chunks(df, "k", "t").orderBy("k", "chunk_index").collect():
        got.setdefault(r.k, []).append(r.chunk)
    assert got == {i: loop(t) for i, t in enumerate(texts) if loop(t)}


def test_archives_are_listed_newest_first(spark, tmp_path):
    m = spark.createDataFrame([("a",), ("b",)], "id string")
    for at, label in ((5, "old"), (9, "new")):
        archive.write_archive({"memories": m, "projects": m.limit(1)}, str(tmp_path), label, at)
    assert [(r.name.split("-")[2], r.created_us, r.total_rows) for r in archive.list_archives(spark, str(tmp_path)).collect()] == [("new", 9, 3), ("old", 5, 3)]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from recollex import runtime

    class Fake:
        class sparkContext:  # noqa: N801
            master, applicationId = "yarn", "x"

            @staticmethod
            def getConf():  # noqa: N802
                return {}

        conf: dict = {}

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Fake)
