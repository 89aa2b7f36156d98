import math
import random

import pytest
from pyspark.sql import functions as F

from recollex.functions import scores, text
from recollex.operators import dedup, evaluation, fusion, graph, maintenance, retrieval, store
from recollex.plans import store_queries
from recollex.sources import text_files
from recollex.streaming import activity


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_decay_and_strength(spark):
    df = spark.sql("SELECT timestamp'2024-01-02' AS now, timestamp'2024-01-01' AS last, 0D AS s, cast(null AS timestamp) AS never")
    r = df.select(scores.retrievability(F.col("last"), F.col("s"), F.col("now")), scores.retrievability(F.col("never"), F.col("s"), F.col("now")), scores.strength_after(F.lit(0.0), F.lit(2)), scores.decay_boost(F.lit(1.0))).first()
    assert r[0] == pytest.approx(math.exp(-1)) and r[1] == 1.0 and r[2] == pytest.approx(0.9) and r[3] == pytest.approx(1.2)


def test_simhash_is_symmetric_and_zero_for_nothing(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, "three one two"), (3, ""), (4, None), (5, "  ")], "id int, t string")
    got = {r.id: r.simhash for r in dedup.with_simhash(df, "id", "t").collect()}
    assert got[1] == got[2] != 0 and got[3] == got[4] == got[5] == 0


def test_hamming_pairs_equal_brute_force(spark):
    bits = [0, 1, 7, 15, -1, -2, 1 << 62, (1 << 62) + 3, None, 0]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "i int, b long")
    own = sorted({b for b in bits if b is not None})
    expected = [(a, b, bin((a ^ b) & (2**64 - 1)).count("1")) for i, a in enumerate(own) for b in own[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3]
    assert values(dedup.hamming_pairs(df, "i", "b")) == sorted(expected, key=repr)


@pytest.mark.parametrize(("words", "back"), [("10 days ago", 10), ("a couple of days ago", 2), ("a few days ago", 3), ("yesterday", 1), ("3 weeks ago", 21), ("two weeks ago", 14), ("last week", 7), ("2 months ago", 60), ("last month", 30), ("last friday", 7), ("last monday", 4), ("nothing", None)])
def test_target_date(spark, words, back):
    row = spark.sql("SELECT date'2024-05-03' AS ref").select(F.datediff("ref", text.target_date(F.lit(words), F.col("ref")))).first()
    assert row[0] == back


def test_intents(spark):
    df = spark.createDataFrame([("Any tips?",), ("What is the port?",), ("Any tips for portrait photography?",), ("What is my latest job now?",), ("What did I eat in May, latest?",), ("How many days ago?",), ("",), (None,)], "q string")
    rows = [tuple(r) for r in df.select(text.is_vague(F.col("q")), text.wants_recent(F.col("q")), text.is_counting(F.col("q")), text.asks_interval(F.col("q"))).collect()]
    assert rows[0][0] is True and rows[1][0] is False and rows[2][0] is False
    assert rows[3][1] is True and rows[4][1] is False and rows[5][2] is True and rows[5][3] is True


def test_nearest_breaks_ties_and_skips_bad_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0])], "id int, v array<double>").repartition(3)
    q = rows.where("id = 1").select(F.col("id").alias("q"), "v")
    got = [(r.id, round(r.cosine, 6), r.rank) for r in retrieval.nearest(q, "q", "v", rows, "id", "v", 2).orderBy("rank").collect()]
    assert got == [(1, 1.0, 1), (2, 1.0, 2)]
    assert retrieval.nearest(q.limit(0), "q", "v", rows, "id", "v", 2).count() == 0


def test_similarity_pairs_do_not_depend_on_blocks(spark):
    rows = spark.range(40).select("id", F.array(F.sin("id"), F.cos(F.col("id") * 1.7), F.sin(F.col("id") * 0.3)).alias("v"))
    small, large = (values(retrieval.similarity_pairs(rows, "id", "v", 0.8, block).select("a", "b")) for block in (7, 1000))
    assert small == large and small


def test_rrf_and_near_ties(spark):
    lists = [spark.createDataFrame([("q", x, i + 1) for i, x in enumerate(xs)], "q string, r string, rank int") for xs in ("abc", "bda")]
    got = {r.r: r.score for r in fusion.weighted_rrf([(x, 1.0) for x in lists], "q", "r").collect()}
    assert got["b"] == pytest.approx(1 / 62 + 1 / 61) and got["b"] > got["a"] and len(got) == 4
    df = spark.createDataFrame([("q", "x", 0.1, 1, 0), ("q", "y", 0.098, 2, 5), ("q", "z", 0.08, 3, 9), ("q", "u", 0.099, 4, 9)], "q string, r string, score double, rank int, k int")
    ranks = {r.r: r["rank"] for r in fusion.near_tie_reorder(df, "q", "rank", [F.col("k")]).collect()}
    # Only the leading rows may swap: u is near the top, but behind a row that isn't.
    assert ranks == {"y": 1, "x": 2, "z": 3, "u": 4}


def test_diversify_without_trade_keeps_order(spark):
    df = spark.createDataFrame([("q", f"m{i}", 1.0 - i / 10, "same words here", None) for i in range(5)], "q string, r string, score double, c string, g string")
    got = [r.r for r in fusion.diversify(df, "q", "r", "c", "g", 3, trade=1.0).orderBy("rank").collect()]
    assert got == ["m0", "m1", "m2"]


def test_explore_is_clamped_and_survives_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("x", "x"), ("a", "b"), (None, "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("x",), ("unknown",)], "seed string")
    one, nine = (values(graph.explore(edges, seeds, d)) for d in (0, 9))
    assert one == [("a", "b", 1)]
    assert {n for _, n, _ in nine} == {"b", "c", "d", "e", "f"} and set(one) <= set(nine)


def test_store_events_versions_and_restore(spark):
    log = spark.createDataFrame([("a", 1, "x", False), ("a", 2, "y", False), ("b", 1, "z", False), ("b", 3, None, True)], "id string, seq int, v string, gone boolean")
    assert values(store.latest(log, "id", "seq", "gone").select("id", "v")) == [("a", "y")]
    state = spark.createDataFrame([("a", "old", 1, None, False, True)], "id string, content string, version int, version_of string, obsolete boolean, pinned boolean")
    new = store.new_version(state, spark.createDataFrame([("a", "n", "new")], "id string, new_id string, content string"))
    assert values(new) == sorted([("a", "old", 1, None, True, True), ("n", "new", 2, "a", False, True)], key=repr)
    left, right = spark.createDataFrame([(1, "l"), (2, "l")], "k int, v string"), spark.createDataFrame([(2, "r"), (3, "r")], "k int, v string")
    assert values(store.restored(left, right, ["k"])) == [(1, "l"), (2, "r"), (3, "r")]
    assert values(store.restored(left, right, ["k"], update=False)) == [(1, "l"), (2, "l"), (3, "r")]
    assert values(store.upgraded(left, {"n": ("int", F.lit(1))})) == [(1, "l", 1), (2, "l", 1)]


def test_clusters_and_merge(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.01 * i], "g", i) for i in range(4)] + [(9, [0.0, 1.0], "g", 9)], "id int, v array<double>, g string, t int")
    got = values(maintenance.clusters(rows, "id", "v", "g", "t", least=0.9))
    assert got == [("g", 0, i) for i in range(4)]
    m = spark.createDataFrame([("c", "A", "s1", 1, 0.5, ["x"], "fact"), ("c", " a", "s2", 2, 0.9, ["y"], "fact"), ("c", "B", None, 0, 0.1, ["x"], "note")], "cluster_id string, content string, subject string, created_at int, confidence double, tags array<string>, kind string")
    r = maintenance.merged(m).first()
    assert r.content == "Consolidated from 3 memories:\n- a\n- B" and r.subject == "s2" and r.kind == "fact" and r.confidence == 0.9 and r.tags == ["consolidated", "x", "y"]


def test_clusters_are_not_crowded_out_by_other_groups(spark):
    far = [(100 + i, [1.0, 0.0001 * i], "other", i) for i in range(60)]
    rows = spark.createDataFrame([(i, [1.0, 0.1 * i], g, i) for g, ids in (("g", (0, 1, 2)), (None, (3, 4, 5))) for i in ids] + far, "id int, v array<double>, g string, t int")
    got = values(maintenance.clusters(rows, "id", "v", "g", "t", least=0.8).where("g IS NULL OR g = 'g'"))
    assert got == sorted([("g", 0, i) for i in range(3)] + [(None, 3, i) for i in (3, 4, 5)], key=repr)
    pairs = values(retrieval.similarity_pairs(rows, "id", "v", 0.9, block=7, group="g").select("a", "b"))
    everywhere = {(a, b) for a, b in values(retrieval.similarity_pairs(rows, "id", "v", 0.9).select("a", "b"))}
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a, b in everywhere if (a >= 100) == (b >= 100) and (b >= 100 or (a < 3) == (b < 3))}


def test_maxsim_meets_every_vector(spark):
    rng = random.Random(3)
    rows = [(label, i, [rng.uniform(-1, 1) for _ in range(5)]) for label in range(3) for i in range(label * 100, label * 100 + 40)]
    df = spark.createDataFrame([*rows, (0, 999, None)], "g int, k int, v array<double>")
    got = retrieval.maxsim_scores(df, df.withColumn("g", F.col("g") - 1), "g", "k", "v", block=7).collect()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    assert {r.g: round(r.score, 9) for r in got} == {g: round(sum(max(dot(v, w) for h, _, w in rows if h == g + 1) for f, _, v in rows if f == g), 9) for g in (0, 1)}


def test_maxsim_query_scores_whole_labels(spark, tmp_path):
    rows = [(20 * i, label, [1.0 if i == 30 else 0.1, 0.5]) for i in range(31) for label in (0, 1)]
    spark.createDataFrame([(2 * k + g, g, v) for k, g, v in rows], "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    (row,) = store_queries.o59_maxsim(spark, str(tmp_path)).collect()
    assert row.score == pytest.approx(30 * (0.1 + 0.25) + 1.25)


def test_every_text_of_a_fingerprint_is_judged(spark, tmp_path):
    # A token that is the majority makes the fingerprint alone.
    base = "alpha " * 9
    texts = [base + "zebra yakk", base + "yakk zebra", base + "lion tiger", base, None, "something else that no other text here repeats at all"]
    rows = [(i, t, 7 if i % 2 else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "id long, content string, simhash long").write.parquet(str(tmp_path / "memories.parquet"))
    classes = {r.id: r["class"] for r in store_queries.o170_duplicate_classes(spark, str(tmp_path)).collect()}
    assert classes == {0: 0, 1: 0, 2: 2, 3: 3, 5: 5}
    got = {(r.class_a, r.class_b): (r.distance, r.diverge) for r in store_queries.o170_divergent_duplicates(spark, str(tmp_path)).collect()}
    assert got == {(0, 2): (0, True), (0, 3): (0, False), (2, 3): (0, False)}


def test_metrics(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "q string, r string, rank int")
    rel = spark.createDataFrame([("q", "b", 1.0), ("q", "z", 1.0), ("n", "z", 1.0)], "q string, r string, gain double")
    got = {r.q: r for r in evaluation.ranking_metrics(run, rel, "q", "r", 2).collect()}
    assert got["q"].recall == 0.5 and got["q"].ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3))) and got["n"].ndcg == 0.0
    f1 = spark.sql("SELECT 'the red car' AS p, 'a car' AS g").select(evaluation.token_f1(F.col("p"), F.col("g")), evaluation.evidence_recall(F.array(F.lit("x")), F.array().cast("array<string>"))).first()
    assert f1[0] == pytest.approx(2 / 3) and f1[1] == 1.0


def test_chunks_and_chats(spark):
    docs = spark.createDataFrame([(1, "\n\n".join(["short paragraph of words " * 4] * 30)), (2, ""), (3, None), (4, "tiny")], "id int, t string")
    chunks = text_files.paragraph_chunks(docs, "id", "t").collect()
    assert {r.id for r in chunks} == {1} and all(50 <= len(r.chunk) <= 1000 for r in chunks)
    chats = spark.createDataFrame([
        (1, '[{"role": "user", "content": "hi"}, {"role": "assistant", "content": [{"text": "yo"}]}]'),
        (2, '{"type": "human", "content": "a"}\n{"type": "bot", "content": "b"}'),
        (3, "> asked\nanswered"),
        (4, '[{"mapping": {"r": {"parent": null}, "u": {"parent": "r", "message": {"author": {"role": "user"}, "content": {"parts": ["q"]}}}}}]'),
        (5, "plain"), (6, None), (7, "[broken"),
    ], "id int, t string")
    got = values(text_files.chat_messages(chats, "id", "t"))
    assert got == [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "asked"), (3, 1, "assistant", "answered"), (4, 0, "user", "q")]


def test_project_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1")
    (tmp_path / "src" / "b.bin").write_text("no")
    (tmp_path / "src" / "c.md").write_text("  \n")
    (tmp_path / "node_modules" / "d.js").write_text("y")
    assert [r.content for r in text_files.project_files(spark, str(tmp_path)).collect()] == ["x = 1"]


def test_project_files_of_every_kind(spark, tmp_path):
    suffixes = "py js ts jsx tsx go rs rb java c cpp h hpp swift sh bash zsh md txt rst adoc yaml yml json toml cfg ini xml env csv sql html css".split()
    skipped = ".git node_modules __pycache__ .venv venv env build dist .tox .mypy_cache .pytest_cache .ruff_cache coverage htmlcov .eggs .cache .idea .vscode .DS_Store".split()
    kept = [*(f"a.{x}" for x in suffixes), "B.PY", "pkg/__init__.py", "_priv/b.py", ".github/c.yml", "target/d.rs", ".hidden.md", "bu ild/e.py"]
    for name in [*kept, *(f"{x}/f.py" for x in skipped), f"pkg/{skipped[0]}/f.py", ".env", "g.bin"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"caf\xe9 " + name.encode())
    rows = text_files.project_files(spark, str(tmp_path)).collect()
    assert {r.path: r.content for r in rows} == {(tmp_path / x).as_uri(): f"caf\ufffd {x}" for x in kept}
    assert text_files.project_files(spark, str(tmp_path / "missing")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    events = spark.range(500).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 7).alias("ts"), (F.col("id") % 5).alias("user_id"), F.when(F.col("id") % 3 > 0, "view").alias("event_type"), F.lit(1.5).alias("value"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = activity.event_stream(spark, str(tmp_path / "in"), events.schema)
    totals = activity.activity_totals(stream).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    states = activity.access_states(stream, "user_id").writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    totals.awaitTermination(120)
    states.awaitTermination(120)
    assert values(spark.table("totals")) == values(activity.activity_totals(events))
    assert values(spark.table("states")) == values(activity.access_states(events, "user_id"))
    assert activity.log_lines(events).where("value LIKE '2023-11-14T22:13:20Z [?] user=0'").count() == 1


def test_date_forms(spark):
    from recollex.functions import features

    texts = ["We met on May 1st, 2022 and 03/04/2023.", "two  Weeks ago and 2 jan 2022", "2024-13-01, 1 may 1700", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", features.date_terms(F.col("t"), None).alias("d")).collect()}
    assert {"2022-05-01", "may 1 2022", "1 may 2022", "5/1/2022", "1/5/2022", "may 2022", "2023-03-04", "2023-04-03"} <= set(got[0]) and "may 1" not in got[0]
    assert got[1] == ["2022-01-02", "january 2 2022", "jan 2 2022", "2 january 2022", "2 jan 2022", "1/2/2022", "2/1/2022", "january 2022", "two weeks ago"]
    assert got[2] == got[3] == got[4] == []
    many = spark.createDataFrame([(" ".join(f"2024-01-{d:02d}" for d in range(1, 29)),)], "t string")
    assert len(many.select(features.date_terms(F.col("t"))).first()[0]) == 40
    df = spark.createDataFrame([("I prefer Dark roast coffee, dark. It rained.",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(features.preference_terms(F.col("t"))).collect()] == [["prefer", "Dark", "roast", "coffee"], [], []]
    assert df.select(features.hashing_embedder(8)(F.col("t")).alias("e")).where("e IS NOT NULL").count() == 1


def test_distinctive_words_tell_red_from_blue(spark):
    from recollex.functions import features

    df = spark.createDataFrame([("I like the red one", "I like the blue one"), ("PostgreSQL on port 5432", "database uses port 5432"), ("", "red"), (None, "red")], "a string, b string")
    words = [features.distinctive_words(F.col(c)) for c in "ab"]
    assert [r[0] for r in df.select(F.coalesce(dedup.nouns_diverge(*words), F.lit(False))).collect()] == [True, False, False, False]
    assert df.select(features.context_words(F.lit("The PowerBank has USB ports, a powerbank for Lisbon and iPads"))).first()[0] == ["PowerBank", "USB", "ports", "Lisbon", "iPads"]


def test_stems_of_the_published_sample():
    from recollex.functions.stemming import lexemes, stem

    # Words and stems of the algorithm's published sample vocabulary.
    told = "consigned consign consistency consist consolation consol consolidating consolid conspiracy conspiraci constables constabl knackeries knackeri kneeling kneel knightly knight knives knive knitted knit generously generous hoping hope sky sky cries cri by by"
    words = told.split()
    assert [stem(w) for w in words[::2]] == words[1::2]
    assert lexemes("The databases are running, été!") == ["_", "databas", "_", "run", "été"] and lexemes("") == []


@pytest.mark.parametrize("stemmed", [False, True])
def test_web_search(spark, stemmed):
    from recollex.operators import fulltext

    rows = spark.createDataFrame([(1, "red car", "a fast red car", "p"), (2, None, "the blue car is fast", "q"), (3, "bike", "fast bike, not a car red", "p"), (4, None, None, "p")], "id int, subject string, content string, g string").repartition(2)
    q = spark.createDataFrame(
        [("and", "fast car", None), ("phrase", '"red car"', None), ("or", "blue or bike", None), ("not", "car -blue", None), ("none", "--", None), ("null", None, None), ("own", "fast", "q"), ("barred", 'car -"red car"', None), ("unknown", "zebra car", None), ("cars", "CARS", None)],
        "q string, t string, g string",
    )
    vectors = fulltext.text_vectors(rows, ["id", "g"], {"subject": "A", "content": "D"}, stemmed=stemmed)
    got = {}
    for r in fulltext.search(q, "q", "t", vectors, "id", 10, group="g", stemmed=stemmed).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.id)
    expected = {"and": [1, 2, 3], "phrase": [1], "or": [3, 2], "not": [1, 3], "own": [2], "barred": [2, 3]}
    assert got == (expected | {"cars": [1, 2, 3]} if stemmed else expected)
    assert fulltext.search(q.limit(0), "q", "t", vectors, "id", 10, group="g", stemmed=stemmed).count() == 0


def test_answers_metrics_and_ids(spark):
    from recollex.operators import evaluation

    df = spark.createDataFrame([("The cat, and a dog.", "cat dog"), ("1,000 rows", "1000 rows"), ("", ""), ("x", "")], "p string, g string")
    assert [r[0] for r in df.select(evaluation.token_f1(F.col("p"), F.col("g"))).collect()] == [pytest.approx(0.8), 1.0, 1.0, 0.0]
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("z", "a", 1)], "q string, r string, rank int")
    relevant = spark.createDataFrame([("q", "b"), ("q", "c"), ("q", "c"), ("z", "x")], "q string, r string")
    got = {r.q: (r.recall_any, r.recall_all, round(r.ndcg, 6)) for r in evaluation.retrieved_metrics(run, relevant, "q", "r", 3).collect()}
    assert got == {"q": (1.0, 1.0, round((1 / 1.5849625 + 0.5) / (1 + 1 / 1.5849625), 6)), "z": (0.0, 0.0, 0.0)}
    ids = spark.createDataFrame([("s_1_turn_4", ["D3:7", "D3:9", "x"], '{"first": [58, 3], "n": 4}', "0. One.\n1. Two.\n"), ("s_2", [], None, "A\n\n B ")], "c string, e array<string>, j string, f string")
    told = ids.select(evaluation.session_of(F.col("c")), evaluation.evidence_sessions(F.col("e")), evaluation.source_ids(F.col("j")), evaluation.numbered_facts(F.col("f"))).collect()
    assert [tuple(r) for r in told] == [("s_1", ["session_3"], [58, 3, 4], ["One.", "Two."]), ("s_2", [], [], ["A", "B"])]


def test_conflicts_and_clusters_stay_in_their_group(spark):
    """More nearer rows of another group than a row may have neighbours."""
    rows = [(i, [1.0, i / 10_000], "far", i) for i in range(30)] + [(100 + i, [1.0, 0.001 + i / 1000], "own", i) for i in range(4)]
    df = spark.createDataFrame(rows, "id int, v array<double>, g string, t int")
    got = maintenance.clusters(df, "id", "v", "g", "t", least=0.9, neighbours=5).where("g = 'own'").toPandas()
    assert sorted(got["id"]) == [100, 101, 102, 103]


def test_hamming_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for b in base * 6} | {0, (1 << 64) - 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, p) for i, p in enumerate([*signed, signed[0], None])], "i int, p long")
    expected = {(min(a, b), max(a, b), bin((a ^ b) & ((1 << 64) - 1)).count("1")) for a in signed for b in signed if a != b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3}
    assert expected and set(values(dedup.hamming_pairs(df, "i", "p", 3))) == expected


def test_archive_round_trip(spark, tmp_path):
    from recollex.sources import archive

    m = spark.createDataFrame([("a", "x"), ("b", None)], "id string, content string")
    path = archive.write_archive({"memories": m}, str(tmp_path), "my label!", 7)
    assert path.endswith("-mylabel")
    back = archive.read_archive(spark, path)["memories"]
    assert values(back.select("id", "content", "version", "pinned")) == [("a", "x", 1, False), ("b", None, 1, False)]
    m.limit(1).write.mode("overwrite").parquet(f"{path}/memories")
    with pytest.raises(ValueError):
        archive.read_archive(spark, path)


def test_budget(spark):
    from recollex.operators import context

    df = spark.createDataFrame([("q", i, "x" * 40) for i in range(5)], "q string, i int, c string")
    lines = [r.line for r in context.within_budget(df, "q", [F.asc("i")], "c", 110).orderBy("i").collect()]
    assert [len(x) for x in lines] == [40, 40, 27]


def test_access_predicate_and_retention(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "p string")
    assert df.where(store.may_read(F.col("p"), "agent", ["a"])).count() == 2 and df.where(store.may_read(F.col("p"), "admin", [])).count() == 3
    archives = spark.sql("SELECT concat('n', id) AS name, timestamp_seconds(1700000000 - id * 86400) AS at FROM range(50)")
    kept = store.kept_archives(archives, "name", "at", F.timestamp_seconds(F.lit(1_700_000_000)), newest=3, days=10.5)
    assert kept.count() == 11
