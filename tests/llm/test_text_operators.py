import random
import re
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recollex.llm import leaks, packing, plaintext, ranking, reading, splitting, threads


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- splitting ---------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n\ré́\U0001f600", max_size=400), st.integers(20, 60), st.integers(0, 15))
def test_pieces_round_trip(text, limit, overlap):
    spans = splitting.cuts(text, limit, overlap)
    assert all(b - a <= limit for a, b in spans)
    assert text[: spans[0][1]] + "".join(text[a + overlap : b] for a, b in spans[1:]) == text
    assert all(b2 - overlap == a for (_, b2), (a, _) in zip(spans, spans[1:], strict=False))


def test_boundaries_go_from_strong_to_weak():
    text = "a" * 60 + "\n\n" + "b" * 10 + ". " + "c" * 20
    assert text[: splitting.cuts(text, 80, 10)[0][1]].endswith("\n\n")
    assert splitting.cuts("x" * 100, 40, 10) == [(0, 40), (30, 70), (60, 100)]
    with pytest.raises(ValueError):
        splitting.cuts("x", 10, 10)


def test_split_items_of_any_kind(spark):
    rows = [(1, None, "n"), (2, "", "n"), (3, "word " * 300, "n"), (3, "word " * 300, "n"), (4, "y" * 100_000, "n"), (5, "z" * 800, "n")]
    df = spark.createDataFrame(rows, "chunk_id long, content string, piece string")
    got = splitting.split_items(df, "chunk_id", "content").toPandas()
    counts = got.groupby("chunk_id").size().to_dict()
    assert counts[1] == counts[2] == counts[5] == 1 and counts[3] == 2 * got[got.chunk_id == 3].n_pieces.iloc[0] and counts[4] > 100
    assert splitting.split_items(df.limit(0), "chunk_id", "content").count() == 0


def test_split_by_tokens(spark):
    offsets = splitting.token_offsets(lambda t: [m.span() for m in re.finditer(r"\S+\s*", t)])
    df = spark.createDataFrame([(1, " ".join(f"w{i}." for i in range(50)))], "k long, t string")
    got = splitting.split_items(df, "k", "t", limit=12, overlap=3, unit_offsets=offsets).orderBy("chunk_index").collect()
    assert all(len(r.piece.split()) <= 12 for r in got) and all(b.piece.split()[:3] == a.piece.split()[-3:] for a, b in zip(got, got[1:], strict=False))


# --- threads -----------------------------------------------------------------


def test_threads_are_judged_and_ordered(spark):
    t = lambda name, *rows: [(name, i, r, c, f"2024-01-01 00:{i:02d}:00") for i, r, c in rows]
    rows = [
        *t("good", (2, " Assistant", "b"), (1, "HUMAN ", "a"), (1, "human", "a"), (0, "assistant", "hello"), (3, "system", None)),
        *t("unanswered", (0, "user", "a"), (1, "user", "b"), (2, "bot", "c")), *t("blank answer", (0, "user", "a"), (1, "ai", "​  ")),
        *t("gap", (0, "user", "a"), (2, "ai", "b")), *t("clash", (0, "user", "a"), (1, "ai", "b"), (1, "ai", "c")), *t("role", (0, "user", "a"), (1, "ai", "b"), (2, "???", "c")),
        *t("empty", (0, "user", None), (1, "ai", " ")), *t("no user", (0, "ai", "a")), *t("system between", (0, "user", "a"), (1, "system", "s"), (2, "model", "b")),
        *[("long", i, "user" if i % 2 == 0 else "ai", "x", None) for i in range(1400)], *[("broken far", i, "user" if i % 2 == 0 or i == 255 else "ai", "x", None) for i in range(600)],
    ]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "conversation_id string, id long, role string, content string, at string, offset_s string").withColumn("received_at", threads.F.col("at").cast("timestamp"))
    report = {r.thread_id: r.dropped for r in threads.thread_report(threads.turn_messages(df)).collect()}
    assert report == {"good": None, "unanswered": "no reply", "blank answer": "no reply", "gap": "gap", "clash": "clash", "role": "role", "empty": "empty", "no user": "no user", "system between": None, "long": None, "broken far": "no reply"}
    rebuilt = threads.rebuilt_threads(threads.turn_messages(df))
    assert [(r.turn_no, r.role, r.content) for r in rebuilt.where("thread_id = 'good'").orderBy("turn_no").collect()] == [(1, "assistant", "hello"), (2, "user", "a"), (3, "assistant", "b"), (4, "system", None)]
    assert threads.thread_report(threads.turn_messages(df.limit(0))).count() == 0


def test_clock_offset_is_taken_out(spark):
    rows = [("t", i, "user" if i % 2 == 0 else "assistant", "x", 1_700_000_000 + 10 * i + (3600 if i % 2 else 0)) for i in range(20)]
    df = spark.createDataFrame(rows, "conversation_id string, id long, role string, content string, s long").withColumn("received_at", threads.F.timestamp_seconds("s"))
    m = threads.turn_messages(df)
    assert threads.thread_report(m).first().offset_s == pytest.approx(3600)
    said = [r.said_at.timestamp() for r in threads.rebuilt_threads(m).orderBy("turn_no").collect()]
    assert np.diff(said) == pytest.approx([10.0] * 19)


def test_late_rows_and_threads_without_id(spark):
    """A delivery late by days neither bends the offset nor the order; said_at never falls; null is a thread of its own."""
    rows = [(name, i, "user" if i % 2 == 0 else "assistant", "x", 1_700_000_000 + 10 * i + (60 if i % 2 else 0) + (300_000 if i == 7 else 0)) for name in ("t", None) for i in range(600)]
    df = spark.createDataFrame(rows, "conversation_id string, id long, role string, content string, s long").withColumn("received_at", threads.F.timestamp_seconds("s"))
    m = threads.turn_messages(df)
    assert all(r.offset_s == pytest.approx(60, abs=1) and r.dropped is None for r in threads.thread_report(m).collect())
    for name in ("t", None):
        got = threads.rebuilt_threads(m).where(threads.F.col("thread_id").eqNullSafe(name)).orderBy("turn_no").collect()
        said = [r.said_at.timestamp() for r in got]
        assert [r.turn_no for r in got] == list(range(1, 601)) and said == sorted(said) and said[7] == pytest.approx(said[8], abs=1)


def test_offset_keeps_the_order_of_messages(spark):
    """Quick replies and slow questions: plain least squares would put replies behind the next question."""
    at = np.cumsum([0, 1, 10, 1, 10, 1, 10_000, 1])
    rows = [("t", i, "user" if i % 2 == 0 else "assistant", "x", 1_700_000_000 + int(at[i])) for i in range(8)]
    rows += [("ends of spans", i, "user" if i % 2 else "assistant", "x", 1_700_000_000 + 10 * i + (0 if i % 2 else 20)) for i in (254, 255, 256)]
    df = spark.createDataFrame(rows, "conversation_id string, id long, role string, content string, s long").withColumn("received_at", threads.F.timestamp_seconds("s"))
    m = threads.turn_messages(df)
    report = {r.thread_id: r for r in threads.thread_report(m).collect()}
    assert -10 <= report["t"].offset_s <= 1 and {k: r.dropped for k, r in report.items()} == {"t": None, "ends of spans": None} and report["ends of spans"].offset_s == pytest.approx(20)
    said = [r.said_at.timestamp() for r in threads.rebuilt_threads(m).where("thread_id = 't'").orderBy("turn_no").collect()]
    assert said[::2] == [r[4] for r in rows[:8:2]] and said == sorted(said)


def test_times_far_apart_end_no_run(spark):
    rows = [("t", i, "user" if i % 2 == 0 else "assistant", "x", s) for i, s in enumerate([-9_000_000_000_000, 9_000_000_000_000, 5, 6])]
    df = spark.createDataFrame(rows, "conversation_id string, id long, role string, content string, s long").withColumn("received_at", threads.F.timestamp_seconds("s"))
    m = threads.turn_messages(df)
    assert [r.dropped for r in threads.thread_report(m).collect()] == [None]
    said = threads.rebuilt_threads(m).selectExpr("turn_no", "unix_seconds(said_at) AS s").orderBy("turn_no").collect()
    assert [r.s for r in said] == [-9_000_000_000_000, 5, 5, 6]


def test_conversations_are_judged_by_corrected_times(spark):
    """The fit and the merge are steps of the plan that finds the conversations to drop."""
    turns = spark.createDataFrame([("t", 0, "user", "a", None)], "conversation_id string, id long, role string, content string, received_at timestamp")
    questions = spark.createDataFrame([(["a"], [[("user", "hi")]])], "haystack_session_ids array<string>, haystack_sessions array<array<struct<role string, content string>>>")
    found = threads.dropped_threads(turns, questions)
    assert str(threads.LATE_S) in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.thread_id for r in found.collect()} == {"t", "a"}


def test_null_and_empty_sessions_are_dropped(spark):
    q = spark.createDataFrame(
        [(["a", "b", "c", "d"], [None, [], [("user", "hi"), ("bot", "yo")], [None, ("ai", "x")]])], "haystack_session_ids array<string>, haystack_sessions array<array<struct<role string, content string>>>"
    )
    report = {r.thread_id: r.dropped for r in threads.thread_report(threads.session_messages(q)).collect()}
    assert report == {"a": "no message", "b": "no message", "c": None, "d": "role"}


# --- ranking -----------------------------------------------------------------


def test_fusion_ignores_scale_and_spreads_hot_queries(spark):
    rng = random.Random(2)
    rows = [(q, f"m{i}", rng.choice([None, float("nan"), rng.random(), 0.5]), rng.random() * 1e6, rng.random() - 5, "x") for q in (1, 2, None) for i in range(40)]
    df = spark.createDataFrame([*rows, *rows[:10]], "q long, m string, a double, b double, c double, rrf string")
    usual, spread = (values(ranking.fuse_rankings(df, "q", "m", ("a", "b", "c"), hot_rows=h)) for h in (1000, 5))
    assert usual == spread and len(usual) == 120
    scaled = ranking.fuse_rankings(df.withColumn("b", df["b"] * 1e-9), "q", "m", ("a", "b", "c"))
    assert values(scaled) == usual
    assert ranking.best_candidate(scaled, "q", "m").count() == 3
    assert ranking.fuse_rankings(df.limit(0), "q", "m", ("a", "b", "c")).count() == 0


# --- packing -----------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=20))
def test_plans_hold_everything_once(histogram):
    segments, containers, fixed = packing.plan(histogram, 30)
    fill, placed = [0] * containers, {}
    for size, first, n, container in segments:
        assert first == placed.get(size, 0)
        placed[size] = first + n
        for i in range(n):
            fill[container + i] += size
    assert placed == histogram and all(0 < f <= 30 for f in fill) and fixed <= containers
    total = sum(s * n for s, n in histogram.items())
    assert containers <= max(-(-total // 30) * 11 // 9 + 1, sum(n for s, n in histogram.items() if 2 * s > 30) + 1 + total // 15)


def test_packing_splits_only_what_must_be(spark):
    rows = [(1, "word " * 5000), (2, None), (3, ""), (4, "a few words"), (4, "a few words"), *[(10 + i, "token " * (i * 37 % 1500 + 1)) for i in range(60)]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, size int").repartition(3)
    got = packing.pack_texts(df, "doc_id", "text").toPandas()
    assert len(got.doc_id.unique()) == 64 and (got[got.doc_id == 4].shape[0]) == 2
    assert got[got.doc_id == 2].container_id.isna().all() and (got[got.doc_id == 3].n_tokens == 0).all()
    used = got.dropna().groupby("container_id").n_tokens.sum()
    assert used.max() <= 2048
    assert [r.doc_id for r in packing.split_documents(packing.pack_texts(df, "doc_id", "text"), "doc_id").collect()] == [1]
    one = got[got.doc_id == 1].sort_values("piece_no")
    assert one.n_tokens.iloc[:-1].eq(2048).all() and one.first_token.tolist() == [2048 * i for i in range(len(one))]
    assert packing.pack_texts(df.limit(0), "doc_id", "text").count() == 0


# --- leaks -------------------------------------------------------------------


def test_markup_makes_no_difference():
    assert plaintext.plain_words("<p>Café &amp; b­ar</p> docu-\n> ment <b>wo</b>rd​s <!-- gone -->") == ["café", "bar", "document", "words"]


def test_stretches():
    item = np.arange(1, 31)
    assert leaks.holds_stretch(item, np.r_[0, 0, item[5:23], 0])
    assert not leaks.holds_stretch(item, np.r_[0, 0, item[5:22], 0])
    changed = item[:24].copy()
    changed[[3, 9, 15, 20]] = 0
    assert leaks.holds_stretch(item, changed)
    changed[[1, 6, 12, 18]] = 0
    changed[[2, 7]] = 0
    assert not leaks.holds_stretch(item, changed)
    assert leaks.holds_stretch(item, np.delete(item[:26], [4, 11]))
    assert not leaks.holds_stretch(item, item[::-1]) and not leaks.holds_stretch(item, np.array([], int))


def test_leaks_are_found_and_nothing_else(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(45)), "ans wer" if i % 2 else None) for i in range(12)]
    noise = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs, expected = [], set()
    for i, t, _ in items:
        w = t.split()
        docs += [(100 + i, noise(80) + " <i>" + " ".join(w[4:38]).upper() + "</i>, " + noise(50) + " ans wer"), (200 + i, noise(30) + " " + " ".join(w[:20]) + " " + noise(60)), (300 + i, " ".join(rng.sample(w, len(w))))]
        expected.add((100 + i, i))
    docs += [(1, None), (2, ""), (3, noise(5000)), (4, docs[0][1]), (4, docs[0][1])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, ids string")
    it = spark.createDataFrame([*items, (99, None, None), (98, "!!", "a")], "item_id long, text string, answer string")
    rows = leaks.leaked_items(df, "doc_id", "text", it, "item_id", "text", "answer").collect()
    assert {(r.doc_id, r.item_id) for r in rows} == expected | {(4, 0)} and len(rows) == len(expected) + 2
    assert all(r.answer_seen is (True if r.item_id % 2 else None) for r in rows)
    assert leaks.leaked_items(df.limit(0), "doc_id", "text", it, "item_id", "text", "answer").count() == 0
    assert leaks.leaked_items(df, "doc_id", "text", it.limit(0), "item_id", "text", "answer").count() == 0


def test_every_smallest_stretch_is_found(spark):
    rng = random.Random(5)
    items, docs, expected = [], [], set()
    for i, n in enumerate([6, 9, 12, 20, 40, 41, 60, 150, 400]):
        words = [f"w{rng.randrange(3000)}" for _ in range(n)]
        items.append((i, " ".join(words), None))
        least = -(-6 * n // 10)
        for turn in range(6):
            start = rng.randrange(n - least + 1)
            stretch = words[start : start + least]
            for x in range(least // 6):  # evenly, so that every run between two edits is as short as can be
                at = (x + 1) * (least + 1) // (least // 6 + 1) - 1
                stretch[at] = "" if turn % 3 == 1 else f"other{x}" if turn % 3 == 0 else f"{stretch[at]} other{x}"
            docs.append((len(docs), " ".join([*(f"far{x}" for x in range(200)), *stretch, *(f"off{x}" for x in range(200))])))
            expected.add((docs[-1][0], i))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string, answer string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(df, "doc_id", "text", it, "item_id", "text", "answer").collect()} == expected


def test_shared_runs_are_in_every_stretch():
    assert [leaks.shared_run(n) for n in (1, 2, 5, 10, 40, 41, 60, 1000)] == [1, 2, 3, 3, 4, 5, 5, 5]
    rng = np.random.default_rng(2)
    for _ in range(1500):
        item = rng.integers(1, 6, rng.integers(1, 14))
        doc = rng.integers(0, 6, rng.integers(1, 16))
        if leaks.holds_stretch(item, doc):
            q = leaks.shared_run(len(item))
            assert set(leaks._run_keys(item, q).tolist()) & set(leaks._run_keys(doc, q).tolist())
            for g in leaks.GRAMS:
                assert np.isin(leaks._run_keys(doc, g), leaks._run_keys(item, g)).sum() >= leaks.shared_grams(len(item), g)


def test_latent_space_holds_the_passages(spark):
    rng = np.random.default_rng(1)
    passages = [rng.integers(1, 200, 40) for _ in range(15)]
    df = spark.createDataFrame([([int(x) for x in p],) for p in passages], "ids array<int>").repartition(3)
    idf = np.ones(200)
    space = leaks.latent_space(df, idf, rank=150)
    assert np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-4)
    for p in passages:
        words, weight = leaks._vector(p, idf)
        assert np.linalg.norm(weight @ space[words]) == pytest.approx(np.linalg.norm(weight), rel=1e-3)


# --- reading -----------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("One two. Three four! Five?", 3), ("We met Dr. Who at 3.14 today, e.g. here. Then left.", 2), ("- an entry\n- another entry\n* a third", 3), ("A line of its own\nAnother line\nA third line", 3),
        ("this sentence was wrapped by a narrow\npage and goes on here until it ends.\nso does another one that is long\nenough to wrap.", 2), ("# Heading\n\nOne sentence here.", 1),
        ("```\nx = 1\n```\nProse here.", 1), ("2024-01-01 10:00:00 INFO a=1\nProse here.", 1), ("", 0), ("...", 0),
    ],
)
def test_sentences(text, n):
    assert len(reading.sentences(text)) == n


def test_syllables():
    assert [reading.syllables(w) for w in ("cat", "table", "code", "idea", "rhythm", "x", "organization")] == [1, 2, 1, 2, 1, 1, 5]


def test_model_learns_held_out_grades():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(reading.FEATURES)))
    grade = np.clip(np.round(9 + 4 * x[:, 0] + 0.3 * rng.normal(size=600)), 1, 18).astype(int)
    model = reading.fit_ordinal(x[:400], grade[:400])
    assert np.abs(model.grade(x[400:]) - grade[400:]).mean() < 1.0
    assert (np.diff(model.cuts) > 0).all()


def test_levels(spark):
    easy, hard = "The cat sat. The dog ran. I am here. ", "Notwithstanding the intermediary authorization documented previously, the disambiguation of organizational infrastructure incorporates epistemological characterization, thereby complicating subsequent serialization. "
    rows = [(i, (easy if i % 2 else hard) * (2 + i % 3)) for i in range(40)] + [(90, None), (91, ""), (92, "```\nx\n```"), (93, "Der Bericht ist nicht auf dem Server und die Dienste sind neu."), (94, "word " * 50_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, grade string, n_words int")
    labels = spark.createDataFrame([(i, 2 if i % 2 else 17) for i in range(20)] + [(1, None), (2, 99), (3, 3)], "doc_id long, grade int")
    got = {r.doc_id: r for r in reading.reading_levels(docs, "doc_id", "text", labels, "grade").collect()}
    assert set(got) == {*range(40), 93, 94} and got[93].language == "de" and got[0].language == "en"
    assert all((got[i].grade >= 13) == (i % 2 == 0) for i in range(40))
    found = reading.demanding_documents(reading.reading_levels(docs, "doc_id", "text", labels, "grade"), "doc_id")
    assert {r.doc_id for r in found.collect()} >= set(range(0, 40, 2))
    bare = reading.reading_levels(docs, "doc_id", "text", labels.limit(0), "grade").collect()
    assert all(r.grade is None for r in bare) and reading.reading_levels(docs.limit(0), "doc_id", "text", labels, "grade").count() == 0


def test_english_without_function_words_is_english(spark):
    plain = ["The organizational serialization of the platform was characterized by the accommodation of computational infrastructure and it is differentiated.", "Every one of the regularization steps that we have seen approximates a representational normalization in the instrumentation."]
    german = ["Die Darstellung der Verarbeitung ist nicht die Bereinigung und wir haben auch die Verwaltung der Berichte mit den Diensten für eine Sitzung.", "Das ist eine Auswertung und die Verteilung der Anlagen wurde auf dem Server mit dem Schreiber im Bestand."]
    spanish = ["La organización de los datos es una parte del servicio y no hay que cambiar la memoria por el nodo.", "El informe de la sesión está en el servidor con los datos que se vimos muy tarde."]
    french = ["Nous avons vu le rapport dans la mémoire et il est pour une partie des données du service qui ne sont pas là.", "Le nœud est une partie de la mémoire et nous avons les données sur le serveur avec un journal."]
    rows = [(i, t) for i, t in enumerate([*plain, *german, *spanish, *french] * 5)]
    rows += [(100, "Representational normalization differentiates organizational characterization. Computational serialization accommodates instrumentation."), (101, "Bereinigung Verarbeitung Darstellung Auswertung Verteilung"), (102, "12 34 56.")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, grade int")
    got = {r.doc_id: r.language for r in reading.reading_levels(docs, "doc_id", "text", labels, "grade").collect()}
    assert [got[i] for i in range(8)] == ["en", "en", "de", "de", "es", "es", "fr", "fr"]
    assert (got[100], got[101], got[102]) == ("en", "de", None)


def test_few_texts_of_a_language_teach_it_among_many(spark):
    """Four German texts among 12 000 English ones: no text is left out of the model of languages."""
    text = threads.F.when(threads.F.col("id") < 12_000, "The cat was on the mat and it is here.").when(threads.F.col("id") < 12_004, "Die Darstellung der Verarbeitung ist nicht die Bereinigung und wir haben auch die Verwaltung.")
    docs = spark.range(12_005).select(threads.F.col("id").alias("doc_id"), text.otherwise("Bereinigung Verarbeitung Darstellung").alias("text"))
    labels = spark.createDataFrame([], "doc_id long, grade int")
    got = {r.doc_id: r.language for r in reading.reading_levels(docs, "doc_id", "text", labels, "grade").where("doc_id >= 11999").collect()}
    assert got == {11_999: "en", **{i: "de" for i in range(12_000, 12_005)}}
    read = spark.createDataFrame([(3.0, 0.0, 0.0, 0.0, "cat"), (0.0, 3.0, 0.0, 0.0, "hut"), (2.0, 0.0, 0.0, 0.0, "fez"), (0.0, 0.0, 0.0, 0.0, "")], "en float, de float, fr float, es float, spelt string")
    cat, hut, fez = (reading.language_votes(read)[reading._grams([w])[0]].sum(axis=0) for w in ("cat", "hut", "fez"))
    assert cat.argmax() == 0 and hut.argmax() == 1 and np.abs(fez).max() < 0.05


def test_all_ratings_are_fitted(spark, monkeypatch):
    """More ratings than go to the driver give the model of all ratings, not that of some."""
    for name in ("fit_ordinal", "fit_ordinal_rows"):
        monkeypatch.setattr(reading, name, partial(getattr(reading, name, reading.fit_ordinal), steps=25), raising=False)
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(" ".join(rng.choice(["cat", "organization", "table", "infrastructure"][: 2 + i % 3]) for _ in range(3 + i % 9)).capitalize() + "." for _ in range(4))) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, max(1, min(18, 2 * (i % 9) + rng.randrange(-2, 3)))) for i in range(120)], "doc_id long, grade int")
    every, few = (reading.reading_levels(docs, "doc_id", "text", labels, "grade", most_labels=n).orderBy("doc_id").toPandas() for n in (120, 10))
    assert (every.grade == few.grade).all() and np.allclose(every.above_12, few.above_12, atol=1e-9) and every.grade.nunique() > 5


def test_rarity_counts_words_and_not_places(spark):
    """Words below the least share are equally rare however many there are; frequent ones are counted exactly."""
    common, rare = reading.RAREST * 4, np.log(1 / reading.RAREST)
    frequent = np.array([5, 9], np.int64)
    table = np.r_[np.log(1 / np.array([common, common])), rare]
    sums = {c: [1.0, 1.0] for c in reading.SUMS} | {"n_spoken": [2.0, 2.0]}
    batch = pa.RecordBatch.from_pydict(sums | {"words": pa.array([[5, 9], [7, 10]], pa.list_(pa.int64())), "counts": pa.array([[1, 1], [1, 1]], pa.list_(pa.int32()))})
    got = reading._features(batch, frequent, table)[:, reading.FEATURES.index("rarity")]
    assert np.allclose(got, [np.log(1 / common), rare])
