import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollex.llm import alike, history, near_duplicates

SCHEMA = "id string, content string, words string, rid long"


def words(t):
    return frozenset(re.findall(r"[^\W_]+", (t or "").lower()))


def like(a, b):
    return bool(a) and 10 * len(a & b) >= 7 * len(a | b)


def edited(rng, n_notes, copies, long_every=0):
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    out = []
    for i in range(n_notes):
        size = 300 if long_every and i % long_every == 0 else rng.choice((3, 5, 9, 20, 40, 90))
        note = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            t = list(note)
            for _ in range(rng.randint(0, max(1, len(t) // 5))):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice(([], [rng.choice(vocabulary)], [t[k], rng.choice(vocabulary)]))
            if rng.random() < 0.3:
                rng.shuffle(t)
            out.append(" ".join(t))
    return out


def brute_groups(rows):
    sets = [words(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if like(sets[i], sets[j]):
                parent[find(i)] = find(j)
    return {(a, b) for i, (a, _) in enumerate(rows) for j, (b, _) in enumerate(rows) if a < b and find(i) == find(j)}


@pytest.mark.parametrize(("seed", "cell"), [(1, 4096), (2, 3), (3, 12)])
def test_groups_equal_brute_force(spark, seed, cell):
    rng = random.Random(seed)
    texts = [*edited(rng, 25, 4, long_every=9), None, "", "  ", "!!!", "one", "one", "One.", "same words twice words"]
    rows = [(f"m{i:03d}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], SCHEMA)
    groups = near_duplicates.near_duplicate_groups(df, "id", "content", cell=cell)
    got = {tuple(r) for r in near_duplicates.grouped_pairs(groups, "id", "a", "b").collect()}
    assert got == brute_groups(rows)


def test_links_and_classes(spark):
    texts = ["a b c d e f g h i j", "a b c d e f g h i j", "a b c d e f g h i k", "x y z", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, content string")
    rows = {r.id: r for r in near_duplicates.near_duplicate_groups(df, "id", "content").collect()}
    assert set(rows) == {"0", "1", "2", "3"}
    assert rows["0"].class_id == rows["1"].class_id != rows["2"].class_id
    assert [rows[i].links for i in "0123"] == [1, 1, 1, 0]
    assert rows["0"].group_id == rows["2"].group_id != rows["3"].group_id


def test_a_crowd_of_near_copies(spark):
    """A third of all rows are one note with an own word each: crowded anchors go through finer ones and blocks."""
    rng = random.Random(5)
    crowd = ["alpha beta gamma delta epsilon zeta eta theta iota kappa own" + str(i) for i in range(120)]
    rows = [(f"m{i:03d}", t) for i, t in enumerate([*crowd, *edited(rng, 60, 2)])]
    df = spark.createDataFrame(rows, "id string, content string")
    for cell, block in ((4096, 2048), (40, 11)):
        groups = near_duplicates.near_duplicate_groups(df, "id", "content", cell=cell)
        pairs = [tuple(r) for r in near_duplicates.grouped_pairs(groups, "id", "a", "b", block).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == brute_groups(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id string, content string")
    assert near_duplicates.near_duplicate_groups(none, "id", "content").count() == 0
    chunks = spark.createDataFrame([], "chunk_id long, content string")
    assert history.repeated_chunks(chunks, "chunk_id", "content", none, "content").count() == 0


def test_a_very_long_text(spark):
    text = " ".join(f"t{i}" for i in range(20_000))
    df = spark.createDataFrame([("a", text), ("b", text + " more"), ("c", text[: len(text) // 2])], "id string, content string")
    groups = near_duplicates.near_duplicate_groups(df, "id", "content")
    assert [tuple(r) for r in near_duplicates.grouped_pairs(groups, "id", "x", "y").collect()] == [("a", "b")]


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(-(2**62), 2**62, rng.integers(1, 200)))
        b = np.unique(np.r_[rng.choice(a, rng.integers(1, len(a) + 1)), rng.integers(-(2**62), 2**62, rng.integers(1, 50))])
        values, starts, n = np.r_[a, b], np.array([0, len(a)]), np.array([len(a), len(b)])
        low, mid, rest = alike._sketches(values, starts, n)
        bits = sum(int(np.bitwise_count(np.uint64(x[0]) ^ np.uint64(x[1]))) for x in (low.view(np.uint64), mid.view(np.uint64)))
        if min(n) > 64:
            bits += int(np.bitwise_count(rest.view(np.uint64)[0] ^ rest.view(np.uint64)[1]))
        assert bits <= len(np.setxor1d(a, b))


def test_thresholds_outside_the_classes_are_refused(spark):
    sets = spark.createDataFrame([], "rid long, flag byte, words array<long>")
    with pytest.raises(ValueError):
        alike.alike_pairs(sets, 1, 2)


def brute_repeated(history_texts, chunks):
    old, kept, cases = [words(t) for t in history_texts], [], set()
    for i, t in sorted(chunks):
        w = words(t)
        if any(like(w, o) for o in old) or any(like(w, o) for o in kept):
            cases.add(i)
        else:
            kept.append(w)
    return cases


@pytest.mark.parametrize(("seed", "cell"), [(1, 4096), (2, 4)])
def test_repeated_chunks_equal_brute_force(spark, seed, cell):
    rng = random.Random(seed)
    texts = [*edited(rng, 22, 5), None, "", "??", "one two", "one two"]
    rng.shuffle(texts)
    memory, chunks = texts[::4], [(i, t) for i, t in enumerate(texts[1::2])]
    m = spark.createDataFrame([(t, 1) for t in memory], "content string, first int")
    c = spark.createDataFrame([(i, t, True, "x") for i, t in chunks], "chunk_id long, content string, old boolean, rejected string")
    got = [r.chunk_id for r in history.repeated_chunks(c, "chunk_id", "content", m, "content", cell=cell).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_repeated(memory, chunks)


def test_index_agrees_batch_by_batch(spark, tmp_path):
    rng = random.Random(9)
    texts = edited(rng, 20, 5)
    rng.shuffle(texts)
    chunks = list(enumerate(texts))
    index = history.HistoryIndex(spark, f"file://{tmp_path}/index").create(spark.createDataFrame([(t,) for t in texts[:10]], "content string"), "content")
    got = set()
    for lo in range(0, len(chunks), 25):
        batch = spark.createDataFrame(chunks[lo : lo + 25], "chunk_id long, content string")
        got |= {r.chunk_id for r in index.check(batch, "chunk_id", "content").where(F.col("repeated")).collect()}
    assert got == brute_repeated([], chunks)


@pytest.mark.parametrize("shuffled", [True, False])
def test_components_of_long_paths(spark, shuffled):
    n = 3000
    x = np.random.default_rng(1).permutation(n) if shuffled else np.arange(n)
    links = [(int(min(p)), int(max(p))) for p in zip(x[:-1], x[1:], strict=True)] + [(n + 1, n + 2)]
    got = {r.rid: r["group"] for r in alike.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len(got) == n + 2 and len(set(got.values())) == 2 and got[n + 1] == got[n + 2] in (n + 1, n + 2)


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    links = [(a, b) for a, b in ((rng.randrange(400), rng.randrange(400)) for _ in range(260)) if a != b]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    got = {r.rid: r["group"] for r in alike.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for p in links for x in p}
    assert set(got) == nodes and all((got[a] == got[b]) == (find(a) == find(b)) for a in nodes for b in nodes)
    assert alike.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chains_longer_than_the_rounds(spark):
    """Each text is alike to the next two only: a link a round; the rest goes in order."""
    n = 60
    nodes = spark.createDataFrame([(i, i, i in (7, 30)) for i in range(n)], "rid long, first long, known boolean")
    links = [(j, i) if (i + j) % 2 else (i, j) for i in range(n) for j in (i + 1, i + 2) if j < n]
    got = {r.rid for r in history._first_accepted(nodes, spark.createDataFrame(links, "a long, b long"), rounds=3).collect()}
    accepted, expected = set(), {7, 30}
    for i in range(n):
        if i not in expected:
            (expected if {i - 1, i - 2} & accepted else accepted).add(i)
    assert got == expected


def test_a_small_batch_opens_few_folders(spark, tmp_path):
    rng = random.Random(3)
    texts = edited(rng, 60, 2)
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    index = history.HistoryIndex(spark, f"file://{tmp_path}/index", parts=64).create(df, "content").append(df, "content")
    batch = spark.createDataFrame([(1, texts[0].split()[0] + " zeta eta"), (2, "alone")], "k long, content string")
    own = batch.select(alike.word_hashes(F.col("content")).alias("words"), F.col("k").alias("rid"), F.lit(0).cast("byte").alias("flag"))
    rows = index._keys(own, index._common())
    everything, opened = index.blocks(), index.blocks(history.key_filter(rows))
    plan = opened._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan.replace("isnotnull(part", "part")
    scanned = opened.select("part").distinct().count()
    assert scanned <= rows.select("key").distinct().count() < everything.select("part").distinct().count()
    got = {r.k: r.repeated for r in index.check(batch, "k", "content").collect()}
    assert got == {1: False, 2: False} and index.batches() == [0, 1]
    again = {r.k: r.repeated for r in index.check(batch, "k", "content").collect()}
    assert again == {1: True, 2: True}


def test_a_batch_without_its_mark_does_not_count(spark, tmp_path):
    df = spark.createDataFrame([("a b c d e f g",)], "content string")
    index = history.HistoryIndex(spark, f"file://{tmp_path}/index").create(df, "content")
    index._mark = lambda number: None
    index.append(df, "content")
    del index._mark
    assert index.batches() == [] and index.texts().count() == 0
    assert [r.repeated for r in index.check(spark.createDataFrame([(1, "a b c d e f g")], "k long, content string"), "k", "content").collect()] == [False]
    assert index.texts().count() == 1
