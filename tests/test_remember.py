import hashlib
import random

from recollex.operators.remember import remembered


def simhash(text):
    values = [int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little") for w in text.lower().split()]
    return sum(1 << i for i in range(64) if 2 * sum((v >> i) & 1 for v in values) > len(values))


def test_same_as_one_by_one(spark):
    rng = random.Random(3)
    notes = [" ".join(rng.choice([f"w{i}" for i in range(60)]) for _ in range(30)) for _ in range(12)]

    def edit(t):
        w = t.split()
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = "new"
        return " ".join(w)

    old = [(f"o{i}", notes[i]) for i in range(3)] + [("o8", None)]
    new = [(f"n{i:02d}", edit(rng.choice(notes)), i) for i in range(40)] + [("n90", "", 90), ("n91", None, 91), ("n92", "", 92)]
    kept, expected = [(k, simhash(t)) for k, t in old if t], {}
    for k, t, _ in new:
        h = simhash(t) if t else 0
        blockers = [b for b, x in kept if h and bin(h ^ x).count("1") <= 3]
        expected[k] = blockers
        if h and not blockers:
            kept.append((k, h))
    batch = spark.createDataFrame(new, "id string, content string, n int")
    existing = spark.createDataFrame(old, "id string, content string")
    got = {r.id: (r.blocked_by, r.stored) for r in remembered(batch, existing, "id", "content", "n").collect()}
    assert set(got) == set(expected) and 0 < sum(not s for _, s in got.values()) < 43
    assert all(s == (not expected[k]) and (by is None if s else by in expected[k]) for k, (by, s) in got.items())
    assert remembered(batch.limit(0), existing, "id", "content", "n").count() == 0


def test_meaning_and_conflicts(spark):
    from recollex.operators.remember import semantic_repeats, surfaced_conflicts

    schema = "id string, content string, v array<double>, project_id string, kind string, supersedes string"
    old = [("o1", "cache port alpha", [1.0, 0.0], "p", "fact", None), ("o2", "queue port beta", [0.99, 0.1], "p", "Decision ", None), ("o3", "cache port alpha", [1.0, 0.0], "q", "fact", None), ("o4", None, None, "p", "fact", None)]
    new = [
        ("n1", "alpha port cache", [1.0, 0.01], "p", "fact", None), ("n2", "another thing entirely", [1.0, 0.02], "p", "fact", None), ("n3", "alpha port cache", [1.0, 0.0], "p", "fact", "o1"),
        ("n4", "cache port alpha", [1.0, 0.0], None, "FACT", None), ("n5", "x", None, "p", "fact", None), ("n6", "cache port alpha", [0.0, 1.0], "p", "fact", None), ("n7", "alpha port", [1.0, 0.0], "p", "note", None),
    ]
    batch, existing = spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)
    got = {r.id: r.blocked_by for r in semantic_repeats(batch, existing, "id", "content", "v").collect()}
    assert got == {"n1": "o1", "n4": "o1", "n7": "o1"}
    told = {r.id: [c.id for c in r.conflicts] for r in surfaced_conflicts(batch, existing, "id", "v").collect()}
    assert told == {"n1": ["o1"], "n2": ["o1"], "n4": ["o1", "o3"]}
    assert semantic_repeats(batch.limit(0), existing, "id", "content", "v").count() == 0
