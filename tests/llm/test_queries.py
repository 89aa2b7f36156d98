import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollex.llm import leaks, plaintext, tokens
from recollex.llm.queries import ORACLES, QUERIES
from tests.compare import connection, rows_of, sql_rows

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are missing")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SMALL)) == sql_rows(connection(SMALL), ORACLES[name])


def table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet").toPandas()


def test_groups_and_pairs_agree(spark):
    groups = QUERIES["p1_groups"](spark, SMALL).toPandas()
    sizes = groups.groupby("group_id").size()
    assert (sizes * (sizes - 1) // 2).sum() == QUERIES["p1_found"](spark, SMALL).count()
    assert (groups.groupby("class_id").group_id.nunique() == 1).all() and (groups.links >= 0).all() and not groups.id.duplicated().any()


def test_pieces_are_the_texts(spark):
    chunks = table(spark, "import_chunks").set_index("chunk_id").content
    pieces = QUERIES["p4_pieces"](spark, SMALL).toPandas().sort_values(["chunk_id", "chunk_index"])
    for k, own in pieces.groupby("chunk_id"):
        if chunks[k] is None:
            assert own.piece.tolist() == [None]
            continue
        parts = own.piece.tolist()
        assert own.chunk_index.tolist() == list(range(len(parts))) and max(map(len, parts)) <= 800
        assert parts[0] + "".join(p[100:] for p in parts[1:]) == chunks[k] and all(b[:100] == a[-100:] for a, b in zip(parts, parts[1:], strict=False))
    assert set(pieces.chunk_id) == set(chunks.index)


def test_rebuilt_threads_are_whole(spark):
    dropped = {r.thread_id for r in QUERIES["p5_found"](spark, SMALL).collect()}
    turns = QUERIES["p5_threads"](spark, SMALL).toPandas().sort_values(["thread_id", "turn_no"])
    assert len(turns) and not dropped & set(turns.thread_id)
    every = {r[0] for r in spark.read.parquet(f"{SMALL}/beam_turns.parquet").select("conversation_id").distinct().collect()}
    every |= {r[0] for r in spark.read.parquet(f"{SMALL}/lme_questions.parquet").select(F.explode("haystack_session_ids")).collect()}
    assert every == dropped | set(turns.thread_id)
    for _, own in turns.groupby("thread_id"):
        assert own.turn_no.tolist() == list(range(1, len(own) + 1)) and own.said_at.dropna().is_monotonic_increasing
        talk = own[own.role != "system"]
        assert set(talk.role) <= {"user", "assistant"} and (talk.role == "user").any()
        assert all(b == "assistant" for a, b in zip(talk.role, [*talk.role[1:], None], strict=True) if a == "user")


def test_containers_hold_every_token_once(spark):
    texts = table(spark, "documents").set_index("doc_id").text
    packed = QUERIES["p7_containers"](spark, SMALL).toPandas()
    encode = tokens.encoding(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.tiktoken").encode_ordinary
    assert set(packed.doc_id) == set(texts.index)
    for k, own in packed.groupby("doc_id"):
        if texts[k] is None:
            assert own.n_tokens.isna().all() and own.container_id.isna().all()
            continue
        n = len(encode(texts[k]))
        own = own.sort_values("piece_no")
        assert own.n_tokens.sum() == n and len(own) == max(1, -(-n // 2048)) and own.first_token.tolist() == [2048 * i for i in range(len(own))]
    load = packed[packed.n_tokens > 0].groupby("container_id").n_tokens.sum()
    assert load.max() <= 2048 and len(load) <= np.ceil(load.sum() / 2048) + 1
    assert {r.doc_id for r in QUERIES["p7_found"](spark, SMALL).collect()} == {k for k, t in texts.items() if t and len(encode(t)) > 2048}


def test_leaks_equal_brute_force(spark):
    """Every pair of document and item, but for those that share too few words for any stretch, is aligned."""
    docs = [(k, plaintext.plain_words(t)) for k, t in table(spark, "documents")[["doc_id", "text"]].itertuples(index=False) if t]
    items = [(k, plaintext.plain_words(t)) for k, t in table(spark, "eval_items")[["item_id", "text"]].itertuples(index=False) if t]
    numbers: dict[str, int] = {}
    number = lambda ws: np.array([numbers.setdefault(w, len(numbers)) for w in ws])
    docs, items = [(k, number(w)) for k, w in docs], [(k, number(w)) for k, w in items]
    expected = set()
    for d, doc in docs:
        for i, item in items:
            if np.isin(item, doc).sum() >= 0.6 * len(item) * 5 / 6 - 1 and leaks.holds_stretch(item, doc):
                expected.add((d, i))
    got = [(r.doc_id, r.item_id) for r in QUERIES["p8_found"](spark, SMALL).collect()]
    assert expected and len(got) == len(set(got)) and set(got) == expected
    told = QUERIES["p8_leaks"](spark, SMALL).toPandas()
    answers = table(spark, "eval_items").set_index("item_id").answer
    assert (told.answer_seen.isna() == told.item_id.map(lambda i: answers[i] is None)).all()


def test_levels_agree_with_ratings(spark):
    folder = "/root/testdata/sf0.01"
    levels = QUERIES["p9_levels"](spark, folder).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{folder}/reading_labels.parquet").dropna(subset=["grade"]).toPandas()
    own = labels.join(levels, on="doc_id", rsuffix="_told", how="inner")
    assert len(own) > 50 and (own.language == "en").all() and ((own.grade >= 13) == (own.grade_told >= 13)).all() and (own.grade - own.grade_told).abs().mean() < 1.5
    found = {r.doc_id for r in QUERIES["p9_found"](spark, folder).collect()}
    assert found == set(levels[(levels.language == "en") & (levels.grade >= 13)].index)


def test_batches_count_the_repeated_chunks(spark):
    found = QUERIES["p3_found"](spark, SMALL).count()
    counted = QUERIES["p3_batches"](spark, SMALL).toPandas()
    assert 0 < counted.chunks_deduplicated.sum() <= found and not counted.batch_no.duplicated().any()
