"""Evaluation passages inside a large corpus, by shared runs of words.

1. Words of the test items get numbers; every document is read once and becomes
   the list of its word numbers (0: a word of no item).
2. A stretch with e edits falls into at most e + 1 unbroken runs, so every
   document that repeats a passage of an item shares a run of ``shared_run``
   words with it; these runs are looked up.
3. Of the places found, those stay around which enough words, and runs of two and
   of three words, are the item's (``shared_grams``).
4. They are checked by an alignment of words (edit distance), and for the item's
   answer.

Steps 2 and 3 are bounds that follow from the definition of a passage, for any
length and number of items: they lose nothing that step 4 accepts.
``latent_space`` decomposes passages; the search does not need it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.llm.plaintext import plain_words

#: Words of a passage for the decomposition.
PART = 24
RANK, OVERSAMPLE, POWER = 224, 24, 1
#: A passage has this share of an item's words and one edit in so many words.
SHARE, PER_EDIT = 0.6, 6
#: Items, and characters of items, of one pass over the corpus; more are taken in blocks.
BLOCK_ITEMS, BLOCK_CHARS = 5000, 20_000_000
#: Rows of a matrix that are summed in one group.
_ROWS = 256
#: Lengths of the runs that are counted around a place, the cheapest first.
GRAMS = (1, 2, 3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Places, and words around them, that are looked at together.
_PLACES, _WORDS = 200_000, 4_000_000


def _number_words(key: str, text: str, vocabulary: dict[str, int]):
    get = vocabulary.get

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lists = [], []
            for i, t in enumerate(batch.column(text).to_pylist()):
                if t:
                    ids = [get(w, 0) for w in plain_words(t)]
                    if any(ids):
                        rows.append(i)
                        lists.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), pa.array(lists, pa.list_(pa.int32()))], names=[key, "ids"])

    return run


def _passages(ids: np.ndarray) -> list[np.ndarray]:
    parts = [ids[i : i + PART] for i in range(0, max(1, len(ids) - PART // 2), PART // 2)]
    return [ids, *parts] if len(ids) > PART else [ids]


def _vector(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, counts = np.unique(ids, return_counts=True)
    return words, (counts * idf[words]).astype(np.float64)


def _share(basis: np.ndarray, idf: np.ndarray, gram: bool):
    """Each partition's sum over its passages a of a (a'B), or of (B'a)(B'a)' for the gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((basis.shape[1] if gram else basis.shape[0], basis.shape[1]))
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                for part in _passages(np.array(ids, np.int64)):
                    words, weight = _vector(part, idf)
                    weight = weight / max(np.linalg.norm(weight), 1e-12)
                    row = weight @ basis[words]
                    if gram:
                        total += np.outer(row, row)
                    else:
                        total[words] += weight[:, None] * row
        firsts = [a for a in range(0, len(total), _ROWS) if total[a : a + _ROWS].any()]
        sums = [total[a : a + _ROWS].tobytes() for a in firsts]
        yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(sums, pa.binary())], names=["first", "sums"])

    return run


def _added(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x) for x in table.column("sums").to_pylist())
    return pa.table({"first": pa.array([keys[0].as_py()], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})


def latent_space(items: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """An orthonormal basis (words x rank) of the items' TF-IDF passages, by randomised SVD with power steps.

    The driver holds words x (rank + oversampling) numbers; the words are those
    of the items, not of the corpus.
    """
    width = min(rank + OVERSAMPLE, len(idf))
    basis = np.random.default_rng(seed).standard_normal((len(idf), width)) / np.sqrt(width)
    basis[0] = 0

    def summed(gram: bool) -> np.ndarray:
        shares = items.mapInArrow(_share(basis, idf, gram), "first long, sums binary")
        total = np.zeros((width if gram else len(idf), width))
        for r in shares.groupBy("first").applyInArrow(_added, "first long, sums binary").toLocalIterator():
            block = np.frombuffer(r["sums"]).reshape(-1, width)
            total[r["first"] : r["first"] + len(block)] = block
        return total

    for _ in range(POWER + 1):
        basis = np.linalg.qr(summed(False))[0]
    values, turn = np.linalg.eigh(summed(True))
    strong = np.argsort(values)[::-1][:rank]
    strong = strong[values[strong] > 1e-9 * max(values.max(), 1e-30)]
    return (basis @ turn[:, strong]).astype(np.float32)


def holds_stretch(item: np.ndarray, doc: np.ndarray, share: float = SHARE, per_edit: int = PER_EDIT) -> bool:
    """Whether ``doc`` repeats an unbroken stretch of at least ``share`` of the item's words with at most one edit in ``per_edit`` words.

    Edit distances of all starts in the item to every end in the document are
    kept in one table, a row a start; the stretch begins and ends with a word
    that both have.
    """
    n, m = len(item), len(doc)
    least = int(np.ceil(share * n - 1e-9))
    if not n or m < least - least // per_edit:
        return False
    starts = n - least + 1
    far = n + m + 1
    table = np.full((starts, m + 1), far, np.int32)
    steps = np.arange(m + 1, dtype=np.int32)
    for i in range(n):
        same = doc == item[i]
        live = table[: min(i + 1, starts)]
        new = live + 1
        np.minimum(new[:, 1:], live[:, :-1] + ~same, out=new[:, 1:])
        if i < starts:
            new[i] = far
            new[i, 1:][same] = 0
        table[: len(live)] = new = np.minimum.accumulate(new - steps, axis=1) + steps
        done = i + 2 - least
        if done > 0 and same.any():
            best = new[:done, 1:][:, same].min(axis=1)
            if (best * per_edit <= i + 1 - np.arange(done)).any():
                return True
    return False


def shared_run(n: int, share: float = SHARE, per_edit: int = PER_EDIT) -> int:
    """Words in a row that an item of ``n`` words shares with every text that ``holds_stretch``.

    Of a stretch of x words with e edits at least x - e words stay, in at most
    e + 1 runs; the least of the longest run over all x is the answer.
    """
    x = np.arange(max(1, int(np.ceil(share * n - 1e-9))), n + 1)
    return int((-(-(x - x // per_edit) // (x // per_edit + 1))).min())


def shared_grams(n: int, g: int, share: float = SHARE, per_edit: int = PER_EDIT) -> int:
    """How many runs of ``g`` words of an item of ``n`` words are at least in a passage of it: an edit breaks ``g`` runs at most."""
    x = np.arange(max(1, int(np.ceil(share * n - 1e-9))), n + 1)
    return max(0, int((x - g + 1 - g * (x // per_edit)).min()))


def _run_keys(values: np.ndarray, length: int) -> np.ndarray:
    """A number for each run of ``length`` values; equal runs have equal numbers."""
    keys = np.zeros(max(0, len(values) - length + 1), np.uint64)
    for k in range(length):
        keys = keys * _MIX + values[k : k + len(keys)].astype(np.uint64)
    return keys


def _search(key: str, item_ids: list[np.ndarray], item_keys: np.ndarray, answers: list[np.ndarray], size: int):
    lengths = np.array([len(x) for x in item_ids], np.int64)
    slack = lengths // PER_EDIT
    mixed = np.arange(len(item_ids), dtype=np.uint64) * _MIX
    filters = []
    for g in GRAMS:
        member = np.unique(np.concatenate([_run_keys(ids, g) + mixed[i] for i, ids in enumerate(item_ids)]))
        filters.append((g, member, np.array([shared_grams(int(n), g) for n in lengths])))
    by_run: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        by_run.setdefault(shared_run(int(n)), []).append(i)
    tables = []
    for q, chosen in by_run.items():
        runs = np.concatenate([_run_keys(item_ids[i], q) for i in chosen])
        many = lengths[chosen] - q + 1
        place = np.arange(len(runs)) - np.repeat(np.cumsum(many) - many, many)
        order = np.argsort(runs, kind="stable")
        keys, first, count = np.unique(runs[order], return_index=True, return_counts=True)
        tables.append((q, keys, first, count, np.repeat(chosen, many)[order], place[order]))

    def places(values: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """(record, item, where the item's first word would stand) of the shared runs."""
        record = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for q, keys, first, count, item, place in tables:
            runs = _run_keys(values, q)
            at = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
            hit = np.flatnonzero((keys[at] == runs) & (record[: len(runs)] == record[len(values) - len(runs) :]))
            steps = np.cumsum(count[at[hit]]) // _PLACES
            for part in np.split(hit, np.flatnonzero(np.diff(steps)) + 1):
                many = count[at[part]]
                entry = np.repeat(first[at[part]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                start = np.repeat(part, many)
                yield np.unique(np.stack([record[start], item[entry], start - place[entry]], axis=1), axis=0)

    def candidates(values: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """(record, item) to the parts of the record with enough words of the item."""
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        grams = {g: _run_keys(values, g) for g in GRAMS}
        for told in places(values, offsets):
            r, i, start = told.T
            a = np.maximum(offsets[r], start - slack[i])
            b = np.minimum(offsets[r + 1], start + lengths[i] + slack[i])
            for g, member, least in filters:
                enough = [np.zeros(0, np.int64)]
                steps = np.cumsum(b - a) // _WORDS
                for part in np.split(np.arange(len(r)), np.flatnonzero(np.diff(steps)) + 1):
                    many = np.maximum(0, (b - a)[part] - g + 1)
                    ends = np.cumsum(many)
                    wanted = grams[g][np.repeat(a[part], many) + np.arange(many.sum()) - np.repeat(ends - many, many)] + np.repeat(mixed[i[part]], many)
                    # An item too short for any run of g words has nothing to be found and least 0.
                    inside = member[np.minimum(np.searchsorted(member, wanted), len(member) - 1)] == wanted if len(member) else np.zeros(len(wanted), bool)
                    sums = np.r_[0, np.cumsum(inside)]
                    enough.append(part[sums[ends] - sums[ends - many] >= least[i[part]]])
                kept = np.concatenate(enough)
                r, i, a, b = r[kept], i[kept], a[kept], b[kept]
            for x in range(len(r)):
                found.setdefault((int(r[x]), int(i[x])), []).append((int(a[x]), int(b[x])))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            offsets = column.offsets.to_numpy().astype(np.int64)
            values = column.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
            offsets = offsets - offsets[0]
            rows, items, told = [], [], []
            for (r, i), parts in sorted(candidates(values, offsets).items()):
                item = item_ids[i]
                spans: list[list[int]] = []
                for a, b in sorted(parts):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                if any(holds_stretch(item, values[a:b]) for a, b in spans):
                    rows.append(r)
                    items.append(item_keys[i])
                    said = answers[i]
                    told.append(None if not len(said) else bool(np.isin(said, values[offsets[r] : offsets[r + 1]]).all()))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), pa.array(told, pa.bool_())], names=[key, "item_id", "answer_seen"])

    return run


def leaked_items(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, answer: str) -> DataFrame:
    """``(key, item_id, answer_seen)``: every document that repeats a passage of a test item.

    A passage counts if the document has an unbroken stretch of at least 0.6 of
    the item's words in order with at most one word in six changed, added or
    missing; case, punctuation, markup, entities, invisible characters and
    hyphens at line ends don't matter.  ``answer_seen`` tells whether all words
    of the item's answer stand in the document, null where there is no answer.
    Null and empty texts and items without words give nothing; repeated
    documents count each, repeated items too; ``item_key`` must be integral.
    Items are taken about ``BLOCK_ITEMS`` or ``BLOCK_CHARS`` at a time, each
    block against all documents; a block, with the words in it, is all that
    leaves the executors.
    """
    kept = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("t"), F.col(answer).alias("a"))
    total, chars = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("t") + F.coalesce(F.length("a"), F.lit(0))), F.lit(0))).first()
    blocks = max(1, -(-total // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    out = None
    for b in range(blocks):
        rows = kept.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks)) == b).collect()
        part = _leaks_of_block(documents, key, text, [(r["item_id"], r["t"], r["a"]) for r in rows])
        out = part if out is None else out.unionByName(part)
    return out


def _leaks_of_block(documents: DataFrame, key: str, text: str, rows: list[tuple[int, str, str | None]]) -> DataFrame:
    spark, kind = documents.sparkSession, dict(documents.dtypes)[key]
    rows = [(i, plain_words(t), plain_words(a or "")) for i, t, a in rows]
    rows = sorted((i, words, said) for i, words, said in rows if words)
    if not rows:
        return spark.createDataFrame([], f"{key} {kind}, item_id long, answer_seen boolean")
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, words, said in rows for w in (*words, *said)}), 1)}
    item_ids = [np.array([vocabulary[w] for w in words], np.int64) for _, words, _ in rows]
    answers = [np.array([vocabulary[w] for w in said], np.int64) for _, _, said in rows]
    number = _number_words(key, text, vocabulary)
    search = _search(key, item_ids, np.array([i for i, _, _ in rows], np.int64), answers, len(vocabulary) + 1)
    return documents.select(key, text).mapInArrow(lambda batches: search(number(batches)), f"{key} {kind}, item_id long, answer_seen boolean")
