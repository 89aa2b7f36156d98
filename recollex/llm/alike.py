"""All pairs of texts whose word sets have a Jaccard similarity of at least ``num/den``, without comparing all pairs.

The search is exact, by anchor-point covering:

* The fingerprint of a text is the list of its rarest words, long enough that
  two alike texts must share ``g + 1`` of them (all words in one global order,
  rare first; the usual prefix argument, taken ``g + 1`` times).
* Words fall by hash into ``g`` groups.  The anchors are the code words of
  weight two inside a group.  They cover: any ``g + 1`` shared words have two in
  one group (pigeonhole), so two alike fingerprints have an anchor in common.
* A fingerprint is replicated to every anchor it covers, and compared per
  anchor by a parity sketch of up to 160 bits of the whole text.  The sketches of two
  texts differ in at most as many bits as their sets differ in words, so the
  test drops no alike pair.  What remains is verified on the words.

``g`` grows with the text, so that anchors grow with its length and not with
the square.  Texts meet only in the size classes that the similarity allows.

An anchor that more than ``REFINE`` texts share (two words of one phrase, say)
is replaced by anchors of three words: alike texts with two words in common
must share a third among their rarest, by the same argument.  What more than
``CELL`` texts still share is dealt into blocks, every pair of blocks is a task
of its own and compares the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.runtime import drop_stored, stored

CELL = 4096
REFINE = 4096
#: Words in more than this share of all texts are ordered by frequency, the rest by hash; so at most mean length / share words are collected.
COMMON_SHARE = 1 / 2000
_PAIRWISE = 64
_LONG = 64
#: Bits of a bitmap that stands for a set of keys, and how many of them travel in one row.
FILTER_BITS = 1 << 26
_SLICE = 1 << 20


def places(keys: np.ndarray) -> np.ndarray:
    """The bits of keys in a bitmap."""
    return _mixed(keys) % np.uint64(FILTER_BITS)


def _set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        bits[places(batch.column("key").to_numpy())] = True
    for at in range(0, FILTER_BITS, _SLICE):
        if bits[at : at + _SLICE].any():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(bits[at : at + _SLICE]).tobytes()])], names=["at", "bits"])


def _joined_bits(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()]
    return pa.table({"at": pa.array([keys[0].as_py()], pa.int64()), "bits": pa.array([np.bitwise_or.reduce(parts).tobytes()])})


def key_filter(rows: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BITS`` bits with one set for every ``key``; it tells nearly all other keys apart and never loses one."""
    total = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows.select("key").mapInArrow(_set_bits, "at long, bits binary").groupBy("at").applyInArrow(_joined_bits, "at long, bits binary").toLocalIterator():
        total[r["at"] // 8 : r["at"] // 8 + _SLICE // 8] = np.frombuffer(r["bits"], np.uint8)
    return total


def is_set(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = places(keys)
    return (bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0


def only(df: DataFrame, column: str, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose ``column`` may be among the ``key`` of ``wanted``, by a bitmap; a join that follows has little left to shuffle."""
    bits = key_filter(wanted.select(F.col(key).alias("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(is_set(bits, batch.column(column).to_numpy())))

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes))


def word_hashes(text: Column) -> Column:
    """Distinct words (maximal runs of letters and digits of the lower-cased text) as sorted 48-bit hashes; null text gives null."""
    short = lambda w: F.xxhash64(w).bitwiseAND(F.lit((1 << 48) - 1).cast("long"))
    hashes = F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), short)
    return F.sort_array(F.array_distinct(F.array_remove(hashes, short(F.lit("")))))


def set_hashes(words: str) -> dict[str, Column]:
    """The 128 bits that name a word set."""
    return {"set_hash_1": F.xxhash64(words), "set_hash_2": F.xxhash64(F.lit(1), words)}


def word_sets(df: DataFrame, words: str, *aggregates: Column) -> DataFrame:
    """One row ``(set_hash_1, set_hash_2, words, aggregates...)`` for each distinct non-empty word set; equality of sets is that of a 128-bit hash."""
    keyed = df if "set_hash_1" in df.columns else df.where(F.size(words) > 0).withColumns(set_hashes(words))
    return keyed.groupBy("set_hash_1", "set_hash_2").agg(F.any_value(words).alias("words"), *aggregates)


def distinct_sets(df: DataFrame, words: str, *aggregates: Column) -> DataFrame:
    """``word_sets`` with a number ``rid``, stored, so that it doesn't change."""
    return stored(word_sets(df, words, *aggregates).withColumn("rid", F.monotonically_increasing_id()), "word-sets")


def common_words(sets: DataFrame, share: float = COMMON_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted, frequency rank from 1) of the words in more than ``share`` of the sets."""
    least = max(8, int(sets.count() * share))
    counts = sets.select(F.explode("words").alias("w")).groupBy("w").count().where(F.col("count") > least)
    rows = counts.select("w", "count").toPandas()
    rows = rows.sort_values(["count", "w"], ignore_index=True)
    order = np.argsort(rows["w"].to_numpy(np.int64), kind="stable")
    return rows["w"].to_numpy(np.int64)[order], (order + 1).astype(np.int64)


#: Largest size of each class, and its groups of words: fewer than the words that two alike texts of the class share.
_EDGES = np.array([8 * 3**i for i in range(18)], np.int64)
_GROUPS = np.maximum(1, _EDGES // 10)


def _classes(n: np.ndarray) -> np.ndarray:
    """Size class: 0 up to 8 words, 1 up to 24, 2 up to 72, ..."""
    return np.searchsorted(_EDGES, n, side="left")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _sketches(values: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parity sketch of each text, 160 bits: 64, then 32 in the upper half of a long, then 64 that only texts over ``_LONG`` words have."""
    bit = ((values.view(np.uint64) >> np.uint64(8)) % np.uint64(160)).astype(np.int64)
    one, none = np.uint64(1), np.uint64(0)
    low = np.bitwise_xor.reduceat(np.where(bit < 64, one << (bit & 63).astype(np.uint64), none), starts)
    mid = np.bitwise_xor.reduceat(np.where((bit >= 64) & (bit < 96), one << (bit & 31).astype(np.uint64), none), starts)
    rest = np.bitwise_xor.reduceat(np.where(bit >= 96, one << ((bit - 96) & 63).astype(np.uint64), none), starts)
    return low.view(np.int64), (mid << np.uint64(32)).view(np.int64), np.where(n > _LONG, rest, none).view(np.int64)


def anchor_rows(rid: np.ndarray, flag: np.ndarray, values: np.ndarray, offsets: np.ndarray, common: tuple[np.ndarray, np.ndarray], num: int, den: int, hot: tuple[np.ndarray, np.ndarray] | None = None, whole: bool = False):
    """(key, rid, about, sketch, rest) of every anchor of every text; ``about`` is 2 * size + flag, and 32 bits of the sketch above.

    With ``hot``, the (record, key) of crowded anchors, it gives the anchors of
    three words that replace these; with ``whole`` one more, of the text as a set.
    """
    n = np.diff(offsets)
    record = np.repeat(np.arange(len(n)), n)
    rank = np.zeros(len(values), np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], values), len(common[0]) - 1)
        rank = np.where(common[0][at] == values, common[1][at], 0)
    low, high, rest = _sketches(values, offsets[:-1], n)
    order = np.lexsort((values, rank, record))
    values = values[order]
    place = np.arange(len(values)) - np.repeat(offsets[:-1], n)
    shared = (num * n + den - 1) // den
    own = _classes(n)
    top = _classes(n * den // num)
    mixed = _mixed(values)
    keys, owners = [], []
    for step in range(int((top - own).max(initial=0)) + 1):
        size_class = own + step
        use = (size_class <= top) & (n > 1)
        groups = _GROUPS[np.minimum(size_class, len(_GROUPS) - 1)]
        length = np.where(use, np.minimum(n, n - shared + groups + 1), 0)
        keep = np.flatnonzero(place < length[record])
        rec = record[keep]
        group = (mixed[keep] >> np.uint64(40)).astype(np.int64) % groups[rec]
        inner = np.lexsort((keep, group, rec))
        keep, rec, group = keep[inner], rec[inner], group[inner]
        first = np.arange(len(keep))
        for lag in range(1, len(keep)):
            first = first[first + lag < len(keep)]
            first = first[(rec[first] == rec[first + lag]) & (group[first] == group[first + lag])]
            if not len(first):
                break
            a, b = mixed[keep[first]], mixed[keep[first + lag]]
            salt = size_class[rec[first]].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            pair = _mixed(a * np.uint64(0xC2B2AE3D27D4EB4F) + b + salt).view(np.int64)
            if hot is None:
                keys.append(pair)
                owners.append(rec[first])
            else:
                here = np.flatnonzero(np.isin(_mixed(pair & ((1 << 48) - 1)) ^ _mixed(rec[first]), _mixed(hot[1]) ^ _mixed(hot[0])))
                for i, one, two in zip(rec[first[here]], keep[first[here]], keep[first[here] + lag], strict=True):
                    # The n - shared + 3 rarest words hold three shared ones, so at least one besides the two of the anchor.
                    third = offsets[i] + np.arange(min(n[i], n[i] - shared[i] + 3))
                    third = third[(third != one) & (third != two)]
                    one, two = mixed[one : one + 1], mixed[two : two + 1]
                    anchor = _mixed(one * np.uint64(0xC2B2AE3D27D4EB4F) + two + size_class[i : i + 1].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                    keys.append(_mixed(anchor * np.uint64(0xFF51AFD7ED558CCD) + mixed[third]).view(np.int64))
                    owners.append(np.full(len(third), i))
    if whole:
        keys.append(_mixed(np.add.reduceat(_mixed(values), offsets[:-1], dtype=np.uint64)).view(np.int64))
        owners.append(np.arange(len(n)))
    # 48 bits of a key: a chance meeting costs a comparison, shorter rows save more.
    key = np.concatenate(keys) & ((1 << 48) - 1) if keys else np.empty(0, np.int64)
    owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
    return key, rid[owner], (high | (2 * n + flag))[owner], low[owner], rest[owner]


_ANCHOR = "key long, rid long, about long, sketch long, rest long"


def anchors(sets: DataFrame, common: tuple[np.ndarray, np.ndarray], num: int = 7, den: int = 10, whole: bool = False) -> DataFrame:
    """The anchor table of ``(rid, flag, words)``; it can be kept and appended to, as long as ``common`` stays the same.

    With a column ``keys``, the crowded anchors of each text, it gives the
    anchors of three words that replace these; with ``whole`` also one of each
    text as a set, so that equal sets of two tables meet, however short.
    """
    columns = ["rid", "flag", "words", *(["keys"] if "keys" in sets.columns else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, offsets = _flat(batch.column("words"))
            hot = None
            if "keys" in columns:
                keys, ends = _flat(batch.column("keys"))
                hot = (np.repeat(np.arange(batch.num_rows), np.diff(ends)), keys)
            out = anchor_rows(batch.column("rid").to_numpy(), batch.column("flag").to_numpy().astype(np.int64), values, offsets, common, num, den, hot, whole)
            for at in range(0, len(out[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 200_000]) for x in out], names=["key", "rid", "about", "sketch", "rest"])

    return sets.select(*columns).mapInArrow(run, _ANCHOR)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets from 0) of a column of lists."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _may_be_alike(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Pairs of positions that the flags, sizes and sketches allow."""
    about_a, about_b = x["about"][a], x["about"][b]
    n_a, n_b = ((about & 0xFFFFFFFF) >> 1 for about in (about_a, about_b))
    total = n_a + n_b
    differ = sum(np.bitwise_count(bits.view(np.uint64)).astype(np.int64) for bits in (x["sketch"][a] ^ x["sketch"][b], (about_a ^ about_b) >> 32 << 32))
    differ += np.where((n_a > _LONG) & (n_b > _LONG), np.bitwise_count((x["rest"][a] ^ x["rest"][b]).view(np.uint64)), 0)
    fits = np.minimum(n_a, n_b) * den >= num * np.maximum(n_a, n_b)
    return fits & (differ * (den + num) <= (den - num) * total) & ((about_a & about_b & 1) == 0)


def _compare_cells(num: int, den: int, cell: int):
    """Candidates (a < b) of each run of equal keys; rows of runs over ``cell`` come out alone, for the blocks."""
    names = ["key", "rid", "about", "sketch", "rest"]

    def pairs(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key = x["key"]
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[edges, len(key)])
        first = np.flatnonzero(np.repeat((length > 1) & (length <= _PAIRWISE), length))
        found = []
        for lag in range(1, _PAIRWISE):
            first = first[first + lag < len(key)]
            first = first[key[first] == key[first + lag]]
            if not len(first):
                break
            ok = _may_be_alike(x, first, first + lag, num, den)
            found.append((first[ok], first[ok] + lag))
        for start, size in zip(edges[length > _PAIRWISE], length[length > _PAIRWISE], strict=True):
            for i in range(start, start + size, 128):
                a, b = np.meshgrid(np.arange(i, min(i + 128, start + size)), np.arange(i, start + size), indexing="ij")
                upper = a < b
                a, b = a[upper], b[upper]
                ok = _may_be_alike(x, a, b, num, den)
                found.append((a[ok], b[ok]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = (x["rid"][np.concatenate(side)] for side in zip(*found, strict=True))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return both[0], both[1]

    def batch_of(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None = None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), none if key is None else pa.array(key)], names=["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        held_rows, hot = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {c: batch.column(c).to_numpy() for c in names}
            if hot is not None:
                same = int(np.searchsorted(x["key"], hot, side="right"))
                if same:
                    yield batch_of(x["rid"][:same], None, x["key"][:same])
                    x = {c: v[same:] for c, v in x.items()}
                if not len(x["key"]):
                    continue
                hot = None
            held.append(x)
            held_rows += len(x["key"])
            if held_rows < 50_000 and len(held) < 64:
                continue
            x = {c: np.concatenate([h[c] for h in held]) for c in names}
            tail = int(np.searchsorted(x["key"], x["key"][-1]))
            rest = {c: v[tail:] for c, v in x.items()}
            x = {c: v[:tail] for c, v in x.items()}
            yield from finish(x)
            held, held_rows = [rest], len(rest["key"])
            if held_rows > cell:
                hot = rest["key"][0]
                yield batch_of(rest["rid"], None, rest["key"])
                held, held_rows = [], 0
        if held:
            yield from finish({c: np.concatenate([h[c] for h in held]) for c in names})

    def finish(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not len(x["key"]):
            return
        edges = np.flatnonzero(np.r_[True, x["key"][1:] != x["key"][:-1]])
        length = np.diff(np.r_[edges, len(x["key"])])
        large = np.repeat(length > cell, length)
        if large.any():
            yield batch_of(x["rid"][large], None, x["key"][large])
            x = {c: v[~large] for c, v in x.items()}
            if not len(x["key"]):
                return
        a, b = pairs(x)
        if len(a):
            yield batch_of(a, b)

    return run


def _compare_block(num: int, den: int, cell: int):
    """Exact pairs of one pair of blocks; each pair of texts belongs to one pair of blocks only."""

    def run(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rid, flag, block = (table.column(c).to_numpy() for c in ("rid", "flag", "block"))
        words = [np.asarray(w) for w in table.column("words").to_pylist()]
        n = np.array([len(w) for w in words], np.int64)
        one, two = keys[1].as_py(), keys[2].as_py()
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        index: dict[int, list[int]] = {}
        for j in right:
            for w in words[j].tolist():
                index.setdefault(w, []).append(j)
        lists = {w: np.array(v) for w, v in index.items()}
        found = []
        for i in left:
            hits = np.zeros(len(words), np.int64)
            for w in words[i].tolist():
                if w in lists:
                    hits[lists[w]] += 1
            ok = (hits > 0) & (hits * (den + num) >= num * (n + n[i])) & ((flag & flag[i]) == 0) & (rid != rid[i])
            found += [(min(rid[i], rid[j]), max(rid[i], rid[j])) for j in np.flatnonzero(ok)]
        a, b = zip(*set(found), strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def alike_pairs(sets: DataFrame, num: int = 7, den: int = 10, cell: int = CELL, common: tuple[np.ndarray, np.ndarray] | None = None, anchor_table: DataFrame | None = None) -> DataFrame:
    """``(a, b)``, a < b: every pair of ``rid`` whose sets share at least num/den of the words in either.

    ``sets`` is ``(rid, flag, words)`` with distinct word sets.  Two texts whose
    flags (0 or 1) are both 1 are not paired, so that old texts need not be
    compared among themselves.  The size classes are made for num/den >= 0.7.
    """
    if 10 * num < 7 * den or num > den:
        raise ValueError("0.7 <= num/den <= 1 must hold")
    common = common if common is not None else common_words(sets)
    table = anchor_table if anchor_table is not None else anchors(sets, common, num, den)
    def compared(rows: DataFrame, most: int) -> DataFrame:
        met = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_compare_cells(num, den, most), "a long, b long, key long")
        return stored(met, "anchor-pairs")

    met = compared(table, min(REFINE, cell))
    found = met.where("b IS NOT NULL").select("a", "b")
    crowded = met.where("key IS NOT NULL").groupBy(F.col("a").alias("rid")).agg(F.collect_set("key").alias("keys"))
    crowded = stored(crowded, "crowded")
    if not crowded.isEmpty():
        finer = anchors(crowded.join(only(sets.select("rid", "flag", "words"), "rid", crowded, "rid"), "rid"), common, num, den)
        met = compared(finer, cell)
        found = found.unionByName(met.where("b IS NOT NULL").select("a", "b"))
        crowded = met.where("key IS NOT NULL").select("key", F.col("a").alias("rid")).distinct()
    pairs = stored(found.distinct(), "candidates")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    words = stored(only(sets.select("rid", "words"), "rid", needed, "rid").join(needed, "rid"), "candidate-words")
    pairs = pairs.join(words.withColumnsRenamed({"rid": "a", "words": "wa"}), "a").join(words.withColumnsRenamed({"rid": "b", "words": "wb"}), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    pairs = pairs.where(shared * (num + den) >= num * (F.size("wa") + F.size("wb"))).select("a", "b")
    if "key" in crowded.columns and not crowded.isEmpty():
        blocks = crowded.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("blocks"))
        dealt = crowded.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.join(sets.select("rid", "flag", "words"), "rid").select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "rid", "flag", "words")
        pairs = pairs.unionByName(dealt.groupBy("key", "one", "two").applyInArrow(_compare_block(num, den, cell), "a long, b long")).distinct()
    return pairs


def components(pairs: DataFrame) -> DataFrame:
    """``(rid, group)`` for every rid of a pair; group is one rid of the component, the same for all of it.

    Each round every node hooks to the neighbour that comes first in a random
    order of that round, follows hooks for four steps, and the links are
    rewritten to where their ends went.  In a random order at most half of the
    nodes that still have links stay apart, so the links shrink geometrically
    and rounds are logarithmic whatever the shape (a path of 100 000 takes about
    ten).  Rounds are then put together from the last to the first.
    """
    links = stored(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    rounds: list[DataFrame] = []
    while not rounds or not links.isEmpty():
        place = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c).alias("h"), F.col(c).alias("rid"))  # noqa: B023, E731
        first = links.groupBy("a").agg(F.min(place("b")).alias("m")).select(F.col("a").alias("rid"), F.least("m", place("a"))["rid"].alias("up"))
        hooks = stored(first, "hooks")
        two = hooks.join(hooks.select(F.col("rid").alias("up"), F.col("up").alias("over")), "up").select("rid", F.col("over").alias("up"))
        went = stored(two.join(two.select(F.col("rid").alias("up"), F.col("up").alias("over")), "up").select("rid", F.col("over").alias("group")), "labels")
        rounds.append(went)
        to = lambda c: went.withColumnsRenamed({"rid": c, "group": f"{c}2"})  # noqa: B023, E731
        moved = links.join(to("a"), "a").join(to("b"), "b").where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct()
        after = stored(moved, "links")
        drop_stored(links)
        drop_stored(hooks)
        links = after
    drop_stored(links)
    labels = rounds.pop()
    while rounds:
        earlier, later = rounds.pop(), labels
        labels = stored(earlier.join(later.select(F.col("rid").alias("group"), F.col("group").alias("root")), "group", "left").select("rid", F.coalesce("root", "group").alias("group")), "labels")
        drop_stored(earlier)
        drop_stored(later)
    return labels
