"""Deduplicating new batches against everything accepted before.

Fingerprints are bit vectors whose difference in bits never exceeds the
difference of the texts in words (``alike``); block tables hold, for every text,
one exact key for each pair of rare words in a block, and one for the whole set
of words.  A batch looks up its own keys, compares the bits of what it meets,
verifies the words, and is appended.
(Blocks cut from a plain 64-bit fingerprint with three differing bits miss most
texts that share 0.7 of their words; the README has the figures.)
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.llm.alike import CELL, FILTER_BITS, alike_pairs, anchors, common_words, components, is_set, key_filter, places, set_hashes, word_hashes, word_sets
from recollex.runtime import drop_stored, shared_dir, stored

#: Folders that the block table is cut into by key; one for some 100 MB.
PARTS = 1
#: Rounds in which all texts decide at once; what is then still open is decided in order, component by component.
ROUNDS = 12

_TEXTS = "rid long, words array<long>"
_BLOCKS = "rid long, about long, sketch long, rest long, keys array<long>, part int"


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rejected ``after`` of links sorted by group and order; a text without a link to an earlier one is accepted."""
    group, rejected, now, bad = None, set(), None, False
    for batch in batches:
        out = []
        for g, after, before in zip(*(batch.column(c).to_pylist() for c in ("group", "after", "before")), strict=True):
            if (g, after) != (group, now):
                if bad:
                    rejected.add(now)
                if g != group:
                    rejected = set()
                group, now, bad = g, after, False
            if not bad and before not in rejected:
                bad = True
                out.append(after)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["rid"])


def _first_accepted(nodes: DataFrame, pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``rid`` of the rejected nodes: going through them by ``first``, those linked to an earlier one that isn't rejected.

    ``nodes`` is (rid, first, known) where known nodes are rejected from the
    start; ``pairs`` is (a, b) in any direction.  Each round settles every node
    whose earlier neighbours are settled, or one of whose earlier neighbours is
    accepted.  A long chain of edits settles a link a round only, so after
    ``rounds`` the open rest goes in order through one pass over its sorted
    links; a task holds no more of it than the numbers of rejected texts of one
    component.
    """
    place = nodes.select("rid", "first")
    ends = pairs.join(place.withColumnsRenamed({"rid": "a", "first": "fa"}), "a").join(place.withColumnsRenamed({"rid": "b", "first": "fb"}), "b")
    one, two = F.struct(F.col("fa").alias("f"), F.col("a").alias("r")), F.struct(F.col("fb").alias("f"), F.col("b").alias("r"))
    links = stored(ends.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).select(F.col("x.r").alias("before"), F.col("y.r").alias("after"), F.col("y.f").alias("first")), "ordered-links")
    # state: 0 undecided, 1 accepted, 2 rejected
    state = stored(nodes.select("rid", F.when(F.col("known"), F.lit(2)).otherwise(F.lit(0)).alias("state")), "dedup-state")
    for _ in range(rounds):
        seen = links.join(state.select(F.col("rid").alias("before"), F.col("state").alias("s")), "before").groupBy(F.col("after").alias("rid")).agg(
            F.max(F.col("s") == 1).alias("accepted"), F.max(F.col("s") == 0).alias("open")
        )
        decided = (
            F.when(F.col("state") != 0, F.col("state"))
            .when(F.coalesce("accepted", F.lit(False)), F.lit(2))
            .when(~F.coalesce("open", F.lit(False)), F.lit(1))
            .otherwise(F.lit(0))
        )
        after = stored(state.join(seen, "rid", "left").select("rid", decided.alias("state")), "dedup-state")
        drop_stored(state)
        state = after
        if state.where("state = 0").isEmpty():
            return state.where("state = 2").select("rid")
    undecided, unrejected = state.where("state = 0").select(F.col("rid").alias("after")), state.where("state < 2").select(F.col("rid").alias("before"))
    rest = links.join(undecided, "after", "left_semi").join(unrejected, "before", "left_semi")
    rest = stored(rest.select("before", "after", "first"), "open-links")
    groups = components(rest.select(F.col("before").alias("a"), F.col("after").alias("b")))
    sorted_links = rest.join(groups.withColumnRenamed("rid", "after"), "after").repartition("group").sortWithinPartitions("group", "first", "after")
    return state.where("state = 2").select("rid").unionByName(sorted_links.select("group", "after", "before").mapInArrow(_in_order, "rid long"))


def _by_part(parts: int):
    """One row for each text and folder that it has keys in, from rows of equal texts together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {c: batch.column(c).to_numpy() for c in ("key", "rid", "about", "sketch", "rest")}
            part = (places(x["key"]) % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((x["rid"], part))
            rid, part = x["rid"][order], part[order]
            first = np.flatnonzero(np.r_[True, (rid[1:] != rid[:-1]) | (part[1:] != part[:-1])]) if len(rid) else np.zeros(0, np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.r_[first, len(rid)].astype(np.int32)), pa.array(x["key"][order]))
            yield pa.RecordBatch.from_arrays([*[pa.array(x[c][order[first]]) for c in ("rid", "about", "sketch", "rest")], keys, pa.array(part[first])], names=["rid", "about", "sketch", "rest", "keys", "part"])

    return run


def _met(bits: np.ndarray):
    """(key, rid, about, sketch, rest) of the keys that the filter lets through; ``about`` marks them as old."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("keys")
            offsets = column.offsets.to_numpy().astype(np.int64)
            keys = column.values.to_numpy()[offsets[0] : offsets[-1]]
            hit = np.flatnonzero(is_set(bits, keys))
            own = np.repeat(np.arange(batch.num_rows), np.diff(offsets))[hit]
            told = {c: batch.column(c).to_numpy()[own] for c in ("rid", "about", "sketch", "rest")}
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[hit], told["rid"], told["about"] | 1, told["sketch"], told["rest"])], names=["key", "rid", "about", "sketch", "rest"])

    return run


def _batch_words(batch: DataFrame, key: str, text: str) -> DataFrame:
    """``(_id, words, set_hash_1, set_hash_2)`` of the rows with a key and a word, stored."""
    own = batch.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), word_hashes(F.col(text)).alias("words")).where(F.size("words") > 0)
    return stored(own.withColumns(set_hashes("words")), "batch-words")


class HistoryIndex:
    """The accepted texts of all batches so far, as tables in a shared folder.

    ``blocks`` holds the keys and the fingerprint of every text, in ``parts``
    folders by key, and ``texts`` its words.  ``check`` opens only the folders
    that the batch has keys in, takes from them the keys that a bitmap of the
    batch's own lets through, and reads words only for pairs whose fingerprints
    fit.  Accepted texts are added under a batch number of their own, which
    counts once its mark is written, so a failed batch leaves nothing behind that
    is read.  Choose ``parts`` so, and batches of at
    most some millions of texts, which the bitmap is made for (larger ones are as
    right, but open more).  The order of words is fixed when the index is made:
    any order gives exact results, one from similar texts gives small cells.
    """

    def __init__(self, spark: SparkSession, folder: str, num: int = 7, den: int = 10, parts: int = PARTS, cell: int = CELL):
        if parts < 1 or FILTER_BITS % parts:
            raise ValueError("parts must be a power of two")
        self.spark, self.folder, self.num, self.den, self.parts, self.cell = spark, folder.rstrip("/"), num, den, parts, cell

    def create(self, sample: DataFrame, text: str) -> HistoryIndex:
        """Starts an empty index; ``sample`` gives the frequent words (a bounded number, see ``common_words``)."""
        return self._create(sample.select(word_hashes(F.col(text)).alias("words")))

    def _create(self, sets: DataFrame) -> HistoryIndex:
        words, ranks = common_words(sets)
        rows = list(zip(words.tolist(), ranks.tolist(), strict=True))
        self.spark.createDataFrame(rows, "word long, place long").coalesce(1).write.parquet(f"{self.folder}/common")
        return self

    def _common(self) -> tuple[np.ndarray, np.ndarray]:
        rows = self.spark.read.parquet(f"{self.folder}/common").orderBy("word").toPandas()
        return rows["word"].to_numpy(np.int64), rows["place"].to_numpy(np.int64)

    def _marks(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/marks")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Numbers of the batches that count."""
        path, files = self._marks()
        return sorted(int(f.getPath().getName()) for f in files.listStatus(path)) if files.exists(path) else []

    def _mark(self, number: int) -> None:
        path, files = self._marks()
        files.create(self.spark._jvm.org.apache.hadoop.fs.Path(path, str(number)), True).close()

    def _table(self, name: str, schema: str) -> DataFrame:
        folders = [f"{self.folder}/{name}/batch={n}" for n in self.batches()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*folders)

    def texts(self) -> DataFrame:
        return self._table("texts", _TEXTS)

    def blocks(self, bits: np.ndarray | None = None) -> DataFrame:
        """The block table of all batches that count; with the bitmap of some keys, of the folders they fall in."""
        blocks = self._table("blocks", _BLOCKS)
        if bits is None or self.parts == 1:
            return blocks
        hit = np.unpackbits(bits).reshape(-1, self.parts).any(axis=0)
        return blocks.where(F.col("part").isin([int(p) for p in np.flatnonzero(hit)]))

    def _keys(self, sets: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        """Every key of every set with its fingerprint: the anchors, and the set as a whole."""
        return anchors(sets, common, self.num, self.den, whole=True)

    def _next(self) -> int:
        number = max(self.batches(), default=-1) + 1
        if number >= 1 << 15:
            raise ValueError("too many batches; build the index anew from its texts")
        return number

    def _sets(self, df: DataFrame, *aggregates: Column) -> DataFrame:
        """Distinct word sets with numbers that no other batch has."""
        partition = F.when(F.spark_partition_id() < 1 << 15, F.monotonically_increasing_id()).otherwise(F.raise_error(F.lit("a batch may have at most 32768 partitions")))
        return word_sets(df, "words", *aggregates).withColumn("rid", partition.bitwiseOR(F.lit(self._next() << 48)))

    def append(self, df: DataFrame, text: str) -> HistoryIndex:
        """Takes over texts that were accepted elsewhere, without checking them."""
        number = self._next()
        return self._add_blocks(self._add_texts(self._sets(df.select(word_hashes(F.col(text)).alias("words"))), number), number)

    def _add_texts(self, sets: DataFrame, number: int) -> DataFrame:
        path = f"{self.folder}/texts/batch={number}"
        sets.select("rid", "words").write.mode("overwrite").parquet(path)
        return self.spark.read.schema(_TEXTS).parquet(path)

    def _add_blocks(self, texts: DataFrame, number: int) -> HistoryIndex:
        flagged = texts.select("rid", F.lit(1).cast("byte").alias("flag"), "words")
        rows = self._keys(flagged, self._common()).mapInArrow(_by_part(self.parts), _BLOCKS)
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/blocks/batch={number}")
        self._mark(number)
        return self

    def check(self, batch: DataFrame, key: str, text: str) -> DataFrame:
        """``(key, repeated)`` for every row of the batch with a key and a word in its text; accepted rows are appended.

        A text is repeated if it is alike to an accepted one or to an earlier
        one of the batch (by ``key``) which is itself not repeated.  Of equal
        texts the first by key counts, equal keys count as one.
        """
        number = self._next()
        own = _batch_words(batch, key, text)
        sets = stored(self._sets(own, F.min("_id").alias("first")), "batch-sets")
        rejected, fate = self._judged(own, sets, key, number)
        self._add_blocks(self._add_texts(sets.join(rejected, "rid", "left_anti"), number), number)
        return fate

    def _judged(self, own: DataFrame, sets: DataFrame, key: str, number: int) -> tuple[DataFrame, DataFrame]:
        """(rid of the rejected sets, check's result) of a batch of that number."""
        common = self._common()
        mine = sets.select("rid", F.lit(0).cast("byte").alias("flag"), "words")
        rows = self._keys(mine, common)
        bits = key_filter(rows)
        met = self.blocks(bits).select("rid", "about", "sketch", "rest", "keys").mapInArrow(_met(bits), "key long, rid long, about long, sketch long, rest long")
        universe = mine.unionByName(self.texts().select("rid", F.lit(1).cast("byte").alias("flag"), "words"))
        pairs = stored(alike_pairs(universe, self.num, self.den, self.cell, common, rows.unionByName(met)), "alike-pairs")
        new = lambda c: F.col(c) >= number << 48
        by_history = stored(pairs.where(new("a") != new("b")).select(F.greatest("a", "b").alias("rid")).distinct(), "met-history")
        among = pairs.where(new("a") & new("b"))
        linked = among.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
        nodes = linked.join(sets.select("rid", "first"), "rid").join(by_history.withColumn("known", F.lit(True)), "rid", "left").select("rid", "first", F.coalesce("known", F.lit(False)).alias("known"))
        rejected = stored(_first_accepted(nodes, among).unionByName(by_history).distinct(), "rejected")
        fate = sets.join(rejected.withColumn("bad", F.lit(True)), "rid", "left").select("set_hash_1", "set_hash_2", "first", F.coalesce("bad", F.lit(False)).alias("bad"))
        judged = own.select("_id", "set_hash_1", "set_hash_2").join(fate, ["set_hash_1", "set_hash_2"]).select(F.col("_id").alias(key), (F.col("bad") | (F.col("_id") > F.col("first"))).alias("repeated"))
        return rejected, judged


def repeated_chunks(chunks: DataFrame, key: str, text: str, history: DataFrame, history_text: str, num: int = 7, den: int = 10, cell: int = CELL, parts: int = PARTS) -> DataFrame:
    """``key`` of the chunks not to be stored again, going through them by ``key``.

    The history is appended to a new ``HistoryIndex`` and the chunks are checked
    against it as one batch, whose order within is kept; so the result is that
    of going chunk by chunk.  As the index ends with this batch, its blocks are
    not appended (``HistoryIndex.check`` does).  A chunk is repeated if its text
    is alike to one of ``history`` or to an earlier chunk which is itself not
    repeated.  Texts without a word (null, blank) are alike to nothing, chunks
    without a key are left out.  Empty tables give no rows; other columns are
    ignored.
    """
    index = HistoryIndex(chunks.sparkSession, f"{shared_dir(chunks.sparkSession)}/history-{uuid.uuid4().hex}", num, den, parts, cell)
    old = index._add_texts(index._sets(history.select(word_hashes(F.col(history_text)).alias("words"))), 0)
    index._create(old)._add_blocks(old, 0)
    own = _batch_words(chunks, key, text)
    sets = stored(index._sets(own, F.min("_id").alias("first")), "batch-sets")
    return index._judged(own, sets, key, 1)[1].where("repeated").select(key)
