"""Ranked lists: exact vector search, lexical match over an inverted index, trigrams, BM25."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from recollex.functions.text import rank_tokens, set_similarity, trigrams
from recollex.runtime import stored

#: Queries that go to the executors at once; more are taken in blocks.
QUERY_BLOCK = 4096
#: The most rows and queries that meet in a cell, and values of a cell that are held at once.
CELL_ROWS, CELL_QUERIES, CELL_VALUES = 65536, 8192, 1 << 22
#: The same for BM25, where a cell of more rows leaves out more of them.
BM25_ROWS, BM25_QUERIES = 131072, 8192


def _blocks(queries: DataFrame, query: str) -> Iterator[pa.Table]:
    """The queries in blocks of about ``QUERY_BLOCK``, dealt by a hash of their key, so that each is in exactly one."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == b)
        yield part.toArrow().combine_chunks()


def _met_in_cells(queries: DataFrame, query: str, rows: DataFrame, row: str, judge: Callable[[pa.Table, pa.Table], pa.Table], kind: StructType, most_rows: int = CELL_ROWS, most_queries: int = CELL_QUERIES) -> DataFrame:
    """What ``judge`` makes of the queries and of the rows that they may see, met in cells.

    Both sides have a column ``_g``: a query sees the rows of its group, and all
    where its group is null.  A group is dealt into blocks of queries and of rows,
    every two of which meet in one cell; many small cells go to ``judge`` at once,
    which takes them apart by ``_cells``.  Only counts of groups are joined and
    only one number goes to the driver.
    """
    spread = rows.withColumn("_g", F.explode(F.array_distinct(F.array("_g", F.lit(None).cast(rows.schema["_g"].dataType)))))
    asks = queries.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / most_queries).cast("int").alias("_nq"))
    holds = spread.groupBy(F.col("_g").alias("_h")).agg(F.count(F.lit(1)).alias("_n"), F.ceil(F.count(F.lit(1)) / most_rows).cast("int").alias("_nr"))
    cells = stored(asks.join(holds, F.col("_g").eqNullSafe(F.col("_h"))).select("_h", "_n", "_nq", "_nr", F.monotonically_increasing_id().alias("_i")), "cells")
    moved = cells.agg(F.sum(F.col("_n") * F.col("_nq"))).first()[0] or 0
    buckets = max(64, 2 * -(-moved // most_rows))

    def dealt(df: DataFrame, key: str, own: str, others: str, x: str, y: str) -> DataFrame:
        placed = df.join(cells, F.col("_g").eqNullSafe(F.col("_h"))).withColumns({x: F.pmod(F.xxhash64(key), F.col(own)).cast("int"), y: F.explode(F.sequence(F.lit(0), F.col(others) - 1))})
        placed = placed.withColumn("_b", F.pmod(F.xxhash64("_i", "_x", "_y"), F.lit(buckets)).cast("int")).drop("_g", "_h", "_n", "_nq", "_nr")
        return placed.select(*[F.col(c).alias(c) for c in placed.columns])  # columns of its own, as both sides come from one table

    left, right = dealt(queries, query, "_nq", "_nr", "_y", "_x"), dealt(spread, row, "_nr", "_nq", "_x", "_y")
    return left.groupBy("_b").cogroup(right.groupBy("_b")).applyInArrow(judge, kind)


def _cells(asked: pa.Table, held: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The cells of a bucket that have both sides: places of the queries, and of the rows."""

    def sides(table: pa.Table) -> dict[tuple, np.ndarray]:
        keys = np.stack([table.column(c).to_numpy() for c in ("_i", "_x", "_y")], axis=1)
        order = np.lexsort(keys.T[::-1])
        edges = np.flatnonzero(np.any(keys[order[1:]] != keys[order[:-1]], axis=1)) + 1
        return {tuple(keys[part[0]].tolist()): part for part in np.split(order, edges) if len(part)}

    left, right = sides(asked), sides(held)
    for cell, at in left.items():
        if cell in right:
            yield at, right[cell]


def _leading(table: np.ndarray, k: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (line, column) of at least the k highest values of each line and all within ``margin`` below, and a value that k of each line reach."""
    lines, n = table.shape
    if n <= k:
        bound = np.full(lines, -np.inf)
    else:
        # k of the maxima of disjoint parts are k values, so the k-th of them is no more than the k-th of all.
        m = n // 32
        most = table[:, : m * 32].reshape(lines, 32, m).max(axis=1) if m >= 4 * k else table
        bound = np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k]
    i, j = np.nonzero((table >= (bound - margin)[:, None]) & (table > -np.inf))
    return i, j, bound


def _best_of_cell(who: np.ndarray, what: np.ndarray, value: np.ndarray, k: int, margin: float) -> np.ndarray:
    """Places of the k highest values of each ``who``, and of those within ``margin`` below the k-th."""
    order = np.lexsort((-value, who))
    first = np.searchsorted(who[order], who[order])
    last = np.minimum(first + k - 1, np.searchsorted(who[order], who[order], side="right") - 1)
    return order[value[order] >= value[order][last] - margin]


def _matrices(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The length of each vector (0: none), its line, and the unit vectors of each length as lines of a matrix."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    line, by_length = np.zeros(len(length), np.int64), {}
    for width in np.unique(length[length > 0]).tolist():
        at = np.flatnonzero(length == width)
        v = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width)
        size = np.linalg.norm(v, axis=1)
        length[at[~(size > 0)]] = 0
        line[at], by_length[width] = np.arange(len(at)), np.divide(v, size[:, None], out=np.zeros_like(v), where=size[:, None] > 0)
    return length, line, by_length


def _nearest_in_cells(query: str, row: str, k: int, least: float | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def judge(asked: pa.Table, held: pa.Table) -> pa.Table:
        (wide, place, vectors), (size, line, matrix) = _matrices(asked.column("_v")), _matrices(held.column("_v"))
        who, what, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for ask, hold in _cells(asked, held):
            for width in np.unique(wide[ask]).tolist():
                a, h = ask[wide[ask] == width], hold[size[hold] == width]
                if not width or not len(h):
                    continue
                right = matrix[width][line[h]].T
                step = max(1, CELL_VALUES // len(h))
                for at in range(0, len(a), step):
                    cosines = vectors[width][place[a[at : at + step]]] @ right
                    if least is not None:
                        cosines[cosines < least] = -np.inf
                    i, j, _ = _leading(cosines, k, 2e-9)
                    kept = _best_of_cell(i, j, cosines[i, j], k, 2e-9)
                    i, j = i[kept], j[kept]
                    who.append(a[at + i])
                    what.append(h[j])
                    value.append(cosines[i, j])
        return pa.table([asked.column(query).take(pa.array(np.concatenate(who))), held.column(row).take(pa.array(np.concatenate(what))), pa.array(np.concatenate(value))], names=[query, "_row", "cosine"])

    return judge


def nearest(queries: DataFrame, query: str, query_vector: str, rows: DataFrame, row: str, vector: str, k: int, least: float | None = None, skip_self: bool = False, group: str | None = None) -> DataFrame:
    """``(query, row, cosine, rank)``: the k rows of highest cosine for each query, exactly; ties go to the smaller row.

    Each partition multiplies its vectors with a block of queries and keeps k a
    query, a window keeps k of all.  Null, empty and zero vectors, and those of
    another length, match nothing.  Queries are taken about ``QUERY_BLOCK`` at a
    time.  ``least`` drops lower cosines, ``skip_self`` rows whose key equals the
    query's; with ``group``, a column of both sides, a query sees the rows of its
    group, and all where its group is null: then queries and rows meet in cells
    of their group, and nothing of other groups is multiplied.
    """
    q = queries.where(F.size(query_vector) > 0).select(query, F.col(query_vector).alias("_v"), *([F.col(group).alias("_g")] if group else []))
    kind = StructType([StructField(query, queries.schema[query].dataType), StructField("_row", rows.schema[row].dataType), StructField("cosine", DoubleType())])
    out = None
    if group:
        own = rows.select(row, F.col(vector).alias("_v"), F.col(group).alias("_g"))
        out = _met_in_cells(q, query, own, row, _nearest_in_cells(query, row, k + (1 if skip_self else 0), least), kind)
    for block in () if group else _blocks(q, query):
        names = pa.array(block.column(query).to_pylist(), block.schema.field(query).type)
        width = max((len(v) for v in block.column("_v").to_pylist()), default=0)
        matrix = np.array([v if len(v) == width else [0.0] * width for v in block.column("_v").to_pylist()], np.float64).reshape(len(names), width)
        norm = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)
        live = norm[:, 0] > 0

        def run(batches: Iterator[pa.RecordBatch], names=names, matrix=matrix, live=live, width=width) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column(vector)), width), False)
                at = np.flatnonzero(fits.to_numpy(zero_copy_only=False)) if width else np.zeros(0, np.int64)
                if not len(at) or not len(names):
                    continue
                v = batch.column(vector).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                v = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
                cosines = np.where((size[:, 0] > 0)[None, :] & live[:, None], matrix @ v.T, -np.inf)
                if least is not None:
                    cosines[cosines < least] = -np.inf
                # Rows tied with the k-th stay, so that ties are broken over all partitions.
                keep = min(k + (1 if skip_self else 0), len(at))
                bound = np.partition(cosines, len(at) - keep, axis=1)[:, len(at) - keep]
                i, j = np.nonzero((cosines >= bound[:, None] - 1e-12) & np.isfinite(cosines))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), batch.column(row).take(pa.array(at[j])), pa.array(cosines[i, j])], names=[query, "_row", "cosine"])

        part = rows.select(row, vector).mapInArrow(run, kind)
        out = part if out is None else out.unionByName(part)
    if skip_self:
        out = out.where(F.col(query) != F.col("_row"))
    order = Window.partitionBy(query).orderBy(F.round("cosine", 9).desc(), "_row")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query, F.col("_row").alias(row), "cosine", "rank")


def similarity_pairs(rows: DataFrame, key: str, vector: str, least: float, block: int = 1024, group: str | None = None) -> DataFrame:
    """``(a, b, cosine)``, a < b: every pair of vectors with a cosine above ``least``; rows go against all rows in blocks.

    Every block of vectors meets every other in a task of its own, as a matrix
    product.  With ``group``, only rows of one group meet; null is a group too.
    """
    kind = rows.schema[key].dataType.simpleString()
    full = rows.where(F.size(vector) > 0).select(F.col(key).alias("_k"), F.col(vector).alias("_v"), (F.lit(0) if group is None else F.col(group)).alias("_g"))
    blocks = full.groupBy(F.col("_g").alias("_h")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"))
    dealt = full.join(blocks, F.col("_g").eqNullSafe(F.col("_h"))).withColumn("_b", F.pmod(F.xxhash64("_k"), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select("_g", "_k", "_v", "_b", F.least("_b", "_o").alias("_x"), F.greatest("_b", "_o").alias("_y"))

    def run(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x, y = keys[1].as_py(), keys[2].as_py()
        b = table.column("_b").to_numpy()
        v = np.array(table.column("_v").to_pylist(), np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        left, right = np.flatnonzero(b == x), np.flatnonzero(b == y)
        i, j = np.nonzero(v[left] @ v[right].T > least)
        names = table.column("_k")
        one, two = names.take(pa.array(left[i])).to_pylist(), names.take(pa.array(right[j])).to_pylist()
        cosine = (v[left[i]] * v[right[j]]).sum(axis=1)
        keep = [(min(p, q), max(p, q), float(c)) for p, q, c in zip(one, two, cosine, strict=True) if p != q and (x != y or p < q)]
        a, b2, c = zip(*keep, strict=True) if keep else ((), (), ())
        return pa.table({"a": pa.array(a, names.type), "b": pa.array(b2, names.type), "cosine": pa.array(c, pa.float64())})

    return dealt.groupBy("_g", "_x", "_y").applyInArrow(run, f"a {kind}, b {kind}, cosine double")


def maxsim_scores(queries: DataFrame, rows: DataFrame, pair: str, key: str, vector: str, block: int = 1024) -> DataFrame:
    """``(pair, score)``: late interaction of the query vectors of each pair with all row vectors of the pair.

    For each query vector the best product with any row vector, summed.  Blocks
    of both sides meet as matrix products, whose maxima are partial; ``key`` is
    unique among a pair's queries.  A pair without vectors on a side gives nothing.
    """
    full = [df.where(F.size(vector) > 0).select(F.col(pair).alias("_g"), F.col(key).alias("_k"), F.col(vector).alias("_v")) for df in (queries, rows)]
    blocks = [df.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(n)) for df, n in zip(full, ("_nx", "_ny"), strict=True)]
    sizes = blocks[0].join(blocks[1], "_g")

    def dealt(df: DataFrame, own: str, other: str, asks: bool) -> DataFrame:
        placed = df.join(sizes, "_g").withColumn(f"_{own}", F.pmod(F.xxhash64("_k"), F.col(f"_n{own}")).cast("int"))
        return placed.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1))).select("_g", "_k", "_v", "_x", "_y", F.lit(asks).alias("_q"))

    def run(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("_q").to_pylist(), bool)
        v = np.array(table.column("_v").to_pylist(), np.float64)
        asked = table.filter(pa.array(asks))
        best = (v[asks] @ v[~asks].T).max(axis=1) if asks.any() and not asks.all() else None
        asked = asked if best is not None else asked.slice(0, 0)
        return pa.table({"_g": asked.column("_g"), "_k": asked.column("_k"), "_m": pa.array(best if best is not None else [], pa.float64())})

    kinds = dict(full[0].dtypes)
    met = dealt(full[0], "x", "y", True).unionByName(dealt(full[1], "y", "x", False))
    best = met.groupBy("_g", "_x", "_y").applyInArrow(run, f"_g {kinds['_g']}, _k {kinds['_k']}, _m double")
    return best.groupBy("_g", "_k").agg(F.max("_m").alias("_m")).groupBy(F.col("_g").alias(pair)).agg(F.sum("_m").alias("score"))


def inverted_index(rows: DataFrame, row: str, text: str) -> DataFrame:
    """``(token, row, tf, length)``; kept as a table it makes lexical search an equi-join."""
    tokens = rows.select(row, F.size(rank_tokens(F.col(text))).alias("length"), F.explode(rank_tokens(F.col(text))).alias("token"))
    return tokens.groupBy("token", row).agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length"))


def _py_rank_tokens(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if len(w) > 1]


def _py_trigrams(text: str) -> list[str]:
    padded = (f"  {w} " for w in re.split("[^a-z0-9]+", text.lower()) if w)
    return list({p[i : i + 3] for p in padded for i in range(len(p) - 2)})


def _postings(texts: list[str | None], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, count) of the known terms, by term and document, and the number of all tokens of each document."""
    size = np.zeros(len(texts), np.int64)
    terms, places = [], []
    for i, t in enumerate(texts):
        if t:
            words = _py_rank_tokens(t)
            size[i] = len(words)
            hit = [n for n in map(vocabulary.get, words) if n is not None]
            terms += hit
            places += [i] * len(hit)
    both = np.array(terms, np.int64) * max(1, len(texts)) + np.array(places, np.int64)
    pairs, count = np.unique(both, return_counts=True)
    return pairs // max(1, len(texts)), pairs % max(1, len(texts)), count, size


def _bm25_in_cells(query: str, row: str, k: int, k1: float, b: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best of a cell for each query, exactly, without meeting the rows that hold common words alone.

    The most that a word can add is its highest value in the cell.  A query's
    words are taken from the one that can add most; once k rows have more than
    all words still to come can add together, no other row can be among the k,
    and those words are only looked up for the rows at hand.
    """

    def judge(asked: pa.Table, held: pa.Table) -> pa.Table:
        who, what, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        texts, words, idfs, mean = held.column("_t").combine_chunks(), asked.column("_w").combine_chunks(), asked.column("_idf").combine_chunks(), held.column("_mean").combine_chunks()
        for ask, hold in _cells(asked, held):
            lists, weights = words.take(pa.array(ask)).to_pylist(), idfs.take(pa.array(ask)).to_pylist()
            vocabulary: dict[str, int] = {}
            terms = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int64) for ws in lists]
            n = len(hold)
            term, place, count, size = _postings(texts.take(pa.array(hold)).to_pylist(), vocabulary)
            part = count * (k1 + 1) / (count + k1 * (1 - b + b * size[place] / max(mean[int(hold[0])].as_py(), 1e-9)))
            edges = np.searchsorted(term, np.arange(len(vocabulary) + 1))
            most = np.zeros(len(vocabulary))
            np.maximum.at(most, term, part)
            common: dict[int, np.ndarray] = {}

            def looked_up(t: int, rows: np.ndarray) -> np.ndarray:
                """What a term has in some rows; lists that are long are laid out as a whole."""
                own = slice(edges[t], edges[t + 1])
                docs = place[own]
                if len(docs) * 16 >= n:
                    if t not in common:
                        common[t] = np.zeros(n, np.float64)
                        common[t][docs] = part[own]
                    return common[t][rows]
                if not len(docs):
                    return np.zeros(len(rows))
                at = np.minimum(np.searchsorted(docs, rows), len(docs) - 1)
                return np.where(docs[at] == rows, part[own][at], 0.0)

            total, seen = np.zeros(n), np.zeros(n, bool)
            for q, (ids, gain) in enumerate(zip(terms, weights, strict=True)):
                gain = np.array(gain, np.float64)
                order = np.argsort(-(gain * most[ids]), kind="stable")
                ids, gain = ids[order], gain[order]
                rest = np.append(np.cumsum((gain * most[ids])[::-1])[::-1], 0.0)
                met, reached = [], 0.0
                for x, t in enumerate(ids.tolist()):
                    if reached > rest[x] + 1e-5:
                        break
                    own = slice(edges[t], edges[t + 1])
                    docs = place[own]
                    fresh = docs[~seen[docs]]
                    seen[fresh] = True
                    met.append(fresh)
                    total[docs] += gain[x] * part[own]
                    if len(docs) and rest[x + 1] < rest[0]:
                        now = total[np.concatenate(met)]
                        if len(now) >= k:
                            reached = np.partition(now, len(now) - k)[len(now) - k]
                else:
                    x = len(ids)
                rows = np.concatenate(met) if met else np.zeros(0, np.int64)
                score = total[rows]
                total[rows], seen[rows] = 0.0, False
                for y in range(x, len(ids)):
                    # Rows that even all words to come cannot lift among the k are left.
                    kept = score + rest[y] >= reached - 1e-5
                    rows, score = rows[kept], score[kept]
                    score = score + gain[y] * looked_up(int(ids[y]), rows)
                    if len(score) >= k:
                        reached = max(reached, np.partition(score, len(score) - k)[len(score) - k])
                if len(score) > k:
                    kept = score >= np.partition(score, len(score) - k)[len(score) - k] - 2e-6
                    rows, score = rows[kept], score[kept]
                who.append(np.full(len(rows), ask[q]))
                what.append(hold[rows])
                value.append(score)
        return pa.table([asked.column(query).take(pa.array(np.concatenate(who))), held.column(row).take(pa.array(np.concatenate(what))), pa.array(np.concatenate(value))], names=[query, row, "score"])

    return judge


def bm25(queries: DataFrame, query: str, query_text: str, rows: DataFrame, row: str, text: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``(query, row, score, rank)``: the k best rows by BM25 with statistics over all rows; ties go to the smaller row.

    Repeated query words count as often as they occur.  Null and empty texts
    match nothing, but count as documents.
    """
    own = rows.select(row, F.col(text).alias("_t"))
    tokens = F.coalesce(rank_tokens(F.col("_t")), F.array().cast("array<string>"))
    asked = queries.where(F.col(query_text).isNotNull()).select(query, F.col(query_text).alias("_t")).withColumn("_w", F.explode(tokens)).groupBy(query, "_w").agg(F.count(F.lit(1)).alias("_times"))
    counts = own.select(F.explode(F.array_distinct(tokens)).alias("_w")).groupBy("_w").agg(F.count(F.lit(1)).alias("_df"))
    sizes = own.agg(F.count(F.lit(1)).alias("_docs"), F.sum(F.size(tokens)).alias("_all")).first()
    docs, mean = sizes["_docs"], float(sizes["_all"] or 0) / max(1, sizes["_docs"])
    idf = F.log((F.lit(float(docs)) - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1.0) * F.col("_times")
    q = asked.join(counts, "_w").groupBy(query).agg(F.sort_array(F.collect_list(F.struct("_w", idf.alias("_idf")))).alias("_l")).select(query, F.col("_l._w").alias("_w"), F.col("_l._idf").alias("_idf"), F.lit(None).cast("string").alias("_g"))
    # Questions of the same words have the same rows, so one of them asks for all.
    lists = stored(q.withColumn("_lead", F.min(query).over(Window.partitionBy("_w", "_idf"))), "words-asked")
    held = own.where(F.col("_t").isNotNull()).select(row, "_t", F.lit(mean).alias("_mean"), F.lit(None).cast("string").alias("_g"))
    kind = StructType([StructField(query, queries.schema[query].dataType), StructField(row, rows.schema[row].dataType), StructField("score", DoubleType())])
    out = _met_in_cells(lists.where(F.col(query) == F.col("_lead")).drop("_lead"), query, held, row, _bm25_in_cells(query, row, k, k1, b), kind, BM25_ROWS, BM25_QUERIES)
    order = Window.partitionBy(query).orderBy(F.round("score", 6).desc(), row)
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.withColumnRenamed(query, "_lead").join(lists.select(query, "_lead"), "_lead").select(query, row, "score", "rank")


#: Code of each byte in a trigram: letters and digits, 0 for what parts words.
_SIGNS = np.zeros(256, np.int64)
_SIGNS[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = np.arange(1, 37)
#: Rows whose trigrams are laid out at once.
GRAM_ROWS = 8192


def _trigram_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``(text, code)`` of the distinct trigrams of each text, ordered; words have two blanks before and one behind."""
    parts = [(t or "").lower().encode("ascii", "replace") for t in texts]
    signs = _SIGNS[np.frombuffer(b"\n\n" + b"\n\n".join(parts) + b"\n\n", np.uint8)]
    owner = np.repeat(np.arange(len(parts)), [len(p) + 2 for p in parts])
    at = np.flatnonzero(signs[2:]) + 2
    one, two = signs[at - 1], np.where(signs[at - 1] > 0, signs[at - 2], 0)
    last = at[signs[at + 1] == 0]
    codes = np.concatenate([two * 1369 + one * 37 + signs[at], signs[last - 1] * 1369 + signs[last] * 37])
    both = np.unique(owner[np.concatenate([at, last]) - 2] * 50653 + codes)
    return both // 50653, both % 50653


def _alike_in_cells(query: str, row: str, least: float, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Common trigrams as sums of lines of bytes, a line for each trigram of the queries and a byte for each row."""

    def judge(asked: pa.Table, held: pa.Table) -> pa.Table:
        texts = [asked.column("_t").combine_chunks(), held.column("_t").combine_chunks()]
        who, what, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for ask, hold in _cells(asked, held):
            owner, code = _trigram_codes(texts[0].take(pa.array(ask)).to_pylist())
            known, term = np.unique(code, return_inverse=True)
            number = np.full(50653, -1)
            number[known] = np.arange(len(known))
            edges = np.searchsorted(owner, np.arange(len(ask) + 1))
            count = np.diff(edges).astype(np.float32)
            bound = np.full(len(ask), least, np.float32)
            found = [[], [], []]
            for start in range(0, len(hold), GRAM_ROWS):
                own = hold[start : start + GRAM_ROWS]
                place, code = _trigram_codes(texts[1].take(pa.array(own)).to_pylist())
                size = np.bincount(place, minlength=len(own)).astype(np.float32)
                hit = number[code] >= 0
                lines = np.zeros((len(known), len(own)), np.uint8)
                lines[number[code[hit]], place[hit]] = 1
                step = max(1, min(64, CELL_VALUES // len(own)))
                for at in range(0, len(ask), step):
                    n = min(step, len(ask) - at)
                    common = np.zeros((n, len(own)), np.float32)
                    for i in range(n):
                        terms = term[edges[at + i] : edges[at + i + 1]]
                        if len(terms):
                            common[i] = np.add.reduce(lines[terms], axis=0, dtype=np.uint8 if len(terms) < 256 else np.uint32)
                    alike = count[at : at + n, None] + size
                    alike -= common
                    np.divide(common, np.maximum(alike, 1.0, out=alike), out=alike)
                    # Single precision chooses, with room for its error; double precision decides.
                    alike[alike < (bound[at : at + n] - 1e-6)[:, None]] = -np.inf
                    i, j, reached = _leading(alike, k, 1e-6)
                    bound[at : at + n] = np.maximum(bound[at : at + n], reached)
                    shared = common[i, j].astype(np.float64)
                    exact = shared / (count[at + i].astype(np.float64) + size[j] - shared)
                    kept = exact > least
                    for part, x in zip(found, (at + i[kept], own[j[kept]], exact[kept]), strict=True):
                        part.append(x)
            i, h, exact = (np.concatenate(x) for x in found)
            kept = _best_of_cell(i, h, exact, k, 2e-9)
            who.append(ask[i[kept]])
            what.append(h[kept])
            value.append(exact[kept])
        return pa.table([asked.column(query).take(pa.array(np.concatenate(who))), held.column(row).take(pa.array(np.concatenate(what))), pa.array(np.concatenate(value))], names=[query, row, "similarity"])

    return judge


def trigram_matches(queries: DataFrame, query: str, query_text: str, rows: DataFrame, row: str, text: str, least: float, k: int, group: str | None = None) -> DataFrame:
    """``(query, row, similarity, rank)``: the k most similar rows by shared trigrams, above ``least``; ties go to the smaller row; ``group`` as in ``nearest``.

    Without groups, of rows with the same text only the k smallest take part: the others come after these k.
    """
    none = F.lit(None).cast("string")
    q = queries.where(F.col(query_text).isNotNull()).select(query, F.col(query_text).alias("_t"), (F.col(group) if group else none).alias("_g"))
    own = rows.where(F.col(text).isNotNull()).select(row, F.col(text).alias("_t"), (F.col(group) if group else none).alias("_g"))
    if group is None:
        own = own.withColumn("_n", F.row_number().over(Window.partitionBy("_t").orderBy(row))).where(F.col("_n") <= k).drop("_n")
    kind = StructType([StructField(query, queries.schema[query].dataType), StructField(row, rows.schema[row].dataType), StructField("similarity", DoubleType())])
    out = _met_in_cells(q, query, own, row, _alike_in_cells(query, row, least, k), kind)
    order = Window.partitionBy(query).orderBy(F.round("similarity", 9).desc(), row)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def text_similarity(a, b):
    """Trigram similarity of two text columns."""
    return set_similarity(trigrams(a), trigrams(b))
