"""Approximate vector search: vectors in cells around centres, of which a query opens a few.

The centres are fitted on a bounded sample; every row is put into a cell.  How
many cells a query must open for a wanted recall is measured on the sample
against brute force, never assumed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollex.runtime import stored

#: Rows that the centres are fitted on at most, by a hash of their key.
SAMPLE = 20_000
#: Rows of a cell that one task compares; larger cells are dealt into blocks.
BLOCK = 8192


def _unit(lists: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of the lists of that width that aren't zero."""
    at = [i for i, v in enumerate(lists) if v is not None and len(v) == width]
    v = np.array([lists[i] for i in at], np.float64).reshape(len(at), width)
    size = np.linalg.norm(v, axis=1)
    live = size > 0
    return np.array(at, np.int64)[live], v[live] / size[live, None]


@dataclass
class CellIndex:
    """``rows`` is (cell, block, key, vector); ``probes`` cells, all ``blocks`` of each, are opened by a query."""

    rows: DataFrame
    centres: np.ndarray
    blocks: np.ndarray
    probes: int
    recall: float


def build(rows: DataFrame, key: str, vector: str, cells: int = 64, k: int = 10, least_recall: float = 0.95, sample: int = SAMPLE, seed: int = 3) -> CellIndex:
    """Fits ``cells`` centres (spherical k-means on at most ``sample`` rows) and puts every row with a vector into the cell of its nearest centre."""
    full = rows.where(F.size(vector) > 0).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    taken = full.orderBy(F.xxhash64(F.lit(seed), "key")).limit(sample).toArrow().column("vector").to_pylist()
    width = max(map(len, taken), default=0)
    _, v = _unit(taken, width)
    if not len(v):
        return CellIndex(full.select(F.lit(0).alias("cell"), F.lit(0).alias("block"), "key", "vector"), np.zeros((1, width)), np.ones(1, np.int64), 1, 1.0)
    rng = np.random.default_rng(seed)
    centres = v[rng.permutation(len(v))[: min(cells, len(v))]]
    for _ in range(12):
        own = (v @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _unit(batch.column("vector").to_pylist(), width)
            some = batch.take(pa.array(at))
            cell = (x @ centres.T).argmax(axis=1) if len(at) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), some.column("key"), some.column("vector")], names=["cell", "key", "vector"])

    kinds = dict(full.dtypes)
    placed = stored(full.mapInArrow(place, f"cell int, key {kinds['key']}, vector {kinds['vector']}"), "cell-index")
    blocks = np.ones(len(centres), np.int64)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a cell
        blocks[r["cell"]] = -(-r["n"] // BLOCK)
    share = F.element_at(F.array(*[F.lit(int(n)) for n in blocks]), F.col("cell") + 1)
    dealt = placed.select("cell", F.pmod(F.xxhash64("key"), share).cast("int").alias("block"), "key", "vector")
    probes, told = _calibrated(v, centres, k, least_recall, rng)
    return CellIndex(dealt, centres, blocks, probes, told)


def _calibrated(v: np.ndarray, centres: np.ndarray, k: int, least: float, rng) -> tuple[int, float]:
    """(cells to open, recall then) over some of the sample's own rows as queries."""
    asked = v[rng.permutation(len(v))[:256]]
    own = (v @ centres.T).argmax(axis=1)
    order = np.argsort(-(asked @ centres.T), axis=1)
    near = np.argsort(-(asked @ v.T), axis=1)[:, : k + 1]
    # In which of a query's cells, the nearest first, each true neighbour lies.
    step = np.empty_like(order)
    np.put_along_axis(step, order, np.arange(order.shape[1])[None, :], axis=1)
    opened = np.take_along_axis(step, own[near], axis=1)
    for probes in range(1, len(centres) + 1):
        found = float((opened < probes).mean())
        if found >= least:
            return probes, found
    return len(centres), 1.0


def neighbours(index: CellIndex, queries: DataFrame, query: str, vector: str, k: int = 10, skip_self: bool = False) -> DataFrame:
    """``(query, key, cosine, rank)``: the best k rows of the cells that each query opens; ties go to the smaller key."""
    centres, blocks, probes, kinds = index.centres, index.blocks, index.probes, dict(queries.dtypes)
    width = centres.shape[1]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _unit(batch.column(vector).to_pylist(), width)
            cells = np.argsort(-(x @ centres.T), axis=1)[:, : probes] if len(at) else np.zeros((0, probes), np.int64)
            own, cell = np.repeat(at, cells.shape[1]), cells.ravel()
            many = blocks[cell]
            block = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            some = batch.take(pa.array(np.repeat(own, many)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cell, many).astype(np.int32)), pa.array(block.astype(np.int32)), some.column(query), some.column(vector)], names=["cell", "block", "_q", "_v"])

    asked = queries.where(F.size(vector) > 0).select(query, vector).mapInArrow(opened, f"cell int, block int, _q {kinds[query]}, _v {kinds[vector]}")

    def best(keys: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        names = left.column("_q"), right.column("key")
        if not left.num_rows or not right.num_rows:
            return pa.table({"_q": names[0].slice(0, 0), "key": names[1].slice(0, 0), "cosine": pa.array([], pa.float64())})
        (a, x), (b, y) = _unit(left.column("_v").to_pylist(), width), _unit(right.column("vector").to_pylist(), width)
        qs, rs, cs = [], [], []
        for at in range(0, len(a), 256):
            cosine = x[at : at + 256] @ y.T
            keep = min(k + 1, len(b))
            bound = np.partition(cosine, len(b) - keep, axis=1)[:, len(b) - keep]
            i, j = np.nonzero(cosine >= bound[:, None] - 1e-12)
            qs.append(a[at + i])
            rs.append(b[j])
            cs.append(cosine[i, j])
        return pa.table({"_q": names[0].take(pa.array(np.concatenate(qs))), "key": names[1].take(pa.array(np.concatenate(rs))), "cosine": pa.array(np.concatenate(cs))})

    rows = index.rows
    met = asked.groupBy("cell", "block").cogroup(rows.groupBy("cell", "block")).applyInArrow(best, f"_q {kinds[query]}, key {dict(rows.dtypes)['key']}, cosine double")
    if skip_self:
        met = met.where(F.col("_q") != F.col("key"))
    order = Window.partitionBy("_q").orderBy(F.round("cosine", 9).desc(), "key")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("_q").alias(query), "key", "cosine", "rank")
