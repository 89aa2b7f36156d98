"""Filling fixed-capacity containers.

Token counts are at most the capacity, so the whole instance is a histogram of
at most ``capacity`` sizes, however many documents there are.  The histogram is
planned in one place: Martello-Toth dominance fixes the containers that no
other choice can beat, best fit decreasing places the rest.  The plan says
which ranks of which size go to which containers; documents get their rank
within their size from counts a partition, and look their container up.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollex.llm.tokens import TOKENIZER_DIR, encoding
from recollex.runtime import stored

#: (size, first rank, count, first container): ranks first..first+count-1 of a size go to as many containers in a row.
Segment = tuple[int, int, int, int]


class _Stock:
    """Sizes that are left, with counts."""

    def __init__(self, histogram: dict[int, int]):
        self.counts = {s: c for s, c in histogram.items() if c > 0}
        self.sizes = sorted(self.counts)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size]
            self.sizes.remove(size)

    def largest(self, room: int, without: dict[int, int] | None = None) -> int:
        """The largest size that fits, 0 if none; ``without`` holds copies that are spoken for."""
        i = bisect_right(self.sizes, room)
        while i:
            size = self.sizes[i - 1]
            if self.counts[size] > (without or {}).get(size, 0):
                return size
            i -= 1
        return 0

    def smallest(self, n: int, without: int) -> list[int]:
        """The n smallest copies, one copy of ``without`` left out."""
        out: list[int] = []
        for size in self.sizes:
            out += [size] * min(n - len(out), self.counts[size] - (size == without))
            if len(out) == n:
                break
        return out


def _dominant(stock: _Stock, s: int, capacity: int) -> list[int] | None:
    """Companions of an item of size s that no other choice beats, or None if that can't be told for up to three items."""
    room = capacity - s
    least = stock.smallest(3, s)
    if not least or least[0] > room:
        return []
    k = stock.largest(room, {s: 1})
    if k == room or len(least) == 1 or least[0] + least[1] > room:
        return [k]
    if len(least) == 2 or sum(least) > room:
        # At most two companions fit: a pair x >= y beats {k} and {k, b} only if y is larger than b.
        taken = {s: 1}
        taken[k] = taken.get(k, 0) + 1
        b = stock.largest(room - k, taken)
        above = next((y for y in stock.sizes[bisect_right(stock.sizes, b) :] if stock.counts[y] - taken.get(y, 0) > 0), 0)
        if not above or 2 * above > room:
            return [k, b] if b else [k]
    return None


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Segment], int, int]:
    """Segments, number of containers, and how many of these the dominance rules fixed."""
    stock = _Stock(histogram)
    used = dict.fromkeys(stock.counts, 0)
    segments: list[Segment] = []
    containers = 0

    def place(size: int, n: int, first: int) -> None:
        segments.append((size, used[size], n, first))
        used[size] += n

    for s in reversed(list(stock.sizes)):
        while stock.counts.get(s):
            companions = _dominant(stock, s, capacity)
            if companions is None:
                break
            need: dict[int, int] = {s: 1}
            for c in companions:
                need[c] = need.get(c, 0) + 1
            n = min(stock.counts[size] // copies for size, copies in need.items())
            if companions and sum(companions) < capacity - s:
                # Not a perfect fit: what is best may change once a size runs short.
                n = max(1, min(n, min(stock.counts[size] // copies for size, copies in need.items()) - 1))
            for size, copies in need.items():
                for _ in range(copies):
                    place(size, n, containers)
                stock.take(size, n * copies)
            containers += n
    fixed = containers
    open_: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    for s in reversed(list(stock.sizes)):
        left = stock.counts[s]
        while left:
            room = next((r for r in range(s, capacity) if open_[r]), capacity)
            if room == capacity:
                n, first = left, containers
                per = capacity // s
                n = -(-left // per) if per > 1 else left
                containers += n
            else:
                first, many = open_[room].pop()
                n = min(many, left)
                if n < many:
                    open_[room].append([first + n, many - n])
            place(s, n, first)
            left -= n
            if room > s:
                open_[room - s].append([first, n])
    return segments, containers, fixed


def _count_tokens(key: str, text: str, capacity: int, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = encoding(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        full_seen = 0
        for batch in batches:
            n = np.array([-1 if t is None else len(tokenizer.encode_ordinary(t)) for t in batch.column(text).to_pylist()], np.int64)
            full = np.where(n > capacity, n // capacity, 0)
            size = np.where(n < 0, 0, n - full * capacity)
            rank = np.empty(len(n), np.int64)
            before = np.empty(len(n), np.int64)
            for i, (s, f) in enumerate(zip(size.tolist(), full.tolist(), strict=True)):
                rank[i] = seen[s]
                seen[s] += 1
                before[i] = full_seen
                full_seen += f
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(n, pa.int64(), mask=n < 0), pa.array(full), pa.array(size.astype(np.int32)), pa.array(np.full(len(n), part, np.int32)), pa.array(rank), pa.array(before)],
                names=[key, "n_tokens", "n_full", "size", "part", "rank", "full_before"],
            )

    return run


def pack_texts(df: DataFrame, key: str, text: str, capacity: int = 2048, vocabulary: str = "byte_bpe_50k.tiktoken", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``(key, piece_no, n_pieces, first_token, n_tokens, container_id)`` for every row of ``df``.

    Only texts of more than ``capacity`` tokens are cut: into full containers
    and a rest, which is packed like any other text.  A text without tokens
    takes no room and goes to container 0; a null text has null tokens and no
    container.  Repeated rows are packed each; ties of size are broken by
    partition and position; an empty table gives no rows; other columns are left
    out.  The driver gets one histogram of at most ``capacity`` sizes.
    """
    kind = dict(df.dtypes)[key]
    schema = f"{key} {kind}, n_tokens long, n_full long, size int, part int, rank long, full_before long"
    counted = stored(df.select(key, text).mapInArrow(_count_tokens(key, text, capacity, f"{tokenizer_dir}/{vocabulary}"), schema), "token-counts")
    per_part = counted.groupBy("part", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("n_full").alias("f"))
    histogram = {r["size"]: r["n"] for r in per_part.groupBy("size").agg(F.sum("n").alias("n")).collect() if r["size"] > 0}
    segments, containers, _ = plan(histogram, capacity)
    earlier = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", "size", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    parts = per_part.groupBy("part").agg(F.sum("f").alias("f"))
    full_offsets = parts.select("part", F.coalesce(F.sum("f").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_full_before"))
    placed = counted.join(offsets, ["part", "size"]).join(full_offsets, "part")
    placed = placed.select(key, "n_tokens", "n_full", "size", (F.col("rank") + F.col("_before")).alias("rank"), (F.lit(containers) + F.col("_full_before") + F.col("full_before")).alias("full_first"))
    looked = placed.mapInArrow(_look_up(segments, capacity), f"{key} {kind}, n_tokens long, n_full long, size int, full_first long, container long")
    rest = (F.col("size") > 0) | (F.col("n_full") == 0)
    pieces = looked.select("*", (F.col("n_full") + F.when(rest, 1).otherwise(0)).cast("int").alias("n_pieces"))
    pieces = pieces.select("*", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece_no"))
    is_full = F.col("piece_no") < F.col("n_full")
    return pieces.select(
        key, "piece_no", "n_pieces", (F.col("piece_no") * F.lit(capacity).cast("long")).alias("first_token"),
        F.when(F.col("n_tokens").isNull(), F.lit(None)).when(is_full, F.lit(capacity)).otherwise(F.col("size")).cast("long").alias("n_tokens"),
        F.when(F.col("n_tokens").isNull(), F.lit(None)).when(is_full, F.col("full_first") + F.col("piece_no")).otherwise(F.col("container")).alias("container_id"),
    )


def _look_up(segments: list[Segment], capacity: int):
    """Containers by (size, rank).  Sent with the tasks: its length is bounded by sizes and capacity, not by documents."""
    table = np.array(sorted(segments), np.int64).reshape(-1, 4)
    starts = np.searchsorted(table[:, 0], np.arange(capacity + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            rank = batch.column("rank").to_numpy()
            container = np.zeros(len(size), np.int64)
            for s in np.unique(size):
                if s == 0:
                    continue
                own = table[starts[s] : starts[s + 1]]
                rows = size == s
                at = np.searchsorted(own[:, 1], rank[rows], side="right") - 1
                container[rows] = own[at, 3] + rank[rows] - own[at, 1]
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(container)], names=[*keep, "container"])

    return run


def split_documents(packed: DataFrame, key: str) -> DataFrame:
    """Documents that had to be cut."""
    return packed.where("piece_no = 0 AND n_pieces > 1").select(key)
