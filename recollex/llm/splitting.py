"""Splitting oversized items at natural boundaries, with overlap.

Units (characters, or tokens of a tokenizer) have start offsets in one sorted
array, whose index is the prefix sum of units; boundaries of each kind are
sorted arrays of offsets.  A piece ends at the last boundary under the limit,
found by binary search; the next begins ``overlap`` units before that end.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BREAK = r"(?:\r\n|[\n\r\u2028\u2029\x0b\x0c\x85])"
#: Kinds of boundary from the strongest to the weakest; a piece may end before or after the white space there.
KINDS = tuple(
    re.compile(x)
    for x in (
        rf"(?:[^\S\n\r\u2028\u2029\x0b\x0c\x85]*{_BREAK}){{2,}}|\u2029",
        rf"{_BREAK}+",
        r"(?:(?<=[.!?…。！？])|(?<=[.!?…]['\")\]»”’]))\s+|(?<=[。！？])",
        r"\s+",
    )
)


def boundaries(text: str) -> list[list[int]]:
    """For each kind the sorted offsets at which a piece may end."""
    return [sorted({p for m in kind.finditer(text) for p in (m.start(), m.end())}) for kind in KINDS]


def _joined(text: str, at: int) -> bool:
    """Whether a cut at ``at`` would part a line end or a character and its marks."""
    if not 0 < at < len(text):
        return False
    return text[at - 1 : at + 1] == "\r\n" or text[at] == "\u200d" or text[at - 1] == "\u200d" or unicodedata.category(text[at]) in ("Mn", "Me", "Mc")


def cuts(text: str, limit: int, overlap: int, units: Sequence[int] | None = None) -> list[tuple[int, int]]:
    """(start, end) of each piece in characters.

    ``units`` are the sorted start offsets of units; None means that every
    character is one.  Pieces have at most ``limit`` units, each but the first
    begins ``overlap`` units before the end of the one before, and without these
    repeats they put the text together again.  Stronger boundaries go first as
    long as a piece is at least half full; then any boundary; then a hard cut.
    """
    if overlap >= limit or limit < 1 or overlap < 0:
        raise ValueError("0 <= overlap < limit must hold")
    n = len(text)
    total = n if units is None else len(units)
    index = (lambda p: p) if units is None else (lambda p: bisect_left(units, p))
    offset = (lambda i: min(i, n)) if units is None else (lambda i: n if i >= total else units[i])
    if total <= limit:
        return [(0, n)]
    kinds = boundaries(text)
    pieces, start, done = [], 0, 0
    while True:
        if total - index(start) <= limit:
            pieces.append((start, n))
            return pieces
        most = offset(index(start) + limit)
        end = 0
        for least in (max(done + 1, offset(index(start) + max(limit // 2, overlap + 1))), max(done, offset(overlap)) + 1):
            for offsets in kinds:
                i = bisect_right(offsets, most)
                if i and offsets[i - 1] >= least:
                    end = offsets[i - 1]
                    break
            if end:
                break
        if not end:
            end = most
            for back in range(1, 17):
                if not _joined(text, end):
                    break
                end = most - back
            else:
                end = most
            end = end if end > done else most
        pieces.append((start, end))
        done, start = end, offset(index(end) - overlap)


def split_items(df: DataFrame, key: str, text: str, limit: int = 800, overlap: int = 100, unit_offsets: Callable[[str], Sequence[int]] | None = None) -> DataFrame:
    """``(key, chunk_index, n_pieces, start, piece)``: every item, cut where it is over ``limit``.

    Items within the limit come out unchanged as one piece, an empty text as one
    empty piece, a null text as one null piece.  Repeated rows are each split on
    their own, other columns are left out, an empty table gives no rows.
    ``unit_offsets`` gives the start offsets of a text's units where these aren't
    characters.  A single text is the unit of work: it must fit a Python worker.
    """
    schema = f"{key} {dict(df.dtypes)[key]}, chunk_index int, n_pieces int, start int, piece string"
    if unit_offsets is None:
        short = F.col(text).isNull() | (F.length(text) <= limit)
        whole = df.where(short).select(key, F.lit(0).alias("chunk_index"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.col(text).alias("piece"))
        return whole.unionByName(df.where(~short).select(key, text).mapInArrow(_splitter(key, text, limit, overlap, None), schema))
    return df.select(key, text).mapInArrow(_splitter(key, text, limit, overlap, unit_offsets), schema)


def _splitter(key: str, text: str, limit: int, overlap: int, unit_offsets):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, number, count, start, piece = [], [], [], [], []
            for i, value in enumerate(batch.column(text).to_pylist()):
                spans = [(0, 0)] if value is None else cuts(value, limit, overlap, unit_offsets(value) if unit_offsets else None)
                for j, (a, b) in enumerate(spans):
                    rows.append(i)
                    number.append(j)
                    count.append(len(spans))
                    start.append(a)
                    piece.append(None if value is None else value[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(count, pa.int32()), pa.array(start, pa.int32()), pa.array(piece, pa.string())],
                names=[key, "chunk_index", "n_pieces", "start", "piece"],
            )

    return run


def token_offsets(encode_offsets: Callable[[str], Sequence[tuple[int, int]]]) -> Callable[[str], list[int]]:
    """Start offsets of tokens, each once, from a tokenizer's (start, end) pairs; the first is 0."""

    def offsets(text: str) -> list[int]:
        starts = sorted({a for a, _ in encode_offsets(text)} | ({0} if text else set()))
        return starts

    return offsets
