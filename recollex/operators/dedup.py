"""SimHash fingerprints, Hamming search by bands, and the guards around them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.functions.features import distinctive_words
from recollex.functions.scores import hamming


def with_simhash(df: DataFrame, key: str, text: str, out: str = "simhash") -> DataFrame:
    """``(key, out)``: 64-bit SimHash of each text, 0 for a text without tokens or null; one row in, one row out.

    Tokens are what white space parts; each has the first eight bytes of its
    md5, little-endian.  A row needs no other, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            if len(seen) > 500_000:
                seen.clear()
            tokens = [(t or "").lower().split() for t in batch.column(text).to_pylist()]
            n = np.array([len(x) for x in tokens], np.int64)
            flat = [w for x in tokens for w in x]
            for w in flat:
                if w not in seen:
                    seen[w] = int.from_bytes(hashlib.md5(w.encode("utf-8", "surrogatepass")).digest()[:8], "little")
            prints = np.zeros(len(n), np.uint64)
            if flat:
                bits = np.unpackbits(np.fromiter((seen[w] for w in flat), np.uint64, len(flat)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                full = np.flatnonzero(n)
                sums = np.add.reduceat(bits, (np.cumsum(n) - n)[full], axis=0, dtype=np.int64)
                prints[full] = np.packbits(2 * sums > n[full, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(prints.view(np.int64))], names=[key, out])

    return df.select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, {out} long")


def hamming_pairs(df: DataFrame, key: str, bits: str, most: int = 3, equal: int = 3) -> DataFrame:
    """``(bits_a, bits_b, distance)``: every two different fingerprints within ``most`` bits, a < b.

    Fingerprints are made distinct first (membership stays with the caller's
    rows) and cut into ``most + equal`` blocks; ``most`` bits leave ``equal`` of
    them untouched, so there is a table for every choice of ``equal`` blocks,
    whose joined bits are the key.  For 3 bits these are 20 tables with keys of 32
    bits, so a thousand million fingerprints meet less than one other by chance.
    A pair is verified and reported by its first equal choice only.
    """
    blocks = most + equal
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tables = [signed(sum(masks[i] for i in chosen)) for chosen in combinations(range(blocks), equal)]
    prints = df.where(F.col(bits).isNotNull()).select(F.col(bits).alias("bits")).distinct()
    value = lambda c, m: F.col(c).bitwiseAND(F.lit(m).cast("long"))
    rows = prints.select("bits", F.posexplode(F.array(*[value("bits", m) for m in tables])).alias("band", "value"))
    a, b = rows.withColumnRenamed("bits", "bits_a"), rows.withColumnRenamed("bits", "bits_b")
    distance = hamming(F.col("bits_a"), F.col("bits_b"))
    met = a.join(b, ["band", "value"]).where((F.col("bits_a") < F.col("bits_b")) & (distance <= most))
    first = F.coalesce(*[F.when(value("bits_a", m) == value("bits_b", m), F.lit(i)) for i, m in enumerate(tables)])
    return met.where(F.col("band") == first).select("bits_a", "bits_b", distance.cast("int").alias("distance"))


def nouns_diverge(a: Column, b: Column, least: float = 0.3) -> Column:
    """Whether two sets of distinctive words share less than ``least``; an empty side never diverges."""
    shared = F.size(F.array_intersect(a, b))
    return (F.size(a) > 0) & (F.size(b) > 0) & (shared / (F.size(a) + F.size(b) - shared) < least)


def fingerprint_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, class, simhash, words)`` of every text that is not null: texts of one fingerprint and the same distinctive words are a class, named by its least key."""
    kept = df.where(F.col(text).isNotNull()).select(key, text)
    marked = with_simhash(kept, key, text).join(kept, key).select(key, "simhash", F.array_sort(distinctive_words(F.col(text))).alias("words"))
    classes = marked.groupBy("simhash", "words").agg(F.min(key).alias("class"))
    return marked.join(classes, ["simhash", "words"]).select(key, "class", "simhash", "words")


def divergent_pairs(classes: DataFrame, most: int = 3) -> DataFrame:
    """``(class_a, class_b, bits_a, bits_b, distance, diverge)``, class_a < class_b: every two classes within ``most`` bits, those of one fingerprint too, and whether their words differ all the same."""
    one = classes.select("class", "simhash", "words").distinct()
    near = hamming_pairs(one, "class", "simhash", most)
    same = one.select(F.col("simhash").alias("bits_a"), F.col("simhash").alias("bits_b"), F.lit(0).alias("distance")).distinct()
    bits = near.unionByName(near.select(F.col("bits_b").alias("bits_a"), F.col("bits_a").alias("bits_b"), "distance")).unionByName(same)
    a, b = (one.withColumnsRenamed({"class": f"class_{x}", "simhash": f"bits_{x}", "words": f"_w{x}"}) for x in "ab")
    met = bits.join(a, "bits_a").join(b, "bits_b").where(F.col("class_a") < F.col("class_b"))
    return met.select("class_a", "class_b", "bits_a", "bits_b", "distance", nouns_diverge(F.col("_wa"), F.col("_wb")).alias("diverge"))
