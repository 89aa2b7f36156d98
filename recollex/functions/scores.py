"""Decay, fingerprints and vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def retrievability(last: Column, strength: Column, as_of: Column, base: float = 1.0) -> Column:
    """exp(-t / (base * (1 + strength))) after t days; 1 where there was no access or it was just now."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(last)) / 86_400_000_000.0)
    return F.when(last.isNull() | (days < 0.001), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-days / (base * (1.0 + strength))))))


def decay_boost(r: Column) -> Column:
    return 0.3 + 0.9 * r


def strength_after(strength: Column, accesses: Column, growth: float = 0.5) -> Column:
    """Strength after a number of accesses; each adds growth / (1 + strength / 2).  Null counts as none."""
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), accesses.cast("int")))
    grown = F.aggregate(steps, strength.cast("double"), lambda s, _: s + growth / (1.0 + 0.5 * s))
    return F.when(F.coalesce(accesses, F.lit(0)) > 0, grown).otherwise(strength.cast("double"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def maxsim(query_tokens: Column, doc_tokens: Column) -> Column:
    """Late interaction: for each query vector the best product with a document vector, summed; 0 where a side is empty."""
    best = F.transform(query_tokens, lambda q: F.array_max(F.transform(doc_tokens, lambda d: dot(q, d))))
    empty = (F.size(query_tokens) == 0) | (F.size(doc_tokens) == 0)
    return F.when(empty, 0.0).otherwise(F.aggregate(best, F.lit(0.0), lambda s, x: s + x))
