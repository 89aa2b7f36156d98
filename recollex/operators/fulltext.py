"""Full-text match in web-search form over weighted fields: all words, "phrases", alternatives with or, -exclusions.

Texts become rows of lexemes once (``text_vectors``), which may be kept as a
table and appended to.  A query is led by its rarest lexeme: only rows that hold
it are met, by an equi-join, and then judged as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollex.functions.stemming import lexemes, plain_words

#: Weight of a match by field class.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
_PART = re.compile(r'(-?)"([^"]*)"|(\S+)')


@dataclass
class Search:
    """Alternatives, each a list of words and phrases that must all occur; and what must not."""

    options: list[list[tuple[str, ...]]] = field(default_factory=list)
    barred: list[tuple[str, ...]] = field(default_factory=list)


def parse(query: str | None, words: Callable[[str], list[str]] = plain_words) -> Search:
    """The search that a text in web-search form means; stop words ('_') count inside phrases only."""
    search, current, either = Search(), [], False
    for minus, phrase, word in _PART.findall(query or ""):
        if word.lower() == "or" and current:
            either = True
            continue
        barred = minus or (word[:1] == "-" and len(word) > 1)
        found = words(phrase or word.lstrip("-"))
        while found and found[0] == "_":
            found = found[1:]
        while found and found[-1] == "_":
            found = found[:-1]
        if not found:
            continue
        terms = tuple(found)
        if barred:
            search.barred.append(terms)
        elif either:
            search.options.append(current)
            current, either = [terms], False
        else:
            current.append(terms)
    search.options += [current] if current else []
    return search


def text_vectors(rows: DataFrame, keep: list[str], fields: dict[str, str], extra: dict[str, str] | None = None, stemmed: bool = True) -> DataFrame:
    """``(keep..., lexemes, weights, body)``: the distinct lexemes of each row, the weight of the best field each stands in, and all in order.

    ``fields`` maps text columns to a class of ``WEIGHTS``; ``extra`` maps
    columns of string arrays (dates and preferences to be found by) to a class,
    which count as fields of their own.  Null fields hold nothing.
    """
    words, extra = (lexemes if stemmed else plain_words), extra or {}
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lexemes array<string>, weights array<double>, body string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[dict[str, float]] = [{} for _ in range(batch.num_rows)]
            bodies: list[list[str]] = [[""] for _ in range(batch.num_rows)]
            for column, level in {**fields, **extra}.items():
                for i, value in enumerate(batch.column(column).to_pylist()):
                    for part in ([value] if isinstance(value, str) else value or []):
                        ws = words(part) if part else []
                        bodies[i] += [*ws, "|"]
                        for w in ws:
                            if w != "_" and names[i].get(w, 0.0) < WEIGHTS[level]:
                                names[i][w] = WEIGHTS[level]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array([list(x) for x in names], pa.list_(pa.string())), pa.array([list(x.values()) for x in names], pa.list_(pa.float64())), pa.array([" ".join(b) + " " for b in bodies], pa.string())],
                names=[*keep, "lexemes", "weights", "body"],
            )

    return rows.select(*dict.fromkeys([*keep, *fields, *extra])).mapInArrow(run, schema)


def _parsed(queries: DataFrame, query: str, query_text: str, group: str | None, words) -> DataFrame:
    kinds = dict(queries.dtypes)
    terms = "struct<need: array<string>, phrases: array<string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            options, barred, phrases = [], [], []
            for text in batch.column(query_text).to_pylist():
                search = parse(text, words)
                options.append([{"need": sorted({w for t in o for w in t if w != "_"}), "phrases": [f" {' '.join(t)} " for t in o if len(t) > 1]} for o in search.options])
                barred.append([t[0] for t in search.barred if len(t) == 1])
                phrases.append([f" {' '.join(t)} " for t in search.barred if len(t) > 1])
            kind = pa.list_(pa.struct([("need", pa.list_(pa.string())), ("phrases", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(options, kind), *[pa.array(x, pa.list_(pa.string())) for x in (barred, phrases)]], names=[*own, "options", "barred", "barred_phrases"])

    own = [query, *([group] if group else [])]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in own) + f", options array<{terms}>, barred array<string>, barred_phrases array<string>"
    return queries.select(query, query_text, *([group] if group else [])).mapInArrow(run, schema)


def search(queries: DataFrame, query: str, query_text: str, vectors: DataFrame, row: str, k: int, order: list[Column] | None = None, group: str | None = None, stemmed: bool = True) -> DataFrame:
    """``(query, row, score, rank)``: the k best rows of ``text_vectors`` that match, by the summed weight of the option's lexemes.

    Ties go by ``order`` (columns that ``vectors`` keeps), then to the smaller
    row.  With ``group``, a column of both sides, a query sees the rows of its
    group, and all where its group is null.  A query without lexemes matches nothing.
    """
    asked = _parsed(queries, query, query_text, group, lexemes if stemmed else plain_words)
    asked = asked.select(F.col(query).alias("_q"), *([F.col(group).alias("_g")] if group else []), "barred", "barred_phrases", F.posexplode("options").alias("_o", "_s"))
    asked = asked.select("_q", "_o", *(["_g"] if group else []), "barred", "barred_phrases", F.col("_s.need").alias("need"), F.col("_s.phrases").alias("phrases")).where(F.size("need") > 0)
    postings = vectors.select(F.col(row).alias("_row"), F.explode("lexemes").alias("lexeme"))
    wanted = asked.select("_q", "_o", F.explode("need").alias("lexeme"))
    known = postings.join(wanted.select("lexeme").distinct(), "lexeme", "left_semi").groupBy("lexeme").agg(F.count(F.lit(1)).alias("_df"))
    rarest = wanted.join(known, "lexeme", "left").groupBy("_q", "_o").agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("n"), "lexeme")).alias("_m"))
    led = rarest.where("_m.n > 0").select("_q", "_o", F.col("_m.lexeme").alias("lexeme"))
    met = led.join(postings, "lexeme").select("_q", "_o", "_row").join(asked, ["_q", "_o"])
    rows = met.join(vectors.withColumnRenamed(row, "_row"), "_row")
    holds = (F.size(F.array_except("need", "lexemes")) == 0) & F.forall("phrases", lambda p: F.contains("body", p)) & ~F.arrays_overlap("barred", "lexemes") & ~F.exists("barred_phrases", lambda p: F.contains("body", p))
    if group:
        holds &= F.col("_g").isNull() | (F.col("_g") == F.col(group))
    weight = F.aggregate("need", F.lit(0.0), lambda s, w: s + F.get("weights", F.array_position("lexemes", w).cast("int") - 1))
    scored = rows.where(holds).withColumn("score", weight)
    best = Window.partitionBy("_q", "_row").orderBy(F.col("score").desc())
    scored = scored.withColumn("_b", F.row_number().over(best)).where("_b = 1")
    place = Window.partitionBy("_q").orderBy(F.round("score", 9).desc(), *(order or []), "_row")
    return scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select(F.col("_q").alias(query), F.col("_row").alias(row), "score", "rank")
