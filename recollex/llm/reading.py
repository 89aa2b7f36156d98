"""Reading level of each document: ordinal regression on features of its prose.

Every text is read once: its running prose is taken apart into sentences and
words (code, logs and markup don't count) and kept as a few sums and a bag of
words.  Word frequencies and the model of languages come from the bags of all
documents; then each document gets its features, and a proportional-odds model
fitted on the graded documents gives its grade.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.llm.plaintext import WORD, plain
from recollex.runtime import stored

#: A word is rare in full if it is less than this share of all words; so the table of frequencies has at most 1 / share rows.
RAREST = 1 / 250_000
#: Runs of characters are counted in so many places.
GRAM_PLACES = 1 << 15
#: Features of so many graded documents go to the driver; more stay on the executors, which form the sums of each step.
MOST_LABELS = 50_000
#: Rows of a block there.
FIT_BLOCK = 1024
GRADES = 18
#: The longest line of a narrow page; longer lines stand for themselves.
PAGE = 100

# Words that join clauses, and function words that tell four languages apart.
CONNECTIVES = frozenset(
    "although because since while whereas notwithstanding therefore consequently thereby thus hence however moreover furthermore nevertheless unless until when which that who whose whom where if though as so but and or nor yet subsequently besides otherwise meanwhile".split()
)
CLAUSE_WORDS = frozenset("which that who whose whom where when while although because since if unless until whereas though as thereby so but notwithstanding".split())
LANGUAGE_WORDS = {
    "en": frozenset("the a an of and to in is was it that for on with as by from be are this not but or at had has have which she he they we you i my its their our us before after while when".split()),
    "de": frozenset("der die das und ist nicht ein eine einen den dem des mit auf für von zu wir haben war sind bitte am im als auch sich wurde hat".split()),
    "fr": frozenset("le la les des une est et pas dans pour sur avec nous avons du au aux ce cette qui que ne il elle sont été vous en".split()),
    "es": frozenset("el la los las es y no un una de del en que con por para este esta está hay muy fue se su al lo como son vimos".split()),
}
_ABBREVIATION = re.compile(r"\b(?:e\.g|i\.e|etc|vs|cf|approx|resp|incl|no|nos|dr|mr|mrs|ms|prof|st|fig|sec|ver|est|dept|inc|ltd|jr|sr|al|ca|min|max|jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec|[a-z])\.", re.IGNORECASE)
_END = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s|$)")
_LOG = re.compile(r"^\W{0,3}(?:\d{4}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d|\d\d:\d\d:\d\d|(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b)")
_CODE = re.compile(
    r"^\s*(?:(?:def|class|function|fn|func|public|private|static|const|let|var|import|from|package|#include|using)\s+\w.*[:;{(]|(?:if|for|while|elif|else|try|except|with|switch|return)\b[^.?!]*[:;{)]\s*$|SELECT\s.+\sFROM\s|[\w.\[\]]+\s*(?:=|\+=|-=|:=|==)\s*\S|[\w.]+\([^)]*\);?\s*$|[{}()\[\];]+\s*$|#!|//|#\s?\w+\s\w+$|\$\s)"
)
_ASIDE = re.compile(r"^\s*(?:#{1,6}\s|\(c\)\s|\u00a9|--+\s.*\s--+\s*$|=+\s*$|page \d+ of \d+\s*$)", re.IGNORECASE)
_MARK = re.compile(r"^\s*(?:[-*•+‣◦·]|\d{1,3}[.)]|[A-Za-z][.)]|#{1,6}|>+|\|)\s+")
_SPEAKER = re.compile(r"^\s*(?:user|assistant|human|system|ai|bot|model)\s*:\s*", re.IGNORECASE)
_VOWELS = re.compile(r"[aeiouyàâäáãèéêëìíîïòóôöõùúûüœæ]+")


def _lines(text: str) -> Iterator[tuple[str, bool]]:
    """(line, begins an entry of its own) without code, logs, headings, notices and marks; an empty line ends a paragraph."""
    fenced = False
    for line in re.split(r"\r\n|[\n\r\u2028\u2029]", text):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
            yield "", True
            continue
        if fenced or _LOG.match(line) or _CODE.match(line) or _ASIDE.match(line):
            yield "", True
            continue
        bare = re.sub(r"^\s*(?:>\s?)+", "", line)
        entry = bool(_MARK.match(bare)) or bool(_SPEAKER.match(bare))
        bare = _SPEAKER.sub("", _MARK.sub("", bare))
        yield bare.strip(), entry


def _wrapped(lines: list[str]) -> bool:
    """Whether the line breaks of a paragraph are only those of a narrow page.

    Most lines that end no sentence are then followed by one that begins in
    lower case; a third is enough if every line is as full as it can be (the
    first word of the next would have made it longer than the longest).
    """
    broken = [(a, b) for a, b in zip(lines, lines[1:], strict=False) if not _END.search(a[-3:])]
    lower = sum(b[:1].islower() for _, b in broken)
    if not lower:
        return False
    width = max(map(len, lines))
    full = width <= PAGE and all(len(a) + 1 + len(b.split(None, 1)[0]) > width for a, b in zip(lines, lines[1:], strict=False))
    return (3 if full else 2) * lower > len(broken)


def sentences(text: str) -> list[str]:
    """Sentences of the running prose: entries and lines that stand for themselves count, wrapped lines are joined."""
    blocks: list[list[str]] = [[]]
    for line, entry in _lines(plain(text)):
        if not line:
            blocks.append([])
        elif entry:
            blocks.append([line])
        else:
            blocks[-1].append(line)
    out = []
    for block in blocks:
        if not block:
            continue
        for piece in [" ".join(block)] if _wrapped(block) else block:
            start = 0
            for end in _END.finditer(piece):
                mark = piece[end.start() : end.end()]
                if mark[0] == "." and end.end() < len(piece):
                    before = piece[max(0, end.start() - 8) : end.start() + 1]
                    hit = [m for m in _ABBREVIATION.finditer(before) if m.end() == len(before)]
                    after = piece[end.end() :].lstrip()[:1]
                    if hit and (hit[0].group().lower().rstrip(".") not in ("etc", "no", "min", "max", "al") or not after.isupper()):
                        continue
                out.append(piece[start : end.end()])
                start = end.end()
            if piece[start:].strip():
                out.append(piece[start:])
    return [s for s in out if WORD.search(s)]


def syllables(word: str) -> int:
    """Groups of vowels, a silent final e left out; at least one."""
    n = len(_VOWELS.findall(word))
    if n > 1 and word.endswith("e") and not word.endswith(("le", "ee", "ie", "ye", "ue", "oe")):
        n -= 1
    return max(1, n)


SUMS = ("n_sentences", "log_lengths", "n_words", "n_spoken", "n_syllables", "n_letters", "n_long", "n_types", "n_connectives", "n_clauses", *LANGUAGE_WORDS)
_BY_WORD = ("n_spoken", "n_syllables", "n_letters", "n_long", "n_connectives", "n_clauses", *LANGUAGE_WORDS)


class _Places(dict):
    """The place of each run of characters."""

    def __missing__(self, run: str) -> int:
        place = self[run] = xxhash.xxh32_intdigest(run) % GRAM_PLACES
        return place


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs of two to four characters of words and their ends, and of words themselves that are short; how many each word has."""
    places, flat, sizes = _Places(), [], []
    for word in words:
        bound = f"<{word}>"
        size = len(flat)
        flat += [places[bound[i : i + n]] for n in (2, 3, 4) for i in range(len(bound) - n + 1)]
        if len(word) < 6:
            flat.append(places[bound])
        sizes.append(len(flat) - size)
    return np.array(flat, np.int64), np.array(sizes, np.int64)


class _Words(dict):
    """Numbers of words, with what is known of each; a word is looked at once a process."""

    def __init__(self):
        super().__init__()
        self.hashes, self.rows = [], []
        self.table = (np.zeros(0, np.int64), np.zeros((0, len(_BY_WORD)), np.float32))

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        if word.isdigit():
            self.rows.append((0, 1, 0, 0, 0, 0, *(0,) * len(LANGUAGE_WORDS)))
            return number
        beats = syllables(word)
        self.rows.append((1, beats, len(word), beats >= 3, word in CONNECTIVES, word in CLAUSE_WORDS, *(word in ws for ws in LANGUAGE_WORDS.values())))
        return number

    def known(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, numbers named in ``_BY_WORD``) of every word."""
        if len(self.table[0]) < len(self):
            at = len(self.table[0])
            more = np.array(self.hashes[at:], np.uint64).view(np.int64), np.array(self.rows[at:], np.float32)
            self.table = tuple(np.concatenate(x) for x in zip(self.table, more, strict=True))
        return self.table


#: Words that a process remembers at most; they are forgotten between batches.
_REMEMBERED = 400_000


def batch_sums(texts: list[str | None], words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, sums named in ``SUMS``, bag sizes, word hashes, counts, words) of the texts that have prose."""
    rows, lists, counted = [], [], []
    for i, text in enumerate(texts):
        if text:
            said = sentences(text)
            parts = [WORD.findall(s.lower()) for s in said]
            ids = [words[w] for part in parts for w in part]
            if ids:
                rows.append(i)
                lists.append(ids)
                counted.append((len(parts), sum(map(log, map(len, parts))), sum(s.count(",") + s.count(";") for s in said)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, len(SUMS)), np.float32), *(np.zeros(0, np.int64) for _ in range(3)), pa.array([], pa.string())
    hashes, about = words.known()
    n = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter((i for ids in lists for i in ids), np.int64, n.sum())
    by_word = np.add.reduceat(about[flat], np.r_[0, np.cumsum(n)[:-1]], axis=0, dtype=np.float64)
    record = np.repeat(np.arange(len(n)), n)
    spoken = about[flat, 0] > 0
    bag, counts = np.unique(record[spoken] * len(words) + flat[spoken], return_counts=True)
    sizes = np.bincount(bag // len(words), minlength=len(n))
    column = dict(zip(_BY_WORD, by_word.T, strict=True)) | {"n_sentences": np.array(counted)[:, 0], "log_lengths": np.array(counted)[:, 1], "n_words": n, "n_types": sizes}
    column["n_clauses"] = column["n_clauses"] + np.array(counted)[:, 2]
    return np.array(rows, np.int64), np.stack([column[c] for c in SUMS], axis=1).astype(np.float32), sizes, hashes[bag % len(words)], counts, pa.array(list(words), pa.string()).take(pa.array(bag % len(words)))


def _lists(sizes: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values, kind))


def _read(key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            if len(words) > _REMEMBERED:
                words = _Words()
            rows, sums, sizes, hashes, counts, spelt = batch_sums(batch.column(text).to_pylist(), words)
            bag = [_lists(sizes, hashes, pa.int64()), _lists(sizes, counts, pa.int32()), pc.binary_join(_lists(sizes, spelt, pa.string()), " ")]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows)), *map(pa.array, sums.T.copy()), *bag], names=[key, *SUMS, "words", "counts", "spelt"])

    return run


def _bags(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, number) of every entry of the bags, and the words by number."""
    lists = pc.split_pattern(batch.column("spelt"), " ")
    row, words = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), lists.flatten()
    there = pc.not_equal(words, "")
    found = words.filter(there).dictionary_encode()
    return row[there.to_numpy(zero_copy_only=False)], found.indices.to_numpy(), found.dictionary.to_pylist()


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each run of characters occurs in each language, over the texts whose function words leave no doubt."""
    total = np.zeros((GRAM_PLACES, len(LANGUAGE_WORDS)))
    seen: dict[str, np.ndarray] = {}

    def add() -> None:
        if seen:
            places, sizes = _grams(list(seen))
            for language, n in enumerate(np.array(list(seen.values())).T):
                total[:, language] += np.bincount(places, weights=np.repeat(n, sizes), minlength=GRAM_PLACES)
        seen.clear()

    for batch in batches:
        said = np.stack([batch.column(c).to_numpy() for c in LANGUAGE_WORDS], axis=1)
        most = said.max(axis=1, initial=0)
        sure = (most >= 3) & (3 * np.sort(said, axis=1)[:, -2] <= most)
        row, number, words = _bags(batch)
        row, number = row[sure[row]], number[sure[row]]
        counts = np.bincount(number * len(LANGUAGE_WORDS) + said.argmax(axis=1)[row], minlength=len(words) * len(LANGUAGE_WORDS)).reshape(-1, len(LANGUAGE_WORDS))
        for i in np.flatnonzero(counts.any(axis=1)):
            seen[words[i]] = seen[words[i]] + counts[i] if words[i] in seen else counts[i]
        if len(seen) > _REMEMBERED:
            add()
    add()
    place, language = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(language), pa.array(total[place, language].astype(np.int64))], names=["place", "language", "n"])


def language_votes(read: DataFrame) -> np.ndarray:
    """(places x languages): the logarithm by which a run of characters speaks for each language.

    A naive Bayes model of the runs of characters of words.  It teaches itself
    from all texts whose function words leave no doubt; so a text without any
    function word is known by the make of its words.  ``read`` has the sums and
    bags of every document.
    """
    rows = read.select(*LANGUAGE_WORDS, "spelt").mapInArrow(_gram_counts, "place long, language long, n long").groupBy("place", "language").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((GRAM_PLACES, len(LANGUAGE_WORDS)))
    counts[rows["place"].to_numpy(np.int64), rows["language"].to_numpy(np.int64)] = rows["n"]
    taught = counts.sum(axis=0) > 0
    share = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * GRAM_PLACES))
    mean = share[:, taught].mean(axis=1, keepdims=True) if taught.any() else 0
    return np.where(taught, share - mean, 0).astype(np.float32)


class _Votes(dict):
    """Numbers of words, with what each says for each language; a word is looked at once a process."""

    def __init__(self, votes: np.ndarray):
        super().__init__()
        self.votes, self.table = votes, np.zeros((0, len(LANGUAGE_WORDS)))

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        """(rows x languages): the votes of all words of each bag, as often as they occur."""
        if len(self) > _REMEMBERED:
            self.clear()
            self.table = self.table[:0]
        row, number, words = _bags(batch)
        if new := [w for w in words if w not in self]:
            places, sizes = _grams(new)
            self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
            self.table = np.concatenate([self.table, np.add.reduceat(self.votes[places], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)])
        said = self.table[np.array([self[w] for w in words], np.int64)][number] * batch.column("counts").flatten().to_numpy()[:, None]
        return np.stack([np.bincount(row, weights=x, minlength=batch.num_rows) for x in said.T], axis=1)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, summed in portions, so that no task holds more than one."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        words, place = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.bincount(place, weights=np.concatenate([n for _, n in parts])).astype(np.int64))], names=["word", "n"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append(tuple(batch.column(c).flatten().to_numpy() for c in ("words", "counts")))
        if sum(len(w) for w, _ in held) > 2_000_000:
            yield summed(held)
            held = []
    if held:
        yield summed(held)


FEATURES = ("length_index", "words_per_sentence", "log_words_per_sentence", "syllables_per_word", "letters_per_word", "long_share", "diversity", "rarity", "connectives", "clause_depth", "log_length")


def _features(batch: pa.RecordBatch, frequent: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """The features of each row; ``rarity`` is that of the ``frequent`` words (sorted hashes), its last entry that of all others."""
    x = {c: batch.column(c).to_numpy().astype(np.float64) for c in SUMS}
    words = batch.column("words")
    values, counts = words.flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
    size = np.diff(words.offsets.to_numpy())
    record = np.repeat(np.arange(len(size)), size)
    at = np.searchsorted(frequent, values)
    at = np.where(np.r_[frequent, 0][at] == values, at, len(frequent)) if len(frequent) else np.zeros(len(values), np.int64)
    spoken = np.maximum(x["n_spoken"], 1)
    rare = np.bincount(record, weights=rarity[at] * counts, minlength=len(size)) / spoken
    words, sentences_ = np.maximum(x["n_words"], 1), np.maximum(x["n_sentences"], 1)
    # The geometric mean: one run of words without marks must not make a plain text a demanding one.
    usual = x["log_lengths"] / sentences_
    per_sentence, per_word = np.minimum(np.exp(usual), 80), np.minimum(x["n_syllables"] / words, 8)
    return np.stack(
        [
            0.39 * per_sentence + 11.8 * per_word - 15.59, per_sentence, usual, per_word, np.minimum(x["n_letters"] / spoken, 20), x["n_long"] / spoken,
            x["n_types"] / np.sqrt(spoken), rare, x["n_connectives"] / spoken, np.minimum(x["n_clauses"] / sentences_, 30), np.log(words),
        ],
        axis=1,
    )


@dataclass
class OrdinalModel:
    """P(grade > g) = 1 / (1 + exp(cut[g] - w.z)) for standardised features z, cuts in rising order."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, features: np.ndarray) -> np.ndarray:
        score = np.clip((features - self.mean) / self.scale, -6, 6) @ self.weights
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -500, 500)))

    def grade(self, features: np.ndarray) -> np.ndarray:
        """The median grade, between grades by how far the halves are apart."""
        over = self.above(features)
        return 1 + (over >= 0.5).sum(axis=1)


def _slope(weights: np.ndarray, cuts: np.ndarray, z: np.ndarray, grades: np.ndarray, n: int) -> np.ndarray:
    """What these of ``n`` rows add to the slope of the mean loss by weights, then by cuts."""
    wrong = cuts[None, :] - (z @ weights)[:, None]
    np.exp(np.clip(wrong, -500, 500, out=wrong), out=wrong)
    np.divide(1, np.add(wrong, 1, out=wrong), out=wrong)
    wrong -= grades[:, None] > np.arange(1, GRADES)[None, :]
    wrong /= n
    return np.r_[z.T @ wrong.sum(axis=1), -wrong.sum(axis=0)]


def _descend(slope_at: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int, above: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) by gradient steps (Adam); cuts are sums of positive gaps, ``above`` is how many of ``n`` rows exceed each grade."""
    share = np.clip(above / n, 1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(np.log((1 - share) / share))
    k = len(FEATURES)
    theta = np.r_[np.zeros(k), start[0], np.log(np.maximum(np.diff(start), 0.02))]
    first = second = np.zeros_like(theta)
    for step in range(1, steps + 1):
        gaps = np.exp(theta[k + 1 :])
        slope = slope_at(theta[:k], theta[k] + np.r_[0, np.cumsum(gaps)])
        by_cut = slope[k:]
        grad = np.r_[slope[:k] + ridge * theta[:k], by_cut.sum(), gaps * np.cumsum(by_cut[::-1])[::-1][1:]]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:k], theta[k] + np.r_[0, np.cumsum(np.exp(theta[k + 1 :]))]


def fit_ordinal(features: np.ndarray, grades: np.ndarray, ridge: float = 1e-3, steps: int = 1500) -> OrdinalModel:
    """Proportional odds with a ridge penalty, by gradient steps on all rows."""
    mean, scale = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-6)
    z = np.clip((features - mean) / scale, -6, 6)
    above = (grades[:, None] > np.arange(1, GRADES)[None, :]).sum(axis=0)
    return OrdinalModel(mean, scale, *_descend(lambda w, c: _slope(w, c, z, grades, len(z)), len(z), above, ridge, steps))


def fit_ordinal_rows(graded: DataFrame, ridge: float = 1e-3, steps: int = 1500) -> OrdinalModel:
    """The same model of a table ``(grade, *FEATURES)`` of any size; the driver gets sums only.

    The rows are stored as blocks of numbers, which are read once a step.
    """
    spread = [f(c) for f in (F.avg, F.stddev_pop) for c in FEATURES]
    first = list(graded.agg(F.count(F.lit(1)), *[F.count_if(F.col("grade") > g) for g in range(1, GRADES)], *spread).first())
    mean, scale = np.array(first[GRADES:], np.float64).reshape(2, -1)
    n, scale = first[0], np.maximum(scale, 1e-6)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.clip((np.stack([batch.column(c).to_numpy() for c in FEATURES], axis=1) - mean) / scale, -6, 6)
            rows = np.column_stack([z, batch.column("grade").to_numpy()])
            yield pa.RecordBatch.from_arrays([pa.array([rows[i : i + FIT_BLOCK].tobytes() for i in range(0, len(rows), FIT_BLOCK)], pa.binary())], names=["rows"])

    blocks = stored(graded.mapInArrow(packed, "rows binary"), "graded-blocks")

    def slope_at(weights: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(weights) + len(cuts))
            for batch in batches:
                for block in batch.column("rows"):
                    rows = np.frombuffer(block.as_buffer()).reshape(-1, len(FEATURES) + 1)
                    total += _slope(weights, cuts, rows[:, :-1], rows[:, -1], n)
            yield pa.RecordBatch.from_arrays([_lists(np.array([len(total)]), total, pa.float64())], names=["sums"])

        return np.sum([r[0] for r in blocks.mapInArrow(run, "sums array<double>").collect()], axis=0)

    return OrdinalModel(mean, scale, *_descend(slope_at, n, np.array(first[1:GRADES], np.float64), ridge, steps))


def reading_levels(documents: DataFrame, key: str, text: str, labels: DataFrame, grade: str, most_labels: int = MOST_LABELS) -> DataFrame:
    """``(key, language, grade, above_12, words_per_sentence, syllables_per_word)`` of every document with prose.

    ``language`` is the likeliest of en, de, fr and es by a model of the runs of
    characters in words (``language_votes``), null where nothing speaks for any.  ``grade`` is the model's median on the scale of
    ``labels``, ``above_12`` the probability of grade 13 or above.  Documents
    without a word of prose (null, empty, code or logs only) are left out;
    repeated documents come out each; extra columns are ignored.  Several
    ratings of a document count each; null and out-of-range grades don't.  With
    fewer than two different grades there is no model, and grade is null.
    The model is fitted on all graded documents, and frequencies and features
    cover all; with more than ``most_labels`` ratings the sums of the fit are
    formed on the executors.
    """
    kind = dict(documents.dtypes)[key]
    sums = ", ".join(f"{c} float" for c in SUMS)
    read = stored(documents.select(key, text).mapInArrow(_read(key, text), f"{key} {kind}, {sums}, words array<long>, counts array<int>, spelt string"), "text-sums")
    votes = language_votes(read)
    total = read.agg(F.sum("n_spoken")).first()[0] or 0
    counted = read.select("words", "counts").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = counted.where(F.col("n") >= max(2.0, total * RAREST)).toPandas().sort_values("word", ignore_index=True)
    frequent = counted["word"].to_numpy(np.int64)
    rarity = np.log(1 / np.r_[counted["n"].to_numpy(np.float64) / max(total, 1), RAREST])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, heard = np.array(list(LANGUAGE_WORDS), object), _Votes(votes)
        for batch in batches:
            x, said = _features(batch, frequent, rarity), heard.of(batch)
            language = np.where(np.ptp(said, axis=1) > 0, names[said.argmax(axis=1)], None)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(language, pa.string()), *map(pa.array, x.T.copy())], names=[key, "language", *FEATURES])

    columns = ", ".join(f"{c} double" for c in FEATURES)
    described = stored(read.mapInArrow(featured, f"{key} {kind}, language string, {columns}"), "text-features")
    rated = labels.where(F.col(grade).between(1, GRADES)).select(key, F.col(grade).cast("int").alias("grade"))
    graded = stored(described.join(rated, key).select("grade", *FEATURES), "graded-features")
    n, least, most = graded.agg(F.count(F.lit(1)), F.min("grade"), F.max("grade")).first()
    model = None
    if n and least < most and n > most_labels:
        model = fit_ordinal_rows(graded)
    elif n and least < most:
        table = graded.toPandas().sort_values(["grade", *FEATURES], ignore_index=True)
        model = fit_ordinal(table[list(FEATURES)].to_numpy(), table["grade"].to_numpy())

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in FEATURES], axis=1)
            none = pa.nulls(len(x))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key), batch.column("language"),
                    none.cast(pa.int32()) if model is None else pa.array(model.grade(x).astype(np.int32)),
                    none.cast(pa.float64()) if model is None else pa.array(model.above(x)[:, 11]),
                    pa.array(x[:, 1]), pa.array(x[:, 3]),
                ],
                names=[key, "language", "grade", "above_12", "words_per_sentence", "syllables_per_word"],
            )

    return described.mapInArrow(judged, f"{key} {kind}, language string, grade int, above_12 double, words_per_sentence double, syllables_per_word double")


def demanding_documents(levels: DataFrame, key: str, least: int = 13, language: str = "en") -> DataFrame:
    """Documents of one language at or above a grade."""
    return levels.where((F.col("language") == language) & (F.col("grade") >= least)).select(key)
