"""Toxicity scores from a weighted lexicon.

Texts are folded: lower case, accents of look-alike letters of other scripts mapped to Latin ones, digits and signs that
stand for letters put back. An Aho-Corasick automaton finds lexicon entries in the folded words; matches inside exception
phrases do not count. The weights of the matches, as a sum and by length, give the score through a logistic curve.

Entries are whole words or beginnings of words. They are learnt from labelled documents: Spark counts, for each word and
word beginning, the labelled documents that hold it, and the entries are those far commoner in toxic ones.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold_of, whole

#: Letters of other scripts that look like Latin ones, and their Latin letters.
HOMOGLYPHS = dict(zip("абвгеёзіїјкмнорсԁѕтухһԛԝɡαβγεηικνορτυχωⅼ", "abbreesiijkmhopcdstyxhqwgabyenikvoptuxwl", strict=True))
#: Digits and signs used for letters, inside words that also hold a letter.
SUBSTITUTES = dict(zip("013457@$!€£", "oieastasiel", strict=True))
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "scum layer", "pond scum", "stupid easy")

_FOLD = str.maketrans(HOMOGLYPHS)
_DIGITS = str.maketrans(SUBSTITUTES)
_WORD = re.compile(r"[^\W_]+(?:[@$!€£]+[^\W_]+)*[@$!€£]?|[@$!€£]+[^\W_]+(?:[@$!€£]+[^\W_]+)*", re.UNICODE)
_SUBSTITUTED = re.compile("[0-9@$!€£]")
#: Lengths of the word beginnings that may become entries.
STEMS = (4, 5, 6, 7)
#: Labelled rows that the lexicon and the curve are fitted on, at most; chosen by hash of the id.
TRAIN_ROWS = 30_000


def fold_words(text: str) -> list[str]:
    """The words of a text after folding; a trailing sign is punctuation unless letters follow it."""
    text = text.lower().translate(_FOLD)
    out = []
    for word in _WORD.findall(text):
        if not word[-1].isalnum():
            word = word.rstrip("@$!€£")
        if _SUBSTITUTED.search(word) and not word.isdigit():
            word = word.translate(_DIGITS)
        out.append(word)
    return out


@dataclass
class Lexicon:
    """Entries with weights (a trailing * marks a beginning), the phrases that do not count, and the curve's coefficients."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-4.0, 1.5, 1.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            built = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                key = f" {entry[:-1]}" if entry.endswith("*") else f" {entry} "
                if weight > built.get(key, (0.0, 0))[0]:
                    built.add_word(key, (weight, len(key)))
            for phrase in self.exceptions:
                key = f" {' '.join(fold_words(phrase))} "
                built.add_word(key, (0.0, len(key)))
            built.make_automaton()
            self._automaton = built
        return self._automaton

    def features(self, text: str) -> tuple[float, float, int, int]:
        """The sum of weights of matched words, that sum for 100 words, matched words, words."""
        words = fold_words(text)
        if not words or not (self.weights or self.exceptions):
            return 0.0, 0.0, 0, len(words)
        line = f" {' '.join(words)} "
        best: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (weight, size) in self.automaton().iter(line):
            start = end - size + 1
            if weight:
                best[start] = max(weight, best.get(start, 0.0))  # one match for each word: its heaviest entry
            else:
                free.append((start, end))
        if free:
            best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in free)}
        total = sum(best.values())
        return total, 100.0 * total / len(words), len(best), len(words)

    def score(self, text: str) -> tuple[float, int, int]:
        total, dense, hits, words = self.features(text)
        a, b, c = self.curve
        z = a + b * math.log1p(total) + c * math.log1p(dense)
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z)))), hits, words


def _terms(batches):
    """For each labelled text, its distinct words and word beginnings, once each."""
    for b in batches:
        terms, labels = [], []
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
            found = set()
            for word in set(fold_words(text or "")):
                found.add(word)
                found.update(f"{word[:n]}*" for n in STEMS if len(word) > n)
            terms += found
            labels += [label] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(labels, pa.int32())], ["term", "label"])


def train_rows(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", most: int = TRAIN_ROWS) -> DataFrame:
    """Text and label of at most `most` labelled rows: all, or those with the lowest hashes of their ids.

    Rows of labels without an id or a label are left out; of several labels of one id, the highest counts.
    """
    known = labels.filter(F.col(id).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id).alias("__id")).agg((F.max("toxic") > 0).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(most)
    return docs.select(F.col(id).alias("__id"), whole(text).alias("text")).join(F.broadcast(chosen), "__id").select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", most: int = TRAIN_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS, minimum: int = 6) -> Lexicon:
    """Learn the lexicon and the curve.

    An entry must occur in at least `minimum` toxic training documents and be, by smoothed log-odds with a margin of one
    standard error, at least e^2 times as likely in toxic ones. With no labelled row of either kind the lexicon is empty and
    every score is low.
    """
    rows = train_rows(docs, labels, id, text, most)
    sizes = dict(rows.groupBy("label").count().collect())  # two rows
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Lexicon({}, exceptions)
    counts = rows.mapInArrow(_terms, "term string, label int").groupBy("term").agg(F.sum("label").alias("toxic"), F.count("*").alias("all"))
    pos, neg = F.col("toxic") + 0.5, F.col("all") - F.col("toxic") + 0.5
    odds = F.log(pos / (n1 + 1.0)) - F.log(neg / (n0 + 1.0))
    low = odds - F.sqrt(1.0 / pos + 1.0 / neg)
    best = counts.filter(F.col("toxic") >= minimum).select("term", odds.alias("weight"), low.alias("low"), "toxic").filter("low >= 2.0").orderBy("term")
    lexicon = Lexicon({r.term: float(r.weight) for r in best.collect()}, exceptions)  # terms of at most `most` labelled rows, each in `minimum` of them
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches):
        for b in batches:
            got = [shared.value.features(t or "")[:2] for t in b.column("text").to_pylist()]
            cells = [(round(math.log1p(s), 1), round(math.log1p(d), 1)) for s, d in got]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.float64()), pa.array([c[1] for c in cells], pa.float64()), b.column("label")], ["s", "d", "label"])

    grid = rows.mapInArrow(measure, "s double, d double, label int").groupBy("s", "d", "label").count().orderBy("s", "d", "label").collect()  # cells of a grid, at most TRAIN_ROWS
    lexicon.curve = _logistic(grid)
    return lexicon


def _logistic(grid) -> tuple[float, float, float]:
    """Ridge-damped logistic regression by Newton's steps on counted cells."""
    x = np.array([[1.0, r["s"], r["d"]] for r in grid])
    y, n = np.array([float(r["label"]) for r in grid]), np.array([float(r["count"]) for r in grid])
    w, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """`docs` with score (0 to 1), n_matches and n_folded_words, from the whole text.

    Null and empty texts have no match and so the lowest score. Equal texts have equal scores; columns of docs with the added
    names are replaced.
    """
    kept = docs.drop("score", "n_matches", "n_folded_words")
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("score double, n_matches long, n_folded_words long")
    def scored(texts):
        import pandas as pd

        return pd.DataFrame([shared.value.score(t or "") for t in texts], columns=["score", "n_matches", "n_folded_words"])

    return kept.withColumn("__s", scored(whole(text))).select(*kept.columns, "__s.score", "__s.n_matches", "__s.n_folded_words")


def training_labels(labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """Labels of the rows that may be learnt from: crc32 of the id as text, modulo 5, is not 0."""
    return labels.filter(fold_of(id, 5) != 0)
