"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds t(1) < t(2) < ... cut its score:
P(grade >= k) = sigmoid(score - t(k)). The expected grade is the sum of these tails, and the tail of the top grade
serves for selection. Features are the distinct lower-cased words and symbol runs of the whole text, the beginnings of
its longer words, and a few shape marks (share of repeated words, of words that repeat the one before, of capitals, of
symbols, length); each feature counts once, so length does not dilute it. An absolute-value penalty, weaker with more
rows, leaves weight on the few features that tell grades apart and none on words that merely met one grade.

The fit uses at most `most` rated rows, those with the smallest hash of the id; scoring covers every row and whole texts
in one narrow pass. Ratings: rows with a null rating, id or text are not learned from; repeated
rows count as often as they occur, each gets its row, and rows with a null id are scored by their text. Null and empty
texts get grade 0 and tail 0; a tail of just the bound is kept. With fewer than two grades the one grade is predicted, with no rating at all grade 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = regex.compile(r"\w+|[^\w\s]+")
MASK = (1 << 40) - 1
#: Letters of a longer word that are a feature by themselves.
BEGINNING = 5


def features(text: str) -> set[str]:
    """The distinct features of a text."""
    tokens = TOKEN.findall(text.lower())
    kinds = set(tokens)
    n = len(tokens)
    if n:
        symbols = sum(not (t[0].isalnum() or t[0] == "_") for t in tokens)
        words = text.split()
        again = sum(a == b for a, b in pairwise(words))
        capitals = sum(len(w) > 1 and w.isupper() for w in words)
        shape = {f"#distinct {10 * len(kinds) // n}", f"#symbols {10 * symbols // n}", f"#length {n.bit_length()}", f"#again {10 * again // len(words)}", f"#capitals {10 * capitals // len(words)}"}
        kinds |= {t[:BEGINNING] + "*" for t in kinds if len(t) > BEGINNING} | shape
    return kinds


def hashed(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) & MASK


@dataclass
class Model:
    """Sorted feature hashes with their weights, a mean score, and the thresholds between the grades."""

    grades: list[int]
    names: np.ndarray
    weight: np.ndarray
    threshold: np.ndarray

    def table(self) -> dict[int, float]:
        return dict(zip(self.names.tolist(), self.weight.tolist(), strict=True))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: list[np.ndarray], grade: np.ndarray, *, least_rows: int = 3, rounds: int = 400, penalty: float = 0.02, rate: float = 0.05) -> Model:
    """Full-batch Adam with proximal steps on the cumulative-link likelihood, the penalty falling as the root of the rows;
    thresholds stay ordered as a first one plus positive steps."""
    grades = sorted({*grade.tolist()})
    if len(grades) < 2:
        return Model(grades, np.empty(0, np.int64), np.empty(0), np.empty(0))
    size = np.array([len(r) for r in rows])
    names, column, seen = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    keep = seen >= least_rows
    names, slot = names[keep], np.cumsum(keep) - 1
    row = np.repeat(np.arange(len(rows)), size)[keep[column]]
    column = slot[column[keep[column]]]
    y = np.searchsorted(grades, grade)
    share = np.bincount(y, minlength=len(grades)) / len(y)
    balance = (1 / (len(grades) * share))[y]  # each grade weighs the same
    top = len(grades) - 1
    above = np.cumsum(share[::-1])[::-1][1:]
    start = -np.log(above / (1 - above))
    x = np.concatenate((np.zeros(len(names)), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))))
    m, v = np.zeros_like(x), np.zeros_like(x)
    w, lasso = len(names), penalty / np.sqrt(len(y))
    for t in range(1, rounds + 1):
        cuts = x[w] + np.concatenate(([0], np.cumsum(np.exp(x[w + 1 :]))))
        score = np.bincount(row, x[:w][column], minlength=len(rows))
        tail = _sigmoid(score[:, None] - cuts)
        full = np.concatenate((np.ones((len(y), 1)), tail, np.zeros((len(y), 1))), axis=1)
        slope = np.concatenate((np.zeros((len(y), 1)), tail * (1 - tail), np.zeros((len(y), 1))), axis=1)
        at = np.arange(len(y))
        p = np.maximum(full[at, y] - full[at, y + 1], 1e-9)
        by_score = -(slope[at, y] - slope[at, y + 1]) / p * balance / len(y)
        by_cut = np.zeros(top)
        np.add.at(by_cut, y[y > 0] - 1, (slope[at, y] / p * balance / len(y))[y > 0])
        np.add.at(by_cut, y[y < top], (-slope[at, y + 1] / p * balance / len(y))[y < top])
        steps = np.exp(x[w + 1 :]) * np.cumsum(by_cut[::-1])[::-1][1:]
        g = np.concatenate((np.bincount(column, by_score[row], minlength=w), [by_cut.sum()], steps))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        x = x - step * (m / (1 - 0.9**t))
        x[:w] = np.sign(x[:w]) * np.maximum(np.abs(x[:w]) - step[:w] * lasso, 0)
    cuts = x[w] + np.concatenate(([0], np.cumsum(np.exp(x[w + 1 :]))))
    some = x[:w] != 0
    return Model(grades, names[some], x[:w][some], cuts)


def fit(docs: DataFrame, ratings: DataFrame, rating: Column, *, most: int = 8000, least_rows: int = 3) -> Model:
    """Learns from rated documents; `rating` is an integer expression on `ratings(doc_id, ...)`.

    The sample has at most `most` ratings and at most `most` texts, those with the smallest hashes, so it and what the
    driver collects are bounded whatever the tables hold.
    """
    sample = ratings.select("doc_id", rating.cast("int").alias("grade")).dropna().orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(most)
    joined = docs.select("doc_id", "text").dropna().join(F.broadcast(sample), "doc_id").select("grade", "text", F.xxhash64("doc_id", "text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(map(hashed, features(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64())), batch.column(2)], ["grade", "features", "h"])

    got = joined.mapInArrow(task, "grade int, features array<long>, h long").orderBy("h").limit(most).toArrow()
    return fit_ordinal([np.array(x.as_py(), np.int64) for x in got.column(1)], np.array(got.column(0).to_pylist(), int), least_rows=least_rows)


def score(docs: DataFrame, model: Model, *, cache: int = 300_000) -> DataFrame:
    """One row per document row: doc_id, expected_grade and tail (the chance of the top grade)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words, cuts, grades = model.table(), {}, model.threshold, np.array(model.grades, float)

        def total(text: str | None) -> float:
            s = 0.0
            for f in features(text) if text else ():
                if (x := words.get(f)) is None:
                    if len(words) >= cache:
                        words.clear()
                    x = words[f] = table.get(hashed(f), 0.0)
                s += x
            return s

        for batch in batches:
            texts = batch.column(1).to_pylist()
            tails = _sigmoid(np.array([total(t) for t in texts]).reshape(-1, 1) - cuts) if len(grades) > 1 else np.empty((len(texts), 0))
            grade = (grades[0] if len(grades) else 0.0) + tails @ np.diff(grades) if len(grades) > 1 else np.full(len(texts), grades[0] if len(grades) else 0.0)
            tail = tails[:, -1] if len(grades) > 1 else np.full(len(texts), float(len(grades) == 1))
            none = np.array([not t for t in texts], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(none, 0.0, grade)), pa.array(np.where(none, 0.0, tail))], ["doc_id", "expected_grade", "tail"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, expected_grade double, tail double")


def graded(docs: DataFrame, labels: DataFrame, *, keep_tail: float = 0.5) -> DataFrame:
    """Every document's expected grade, tail and selection, where a toxic document is 0, a poor one 1 and a good one 2."""
    rating = F.when(F.col("toxic") == 1, 0).when(F.col("toxic") == 0, F.col("quality") + 1)
    scored = score(docs, fit(docs, labels, rating))
    return scored.withColumn("keep", F.col("tail") >= keep_tail)
