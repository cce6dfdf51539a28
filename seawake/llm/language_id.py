"""Language identification by the nearest of several centroids per language.

A text is lower-cased, every run of ASCII characters that are not letters becomes one space, and the 2-, 3- and 4-grams
of its UTF-8 bytes are counted in hashed buckets. Counts are damped by log(1 + n), weighted by inverse document frequency
and normalised. Each language's training vectors are clustered by spherical k-means; a text belongs to the language of
the centroid with the largest cosine. It is rejected where that cosine is below a limit, or where it has no letter.

The limit depends on the language and on the number of different n-grams of the text, as short and repetitive texts lie
farther from every centroid: for each class of such numbers it is a low quantile (`reject`) of the cosines of the training texts, and of short spans of them, to
the centroids of their language. A class with few of them takes the limit of the next smaller one.

The fit uses at most `per_language` labelled rows of each of the `languages` most frequent languages, picked by a hash of
the id; prediction covers every row and whole texts, and is one narrow pass. Null texts and texts without a letter are
`und` with score 0. Of centroids at equal cosine the first in the order of the languages wins. Repeated rows each get
their row, and count as often in the fit; rows with a null doc_id are learned from and predicted like others. Rows with a
null language are not learned from; without any training row every text is `und`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seawake.llm.words import cut, tidy

LETTER = regex.compile(r"\p{L}")
#: ASCII letters and non-ASCII bytes stay, the rest becomes a space.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPACES = regex.compile(rb" {2,}")
#: Spans of so many words of a training text show how far short texts of its language lie from the centroids.
SPANS = (1, 2, 4, 8, 16, 32, 64)
#: A class of lengths has a limit of its own from so many cosines on; its limit is so much below the quantile.
LEAST_ROWS, MARGIN = 100, 0.8


def counts(text: str, buckets: int) -> np.ndarray:
    """Counts of the hashed byte n-grams of a text."""
    data = np.frombuffer(_SPACES.sub(b" ", b" " + text.lower().encode().translate(_LETTERS) + b" "), np.uint8).astype(np.uint32)
    code, total = data, np.zeros(buckets, np.int64)
    shift = np.uint32(32 - buckets.bit_length() + 1)
    for n in (2, 3, 4):
        code = code[:-1] * np.uint32(257) + data[n - 1 :]
        if len(code):
            total += np.bincount((code * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519) >> shift, minlength=buckets)
    return total


@dataclass
class Model:
    """Centroids as unit rows, the language of each, the weights of the buckets and the least cosine by language and class
    of lengths."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    weight: np.ndarray
    least: np.ndarray

    def vectors(self, rows: list[np.ndarray] | np.ndarray) -> np.ndarray:
        return _unit(np.log1p(np.array(rows, np.float32)) * self.weight)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, cosine and whether it is rejected, for each text."""
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        real = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        if real:
            found = [counts(texts[i], len(self.weight)) for i in real]
            cosine = self.vectors(found) @ self.centroids.T
            best = cosine.argmax(1)
            owner, top = self.owner[best], cosine[np.arange(len(best)), best].clip(0, 1)
            bad = top < self.least[owner, length_class(np.array([np.count_nonzero(f) for f in found]))]
            for i, c, k, b in zip(real, top.tolist(), owner.tolist(), bad.tolist(), strict=True):
                out[i] = (self.languages[k], c, b)
        return out


CLASSES = 64


def length_class(grams: np.ndarray) -> np.ndarray:
    """Two classes for each doubling of the number of different n-grams."""
    return np.minimum(2 * np.log2(np.maximum(grams, 1)), CLASSES - 1).astype(np.int64)


def limits(cosine: np.ndarray, grams: np.ndarray, reject: float) -> np.ndarray:
    """The least cosine of each class of lengths."""
    out, last, which = np.zeros(CLASSES), 0.0, length_class(grams)
    for k in range(CLASSES):
        if (which == k).sum() >= LEAST_ROWS:
            last = max(last, MARGIN * float(np.quantile(cosine[which == k], reject)))
        out[k] = last
    return out


def spans(text: str) -> list[str]:
    """Spans of the numbers of words in `SPANS`, from places spread over the text by its length."""
    words = text.split()
    at = [(len(text) * (2 * k + 1) * 7919) % (len(words) - n + 1) if len(words) > n else 0 for k, n in enumerate(SPANS)]
    return [" ".join(words[a : a + n]) for a, n in zip(at, SPANS, strict=True) if len(words) > n]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from rows that lie far apart."""
    centre = [_unit(x.mean(0, keepdims=True))[0]]
    first = [int((x @ centre[0]).argmax())]
    while len(first) < min(k, len(x)):
        first.append(int((x @ x[first].T).max(1).argmin()))
    c = x[first]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = _unit(np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))]))
    return c


def _sparse(rows: pd.DataFrame, buckets: int) -> np.ndarray:
    full = np.zeros((len(rows), buckets), np.float32)
    for i, (at, n) in enumerate(zip(rows["at"], rows["n"], strict=True)):
        full[i, at] = n
    return full


def _centroids(model: Model, clusters: int, reject: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Clusters the texts of one language and finds its limits."""
    buckets = len(model.weight)

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable")
        c = _clusters(model.vectors(_sparse(rows[rows.whole], buckets)), clusters)
        parts = [_sparse(rows.iloc[i : i + 512], buckets) for i in range(0, len(rows), 512)]
        cosine = np.concatenate([(model.vectors(x) @ c.T).max(1) for x in parts])
        least = limits(cosine, np.concatenate([np.count_nonzero(x, axis=1) for x in parts]), reject)
        return pd.DataFrame({"lang": rows.lang.iloc[:1], "centroids": [c.astype(np.float32).ravel()], "least": [least]})

    return task


def fit(docs: DataFrame, train: Column, *, per_language: int = 800, clusters: int = 3, buckets: int = 4096, reject: float = 0.002, languages: int = 512) -> Model:
    """Learns from the rows where `train` holds and `lang` is not null, at most `per_language` of each of the most frequent
    `languages`. N-grams are counted in tasks and clustered in one task for each language; the driver gets the number of
    texts that have each n-gram, and centroids."""
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = F.xxhash64(F.col("doc_id").cast("string"))
    share = F.pmod(order, F.lit(1 << 20)) / F.lit(float(1 << 20))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    some = rows.join(F.broadcast(sizes), "lang").filter(share * F.col("count") <= 1.5 * per_language + 50)
    picked = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id", F.xxhash64("text")))).filter(F.col("place") <= per_language)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, whole, at, n = [], [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                for j, part in enumerate((text, *filter(LETTER.search, spans(text)))):
                    full = counts(part, buckets)
                    some = np.flatnonzero(full)  # only these are kept
                    row.append(k)
                    whole.append(j == 0)
                    at.append(some.astype(np.int32))
                    n.append(full[some].astype(np.int32))
            lists, row = pa.list_(pa.int32()), pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(whole, pa.bool_()), pa.array(at, lists), pa.array(n, lists)], ["lang", "place", "whole", "at", "n"])

    grams = cut(picked.select("lang", "place", "text").mapInArrow(tidy(task), "lang string, place int, whole boolean, at array<int>, n array<int>"))
    spread, texts = np.zeros(buckets), 0
    for r in grams.filter("whole").select(F.explode(F.concat("at", F.array(F.lit(-1)))).alias("k")).groupBy("k").count().collect():  # a row for each bucket
        if r.k < 0:
            texts = r["count"]
        else:
            spread[r.k] = r["count"]
    weight = np.log((1 + texts) / (1 + spread)).astype(np.float32) + np.float32(1)
    model = Model([], np.empty(0, int), np.empty((0, buckets), np.float32), weight, np.empty((0, CLASSES)))
    for r in sorted(grams.groupBy("lang").applyInPandas(_centroids(model, clusters, reject), "lang string, centroids array<float>, least array<double>").collect(), key=lambda r: r.lang):
        c = np.array(r.centroids, np.float32).reshape(-1, buckets)
        model.owner = np.concatenate((model.owner, np.full(len(c), len(model.languages))))
        model.centroids = np.concatenate((model.centroids, c))
        model.least = np.concatenate((model.least, np.array(r.least)[None]))
        model.languages.append(r.lang)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `lang_pred`, `score` and `rejected`, which replace columns of those names. The text is the only input."""
    docs = docs.drop("lang_pred", "score", "rejected")
    at = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, len(batch), 256)):
                found = model.predict(part.column(at).to_pylist())
                new = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, "lang_pred", "score", "rejected"])

    new = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())]
    return docs.mapInArrow(tidy(task), T.StructType([*docs.schema.fields, *(T.StructField(*x) for x in new)]))


def held_out() -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def predicted(docs: DataFrame) -> DataFrame:
    """Predictions for every row by a model of the rows that are not held out."""
    docs = docs.select("doc_id", "text", "lang")
    model = fit(docs, ~held_out())
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")
