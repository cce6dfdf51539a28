"""Token counts under a unigram vocabulary, without building the segmentation.

An Aho-Corasick automaton reports the vocabulary pieces that end at each character; dynamic programming carries the best
score and the number of pieces on that path. Ties and unknown characters follow the public unigram tokenizer: a longer
last piece wins a tie, a character without a piece of its own costs the least score minus ten and counts as its UTF-8
bytes, and each word with the space before it is segmented by itself.

Scores are double precision sums. Null and empty texts have no tokens. Repeated rows each get their row, with a null id
too. A run of spaces is one piece for each of them: pieces of several spaces are left out, as the tokenizer of words has
none. Words are cached per task up to `cache` entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from seawake.llm.vocab import MODEL, SPACE, pieces, read_model


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, model: bytes, cache: int = 300_000) -> None:
        normal, _ = pieces(model)
        self.automaton = ahocorasick.Automaton()
        for p, (_, score) in normal.items():
            self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()
        self.single = {p for p in normal if len(p) == 1}
        self.unknown = min(s for _, s in normal.values()) - 10.0
        self.most, self.cache = cache, {}

    def word(self, word: str) -> tuple[int, float]:
        """Number of pieces and score of the best path through one word."""
        n = len(word)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        done = 0  # positions up to here have their best path
        single, unknown = self.single, self.unknown
        for last, (length, score) in self.automaton.iter(word):
            end = last + 1
            while done < end - 1:  # characters at which no piece ends
                c = word[done]
                done += 1
                best[done], count[done] = best[done - 1] + unknown, count[done - 1] + len(c.encode())
            start = end - length
            s = best[start] + score
            if done < end:
                done = end
                best[end], count[end] = s, count[start] + 1
                if (c := word[last]) not in single and best[last] + unknown > s:
                    best[end], count[end] = best[last] + unknown, count[last] + len(c.encode())
            elif s > best[end]:
                best[end], count[end] = s, count[start] + 1
        while done < n:
            c = word[done]
            done += 1
            best[done], count[done] = best[done - 1] + unknown, count[done - 1] + len(c.encode())
        return count[n], best[n]

    def text(self, text: str | None) -> tuple[int, float]:
        """Number of tokens and score of a text."""
        if not text:
            return 0, 0.0
        if SPACE in text:
            text = text.replace(SPACE, " ")
        n, total, get = 0, 0.0, self.cache.get
        for w in (text[1:] if text[0] == " " else text).split(" "):
            if (x := get(w)) is None:
                x = self.word(SPACE + w)
                if len(self.cache) >= self.most:
                    self.cache.clear()
                if len(w) <= 48:
                    self.cache[w] = x
            n += x[0]
            total += x[1]
        return n, total


_COUNTERS: dict[tuple, Counter] = {}


def count_tokens(docs: DataFrame, *, model: str = MODEL, cache: int = 300_000) -> DataFrame:
    """One row per document row: doc_id, n_tokens and the score of the best path. One narrow pass, no shuffle."""
    settings = (read_model(model), cache)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if settings not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[settings] = Counter(*settings)
        c = _COUNTERS[settings]
        for batch in batches:
            n, score = zip(*map(c.text, batch.column(1).to_pylist()), strict=True) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, n_tokens long, score double")
