"""Small helpers on UTF-8 bytes and on row keys that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seawake.session import shared_folder

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z in lower case; every byte that is neither a digit, a letter nor part of a non-ASCII character becomes a space.
ALNUM = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in LOWER)

U64 = np.uint64
#: A guess of a table's bytes of more bits than this (that of a table of unknown size has 63) is dropped.
GUESS_BITS = 512
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.n = 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            self.up, self.down = (np.full(self.n, v, U64) for v in (_BASE, _INVERSE))
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.multiply.accumulate(self.up), np.multiply.accumulate(self.down)
        return self.up[:n], self.down[:n]


POWERS = Powers()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of `text`, A-Z lower-cased, split at ASCII white space."""
    data = np.frombuffer(text.translate(LOWER), np.uint8)
    if not len(data):
        return np.empty(0, U64)
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = POWERS.get(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up, out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def shingles(text: bytes | None, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the k-word shingles; a shorter text is one shingle, an empty one none."""
    w = word_hashes(text or b"")
    if not len(w):
        return w
    n, width = max(1, len(w) - k + 1), min(k, len(w))
    total = np.full(n, width, U64)
    for i in range(width):
        total += w[i : i + n] * U64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64))
    total = np.sort(mix(total))
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A never-null key of a row: equal for repeated rows, different for rows that share only an id."""
    return F.struct(F.coalesce(F.col(doc_id), F.lit(-(1 << 63))).alias("i"), F.xxhash64(text).alias("h"))


#: What this worker keeps between tasks, by the operator that made it.
KEPT: dict[str, object] = {}


def forget(but: str | None = None) -> None:
    """Drops what this worker keeps for other operators than `but`."""
    for name in KEPT.keys() - {but}:
        del KEPT[name]


def give_back() -> None:
    """Gives memory that this worker has freed back to the machine, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`task`, which gives the memory of its batches back at its end; workers live on for other tasks and stages. What
    other operators than `keeps` have kept in the worker goes before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, so that a task's copies of texts stay small."""
    for batch in batches:
        yield from (batch.slice(i, rows) for i in range(0, len(batch), rows))


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in the session's shared folder.

    What was computed for it is then unreachable; collecting it at once lets Spark delete its shuffle files, which would
    else stay on the executors' disks until the driver happens to need memory.
    """
    shared_folder(df.sparkSession)
    done = df.checkpoint()
    del df
    gc.collect()
    done.sparkSession.sparkContext._jvm.System.gc()
    return _unknown(done)


def size_bits(df: DataFrame) -> int:
    """Bits of Spark's guess of the bytes of `df`."""
    try:
        return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    except ValueError:  # Python reads no number of so many digits
        return 1 << 16


def _unknown(done: DataFrame) -> DataFrame:
    """`done`, of unknown size if Spark's guess of it has become an absurd number.

    The guess is the product of the sizes that are joined, and checkpoints keep it: rounds of joins would make it a number of
    thousands of digits, and the driver's time and memory would go into multiplying such numbers.
    """
    if size_bits(done) <= GUESS_BITS:
        return done
    spark = done.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.toJavaRDD(), done._jdf.schema()), spark)
