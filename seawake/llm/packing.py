"""Packing tokenized documents into as few sequences as can be, by bin completion with branch and bound.

Documents become ids of a public word vocabulary and an end id; only those longer than a sequence are cut. What is packed
are lengths, and there are at most `capacity` different ones, so the search works on a table of counts of that size and
costs the same for any number of documents: a filling is used for as many sequences as the counts allow at once.

The search takes the largest length left and enumerates fillings of the rest of its sequence: exact ones first, those
whose shortest document is longest before others (short ones are worth most at the end), then by growing waste; one is left
out where a single document could take the place of two of its own. The incumbent is the best-fit solution. A branch ends
once its waste exceeds what a solution of one sequence less may waste; the search ends where the incumbent meets the lower
bound, and after `effort` steps otherwise. Ranks of equal lengths are counted task by task, and a table of ranges of ranks
(at most about capacity x ln(capacity) rows) tells each piece its sequence and place.

A null text is empty: a document of the end id alone. Null ids, repeated rows and ties are pieces of their own. Any other
columns of `pack`'s table are kept; those of `pieces` besides doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from seawake.llm.words import LOWER, cut

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
CAPACITY, END = 4096, 1
#: Steps of the search, fillings tried for one sequence, bytes of text encoded at once, words and chunks a worker keeps.
EFFORT, WIDTH, AT_ONCE, CACHE = 20_000, 8, 4 << 20, 500_000
#: Marks that the vocabulary takes out of a text before all else.
MARK = "<|"

# ---- tokens

_LUT = np.frombuffer(LOWER, np.uint8)
#: Kinds of bytes: white space, letters, digits, other ASCII, apostrophe or beyond ASCII.
_KIND = np.array([0 if b in b"\t\n\x0b\x0c\r " else 1 if chr(b).isalpha() and b < 128 else 2 if 48 <= b <= 57 else 4 if b == 39 or b > 127 else 3 for b in range(256)], np.uint8)
_PLAIN = re.compile("[!-~]+")
#: Letters that composition leaves alone and that have one small letter each.
_LATIN = re.compile("[!-~À-įı-ſ]+")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ſ]+|[0-9]|[^\\sa-z0-9À-ÖØ-öø-ſ]+")


class Encoder:
    """Ids of texts. A text is taken apart at ASCII white space, across which nothing depends on its neighbour, and a chunk of
    ASCII without apostrophes into runs of letters, single digits and runs of other characters, as the vocabulary does. Each
    different piece is encoded once; what holds apostrophes or other letters goes word by word or through the whole tokenizer."""

    def __init__(self, path: str = VOCABULARY) -> None:
        self.whole = Tokenizer.from_file(path)
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelt = {c: bytes_of.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x180)}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}

    def full(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, spelt: str) -> bytes:
        found = [t.id for t in self.whole.model.tokenize(spelt)]
        return pack_ids(f"<{len(found)}I", *found)

    def _word(self, word: str) -> bytes:
        if (x := self.words.get(word)) is None:
            x = self._ids(word if word.isascii() else word.translate(self.spelt))
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = x
        return x

    def chunk(self, chunk: bytes) -> bytes:
        """The ids of a chunk whose A-Z are lower-case."""
        if (x := self.chunks.get(chunk)) is None:
            s = chunk.decode()
            if chunk.isalpha():
                x = self._ids(s)
            elif _PLAIN.fullmatch(s):
                x = b"".join(map(self._word, _WORDS.findall(s)))
            elif _LATIN.fullmatch(s):
                x = b"".join(map(self._word, _WORDS.findall(s.lower())))
            else:
                x = self.full(s)
            if len(self.chunks) >= CACHE:
                self.chunks.clear()
            if len(chunk) <= 64:
                self.chunks[chunk] = x
        return x

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of each."""
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = _LUT[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
        offsets = offsets - offsets[0]
        kind = _KIND[data]
        space = kind == 0
        begin = ~space  # a chunk begins after white space and at the start of a text
        begin[1:] &= space[:-1]
        firsts = offsets[:-1][np.diff(offsets) > 0]
        begin[firsts] = ~space[firsts]
        if len(chunk_at := np.flatnonzero(begin)):  # plain chunks are taken apart
            plain = np.repeat(np.maximum.reduceat(kind, chunk_at) < 4, np.diff(np.append(chunk_at, len(data))))
            plain = np.concatenate((np.zeros(chunk_at[0], bool), plain)) & ~space
            begin[1:] |= plain[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        at = np.flatnonzero(begin)
        solid = np.concatenate(([0], np.cumsum(~space)))
        ends = np.append(solid[at], solid[-1])
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[~space])]).dictionary_encode()
        ids = [self.chunk(x) for x in chunks.dictionary.to_pylist()]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start, index = np.cumsum(size) - size, chunks.indices.to_numpy()
        each = size[index]
        out = np.frombuffer(b"".join(ids), "<u4")[np.repeat(start[index] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        total = np.concatenate(([0], np.cumsum(each)))
        return out, np.diff(total[np.searchsorted(at, offsets)])


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about AT_ONCE bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // AT_ONCE
    starts = np.concatenate(([0], np.flatnonzero(np.diff(size)) + 1, [len(batch)]))
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        yield batch.slice(a, b - a)


_ENCODERS: dict[str, Encoder] = {}


def pieces(docs: DataFrame, *, capacity: int = CAPACITY, end: int = END, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and the end id in pieces of at most `capacity`; ids are
    little-endian unsigned 32-bit. One narrow pass."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
        for batch in batches:
            for part in _portions(batch) if len(batch) else ():
                texts = part.column(1)
                marked = pc.fill_null(pc.match_substring(texts, MARK), False)
                ids, n = encoder.many(pc.if_else(marked, "", texts))
                if pc.any(marked).as_py():
                    lists = np.split(ids, np.cumsum(n)[:-1])
                    for k in np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist():
                        lists[k] = np.frombuffer(encoder.full(texts[k].as_py()), "<u4")
                    ids, n = np.concatenate(lists), np.array([len(x) for x in lists])
                out = np.insert(ids, np.cumsum(n), end).astype("<u4")
                n = n + 1
                count = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start, length = piece * capacity, np.minimum(capacity, n[doc] - piece * capacity)
                bounds = np.concatenate(([0], np.cumsum(length))) * 4
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(bounds), pa.py_buffer(out)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), data], ["doc_id", "piece", "start", "length", "ids"])

    kind = T.StructType([docs.schema["doc_id"], *(T.StructField(c, k) for c, k in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType())))])
    return docs.select("doc_id", "text").mapInArrow(task, kind)


# ---- search over counts of lengths


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that no packing can do without: for each t, those over capacity - t take one each, those over half of it
    too, and what of the others from t up does not fit beside the latter takes more."""
    lengths = np.arange(capacity + 1)
    n, s = np.cumsum(counts), np.cumsum(lengths * counts)
    half = capacity // 2
    t = np.arange(1, half + 1)
    large, middle = n[capacity] - n[capacity - t], n[capacity - t] - n[half]
    beside = middle * capacity - (s[capacity - t] - s[half])
    more = np.maximum(0, -((beside - (s[half] - s[t - 1])) // capacity))
    return max(-(-int(s[-1]) // capacity), int((large + middle + more).max(initial=0)))


def _dominated(filling: tuple[int, ...], counts: np.ndarray) -> bool:
    return any(counts[a + b] > filling.count(a + b) for i, a in enumerate(filling) for b in filling[i + 1 :]) if len(filling) <= 12 else False


def fillings(counts: np.ndarray, room: int, width: int = WIDTH) -> Iterator[tuple[int, ...]]:
    """Up to `width` fillings of `room`: exact ones by falling shortest document, then by growing waste.

    Sums that can be reached are the bits of a number, one number after each length from the longest down.
    """
    lengths = [x for x in np.flatnonzero(counts[: room + 1])[::-1].tolist() if x]
    if not lengths:
        yield ()
        return
    mask, goal, reach, given = (1 << (room + 1)) - 1, 1 << room, [1], 0

    def trace(left: int, i: int) -> tuple[int, ...]:
        found: list[int] = []
        while left:
            while reach[i - 1] >> left & 1:
                i -= 1
            k, x = 1, lengths[i - 1]
            while not reach[i - 1] >> (left - k * x) & 1:
                k += 1
            found += [x] * k
            left -= k * x
            i -= 1
        return tuple(found)

    for i, x in enumerate(lengths):
        sums, k, step = reach[-1], min(int(counts[x]), room // x), 1
        while k > 0:
            m = min(step, k)
            sums |= (sums << (x * m)) & mask
            k, step = k - m, step * 2
        reach.append(sums)
        if sums & goal:
            if not _dominated(f := trace(room, i + 1), counts):
                yield f
                given += 1
            if given >= width:
                return
            reach[-1] = sums & ~goal
    for waste in range(1, room + 1):
        if reach[-1] >> (room - waste) & 1:
            yield trace(room - waste, len(lengths))
            given += 1
            if given >= width:
                return


Run = tuple[int, dict[int, int]]


def _pattern(top: int, filling: tuple[int, ...]) -> dict[int, int]:
    found = {top: 1}
    for x in filling:
        found[x] = found.get(x, 0) + 1
    return found


def _most(counts: np.ndarray, pattern: dict[int, int]) -> int:
    return min(int(counts[x]) // m for x, m in pattern.items())


def best_fit(counts: np.ndarray, capacity: int) -> list[Run]:
    """The incumbent: the largest length left, then again and again the largest that fits."""
    counts, runs = counts.copy(), []
    while (lengths := np.flatnonzero(counts)).size:
        top = int(lengths[-1])
        pattern, room = {top: 1}, capacity - top
        for x in lengths[::-1].tolist():
            if x <= room and (k := min(room // x, int(counts[x]) - pattern.get(x, 0))):
                pattern[x] = pattern.get(x, 0) + k
                room -= k * x
        q = _most(counts, pattern)
        for x, m in pattern.items():
            counts[x] -= q * m
        runs.append((q, pattern))
    return runs


def complete_bins(counts: np.ndarray, capacity: int, effort: int = EFFORT, width: int = WIDTH) -> list[Run]:
    """The fewest sequences found, as (how many, lengths in each): depth first, the latest choice is changed first."""
    counts = np.asarray(counts, np.int64).copy()
    total, least, best = int((counts * np.arange(capacity + 1)).sum()), lower_bound(counts, capacity), best_fit(counts, capacity)
    bins = sum(q for q, _ in best)
    allowed, waste, left = (bins - 1) * capacity - total, 0, int(counts.sum())
    runs: list[tuple[int, dict[int, int], int]] = []  # with the waste of each
    tried = [0]  # fillings tried at each depth
    top = capacity
    for _ in range(effort):
        if bins == least:
            break
        while top and not counts[top]:
            top -= 1
        pattern, q, lost = None, 0, 0
        if top:
            counts[top] -= 1
            for k, f in enumerate(fillings(counts, capacity - top, width)):
                if k == tried[-1]:
                    pattern = _pattern(top, f)
                    break
            counts[top] += 1
        if pattern:
            tried[-1] += 1
            lost = capacity - sum(x * m for x, m in pattern.items())
            q = min(_most(counts, pattern), (allowed - waste) // lost) if lost else _most(counts, pattern)
        if pattern and q > 0:
            for x, m in pattern.items():
                counts[x] -= q * m
                left -= q * m
            waste += q * lost
            runs.append((q, pattern, q * lost))
            tried.append(0)
            if left:
                continue
            best, bins = [(q, p) for q, p, _ in runs], sum(q for q, _, _ in runs)
            allowed = (bins - 1) * capacity - total
        tried.pop()  # nothing better below: back to the choice before
        if not runs:
            break
        q, pattern, lost = runs.pop()
        for x, m in pattern.items():
            counts[x] += q * m
            left += q * m
        waste -= lost
        top = capacity
    return best


# ---- from lengths to places


def _table(runs: list[Run]) -> tuple[np.ndarray, ...]:
    """For ranges of ranks of each length, by (length, first rank): first sequence, how many to a sequence, first place."""
    rows, used, first = [], {}, 0
    for q, pattern in runs:
        place = 0
        for x, m in sorted(pattern.items(), reverse=True):
            rows.append((x, used.get(x, 0), first, m, place))
            used[x] = used.get(x, 0) + q * m
            place += m * x
        first += q
    t = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return (t[:, 0] << 48) + t[:, 1], t[:, 1], t[:, 2], t[:, 3], t[:, 4]


def pack(parts: DataFrame, *, capacity: int = CAPACITY, effort: int = EFFORT, width: int = WIDTH) -> DataFrame:
    """`parts` with the sequence (sequence_id) and the place in it (offset) of each row, by its `length` of 1 to `capacity`."""
    names = parts.columns
    at, width_of_row = names.index("length"), len(names)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            x = batch.column(at).to_numpy()
            order = np.argsort(x, kind="stable")
            n = np.bincount(x, minlength=capacity + 1)
            rank = np.empty(len(x), np.int64)
            rank[order] = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(seen, n)
            seen += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(x), part), pa.int32()), pa.array(rank)], [*batch.schema.names, "part of rank", "rank"])

    kind = T.StructType([*parts.schema.fields, T.StructField("part of rank", T.IntegerType()), T.StructField("rank", T.LongType())])
    ranked = cut(parts.mapInArrow(number, kind))
    each = ranked.groupBy("part of rank", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part of rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = cut(each.select("part of rank", "length", "n", before.alias("before")))
    counts = np.zeros(capacity + 1, np.int64)
    for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r.length] = r.n
    keys, starts, first, to_one, places = _table(complete_bins(counts, capacity, effort, width))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, rank = batch.column(at).to_numpy(), batch.column(width_of_row).to_numpy()
            k = np.searchsorted(keys, (x << 48) + rank, "right") - 1
            nth = rank - starts[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(first[k] + nth // to_one[k]), pa.array(places[k] + nth % to_one[k] * x)], [*names, "sequence_id", "offset"])

    placed = ranked.join(each.drop("n"), ["part of rank", "length"]).select(*names, (F.col("rank") + F.col("before")).alias("rank"))
    return placed.mapInArrow(place, T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def packed_documents(docs: DataFrame, *, capacity: int = CAPACITY, end: int = END, path: str = VOCABULARY) -> DataFrame:
    """The pieces of all documents with their ids, sequence and place."""
    return pack(pieces(docs, capacity=capacity, end=end, path=path), capacity=capacity)
