"""SentencePiece encoding and decoding with seeded merge-dropout.

A text becomes byte-pair merges of a public vocabulary: the best-scored candidate merge is taken first, the leftmost on
ties. When a candidate comes up, a keyed hash of seed, text, place of the word in the text, place in the word and merged
piece decides whether it is skipped, so every occurrence of a word is dealt with by itself. Equal texts get equal
segmentations and repeated runs agree on any cluster. With `dropout=0` the result is the vocabulary's own encoding.

What a worker keeps of a word is not a segmentation but the candidates that come up after each series of skips: a tree
that grows by the skips that are met. An occurrence draws all its skips anew and is led by them through the tree.

Lossless: unknown characters and a literal U+2581 become byte pieces, so decoding always gives the text back.
Null texts give null; an empty text gives no ids. A worker keeps up to about `cache` nodes of such trees and then starts
anew; no piece spans two words, so long texts need no more than their own length. Decoding looks up the bytes
of all ids of a batch at once, a bounded number of ids at a time.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seawake.llm.vocab import MODEL, SPACE, pieces, read_model
from seawake.llm.words import KEPT, mix, tidy

CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
NEVER = float("inf")
MASK = (1 << 64) - 1
SHORT = 48
WIDE = 1 << 20
#: Nodes that a worker keeps, ids that it decodes at once and words that it encodes at once.
CACHE, AT_ONCE, WORDS = 80_000, 1 << 18, 1 << 16
#: The mark of an occurrence that is merged by itself.
ONCE = -2
#: No word of up to `SHORT` characters meets so many candidates: each merge offers at most two new ones.
STEPS = 256


class Encoder:
    """Encodes and decodes texts; `dropout` is the chance that a candidate merge is skipped."""

    def __init__(self, model: bytes, dropout: float = 0.1, seed: int = 0, cache: int = CACHE) -> None:
        normal, self.of_byte = pieces(model)
        self.id = {p: i for p, (i, _) in normal.items()}
        self.rank = {p: -s for p, (_, s) in normal.items()}
        text = {i: p.replace(SPACE, " ").encode() for p, i in self.id.items()} | {i: bytes([b]) for b, i in enumerate(self.of_byte)}
        self.size = np.zeros(max(text) + 1, np.int64)
        self.size[list(text)] = [len(x) for x in text.values()]
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(text[i] for i in sorted(text)), np.uint8)
        self.limit, self.seed, self.most = int(dropout * (1 << 32)), seed, cache
        self._forget()
        self.known = {p for p in self.id if len(p) == 1}
        self.of_char = np.full(0x110000, -1, np.int64)
        for p, i in self.id.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        splits = [(self.id[p[:k]] * WIDE + self.id[p[k:]], i, self.rank[p]) for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id]
        splits.sort()
        self.pair, self.pair_id = (np.array([x[k] for x in splits], np.int64) for k in (0, 1))
        self.pair_rank = np.array([x[2] for x in splits])

    def _skip(self, key: int, at: int, piece: int) -> bool:
        x = (key ^ (at * 0x9E3779B97F4A7C15 + piece * 0xC2B2AE3D27D4EB4F)) & MASK
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & MASK
        return ((x ^ (x >> 32)) & 0xFFFFFFFF) < self.limit

    def _skips(self, key: np.ndarray, at: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """`_skip` for arrays."""
        return self._drawn(key ^ self._codes(at, piece))

    @staticmethod
    def _codes(at: np.ndarray, piece: np.ndarray) -> np.ndarray:
        u = np.uint64
        return at.astype(u) * u(0x9E3779B97F4A7C15) + piece.astype(u) * u(0xC2B2AE3D27D4EB4F)

    def _drawn(self, x: np.ndarray) -> np.ndarray:
        u = np.uint64
        x = (x ^ (x >> u(32))) * u(0xD6E8FEB86659FD93)
        return ((x ^ (x >> u(32))) & u(0xFFFFFFFF)) < u(self.limit)

    def _offers(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the merge of each pair of pieces; an infinite rank where there is none."""
        key = left * WIDE + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        real = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(real, self.pair_rank[at], NEVER), self.pair_id[at]

    def merge_many(self, words: list[str], keys: np.ndarray) -> list[bytes]:
        """What `merge` gives, as the bytes of its ids, for many words of known characters at once."""
        return self._rounds(words, lambda _, rows, i, piece: self._skips(keys[rows], i, piece))

    def _rounds(self, words: list[str], skips: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> list[bytes]:
        """The merges of many words of known characters: every round takes one candidate of each word, and
        `skips(round, words, places, pieces)` says which of them are skipped."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        n, width = len(words), int(size.max())
        s = np.full((n, width + 1), -1, np.int64)
        s[np.arange(width + 1) < size[:, None]] = self.of_char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        right = np.tile(np.arange(1, width + 2), (n, 1))
        left = np.tile(np.arange(-1, width), (n, 1))
        cost, to = self._offers(s[:, :-1], s[:, 1:])
        rows, step = np.arange(n), 0
        while len(rows):
            part = cost[rows]
            i = part.argmin(1)
            live = part[np.arange(len(rows)), i] < NEVER
            rows, i = rows[live], i[live]
            piece, r = to[rows, i], rows
            if self.limit:
                skip, step = skips(step, rows, i, piece), step + 1
                cost[rows[skip], i[skip]] = NEVER
                r, i, piece = rows[~skip], i[~skip], piece[~skip]
            j = right[r, i]
            s[r, i], s[r, j] = piece, -1
            inner = j < width
            cost[r[inner], j[inner]] = NEVER
            after = right[r, j]
            right[r, i] = after
            inner = after <= width
            left[r[inner], after[inner]] = i[inner]
            cost[r, i], to[r, i] = self._offers(piece, np.where(inner, s[r, np.minimum(after, width)], -1))
            before = left[r, i]
            some = before >= 0
            r, before = r[some], before[some]
            cost[r, before], to[r, before] = self._offers(s[r, before], piece[some])
        kept = s >= 0
        flat, ends = s[kept].astype("<i4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge(self, word: str, key: int) -> list[str]:
        """The symbols of a word after all merges that are not skipped."""
        if len(word) > SHORT:
            return self._merge_long(word, key)
        rank, s = self.rank.get, list(word)
        at = list(range(len(s)))
        cost = [rank(a + b, NEVER) for a, b in zip(s, s[1:], strict=False)]
        while cost and (best := min(cost)) != NEVER:
            i = cost.index(best)
            piece = s[i] + s[i + 1]
            if self.limit and self._skip(key, at[i], self.id[piece]):
                cost[i] = NEVER
                continue
            s[i] = piece
            del s[i + 1], at[i + 1], cost[i]
            if i:
                cost[i - 1] = rank(s[i - 1] + piece, NEVER)
            if i < len(cost):
                cost[i] = rank(piece + s[i + 1], NEVER)
        return s

    def _merge_long(self, word: str, key: int) -> list[str]:
        """The same with an agenda, for words of any length."""
        s: list[str | None] = list(word)
        left, right = list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (r := self.rank.get(p := s[i] + s[j])) is not None:
                heapq.heappush(agenda, (r, i, j, p))

        for i in range(len(s) - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, p = heapq.heappop(agenda)
            if s[i] is None or s[j] is None or right[i] != j or len(s[i]) + len(s[j]) != len(p):
                continue
            if self.limit and self._skip(key, i, self.id[p]):
                continue
            s[i], s[j] = p, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [x for x in s if x is not None]

    def keys(self, text: str, n: int) -> np.ndarray:
        """The skip keys of a text's `n` words, by their places."""
        return mix(np.uint64(xxhash.xxh64_intdigest(text, seed=self.seed & MASK)) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _ids(self, symbols: list[str]) -> bytes:
        ids: list[int] = []
        for p in symbols:
            if (i := self.id.get(p)) is not None:
                ids.append(i)
            else:
                ids += [self.of_byte[b] for b in p.encode()]
        return np.array(ids, "<i4").tobytes()

    def _forget(self) -> None:
        """Empties the trees. A node has a word, the steps skipped so far, the ids if nothing more is skipped and the
        codes of the candidates until then; `base` is the step of the first of them."""
        self.root: dict[str, int] = {}
        self.child: dict[int, int] = {}
        self.word: list[str] = []
        self.skipped: list[tuple[int, ...]] = []
        self.out: list[bytes] = []
        self.nodes, self.codes, self.n_codes = np.zeros((1024, 3), np.int64), np.zeros(4096, np.uint64), 0

    def _add(self, words: list[str], skipped: list[tuple[int, ...]], out: list[bytes], codes: np.ndarray, count: np.ndarray) -> range:
        """New nodes; `codes` holds their candidates one after another."""
        a, b = len(self.out), len(self.out) + len(words)
        self.word += words
        self.skipped += skipped
        self.out += out
        if b > len(self.nodes):
            self.nodes = np.concatenate((self.nodes[:a], np.zeros((2 * b - a, 3), np.int64)))
        self.nodes[a:b, 0] = self.n_codes + np.cumsum(count) - count
        self.nodes[a:b, 1] = count
        self.nodes[a:b, 2] = [s[-1] + 1 if s else 0 for s in skipped]
        if (end := self.n_codes + len(codes)) > len(self.codes):
            self.codes = np.concatenate((self.codes[: self.n_codes], np.zeros(2 * end - self.n_codes, np.uint64)))
        self.codes[self.n_codes : end], self.n_codes = codes, end
        return range(a, b)

    @staticmethod
    def _alike(words: list[str]) -> Iterator[list[int]]:
        """The places of the words in parts of like lengths."""
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        yield from (order[i : i + 2048].tolist() for i in range(0, len(order), 2048))

    def _learn(self, todo: list[tuple[str, tuple[int, ...]]]) -> np.ndarray:
        """The new nodes of words of known characters under series of skipped steps."""
        at = np.empty(len(todo), np.int64)
        for part in self._alike([w for w, _ in todo]):
            words, skipped = [todo[k][0] for k in part], [todo[k][1] for k in part]
            forced = np.zeros((len(part), STEPS), bool)
            forced[np.repeat(np.arange(len(part)), [*map(len, skipped)]), np.fromiter(chain.from_iterable(skipped), np.int64)] = True
            base, met = np.array([s[-1] if s else -1 for s in skipped]), [(np.empty(0, np.int64), np.empty(0, np.uint64))]

            def skips(step: int, rows: np.ndarray, i: np.ndarray, piece: np.ndarray, base: np.ndarray = base, forced: np.ndarray = forced, met: list = met) -> np.ndarray:
                new = base[rows] < step
                met.append((rows[new], self._codes(i[new], piece[new])))
                return forced[rows, step]

            out = self._rounds(words, skips)
            rows, codes = (np.concatenate(x) for x in zip(*met, strict=True))
            at[part] = self._add(words, skipped, out, codes[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=len(part)))
        return at

    def _roots(self, words: Counter[str]) -> None:
        """Adds the roots of new words that occur more than once. Words that are long or have unknown characters get one only
        if nothing in them depends on skips; the others are marked by -1 and merged each time."""
        easy, fixed = [], []
        for w, n in words.items():
            if w and len(w) <= SHORT and self.known.issuperset(w):
                if n > 1 or not self.limit:
                    easy.append(w)
            elif not self.limit or not any(a + b in self.rank for a, b in zip(w, w[1:], strict=False)):
                fixed.append(w)
            else:
                self.root[w] = -1
        self.root.update(zip(easy, self._learn([(w, ()) for w in easy]).tolist(), strict=True))
        literal = np.array([self.of_byte[b] for b in SPACE.encode()], "<i4").tobytes()
        ids = [self._ids(self.merge(w, 0)) if w else literal for w in fixed]
        self.root.update(zip(fixed, self._add(fixed, [()] * len(fixed), ids, np.empty(0, np.uint64), np.zeros(len(fixed), np.int64)), strict=True))

    def _segment(self, words: list[str], keys: np.ndarray) -> list[bytes]:
        """The bytes of the ids of each occurrence of a word, under its key. Words and series of skips that are met but once
        among them are merged at once and not kept."""
        new = Counter(words)
        if len(self.out) + len(new) > self.most:
            self._forget()
        self._roots(Counter({w: n for w, n in new.items() if w not in self.root}))
        node = np.array([self.root.get(w, ONCE) for w in words], np.int64)
        live = np.flatnonzero(node >= 0)
        while self.limit:
            live = live[self.nodes[node[live], 1] > 0]
            if not len(live):
                break
            first, count, base = self.nodes[node[live]].T
            end = np.cumsum(count)
            x = np.repeat(keys[live], count) ^ self.codes[np.repeat(first - end + count, count) + np.arange(end[-1])]
            hit = np.flatnonzero(self._drawn(x))
            owner = np.searchsorted(end, hit, side="right")
            once = np.diff(owner, prepend=-1) > 0  # the first skip of each
            hit, owner = hit[once], owner[once]
            branch = node[live[owner]] * STEPS + base[owner] + hit - (end - count)[owner]
            some, which, times = np.unique(branch, return_inverse=True, return_counts=True)
            missing = [b for b, n in zip(some.tolist(), times.tolist(), strict=True) if n > 1 and b not in self.child]
            self.child.update(zip(missing, self._learn([(self.word[b // STEPS], (*self.skipped[b // STEPS], b % STEPS)) for b in missing]).tolist(), strict=True))
            live = live[owner]
            node[live] = np.array([self.child.get(b, ONCE) for b in some.tolist()], np.int64)[which]
            live = live[node[live] >= 0]
        once = np.flatnonzero(node == ONCE)
        found = self._merged([words[k] for k in once.tolist()], keys[once])
        rows = self._rows(node, words, keys)
        for k, x in zip(once.tolist(), found, strict=True):
            rows[k] = x
        return rows

    def _merged(self, words: list[str], keys: np.ndarray) -> list[bytes]:
        """`merge_many` for words of any lengths."""
        out: list[bytes] = [b""] * len(words)
        for part in self._alike(words):
            for k, x in zip(part, self.merge_many([words[k] for k in part], keys[part]), strict=True):
                out[k] = x
        return out

    def _rows(self, node: np.ndarray, words: list[str], keys: np.ndarray) -> list[bytes]:
        return [b"" if n == ONCE else self.out[n] if n >= 0 else self._ids(self.merge(words[k], int(keys[k]))) for k, n in enumerate(node.tolist())]

    def chunks(self, text: str) -> list[str]:
        """The words of a text, each with the spaces before it; a literal U+2581 stands for itself as a chunk of its own."""
        parts = text.split(SPACE)
        found = CHUNK.findall(SPACE + parts[0].replace(" ", SPACE))
        for part in parts[1:]:
            found.append("")
            found += CHUNK.findall(part.replace(" ", SPACE))
        return found

    def encode_many(self, texts: list[str | None]) -> list[bytes | None]:
        """The bytes of the ids of each text; null for null, none for an empty text."""
        out: list[bytes | None] = []
        at, split, keys = 0, [self.chunks(t) if t else [] for t in texts], []
        for t, c in zip(texts, split, strict=True):
            keys.append(self.keys(t or "", len(c)))
        flat, key, rows = [w for c in split for w in c], np.concatenate([*keys, np.empty(0, np.uint64)]), []
        for i in range(0, len(flat), WORDS):
            rows += self._segment(flat[i : i + WORDS], key[i : i + WORDS])
        for t, c in zip(texts, split, strict=True):
            out.append(None if t is None else b"".join(rows[at : at + len(c)]))
            at += len(c)
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], "<i4").tolist()

    def decode_many(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of texts, one after another, and their number for each text; `ids` holds their ids one after
        another, `counts` how many each has. The space before a text's first word goes."""
        first = np.zeros(len(ids), np.int64)
        begin = np.cumsum(counts) - counts
        first[begin[counts > 0]] = 1
        size, out = self.size[ids] - first, []
        for a in range(0, len(ids), AT_ONCE):
            n = size[a : a + AT_ONCE]
            at = self.begin[ids[a : a + AT_ONCE]] + first[a : a + AT_ONCE]
            out.append(self.bytes[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        total = np.concatenate(([0], np.cumsum(size)))
        return np.concatenate(out) if out else np.empty(0, np.uint8), total[begin + counts] - total[begin]

    def decode(self, ids: list[int]) -> str:
        """The text of which `ids` are any segmentation."""
        return self.decode_many(np.array(ids, np.int64), np.array([len(ids)]))[0].tobytes().decode()


def _encoder(*args: object) -> Encoder:
    """One encoder for each worker process and setting."""
    made = KEPT.get("bpe_dropout")
    if made is None or made[0] != args:
        made = KEPT["bpe_dropout"] = (args, Encoder(*args))
    return made[1]


def _lists(rows: list[bytes | None]) -> pa.Array:
    """A column of lists from the bytes of their ids."""
    ends = np.cumsum([0, *(len(r or b"") // 4 for r in rows)])
    null = np.array([r is None for r in rows], bool)
    values = pa.array(np.frombuffer(b"".join(r or b"" for r in rows), "<i4"))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(null))


def encode(docs: DataFrame, *, model: str = MODEL, dropout: float = 0.1, seed: int = 0, cache: int = CACHE) -> DataFrame:
    """`docs` with a column `ids` (array of int) that replaces one of that name; one narrow pass, no shuffle."""
    docs = docs.drop("ids")
    at, settings = docs.columns.index("text"), (read_model(model), dropout, seed, cache)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(*settings)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, len(batch), 256)):
                ids = _lists(e.encode_many(part.column(at).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, "ids"])

    return docs.mapInArrow(tidy(task, "bpe_dropout"), T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def _texts(e: Encoder, column: pa.ListArray) -> pa.Array:
    """The texts of a column of ids; null for null."""
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    data, size = e.decode_many(column.flatten().to_numpy(zero_copy_only=False), counts)
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    null = column.is_null().to_numpy(zero_copy_only=False)
    valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(column), [valid, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.large_string()).cast(pa.string())


def decode(df: DataFrame, *, model: str = MODEL) -> DataFrame:
    """`df` with a column `decoded` made from `ids`; null ids give null, no ids the empty text."""
    df = df.drop("decoded")
    at, settings = df.columns.index("ids"), (read_model(model), 0.0)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(*settings)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, len(batch), 256)):
                yield pa.RecordBatch.from_arrays([*part.columns, _texts(e, part.column(at))], [*part.schema.names, "decoded"])

    return df.mapInArrow(tidy(task, "bpe_dropout"), T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())]))


def round_trip(docs: DataFrame, *, model: str = MODEL, dropout: float = 0.1, seed: int = 0) -> DataFrame:
    """Ids, their number and whether decoding them gives the text back, per document; null texts give null ids.

    Texts are encoded and the ids decoded in the same pass, so neither ids nor decoded texts move between processes twice.
    """
    settings = (read_model(model), dropout, seed, CACHE)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(*settings)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, len(batch), 256)):
                texts = part.column(1).cast(pa.string())
                ids = _lists(e.encode_many(texts.to_pylist()))
                same = pc.equal(_texts(e, ids), texts)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, ids.value_lengths().fill_null(0).cast(pa.int64()), pc.coalesce(same, texts.is_null())], ["doc_id", "ids", "n_tokens", "lossless"])

    return docs.select("doc_id", "text").mapInArrow(tidy(task, "bpe_dropout"), T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("ids array<int>, n_tokens long, lossless boolean")]))
