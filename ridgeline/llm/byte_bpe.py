"""Byte-level BPE encoding and decoding with padded numpy matrices.

Pre-tokens that a worker hasn't met are laid out as rows of token ids in matrices, one for each power-of-two length
bucket. In each round every row merges its leftmost pair of minimum rank; the pair's rank comes from an open-addressing
hash table that is probed for all pairs at once, and the row is closed up by one gather. Rows without a mergeable pair
leave the matrix. Texts are then assembled from the pool of encoded pre-tokens by one ragged gather.
"""

from __future__ import annotations

import base64
import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import append_columns, pieces, ragged, stretches
from ridgeline.llm.token_counts import ANY_PRETOKEN, FOREIGN, PRETOKEN

NONE = np.int32(2**31 - 1)
#: A longer pre-token is a matrix of its own, with as many rows of BLOCK ids as it needs.
WIDEST, BLOCK = 1 << 11, 1 << 10
POOL_WORDS, STRETCH = 400_000, 1 << 20


def mixed(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    h = (left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Vocabulary:
    """The ranks of a .tiktoken file, with the hash table of mergeable pairs and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # two neighbours merge if their joint bytes are a token, however that token itself came about
        pairs = [
            (self.ranks[t[:i]], self.ranks[t[i:]], r)
            for t, r in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        self.build(self.ranks, pairs)

    def build(self, ids: dict[bytes, int], pairs: list[tuple[int, int, int]]) -> None:
        """Tokens by id, and the hash table of pairs (left, right, merged id, which is the rank too)."""
        tokens = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            tokens[i] = token
        self.lens = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.of_byte = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int32)
        a = np.array(pairs, dtype=np.int64).reshape(-1, 3)
        self.bits = max(10, (4 * len(a)).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, dtype=np.int64)
        self.values = np.full(len(self.keys), NONE, dtype=np.int32)
        key, at = a[:, 0] << 32 | a[:, 1], mixed(a[:, 0], a[:, 1], self.bits)
        left = np.arange(len(a))
        while len(left):
            free = self.keys[at[left]] < 0
            _, first = np.unique(at[left][free], return_index=True)
            put = left[free][first]
            self.keys[at[put]], self.values[at[put]] = key[put], a[put, 2]
            left = left[~np.isin(left, put, assume_unique=True)]
            at[left] += 1
            if len(left) and at.max() >= len(self.keys):
                raise ValueError("the pair table is too full")

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merger, NONE if it has none or either side is padding (-1)."""
        out = np.full(left.shape, NONE, dtype=np.int32)
        valid = np.flatnonzero((left >= 0).ravel() & (right >= 0).ravel())
        a, b = left.ravel()[valid].astype(np.int64), right.ravel()[valid].astype(np.int64)
        key, at = a << 32 | b, mixed(a, b, self.bits)
        flat = out.ravel()
        while len(valid):
            there = self.keys[at]
            hit = there == key
            flat[valid[hit]] = self.values[at[hit]]
            more = ~hit & (there >= 0)
            valid, key, at = valid[more], key[more], at[more] + 1
        return flat.reshape(left.shape)

    def merge_matrix(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """The ids of words of at most `width` bytes."""
        lens = np.array([len(w) for w in words])
        ids = np.full((len(words), width), -1, dtype=np.int32)
        ids[np.arange(width) < lens[:, None]] = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        rank = np.full((len(words), width), NONE, dtype=np.int32)  # of the pair that begins here
        rank[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        out: list = [None] * len(words)
        which, cols = np.arange(len(words)), np.arange(width)
        while len(which):
            at = rank.argmin(axis=1)  # the leftmost of the least
            best = rank[np.arange(len(which)), at]
            done = best == NONE
            if done.any():
                for row in np.flatnonzero(done):
                    out[which[row]] = ids[row, : lens[which[row]]].copy()
                ids, rank, at, best, which = (x[~done] for x in (ids, rank, at, best, which))
                if not len(which):
                    break
            rows = np.arange(len(which))
            ids[rows, at] = best
            # close the gap that the merged pair's right half leaves
            source = np.minimum(cols + (cols > at[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            ids[:, -1], rank[:, -1] = -1, NONE
            lens[which] -= 1
            most = int(lens[which].max())
            if most < width // 2:
                width = max(most, 2)
                ids, rank, cols = ids[:, :width], rank[:, :width], cols[:width]
            # the pair's own rank, and its left neighbour's
            after = np.minimum(at + 1, width - 1)
            rank[rows, at] = np.where(after > at, self.rank(ids[rows, at], ids[rows, after]), NONE)
            has = at > 0
            rank[rows[has], at[has] - 1] = self.rank(ids[rows[has], at[has] - 1], ids[rows[has], at[has]])
        return out

    def pair_rank(self, left: int, right: int) -> int:
        """rank() of one pair."""
        key = left << 32 | right
        at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.bits)
        while (there := int(self.keys[at])) != key:
            if there < 0:
                return int(NONE)
            at += 1
        return int(self.values[at])

    def merge_blocks(self, word: bytes) -> np.ndarray:
        """The ids of one long word, laid out row by row: each round merges the leftmost pair of minimum rank of the whole matrix.

        The rows' minima find it, and only the row that loses an id is closed up, so a round costs a row, not a word.
        """
        n = len(word)
        rows = -(-n // BLOCK)
        ids, rank = np.full(rows * BLOCK, -1, dtype=np.int32), np.full(rows * BLOCK, NONE, dtype=np.int32)
        ids[:n] = self.of_byte[np.frombuffer(word, dtype=np.uint8)]
        rank[: n - 1] = self.rank(ids[: n - 1], ids[1:n])
        ids, rank = ids.reshape(rows, BLOCK), rank.reshape(rows, BLOCK)
        lens = [min(BLOCK, n - k * BLOCK) for k in range(rows)]
        after, before = [*range(1, rows), -1], [-1, *range(rows - 1)]  # rows that still hold ids
        least = rank.min(axis=1)
        while (best := least[row := int(least.argmin())]) != NONE:
            at = int(rank[row].argmin())
            ids[row, at] = best
            # the id that goes is the next of the row, or the first of the next one
            gone, k = (row, at + 1) if at + 1 < lens[row] else (after[row], 0)
            lens[gone] -= 1
            end = lens[gone]
            ids[gone, k:end], rank[gone, k:end] = ids[gone, k + 1 : end + 1].copy(), rank[gone, k + 1 : end + 1].copy()
            ids[gone, end], rank[gone, end] = -1, NONE
            if not end:
                after[row] = after[gone]
                if after[gone] >= 0:
                    before[after[gone]] = row
                least[gone] = NONE
            # the merged id's own pair, and its left neighbour's
            follow = int(ids[row, at + 1]) if at + 1 < lens[row] else int(ids[after[row], 0]) if after[row] >= 0 else -1
            rank[row, at] = self.pair_rank(int(best), follow) if follow >= 0 else NONE
            to, j = (row, at - 1) if at else (before[row], lens[before[row]] - 1)
            if to >= 0:
                rank[to, j] = self.pair_rank(int(ids[to, j]), int(best))
            for r in {row, gone, to} - {-1}:
                least[r] = rank[r].min()
        flat = ids.ravel()
        return flat[flat >= 0]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word; a word that is a token is that token, as in the library."""
        out: list = [None] * len(words)
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if (r := self.ranks.get(w)) is not None:
                out[i] = np.array([r], dtype=np.int32)
            elif len(w) > WIDEST:
                out[i] = self.merge_blocks(w)
            else:
                buckets.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            for k in range(0, len(rows), most := max(1, (1 << 19) // width)):
                part = rows[k : k + most]
                for i, ids in zip(part, self.merge_matrix([words[i] for i in part], width), strict=True):
                    out[i] = ids
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Pool:
    """Encoded pre-tokens: the place of each in one flat array of ids. It starts anew when it is full."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.used = 0
        self.flat, self.starts, self.lens = np.empty(1 << 16, np.int32), np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)

    def add(self, words: set[str]) -> None:
        if len(self.at) > POOL_WORDS or self.used > 4 * POOL_WORDS * 2:
            self.clear()
        new = [w for w in words if w not in self.at]
        if new:
            ids = self.vocab.merge([w.encode() for w in new])
            lens = np.array([len(x) for x in ids], dtype=np.int64)
            first, used = len(self.at), self.used + int(lens.sum())
            last = first + len(new)
            if used > len(self.flat):
                self.flat = np.resize(self.flat, 2 * used)
            if last > len(self.lens):
                self.starts, self.lens = np.resize(self.starts, 2 * last), np.resize(self.lens, 2 * last)
            np.concatenate(ids, out=self.flat[self.used : used])
            self.lens[first:last], self.starts[first:last] = lens, self.used + np.cumsum(lens) - lens
            self.at.update(zip(new, range(first, last), strict=True))
            self.used = used

    def encode(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts' pre-tokens, and the number of them in each text."""
        self.add(set().union(*split))
        n = sum(map(len, split))
        at = np.fromiter(map(self.at.__getitem__, itertools.chain.from_iterable(split)), dtype=np.int64, count=n)
        lens = self.lens[at]
        ends = np.concatenate(([0], np.cumsum(lens)))
        text_ends = np.cumsum([0, *map(len, split)])
        return ragged(self.flat, self.starts[at], lens), np.diff(ends[text_ends])


def encode_batch(pool: Pool, texts: list[str]) -> pa.ListArray:
    ids: list[np.ndarray] = [np.empty(0, np.int32)]
    counts: list[np.ndarray] = [np.zeros(1, np.int64)]

    def of(texts: list[str]) -> np.ndarray:
        found, n = pool.encode([(ANY_PRETOKEN if FOREIGN.search(t) else PRETOKEN).findall(t) for t in texts])
        ids.append(found)
        return n

    for run in pieces(texts):
        *short, end = run
        counts.append(of(short))
        counts.append(np.array([sum(int(of([part])[0]) for part in stretches(end, STRETCH))]))
    return pa.ListArray.from_arrays(np.cumsum(np.concatenate(counts)).astype(np.int32), pa.array(np.concatenate(ids)))


def decode_batch(vocab: Vocabulary, ids: pa.ListArray) -> pa.BinaryArray:
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    lens = vocab.lens[flat]
    data = ragged(vocab.flat, vocab.starts[flat], lens)
    ends = np.concatenate(([0], np.cumsum(lens)))[offsets].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def encode(docs: DataFrame, ranks_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Adds the token ids of each whole text as an array of int.

    Ids equal the library's ordinary encoding, whatever the script; special strings are ordinary text. Null and empty texts
    get an empty array. Other columns pass through; one with the name of the result is replaced. Rows stay in their
    partition. Memory follows the Arrow batch and the pool of pre-tokens, which is bounded, not the vocabulary of the corpus.
    """

    def make():
        pool = Pool(vocabulary(ranks_path))
        return lambda batch: [encode_batch(pool, batch.column(text_col).fill_null("").to_pylist())]

    return append_columns(docs, {out: T.ArrayType(T.IntegerType(), True)}, make)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that an array of token ids stands for; null and empty arrays give empty bytes.

    Bytes, not text: a part of a document's ids may end within a character.
    """

    def make():
        vocab = vocabulary(ranks_path)
        return lambda batch: [decode_batch(vocab, batch.column(ids_col))]

    return append_columns(encoded, {out: T.BinaryType()}, make)


def round_trip(docs: DataFrame, ranks_path: str, text_col: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encode() and decode() in one pass, so that a task needs one Python worker; the text is not passed on."""

    def make():
        pool = Pool(vocabulary(ranks_path))

        def f(batch: pa.RecordBatch) -> list[pa.Array]:
            found = encode_batch(pool, batch.column(text_col).fill_null("").to_pylist())
            return [found, decode_batch(pool.vocab, found)]

        return f

    return append_columns(docs, {ids: T.ArrayType(T.IntegerType(), True), out: T.BinaryType()}, make, drop=[text_col])


def op7(docs: DataFrame, ranks_path: str) -> DataFrame:
    """The digest query: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = round_trip(docs.select("doc_id", "text"), ranks_path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
