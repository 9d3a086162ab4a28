"""Alignment of two tokenizers' tokens, by windows between whitespace-token anchors.

Each text is tokenised whole by both libraries. A byte offset at which a token of either side ends, and before a token of either side that begins with
the space mark, is an anchor: there both sequences can be cut, and the windows between anchors, mostly words, are aligned apart.
A window is known by its token ids alone, so its alignment is worked out once for each tuple of ids of a block of documents, and taken from there for
all its occurrences. A document's groups are its windows' groups one after another; its links are theirs.

How many documents hold a pair of ids linked is counted over the corpus without dealing out the links of documents: a block of documents has a
dictionary of its pairs, so the shuffles carry a pair once for each block that holds it, there and back.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.byte_bpe import Pool, Vocabulary
from ridgeline.llm.common import ragged, ship, slices, stage_table
from ridgeline.llm.token_counts import load, pretokens

#: Bytes of text in a block, and ids of the longest window that is aligned once for all its occurrences in a block.
BLOCK, MEMO_TOKENS = 3 << 20, 48
#: Texts that the libraries get at once.
BATCH = 1 << 20


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable(Vocabulary):
    """The merges of a byte-level vocabulary in the tokenizers library's format, for byte_bpe's matrices."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = byte_letters(), model["vocab"]
        pairs = [(vocab[x], vocab[y], vocab[x + y]) for x, y in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        if model["type"] != "BPE" or model.get("ignore_merges") or any(k[2] >= m[2] for k, m in itertools.pairwise(pairs)):
            raise ValueError("ids in the order of merges are expected")
        self.build({bytes(map(letters.__getitem__, t)): i for t, i in vocab.items()}, pairs)
        self.ranks = {}  # no word is a token before it is merged


class ByteLevel:
    """Side A: a byte-level vocabulary of the tokenizers library; special strings are plain text.

    Pre-tokens are encoded independently of each other, by byte_bpe's matrices; a bounded pool remembers their ids.
    """

    def __init__(self, path: str):
        self.tok = load(path)
        table = MergeTable(path)
        self.bytes = [table.flat[i : i + n].tobytes() for i, n in zip(table.starts, table.lens, strict=True)]
        self.pool = Pool(table)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of each text's."""
        return self.pool.encode([pretokens(self.tok, " " + t) for t in texts])


class Pieces:
    """Side B: a sentencepiece model, which adds a space before the text itself."""

    def __init__(self, path: str):
        self.tok = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.tok.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.tok.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.tok.id_to_piece, range(n)))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.tok.encode(texts, num_threads=1)
        n = np.array([*map(len, found)], dtype=np.int64)
        return np.fromiter(itertools.chain.from_iterable(found), dtype=np.int32, count=int(n.sum())), n


class Side:
    """A tokenizer with its tokens as arrays: bytes, lengths, decimal ids, and whether they begin with a space."""

    def __init__(self, tok: ByteLevel | Pieces):
        self.tok = tok
        self.lens, self.starts, self.flat = flattened(tok.bytes)
        if not self.lens.all():
            raise ValueError("a token without bytes has no place in an alignment")
        self.digits = flattened([str(i).encode() + b"," for i in range(len(tok.bytes))])
        self.spaced = np.array([t[:1] == b" " for t in tok.bytes], dtype=bool)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """Ids of all texts, the number of each text's, and whether its tokens spell a space and the text byte for byte."""
        ids, n = self.tok.encode(texts)
        spelled = ragged(self.flat, self.starts[ids], self.lens[ids]).tobytes()
        ends = np.concatenate(([0], np.cumsum(self.lens[ids])))[np.concatenate(([0], np.cumsum(n)))].tolist()
        return ids, n, [spelled[i:j] == b" " + t.encode() for t, (i, j) in zip(texts, itertools.pairwise(ends), strict=True)]


def flattened(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, places and bytes of the strings in a row."""
    lens = np.array([len(t) for t in strings], dtype=np.int64)
    return lens, np.cumsum(lens) - lens, np.frombuffer(b"".join(strings), dtype=np.uint8)


def starts_of(lens: np.ndarray) -> np.ndarray:
    return np.cumsum(lens) - lens


def summed(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sums of runs of values of the given lengths."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    ends = np.cumsum(lens)
    return total[ends] - total[ends - lens]


def tuple_codes(ids: np.ndarray, lens_a: np.ndarray, lens_b: np.ndarray) -> np.ndarray:
    """A number for each window: equal for equal tuples of ids, and only for those. ids: A and B ids of each window in a row.

    Two ids at a time are appended to the number so far, and the results are numbered anew; windows of more than MEMO_TOKENS ids are each one of their own.
    """
    lens = lens_a + lens_b
    at = starts_of(lens)
    code = lens_a << 31 | lens_b
    _, code = np.unique(code, return_inverse=True)
    used = int(code.max(initial=0)) + 1
    padded = np.concatenate((ids.astype(np.int64) + 1, [0]))
    long = np.flatnonzero(lens > MEMO_TOKENS)
    code[long] = used + np.arange(len(long))
    used += len(long)
    for k in range(0, MEMO_TOKENS, 2):
        live = np.flatnonzero((lens > k) & (lens <= MEMO_TOKENS))
        if not len(live):
            break
        two = padded[at[live] + k] << 16 | np.where(lens[live] > k + 1, padded[at[live] + k + 1], 0)
        _, new = np.unique(code[live] << 32 | two, return_inverse=True)
        code[live] = used + new
        used += int(new.max()) + 1
    return code


class Windows:
    """The alignments of windows, given as A and B ids in a row with each window's numbers.

    texts: the groups of each as text; groups: how many; links: all windows' links in a row as a << 32 | b; n_links: each one's number.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray, sides: tuple[Side, Side]):
        # both sides of a window have as many bytes, so the windows in a row are aligned as one text
        ends_a, ends_b = np.cumsum(sides[0].lens[a]), np.cumsum(sides[1].lens[b])
        merged = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")
        again = np.concatenate(([False], merged[1:] == merged[:-1]))
        both, ends = merged[again], merged[~again]
        window_ends = ends_a[np.cumsum(len_a) - 1]
        group_of = [np.searchsorted(both, e) for e in (ends_a, ends_b)]
        self.groups = np.diff(np.searchsorted(both, window_ends), prepend=-1)
        # between two neighbouring ends of either side lies a stretch of one token of each: a link
        self.links = a[np.searchsorted(ends_a, ends)].astype(np.int64) << 32 | b[np.searchsorted(ends_b, ends)]
        self.n_links = np.diff(np.searchsorted(ends, window_ends), prepend=-1)
        # decimal ids, A before B in each group; the comma after a group's last id becomes the mark that ends its side
        part = np.concatenate([2 * g + side for side, g in enumerate(group_of)])
        order = np.argsort(part, kind="stable")
        part = part[order]
        (lens_a, at_a, flat_a), (lens_b, at_b, flat_b) = (s.digits for s in sides)
        lens, starts = np.concatenate((lens_a[a], lens_b[b]))[order], np.concatenate((at_a[a], at_b[b] + len(flat_a)))[order]
        text = ragged(np.concatenate((flat_a, flat_b)), starts, lens)
        last = np.flatnonzero(np.append(part[1:] != part[:-1], True))
        text[np.cumsum(lens)[last] - 1] = np.where(part[last] % 2 == 0, ord("|"), ord(";"))
        raw = text.tobytes()
        cuts = np.concatenate(([0], np.cumsum(lens)))[np.concatenate(([0], np.cumsum(len_a + len_b)))].tolist()
        self.texts = [raw[i:j] for i, j in itertools.pairwise(cuts)]


def counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, ascending, and the sum of times of each."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(times, first)


class Aligned:
    """The alignment of a block of texts: per text n_a, n_b, n_groups, n_links and digest; and the links of each text (owner, link, times)."""

    def __init__(self, texts: list[str | None], sides: tuple[Side, Side]):
        self.n_a, self.n_b, self.n_groups, self.n_links = np.zeros((4, len(texts)), dtype=np.int64)
        self.digest = [""] * len(texts)
        self.owner, self.links, self.times = np.empty((3, 0), dtype=np.int64)
        docs, a, b, n_a, n_b = self.tokenised(texts, sides)
        if len(docs):
            self.align(docs, a, b, n_a, n_b, sides)

    @staticmethod
    def tokenised(texts: list[str | None], sides: tuple[Side, Side]) -> list[np.ndarray]:
        """The texts that both sides spell, their A and B ids in a row, and the numbers of these."""
        none = np.empty(0, np.int64)
        out: list[list[np.ndarray]] = [[none], [none.astype(np.int32)], [none.astype(np.int32)], [none], [none]]
        for k, m in runs(texts):
            present = [i for i in range(k, m) if texts[i]]
            (a, n_a, fit_a), (b, n_b, fit_b) = (side.tokens([texts[i] for i in present]) for side in sides)
            fit = np.array(fit_a, dtype=bool) & np.array(fit_b, dtype=bool)
            for whole, new in zip(out, (np.array(present, dtype=np.int64)[fit], a[np.repeat(fit, n_a)], b[np.repeat(fit, n_b)], n_a[fit], n_b[fit]), strict=True):
                whole.append(new)
        return [np.concatenate(x) for x in out]

    def align(self, docs: np.ndarray, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, sides: tuple[Side, Side]) -> None:
        begin_a, begin_b = (starts_of(s.lens[ids]) for s, ids in zip(sides, (a, b), strict=True))
        open_a, open_b = sides[0].spaced[a], sides[1].spaced[b]
        open_a[starts_of(n_a)], open_b[starts_of(n_b)] = True, True
        at_a, at_b = np.flatnonzero(open_a), np.flatnonzero(open_b)
        # an anchor: on both sides a token with the space mark begins there, or the text; so what is before it ends there on both sides
        _, i, j = np.intersect1d(begin_a[at_a], begin_b[at_b], assume_unique=True, return_indices=True)
        from_a, from_b = at_a[i], at_b[j]
        len_a, len_b = np.diff(np.append(from_a, len(a))), np.diff(np.append(from_b, len(b)))
        of_doc = np.searchsorted(starts_of(n_a), from_a, side="right") - 1
        head = starts_of(len_a + len_b)
        place = np.empty(len(a) + len(b), dtype=np.int32)  # A and B ids, window by window
        place[np.arange(len(a)) + np.repeat(head - from_a, len_a)] = a
        place[np.arange(len(b)) + np.repeat(head + len_a - from_b, len_b)] = b
        _, first, which = np.unique(tuple_codes(place, len_a, len_b), return_index=True, return_inverse=True)
        found = Windows(ragged(a, from_a[first], len_a[first]), ragged(b, from_b[first], len_b[first]), len_a[first], len_b[first], sides)
        windows = np.bincount(of_doc, minlength=len(docs))
        self.n_a[docs], self.n_b[docs] = n_a, n_b
        self.n_groups[docs], self.n_links[docs] = summed(found.groups[which], windows), summed(found.n_links[which], windows)
        text, ends = found.texts, np.concatenate(([0], np.cumsum(windows))).tolist()
        for d, (k, m) in zip(docs.tolist(), itertools.pairwise(ends), strict=True):
            self.digest[d] = hashlib.sha256(b"".join([text[w] for w in which[k:m].tolist()])[:-1]).hexdigest()
        # a text's windows, each once with its number, then the links of those
        pair, times = np.unique(of_doc * len(text) + which, return_counts=True)
        doc, window = np.divmod(pair, len(text))
        n = found.n_links[window]
        self.owner, self.times = docs[np.repeat(doc, n)], np.repeat(times, n)
        self.links = ragged(found.links, starts_of(found.n_links)[window], n)


def runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BATCH characters."""
    k = n = 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= BATCH:
            yield k, i + 1
            k, n = i + 1, 0
    if k < len(texts):
        yield k, len(texts)


@functools.lru_cache(maxsize=1)
def loaded(path_a: str, path_b: str) -> tuple[Side, Side]:
    return Side(ByteLevel(path_a)), Side(Pieces(path_b))


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents, and a row for each block of them with its dictionary of pairs (pairs, in_docs); stored.

    A document's links are slots of its block's dictionary, with their numbers.
    """
    ship(docs.sparkSession)
    fields = ["n_a", "n_b", "n_groups", "n_links"]
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("is_doc", T.BooleanType()),
            docs.schema[id_col],
            *(T.StructField(f, T.LongType()) for f in fields),
            T.StructField("groups_sha256", T.StringType()),
            T.StructField("slots", T.ArrayType(T.IntegerType())),
            T.StructField("times", T.ArrayType(T.IntegerType())),
            T.StructField("pairs", T.ArrayType(T.LongType())),
            T.StructField("in_docs", T.ArrayType(T.LongType())),
        ]
    )
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = loaded(path_a, path_b)
        number = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in slices(batches, BLOCK):
            n, block = batch.num_rows, next(number)
            if not n:
                continue
            got = Aligned(batch.column(text_col).to_pylist(), sides)
            pairs, slot = np.unique(got.links, return_inverse=True)
            key, times = counted(got.owner * max(1, len(pairs)) + slot, got.times)
            owner, slot = np.divmod(key, max(1, len(pairs)))
            ends = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
            of_docs = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (slot, times)]
            ids = batch.column(id_col)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, block)),
                    pa.array(np.ones(n, dtype=bool)),
                    ids,
                    *(pa.array(getattr(got, f)) for f in fields),
                    pa.array(got.digest, pa.string()),
                    *of_docs,
                    pa.nulls(n, longs),
                    pa.nulls(n, longs),
                ],
                names,
            )
            if len(pairs):
                in_docs = np.bincount(slot, minlength=len(pairs)).astype(np.int64)
                dictionary = [pa.array([x], longs) for x in (pairs, in_docs)]
                empty = [pa.nulls(1, t) for t in (ids.type, *[pa.int64()] * 4, pa.string(), ints, ints)]
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([False]), *empty, *dictionary], names)
        pa.default_memory_pool().release_unused()

    return stage_table(docs.select(id_col, text_col).mapInArrow(run, schema), "aligned")


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row.

    A: space + text by the byte-level vocabulary at path_a. B: the text by the sentencepiece model at path_b. Byte offsets where tokens of both end cut them
    into groups; a link is a pair of occurrences whose bytes overlap. A pair of ids counts the documents that hold it linked; n_best are the links
    whose count is the highest of any pair with their A id, count_sum adds the counts over the links.
    Texts that are null, empty, or not spelled byte for byte by both sides have no tokens: zeros and ''. Every row is a document, so repeated rows
    count each; a null id is a row like others. Other columns are ignored. An empty table gives an empty table.
    A text without spaces is one window, whatever its length. No row of a document is dealt by a pair: a pair has one row for each block that holds it,
    and a block's documents meet only their dictionary, so neither is ever gathered beyond a block.
    """
    both = aligned_blocks(docs, path_a, path_b, id_col, text_col)
    held = both.where("not is_doc").select(F.col("block").alias("of_block"), F.explode(F.arrays_zip("pairs", "in_docs")).alias("x"))
    held = held.select("of_block", F.col("x.pairs").alias("pair"), F.col("x.in_docs").alias("in_docs"))
    counts = held.groupBy("pair").agg(F.sum("in_docs").alias("count")).withColumn("a", F.shiftright("pair", 32))
    counts = stage_table(counts, "pairs")
    # an A id has at most as many pairs as the other vocabulary has ids
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    rated = counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    rated = held.select("of_block", "pair").join(rated, "pair")
    own = both.where("is_doc").drop("is_doc", "pairs", "in_docs")
    fields = [f for f in own.columns if f not in ("block", "slots", "times")]
    order = [*fields[:-1], "n_best", "count_sum", fields[-1]]
    schema = T.StructType([*(own.schema[f] for f in fields[:-1]), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), own.schema[fields[-1]]])

    def rate(_, rows: pa.Table, dictionary: pa.Table) -> pa.Table:
        # slots are places among the block's pairs in ascending order
        rank = np.argsort(dictionary.column("pair").to_numpy(), kind="stable")
        count, best = dictionary.column("count").to_numpy()[rank], dictionary.column("best").to_numpy(zero_copy_only=False)[rank]
        slots, times = (rows.column(c).combine_chunks() for c in ("slots", "times"))
        slot, time = slots.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(slots.value_lengths().fill_null(0).to_numpy())))
        got = {}
        for name, worth in (("n_best", best[slot] * time), ("count_sum", count[slot] * time)):
            sums = np.concatenate(([0], np.cumsum(worth, dtype=np.int64)))
            got[name] = pa.array(sums[ends[1:]] - sums[ends[:-1]])
        return pa.table([got[c] if c in got else rows.column(c) for c in order], names=order)

    return own.groupBy("block").cogroup(rated.groupBy("of_block")).applyInArrow(rate, schema)


def op13(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The digest query: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return align_tokens(docs, path_a, path_b)
