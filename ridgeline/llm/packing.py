"""Best-fit packing of documents into fixed-length sequences by a configuration linear program.

Documents become pieces of at most one capacity; only the histogram of piece lengths, at most `capacity` rows whatever the
corpus, reaches the driver. There the configuration LP (a variable for each way to fill a sequence, a row for each length) is
solved by multiplicative weights: every length has a weight, the configuration of greatest weight is priced by a knapsack
dynamic program, and the weights of lengths that are covered ahead of the others fall. The fractional solution is rounded
down, and what it leaves is packed best-fit, again on counts alone. The weights' dual value bounds every packing from below. In Spark every piece then finds its place by its rank
among the pieces of its length, in ranges of ranks that belong to one configuration.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from tokenizers import Tokenizer, pre_tokenizers

from ridgeline.llm.common import Kept, give_back, ship, slices, stage_table, stretches
from ridgeline.llm.common import pieces as runs
from ridgeline.llm.token_counts import LETTERS, NUMBERS, SPACES

#: Words of the lower-casing, space-dropping vocabulary, where its character classes are known (see token_counts).
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
#: A character outside that range, or that leaves it in lower case.
FOREIGN = re.compile("[^\x00-įı-ſ‐-‧‰-⁞€]")
#: Characters that only str.split() takes for white space.
NO_SPACE = "\x1c\x1d\x1e\x1f"
UNICODE_SPACES = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
MEMO_ENTRIES, MEMO_CHARS, STRETCH = 200_000, 40, 1 << 20


def is_foreign(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")  # faster than the pattern, and within it but for NO_SPACE
        return False
    except UnicodeEncodeError:
        return FOREIGN.search(text) is not None


class ChunkIds:
    """Little-endian 32-bit ids by chunk, a run of characters other than white space: chunks are encoded independently of each other.

    A worker keeps one memo for all its packing tasks, in two generations of MEMO_ENTRIES each; what the older one holds and is met
    again moves to the younger. Another operator's task in that worker ends it.
    """

    def __init__(self, path: str):
        self.path = path
        # for words that are split and in lower case already, the same vocabulary without those steps
        self.words = Tokenizer.from_file(path)
        self.special = [t.content for t in self.words.get_added_tokens_decoder().values()]
        suffix = getattr(self.words.model, "end_of_word_suffix", None)
        self.last = np.array([bool(suffix) and (self.words.id_to_token(i) or "").endswith(suffix) for i in range(self.words.get_vocab_size())])
        self.words.normalizer = None
        bytes_ = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytes_])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @functools.cached_property
    def whole(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids of each of some strings that encode independently of each other."""
        found = self.whole.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The same for strings of one pre-token each: in one go, cut after the tokens that end a word."""
        out: list[bytes] = []
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            ids = np.array(self.words.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = [0, *((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()]
            flat = ids.tobytes()
            if len(ends) == len(part) + 1 and ends[-1] == len(flat):
                out += [flat[i:j] for i, j in itertools.pairwise(ends)]
            else:  # a vocabulary that doesn't mark ends
                out += self.encode(part)
        return out

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of all these chunks, of which short ones are remembered."""
        if len(self.young) > MEMO_ENTRIES:
            self.old, self.young = self.young, {}
        known, old = self.young, self.old
        found = {c: old[c] for c in chunks if c in old} if old else {}
        fresh = chunks.difference(found) if found else chunks
        text = " ".join(fresh)
        foreign, special = is_foreign(text), any(s in text for s in self.special)
        odd = [c for c in fresh if foreign and FOREIGN.search(c) or special and any(s in c for s in self.special)] if foreign or special else []
        split: dict[str, list[str]] = {}
        words: set[str] = set()
        for c in fresh.difference(odd) if odd else fresh:
            if c.isalpha():
                words.add(c)
            else:
                split[c] = parts = WORD.findall(c)
                words.update(parts)
        new = [w for w in words if w not in known]
        of = dict(zip(new, self.encode_words(new), strict=True))
        if odd:
            found.update(zip(odd, self.encode(odd), strict=True))
        for c, parts in split.items():
            found[c] = b"".join([of[w] if w in of else known[w] for w in parts])
        for part in (of, found):
            if max(map(len, part), default=0) > MEMO_CHARS:
                known.update((c, ids) for c, ids in part.items() if len(c) <= MEMO_CHARS)
            else:
                known.update(part)
        return found | of

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, in lower case but for foreign ones, whose case the library folds."""
        foreign = is_foreign(text)
        if not foreign:
            text = text.lower()
        split = [*filter(None, UNICODE_SPACES.split(text))] if any(s in text for s in NO_SPACE) else text.split()
        return [c if is_foreign(c) else c.lower() for c in split] if foreign else split

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        split = [self.chunks(t) for t in texts]
        found = [[*map(self.young.get, c)] for c in split]
        new = set().union(*([c for c, i in zip(cs, ids, strict=True) if i is None] for cs, ids in zip(split, found, strict=True) if None in ids))
        if new:
            fresh = self.learn(new)
            found = [[fresh[c] if i is None else i for c, i in zip(cs, ids, strict=True)] if None in ids else ids for cs, ids in zip(split, found, strict=True)]
        return [*map(b"".join, found)]

    def all(self, texts: list[str]) -> Iterator[bytes]:
        """The same, a bounded stretch at a time."""
        for run in runs(texts):
            *short, end = run
            yield from self.texts(short)
            yield b"".join(self.texts([part])[0] for part in stretches(end, STRETCH))


def chunk_ids(path: str) -> ChunkIds:
    return Kept.get("chunk_ids", path, make=lambda: ChunkIds(path))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32): each document's ids and end_id, cut into pieces where longer than capacity.

    A null or empty text is the end id alone. Documents are tokenised whole.
    """
    ship(docs.sparkSession)
    schema = T.StructType(
        [docs.schema[id_col]]
        + [T.StructField(c, t) for c, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()))]
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = chunk_ids(tokenizer_path).all
        for batch in slices(batches):
            rows = []
            for i, b in enumerate(ids(batch.column(text_col).fill_null("").to_pylist())):
                view = memoryview(b + end)
                n = len(view) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    part = view[4 * at : 4 * min(n, at + capacity)]
                    rows.append((i, k, at, len(part) // 4, zlib.crc32(part)))
            table = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).take(pa.array(table[0])), pa.array(table[1].astype(np.int32)), *map(pa.array, table[2:])], schema.names
            )
        give_back()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def price(lengths: np.ndarray, values: np.ndarray, limits: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """How often to take each length, at most `limits` times, for the greatest sum of values within capacity, and that sum.

    Lengths that may fill a sequence are an unbounded knapsack by capacity; the scarcer ones follow as bundles of 1, 2, 4, ... pieces.
    """
    free = limits >= capacity // lengths
    offer = np.full(capacity + 1, -np.inf)
    offer[lengths[free]] = values[free]
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, dtype=np.int64)  # a length, or 0 for a token left idle
    for c in range(int(lengths[free].min(initial=capacity + 1)), capacity + 1):
        x = offer[1 : c + 1] + best[c - 1 :: -1]
        i = int(x.argmax())
        best[c], took[c] = (x[i], i + 1) if x[i] > best[c - 1] else (best[c - 1], 0)
    bundles = []
    for k in np.flatnonzero(~free).tolist():
        n, size = int(limits[k]), 1
        while n > 0:
            m = min(size, n)
            weight = m * int(lengths[k])
            if weight > capacity:
                break
            x = best[:-weight] + m * values[k]
            better = x > best[weight:]
            if better.any():
                best[weight:][better] = x[better]
                bundles.append((k, m, weight, better))
            n, size = n - m, 2 * size
    take = np.zeros(len(lengths), dtype=np.int64)
    c = capacity
    for k, m, weight, better in reversed(bundles):
        if c >= weight and better[c - weight]:
            take[k] += m
            c -= weight
    of = np.zeros(capacity + 1, dtype=np.int64)
    of[lengths] = np.arange(len(lengths))
    while c > 0:
        if took[c]:
            take[of[took[c]]] += 1
        c -= max(int(took[c]), 1)
    return take, float(best[capacity])


def solve_lp(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, rate: float = 6.0) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Configurations with fractional multiplicities that cover no length more than it needs, and a lower bound on any packing.

    Multiplicative weights: a length is worth its size times exp(-rate x the share of it that is covered), so that pricing
    turns to what lags behind. Each round prices over all lengths not yet covered, none more often than is left of it, and takes
    an eighth of what the scarcest length of the configuration found allows, so that later weights can still turn it elsewhere. Weights are also a dual solution once they are divided by
    the price of the best configuration within the whole counts: the greatest value of all lengths under any weights met (the
    first, and every sixteenth), or under the share of a sequence that each length takes, bounds the number of sequences from below.
    """
    covered = np.zeros(len(lengths))
    found = []
    share = 1 / (capacity // lengths)
    bound = float((share * counts).sum()) / price(lengths, share, counts.astype(np.int64), capacity)[1]
    for i in range(rounds):
        left = counts - covered
        open_ = np.flatnonzero(left >= 1)
        weight = lengths / capacity * np.exp(-rate * covered / counts)
        if i % 16 == 0 or not len(open_):
            bound = max(bound, float((weight * counts).sum()) / price(lengths, weight, counts.astype(np.int64), capacity)[1])
        if not len(open_):
            break
        take, _ = price(lengths[open_], weight[open_], left[open_].astype(np.int64), capacity)
        used = take > 0
        allowed = float((left[open_][used] / take[used]).min())
        step = max(allowed / 8, 1.0)
        config = np.zeros(len(lengths), dtype=np.int64)
        config[open_] = take
        covered += step * config
        found.append((config, step))
    return found, bound


def pack_histogram(histogram: dict[int, int], capacity: int, rounds: int = 96) -> tuple[list[tuple[dict[int, int], int]], float]:
    """((configuration as length -> times, number of sequences filled so), ...), which together hold the histogram exactly, and the
    linear program's lower bound on the number of sequences."""
    if not histogram:
        return [], 0.0
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    solved, bound = solve_lp(lengths, counts.astype(float), capacity, rounds)
    left = counts.copy()
    merged: dict[tuple[tuple[int, int], ...], int] = defaultdict(int)
    # rounded down; what rounding leaves of a configuration stays for the best fit
    for config, times in solved:
        used = config > 0
        n = min(int(times), int((left[used] // config[used]).min()))
        if n > 0:
            left -= n * config
            merged[tuple((int(x), int(k)) for x, k in zip(lengths[used], config[used], strict=True))] += n
    out = [(dict(c), n) for c, n in merged.items()]
    # best fit, longest first, over groups of sequences with equal contents, by the room they have left
    room: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(space: int, config: dict[int, int], n: int) -> None:
        if space == 0:
            out.append((config, n))
            return
        if not room[space]:
            bisect.insort(rooms, space)
        room[space].append((config, n))

    for length, n in zip(lengths[::-1].tolist(), left[::-1].tolist(), strict=True):
        while n:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                space = rooms[at]
                config, there = room[space].pop()
                if not room[space]:
                    del rooms[at]
                each = min(space // length, n)  # as many as fit into one
                take = min(there, n // each)
                if there > take:
                    put(space, config, there - take)
                put(space - each * length, config | {length: config.get(length, 0) + each}, take)
                n -= take * each
            else:
                each = min(capacity // length, n)
                put(capacity - each * length, {length: each}, n // each)
                n -= n // each * each
    return out + [x for groups in room.values() for x in groups], bound


class Places:
    """Where the rank-th piece of a length goes: arrays over ranges of ranks, sorted by length and first rank."""

    def __init__(self, packed: list[tuple[dict[int, int], int]]):
        rows = []
        first = 0
        for config, n in packed:
            offset = 0
            for length, times in sorted(config.items(), reverse=True):
                rows.append((length, n * times, first, times, offset))
                offset += length * times
            first += n
        self.sequences = first
        a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.length, slots, self.first, self.times, self.offset = a.T
        before = np.cumsum(slots) - slots
        starts = np.searchsorted(self.length, self.length, side="left")
        self.rank = before - before[starts] if len(a) else before
        self.key = self.length << 40 | self.rank

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 40 | rank, side="right") - 1
        r = rank - self.rank[at]
        return self.first[at] + r // self.times[at], self.offset[at] + r % self.times[at] * length


def pack(cut: DataFrame, capacity: int, rounds: int = 96, rows_a_group: int = 2_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (length between 1 and capacity), so that sequences are gapless from 0.

    `cut` must be a stored table, as it is read three times, with a column row that is different in every row. Only the histogram,
    at most `capacity` rows, and the configurations made of it reach the driver and the broadcast. A length that many pieces
    share is numbered in as many hashed groups as it fills with rows_a_group rows; the groups' first ranks are running sums in Spark.
    """
    spark = cut.sparkSession
    ship(spark)
    histogram = {int(r["length"]): int(r["count"]) for r in cut.groupBy("length").count().collect()}
    groups = spark.createDataFrame([(x, 1 + n // rows_a_group) for x, n in histogram.items()], "length long, groups long")
    packed, _ = pack_histogram(histogram, capacity, rounds)
    places_of = spark.sparkContext.broadcast(Places(packed))
    dealt = cut.join(F.broadcast(groups), "length").withColumn("dealt", F.pmod(F.xxhash64("row"), F.col("groups"))).drop("groups")
    earlier = Window.partitionBy("length").orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "dealt").count().select("length", "dealt", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("length", "dealt").orderBy("row")) - 1
    numbered = dealt.withColumn("at", at).join(starts, ["length", "dealt"]).withColumn("rank", F.col("at") + F.col("before"))
    kept = [c for c in cut.columns if c != "row"]
    schema = T.StructType([*(cut.schema[c] for c in kept), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = places_of.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            sequence, offset = places.find(length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], schema.names)

    return numbered.select(*kept, "rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of one token; texts longer than capacity, and only those, are cut into pieces of capacity
    and a rest. Repeated rows are packed each. An empty table gives no rows. Other columns are ignored.
    """
    cut = token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col)
    return pack(stage_table(cut.withColumn("row", F.monotonically_increasing_id()), "pieces"), capacity)


def op8(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The digest query: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(docs, tokenizer_path)
