"""Katz backoff language model: Good-Turing discounted n-gram counts with exactly normalised backoff weights.

Texts are cut into blocks. For each order a block asks, for the different n-grams it holds, how often the training texts have them: the n-grams are dealt
by history to the parts of that order's table, each part sums up what all blocks tell of its n-grams, and answers every block in the order it asked.
So a shuffle carries an n-gram once a block, there and back, never once an occurrence.

A part's answer has the counts, and for each history what its backoff weight is made of: how many of its continuations were seen r times, r up to
the discounts' limit, and the counts that these continuations have at the order below. All are whole numbers, so the weight is the same whatever the
dealing. A history of very many tokens is dealt over several parts by its continuations too, and its sums are added up before the answer.

With counts and weights at hand a block's tokens are scored by recursion from the lowest order up: the discounted share where the n-gram was seen, else the
history's weight times the probability at the order below.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import ship, slices, stage_table
from ridgeline.llm.words import ODD, mix

#: Bytes of text in a block; n-grams asked of a part of a table; tokens of a history from which it is dealt over several parts.
BLOCK, PART, SPREAD = 12 << 20, 1 << 17, 1 << 14
#: Counts above this aren't discounted.
MOST = 5
#: The end of a text as a word that no text has; the beginning, a history only, by id.
END, BEGIN = np.uint64(1), np.int64(-1)

#: Bytes in lower case (A-Z only), 0 for those that part words.
FOLD = np.arange(1, 257, dtype=np.uint64)
FOLD[ord("A") : ord("Z") + 1] += np.uint64(32)
FOLD[[9, 10, 11, 12, 13, 32]] = 0
SYMBOL = mix(FOLD * ODD)
BASE = np.uint64(0xC2B2AE3D27D4EB4F)
STRIDE = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE, and of its inverse, modulo 2^64."""
    both = (BASE, np.uint64(pow(int(BASE), -1, 1 << 64)))
    return tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, b, dtype=np.uint64))), dtype=np.uint64) for b in both)


POWERS = powers(STRIDE)


def hashed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of data, and where they begin."""
    found, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    k = 0
    while k < len(data):
        e = min(len(data), k + STRIDE)
        if e < len(data):
            spaces = np.flatnonzero(FOLD[data[k:e]] == 0)
            if len(spaces):
                e = k + int(spaces[-1]) + 1
            else:  # within a word longer than a stride
                spaces = np.flatnonzero(FOLD[data[e:]] == 0)
                e = e + int(spaces[0]) if len(spaces) else len(data)
        part = data[k:e]
        up, down = POWERS if len(part) <= STRIDE else powers(len(part))
        edge = np.flatnonzero(np.diff((FOLD[part] > 0).view(np.int8), prepend=0, append=0))
        start, end = edge[::2], edge[1::2]
        if len(start):
            sums = np.cumsum(SYMBOL[part] * up[: len(part)], dtype=np.uint64)
            before = np.where(start > 0, sums[start - 1], np.uint64(0))
            found.append(mix((sums[end - 1] - before) * down[start] ^ (end - start).astype(np.uint64) * ODD))
            places.append(start + k)
        k = e
    return np.concatenate(found), np.concatenate(places)


def token_stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, each text followed by its end, and the number of tokens of each."""
    raw = [(t or "").encode() for t in texts]
    words, place = hashed_words(np.frombuffer(b"\n".join(raw), dtype=np.uint8))
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), place, side="right")
    lens = np.bincount(owner, minlength=len(texts)) + 1
    out = np.full(len(words) + len(texts), END)
    out[np.arange(len(words)) + owner] = words
    return out, lens


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane, compressed."""
    out = []
    for x in arrays:
        planes = np.ascontiguousarray(x, dtype=np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()
        z = zstandard.ZstdCompressor(level=1).compress(planes)
        out += [struct.pack("<q", len(z)), z]
    return b"".join(out)


def unpack(payload: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(payload):
        (n,) = struct.unpack_from("<q", payload, at)
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[at + 8 : at + 8 + n]), dtype=np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).ravel())
        at += 8 + n
    return out


def unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64)


def steps(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=sorted_.dtype.type(0))


class Discounts:
    """What is left of a count r: r times a factor below 1 up to MOST, r itself above.

    The factors are Katz's form of Good-Turing; where the counts of counts give one outside (0, 1), the order takes absolute discounting for all of them.
    seen: how many n-grams have the count 1, 2, ... MOST + 1.
    """

    def __init__(self, seen: list[int]):
        r = np.arange(1, MOST + 1)
        n = np.array(seen, dtype=float)
        with np.errstate(divide="ignore", invalid="ignore"):
            common = (MOST + 1) * n[MOST] / n[0]
            kept = ((r + 1) * n[1:] / (r * n[:-1]) - common) / (1 - common)
        if not ((kept > 0) & (kept < 1)).all():
            kept = (r - (n[0] + 1) / (n[0] + 2 * n[1] + 2)) / r
        self.of = np.concatenate(([0.0], r * kept))
        #: What a count gives away.
        self.freed = r * (1 - kept)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts <= MOST, self.of[np.minimum(counts, MOST)], counts)


class Sizes:
    """What the driver learns, a few numbers: tokens and texts that teach, different words, discounts and parts of each order's table."""

    def __init__(self) -> None:
        self.tokens = self.texts = self.words = 0
        self.discounts: list[Discounts] = []
        self.parts: list[int] = []

    def single(self, seen: list[int]) -> None:
        """The lowest order: its total, and the share of all unknown words together."""
        self.discounts.append(Discounts(seen))
        freed = float((self.discounts[0].freed * np.array(seen[:MOST])).sum())
        self.total, self.unknown = (float(self.tokens), freed / self.tokens) if freed > 0 else (self.tokens + 1.0, 1 / (self.tokens + 1.0))


class Asked:
    """The different n-grams of a block that have a seen history, by part of the table: what is asked, and where the answers belong."""

    def __init__(self, block: Scored, parts: int):
        self.live = live = np.flatnonzero((block.place >= block.order - 1) & (block.history_count > 0))
        words = len(block.ids)
        self.histories, self.history_of = np.unique(block.history[live], return_inverse=True)
        grams, self.gram_of = np.unique(self.history_of * words + block.local[live], return_inverse=True)
        history, word = np.divmod(grams, max(1, words))
        ids = block.ids[word]
        lower, self.count, self.below = np.zeros(len(grams), np.int64), np.zeros(len(self.histories), np.int64), np.ones(len(self.histories))
        lower[self.gram_of] = block.count[live]
        self.count[self.history_of] = block.history_count[live]
        self.below[self.history_of] = block.total[live]
        taught = np.bincount(self.gram_of, weights=block.teaches[live], minlength=len(grams)).astype(np.int64)
        spread = -(-self.count // SPREAD)
        self.hot = spread > 1
        part = (mix(unsigned(self.histories) * ODD)[history] + mix(unsigned(ids) * ODD) % unsigned(spread)[history]) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.payloads: dict[int, bytes] = {}
        self.grams = len(grams)
        for p in np.flatnonzero(np.diff(edges)).tolist():
            mine = order[edges[p] : edges[p + 1]]
            first = np.flatnonzero(np.diff(history[mine], prepend=-1))
            held = history[mine][first]
            self.parts[p] = mine, held
            self.payloads[p] = (held, first, mine, ids, taught, lower)  # packed when it is sent

    def payload(self, p: int) -> bytes:
        held, first, mine, ids, taught, lower = self.payloads[p]
        return pack(self.histories[held], np.diff(np.append(first, len(mine))), self.hot[held], ids[mine], taught[mine], lower[mine])


class Scored:
    """A block's tokens with their probabilities by the orders answered so far."""

    def __init__(self, local: np.ndarray, lens: np.ndarray, teaches: np.ndarray, ids: np.ndarray, counts: np.ndarray, sizes: Sizes):
        self.local, self.ids, self.sizes = local, ids, sizes
        self.first = np.cumsum(lens) - lens
        self.place = np.arange(len(local)) - np.repeat(self.first, lens)
        self.teaches = np.repeat(teaches, lens)
        self.order = 1
        self.count = self.words = counts[local]
        self.prob = np.where(self.count > 0, sizes.discounts[0](self.count) / sizes.total, sizes.unknown)
        self.total = np.full(len(local), sizes.total)
        self.history, self.history_count = self.before(ids[local], BEGIN), self.before(self.count, sizes.texts)

    def before(self, x: np.ndarray, at_first) -> np.ndarray:
        """The value of the token before."""
        out = np.empty_like(x)
        out[1:], out[self.first] = x[:-1], at_first
        return out

    def answered(self, asked: Asked, counts: np.ndarray, sums: np.ndarray) -> None:
        """Goes on to the next order. counts: of the n-grams asked; sums: see Table, by history."""
        discount, lower = self.sizes.discounts[self.order], self.sizes.discounts[self.order - 1]
        freed = sums[:, :MOST] @ discount.freed
        # a history that gives nothing away is counted once more, so that there is a share for the unseen
        total = np.where(freed > 0, asked.count, asked.count + 1.0)
        left = np.where(freed > 0, freed, 1.0) / total
        below = (sums[:, MOST] - sums[:, MOST + 1 :] @ lower.freed) / asked.below
        weight = left / (1 - below)
        live, count = asked.live, counts[asked.gram_of]
        self.prob[live] = np.where(count > 0, discount(count) / total[asked.history_of], weight[asked.history_of] * self.prob[live])
        self.total[live] = total[asked.history_of]
        self.count = np.zeros(len(self.local), dtype=np.int64)
        self.count[live] = count
        # one word more to the front of every history
        self.order += 1
        back = self.order  # the word so many tokens ago, the beginning at the first place that has one
        far = np.full(len(self.local), BEGIN)
        has = np.flatnonzero(self.place >= back)
        far[has] = self.ids[self.local[has - back]]
        self.history = mix(unsigned(self.history) * ODD + mix(unsigned(far))).view(np.int64)
        self.history_count = self.before(self.count, 0)


class Table:
    """A part of an order's table: the n-grams that blocks asked for, with their counts.

    sums by history: how many continuations were seen 1 to MOST times; their counts at the order below, all together; and how many have 1 to
    MOST there.
    """

    def __init__(self, payloads: list[bytes]):
        asked = [unpack(p) for p in payloads]
        self.asked_histories, self.hot = [a[0] for a in asked], [a[2].astype(bool) for a in asked]
        self.lens = [len(a[3]) for a in asked]
        self.histories, history = np.unique(np.concatenate([np.repeat(a[0], a[1]) for a in asked]), return_inverse=True)
        words, word = np.unique(np.concatenate([a[3] for a in asked]), return_inverse=True)
        _, first, self.gram_of = np.unique(history * len(words) + word, return_index=True, return_inverse=True)
        self.count = np.bincount(self.gram_of, weights=np.concatenate([a[4] for a in asked])).astype(np.int64)
        lower, of = np.concatenate([a[5] for a in asked])[first], history[first]
        self.seen = np.bincount(self.count[self.count <= MOST + 1], minlength=MOST + 2)[1:]
        n = len(self.histories)
        seen = self.count > 0
        self.sums = np.zeros((n, 2 * MOST + 1), dtype=np.int64)
        for r in range(1, MOST + 1):
            self.sums[:, r - 1] = np.bincount(of[self.count == r], minlength=n)
            self.sums[:, MOST + r] = np.bincount(of[seen & (lower == r)], minlength=n)
        self.sums[:, MOST] = np.bincount(of[seen], weights=lower[seen], minlength=n)

    def answers(self) -> Iterator[tuple[bytes, np.ndarray]]:
        """For each block that asked: counts, and its histories' sums but for hot ones; and which hot ones it asked for."""
        at = 0
        for n, histories, hot in zip(self.lens, self.asked_histories, self.hot, strict=True):
            sums = self.sums[np.searchsorted(self.histories, histories)]
            sums[hot] = 0
            yield pack(self.count[self.gram_of[at : at + n]], sums.T.ravel()), histories[hot]
            at += n

    def hot_sums(self) -> tuple[np.ndarray, np.ndarray]:
        hot = np.unique(np.concatenate([h[x] for h, x in zip(self.asked_histories, self.hot, strict=True)]))
        return hot, self.sums[np.searchsorted(self.histories, hot)]


ANSWER = "block long, part int, payload binary, hot array<long>, sums array<array<long>>, seen array<long>"
ASK = "part int, block long, payload binary"


def answer_table(part: int, blocks: list, payloads: list[bytes], asked_hot: list, hot, sums, seen) -> pa.Table:
    """Answers to blocks, and a row for the driver (block -1) with what the part counted."""
    n = len(blocks)
    lists = pa.list_(pa.int64())
    return pa.table(
        {
            "block": pa.array([*blocks, -1], pa.int64()),
            "part": pa.array([part] * (n + 1), pa.int32()),
            "payload": pa.array([*payloads, None], pa.binary()),
            "hot": pa.array([*asked_hot, hot], lists),
            "sums": pa.array([*[None] * n, sums], pa.list_(lists)),
            "seen": pa.array([*[None] * n, seen], lists),
        }
    )


def text_blocks(docs: DataFrame, teaches: Column, id_col: str, text_col: str) -> DataFrame:
    """A row for each block of texts: ids, which of them teach, tokens of each, the tokens as places in the block's words, and the words; stored."""
    ship(docs.sparkSession)
    fields = [
        T.StructField("block", T.LongType()),
        T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)),
        T.StructField("teaches", T.ArrayType(T.BooleanType())),
        T.StructField("lens", T.ArrayType(T.LongType())),
        *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_words", "n_teaching")),
        T.StructField("tokens", T.BinaryType()),
        T.StructField("words", T.BinaryType()),
    ]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in slices(batches, BLOCK):
            if not batch.num_rows:
                continue
            stream, lens = token_stream(batch.column("text").to_pylist())
            teach = batch.column("teaches").to_numpy(zero_copy_only=False).astype(bool)
            words, local = np.unique(stream, return_inverse=True)
            counts = np.bincount(local, weights=np.repeat(teach, lens), minlength=len(words)).astype(np.int64)
            row = {"block": next(number), "teaches": teach.tolist(), "lens": lens.tolist(), "n_tokens": len(stream), "n_words": len(words), "n_teaching": int(teach.sum())}
            row |= {"tokens": pack(local), "words": pack(steps(words).view(np.int64), counts)}
            cells = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("id")) if c == "ids" else pa.array([row[c]], None if c not in ("teaches", "lens") else pa.list_(pa.bool_() if c == "teaches" else pa.int64())) for c in names]
            yield pa.RecordBatch.from_arrays(cells, names)
        pa.default_memory_pool().release_unused()

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), teaches.alias("teaches"))
    return stage_table(given.mapInArrow(run, T.StructType(fields)), "blocks")


def word_table(blocks: DataFrame, parts: int) -> DataFrame:
    """The lowest order: every word of a block gets its number and its count; stored."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist(), strict=True):
                words, counts = unpack(payload)
                words = np.cumsum(unsigned(words), dtype=np.uint64)
                part = (words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
                edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
                rows = [(p, pack(steps(words[a:b]).view(np.int64), counts[a:b])) for p, (a, b) in enumerate(itertools.pairwise(edges.tolist())) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["part", "block", "payload"])

    def answer(group: pa.Table) -> pa.Table:
        asked = [unpack(p) for p in group.column("payload").to_pylist()]
        lens = [len(a[0]) for a in asked]
        words, word = np.unique(np.concatenate([np.cumsum(unsigned(a[0]), dtype=np.uint64) for a in asked]), return_inverse=True)
        count = np.bincount(word, weights=np.concatenate([a[1] for a in asked]), minlength=len(words)).astype(np.int64)
        cuts = np.concatenate(([0], np.cumsum(lens))).tolist()
        payloads = [pack(steps(word[a:b]), count[word[a:b]]) for a, b in itertools.pairwise(cuts)]
        seen = [*np.bincount(count[count <= MOST + 1], minlength=MOST + 2)[1:].tolist(), int(count.sum()), int((count > 0).sum())]
        return answer_table(group.column("part")[0].as_py(), group.column("block").to_pylist(), payloads, [[]] * len(lens), [], [], seen)

    asked = blocks.select("block", "words").mapInArrow(ask, ASK)
    return stage_table(asked.groupBy("part").applyInArrow(answer, ANSWER), "words")


def counted(answers: DataFrame) -> list[int]:
    """What all parts counted together."""
    sums = answers.where("block < 0").select(F.posexplode("seen")).groupBy("pos").agg(F.sum("col").alias("n")).orderBy("pos")
    return [r["n"] for r in sums.collect()]


def hot_answers(answers: DataFrame) -> DataFrame:
    """(block, history, sums) for the hot histories that each block asked for, over all parts."""
    partial = answers.where("block < 0").select(F.explode(F.arrays_zip("hot", "sums")).alias("x")).select(F.col("x.hot").alias("history"), F.col("x.sums").alias("sums"))
    whole = partial.groupBy("history").agg(F.array(*(F.sum(F.col("sums")[i]) for i in range(2 * MOST + 1))).alias("sums"))
    asked = answers.where("block >= 0").select("block", F.explode("hot").alias("history")).distinct()
    return asked.join(whole, "history").select("block", "history", "sums")


def gathered(blocks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """A block's tokens and all answers to it, as rows of one schema. level: 0 tokens, 1 words, then the orders; hot sums have a history."""
    ids = blocks.schema["ids"]
    none = {"level": F.lit(0), "part": F.lit(None).cast("int"), "payload": F.lit(None).cast("binary"), "history": F.lit(None).cast("long"), "sums": F.lit(None).cast("array<long>")}
    none |= {"ids": F.lit(None).cast(ids.dataType), "teaches": F.lit(None).cast("array<boolean>"), "lens": F.lit(None).cast("array<long>")}

    def rows(df: DataFrame, **given: Column) -> DataFrame:
        return df.select("block", *[(given.get(c, v)).alias(c) for c, v in none.items()])

    col = F.col
    out = rows(blocks, payload=col("tokens"), ids=col("ids"), teaches=col("teaches"), lens=col("lens"))
    for k, found in enumerate(answers, 1):
        out = out.union(rows(found.where("block >= 0"), level=F.lit(k), part=col("part"), payload=col("payload")))
        if k > 1:
            out = out.union(rows(hot_answers(found), level=F.lit(k), history=col("history"), sums=col("sums")))
    return out


def replayed(group: pa.Table, sizes: Sizes) -> tuple[Scored, pa.Table]:
    """A block scored by all orders that were answered, and its row of tokens."""
    level = group.column("level").to_numpy()
    own = group.take(pa.array(np.flatnonzero(level == 0)))
    (local,) = unpack(own.column("payload")[0].as_py())
    lens, teaches = (np.array(own.column(c)[0].as_py(), dtype=t) for c, t in (("lens", np.int64), ("teaches", bool)))

    def answers(k: int) -> tuple[list[tuple[int, list[np.ndarray]]], list[tuple[int, list[int]]]]:
        mine = group.take(pa.array(np.flatnonzero(level == k)))
        rows = [*zip(*(mine.column(c).to_pylist() for c in ("part", "payload", "history", "sums")), strict=True)]
        return sorted(((p, unpack(x)) for p, x, h, _ in rows if h is None), key=lambda r: r[0]), [(h, s) for _, _, h, s in rows if h is not None]

    words, _ = answers(1)
    ids = np.concatenate([np.cumsum(x[0]) * sizes.parts[0] + p for p, x in words])
    block = Scored(local, lens, teaches, ids, np.concatenate([x[1] for _, x in words]), sizes)
    for k in range(2, len(sizes.discounts) + 1):
        asked = Asked(block, sizes.parts[k - 1])
        found, hot = answers(k)
        counts, sums = np.zeros(asked.grams, np.int64), np.zeros((len(asked.histories), 2 * MOST + 1), np.int64)
        for p, (count, flat) in found:
            mine, held = asked.parts[p]
            counts[mine] = count
            sums[held] += flat.reshape(2 * MOST + 1, -1).T
        if hot:
            sums[np.searchsorted(asked.histories, np.array([h for h, _ in hot]))] = np.array([s for _, s in hot])
        block.answered(asked, counts, sums)
    return block, own


def gram_table(blocks: DataFrame, answers: list[DataFrame], sizes: Sizes, parts: int) -> DataFrame:
    """The next order's table, as answers to the blocks; stored."""

    def ask(group: pa.Table) -> pa.Table:
        block, own = replayed(group, sizes)
        asked = Asked(block, parts)
        found = [*asked.parts]
        payloads = [asked.payload(p) for p in found]
        return pa.table({"part": pa.array(found, pa.int32()), "block": pa.array(own.column("block").to_pylist() * len(found), pa.int64()), "payload": pa.array(payloads, pa.binary())})

    def answer(group: pa.Table) -> pa.Table:
        table = Table(group.column("payload").to_pylist())
        found = [*table.answers()]
        hot, sums = table.hot_sums()
        blocks_ = group.column("block").to_pylist()
        return answer_table(group.column("part")[0].as_py(), blocks_, [x for x, _ in found], [h.tolist() for _, h in found], hot.tolist(), sums.tolist(), table.seen.tolist())

    asked = gathered(blocks, answers).groupBy("block").applyInArrow(ask, ASK)
    return stage_table(asked.groupBy("part").applyInArrow(answer, ANSWER), "grams")


def score_texts(docs: DataFrame, teaches: Column, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Words are runs of characters other than the space and \\t to \\r, A-Z in lower case; a text's tokens are its words and one end. teaches: which rows the model learns
    from (null: not). n_known are tokens that the training texts have, train_tokens the number of theirs. base_score is the add-one unigram log10 probability, score that of
    the Katz model of n-grams up to `order` (2 at least); a text's beginning is a history, so the first word is scored by it.
    Words that no training text has are one unknown word. Where nothing teaches, every text scores 0.
    A null text counts as empty and is its end; every row counts, repeated ones too; a null id is an id like others; other columns are ignored; an empty table gives an
    empty table. Words are told by 64-bit hashes, histories of two words or more as well; n-grams within a history by the words' numbers.
    Nothing but sums over the corpus reaches the driver. Memory follows a block (BLOCK bytes of text, or the longest text) and a part's n-grams.
    """
    if order < 2:
        raise ValueError("a backoff model has order 2 at least")
    blocks = text_blocks(docs, F.coalesce(teaches, F.lit(False)), id_col, text_col)
    n = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_words", "n_teaching"))).first()
    sizes = Sizes()
    sizes.texts, sizes.parts = n["n_teaching"], [-(-n["n_words"] // PART) or 1]
    answers = [word_table(blocks, sizes.parts[0])]
    *seen, sizes.tokens, sizes.words = counted(answers[0]) or [0] * (MOST + 3)
    sizes.single(seen)
    for _ in range(order - 1):
        parts = -(-n["n_tokens"] // PART) or 1
        answers.append(gram_table(blocks, answers, sizes, parts))
        sizes.parts.append(parts)
        sizes.discounts.append(Discounts(counted(answers[-1]) or [0] * (MOST + 1)))

    def score(group: pa.Table) -> pa.Table:
        block, own = replayed(group, sizes)
        base = np.log10((block.words + 1) / (sizes.tokens + sizes.words + 1))
        ends = np.append(block.first, len(block.local))
        columns = [pa.array(np.diff(ends)), pa.array(np.add.reduceat((block.words > 0).astype(np.int64), block.first)), pa.array(np.full(len(block.first), sizes.tokens))]
        columns += [pa.array(np.add.reduceat(x, block.first)) for x in (base, np.log10(block.prob))]
        return pa.table([own.column("ids").combine_chunks().flatten(), *columns], names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])
    return gathered(blocks, answers).groupBy("block").applyInArrow(score, schema)


def op12(docs: DataFrame) -> DataFrame:
    """The digest query: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A null id is neither held out nor taught from."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    scored = score_texts(docs.select("doc_id", "text"), rest != 2)
    return scored.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
