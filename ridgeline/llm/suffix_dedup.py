"""Exact removal of repeated byte strings, by merging shard Burrows-Wheeler transforms.

Two strings of `length` bytes can only be equal if their anchors are: the k-byte substring of least hash, the leftmost of equals, which
depends on the string alone. So texts are first cut into runs of windows with one anchor, and runs whose anchor occurs once
in the corpus are done with. What is left are contexts around equal anchors, and since equal windows hold their anchor at the same
place, these contexts are aligned. Of a context that occurs more often, two occurrences go on, cut from their own texts.

In each task the contexts of its anchors form several shards. Every shard has its (positional, multi-string) Burrows-Wheeler
transform: for each column the symbols that follow the prefixes in the order of the reversed prefixes. The shards are merged by
refining their interleave column after column: reading the next symbol of the shard that each place of the interleave
names, and distributing the places stably by symbol, gives the interleave of prefixes one longer. No suffixes are sorted again and no
texts compared. The common prefix of neighbours follows from the maximum over the places between them, and neighbours that have agreed
for `length` bytes are a repeated interval. Every removed byte lies in an interval that such a merge has found.

An anchor with more contexts than a group should hold is parted: the windows of its first and of its second half of places have
longer strings in common, and only contexts that share those can share such windows. The halves are groups of their own, in
which equal rests of contexts fold into one, and are parted again until every group is small; one single window is one context.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import Kept, append_columns, give_back, ship, slices, stage_table
from ridgeline.llm.words import ODD, mix

LENGTH, CORE = 400, 200
SEGMENT = 1 << 19
#: Contexts in a group from which on it is parted into halves.
GROUP = 256
SHARDS, CHUNK, ROWS_A_TASK = 4, 4096, 16_384
#: A key with more than this part of all rows is frequent: there are fewer of them than the number's inverse, so they may be broadcast.
FREQUENT = 1 / 1000

BASE = np.uint64(0xC2B2AE3D27D4EB4F)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * ODD)


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, made when first asked for."""

    power = inverse = None

    @classmethod
    def get(cls) -> tuple[np.ndarray, np.ndarray]:
        if cls.power is None:
            n = SEGMENT + 2 * LENGTH + 1
            cls.power, cls.inverse = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, b))), dtype=np.uint64) for b in (BASE, BASE_INVERSE))
        return cls.power, cls.inverse


def prefix_sums(data: np.ndarray) -> np.ndarray:
    power, _ = Powers.get()
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(SYMBOL[data] * power[: len(data)], dtype=np.uint64)))


def hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] that don't depend on the place."""
    _, inverse = Powers.get()
    return mix((sums[end] - sums[start]) * inverse[start])


def anchor_runs(data: np.ndarray, length: int, core: int) -> np.ndarray:
    """(anchor hash, context hash, anchor place, first window, last window) of each run of windows with one anchor, as columns."""
    out = []
    for at in range(0, len(data) - length + 1, SEGMENT):
        part = data[at : at + SEGMENT + length - 1]
        sums = prefix_sums(part)
        places = np.arange(len(part) - core + 1)
        grams = hashes(sums, places, places + core)
        key = grams & np.uint64(0xFFFFFFFFFFF00000) | places.astype(np.uint64)
        # the least key in every window of `width` keys, by minima within blocks from both sides
        width = length - core + 1
        windows = len(key) - width + 1
        full = np.full(-(-len(key) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        full[: len(key)] = key
        blocks = full.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.append(first[1:], windows) - 1
        a = anchor[first]
        shape = ((a - first) * 1024 + (last - first)).astype(np.uint64)
        context = mix(hashes(sums, first, last + length) + shape * ODD)
        out.append(np.stack([grams[a].view(np.int64), context.view(np.int64), a + at, first + at, last + at]))
    return np.concatenate(out, axis=1) if out else np.empty((5, 0), np.int64)


def shard_transforms(symbols: np.ndarray, group: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column the rows in the order of (shard, group, reversed prefix), and the symbols that come next: the shards' transforms.

    Each shard's own part of the two is its transform; all shards are refined side by side.
    """
    rows, columns = symbols.shape
    order = np.lexsort((group, shard))
    high = (shard.astype(np.int64) << 44 | group.astype(np.int64) << 12)[order]
    orders, following = np.empty((columns + 1, rows), dtype=np.int32), np.empty((columns, rows), dtype=np.int16)
    orders[0] = order
    for c in range(columns):
        following[c] = symbols[orders[c], c]
        # high is the same in every column: a stable sort moves rows only within their shard and group
        orders[c + 1] = orders[c][np.argsort(high + following[c], kind="stable")]
    return orders, following


def merge_transforms(orders: np.ndarray, following: np.ndarray, group: np.ndarray, shard: np.ndarray, span: int) -> np.ndarray:
    """repeats[row, s]: the row's columns s to s + span equal another row's of its group, from the shards' transforms alone."""
    columns, rows = following.shape
    base = np.concatenate(([0], np.cumsum(np.bincount(shard, minlength=SHARDS))))[:-1]
    # the interleave of empty prefixes: by group, then shard
    start = np.lexsort((shard, group))
    interleave, high = shard[start].astype(np.int64), group[start].astype(np.int64) << 12
    since = np.zeros(rows, dtype=np.int32)  # the column from which a place agrees with the one before
    repeats = np.zeros((rows, columns - span + 1), dtype=bool)
    if not span:  # empty strings agree wherever they are in one group
        same = np.flatnonzero(np.diff(high) == 0)
        repeats[start[same], 0] = repeats[start[same + 1], 0] = True
        return repeats

    def pointers(z: np.ndarray) -> np.ndarray:
        at = np.empty(rows, dtype=np.int64)
        for s in range(SHARDS):
            own = np.flatnonzero(z == s)
            at[own] = base[s] + np.arange(len(own))
        return at

    for c in range(columns):
        key = high + following[c][pointers(interleave)]
        to = np.argsort(key, kind="stable")
        key = key[to]
        same = np.flatnonzero(key[1:] == key[:-1])
        fresh = np.full(rows, c + 1, dtype=np.int32)
        if len(same):
            left, right = to[same], to[same + 1]
            # places between two that stay together were between them before: the latest disagreement counts
            bounds = np.stack([left + 1, right + 1], axis=1).ravel()
            fresh[same + 1] = np.maximum.reduceat(np.append(since, c + 1), bounds)[::2]
        interleave, since = interleave[to], fresh
        if c + 1 >= span:
            s = c + 1 - span
            agree = np.flatnonzero(since[1:] <= s)
            if len(agree):
                row = orders[c + 1][pointers(interleave)]
                repeats[row[agree], s] = repeats[row[agree + 1], s] = True
    return repeats


def repeated_windows(group: np.ndarray, left: np.ndarray, texts: list[bytes], side: int) -> np.ndarray:
    """repeats[row, s] for aligned contexts: the window that begins side - s bytes before what the row's group has in common repeats in it.

    texts: a context without the common part; left: how many bytes of it stand before. A window has `side` bytes beside the common part.
    """
    symbols = np.full((len(texts), 2 * side), 256, dtype=np.int16)  # 256 is no byte: nothing valid agrees with it
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    row = np.repeat(np.arange(len(texts)), lens)
    symbols[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(side - left, lens)] = flat
    shard = np.arange(len(texts)) % SHARDS
    orders, following = shard_transforms(symbols, group, shard)
    repeats = merge_transforms(orders, following, group, shard, side)
    # windows beyond the row's own bytes agree in nothing but padding
    s = np.arange(side + 1)
    return repeats & (s >= (side - left)[:, None]) & (s + side <= (side - left + lens)[:, None])


def intervals(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The union of half-open intervals as maximal runs (starts, ends)."""
    if not len(start):
        return np.empty((2, 0), np.int64)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return np.stack([start[new], np.append(end[new[1:] - 1], end[-1])])


RUNS = "same binary, anchor long, context long, place int, first int, last int"
#: A context or a part of one, named (a, b). key: what its group has in common, the windows lo to hi of its anchor; copies: 1, or 2 for more.
PIECES = "a long, b long, key binary, copies int, lo int, hi int, before int, bytes binary"
HALVES = f"of_a long, of_b long, shift int, {PIECES}"


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def digest(*parts: bytes) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(p)
    return h.digest()


ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def names_of(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


def columns_of(rows: list[tuple], columns: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t.split()[1]]) for c, t in zip(zip(*rows, strict=True), columns.split(", "), strict=True)], names_of(columns))


def find_runs(texts: DataFrame, length: int, core: int) -> DataFrame:
    """The runs of windows with one anchor of all texts (same, text)."""
    names = names_of(RUNS)

    def find(batches):
        Kept.drop()
        for batch in slices(batches):
            rows, which = [], []
            for i, t in enumerate(batch.column("text")):
                found = anchor_runs(np.frombuffer(t.as_buffer(), dtype=np.uint8), length, core)
                rows.append(found)
                which.append(np.full(found.shape[1], i))
            if rows:
                found = np.concatenate(rows, axis=1)
                same = batch.column("same").take(pa.array(np.concatenate(which)))
                yield pa.RecordBatch.from_arrays([same, *map(pa.array, found[:2]), *(pa.array(c.astype(np.int32)) for c in found[2:])], names)
        give_back()

    return texts.where(F.octet_length("text") >= length).mapInArrow(find, RUNS)


def frequent(counts: DataFrame, total: int) -> DataFrame:
    """The rows of counts (a count n for each key, of `total` rows in all) of frequent keys: fewer than 1 / FREQUENT."""
    return F.broadcast(counts.where(F.col("n") > max(1.0, total * FREQUENT)).drop("n"))


def cut_contexts(contexts: DataFrame, texts: DataFrame, length: int, core: int) -> DataFrame:
    """The contexts' bytes as pieces: of each, one occurrence or two."""
    two = F.when((F.col("n") > 1) & (F.col("least") != F.col("most")), F.array("least", "most")).otherwise(F.array("least"))
    copies = F.when((F.col("n") > 1) & (F.col("least") == F.col("most")), 2).otherwise(1)
    wanted = contexts.select("anchor", "context", copies.alias("copies"), F.explode(two).alias("one")).select("anchor", "context", "copies", "one.*")
    asked = wanted.groupBy("same").agg(F.collect_list(F.struct("anchor", "context", "copies", "place", "first", "last")).alias("asked"))
    # one of each text's copies: they meet in each task before they are dealt
    holders = texts.groupBy("same").agg(F.first("text").alias("text")).join(asked, "same").select("text", "asked")

    def cut(batches):
        for batch in slices(batches):
            for k in range(batch.num_rows):
                data, asked = memoryview(batch.column("text")[k].as_buffer()), batch.column("asked").slice(k, 1).flatten()
                found = [asked.field(i).to_numpy().tolist() for i in range(6)]
                for at in range(0, len(found[0]), CHUNK):
                    rows = []
                    for anchor, context, n, p, a, z in zip(*(c[at : at + CHUNK] for c in found), strict=True):
                        end = z + length
                        rows.append((anchor, context, digest(data[p : p + core]), n, 0, length - core, p - a, b"".join((data[a:p], data[p + core : end]))))
                    yield columns_of(rows, PIECES)
        give_back()

    return holders.mapInArrow(cut, PIECES)


def halves(pieces: DataFrame) -> DataFrame:
    """Both halves of every piece, where it has windows there, with the piece that they are part of and their first window in it."""

    def part(batches):
        for batch in slices(batches):
            rows = []
            for a, b, key, n, lo, hi, before, data in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                first, last = hi - before, lo + len(data) - before
                left, right = data[:before], data[before:]
                middle = (lo + hi + 1) // 2
                if first < middle:  # windows up to middle - 1 have the bytes from the last one's first on in common
                    z = min(last, middle - 1)
                    new = digest(key, b"-", left[len(left) - (hi - middle + 1) :])
                    rest = left[: middle - 1 - first], right[: z - lo]
                    rows.append((a, b, 0, new, n, lo, middle - 1, *rest))
                if last >= middle:
                    f = max(first, middle)
                    new = digest(key, b"+", right[: middle - lo])
                    rest = left[len(left) - (hi - f) :] if hi > f else b"", right[middle - lo :]
                    rows.append((a, b, f - first, new, n, middle, hi, *rest))
            named = []
            for a, b, shift, key, n, lo, hi, left, right in rows:
                name = digest(key, len(left).to_bytes(4, "little"), left, right)
                x, y = (int.from_bytes(name[i : i + 8], "little", signed=True) for i in (0, 8))
                named.append((a, b, shift, x, y, key, n, lo, hi, len(left), left + right))
            if named:
                yield columns_of(named, HALVES)
        give_back()

    return pieces.select(names_of(PIECES)).mapInArrow(part, HALVES)


def merge_groups(pieces: DataFrame, rows: int) -> DataFrame:
    """(a, b, since, until): the repeated windows of each piece, numbered from its first, by merging the transforms of each group's pieces."""
    tasks = max(1, -(-rows // ROWS_A_TASK))

    def merge(group):
        group = group.combine_chunks()
        key = np.frombuffer(b"".join(group.column("key").to_pylist()), dtype=np.int64).reshape(-1, 2)
        lo, hi, left, copies = (group.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "before", "copies"))
        text = group.column("bytes").to_pylist()
        order = np.lexsort((key[:, 0], key[:, 1], hi - lo))
        order = np.repeat(order, copies[order])
        side, own = (hi - lo)[order], key[order]
        number = np.cumsum(np.concatenate(([0], (np.diff(own, axis=0) != 0).any(axis=1) | (np.diff(side) != 0))))
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(number) > 0)))
        out = [[], [], []]
        k = 0
        while k < len(cuts):
            # whole groups of one width, about CHUNK rows
            most = min(cuts[k] + CHUNK, int(np.searchsorted(side, side[cuts[k]], side="right")))
            e = max(k + 1, int(np.searchsorted(cuts, most, side="right")) - 1)
            if e == len(cuts) - 1 and most == len(order):
                e = len(cuts)
            at = slice(cuts[k], cuts[e] if e < len(cuts) else len(order))
            some, width = order[at], int(side[cuts[k]])
            repeats = repeated_windows(number[at] - number[cuts[k]], left[some], [text[i] for i in some.tolist()], width)
            repeats = repeats[np.concatenate(([True], some[1:] != some[:-1]))]
            some = some[np.concatenate(([True], some[1:] != some[:-1]))]
            edge = np.diff(np.pad(repeats, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            i, s = np.nonzero(edge == 1)
            _, z = np.nonzero(edge == -1)
            skip = width - left[some[i]]
            for column, found in zip(out, (some[i], s - skip, z - 1 - skip), strict=True):
                column.append(found)
            k = e
        which, since, until = map(np.concatenate, out)
        del text, out
        give_back()
        return pa.table([*(group.column(c).take(pa.array(which)) for c in ("a", "b")), pa.array(since), pa.array(until)], names=["a", "b", "since", "until"])

    dealt = pieces.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(merge, "a long, b long, since long, until long")


def merged_windows(pieces: DataFrame) -> DataFrame:
    """merge_groups() of stored pieces with groups of any size: large ones are parted into halves until none is."""
    sizes = pieces.groupBy("key").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"))
    sizes = stage_table(sizes.where("copies > 1"), "groups")
    rows, small, large = sizes.agg(F.sum("n"), F.count(F.when(F.col("n") <= GROUP, 1)), F.count(F.when(F.col("n") > GROUP, 1))).first()
    if not large:
        return merge_groups(pieces.join(sizes, "key", "left_semi"), rows or 0)
    # the keys of large groups are fewer than rows / GROUP; Spark broadcasts them only below its own threshold
    parted = stage_table(halves(pieces.join(sizes.where(F.col("n") > GROUP), "key", "left_semi")), "halves")
    folded = parted.groupBy("a", "b").agg(F.first("key").alias("key"), F.least(F.sum("copies"), F.lit(2)).cast("int").alias("copies"), *(F.first(c).alias(c) for c in ("lo", "hi", "before", "bytes")))
    found = stage_table(merged_windows(stage_table(folded, "pieces")), "windows")
    up = parted.select("of_a", "of_b", "shift", "a", "b").join(found, ["a", "b"])
    up = up.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"), F.col("since") + F.col("shift"), F.col("until") + F.col("shift"))
    return merge_groups(pieces.join(sizes.where(F.col("n") <= GROUP), "key", "left_semi"), rows).union(up) if small else up.toDF("a", "b", "since", "until")


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, core: int = CORE) -> DataFrame:
    """(same, starts, ends): for each different text that has any (same: its MD5), intervals of bytes whose union is covered by repeats.

    A byte is covered if it lies in a string of `length` bytes that also starts anywhere else in the corpus, the same text included.
    Texts are UTF-8 bytes, null is empty; matches never cross texts. Copies of a text are texts of their own, with equal spans.
    Occurrences of one context beyond the two that are merged as bytes are told by two 64-bit hashes, of the anchor and the context.
    """
    ship(docs.sparkSession)
    texts = docs.select(text_key(F.col(text_col)).alias("same"), F.coalesce(text_col, F.lit("")).alias("text"))
    runs = stage_table(find_runs(texts, length, core), "anchors")
    total = runs.count()
    counts = stage_table(runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    often = frequent(counts, total)
    rest = runs.join(often, "anchor", "left_anti").join(counts.join(often, "anchor", "left_anti"), "anchor", "left_semi")
    found = stage_table(runs.join(often, "anchor", "left_semi").unionByName(rest), "runs")
    one = F.struct("same", "place", "first", "last")
    contexts = found.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(one).alias("least"), F.max(one).alias("most"))
    contexts = stage_table(contexts, "contexts")
    pieces = stage_table(cut_contexts(contexts, texts, length, core), "pieces")
    windows = stage_table(merged_windows(pieces).select(F.col("a").alias("anchor"), F.col("b").alias("context"), "since", "until"), "windows")
    often = frequent(contexts.select("anchor", "context", "n"), total)
    name = ["anchor", "context"]
    # a context has at most (length - core) / 2 + 1 intervals in each occurrence, so those of frequent contexts are bounded too
    hot = found.join(F.broadcast(windows.join(often, name, "left_semi")), name)
    cold = found.join(often, name, "left_anti").join(windows.join(often, name, "left_anti"), name)
    spans = hot.unionByName(cold).select("same", (F.col("first") + F.col("since")).alias("first"), (F.col("first") + F.col("until")).alias("last")).distinct()
    return spans.groupBy("same").agg(F.collect_list("first").alias("starts"), F.collect_list(F.col("last") + length).alias("ends"))


def with_spans(docs: DataFrame, text_col: str, length: int, core: int) -> DataFrame:
    """docs with _starts and _ends (null without repeats)."""
    spans = stage_table(repeated_spans(docs, text_col, length, core), "spans").withColumnsRenamed({"same": "_same", "starts": "_starts", "ends": "_ends"})
    return docs.withColumn("_same", text_key(F.col(text_col))).join(spans, "_same", "left").drop("_same")


def kept_parts(data: memoryview, starts: list[int] | None, ends: list[int] | None) -> tuple[list[memoryview], int, int]:
    """What stays of data, how many bytes go, and in how many maximal runs."""
    parts, at, gone = [], 0, 0
    runs = intervals(np.array(starts or [], dtype=np.int64), np.array(ends or [], dtype=np.int64))
    for a, b in runs.T.tolist():
        parts.append(data[at:a])
        gone += b - a
        at = b
    parts.append(data[at:])
    return parts, gone, runs.shape[1]


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, core: int = CORE) -> DataFrame:
    """docs with every repeated string of `length` bytes cut out of its texts, wherever it stands; untouched texts stay as they are.

    A character that a cut leaves in part goes too. Nulls stay null. Rows and other columns are as before.
    """

    def make():
        def f(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for text, a, b in zip(*(batch.column(c) for c in (text_col, "_starts", "_ends")), strict=True):
                if not a.is_valid or not text.is_valid:
                    out.append(text.as_py())
                else:
                    parts, _, _ = kept_parts(memoryview(text.as_buffer()), a.as_py(), b.as_py())
                    out.append(b"".join(parts).decode(errors="ignore"))
            return [pa.array(out, pa.string())]

        return f

    return append_columns(with_spans(docs, text_col, length, core), {text_col: T.StringType()}, make, drop=["_starts", "_ends"]).select(docs.columns)


def digest_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, core: int = CORE) -> DataFrame:
    """docs with what is left of its text, and with n_bytes (of the input), n_removed, n_spans and kept_sha256.

    A character that a cut leaves in part goes from the text too; the digest is of the remaining bytes. Null, empty and short texts lose nothing. Other columns pass through; those with the results' names are replaced.
    """

    def make():
        def f(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = []
            for text, a, b in zip(*(batch.column(c) for c in (text_col, "_starts", "_ends")), strict=True):
                data = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                parts, gone, runs = kept_parts(data, a.as_py(), b.as_py())
                digest = hashlib.sha256()
                for p in parts:
                    digest.update(p)
                left = b"".join(parts).decode(errors="ignore") if text.is_valid else None
                rows.append((left, len(data), gone, runs, digest.hexdigest()))
            return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]

        return f

    columns = {text_col: T.StringType(), "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType()}
    return append_columns(with_spans(docs, text_col, length, core), columns, make, drop=["_starts", "_ends"])


def op4(docs: DataFrame) -> DataFrame:
    """The digest query: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and text, what is left of it."""
    found = digest_repeats(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")
