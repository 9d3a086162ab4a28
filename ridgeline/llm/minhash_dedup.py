"""MinHash near-duplicates with DartMinHash signatures.

Each element of a weighted set owns a region of the plane, as wide as its weight; darts fall on it at hashed places, the same in
every set that holds the element. A dart has a height and a coordinate; a signature keeps the lowest dart of each
coordinate, found by throwing darts up to a height that should leave no coordinate empty, and higher where one is. Sets
agree in a coordinate with the probability of their weighted Jaccard similarity. Signatures are cut into bands; texts that share a band
are candidates and are verified by the exact similarity of their shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import append_columns, components, stage_table
from ridgeline.llm.embedding_dedup import Forest
from ridgeline.llm.words import ODD, mix, shingle_hashes, shingles_of, text_bytes

TO_UNIT = 2.0**-53
#: Members up to which a star's open pairs are listed; larger ones are compared in tiles of two blocks of TILE members.
BLOCK, TILE, WIDTH = 64, 512, 4096
STARS = 3
#: Bytes of rows that are signed at once.
SIGNED = 2 << 20
MASKS = mix(np.arange(1, STARS + 1, dtype=np.uint64) * ODD) >> np.uint64(1)


def step(cell: int, turn: int) -> np.uint64:
    return np.uint64(int(ODD) * ((cell << 32) + 2 * turn + 3) & (1 << 64) - 1)


def throw(elements: np.ndarray, owner: np.ndarray, weights: np.ndarray | None, height: np.ndarray, k: int):
    """All darts below height[owner] that hit the elements' regions: (owner, coordinate, height, print).

    A region's width is cut at 1, 2, 4, ...: the cell [2^c - 1, 2^(c+1) - 1) of an element has darts of its own, at exponential gaps of rate
    2^c, and each dart has a hashed place within the cell; it hits the set if that lies within the element's weight.
    Weights of 1 need the first cell alone.
    """
    out = []
    cells = 1 if weights is None else int(math.log2(float(weights.max(initial=1)))) + 1
    for c in range(cells):
        live = np.arange(len(elements)) if c == 0 else np.flatnonzero(weights > (1 << c) - 1)
        at = np.zeros(len(live))
        turn = 0
        while len(live):
            h = mix(elements[live] + step(c, turn))
            at = at - np.log1p(-(h >> np.uint64(11)).astype(np.float64) * TO_UNIT) / (1 << c)
            below = at < height[owner[live]]
            live, at, h = live[below], at[below], h[below]
            prints = mix(h + ODD)
            hit = slice(None)
            if c:  # the first cell has width 1, and so lies within every weight
                place = (1 << c) - 1 + (mix(h + step(c, -1)) >> np.uint64(11)).astype(np.float64) * TO_UNIT * (1 << c)
                hit = place < weights[live]
            out.append((owner[live][hit], (prints[hit] % np.uint64(k)).astype(np.int64), at[hit], prints[hit]))
            turn += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def signatures(elements: np.ndarray, owner: np.ndarray, sets: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """A row of k dart prints for each set; sets without elements have zeros. owner: the set of each element, ascending."""
    total = np.bincount(owner, weights=weights, minlength=sets)
    out = np.zeros((sets, k), dtype=np.uint64)
    todo = np.flatnonzero(total > 0)
    height = np.zeros(sets)
    height[todo] = (k * math.log(k) + 2 * k) / total[todo]
    while len(todo):
        mine = np.isin(owner, todo) if len(todo) < sets else slice(None)
        who, coordinate, at, prints = throw(elements[mine], owner[mine], None if weights is None else weights[mine], height, k)
        slot = who * k + coordinate
        lowest = np.full(sets * k, np.inf)
        np.minimum.at(lowest, slot, at)
        first = at == lowest[slot]
        out.ravel()[slot[first]] = prints[first]
        filled = (lowest.reshape(sets, k) < np.inf).sum(axis=1)
        todo = todo[filled[todo] < k]
        height[todo] *= 2
    return out


def sign_batch(texts: list[str | None], shingle: int, k: int, bands: int, counted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The band hashes of each text, whether it has words (else there are no bands), and the weight of its shingles together."""
    elements, text_of = shingles_of(texts, shingle)
    out = np.zeros((len(texts), bands), dtype=np.int64)
    rows, owner = np.unique(text_of, return_inverse=True)
    has, size = np.zeros(len(texts), dtype=bool), np.bincount(text_of, minlength=len(texts))
    if len(rows):
        weights = None
        if counted:
            order = np.lexsort((elements, owner))
            elements, owner = elements[order], owner[order]
            first = np.flatnonzero(np.concatenate(([True], (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1]))))
            weights = np.diff(np.append(first, len(elements))).astype(np.float64)
            elements, owner = elements[first], owner[first]
        # a repeated element throws the same darts again, so sets need no distinct step
        s = signatures(elements, owner, len(rows), k, weights)
        band = np.zeros((len(rows), bands), dtype=np.uint64)
        for j in range(k // bands):
            band = mix(band * ODD + s[:, j * bands : (j + 1) * bands])
        out[rows] = band.view(np.int64)
        has[rows] = True
    return out, has, size if counted else distinct_sizes(elements, owner, rows, len(texts))


def distinct_sizes(elements: np.ndarray, owner: np.ndarray, rows: np.ndarray, texts: int) -> np.ndarray:
    """How many different elements each text has; owner: the place of the text in rows."""
    order = np.lexsort((elements, owner))
    elements, owner = elements[order], owner[order]
    new = np.concatenate((np.ones(min(1, len(owner)), bool), (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1])))
    return np.bincount(rows[owner[new]], minlength=texts)


def exact_similarity(a: np.ndarray, b: np.ndarray, counted: bool) -> float:
    """Jaccard similarity of two arrays of shingle hashes, as sets or as counts."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not counted:
        return len(i) / (len(x) + len(y) - len(i))
    low = int(np.minimum(n[i], m[j]).sum())
    return low / (int(n.sum()) + int(m.sum()) - low)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, counted: bool) -> DataFrame:
    """(a, b, similarity) for pairs of texts (columns node, text).

    A text in very many pairs is one key of the first join, whose pairs, two digests each, Spark's adaptive execution splits.
    """
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")

    def make():
        def f(batch: pa.RecordBatch) -> list[pa.Array]:
            memo: dict[str, np.ndarray] = {}

            def of(t: str) -> np.ndarray:
                if t not in memo:
                    memo[t] = shingle_hashes(text_bytes(t), shingle)
                return memo[t]

            sides = zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)
            return [pa.array([exact_similarity(of(x), of(y), counted) for x, y in sides], pa.float64())]

        return f

    return append_columns(both.select("a", "b", "left", "right"), {"similarity": T.DoubleType()}, make, drop=["left", "right"])


def compared(pairs: DataFrame, known: DataFrame | None, texts: DataFrame, shingle: int, counted: bool) -> DataFrame:
    """known with the similarities of those of the pairs that it lacks, as a stored table."""
    fresh = pairs.distinct()
    if known is not None:
        fresh = fresh.join(known.select("a", "b"), ["a", "b"], "left_anti")
    found = verified(fresh, texts, shingle, counted)
    return stage_table(found if known is None else known.union(found), "measured")


def element_sets(texts: DataFrame, shingle: int, counted: bool) -> DataFrame:
    """(node, elements): the distinct shingles of each text, with weighting by count each occurrence as an element of its own."""

    def make():
        def elements(t: str) -> np.ndarray:
            h = np.sort(shingle_hashes(text_bytes(t), shingle))
            if counted and len(h):
                first = np.searchsorted(h, h)
                return mix(h + (np.arange(len(h)) - first).astype(np.uint64) * ODD).view(np.int64)
            return np.unique(h).view(np.int64)

        return lambda batch: [pa.array([elements(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))]

    return append_columns(texts.select("node", "text"), {"elements": T.ArrayType(T.LongType())}, make, drop=["text"])


def overlaps(sets: list[np.ndarray], asking: np.ndarray) -> np.ndarray:
    """How many elements each asking set shares with each set."""
    lens = np.array([len(x) for x in sets])
    _, element, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), lens)
    shared = counts[element] > 1  # an element of one set alone is in no intersection
    order = np.argsort(element[shared], kind="stable")
    element, owner = element[shared][order], owner[shared][order]
    out = np.zeros((len(asking), len(sets)))
    new = np.concatenate(([0], np.cumsum(np.diff(element) != 0))) if len(element) else element
    for k in range(0, int(new[-1]) + 1 if len(new) else 0, WIDTH):
        a, b = np.searchsorted(new, (k, k + WIDTH))
        there = np.zeros((len(sets), WIDTH), dtype=np.float32)
        there[owner[a:b], new[a:b] - k] = 1
        out += there[asking] @ there.T
    return out


def tile_links(members: DataFrame, texts: DataFrame, threshold: float, shingle: int, counted: bool) -> DataFrame:
    """(a, b): links across components around large stars, by tiles of a star's members and of those that ask.

    Members that ask, those outside a star's largest component, are compared exactly with members of other components. Similar texts
    are of similar size, and of similar distance to the star's first text; so members lie in cells by both, and those that ask
    visit the cells around their own, found once for a cell. Cells that nobody visits are never dealt. A tile returns for each text one link to the
    least text that it is connected with there, never its pairs. A text is a member of a star once, however many buckets they share.
    """
    reach = 1 - threshold + 1e-9
    cell = F.struct(F.floor(F.log("elements_n") / -math.log(threshold)).alias("size"), F.floor(F.col("distance") / reach).alias("ring"))
    held = members.select("first", "node", "label", "asks", cell.alias("cell"))
    key = ["first", "cell"]
    sizes = stage_table(held.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("asks").alias("asking")), "sizes")
    # cells look for their neighbours, not their members: what is listed is at most nine rows a cell, whatever it holds
    near = F.array(*(F.struct((F.col("cell.size") + i).alias("size"), (F.col("cell.ring") + j).alias("ring")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    visits = sizes.where("asking > 0").select("first", F.col("cell").alias("home"), "asking", F.explode(near).alias("cell")).join(sizes.select(*key, "n"), key)
    parts = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    cells = visits.groupBy(*key, "n").agg(F.sum("asking").alias("visitors"), F.collect_list("home").alias("homes"))
    cells = stage_table(cells.select(*key, parts("n").alias("rows"), parts("visitors").alias("columns"), "homes"), "cells")
    # the elements are joined once for each member, before members and visitors are dealt to tiles
    sets = element_sets(texts.join(members.select("node").distinct(), "node", "left_semi"), shingle, counted)
    held = held.join(sets, "node")
    dealt = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    all_of = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    own = held.join(cells, key).select(*key, "node", "label", "elements", F.lit(False).alias("asks"), dealt("rows").alias("row"), all_of("columns").alias("column"))
    homes = cells.select("first", "cell", "rows", "columns", F.explode("homes").alias("home"))
    guests = held.where("asks").withColumnRenamed("cell", "home").join(homes, ["first", "home"])
    guests = guests.select(*key, "node", "label", "elements", F.lit(True).alias("asks"), dealt("columns").alias("column"), all_of("rows").alias("row"))
    met = own.unionByName(guests).select("first", F.col("cell.size").alias("size"), F.col("cell.ring").alias("ring"), "row", "column", "node", "label", "asks", "elements")

    def tile(group):
        group = group.combine_chunks()
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        asking, asked = np.flatnonzero(asks), np.flatnonzero(~asks)
        found = group.column("elements").combine_chunks()
        flat, ends = found.flatten().to_numpy(), np.concatenate(([0], np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False))))
        own = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        n = np.diff(ends)
        forest = Forest(len(own))
        if len(asking) and len(asked):
            shared = overlaps(own, asking)[:, asked]
            near = shared / (n[asking][:, None] + n[asked][None, :] - shared) >= threshold
            label = group.column("label").to_numpy()
            i, j = np.nonzero(near & (label[asking][:, None] != label[asked][None, :]))
            forest.link(asking[i], asked[j])
        moved = np.flatnonzero(forest.label != np.arange(len(own)))
        node = group.column("node")
        return pa.table([node.take(pa.array(moved)), node.take(pa.array(forest.label[moved]))], names=["a", "b"])

    tiles = met.groupBy("first", "size", "ring", "row", "column").applyInArrow(tile, "a long, b long")
    return stage_table(tiles.where("a <> b").distinct(), "tiles")


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def worded(text: Column) -> Column:
    """The text has a word: a character that isn't white space."""
    return F.rlike(F.coalesce(text, F.lit("")), F.lit(r"[^\t-\r\x1c-\x20]"))


def text_classes(
    docs: DataFrame,
    threshold: float = 0.8,
    shingle: int = 5,
    coordinates: int = 96,
    bands: int = 24,
    weighting: str = "count",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(same, class_id, head, n) for each different text that has a word (same: its MD5): its class's smallest id, and the text it stands on.

    n counts the rows with the text. Of texts that stand on one smallest id, the one of least digest is the head; a class without any
    id has a null class_id. See near_duplicates().
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} has to be a whole number, not {docs.schema[id_col].dataType.simpleString()}")
    counted = weighting == "count"

    def make():
        def f(batch: pa.RecordBatch) -> list[pa.Array]:
            found, has, size = sign_batch(batch.column("text").to_pylist(), shingle, coordinates, bands, counted)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, bands, dtype=np.int32)), pa.array(found.ravel()))
            return [pa.array([x if y else None for x, y in zip(lists, has.tolist(), strict=True)], pa.list_(pa.int64())), pa.array(size)]

        return f

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("same", text_digest(F.col("text")))
    # darts take some twenty times the bytes of the texts that are signed at once
    signed = append_columns(named, {"bands": T.ArrayType(T.LongType()), "elements_n": T.LongType()}, make, drop=["text"], most=SIGNED).where("bands is not null")
    signed = stage_table(signed, "signatures")
    texts_of = signed.groupBy("same").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("elements_n").alias("elements_n"), F.count("*").alias("n"))
    # different texts are numbered, once, as the table is stored: shorter than digests, and sums by numbers need no sorting
    unique = stage_table(texts_of.withColumn("node", F.monotonically_increasing_id()), "texts")
    several = signed.groupBy("id").agg(F.min("same").alias("least"), F.max("same").alias("most")).where("id is not null and least <> most")
    number = unique.select("same", "node")
    one_id = signed.join(several, "id").select("same", "least").where("same <> least").distinct()
    one_id = one_id.join(number.withColumnRenamed("node", "a"), "same").join(number.select(F.col("same").alias("least"), F.col("node").alias("b")), "least").select("a", "b")
    bucketed = unique.select("node", "elements_n", F.posexplode("bands").alias("band", "hash"))
    # a bucket's first text is the least under a mask of its band's, so that a group that shares many bands is compared with STARS texts
    mask = F.element_at(F.array(*(F.lit(int(x)) for x in MASKS)), (F.col("band") % STARS + 1).cast("int"))
    shared = bucketed.groupBy("band", "hash").agg(F.count("*").alias("n"), F.min(F.col("node").bitwiseXOR(mask)).alias("first")).where("n > 1")
    shared = shared.select("band", "hash", F.col("first").bitwiseXOR(mask).alias("first"))
    members = stage_table(bucketed.join(shared, ["band", "hash"]).select("band", "hash", "node", "elements_n", "first"), "buckets")
    involved = members.select("node").distinct()
    # one of each text's copies: they meet in each task before they are dealt
    folded = named.where("text is not null").groupBy("same").agg(F.first("text").alias("text"))
    texts = stage_table(folded.join(number.join(involved, "node", "left_semi"), "same").select("node", "text"), "candidates")
    reach = 1 - threshold + 1e-9
    stars = members.select(F.col("first").alias("a"), F.col("node").alias("b")).where("a <> b")
    known = compared(stars, None, texts, shingle, counted)
    measured = known.select(F.col("a").alias("first"), F.col("b").alias("node"), (1 - F.col("similarity")).alias("distance"))
    # texts that share several buckets share their star: from here on each is its member once
    members = members.select("first", "node", "elements_n").distinct().join(measured, ["first", "node"], "left").withColumn("distance", F.coalesce("distance", F.lit(0.0)))
    linked = known.where(F.col("similarity") >= threshold).select("a", "b")
    labels = components(linked, "near").withColumnRenamed("component", "label")
    named_members = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = named_members.groupBy("first", "label").agg(F.count("*").alias("n"))
    split = groups.groupBy("first").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.sum("n").alias("size"), F.count("*").alias("groups")).where("groups > 1")
    mixed = named_members.join(split.drop("groups"), "first").withColumn("asks", F.col("label") != F.col("major")).drop("major")
    mixed = stage_table(mixed, "stars")
    few, many = mixed.where(F.col("size") <= BLOCK), mixed.where(F.col("size") > BLOCK)
    other = few.select("first", F.col("node").alias("other"), F.col("label").alias("of"), F.col("distance").alias("far"))
    open_ = few.where("asks").join(other, "first").where((F.col("label") != F.col("of")) & (F.abs(F.col("distance") - F.col("far")) <= reach))
    known = compared(open_.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")), known, texts, shingle, counted)
    tiles = tile_links(many, texts, threshold, shingle, counted)
    links = known.where(F.col("similarity") >= threshold).select("a", "b").union(tiles).union(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))).union(one_id)
    labels = components(links, "near")
    of_text = stage_table(unique.join(labels, "node", "left").select("same", "id", "n", F.coalesce("component", "node").alias("component")), "classes")
    best = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "same")).alias("best")
    return of_text.join(of_text.groupBy("component").agg(best), "component").select("same", F.col("best.id").alias("class_id"), F.col("best.same").alias("head"), "n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, class_id, kept) for every row: groups connected by similarity >= threshold, named by their smallest id.

    Options and their defaults are those of text_classes(). Similarity is the Jaccard similarity of word shingles (words are split at
    white space, A-Z in lower case), weighted by how often they occur, or as sets with weighting "set". A text of fewer words than a
    shingle is one shingle. Equal texts are one class without being compared. Texts that are null or have no word are in no group but
    their own row's. kept marks the rows whose id is their class's name. An id that stands on different texts joins their
    classes; rows without an id belong to the class of their text, which is named by other rows' ids, or null. Other columns are ignored.

    With 24 bands of 4 a pair at 0.8 shares a band but for a chance of 3e-6. In a bucket all texts are compared with its first one
    (a star, not all pairs; STARS different ones over the bands), which joins most of a bucket into one component. Where a star's buckets together still hold several, the texts
    outside the largest component are compared with the texts of other components: around small stars as pairs, those only that the
    triangle inequality leaves open, around large ones in tiles. So no link between components of a bucket is lost, hot
    groups are split, and no large bucket's pairs are listed. Only counts reach the driver. Ids are whole numbers of up to 64 bits; others are a TypeError.
    """
    classes = stage_table(text_classes(docs, id_col=id_col, text_col=text_col, **options), "classes")
    own = docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("same"))
    # texts on more than a thousandth of the rows are fewer than a thousand
    often = F.broadcast(classes.where(F.col("n") > max(1.0, docs.count() / 1000)))
    cold = own.join(often, "same", "left_anti").join(classes, "same", "left")
    out = own.join(often, "same").unionByName(cold)
    name = F.when(F.col("head").isNotNull(), F.col("class_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), name.alias("class_id"), F.col("id").eqNullSafe(name).alias("kept"))


def op10(docs: DataFrame) -> DataFrame:
    """The digest query: doc_id, class_id (smallest doc_id of the class), kept."""
    return near_duplicates(docs.select("doc_id", "text"))
