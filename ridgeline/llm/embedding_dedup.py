"""Embedding near-duplicates by int8 tile products.

Equal vectors are first folded into one with a count. The others are normed and quantised to eight bits with a scale of their own;
the norm of what quantisation lost is kept for each vector, so that x.y is within |X| e(y) + e(x) |Y| + e(x) e(y) of the
product of the quantised X.Y, rigorously. Blocks of vectors meet in tiles, whose integer products are exact in single
precision; only pairs that could reach the threshold under the bound are computed again in double precision. A tile
returns sums of links and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import components, ship, stage_table
from ridgeline.llm.topk_search import matrix, usable

STRIP = 1024


class Quantised:
    """Unit vectors as int8 codes with scales and error norms."""

    def __init__(self, vectors: np.ndarray):
        x = vectors.astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.scale = np.abs(self.unit).max(axis=1) / 127
        self.codes = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        back = self.codes * self.scale[:, None]
        # the slack covers rounding in the norms themselves
        self.error = np.linalg.norm(self.unit - back, axis=1) + 1e-12
        self.size = np.linalg.norm(back, axis=1) + 1e-12
        # integer products are exact in single precision while their sum stays below 2**24
        self.real = self.codes.astype(np.float32 if 127 * 127 * x.shape[1] < 1 << 24 else np.float64)


def close_pairs(a: Quantised, b: Quantised, at: int, rows: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows at.. of a and all of b with cosine >= threshold."""
    e = min(at + rows, len(a.real))
    worst = a.size[at:e] * b.error.max() + a.error[at:e] * (b.size.max() + b.error.max())
    need = (threshold - worst) / (a.scale[at:e] * b.scale.max())
    dot = a.real[at:e] @ b.real.T
    # where the bound leaves nothing to rule out by scale, need is negative and the smaller scale counts
    need = np.where(need < 0, (threshold - worst) / (a.scale[at:e] * b.scale.min()), need)
    i, j = np.nonzero(dot >= np.floor(need)[:, None])
    bound = a.size[at + i] * b.error[j] + a.error[at + i] * (b.size[j] + b.error[j])
    near = dot[i, j] * a.scale[at + i] * b.scale[j] + bound >= threshold
    i, j = at + i[near], j[near]
    sure = np.empty(len(i), dtype=bool)
    for k in range(0, len(i), 1 << 16):
        sure[k : k + (1 << 16)] = np.einsum("ij,ij->i", a.unit[i[k : k + (1 << 16)]], b.unit[j[k : k + (1 << 16)]]) >= threshold
    return i[sure], j[sure]


class Forest:
    """Least labels of what has been linked in one tile."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            low = np.minimum(a, b)
            if (a == b).all():
                return
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label[:] = label[label]


def tile_links(key: np.ndarray, copies: np.ndarray, vectors: np.ndarray, block: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row (copies of its partners), and the row of the least key that it is linked to, over one tile.

    block: which of the tile's one or two blocks a row is in; with two, only pairs across them belong to this tile.
    """
    order = np.lexsort((key[:, 1], key[:, 0]))
    parts = [order[block[order] == b] for b in np.unique(block)]
    links, forest = np.zeros(len(key), dtype=np.int64), Forest(len(key))
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = np.arange(len(key))
    first, last = parts[0], parts[-1]
    a = Quantised(vectors[first])
    b = a if len(parts) == 1 else Quantised(vectors[last])
    for at in range(0, len(first), STRIP):
        i, j = close_pairs(a, b, at, STRIP, threshold)
        if len(parts) == 1:
            i, j = i[i < j], j[i < j]
        if len(i):
            i, j = first[i], last[j]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            forest.link(rank[i], rank[j])
    return links, order[forest.label[rank]]


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, rows_a_block: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row: links with cosine >= threshold, and the components they form.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; nor do vectors of different
    lengths. Equal vectors link with each other and share their links, without being paired. component_id is the smallest id
    reachable. Repeated rows count as vectors of their own. Other columns are ignored. Blocks are dealt by a hash, so no vector or
    group of them lands in one task; a task holds two blocks.
    """
    spark = vectors.sparkSession
    ship(spark)
    all_rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    fit = usable(F.col("vec")) & F.exists("vec", lambda x: x != 0)
    folded = all_rows.where(fit).groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    folded = stage_table(folded.withColumn("print", F.xxhash64("vec")).withColumn("dim", F.size("vec")), "vectors")
    n = folded.count()
    blocks = max(1, math.ceil(n / rows_a_block), min(int(math.sqrt(4 * spark.sparkContext.defaultParallelism)), n // 512))
    own = F.pmod("print", F.lit(blocks)).cast("int")
    met = folded.select("id", "print", "copies", "vec", "dim", own.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    met = met.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    schema = "id long, print long, links long, to_id long, to_print long"

    def tile(key, group):
        group = group.combine_chunks()
        low, high = key[0].as_py(), key[1].as_py()
        block = group.column("block").to_numpy()
        names = ["id", "print", "links", "to_id", "to_print"]
        if low != high and len(np.unique(block)) < 2:
            return pa.table([np.empty(0, np.int64)] * 5, names=names)
        ids = np.stack([group.column("id").fill_null(np.iinfo(np.int64).max).to_numpy(), group.column("print").to_numpy()], axis=1)
        links, to = tile_links(ids, group.column("copies").to_numpy(), matrix(group.column("vec").combine_chunks()), block, threshold)
        at = np.flatnonzero(links)
        return pa.table([ids[at, 0], ids[at, 1], links[at], ids[to[at], 0], ids[to[at], 1]], names=names)

    found = stage_table(met.groupBy("low", "high", "dim").applyInArrow(tile, schema), "links")
    links = found.groupBy("id", "print").agg(F.sum("links").alias("links"))
    edges = found.select(F.struct("id", "print").alias("a"), F.struct(F.col("to_id").alias("id"), F.col("to_print").alias("print")).alias("b"))
    joined = components(edges, "embeddings").select("node.id", "node.print", F.col("component.id").alias("component_id"))
    of_vector = (
        folded.withColumn("own", F.coalesce("id", F.lit(2**63 - 1)))
        .join(links.withColumnRenamed("id", "own"), ["own", "print"], "left")
        .join(joined.withColumnRenamed("id", "own"), ["own", "print"], "left")
        .select("vec", F.col("copies").alias("copies"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    )
    out = all_rows.join(of_vector, "vec", "left")
    component = F.when(F.col("n_links") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept")
    )


def op5(embeddings: DataFrame) -> DataFrame:
    """The digest query: vec_id, n_links, component_id, kept."""
    return near_duplicates(embeddings.select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE used AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM used a JOIN used b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON vec_id = node LEFT JOIN n ON vec_id = a
"""
