"""Exact top-k search by block-at-a-time pruning.

Vectors become integers; a dimension plays the part of a term. Candidates are dealt to ranges, each ordered so that like vectors
are neighbours and cut into small blocks, for which the largest and smallest value of every dimension are kept. For a query
the sum of its term maxima bounds the scores in a block. Blocks are scored, through their own forward rows, from the greatest
bound down, until the bound falls below the k-th best score so far. Ranges and query chunks form tiles; the best of each
tile are merged by a window over the query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import ship

BLOCK = 64


def usable(vec: Column) -> Column:
    """Not null, not empty, and all components present and finite."""
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one Arrow list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def integers(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as double, whose products and sums are exact while they stay below 2**53."""
    return np.floor(scale * vectors.astype(np.float64))


def arranged(rows: np.ndarray, block: int) -> np.ndarray:
    """An order in which blocks of neighbours have tight maxima: nearest of evenly picked pivots, then closeness to it."""
    n = len(rows)
    pivots = rows[:: max(1, n // max(1, n // block))]
    near = rows @ pivots.T / np.maximum(1, np.linalg.norm(pivots, axis=1))
    own = near.argmax(axis=1)
    return np.lexsort((-near[np.arange(n), own], own))


def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The ids and scores of each query's k best rows whose id is not its own, ties to the smaller id; -inf where there are fewer."""
    order = arranged(rows, block)
    ids, rows = ids[order], rows[order]
    cuts = np.arange(0, len(rows), block)
    high, low = np.maximum.reduceat(rows, cuts), np.minimum.reduceat(rows, cuts)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    best = np.full((len(queries), k), -np.inf)
    step = max(1, (1 << 24) // max(1, len(cuts)))
    for s in range(0, len(queries), step):
        q, own = queries[s : s + step], query_ids[s : s + step]
        bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        turn = np.argsort(-bound, axis=1, kind="stable")
        active = np.arange(len(q))
        top, top_id = best[s : s + step], best_id[s : s + step]
        for r in range(len(cuts)):
            at = turn[active, r]
            # a block that only reaches the k-th score may still hold a smaller id
            go = bound[active, at] >= top[active, -1]
            active, at = active[go], at[go]
            if not len(active):
                break
            for b in np.unique(at):
                who = active[at == b]
                a, e = cuts[b], min(cuts[b] + block, len(rows))
                score = q[who] @ rows[a:e].T
                score[own[who][:, None] == ids[None, a:e]] = -np.inf
                both = np.concatenate((top[who], score), axis=1)
                both_id = np.concatenate((top_id[who], np.broadcast_to(ids[a:e], score.shape)), axis=1)
                first = np.lexsort((both_id, -both), axis=1)[:, :k]
                top[who], top_id[who] = np.take_along_axis(both, first, 1), np.take_along_axis(both_id, first, 1)
    return best_id, best


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: float = 256.0,
    rows_a_range: int = 8192,
    queries_a_chunk: int = 4096,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest inner products of floor(scale x) vectors for each query row, exactly.

    Every usable row is a candidate but for rows with the query's own id; ties go to the smaller id. Fewer than k rows give all
    there are. Null vectors, and those with null or non-finite components, take no part; nor do rows with a null id, which
    can't be named. Vectors of different lengths have no product and aren't compared. A query row that is repeated exactly is
    answered once; repeated candidates are listed each. Every row is dealt to a range by a hash of its id, every query to a
    chunk, and a task holds one range and one chunk: memory is bounded by the two parameters, whatever the table's size.
    """
    ship(vectors.sparkSession)
    used = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.size(vec_col).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    n, asking = used.agg(F.count("*"), F.count_if("asks")).first()
    spread = 4 * vectors.sparkSession.sparkContext.defaultParallelism
    ranges = max(1, math.ceil(n / rows_a_range), min(spread, n // 512))
    chunks = max(1, math.ceil(asking / queries_a_chunk))
    part = F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 40))
    rows = used.select("id", "vec", "dim", (part % ranges).cast("int").alias("range"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    asks = used.where("asks").dropDuplicates(["id", "vec"])
    asks = asks.select(
        "id", "vec", "dim", F.xxhash64("vec").alias("print"), F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("range"), (part % chunks).cast("int").alias("chunk")
    )
    schema = "query_id long, print long, vec_id long, score double"

    def tile(left, right):
        out = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            ids, query_ids, prints = (t.column(c).to_numpy() for t, c in ((left, "id"), (right, "id"), (right, "print")))
            x, q = (integers(matrix(t.column("vec").combine_chunks()), scale) for t in (left, right))
            found, score = search(ids, x, query_ids, q, k)
            i, j = np.nonzero(score > -np.inf)
            out = [query_ids[i], prints[i], found[i, j], score[i, j]]
        return pa.table(out, names=["query_id", "print", "vec_id", "score"])

    keys = ["range", "chunk", "dim"]
    found = rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(tile, schema)
    place = F.row_number().over(Window.partitionBy("query_id", "print").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def op9(embeddings: DataFrame) -> DataFrame:
    """The digest query: rows whose vec_id is divisible by 50 against all rows; query_id, rank, vec_id, score."""
    return top_k(embeddings.select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


SQL = """
WITH used AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM used q JOIN used c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
