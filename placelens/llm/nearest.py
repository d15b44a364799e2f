"""Approximate nearest neighbours by collision counting over single projections.

PROJECTIONS random lines; each block of vectors holds, for each line, its vectors' projections in sorted order. A query opens a
window of half-width R times W around its own projection on each line; a vector that lies in the windows of THRESHOLD of all
lines or more is verified by its exact distance. Virtual rehashing: where too few vectors have collided, R grows by GROWTH and
the same sorted arrays are read again, until VERIFY of the block and k vectors are verified; the k-th distance found then bounds the
k-th nearest, and the windows open once more to where vectors at that distance collide. No cap: every vector over the threshold is verified.

Blocks are pairs (block of vectors, block of queries) of BLOCK_ROWS and QUERY_ROWS rows, or as many as fill BLOCK_BYTES where vectors are long, dealt by a hash of the row, so memory
is bounded and no key is hot; a vector that occurs very often under many ids is spread over all blocks. Each block returns its k nearest for each query, and a
top-k over blocks ends the search. Vectors that are null, zero, or hold null or non-finite components take no part, nor do
rows without an id; a query is compared to vectors of its own length, under other ids. Ties go to the smaller id. A row that occurs twice is two
candidates and one query; queries of different vectors under one id share its ranks. Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch

PROJECTIONS, THRESHOLD, GROWTH, VERIFY, MARGIN = 32, 0.75, 2.0, 0.005, 1.5
BLOCK_ROWS, QUERY_ROWS, BLOCK_BYTES = 16_384, 16_384, 32 << 20


def usable(v: Column) -> Column:
    x = v.cast("array<double>")
    return v.isNotNull() & (F.size(v) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def search_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, projections: int = PROJECTIONS, threshold: float = THRESHOLD, growth: float = GROWTH, verify: float = VERIFY, margin: float = MARGIN, seed: int = 7):
    """(query, id, distance) arrays: the k nearest found in this block for each query."""
    n, d = x.shape
    lines = np.random.default_rng(seed).standard_normal((d, projections))
    lines /= np.linalg.norm(lines, axis=0)
    px, pq = x @ lines, q @ lines
    order = np.argsort(px, axis=0, kind="stable").astype(np.int32)
    sorted_px = np.take_along_axis(px, order, axis=0)
    need = int(np.ceil(threshold * projections))
    enough = min(n, max(4 * k, int(verify * n)))
    spread = np.sort(np.abs(px - np.median(px, axis=0)), axis=0)[int(0.25 * (n - 1))].mean()
    width = max(spread, 1e-12)
    out = []
    for j in range(len(q)):
        r = 1.0
        while True:
            lo = [np.searchsorted(sorted_px[:, i], pq[j, i] - r * width, "left") for i in range(projections)]
            hi = [np.searchsorted(sorted_px[:, i], pq[j, i] + r * width, "right") for i in range(projections)]
            whole = all(a == 0 and b == n for a, b in zip(lo, hi, strict=True))
            if whole:
                found = np.arange(n)
            else:
                hits = np.bincount(np.concatenate([order[a:b, i] for i, (a, b) in enumerate(zip(lo, hi, strict=True))]), minlength=n)
                found = np.flatnonzero(hits >= need)
            own = found[ids[found] != qids[j]]
            if whole or len(found) >= enough and len(own) >= k:
                dist = np.sqrt(((x[own] - q[j]) ** 2).sum(1))
                # A vector at distance s lies inside on a line if s / sqrt(d) times a normal deviate does: at MARGIN, on 87 % of lines.
                reach = np.partition(dist, k - 1)[k - 1] * margin / (np.sqrt(d) * width) if len(dist) >= k else np.inf
                if whole or reach <= r:
                    best = np.lexsort((ids[own], dist))[:k]
                    out.append((np.full(len(best), qids[j]), ids[own[best]], dist[best]))
                    break
                r = reach  # the k-th found so far bounds the k-th nearest, so one more window is enough
                continue
            r *= growth
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _search(k: int, options: dict):
    def run(left, right):
        import pyarrow as pa

        empty = not left.num_rows or not right.num_rows
        a, b, s = search_block(left["id"].to_numpy(), _matrix(left["v"]), right["id"].to_numpy(), _matrix(right["v"]), k, **options) if not empty else ([], [], [])
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, **options) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k nearest vectors found, by Euclidean distance."""
    scratch = Scratch(vectors.sparkSession)

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vec_col}`")
        return df.where(usable(v) & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim"))

    x, q = clean(vectors), clean(queries).distinct()
    (n, dim), m = x.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1))).first(), q.count()
    fit = max(64, BLOCK_BYTES // (8 * dim))
    block_rows, query_rows = min(block_rows, fit), min(query_rows, fit)
    nb, qb = max(1, -(-n // block_rows)), max(1, -(-m // query_rows))
    xb = x.withColumn("b", F.pmod(F.xxhash64("id", "v"), F.lit(nb)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    qs = q.withColumn("c", F.pmod(F.xxhash64("id", "v"), F.lit(qb)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    found = xb.groupBy("dim", "b", "c").cogroup(qs.groupBy("dim", "b", "c")).applyInArrow(_search(k, options), "query_id long, vec_id long, score double")
    found = scratch.keep(found)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100, against all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 100 = 0"))
