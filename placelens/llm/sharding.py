"""Sharding by Karmarkar-Karp differencing of indivisible groups.

A group is all rows of equal text; its size is the sum of its rows' bytes, each plus 1. Differencing: every item starts as a partial partition with its size in
one of the parts; the two partial partitions of largest spread are combined again and again, the largest part of one with the smallest of
the other, until one is left.

Groups are differenced in levels, so that neither a task nor the driver holds them all. Items (at first the groups) are dealt by a hash into sets of about SET_ITEMS. Each set
differences its own small items into BUNDLES bundles: half of them into BUNDLES / STRATA bundles of nearly equal size, a quarter into as many and so on, so that small bundles are
left to even out the last differences. Bundles, and the large items (those above a bundle's mean size, so fewer than bundles), are the next level's items: some 1 / 10 as many. For even shards, BUNDLES is 24 times their number or more: no bundle of the last level is then above a quarter of a shard.
There is one level at least; once DRIVER_ITEMS are left, the driver differences them into the shards. Levels are written before use, so they're the same for all readers.

Null texts have no bytes and so size 1. Rows of equal text stay together. Slots run from 0 without gaps in each shard: rows are
numbered within small blocks, and the blocks' sizes are summed up before them. Rows of equal id are rows as others are.
"""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch

SHARDS, BUNDLES, STRATA, BLOCK_ROWS = 8, 192, 12, 100_000
SET_ITEMS, DRIVER_ITEMS = 4_096, 8_192


def differencing(sizes: list[int], parts: int) -> list[int]:
    """The part of each item."""
    order = count()
    trees: list[tuple | None] = [None] * len(sizes)
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(parts, object if s >= 1 << 62 else np.int64)
        sums[-1] = s
        heap.append((-int(s), next(order), sums, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, _, a, i), (_, _, b, j) = heapq.heappop(heap), heapq.heappop(heap)
        joined = a + b[::-1]  # both ascending: the largest of one meets the smallest of the other
        rank = np.argsort(joined, kind="stable")
        sums = joined[rank]
        sums -= sums[0]
        trees.append((i, j, rank))
        heapq.heappush(heap, (-int(sums[-1]), next(order), sums, len(trees) - 1))
    out = [0] * len(sizes)
    # From the root down: where each part of a node ends up.
    todo = [(heap[0][3], np.arange(parts))] if heap else []
    while todo:
        node, place = todo.pop()
        if trees[node] is None:
            out[node] = int(place[-1])
        else:
            i, j, rank = trees[node]
            at = np.empty(parts, np.int64)
            at[rank] = place
            todo += [(i, at), (j, at[::-1])]
    return out


def _bundle(bundles: int):
    """Adds the bundle of each item of a set."""

    def run(rows):
        import pyarrow as pa

        rows = rows.sort_by([("bytes", "descending"), ("level", "ascending"), ("k1", "ascending"), ("k2", "ascending")])
        sizes = rows["bytes"].to_pylist()
        first, each = rows["set"][0].as_py() * bundles, bundles // STRATA
        place = np.zeros(len(sizes), np.int64)
        for s in range(STRATA):  # half of the items, a quarter, an eighth and so on: bundles of many sizes
            own = np.arange((1 << s) - 1, len(sizes), 2 << s) if s < STRATA - 1 else np.arange((1 << s) - 1, len(sizes), 1 << s)
            place[own] = [first + s * each + p for p in differencing([sizes[i] for i in own], each)]
        return rows.drop_columns(["set"]).append_column("bundle", pa.array(place))

    return run


def parts_of(groups: DataFrame, parts: int, bundles: int = BUNDLES, set_items: int = SET_ITEMS, driver_items: int = DRIVER_ITEMS) -> DataFrame:
    """groups (k1, k2, bytes) with the part of each: k1, k2, shard. A set takes set_items * bundles / STRATA * 8 bytes, the driver driver_items * parts * 8."""
    spark = groups.sparkSession
    scratch = Scratch(spark)
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    items = groups.select(F.lit(0).alias("level"), "k1", "k2", "bytes")
    levels = []
    while not levels or n > driver_items:
        sets = max(1, -(-n // set_items))
        small = F.col("bytes") <= max(1, total // (sets * bundles))
        dealt = items.where(small).withColumn("set", F.pmod(F.xxhash64("k1", "k2", F.lit(len(levels))), F.lit(sets)))
        links = scratch.keep(dealt.groupBy("set").applyInArrow(_bundle(bundles), "level int, k1 long, k2 long, bytes long, bundle long"))
        levels.append(links)
        # A bundle is known by its number and its level.
        made = links.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).select(F.lit(len(levels)).alias("level"), F.col("bundle").alias("k1"), F.lit(0).cast("long").alias("k2"), "bytes")
        items = scratch.keep(made.unionByName(items.where(~small)))
        n = items.count()
    last = items.orderBy(F.desc("bytes"), "level", "k1", "k2").collect()  # driver_items rows at most
    of = differencing([r["bytes"] for r in last], parts)
    placed = spark.createDataFrame([(r["level"], r["k1"], r["k2"], p) for r, p in zip(last, of, strict=True)], "level int, k1 long, k2 long, shard int")
    for level in range(len(levels), 0, -1):  # from the bundles down to what is in them
        bundle = placed.where(F.col("level") == level).select(F.col("k1").alias("bundle"), "shard")
        inside = levels[level - 1].join(F.broadcast(bundle) if level == len(levels) else bundle, "bundle")
        placed = placed.where(F.col("level") < level).unionByName(inside.select("level", "k1", "k2", "shard"))
    return placed.select("k1", "k2", "shard")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, block_rows: int = BLOCK_ROWS, **levels) -> DataFrame:
    """id, size, text_crc32, shard, slot of each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"),
    )
    rows = scratch.keep(rows)
    groups = scratch.keep(rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes")))
    of_group = parts_of(groups, shards, **levels)
    n_blocks = max(1, -(-rows.count() // block_rows))
    sharded = rows.join(of_group, ["k1", "k2"]).withColumn("block", F.pmod(F.xxhash64("id", "k1"), F.lit(n_blocks)).cast("int"))
    sharded = scratch.keep(sharded.withColumn("in_block", F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "k1", "k2", "size")) - 1))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = sharded.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return sharded.join(first, ["shard", "block"]).select("id", "size", "text_crc32", "shard", (F.col("first") + F.col("in_block")).cast("long").alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
