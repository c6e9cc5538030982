"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

A group is all rows of one text and goes to one shard. Groups are hashed into blocks of about
``BLOCK`` groups, however many blocks that makes; each block is differenced in its own task down to one partial partition
(a load for each shard). Blocks are items of the next level, differenced in blocks of ``BLOCK`` in the same way, until
one block holds all: that one reaches the driver, ``BLOCK`` x shards numbers at most.

Nulls count as empty texts; equal texts share a shard; an empty table gives no rows; extra
columns are dropped. Rows that repeat entirely keep one row each. Ties go by the order of digests. Of very long texts only
length and digest are carried. A text with a thousandth of all rows or more meets its shard by broadcast, so that its rows
stay apart.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .scratch import ranked, settle

#: Items in a block, about; rows of a text from which it meets its shard by broadcast, if they are a thousandth of all, too.
BLOCK, OFTEN = 20_000, 1000


def difference(loads: list[list[int]]) -> list[list[int]]:
    """Combine partial partitions, widest spread first, in opposite order.

    ``loads[i][p]`` is the load that item i brings to its part p. Returns for each item the
    shard of each of its parts.
    """
    k = len(loads[0]) if loads else 0
    heap, trees = [], []
    for i, load in enumerate(loads):
        order = sorted(range(k), key=lambda p: -load[p])
        sums = [load[p] for p in order]
        trees.append([(i, p) for p in order])
        heap.append((sums[-1] - sums[0], i, [s - sums[-1] for s in sums]))
    heapq.heapify(heap)
    kids: dict[tuple[int, int], tuple] = {}
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        sums = [x[p] + y[k - 1 - p] for p in range(k)]
        order = sorted(range(k), key=lambda p: -sums[p])
        at = len(trees)
        for p in range(k):
            kids[(-1 - at, p)] = (trees[a][p], trees[b][k - 1 - p])
        trees.append([(-1 - at, p) for p in order])
        trees[a] = trees[b] = []
        low = sums[order[-1]]
        heapq.heappush(heap, (low - sums[order[0]], at, [sums[p] - low for p in order]))
    out = [[0] * k for _ in loads]
    if heap:
        for shard, root in enumerate(trees[heap[0][1]]):
            todo = [root]
            while todo:
                at = todo.pop()
                if at[0] < 0:
                    todo.extend(kids[at])
                else:
                    out[at[0]][at[1]] = shard
    return out


def split(weights: list[int], k: int) -> list[int]:
    """The shard of each single weight."""
    return [row[0] for row in difference([[w] + [0] * (k - 1) for w in weights])]


def _block(shards: int, group: pa.Table) -> pa.Table:
    group = group.sort_by("_text")
    weights = group.column("weight").to_pylist()
    return group.append_column("part", pa.array(np.array(split(weights, shards), np.int32)))


def _level(group: pa.Table) -> pa.Table:
    group = group.sort_by("_block")
    return group.append_column("to", pa.array(difference(group.column("loads").to_pylist()), pa.list_(pa.int32())))


def combined(sums: DataFrame, blocks: int, shards: int) -> DataFrame:
    """(_block, part, shard) for blocks' loads (_block, part, w): by one differencing of all, or of blocks of them and then of those."""
    if blocks <= BLOCK:
        loads = [[0] * shards for _ in range(blocks)]
        for row in sums.collect():
            loads[row["_block"]][row["part"]] = row["w"]
        to = [(b, p, s) for b, row in enumerate(difference(loads)) for p, s in enumerate(row)]
        return F.broadcast(sums.sparkSession.createDataFrame(to, "_block long, part int, shard int"))
    entry = lambda p: F.coalesce(F.sum(F.when(F.col("part") == p, F.col("w"))), F.lit(0))
    items = sums.groupBy("_block").agg(F.array(*map(entry, range(shards))).alias("loads")).withColumn("above", F.floor(F.col("_block") / BLOCK))
    schema = StructType([*items.schema, StructField("to", ArrayType(IntegerType()))])
    turned = settle(items.groupBy("above").applyInArrow(_level, schema).selectExpr("_block", "above", "posexplode(arrays_zip(loads, to)) AS (part, x)").selectExpr("_block", "above", "part", "x.loads AS w", "x.to AS upper"), "levels")
    higher = combined(turned.groupBy(F.col("above").alias("_block"), F.col("upper").alias("part")).agg(F.sum("w").alias("w")), -(-blocks // BLOCK), shards)
    return turned.join(higher.select(F.col("_block").alias("above"), F.col("part").alias("upper"), "shard"), ["above", "upper"]).select("_block", "part", "shard")


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of ``docs``.

    ``size`` is the UTF-8 length plus 1; ``slot`` counts 0, 1, ... inside a shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = settle(
        docs.select(
            F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("_text")
        ),
        "sizes",
    )
    n = rows.count()
    blocks, often = max(1, -(-n // BLOCK)), max(OFTEN, n // 1000)
    groups = rows.groupBy("_text").agg(F.sum("size").alias("weight"), F.count("*").alias("copies")).withColumn("_block", F.pmod(F.xxhash64("_text"), F.lit(blocks)))
    parts = settle(groups.groupBy("_block").applyInArrow(lambda t: _block(shards, t), StructType([*groups.schema, StructField("part", IntegerType())])), "parts")
    where = combined(parts.groupBy("_block", "part").agg(F.sum("weight").alias("w")), blocks, shards)
    shard_of = parts.join(where, ["_block", "part"]).select("_text", "shard", "copies")
    hot = F.broadcast(shard_of.where(F.col("copies") >= often).drop("copies"))
    rest = rows.join(hot, "_text", "left_anti").join(shard_of.where(F.col("copies") < often).drop("copies"), "_text")
    return ranked(rows.join(hot, "_text").unionByName(rest).drop("_text"), "shard", "slot", "sharded")
