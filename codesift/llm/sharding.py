"""Sharding by a tree of weighted hash draws.

A topology is a tree of regions, racks and shards.  A row starts at the root and descends
level by level; at each level every child makes a draw ``-ln(u) / weight``, where ``u``
comes from a hash of the row's key and the child's name, and the smallest draw wins.  A
child's weight is the number of shards below it.  A changed weight or a new child moves
rows only into or out of that child, so movement stays within the subtrees that changed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.session import durable

#: Shards of a rack and racks of a region.
RACK, REGION = 2, 2
#: Rows of one shard that are numbered together.
SLOT_ROWS = 200_000


def topology(shards: int, base: int = 16, rack: int = RACK, region: int = REGION) -> dict[str, dict[str, list[int]]]:
    """Regions, racks and shard numbers.

    The first ``base`` shards fill racks of ``rack`` shards and regions of ``region``
    racks.  Every further shard opens a region of its own, so it takes rows only into
    itself: all other weights stay.
    """
    tree: dict[str, dict[str, list[int]]] = {}
    for shard in range(min(shards, base)):
        k = shard // rack
        tree.setdefault(f"g{k // region}", {}).setdefault(f"k{k}", []).append(shard)
    for shard in range(base, shards):
        tree[f"x{shard}"] = {f"k{shard}": [shard]}
    return tree


def _draw(key: Column, node: str, weight: float) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{node}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(16**13))) / F.lit(float(weight))


def _choose(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw; the first in a tie."""
    if len(children) == 1:
        return children[0][2]
    pairs = [F.struct(_draw(key, name, weight).alias("draw"), F.lit(i).alias("at")) for i, (name, weight, _) in enumerate(children)]
    at = F.least(*pairs)["at"]
    chosen = F.when(at == 0, children[0][2])
    for i, (_, _, value) in enumerate(children[1:], 1):
        chosen = chosen.when(at == i, value)
    return chosen


def shard_of(key: Column, tree: dict[str, dict[str, list[int]]], weights: dict[int, float] | None = None) -> Column:
    """The shard of a key string (null: as an empty key) in a topology; ``weights`` of shards are 1 unless given.

    A shard of weight 0 takes no rows.
    """
    key = F.coalesce(key, F.lit(""))
    weight = {s: 1.0 for racks in tree.values() for shards in racks.values() for s in shards} | (weights or {})
    regions = []
    for region, racks in tree.items():
        inner = []
        for rack, shards in racks.items():
            leaves = [(f"s{s}", weight[s], F.lit(s)) for s in shards if weight[s] > 0]
            if leaves:
                inner.append((rack, sum(x[1] for x in leaves), _choose(key, leaves)))
        if inner:
            regions.append((region, sum(x[1] for x in inner), _choose(key, inner)))
    return _choose(key, regions)


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Place every document of ``docs(doc_id, text)`` into a shard, and number the rows of each shard from 0.

    Result: doc_id, size (UTF-8 bytes + 1; 1 for null), text_crc32 (of the text's bytes;
    null text as empty), law ``key``, shard, slot, grown_shard (with one shard more).
    Rows that repeat a doc_id go to the same shard and get slots of their own; rows
    without doc_id share one key.  Other columns are not read.  Slots follow a hash of
    doc_id: every shard is cut into buckets of a bounded expected size, rows are numbered
    within a bucket, and the counts of the buckets before are added.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.col("doc_id").cast("string")
    placed = durable(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.lit("key").alias("law"),
            shard_of(key, topology(shards, shards)).alias("shard"),
            shard_of(key, topology(shards + 1, shards)).alias("grown_shard"),
        )
    )
    buckets = max(16, math.ceil(placed.count() / shards / SLOT_ROWS))
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_rows"))
        .select("shard", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("_row", F.row_number().over(within))
        .join(starts, ["shard", "_bucket"])
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("_start") + F.col("_row") - 1).cast("long").alias("slot"), "grown_shard")
    )
