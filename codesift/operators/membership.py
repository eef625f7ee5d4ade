"""Rows whose key is, or is not, in a list of any size, without moving the rows.

A list that is small enough is broadcast.  A larger one becomes a cascade of Bloom
filters over the keys that occur in the rows: the first filter holds the listed keys, the
second the unlisted keys that the first takes for listed, the third the listed keys that
the second takes for unlisted, and so on.  Each is about a hundredth of the one before
the last, and the first rest that is small enough is broadcast as it is; so the answer is
exact, and wide rows meet broadcasts only.  What is shuffled are keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.operators.joins import BROADCAST_BYTES
from codesift.session import durable

#: Bits of a filter per key, bits set per key, and 64-bit words that are kept as one row.
BITS, PROBES, WORDS = 16, 4, 64
_BLOCK_BYTES = WORDS * 8


def _probe(key: Column, blocks: int, level: int) -> tuple[Column, Column, Column]:
    """Block, word and bits of a key in the filter of a level."""
    place, bits = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    mask = F.lit(0).cast("long")
    for n in range(PROBES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(bits, 6 * n), F.lit(64)).cast("int")))
    word = F.pmod(F.shiftright(bits, 40), F.lit(WORDS)).cast("int")
    return F.pmod(place, F.lit(blocks)), word, mask


def _blocks(count: int, max_bytes: int) -> int:
    """Blocks for so many keys; a filter that would be too large takes more keys wrongly, which the next level tells apart."""
    return max(1, min(math.ceil(count * BITS / (_BLOCK_BYTES * 8)), max_bytes // _BLOCK_BYTES))


def _filter(keys: DataFrame, blocks: int, level: int) -> DataFrame:
    """``(_block, _words)``; a group has WORDS rows at most."""
    block, word, mask = _probe(F.col("_key"), blocks, level)
    words = keys.groupBy(block.alias("_block"), word.alias("_word")).agg(F.bit_or(mask).alias("_bits"))
    held = words.groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_map"))
    none = F.lit(0).cast("long")
    return held.select("_block", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.element_at("_map", w), none)).alias("_words"))


def _passing(rows: DataFrame, held: DataFrame, blocks: int, level: int) -> DataFrame:
    """``rows`` with ``_hit``: whether the filter takes the key for one of its own."""
    block, word, mask = _probe(F.col("_key"), blocks, level)
    there = F.coalesce(F.get("_words", F.col("_word")).bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    probed = rows.withColumns({"_block": block, "_word": word, "_mask": mask}).join(F.broadcast(held), "_block", "left")
    return probed.withColumn("_hit", there).drop("_block", "_word", "_mask", "_words")


def _bytes(keys: DataFrame) -> int:
    return keys.agg(F.sum(F.octet_length(F.col("_key").cast("string")) + F.lit(16))).first()[0] or 0


def listed(rows: DataFrame, keys: DataFrame, key: str, name: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` with the boolean ``name``: whether their ``key`` is in ``keys``.

    A null key is in no list.  ``keys`` may repeat.  The rows are read once, once more for
    their keys if the list is large, and as often as filters of ``max_bytes`` are needed
    for the first level if the list is larger than one filter holds.
    """
    named = F.col(f"`{key}`")
    wanted = durable(keys.select(named.alias("_key")).where("_key IS NOT NULL").distinct())
    rows = rows.withColumn("_key", named)
    if _bytes(wanted) <= max_bytes:
        return _exact(rows, wanted, name)
    slices = max(1, math.ceil(wanted.count() * BITS / 8 / max_bytes))
    present = durable(rows.select("_key").where("_key IS NOT NULL").distinct().join(wanted.withColumn("_in", F.lit(True)), "_key", "left"))
    done = None
    for n in range(slices):
        mine = F.pmod(F.xxhash64("_key", F.lit(-1)), F.lit(slices)) == n
        if n == 0:
            mine = mine | F.col("_key").isNull()
        part = _cascade(rows.where(mine), present.where(mine), name, max_bytes)
        done = part if done is None else done.unionByName(part)
    return done


def _exact(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    held = F.broadcast(keys.select("_key", F.lit(True).alias("_in")))
    return rows.join(held, "_key", "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_key", "_in")


def _cascade(rows: DataFrame, present: DataFrame, name: str, max_bytes: int) -> DataFrame:
    """Levels alternate between listed and unlisted keys; the last is an exact set."""
    ours, theirs = present.where("_in").select("_key"), present.where("_in IS NULL").select("_key")
    # _level counts the filters that a key has passed; the parity of the last one decides.
    rows = rows.withColumn("_level", F.lit(0))
    level = 0
    while _bytes(ours) > max_bytes:
        blocks = _blocks(ours.count(), max_bytes)
        held = durable(_filter(ours, blocks, level))
        rows = _passing(rows, held, blocks, level)
        rows = rows.withColumn("_level", F.when((F.col("_level") == level) & F.col("_hit"), level + 1).otherwise(F.col("_level"))).drop("_hit")
        wrong = durable(_passing(theirs, held, blocks, level).where("_hit").select("_key"))
        ours, theirs = wrong, ours
        level += 1
    rest = F.broadcast(ours.select("_key", F.lit(True).alias("_in")))
    rows = rows.join(rest, "_key", "left")
    passed = F.when((F.col("_level") == level) & F.col("_in").isNotNull(), level + 1).otherwise(F.col("_level"))
    return rows.withColumn(name, passed % 2 == 1).drop("_key", "_in", "_level")


def without(rows: DataFrame, keys: DataFrame, key: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows whose key is not in the list, also those without a key; columns as they were."""
    return listed(rows, keys, key, "_listed", max_bytes).where(~F.col("_listed")).select(*[f"`{c}`" for c in rows.columns])
