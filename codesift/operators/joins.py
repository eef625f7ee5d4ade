"""Joins of a large, possibly skewed table with a smaller one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.session import durable

SALTS = 32
BROADCAST_BYTES = 64 << 20


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str, salt_on: list[str], salts: int = SALTS) -> DataFrame:
    """Shuffle join in which every key of ``big`` spreads over ``salts`` tasks.

    ``small`` must have one row per key; it is repeated once per salt, so this is for a
    side that is far smaller than ``big``.
    """
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int"))
    return keyed.join(spread, [*on, "_salt"], how).drop("_salt")


def skew_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str, salt_on: list[str], counts: DataFrame | None = None
) -> DataFrame:
    """Shuffle join in which only the hot keys of ``big`` are salted.

    A key is hot if it has more rows than an even share of one partition, so there are
    fewer hot keys than partitions and the list of them is safe to broadcast.
    ``counts(*on, rows)`` are the rows per key of ``big`` where they are known; they are
    read twice.
    """
    parts = shuffle_partitions(big)
    if counts is None:
        counts = durable(big.groupBy(*on).agg(F.count("*").alias("rows")))
    total = counts.agg(F.sum("rows").alias("total")).first()["total"] or 0
    share = max(total / parts, 1.0)
    hot = F.broadcast(
        counts.where(F.col("rows") > share).select(*on, F.ceil(F.col("rows") / F.lit(share)).cast("int").alias("_salts"))
    )
    salts = F.coalesce("_salts", F.lit(1))
    keyed = (
        big.join(hot, on, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*salt_on), salts).cast("int"))
        .drop("_salts")
    )
    spread = (
        small.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return keyed.join(spread, [*on, "_salt"], how).drop("_salt")


def sized_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str, salt_on: list[str], max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Broadcast ``small`` if its measured size allows it, else ``skew_join``.

    Keeps the wide rows of ``big`` out of a shuffle whenever that is safe.
    """
    small = durable(small)
    measured = small.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + F.lit(16)).alias("bytes")).first()["bytes"] or 0
    if measured <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    return skew_join(big, small, on, how, salt_on)
