"""Numbering rows within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.operators.joins import shuffle_partitions, sized_join
from codesift.session import durable


def number_within(df: DataFrame, group: str, order: list[Column], name: str, keep: list[str] | None = None) -> DataFrame:
    """1-based position of every row within its group, without one task per group.

    Rows are range-partitioned and sorted by group and order, so a large group spans
    several partitions, and numbered in that order.  What turns a row's number into its
    position is one value per partition and group: its first number there and the rows
    of the group in earlier partitions.  Equal rows share a partition, so ``order``
    should tell rows apart.  It should be of plain columns, since a sort computes
    expressions anew in every comparison; ``keep`` are the columns that stay (None: all).
    """
    keys = [F.col(group).asc(), *order]
    placed = durable(
        df.repartitionByRange(shuffle_partitions(df), *keys)
        .sortWithinPartitions(*keys)
        .select(*(df.columns if keep is None else keep))
        .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    )
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy("_part", group)
        .agg(F.count("*").alias("_rows"), F.min("_row").alias("_first"))
        .select("_part", group, (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    )
    numbered = sized_join(placed, shifts, ["_part", group], "left", ["_row"])
    return numbered.withColumn(name, F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")
