"""Join with a table that has one row per key, by its measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame

from codesift.operators.joins import BROADCAST_BYTES, skew_join
from pyspark.sql import functions as F


def keyed_join(big: DataFrame, small: DataFrame, on: list[str], how: str, width: int, salt_on: list[str], max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``big`` with the kept table ``small``, one row of at most ``width`` bytes per key.

    ``small`` is broadcast if its counted rows are under ``max_bytes``; else both sides
    are shuffled and hot keys of ``big`` salted.
    """
    if small.count() * width <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    return skew_join(big, small, on, how, salt_on)
