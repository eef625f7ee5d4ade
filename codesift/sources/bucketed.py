"""Files kept as a bucketed table, so that joins by repository do not move their text.

A table bucketed by repository alone would put a repository with a third of all files
into one task.  Files are bucketed by repository and part instead, a part being a hash of
the path: a repository spreads over as many buckets as there are parts, and a small row per
repository is repeated once per part to meet it there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.operators.joins import BROADCAST_BYTES
from codesift.session import durable

PART, PARTS = "part", 32


def write_files(files: DataFrame, name: str, buckets: int, parts: int = PARTS) -> DataFrame:
    """Keep ``files(repo_id, rel_path, ...)`` as the table ``name``, with the column ``part``.

    The one shuffle of the text; rows arrive in their buckets, so there is one file a bucket.
    """
    part = F.pmod(F.xxhash64("rel_path"), F.lit(parts)).cast("int").alias(PART)
    rows = files.select(*[f"`{c}`" for c in files.columns if c != PART], part)
    table = rows.repartition(buckets, "repo_id", PART).write.bucketBy(buckets, "repo_id", PART).sortBy("repo_id", PART)
    table.mode("overwrite").saveAsTable(name)
    return files.sparkSession.table(name)


def join_small(table: DataFrame, small: DataFrame, key: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Left join of a bucketed table with ``small``, one row per ``key``, of any size.

    ``small`` is broadcast if it is small; else it is repeated once per part and shuffled
    into the buckets, and the table is read bucket by bucket.
    """
    small = durable(small)
    measured = small.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + F.lit(16))).first()[0] or 0
    if measured <= max_bytes:
        return table.join(F.broadcast(small), key, "left")
    parts = table.agg(F.max(PART)).first()[0] or 0
    spread = small.withColumn(PART, F.explode(F.sequence(F.lit(0), F.lit(parts))))
    return table.join(spread.hint("shuffle_hash"), [key, PART], "left")
