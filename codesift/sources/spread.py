"""Small files with much work a row."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Fewest rows that are worth a task of their own; also the rows of an Arrow batch.
TASK_ROWS = 10_000


def spread(rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Deal the rows of a table read from files over tasks.

    A scan makes its tasks by bytes, and a million short source files may be one of them,
    which the parser or a large table of rules then keeps busy for long.  Tables of few
    rows, and those with tasks enough, stay as they are.  ``rows`` should be a plain read,
    since its rows are counted, which takes no column of it.
    """
    tasks = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // task_rows)
    return rows.repartition(tasks) if tasks > 1 and tasks > rows.rdd.getNumPartitions() else rows
