"""Source trees on a file system that all executors mount.

Spark's file sources hide names that start with ``_`` or ``.``, which would lose
``__init__.py``, so directories are listed by tasks: one job per directory level, each
spread over the directories of that level.  Only a count comes back to the driver.
"""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.functions import text
from codesift.session import durable

_ENTRY_DDL = "repo_id string, rel_path string, size_bytes bigint, is_dir boolean"
_ENTRY_ARROW = pa.schema(
    [("repo_id", pa.string()), ("rel_path", pa.string()), ("size_bytes", pa.int64()), ("is_dir", pa.bool_())]
)
ENTRIES_PER_BATCH, BYTES_PER_BATCH = 10_000, 8 << 20


def _entries(root: str, repo: str, folder: str) -> Iterator[dict]:
    """Entries of one directory as a directory walk has them.

    A link to a directory is neither a file nor entered.  A file whose size cannot be told,
    such as a link to nothing, has size 0.
    """
    try:
        with os.scandir(os.path.join(root, repo, folder)) as found:
            for entry in found:
                path = f"{folder}/{entry.name}" if folder else entry.name
                is_dir, size = False, 0
                with contextlib.suppress(OSError):
                    is_dir = entry.is_dir()
                    size = 0 if is_dir else entry.stat().st_size
                if is_dir and entry.is_symlink():
                    continue
                yield {"repo_id": repo, "rel_path": path, "size_bytes": size, "is_dir": is_dir}
    except OSError:
        return


def list_tree(spark: SparkSession, root: str, repos: DataFrame) -> DataFrame:
    """``(repo_id, rel_path, size_bytes)`` of every file below ``root/<repo_id>``."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def list_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repo, folder in zip(*(column.to_pylist() for column in batch.columns)):
                for row in _entries(root, repo, folder):
                    rows.append(row)
                    if len(rows) == ENTRIES_PER_BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ENTRY_ARROW)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=_ENTRY_ARROW)

    folders = repos.select("repo_id", F.lit("").alias("rel_path"))
    levels = []
    while True:
        spread = folders.repartition(parts, "repo_id", "rel_path")
        level = durable(spread.mapInArrow(list_level, _ENTRY_DDL))
        levels.append(level.where(~F.col("is_dir")).drop("is_dir"))
        folders = level.where("is_dir").select("repo_id", "rel_path")
        if folders.isEmpty():
            break
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    return files


def read_contents(files: DataFrame, root: str) -> DataFrame:
    """Add ``content`` as tolerant text, ``strict_utf8`` (whether the bytes were valid) and ``read_error``.

    A file that cannot be read has no content and the reason.  Filter by path and size
    first: only the rows given here are opened.
    """
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ddl = "repo_id string, rel_path string, size_bytes bigint, raw binary, read_error string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*list(_ENTRY_ARROW)[:3], ("raw", pa.binary()), ("read_error", pa.string())])
        for batch in batches:
            rows, size = [], 0
            for row in batch.to_pylist():
                row |= {"raw": None, "read_error": None}
                try:
                    with open(os.path.join(root, row["repo_id"], row["rel_path"]), "rb") as handle:
                        row["raw"] = handle.read()
                except OSError as error:
                    row["read_error"] = str(error)
                rows.append(row)
                size += len(row["raw"] or b"")
                if size >= BYTES_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rows = files.select("repo_id", "rel_path", "size_bytes").repartition(parts, "repo_id", "rel_path")
    return rows.mapInArrow(read, ddl).select(
        "repo_id",
        "rel_path",
        "size_bytes",
        text.decode_utf8(F.col("raw")).alias("content"),
        F.is_valid_utf8(F.col("raw").cast("string")).alias("strict_utf8"),
        "read_error",
    )
