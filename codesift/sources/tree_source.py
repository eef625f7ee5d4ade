"""Source trees as a Spark data source, ``spark.read.format("source_tree")``.

``load(root)`` has a row per file below ``root/<repo_id>``: repo_id, rel_path, size_bytes
and, with the option ``contents``, raw and read_error.  One scan lists the whole tree:
the driver opens directories, level by level, only until there are as many as the option
``partitions`` asks for; each of these, with all below it, is walked by a task.  Names in
the option ``excluded`` (separated by commas) are never listed.  Filters on repo_id, on
rel_path and on size_bytes are used while walking, so that directories outside a path
prefix are not listed and files that do not pass are not opened.

The root must be mounted on the driver and all executors.  A directory that cannot be
read has no rows; links to directories are not entered; files are as in ``sources.tree``.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith,
)

from codesift.sources.tree import _entries

PARTITIONS = 256
_FILTERS = "spark.sql.python.filterPushdown.enabled"
_TESTS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, StringStartsWith: str.startswith, StringEndsWith: str.endswith,
    LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
}


@dataclass
class Folder(InputPartition):
    """A directory of a repository, and whether a task walks all below it or only reads its own files."""

    repo: str
    path: str
    deep: bool


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.contents = options.get("contents", "false").lower() == "true"
        self.excluded = {name for name in options.get("excluded", "").split(",") if name}
        self.wanted = int(options.get("partitions", PARTITIONS))
        self.filters: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _TESTS and column in ("repo_id", "rel_path", "size_bytes"):
                self.filters.append((column, type(f), f.value))
            else:
                yield f

    def _passes(self, column: str, value: object) -> bool:
        return all(_TESTS[kind](value, other) for name, kind, other in self.filters if name == column)

    def _may_hold(self, folder: str) -> bool:
        """Whether a directory may hold a path that the filters ask for."""
        inside = f"{folder}/" if folder else ""
        for name, kind, other in self.filters:
            if name == "rel_path" and kind in (EqualTo, StringStartsWith):
                if not (other.startswith(inside) or kind is StringStartsWith and inside.startswith(other)):
                    return False
            if name == "rel_path" and kind is In and not any(path.startswith(inside) for path in other):
                return False
        return True

    def _folders(self, repo: str, folder: str) -> Iterator[str]:
        for entry in _entries(self.root, repo, folder):
            if entry["is_dir"] and entry["rel_path"].rsplit("/", 1)[-1] not in self.excluded and self._may_hold(entry["rel_path"]):
                yield entry["rel_path"]

    def _repos(self) -> list[str]:
        """The repositories that the filters name, or else those that are there."""
        named = [{other} if kind is EqualTo else set(other) for name, kind, other in self.filters if name == "repo_id" and kind in (EqualTo, In)]
        if named:
            found = [name for name in set.intersection(*named) if name and "/" not in name and name not in (".", "..") and os.path.isdir(os.path.join(self.root, name))]
        else:
            with os.scandir(self.root) as entries:
                found = [entry.name for entry in entries if entry.is_dir()]
        return sorted(name for name in found if self._passes("repo_id", name))

    def partitions(self) -> list[Folder]:
        flat: list[Folder] = []
        deep = [Folder(repo, "", True) for repo in self._repos()]
        while deep and len(flat) + len(deep) < self.wanted:
            flat += [Folder(f.repo, f.path, False) for f in deep]
            deep = [Folder(f.repo, path, True) for f in deep for path in self._folders(f.repo, f.path)]
        return flat + deep

    def read(self, partition: Folder) -> Iterator[tuple]:
        waiting = [partition.path]
        while waiting:
            for entry in _entries(self.root, partition.repo, waiting.pop()):
                path, size = entry["rel_path"], entry["size_bytes"]
                if entry["is_dir"]:
                    if partition.deep and path.rsplit("/", 1)[-1] not in self.excluded and self._may_hold(path):
                        waiting.append(path)
                elif self._passes("rel_path", path) and self._passes("size_bytes", size):
                    yield (partition.repo, path, size, *(self._content(partition.repo, path) if self.contents else ()))

    def _content(self, repo: str, path: str) -> tuple[bytes | None, str | None]:
        try:
            with open(os.path.join(self.root, repo, path), "rb") as handle:
                return handle.read(), None
        except OSError as error:
            return None, str(error)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        more = ", raw binary, read_error string" if self.options.get("contents", "false").lower() == "true" else ""
        return f"repo_id string, rel_path string, size_bytes bigint{more}"

    def reader(self, schema: object) -> TreeReader:
        return TreeReader(dict(self.options))


def read_tree(spark: SparkSession, root: str, excluded: Iterable[str] = (), contents: bool = False, partitions: int = PARTITIONS) -> DataFrame:
    """The tree below ``root``; filters put on the result reach the walk."""
    spark.dataSource.register(SourceTree)
    spark.conf.set(_FILTERS, "true")
    options = {"excluded": ",".join(excluded), "contents": str(contents).lower(), "partitions": partitions}
    return spark.read.format("source_tree").options(**options).load(root)
