"""Selection of files and gates on file and repository size.

Input: ``files(repo_id, rel_path, size_bytes, content)``.  None of these operators
touches ``content``, so a parquet scan below them reads it only if asked to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift import settings
from codesift.functions import text
from codesift.operators.membership import without


def in_excluded_dir(rel_path: Column, excluded: list[str] | None = None) -> Column:
    """Whether a directory part of the path, at any depth, is on the list."""
    excluded = settings.EXCLUDED_DIRS if excluded is None else excluded
    parts = F.split(rel_path, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.arrays_overlap(dirs, F.array(*[F.lit(name) for name in excluded]).cast("array<string>"))


def prune_excluded(files: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    return files.where(~in_excluded_dir(F.col("rel_path"), excluded))


def is_python(rel_path: Column, allowed: list[str] | None = None) -> Column:
    """Whether a path ends in ``.py`` and in one of the allowed extensions."""
    allowed = settings.ALLOWED_EXTENSIONS if allowed is None else allowed
    keep = F.lit(False)
    for extension in allowed:
        keep = keep | rel_path.endswith(extension)
    return rel_path.endswith(".py") & keep


def python_files(files: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    return files.where(is_python(F.col("rel_path"), allowed))


def total_files(files: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """Files per repository after pruning, of any extension."""
    return prune_excluded(files, excluded).groupBy("repo_id").agg(F.count("*").alias("total_files"))


def repo_sizes(files: DataFrame) -> DataFrame:
    """Size in MB over all files, excluded directories included."""
    return files.groupBy("repo_id").agg(
        (F.coalesce(F.sum("size_bytes"), F.lit(0)) / F.lit(1048576.0)).alias("size_mb")
    )


def oversize_message(size_mb: Column, max_mb: float = settings.MAX_REPO_SIZE_MB) -> Column:
    return F.concat(F.lit("Repository size ("), text.one_decimal(size_mb), F.lit(f"MB) exceeds limit ({max_mb}MB)"))


def oversized_repos(files: DataFrame, max_mb: float = settings.MAX_REPO_SIZE_MB) -> DataFrame:
    """Rejected repositories with the message that says why."""
    return repo_sizes(files).where(F.col("size_mb") > max_mb).withColumn("error", oversize_message(F.col("size_mb"), max_mb))


def accepted_files(files: DataFrame, max_mb: float = settings.MAX_REPO_SIZE_MB) -> DataFrame:
    """Files of the repositories within the size limit.

    Whatever the number of rejected repositories, the text stays where it is
    (``membership``).
    """
    return without(files, oversized_repos(files, max_mb), "repo_id")


def analyzable(files: DataFrame, max_kb: float = settings.MAX_FILE_SIZE_KB) -> DataFrame:
    return files.where(F.col("size_bytes") / 1024 <= max_kb)


def skipped_large(files: DataFrame, max_kb: float = settings.MAX_FILE_SIZE_KB) -> DataFrame:
    """Files over the limit with the warning text."""
    size_kb = F.col("size_bytes") / 1024
    warning = F.concat(
        F.lit("Skipping large file: "), F.col("rel_path"), F.lit(" ("), text.one_decimal(size_kb), F.lit("KB)")
    )
    return files.where(size_kb > max_kb).select("repo_id", "rel_path", "size_bytes", warning.alias("warning"))


def not_blank(files: DataFrame) -> DataFrame:
    return files.where(~text.is_blank(F.col("content")))
