"""Input contracts of the stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FILES = "repo_id string, rel_path string, size_bytes bigint, content string"
RESPONSES = "repo_id string, rel_path string, kind string, response string"
COMMITS = "repo_id string, hash string, author string, message string, committed_at timestamp"
COMMIT_FILES = "repo_id string, hash string, rel_path string"
STAGE_EVENTS = "repo_id string, stage string, ord int, ok boolean, error string"


def require(df: DataFrame, ddl: str) -> DataFrame:
    """The table's contract columns, cast to their types; raises if one is missing."""
    wanted = StructType.fromDDL(ddl)
    missing = [field.name for field in wanted if field.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select([F.col(field.name).cast(field.dataType).alias(field.name) for field in wanted])


def stage_inputs(repos: DataFrame, python_files: DataFrame, analyzable: DataFrame) -> DataFrame:
    """Whether each stage may run for a repository.

    Analysis needs at least one Python file; that all of them are too large is no
    violation.  Repositories without files get a row too.
    """
    listed = python_files.groupBy("repo_id").agg(F.count("*").alias("python_files"))
    kept = analyzable.groupBy("repo_id").agg(F.count("*").alias("analyzable_files"))
    return (
        repos.select("repo_id")
        .join(listed, "repo_id", "left")
        .join(kept, "repo_id", "left")
        .select(
            "repo_id",
            F.coalesce("python_files", F.lit(0)).cast("bigint").alias("python_files"),
            F.coalesce("analyzable_files", F.lit(0)).cast("bigint").alias("analyzable_files"),
            (F.coalesce("python_files", F.lit(0)) > 0).alias("analysis_allowed"),
        )
    )
