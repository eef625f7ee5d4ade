"""Dependencies and metadata read from well-known files at the repository root.

Input: ``files(repo_id, rel_path, content)`` with strictly valid text; files that are
not valid UTF-8 are left out, since they cannot be read as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift import settings
from codesift.functions import text


def dependency_files(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    names = settings.DEPENDENCY_FILES if names is None else names
    return files.where(F.col("rel_path").isin(names))


def _cut(name: Column, operators: list[str]) -> Column:
    """Text before the first of each operator, one operator after the other."""
    for operator in operators:
        name = F.substring_index(name, operator, 1)
    return text.strip(name)


def requirement_names(content: Column) -> Column:
    lines = F.transform(F.split(content, "\n", -1), text.strip)
    kept = F.filter(lines, lambda line: (line != "") & ~line.startswith("#") & ~line.startswith("-"))
    return F.transform(kept, lambda line: _cut(line, ["==", ">=", "<=", ">", "<", "~="]))


def _quoted(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit('"([^"]+)"'), F.lit(1))


def pyproject_names(content: Column) -> Column:
    versioned = F.filter(
        _quoted(content), lambda item: item.contains("==") | item.contains(">=") | item.contains("<=")
    )
    names = F.transform(versioned, lambda item: _cut(item, ["==", ">=", "<="]))
    return F.filter(names, lambda name: ~name.startswith("-"))


def setup_names(content: Column) -> Column:
    listed = F.regexp_extract(content, r"(?sU)install_requires\s*=\s*\[(.*?)\]", 1)
    return F.transform(_quoted(listed), lambda item: _cut(item, ["==", ">=", "<="]))


def _strict(files: DataFrame) -> Column:
    """Whether a file was valid UTF-8 before it was decoded; text of unknown origin speaks for itself."""
    return F.col("strict_utf8") if "strict_utf8" in files.columns else F.is_valid_utf8("content")


def parse_dependencies(files: DataFrame) -> DataFrame:
    """One row per name as written, duplicates kept: ``(repo_id, rel_path, name)``.

    All formats are read in one scan of the selected files.
    """
    path, content = F.col("rel_path"), text.universal_newlines(F.col("content"))
    selected = dependency_files(files).where(_strict(files)).select("repo_id", "rel_path", content.alias("content"))
    names = (
        F.when(path.isin(settings.REQUIREMENTS_FILES), requirement_names(F.col("content")))
        .when(path == "pyproject.toml", pyproject_names(F.col("content")))
        .when(path == "setup.py", setup_names(F.col("content")))
    )
    return selected.select("repo_id", "rel_path", F.explode(names).alias("name")).where("name <> ''")


def distinct_dependencies(files: DataFrame) -> DataFrame:
    """``(repo_id, name)``, one row per distinct name."""
    return parse_dependencies(files).select("repo_id", "name").distinct()


def dependency_context(dependencies: DataFrame, first: int = settings.PROMPT_DEPENDENCIES) -> DataFrame:
    """The first names per repository in code-point order, joined for a prompt.

    The limit is applied before the shuffle as well, so each task sends at most
    ``first`` names per repository.
    """
    by_name = Window.partitionBy("repo_id").orderBy("name")
    return (
        dependencies.withColumn("_n", F.row_number().over(by_name))
        .where(F.col("_n") <= first)
        .groupBy("repo_id")
        .agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
        .select("repo_id", F.concat(F.lit("\n\nRepository dependencies: "), F.col("names")).alias("context"))
    )


def _first_present(files: DataFrame, names: list[str], chars: int, column: str) -> DataFrame:
    priority = F.array_position(F.array(*[F.lit(name) for name in names]), F.col("rel_path"))
    return (
        files.where(F.col("rel_path").isin(names))
        .where(_strict(files))
        .select(
            "repo_id",
            priority.alias("priority"),
            F.left(text.universal_newlines(F.col("content")), F.lit(chars)).alias("content"),
        )
        .groupBy("repo_id")
        .agg(F.min_by("content", "priority").alias(column))
    )


def readme(files: DataFrame, chars: int = settings.README_CHARS) -> DataFrame:
    return _first_present(files, settings.README_FILES, chars, "readme_content")


def licence(files: DataFrame, chars: int = settings.LICENSE_CHARS) -> DataFrame:
    return _first_present(files, settings.LICENSE_FILES, chars, "license_info")
