"""Prompt tables: one row per file and kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift import settings
from codesift.operators.joins import sized_join
from codesift.sources import bucketed

KINDS = ("analysis", "zero_day")
PROMPT_CHARS = settings.CONTEXT_LENGTH * settings.CHARS_PER_TOKEN

# Our own wording; {path}, {context} and {code} are filled in per file.
ANALYSIS_TEMPLATE = """Review this Python file for security weaknesses.

Path: {path}{context}

Source:
{code}

Answer with a JSON array. Each element has the keys vulnerability_type, severity
(critical, high, medium or low), line_number, description, code_snippet,
recommendation, cwe_id and confidence (0.0 to 1.0). Answer [] if there is nothing."""

NOVEL_TEMPLATE = """Look for unusual weaknesses in this Python file that known rules would miss.

Path: {path}

Source:
{code}

Answer with a JSON array. Each element has the keys vulnerability_type, severity,
description, zero_day_likelihood (0.0 to 1.0), exploitation_complexity,
potential_impact and confidence (0.0 to 1.0). Answer [] if there is nothing."""


def fill(template: str, values: dict[str, Column]) -> Column:
    """The template with its ``{name}`` marks replaced by columns."""
    parts, rest = [], template
    while rest:
        marks = [(rest.find("{%s}" % name), name) for name in values if "{%s}" % name in rest]
        if not marks:
            parts.append(F.lit(rest))
            break
        at, name = min(marks)
        parts += [F.lit(rest[:at]), values[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def truncated(content: Column, chars: int = PROMPT_CHARS) -> Column:
    return F.left(content, F.lit(chars))


def with_context(files: DataFrame, contexts: DataFrame) -> DataFrame:
    """Files with their repository's dependency context, empty where there is none.

    Contexts that are too large to be broadcast are brought to the files of a bucketed
    table by their buckets; any other table of files is shuffled with them then.
    """
    if bucketed.PART in files.columns:
        joined = bucketed.join_small(files, contexts, "repo_id")
    else:
        joined = sized_join(files, contexts, ["repo_id"], "left", ["rel_path"])
    return joined.withColumn("context", F.coalesce("context", F.lit("")))


def prompt_table(
    files_with_context: DataFrame,
    novel: bool = True,
    analysis_template: str = ANALYSIS_TEMPLATE,
    novel_template: str = NOVEL_TEMPLATE,
    chars: int = PROMPT_CHARS,
) -> DataFrame:
    """``prompts(repo_id, rel_path, kind, prompt)``; the text is cut before it is copied."""
    values = {"path": F.col("rel_path"), "context": F.col("context"), "code": F.col("code")}
    rows = [F.struct(F.lit("analysis").alias("kind"), fill(analysis_template, values).alias("prompt"))]
    if novel:
        rows.append(F.struct(F.lit("zero_day").alias("kind"), fill(novel_template, values).alias("prompt")))
    return files_with_context.select(
        "repo_id", "rel_path", "context", truncated(F.col("content"), chars).alias("code")
    ).select("repo_id", "rel_path", F.inline(F.array(*rows)))
