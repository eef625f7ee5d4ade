"""Response tables to finding tables; narrow, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift import settings
from codesift.functions import responses as parse
from codesift.functions import scores
from codesift.session import allow_repeated_keys


def parse_responses(
    responses: DataFrame,
    assess: Callable[[Column, Column], Column] = scores.confidence_floor,
    fallback_chars: int | None = settings.FALLBACK_CHARS,
) -> DataFrame:
    """``responses(repo_id, rel_path, kind, response)`` to one row per finding.

    Rows keep their place by ``part`` (analysis before zero_day) and ``pos``.
    A failed scorer call has a null response and gives nothing.
    """
    allow_repeated_keys(responses.sparkSession)
    kind = F.col("kind")
    rows = (
        responses.select("repo_id", "rel_path", "kind", "response", parse.array_slice(F.col("response")).alias("cut"))
        .withColumn("sealed", parse.sealed_variant(F.col("cut")))
        .withColumn("items", parse.items(F.col("cut"), F.col("sealed")))
        .withColumn("read", parse.read())
    )
    none = F.array().cast(f"array<{parse.READ_TYPE}>")
    from_text = F.when(
        (kind == "analysis") & parse.mentions_vulnerability(F.col("response")),
        F.array(parse.fallback(F.col("response"), fallback_chars)),
    ).otherwise(none)
    found = (
        F.when(F.col("cut").isNull(), none)
        .when(F.col("read").isNull(), from_text)
        .otherwise(parse.valid_prefix(F.col("read")).cast(f"array<{parse.READ_TYPE}>"))
    )
    exploded = rows.select("repo_id", "rel_path", "kind", F.posexplode(found).alias("pos", "item")).select(
        "repo_id", "rel_path", "kind", "pos", "item.*"
    )
    is_text, analysis = F.col("is_text"), kind == "analysis"
    severity = F.coalesce("severity", F.lit("medium"))
    floor = F.when(analysis & ~is_text, assess(severity, F.col("method")))
    default_type = F.when(analysis, F.lit("unknown")).otherwise(F.lit("zero_day_pattern"))
    return exploded.select(
        "repo_id",
        F.col("rel_path").alias("file_path"),
        F.when(analysis, F.col("line_number")).alias("line_number"),
        F.coalesce("vulnerability_type", default_type).alias("vulnerability_type"),
        severity.alias("severity"),
        F.greatest("confidence", floor).alias("confidence"),
        F.coalesce("description", F.lit("")).alias("description"),
        *[F.when(analysis, F.col(name)).alias(name) for name in ("code_snippet", "recommendation", "cwe_id")],
        F.when(is_text, "text_analysis").when(analysis, "llm_analysis").otherwise("zero_day_analysis").alias("detection_method"),
        F.when(analysis, F.lit(0.0)).otherwise(F.col("zero_day_likelihood")).alias("zero_day_likelihood"),
        F.when(analysis, 0).otherwise(1).alias("part"),
        "pos",
    )


def with_threshold(findings: DataFrame, threshold: float = settings.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Flag the findings that reach the confidence threshold; all are kept."""
    return findings.withColumn("is_confident", F.col("confidence") >= threshold)


def confident(findings: DataFrame, threshold: float = settings.CONFIDENCE_THRESHOLD) -> DataFrame:
    return findings.where(F.col("confidence") >= threshold)


def findings_per_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo_id", "file_path").agg(F.count("*").alias("findings"))
