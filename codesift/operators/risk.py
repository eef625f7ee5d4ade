"""Counts, risk and recommendations per repository.

All figures come from aggregates with partial results before the shuffle, so a
repository that holds a large share of all findings is reduced in many tasks.  Type and
severity counts stay rows: their number is set by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift import settings
from codesift.functions import scores, text


def _severity() -> Column:
    return F.coalesce("severity", F.lit("low"))


def type_counts(findings: DataFrame) -> DataFrame:
    kind = F.coalesce("vulnerability_type", F.lit("unknown"))
    return findings.groupBy("repo_id", kind.alias("vulnerability_type")).agg(F.count("*").alias("findings"))


def severity_counts(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Rows for the four fixed severities, zeros included, and for any other one found."""
    found = findings.groupBy("repo_id", _severity().alias("severity")).agg(F.count("*").alias("findings"))
    fixed = repos.select("repo_id", F.explode(F.array(*[F.lit(s) for s in settings.SEVERITIES])).alias("severity"))
    return (
        fixed.withColumn("findings", F.lit(0).cast("bigint"))
        .unionByName(found)
        .groupBy("repo_id", "severity")
        .agg(F.sum("findings").alias("findings"))
    )


def repo_figures(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """All aggregates that summaries and assessments need, for every repository.

    One pass over the findings: rows are reduced per (repository, file), which also
    gives the distinct files, and then per repository.  The join with ``repos`` has one
    row per key on both sides.
    """
    severity, likelihood = _severity(), F.coalesce("zero_day_likelihood", F.lit(0.0))
    confidence = F.coalesce("confidence", F.lit(0.0))
    types = [
        F.max(F.coalesce(F.col("vulnerability_type") == name, F.lit(False))).alias(f"has_{name}")
        for name, _ in settings.TYPE_RECOMMENDATIONS
    ]
    counts = findings.groupBy("repo_id").agg(
        F.count("*").alias("total"),
        F.countDistinct(F.coalesce("file_path", F.lit(""))).alias("files"),
        *[F.count_if(severity == name).alias(name) for name in settings.SEVERITIES],
        F.sum(scores.severity_weight(severity) * F.coalesce("confidence", F.lit(0.5))).alias("weighted"),
        F.sum(likelihood).alias("likelihood"),
        F.count_if(confidence >= settings.HIGH_CONFIDENCE).alias("confident"),
        F.count_if(likelihood > settings.LIKELIHOOD_INDICATOR).alias("indicators"),
        F.avg("confidence").alias("mean_confidence"),
        *types,
    )
    return repos.join(counts, "repo_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))


def _count(name: str) -> Column:
    return F.coalesce(name, F.lit(0)).cast("bigint")


def _risk_score() -> Column:
    """0 to 100; the last digits of the sum depend on its order and are removed."""
    return F.when(
        F.col("total") > 0, F.round(F.col("weighted") / (F.col("total") * F.lit(10.0)) * F.lit(100.0), 10)
    ).otherwise(F.lit(0.0))


def _band() -> Column:
    return scores.risk_band(_risk_score())


def _overall() -> Column:
    return F.initcap(scores.highest_severity(_count("critical"), _count("high"), _count("medium")))


def summary_columns(figures: DataFrame) -> list[Column]:
    name = F.col("name") if "name" in figures.columns else F.lit(None)
    url = F.col("url") if "url" in figures.columns else F.lit(None)
    return [
        F.coalesce(name, F.lit("Unknown")).alias("repository_name"),
        F.coalesce(url, F.lit("")).alias("repository_url"),
        F.col("total").cast("bigint").alias("total_vulnerabilities"),
        *[_count(severity).alias(severity) for severity in settings.SEVERITIES],
        _overall().alias("overall_risk"),
        _count("files").alias("files_analyzed"),
        (F.coalesce("likelihood", F.lit(0.0)) / F.greatest("total", F.lit(1))).alias("zero_day_potential"),
    ]


def assessment_columns() -> list[Column]:
    some = F.col("total") > 0
    return [
        _band().alias("overall_risk"),
        text.round2(_risk_score()).alias("risk_score"),
        F.when(some, F.col("total")).cast("bigint").alias("total_findings"),
        F.when(some, F.col("confident")).cast("bigint").alias("high_confidence_findings"),
        F.when(some, F.col("indicators")).cast("bigint").alias("zero_day_indicators"),
    ]


def recommendation_column() -> Column:
    """A choice from a fixed list, in its order."""
    urgent = _band().isin("Critical", "High")
    chosen = [F.when(urgent, F.lit(line)) for line in settings.URGENT_RECOMMENDATIONS]
    chosen += [F.when(F.col(f"has_{kind}"), F.lit(line)) for kind, line in settings.TYPE_RECOMMENDATIONS]
    chosen.append(F.when(F.col("indicators") > 0, F.lit(settings.LIKELIHOOD_RECOMMENDATION)))
    chosen += [F.lit(line) for line in settings.GENERAL_RECOMMENDATIONS]
    return F.array_compact(F.array(*chosen)).alias("recommendations")


def executive_summary(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """One row per repository: totals, severities, overall risk by highest severity.

    ``files_analyzed`` counts the distinct files that have findings.
    """
    figures = repo_figures(findings, repos)
    return figures.select("repo_id", *summary_columns(figures))


def risk_assessment(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Weighted risk score, its band, and the counts that exist only where there are findings."""
    return repo_figures(findings, repos).select("repo_id", *assessment_columns())


def recommendations(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """``(repo_id, recommendations array<string>)``."""
    return repo_figures(findings, repos).select("repo_id", recommendation_column())


def severities_found(findings: DataFrame) -> DataFrame:
    """Findings of every severity that occurs, known or not: ``(repo_id, severity, findings)``."""
    return findings.groupBy("repo_id", "severity").agg(F.count("*").alias("findings"))


def model_summary(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Summary of the model findings above the threshold; figures are null where there are none."""
    some = F.col("total") > 0
    return repo_figures(findings, repos).select(
        "repo_id",
        F.col("total").cast("bigint").alias("total_vulnerabilities"),
        *[F.when(some, F.col(severity)).cast("bigint").alias(severity) for severity in settings.SEVERITIES],
        scores.highest_severity(_count("critical"), _count("high"), _count("medium")).alias("risk_level"),
        F.col("mean_confidence").alias("average_confidence"),
        F.when(some, F.col("likelihood") / F.col("total")).alias("zero_day_potential"),
    )
