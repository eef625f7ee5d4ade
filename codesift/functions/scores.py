"""Lookups and score formulas over single rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesift import settings


def _lookup(key: Column, values: dict, default) -> Column:
    chain = None
    for name, value in values.items():
        chain = F.when(key == name, F.lit(value)) if chain is None else chain.when(key == name, F.lit(value))
    return chain.otherwise(F.lit(default))


def severity_rank(severity: Column) -> Column:
    """Sort rank; unknown severities rank with ``low``.  Case matters."""
    return _lookup(severity, {name: rank for rank, name in enumerate(settings.SEVERITIES)}, len(settings.SEVERITIES) - 1)


def severity_weight(severity: Column) -> Column:
    return _lookup(severity, settings.SEVERITY_WEIGHTS, 1)


def confidence_floor(severity: Column, method: Column | None = None) -> Column:
    """Mean of the severity factor and, where the method is known, its factor."""
    by_severity = _lookup(
        F.lower(F.coalesce(severity, F.lit("medium"))), settings.SEVERITY_FACTORS, settings.OTHER_SEVERITY_FACTOR
    )
    if method is None:
        return by_severity
    by_method = _lookup(method, settings.METHOD_FACTORS, None)
    return F.when(by_method.isNull(), by_severity).otherwise((by_method + by_severity) / F.lit(2))


def count_of(items: Column) -> Column:
    """Number of elements; 0 for a null array."""
    return F.greatest(F.coalesce(F.size(items), F.lit(0)), F.lit(0))


def complexity_score(parse_error: Column, nodes: Column, functions: Column, classes: Column, dangerous: Column) -> Column:
    total = (
        F.least(nodes / F.lit(100.0), F.lit(10.0))
        + functions * F.lit(0.5)
        + classes * F.lit(0.3)
        + dangerous * F.lit(1.0)
    )
    return F.when(parse_error.isNotNull(), F.lit(0.0)).otherwise(F.least(total, F.lit(10.0)))


def risky_import_count(imports: Column, parts: list[str] | None = None) -> Column:
    """Imports whose lower-case text contains any of the risky parts."""
    parts = settings.RISKY_IMPORT_PARTS if parts is None else parts

    def risky(name: Column) -> Column:
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.lower(name).contains(part)
        return hit

    return count_of(F.filter(imports, risky))


def security_score(dangerous: Column, hits: Column, risky_imports: Column) -> Column:
    """0 is best, 10 is worst."""
    return F.least((dangerous * 2 + hits + risky_imports).cast("double"), F.lit(10.0))


def static_risk_level(mean_security: Column, dangerous: Column, hits: Column) -> Column:
    return (
        F.when((mean_security >= 7) | (dangerous >= 10) | (hits >= 20), "high")
        .when((mean_security >= 4) | (dangerous >= 5) | (hits >= 10), "medium")
        .otherwise("low")
    )


def highest_severity(critical: Column, high: Column, medium: Column) -> Column:
    return F.when(critical > 0, "critical").when(high > 0, "high").when(medium > 0, "medium").otherwise("low")


def risk_band(score: Column) -> Column:
    """Band of the unrounded score."""
    chain = None
    for bound, name in settings.RISK_BANDS:
        chain = F.when(score >= bound, name) if chain is None else chain.when(score >= bound, name)
    return chain.otherwise("Low")


def run_status(executed: Column, failed: Column, abort: Column | None = None) -> Column:
    """Status from the numbers of stages done and failed; an abort reason overrides."""
    status = F.when(failed == 0, "success").when(executed > failed, "partial_success").otherwise("failure")
    if abort is None:
        return status
    return F.when(abort == "timeout", "timeout").when(abort.isNotNull(), "failure").otherwise(status)
