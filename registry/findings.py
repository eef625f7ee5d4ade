"""Consolidation, order, risk and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from codesift import settings
from codesift.operators import facts as fact_ops
from codesift.operators import findings as ops
from codesift.operators import responses as response_ops
from codesift.operators import risk, rules
from codesift.sinks import documents
from codesift.sources.facts import extract_facts
from codesift.sources.spread import spread
from registry.base import load, query, quoted, sql
from registry.responses import _PARSED
from registry.rules import _HITS, _INPUTS, rule_set, texts


def _findings(spark, sf_dir):
    return load(spark, sf_dir, "findings")


def _repos(spark, sf_dir):
    return load(spark, sf_dir, "repos")


_MODEL = f"SELECT *, 'Model Analysis' AS source, CAST(0 AS INTEGER) AS origin FROM parsed WHERE confidence >= 0.7"


@query("r1_tagged_model_findings", sql("responses", f"WITH {_PARSED} {_MODEL}"))
def r1(spark, sf_dir):
    return ops.from_model(response_ops.confident(response_ops.parse_responses(load(spark, sf_dir, "responses"))))


_STATIC = """'{method}' AS detection_method, CAST(NULL AS VARCHAR) AS code_snippet, CAST(NULL AS VARCHAR) AS recommendation, CAST(NULL AS VARCHAR) AS cwe_id,
 CAST(NULL AS DOUBLE) AS zero_day_likelihood, 'Static Analysis' AS source, CAST(1 AS INTEGER) AS origin"""
_CALLS = f"""SELECT repo_id, rel_path AS file_path, CAST(CASE form WHEN 0 THEN 2 ELSE 3 END AS BIGINT) AS line_number, 'dangerous_function_call' AS vulnerability_type,
 'medium' AS severity, 0.8::DOUBLE AS confidence, 'Potentially dangerous function call: ' || CASE form WHEN 0 THEN 'eval' ELSE 'pickle.loads' END AS description,
 {_STATIC.format(method='static_analysis')}, CAST(0 AS INTEGER) AS part FROM code_files WHERE form IN (0, 3)"""
_PATTERNS = f"""SELECT repo_id, rel_path AS file_path, CAST(line AS BIGINT) AS line_number, 'suspicious_pattern' AS vulnerability_type, 'low' AS severity, 0.6::DOUBLE AS confidence,
 'Suspicious code pattern detected: ' || left(hits[n], 100) AS description, {_STATIC.format(method='pattern_matching')}, CAST(1 AS INTEGER) AS part FROM found"""


@query("r2_call_findings", sql("code_files", _CALLS))
def r2(spark, sf_dir):
    facts = extract_facts(spread(load(spark, sf_dir, "code_files").select("repo_id", "rel_path", "content")))
    return ops.from_calls(fact_ops.dangerous_calls(facts)).drop("pos")


@query("r3_pattern_findings", sql(_INPUTS, f"WITH {_HITS} {_PATTERNS}"))
def r3(spark, sf_dir):
    return ops.from_hits(rules.scan(texts(spark, sf_dir), rule_set())).drop("pos")


_COMMON = "repo_id, file_path, line_number, vulnerability_type, severity, confidence, description, code_snippet, recommendation, cwe_id, detection_method, zero_day_likelihood, source, origin, part"


@query("r4_all_findings", sql("responses " + _INPUTS, f"""WITH {_PARSED}, {_HITS}
SELECT {_COMMON} FROM ({_MODEL}) UNION ALL SELECT {_COMMON} FROM ({_CALLS}) UNION ALL SELECT {_COMMON} FROM ({_PATTERNS})"""))
def r4(spark, sf_dir):
    return ops.consolidate(r1(spark, sf_dir).drop("pos"), r2(spark, sf_dir), r3(spark, sf_dir))


_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
RANKED = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {_RANK}, confidence DESC, origin, file_path, part, pos,
 vulnerability_type, line_number, description) AS position FROM findings)"""


@query("r5_severity_order", sql("findings", f"WITH {RANKED} SELECT repo_id, position, severity, confidence, file_path, origin, part, pos, vulnerability_type, line_number, description FROM ranked"))
def r5(spark, sf_dir):
    ranked = ops.rank_findings(_findings(spark, sf_dir))
    return ranked.select(
        "repo_id", "position", "severity", "confidence", "file_path", "origin", "part", "pos", "vulnerability_type", "line_number", "description"
    )


@query("r6_severity_breakdown", sql("findings repos", f"""
SELECT repo_id, severity, CAST(sum(n) AS BIGINT) AS findings FROM (
 SELECT repo_id, unnest([{', '.join(quoted(s) for s in settings.SEVERITIES)}]) AS severity, 0 AS n FROM repos UNION ALL SELECT repo_id, severity, 1 FROM findings) GROUP BY ALL"""))
def r6(spark, sf_dir):
    return risk.severity_counts(_findings(spark, sf_dir), _repos(spark, sf_dir))


@query("r7_type_counts", sql("findings", "SELECT repo_id, vulnerability_type, count(*) AS findings FROM findings GROUP BY ALL"))
def r7(spark, sf_dir):
    return risk.type_counts(_findings(spark, sf_dir))


_SUMS = f"""sums AS (SELECT repo_id, count(*) AS n, {', '.join(f"CAST(count_if(severity = '{s}') AS BIGINT) AS {s}" for s in settings.SEVERITIES)}, count(DISTINCT file_path) AS files,
 sum(coalesce(zero_day_likelihood, 0)) AS likelihood, sum(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 7 WHEN 'medium' THEN 4 ELSE 1 END * confidence) AS weighted,
 CAST(count_if(confidence >= 0.8) AS BIGINT) AS confident, CAST(count_if(zero_day_likelihood > 0.5) AS BIGINT) AS indicators, {', '.join(f"bool_or(vulnerability_type = '{k}') AS has_{k}" for k, _ in settings.TYPE_RECOMMENDATIONS)}
 FROM findings GROUP BY repo_id), joined AS (SELECT r.repo_id, r.name, r.url, s.* EXCLUDE (repo_id), round(coalesce(weighted / (n * 10) * 100, 0), 10) AS score FROM repos r LEFT JOIN sums s ON r.repo_id = s.repo_id)"""
_OVERALL = "CASE WHEN critical > 0 THEN 'Critical' WHEN high > 0 THEN 'High' WHEN medium > 0 THEN 'Medium' ELSE 'Low' END"
_BAND = "CASE WHEN score >= 70 THEN 'Critical' WHEN score >= 50 THEN 'High' WHEN score >= 30 THEN 'Medium' ELSE 'Low' END"


def _oracle(select: str) -> str:
    return sql("findings repos", f"WITH {_SUMS} SELECT repo_id, {select} FROM joined")


def _summary(spark, sf_dir):
    summary = risk.executive_summary(_findings(spark, sf_dir), _repos(spark, sf_dir))
    return summary.withColumn("zero_day_potential", F.round("zero_day_potential", 6))


def _assessed(spark, sf_dir):
    return risk.risk_assessment(_findings(spark, sf_dir), _repos(spark, sf_dir).select("repo_id"))


@query("r8_overall_risk", _oracle(f"{_OVERALL} AS overall_risk"))
def r8(spark, sf_dir):
    return _summary(spark, sf_dir).select("repo_id", "overall_risk")


@query("r9_files_with_findings", _oracle("coalesce(files, 0) AS files_analyzed"))
def r9(spark, sf_dir):
    return _summary(spark, sf_dir).select("repo_id", "files_analyzed")


@query("r10_zero_day_potential", _oracle("round(coalesce(likelihood / n, 0), 6) AS zero_day_potential"))
def r10(spark, sf_dir):
    return _summary(spark, sf_dir).select("repo_id", "zero_day_potential")


@query("r11_executive_summary", _oracle(f"""coalesce(name, 'Unknown') AS repository_name, coalesce(url, '') AS repository_url, coalesce(n, 0) AS total_vulnerabilities,
 {', '.join(f'coalesce({s}, 0) AS {s}' for s in settings.SEVERITIES)}, {_OVERALL} AS overall_risk, coalesce(files, 0) AS files_analyzed,
 round(coalesce(likelihood / n, 0), 6) AS zero_day_potential"""))
def r11(spark, sf_dir):
    return _summary(spark, sf_dir)


@query("r12_risk_score", _oracle("CAST(printf('%.2f', score) AS DOUBLE) AS risk_score"))
def r12(spark, sf_dir):
    return _assessed(spark, sf_dir).select("repo_id", "risk_score")


@query("r13_risk_band", _oracle(f"{_BAND} AS overall_risk"))
def r13(spark, sf_dir):
    return _assessed(spark, sf_dir).select("repo_id", "overall_risk")


@query("r14_risk_counts", _oracle("n AS total_findings, confident AS high_confidence_findings, indicators AS zero_day_indicators"))
def r14(spark, sf_dir):
    return _assessed(spark, sf_dir).select("repo_id", "total_findings", "high_confidence_findings", "zero_day_indicators")


def _advice() -> str:
    chosen = [f"CASE WHEN {_BAND} IN ('Critical', 'High') THEN {quoted(line)} END" for line in settings.URGENT_RECOMMENDATIONS]
    chosen += [f"CASE WHEN has_{kind} THEN {quoted(line)} END" for kind, line in settings.TYPE_RECOMMENDATIONS]
    chosen.append(f"CASE WHEN indicators > 0 THEN {quoted(settings.LIKELIHOOD_RECOMMENDATION)} END")
    chosen += [quoted(line) for line in settings.GENERAL_RECOMMENDATIONS]
    return f"concat_ws(chr(10), {', '.join(chosen)}) AS recommendations"


@query("r15_recommendations", _oracle(_advice()))
def r15(spark, sf_dir):
    advice = risk.recommendations(_findings(spark, sf_dir), _repos(spark, sf_dir).select("repo_id"))
    return advice.select("repo_id", F.array_join("recommendations", "\n").alias("recommendations"))


def report_time():
    return F.lit("2025-01-02 03:04:05").cast("timestamp")


def _heads(spark, sf_dir):
    return documents.report_heads(_repos(spark, sf_dir), _findings(spark, sf_dir), report_time())


@query("r16_report_row", _oracle(f"""'vuln_report_20250102_030405' AS report_id, '2025-01-02T03:04:05.000000' AS "timestamp", url, {_OVERALL} AS highest, {_BAND} AS band,
 coalesce(n, 0) AS total, 'Model Analysis, Static Analysis' AS agents, {_advice()}"""))
def r16(spark, sf_dir):
    return _heads(spark, sf_dir).select(
        "repo_id",
        "report_id",
        "timestamp",
        "repository_info.url",
        F.col("executive_summary.overall_risk").alias("highest"),
        F.col("risk_assessment.overall_risk").alias("band"),
        F.col("executive_summary.total_vulnerabilities").alias("total"),
        F.array_join("metadata.analysis_agents", ", ").alias("agents"),
        F.array_join("recommendations", "\n").alias("recommendations"),
    )


@query("r17_report_result", _oracle(f"'success' AS status, 'vuln_report_20250102_030405' AS report_id, coalesce(n, 0) AS total_vulnerabilities, {_BAND} AS risk_level"))
def r17(spark, sf_dir):
    return documents.report_results(_heads(spark, sf_dir))
