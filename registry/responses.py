"""Prompts, scoring and response parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from codesift import settings
from codesift.functions import responses as parse
from codesift.functions import scores
from codesift.operators import dependencies, prompts, risk
from codesift.operators import responses as ops
from codesift.sources.scorer import score_prompts
from registry.base import load, query, quoted, sql, table
from registry.metadata import CONTEXT_SQL

_PROMPT_INPUTS = "code_files dep_forms dep_files"


def _prompt_sql(kind: str, template: str) -> str:
    text = quoted(template)
    for mark, column in (("{path}", "rel_path"), ("{context}", "context"), ("{code}", "content")):
        text = f"replace({text}, '{mark}', {column})"
    return f"SELECT repo_id, rel_path, '{kind}' AS kind, {text} AS prompt FROM filled"


_FILLED = f"""filled AS (SELECT f.repo_id, f.rel_path, left(f.content, 98304) AS content, coalesce(c.context, '') AS context
 FROM code_files f LEFT JOIN ({CONTEXT_SQL}) c ON f.repo_id = c.repo_id)"""
_ANALYSIS = _prompt_sql("analysis", prompts.ANALYSIS_TEMPLATE)
_NOVEL = _prompt_sql("zero_day", prompts.NOVEL_TEMPLATE)


def _prompts(spark, sf_dir):
    files = load(spark, sf_dir, "dep_forms").unionByName(load(spark, sf_dir, "dep_files"))
    contexts = dependencies.dependency_context(dependencies.distinct_dependencies(files))
    code = load(spark, sf_dir, "code_files").drop("form")
    return prompts.prompt_table(prompts.with_context(code, contexts))


@query("p1_analysis_prompts", sql(_PROMPT_INPUTS, f"WITH {_FILLED} {_ANALYSIS}"))
def p1(spark, sf_dir):
    return _prompts(spark, sf_dir).where("kind = 'analysis'")


@query("p2_novel_prompts", sql(_PROMPT_INPUTS, f"WITH {_FILLED} {_NOVEL}"))
def p2(spark, sf_dir):
    return _prompts(spark, sf_dir).where("kind = 'zero_day'")


@query("p3_prompts_per_file", sql(_PROMPT_INPUTS, f"""WITH {_FILLED}
SELECT repo_id, rel_path, kind, CAST(length(prompt) AS INTEGER) AS chars FROM ({_ANALYSIS} UNION ALL {_NOVEL})"""))
def p3(spark, sf_dir):
    return _prompts(spark, sf_dir).select("repo_id", "rel_path", "kind", F.length("prompt").alias("chars"))


def _make_scorer():
    def score(prompt: str) -> str:
        if "eval(" in prompt:
            raise ValueError("refused")
        return f"Result: [] after {len(prompt)} characters"

    return score


@query("p4_batch_scoring", sql(_PROMPT_INPUTS, f"""WITH {_FILLED}
SELECT repo_id, rel_path, kind, CASE WHEN prompt LIKE '%eval(%' THEN NULL ELSE 'Result: [] after ' || CAST(length(prompt) AS VARCHAR) || ' characters' END AS response,
 CASE WHEN prompt LIKE '%eval(%' THEN 'refused' END AS error FROM ({_ANALYSIS} UNION ALL {_NOVEL})"""))
def p4(spark, sf_dir):
    return score_prompts(_prompts(spark, sf_dir), _make_scorer)


# --- parsing ----------------------------------------------------------------------
_CUT = """cut AS (SELECT *, CASE WHEN strpos(response, '[') > 0 AND length(response) - strpos(reverse(response), ']') + 1 > strpos(response, '[') AND strpos(response, ']') > 0
 THEN substring(response, strpos(response, '['), length(response) - strpos(reverse(response), ']') - strpos(response, '[') + 2) END AS cut FROM responses)"""
_NUMBER = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$'"


def _number(key: str, default: str) -> str:
    kind, text = f"json_type(el, '$.{key}')", f"json_extract_string(el, '$.{key}')"
    return f"""CASE WHEN {kind} IS NULL THEN {default} WHEN {kind} = 'BOOLEAN' THEN CASE {text} WHEN 'true' THEN 1.0 ELSE 0.0 END
 WHEN {kind} IN ('NULL', 'OBJECT', 'ARRAY') THEN NULL WHEN regexp_matches({text}, {_NUMBER}) THEN TRY_CAST({text} AS DOUBLE) END"""


def _text_ok(key: str, null_ok: bool) -> str:
    kinds = "'VARCHAR', 'NULL'" if null_ok else "'VARCHAR'"
    return f"(json_type(el, '$.{key}') IS NULL OR json_type(el, '$.{key}') IN ({kinds}))"


_LINE = r"""CASE WHEN json_type(el, '$.line_number') = 'VARCHAR' THEN CASE WHEN regexp_matches(json_extract_string(el, '$.line_number'), '^\s*[+-]?\d+(\.0*)?\s*$')
  THEN CAST(TRY_CAST(json_extract_string(el, '$.line_number') AS DOUBLE) AS BIGINT) END
 WHEN json_type(el, '$.line_number') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CASE WHEN TRY_CAST(json_extract_string(el, '$.line_number') AS DOUBLE) = floor(TRY_CAST(json_extract_string(el, '$.line_number') AS DOUBLE))
  THEN CAST(TRY_CAST(json_extract_string(el, '$.line_number') AS DOUBLE) AS BIGINT) END END"""
_ELEMENTS = f"""{_CUT}, els AS (
 SELECT repo_id, rel_path, kind, unnest(json_extract(cut, '$[*]')) AS el, generate_subscripts(json_extract(cut, '$[*]'), 1) - 1 AS pos
 FROM cut WHERE cut IS NOT NULL AND json_valid(cut)),
checked AS (SELECT *, {_number('confidence', '0.5')} AS conf, {_number('zero_day_likelihood', '0.0')} AS likelihood, {_LINE} AS line,
 json_type(el) = 'OBJECT' AND {_text_ok('vulnerability_type', False)} AND {_text_ok('severity', False)} AND {_text_ok('description', False)} AS shared_ok,
 {_text_ok('code_snippet', True)} AND {_text_ok('recommendation', True)} AND {_text_ok('cwe_id', True)} AS optional_ok,
 json_type(el, '$.line_number') IS NULL OR json_type(el, '$.line_number') = 'NULL' AS no_line FROM els),
marked AS (SELECT *, coalesce(shared_ok AND conf IS NOT NULL AND CASE WHEN kind = 'analysis' THEN optional_ok AND (no_line OR line IS NOT NULL) ELSE likelihood IS NOT NULL END, false) AS ok FROM checked),
kept AS (SELECT * FROM (SELECT *, min(CASE WHEN NOT ok THEN pos END) OVER (PARTITION BY repo_id, rel_path, kind) AS bad FROM marked) WHERE bad IS NULL OR pos < bad)"""


def _get(key: str, default: str) -> str:
    return f"coalesce(json_extract_string(el, '$.{key}'), {default})"


_SEVERITY = _get("severity", "'medium'")
_FACTOR = f"CASE lower({_SEVERITY}) WHEN 'critical' THEN 0.9 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.7 ELSE 0.5 END"
_METHOD = "CASE json_extract_string(el, '$.detection_method') WHEN 'llm_analysis' THEN 0.8 WHEN 'static_analysis' THEN 0.9 WHEN 'pattern_matching' THEN 0.6 END"
_FLOOR = f"CASE WHEN {_METHOD} IS NULL THEN ({_FACTOR})::DOUBLE ELSE (({_METHOD})::DOUBLE + ({_FACTOR})::DOUBLE) / 2 END"
_PARSED = f"""{_ELEMENTS}, parsed AS (
SELECT repo_id, rel_path AS file_path, CASE WHEN kind = 'analysis' THEN line END AS line_number,
 {_get('vulnerability_type', "CASE WHEN kind = 'analysis' THEN 'unknown' ELSE 'zero_day_pattern' END")} AS vulnerability_type, {_SEVERITY} AS severity,
 CASE WHEN kind = 'analysis' THEN greatest(conf, {_FLOOR}) ELSE conf END::DOUBLE AS confidence, {_get('description', "''")} AS description,
 CASE WHEN kind = 'analysis' THEN json_extract_string(el, '$.code_snippet') END AS code_snippet,
 CASE WHEN kind = 'analysis' THEN json_extract_string(el, '$.recommendation') END AS recommendation,
 CASE WHEN kind = 'analysis' THEN json_extract_string(el, '$.cwe_id') END AS cwe_id,
 CASE WHEN kind = 'analysis' THEN 'llm_analysis' ELSE 'zero_day_analysis' END AS detection_method,
 CASE WHEN kind = 'analysis' THEN 0.0 ELSE likelihood END::DOUBLE AS zero_day_likelihood,
 CAST(CASE WHEN kind = 'analysis' THEN 0 ELSE 1 END AS INTEGER) AS part, CAST(pos AS INTEGER) AS pos FROM kept
UNION ALL
SELECT repo_id, rel_path, NULL, 'potential_vulnerability', 'medium', 0.3, 'Potential vulnerability detected in text analysis: ' || left(response, 200) || '...',
 NULL, NULL, NULL, 'text_analysis', 0.0, 0, 0 FROM cut
WHERE cut IS NOT NULL AND NOT json_valid(cut) AND kind = 'analysis' AND regexp_matches(lower(response), 'vulnerability|injection'))"""


def _responses(spark, sf_dir):
    return load(spark, sf_dir, "responses")


def _items(spark, sf_dir):
    cut = _responses(spark, sf_dir).withColumn("cut", parse.array_slice(F.col("response")))
    sealed = cut.withColumn("sealed", parse.sealed_variant(F.col("cut")))
    return sealed.withColumn("items", parse.items(F.col("cut"), F.col("sealed")))


def _parsed(spark, sf_dir):
    return ops.parse_responses(_responses(spark, sf_dir))


@query("p5_array_slice", sql("responses", f"WITH {_CUT} SELECT repo_id, rel_path, cut FROM cut"))
def p5(spark, sf_dir):
    return _responses(spark, sf_dir).select("repo_id", "rel_path", parse.array_slice(F.col("response")).alias("cut"))


@query("p6_strict_decode", sql("responses", f"WITH {_CUT} SELECT repo_id, rel_path, json_valid(cut) AS is_array, CAST(CASE WHEN json_valid(cut) THEN json_array_length(cut) END AS INTEGER) AS items FROM cut WHERE cut IS NOT NULL"))
def p6(spark, sf_dir):
    rows = _items(spark, sf_dir).where("cut IS NOT NULL")
    return rows.select("repo_id", "rel_path", F.col("items").isNotNull().alias("is_array"), F.size("items").alias("items"))


@query("p7_analysis_findings", sql("responses", f"WITH {_PARSED} SELECT * FROM parsed WHERE detection_method = 'llm_analysis'"))
def p7(spark, sf_dir):
    return _parsed(spark, sf_dir).where("detection_method = 'llm_analysis'")


@query("p8_novel_findings", sql("responses", f"WITH {_PARSED} SELECT * FROM parsed WHERE detection_method = 'zero_day_analysis'"))
def p8(spark, sf_dir):
    return _parsed(spark, sf_dir).where("detection_method = 'zero_day_analysis'")


_SALVAGED = sql("responses", f"""WITH {_ELEMENTS}, counts AS (
 SELECT repo_id, rel_path, kind, count(*) AS items, CAST(count_if(bad IS NULL OR pos < bad) AS BIGINT) AS kept FROM (
  SELECT *, min(CASE WHEN NOT ok THEN pos END) OVER (PARTITION BY repo_id, rel_path, kind) AS bad FROM marked) GROUP BY ALL)
SELECT repo_id, rel_path, kind, CAST(items AS INTEGER) AS items, CAST(kept AS INTEGER) AS kept FROM counts
UNION ALL SELECT repo_id, rel_path, kind, 0, 0 FROM cut WHERE regexp_full_match(cut, '\\[\\s*\\]')""")


@query("p9_prefix_salvage_all", _SALVAGED)
@query("p9_prefix_salvage", _SALVAGED)
def p9(spark, sf_dir):
    """Items of every array and how many are kept, empty arrays too; the second name is of an earlier round."""
    read = _items(spark, sf_dir).where("items IS NOT NULL").withColumn("read", parse.read())
    kept = F.size(parse.valid_prefix(F.col("read"))).alias("kept")
    return read.select("repo_id", "rel_path", "kind", F.size("items").alias("items"), kept)


@query("p10_text_fallback", sql("responses", f"WITH {_PARSED} SELECT * FROM parsed WHERE detection_method = 'text_analysis'"))
def p10(spark, sf_dir):
    return _parsed(spark, sf_dir).where("detection_method = 'text_analysis'")


@query("p11_confidence_factors", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN m IS NULL THEN s ELSE (m + s) / 2 END AS assessed FROM (
 SELECT l_orderkey, l_linenumber, l_partkey,
  (CASE l_returnflag WHEN 'A' THEN 0.8 WHEN 'N' THEN 0.9 ELSE CASE WHEN l_linestatus = 'O' THEN 0.6 END END)::DOUBLE AS m,
  (CASE l_linenumber % 5 WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 WHEN 2 THEN 0.7 WHEN 3 THEN 0.5 ELSE 0.7 END)::DOUBLE AS s FROM lineitem)""")
def p11(spark, sf_dir):
    severity = F.expr("CASE l_linenumber % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'high' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'other' END")
    method = F.expr("CASE l_returnflag WHEN 'A' THEN 'llm_analysis' WHEN 'N' THEN 'static_analysis' ELSE CASE WHEN l_linestatus = 'O' THEN 'pattern_matching' END END")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", scores.confidence_floor(severity, method).alias("assessed")
    )


@query("p12_confidence_floor", sql("responses", f"""WITH {_PARSED} SELECT file_path, pos, confidence, confidence >=
 CASE lower(severity) WHEN 'critical' THEN 0.75 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.7 ELSE 0.5 END AS reaches FROM parsed WHERE detection_method = 'llm_analysis'"""))
def p12(spark, sf_dir):
    found = _parsed(spark, sf_dir).where("detection_method = 'llm_analysis'")
    least = F.expr("CASE lower(severity) WHEN 'critical' THEN 0.75D WHEN 'high' THEN 0.8D WHEN 'medium' THEN 0.7D ELSE 0.5D END")
    return found.select("file_path", "pos", "confidence", (F.col("confidence") >= least).alias("reaches"))


@query("p13_all_findings", sql("responses", f"WITH {_PARSED} SELECT * FROM parsed"))
def p13(spark, sf_dir):
    return _parsed(spark, sf_dir)


@query("p14_confidence_threshold", sql("responses", f"WITH {_PARSED} SELECT file_path, part, pos, severity, confidence, confidence >= 0.7 AS is_confident FROM parsed"))
def p14(spark, sf_dir):
    flagged = ops.with_threshold(_parsed(spark, sf_dir))
    return flagged.select("file_path", "part", "pos", "severity", "confidence", "is_confident")


_COUNTS = ", ".join(f"CASE WHEN n > 0 THEN {s} END AS {s}" for s in settings.SEVERITIES)


@query("p15_model_summary", sql("responses repos", f"""WITH {_PARSED}, sums AS (
 SELECT repo_id, count(*) AS n, {', '.join(f"CAST(count_if(severity = '{s}') AS BIGINT) AS {s}" for s in settings.SEVERITIES)}, avg(confidence) AS c, avg(zero_day_likelihood) AS z
 FROM parsed WHERE confidence >= 0.7 GROUP BY repo_id)
SELECT r.repo_id, coalesce(n, 0) AS total_vulnerabilities, {_COUNTS}, CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high' WHEN medium > 0 THEN 'medium' ELSE 'low' END AS risk_level,
 round(c, 6) AS average_confidence, round(z, 6) AS zero_day_potential FROM repos r LEFT JOIN sums s ON r.repo_id = s.repo_id"""))
def p15(spark, sf_dir):
    repos = load(spark, sf_dir, "repos").select("repo_id")
    summary = risk.model_summary(ops.confident(_parsed(spark, sf_dir)), repos)
    return summary.withColumns({name: F.round(name, 6) for name in ("average_confidence", "zero_day_potential")})


@query("p15_model_severities", sql("responses", f"""WITH {_PARSED} SELECT repo_id, severity, count(*) AS findings FROM parsed WHERE confidence >= 0.7 GROUP BY ALL"""))
def p15_severities(spark, sf_dir):
    return risk.severities_found(ops.confident(_parsed(spark, sf_dir)))


@query("p15_model_types", sql("responses", f"""WITH {_PARSED} SELECT repo_id, vulnerability_type, count(*) AS findings FROM parsed WHERE confidence >= 0.7 GROUP BY ALL"""))
def p15_types(spark, sf_dir):
    return risk.type_counts(ops.confident(_parsed(spark, sf_dir)))


@query("p16_findings_per_file", sql("responses", f"WITH {_PARSED} SELECT repo_id, file_path, count(*) AS findings FROM parsed GROUP BY ALL"))
def p16(spark, sf_dir):
    return ops.findings_per_file(_parsed(spark, sf_dir))
