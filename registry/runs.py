"""Run status and batch roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from codesift.operators import contracts, files
from codesift.operators import runs as ops
from registry.base import load, query, sql

_LOG = """stages AS (SELECT repo_id, stage, min(ord) AS ord, bool_and(ok) AS ok, min(error) FILTER (NOT ok) AS error FROM stage_events GROUP BY ALL),
log AS (SELECT repo_id, coalesce(string_agg(stage, ',' ORDER BY ord) FILTER (ok), '') AS done, count(*) FILTER (ok) AS n_done,
 coalesce(string_agg(stage, ',' ORDER BY ord) FILTER (NOT ok), '') AS broken, count(*) FILTER (NOT ok) AS n_broken,
 coalesce(string_agg(error, ',' ORDER BY ord) FILTER (NOT ok), '') AS errors FROM stages GROUP BY repo_id),
runs AS (SELECT r.* EXCLUDE (execution_time_seconds), CASE WHEN abort IS NULL THEN execution_time_seconds ELSE 0 END AS execution_time_seconds, coalesce(done, '') AS done, coalesce(broken, '') AS broken,
 concat_ws(',', nullif(errors, ''), CASE WHEN python_files = 0 THEN 'No Python files found for analysis' END,
  CASE WHEN abort = 'timeout' THEN 'Pipeline timed out after 1800 seconds' WHEN abort IS NOT NULL THEN 'Pipeline failed: ' || abort END) AS errors,
 CASE WHEN abort = 'timeout' THEN 'timeout' WHEN abort IS NOT NULL THEN 'failure' WHEN coalesce(n_broken, 0) = 0 THEN 'success' WHEN n_done > n_broken THEN 'partial_success' ELSE 'failure' END AS status
 FROM run_repos r LEFT JOIN log l ON r.repo_id = l.repo_id),
flows AS (SELECT u.repo_id, u.url AS repository_url, CASE WHEN workflow_error IS NOT NULL THEN 'error' ELSE 'success' END AS workflow_status, status,
 CASE WHEN workflow_error IS NOT NULL OR abort IS NOT NULL THEN 0 ELSE total_vulnerabilities END AS vulnerabilities_found,
 CASE WHEN workflow_error IS NOT NULL OR abort IS NOT NULL THEN 'unknown' ELSE overall_risk END AS risk_level,
 CASE WHEN workflow_error IS NOT NULL THEN 0 ELSE execution_time_seconds END AS execution_time, workflow_error AS error_message
 FROM runs u JOIN run_summary s ON u.repo_id = s.repo_id)"""
_INPUTS = "stage_events run_repos run_summary"


def _log(spark, sf_dir):
    return ops.stage_log(contracts.require(load(spark, sf_dir, "stage_events"), contracts.STAGE_EVENTS))


def _runs(spark, sf_dir):
    return ops.run_table(load(spark, sf_dir, "run_repos"), _log(spark, sf_dir))


def _flows(spark, sf_dir):
    return ops.workflow_rows(_runs(spark, sf_dir), load(spark, sf_dir, "run_summary"))


@query("b1_run_status", sql(_INPUTS, f"WITH {_LOG} SELECT repo_id, status, errors AS error_messages, execution_time_seconds FROM runs"))
def b1(spark, sf_dir):
    return _runs(spark, sf_dir).select(
        "repo_id", "status", F.array_join("error_messages", ",").alias("error_messages"), "execution_time_seconds"
    )


@query("b2_stage_log", sql(_INPUTS, f"WITH {_LOG} SELECT repo_id, done AS executed, broken AS failed, errors FROM log"))
def b2(spark, sf_dir):
    return _log(spark, sf_dir).select(
        "repo_id",
        F.array_join("agents_executed", ",").alias("executed"),
        F.array_join("agents_failed", ",").alias("failed"),
        F.array_join("error_messages", ",").alias("errors"),
    )


@query("b3_workflow_rows", sql(_INPUTS, f"WITH {_LOG} SELECT * FROM flows"))
def b3(spark, sf_dir):
    return _flows(spark, sf_dir)


@query("b4_batch_rollup", sql(_INPUTS, f"""WITH {_LOG} SELECT count(*) AS total_repositories, CAST(count_if(workflow_status = 'success') AS BIGINT) AS successful_analyses, CAST(count_if(workflow_status <> 'success') AS BIGINT) AS failed_analyses,
 CAST(count_if(workflow_status = 'success' AND status = 'success') AS BIGINT) AS clean_runs, CAST(sum(vulnerabilities_found) FILTER (workflow_status = 'success') AS BIGINT) AS total_vulnerabilities_found FROM flows"""))
def b4(spark, sf_dir):
    return ops.batch_rollup(_flows(spark, sf_dir))


@query("b5_succeeded", sql(_INPUTS, f"WITH {_LOG} SELECT * FROM flows WHERE workflow_status = 'success'"))
def b5_ok(spark, sf_dir):
    return ops.succeeded(_flows(spark, sf_dir))


@query("b5_failed", sql(_INPUTS, f"WITH {_LOG} SELECT repo_id, repository_url, error_message AS error FROM flows WHERE workflow_status <> 'success'"))
def b5_failed(spark, sf_dir):
    return ops.failed(_flows(spark, sf_dir))


@query("b6_stage_inputs", sql("tree_files repos", """
SELECT r.repo_id, count(t.rel_path) AS python_files, coalesce(CAST(count_if(t.size_bytes <= 102400) AS BIGINT), 0) AS analyzable_files, count(t.rel_path) > 0 AS analysis_allowed
FROM repos r LEFT JOIN (SELECT * FROM tree_files WHERE rel_path LIKE '%.py') t ON r.repo_id = t.repo_id GROUP BY r.repo_id"""))
def b6(spark, sf_dir):
    python = files.python_files(load(spark, sf_dir, "tree_files"))
    return contracts.stage_inputs(load(spark, sf_dir, "repos"), python, files.analyzable(python))
