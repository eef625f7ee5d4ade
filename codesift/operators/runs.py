"""Run status, workflow rows and the roll-up of a batch.

``stage_events(repo_id, stage, ord, ok, error)`` has an event per stage of a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift import settings
from codesift.functions import scores

NO_FILES = "No Python files found for analysis"


def stage_log(stage_events: DataFrame) -> DataFrame:
    """Executed and failed stages and error messages per run, in the order of the events.

    Stages of any name count.  Events are first reduced per (run, stage); the lists hold
    one entry per stage, however many events a run has.
    """
    per_stage = (
        stage_events.groupBy("repo_id", "stage")
        .agg(
            F.min("ord").alias("ord"),
            F.bool_and("ok").alias("ok"),
            F.min_by(F.when(~F.col("ok"), F.col("error")), F.when(~F.col("ok"), F.col("ord"))).alias("error"),
        )
    )
    entry = F.struct("ord", "stage", "error")

    def listed(condition: Column, item: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, item)))

    grouped = per_stage.groupBy("repo_id").agg(
        listed(F.col("ok"), entry).alias("done"), listed(~F.col("ok"), entry).alias("broken")
    )
    return grouped.select(
        "repo_id",
        F.transform("done", lambda item: item["stage"]).alias("agents_executed"),
        F.transform("broken", lambda item: item["stage"]).alias("agents_failed"),
        F.filter(F.transform("broken", lambda item: item["error"]), lambda text: text.isNotNull()).alias("error_messages"),
    )


def run_table(repos: DataFrame, log: DataFrame, timeout_seconds: int = settings.PIPELINE_TIMEOUT_SECONDS) -> DataFrame:
    """``runs``: one row per repository with its status.

    ``repos(repo_id, url)`` may have ``python_files`` (a count of 0 adds the message),
    ``abort`` (``timeout`` or another reason: overrides the status, adds a message and
    leaves the time at 0), ``workflow_error`` (message of a failure outside the run) and
    ``execution_time_seconds``.
    """
    none = F.array().cast("array<string>")
    joined = repos.join(log, "repo_id", "left")
    executed, failed = F.coalesce("agents_executed", none), F.coalesce("agents_failed", none)
    messages = F.coalesce("error_messages", none)
    if "python_files" in repos.columns:
        messages = F.when(F.col("python_files") == 0, F.array_append(messages, F.lit(NO_FILES))).otherwise(messages)
    abort = F.col("abort") if "abort" in repos.columns else F.lit(None).cast("string")
    message = F.when(abort == "timeout", F.lit(f"Pipeline timed out after {timeout_seconds} seconds")).otherwise(
        F.concat(F.lit("Pipeline failed: "), abort)
    )
    messages = F.when(abort.isNotNull(), F.array_append(messages, message)).otherwise(messages)
    broken = F.col("workflow_error") if "workflow_error" in repos.columns else F.lit(None).cast("string")
    seconds = F.col("execution_time_seconds") if "execution_time_seconds" in repos.columns else F.lit(None)
    return joined.select(
        "repo_id",
        F.col("url").alias("repository_url"),
        scores.run_status(F.size(executed), F.size(failed), abort).alias("status"),
        F.when(abort.isNull(), F.coalesce(seconds.cast("double"), F.lit(0.0))).otherwise(0.0).alias("execution_time_seconds"),
        executed.alias("agents_executed"),
        failed.alias("agents_failed"),
        messages.alias("error_messages"),
        abort.alias("abort"),
        broken.alias("workflow_error"),
    )


def workflow_rows(runs: DataFrame, summary: DataFrame) -> DataFrame:
    """Runs with their findings and risk; defaults where a run has no summary.

    A run that ends early, by the time limit or a failure of its own, is still a finished
    workflow; its figures are the defaults.  Only a failure outside the run is an error.
    """
    error = F.col("workflow_error").isNotNull()
    without = error | F.col("abort").isNotNull()
    figures = summary.select("repo_id", "total_vulnerabilities", "overall_risk")
    return runs.join(figures, "repo_id", "left").select(
        "repo_id",
        "repository_url",
        F.when(error, "error").otherwise("success").alias("workflow_status"),
        "status",
        F.when(without, 0).otherwise(F.coalesce("total_vulnerabilities", F.lit(0))).cast("bigint").alias("vulnerabilities_found"),
        F.when(without, "unknown").otherwise(F.coalesce("overall_risk", F.lit("unknown"))).alias("risk_level"),
        F.when(error, 0.0).otherwise(F.col("execution_time_seconds")).alias("execution_time"),
        F.col("workflow_error").alias("error_message"),
    )


def succeeded(workflows: DataFrame) -> DataFrame:
    return workflows.where("workflow_status = 'success'")


def failed(workflows: DataFrame) -> DataFrame:
    """Failures with their message."""
    return workflows.where("workflow_status <> 'success'").select(
        "repo_id", "repository_url", F.coalesce("error_message", F.lit("Unknown error")).alias("error")
    )


def batch_rollup(workflows: DataFrame) -> DataFrame:
    """One row: totals of the batch.

    ``successful_analyses`` counts workflows without an error, whatever the status of
    the run; ``clean_runs`` counts only runs with status success.
    """
    ok = F.col("workflow_status") == "success"
    return workflows.agg(
        F.count("*").alias("total_repositories"),
        F.count_if(ok).alias("successful_analyses"),
        F.count_if(~ok).alias("failed_analyses"),
        F.count_if(ok & (F.col("status") == "success")).alias("clean_runs"),
        F.coalesce(F.sum(F.when(ok, F.col("vulnerabilities_found"))), F.lit(0)).cast("bigint").alias("total_vulnerabilities_found"),
    )
