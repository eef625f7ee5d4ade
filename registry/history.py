"""Commit history."""

from __future__ import annotations

from pyspark.sql import functions as F

from codesift.operators import history as ops
from registry.base import load, query, sql

_DATE = """strftime(committed_at + to_minutes(offset_minutes), '%Y-%m-%dT%H:%M:%S') || CASE WHEN offset_minutes < 0 THEN '-' ELSE '+' END
 || printf('%02d:%02d', abs(offset_minutes) // 60, abs(offset_minutes) % 60)"""
_TRIM = "trim(message, ' ' || chr(10))"


@query("h1_head_commit", sql("commits repos", f"""
SELECT r.repo_id, coalesce(c.hash, 'unknown') AS commit_hash, {_TRIM} AS commit_message, c.author, {_DATE} AS commit_date,
 CASE WHEN c.hash IS NULL THEN 'Failed to get repository info: no commits' END AS error
FROM repos r LEFT JOIN (SELECT * FROM commits QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY committed_at DESC, hash DESC) = 1) c ON r.repo_id = c.repo_id"""))
def h1(spark, sf_dir):
    return ops.head_commit(load(spark, sf_dir, "commits"), load(spark, sf_dir, "repos"))


@query("h2_commit_count", sql("commits", "SELECT repo_id, count(*) AS commit_count FROM commits GROUP BY repo_id"))
def h2(spark, sf_dir):
    return ops.commit_counts(load(spark, sf_dir, "commits"))


@query("h3_recent_contributors", sql("commits", """
SELECT repo_id, string_agg(author, ',' ORDER BY author) AS recent_contributors FROM (SELECT DISTINCT repo_id, author FROM (
 SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY committed_at DESC, hash DESC) AS n FROM commits) WHERE n <= 100) GROUP BY repo_id"""))
def h3(spark, sf_dir):
    recent = ops.recent_contributors(load(spark, sf_dir, "commits"))
    return recent.withColumn("recent_contributors", F.array_join("recent_contributors", ","))


@query("h4_file_history", sql("commits commit_files", f"""WITH touched AS (SELECT DISTINCT * FROM commit_files),
 sizes AS (SELECT repo_id, hash, count(*) AS files_changed FROM touched GROUP BY ALL)
SELECT * FROM (SELECT t.repo_id, t.rel_path, CAST(row_number() OVER (PARTITION BY t.repo_id, t.rel_path ORDER BY committed_at DESC, t.hash DESC) AS INTEGER) AS position,
 t.hash, {_TRIM} AS message, author, {_DATE} AS date, files_changed
 FROM touched t JOIN commits c ON t.repo_id = c.repo_id AND t.hash = c.hash JOIN sizes s ON s.repo_id = t.repo_id AND s.hash = t.hash) WHERE position <= 10"""))
def h4(spark, sf_dir):
    return ops.file_history(load(spark, sf_dir, "commits"), load(spark, sf_dir, "commit_files"))


@query("h5_files_changed", sql("commit_files", "SELECT repo_id, hash, count(DISTINCT rel_path) AS files_changed FROM commit_files GROUP BY ALL"))
def h5(spark, sf_dir):
    return ops.files_changed(load(spark, sf_dir, "commit_files"))
