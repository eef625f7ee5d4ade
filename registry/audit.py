"""The whole audit, with repositories of every outcome."""

from __future__ import annotations

from pyspark.sql import functions as F

from codesift.plans.audit import audit
from codesift.sinks.documents import report_results
from registry.base import INPUTS, load, query, sql

# Of the repositories, 3 is too large, 5 has no Python files, 7 has an invalid address, 11 has none, 23 and 24 have no files.
INPUTS["audit_files"] = ("part", [
    "'repo_' || CAST(p_partkey % 23 AS STRING) AS repo_id",
    """CASE WHEN p_partkey % 10 = 0 THEN 'venv/' WHEN p_partkey % 10 = 1 THEN '.git/x/' ELSE 'pkg/' END
     || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 23 = 5 OR p_partkey % 10 = 2 THEN '.md' ELSE '.py' END AS rel_path""",
    """CAST(CASE WHEN p_partkey % 23 = 3 THEN 600 * 1048576 WHEN p_size % 5 = 0 THEN 102401 + p_partkey ELSE 50 END AS BIGINT) AS size_bytes""",
    """CASE p_size % 4
      WHEN 0 THEN 'x = eval("' || p_name || '")'
      WHEN 1 THEN 'password = "' || p_brand || '"'
      WHEN 2 THEN 'def f(a):' || chr(10) || '    return "{}".format(a)'
      ELSE 'import pickle' || chr(10) || 'y = 1' END || chr(10) AS content""",
    "p_size % 4 AS form",
])
INPUTS["audit_urls"] = ("nation", [
    "CASE n_nationkey WHEN 11 THEN 'repo_other' ELSE 'repo_' || CAST(n_nationkey AS STRING) END AS repo_id",
    "CASE n_nationkey WHEN 7 THEN 'ftp://h/o/r' ELSE 'https://h/o/r' || CAST(n_nationkey AS STRING) END AS url",
])


@query("x1_audit", sql("audit_files audit_urls", r"""WITH sizes AS (SELECT repo_id, sum(size_bytes) / 1048576.0::DOUBLE AS mb,
  count(*) FILTER (rel_path LIKE 'pkg/%.py') AS python_count FROM audit_files GROUP BY repo_id),
checked AS (SELECT u.repo_id, u.url, coalesce(python_count, 0) AS python_count,
  CASE WHEN url LIKE 'ftp:%' THEN 'Invalid input data' WHEN mb > 500 THEN printf('Repository size (%.1fMB) exceeds limit (500MB)', mb) END AS error
  FROM audit_urls u LEFT JOIN sizes s ON s.repo_id = u.repo_id),
files AS (SELECT f.* FROM audit_files f JOIN checked c ON c.repo_id = f.repo_id WHERE c.error IS NULL AND c.python_count > 0 AND f.rel_path LIKE 'pkg/%.py')
SELECT 'run' AS outcome, repo_id, CASE WHEN error IS NOT NULL THEN 'failure||Agent repo_ingestion failed: ' || error
  WHEN python_count = 0 THEN 'success|repo_ingestion|No Python files found for analysis' ELSE 'success|repo_ingestion,python_analysis,report_generation|' END AS detail FROM checked
UNION ALL SELECT 'rejected', repo_id, url || '|' || error FROM checked WHERE error IS NOT NULL
UNION ALL SELECT 'skipped', repo_id, printf('Skipping large file: %s (%.1fKB)', rel_path, size_bytes / 1024.0::DOUBLE) FROM files WHERE size_bytes > 102400
UNION ALL SELECT 'unlisted', repo_id, '' FROM sizes WHERE repo_id NOT IN (SELECT repo_id FROM audit_urls)
UNION ALL SELECT 'report', c.repo_id, CAST(count(f.repo_id) FILTER (f.form < 3 AND f.size_bytes <= 102400) AS VARCHAR)
  FROM checked c JOIN files f ON c.repo_id = f.repo_id GROUP BY c.repo_id"""))
def x1(spark, sf_dir):
    """Runs, rejected addresses, skipped files, unlisted repositories and findings of the reports."""
    result = audit(load(spark, sf_dir, "audit_files").drop("form"), load(spark, sf_dir, "audit_urls"), F.lit("2025-01-02 03:04:05").cast("timestamp"))

    def rows(outcome, df, *detail):
        return df.select(F.lit(outcome).alias("outcome"), "repo_id", F.concat_ws("|", *detail).alias("detail"))

    lists = [F.array_join(name, ",") for name in ("agents_executed", "error_messages")]
    return (
        rows("run", result.runs, "status", *lists)
        .unionByName(rows("rejected", result.rejected, "url", "error"))
        .unionByName(rows("skipped", result.skipped, "warning"))
        .unionByName(rows("unlisted", result.unlisted, F.lit("")))
        .unionByName(rows("report", report_results(result.report.heads), F.col("total_vulnerabilities").cast("string")))
    )
