"""Scans, sources and file-level filters."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from codesift.functions import text
from codesift.operators import contracts
from codesift.operators import files as ops
from codesift.session import checkpoint_dir
from codesift.sources import tree, tree_source
from registry.base import load, query, sql, table

_EXCLUDED = r"(^|/)(\.git|__pycache__|\.pytest_cache|node_modules|\.venv|venv|env)/"


@query("s2_excluded_dir_prune", sql("tree_files", f"SELECT * FROM tree_files WHERE NOT regexp_matches(rel_path, '{_EXCLUDED}')"))
def s2(spark, sf_dir):
    return ops.prune_excluded(load(spark, sf_dir, "tree_files"))


@query("s3_extension_filter", sql("tree_files", "SELECT repo_id, rel_path FROM tree_files WHERE rel_path LIKE '%.py'"))
def s3(spark, sf_dir):
    return ops.python_files(load(spark, sf_dir, "tree_files")).select("repo_id", "rel_path")


@query("s4_total_files", sql("tree_files", f"""
SELECT repo_id, count(*) AS total_files FROM tree_files WHERE NOT regexp_matches(rel_path, '{_EXCLUDED}') GROUP BY repo_id"""))
def s4(spark, sf_dir):
    return ops.total_files(load(spark, sf_dir, "tree_files"))


@query("s5_repo_size_mb", sql("tree_files", """
SELECT repo_id, CAST(sum(size_bytes) AS BIGINT) / 1048576.0::DOUBLE AS size_mb FROM tree_files GROUP BY repo_id"""))
def s5(spark, sf_dir):
    return ops.repo_sizes(load(spark, sf_dir, "tree_files"))


# The limit is put within the range of the supplied data so that both outcomes occur.
_LIMIT_SQL = "SELECT repo_id, sum(size_bytes) / 1048576.0::DOUBLE AS size_mb FROM tree_files GROUP BY repo_id"


@query("s6_repo_size_gate_rejected", sql("tree_files", f"""
SELECT repo_id, size_mb, printf('Repository size (%.1fMB) exceeds limit (90MB)', size_mb) AS error FROM ({_LIMIT_SQL}) WHERE size_mb > 90"""))
def s6_rejected(spark, sf_dir):
    return ops.oversized_repos(load(spark, sf_dir, "tree_files"), 90)


@query("s6_repo_size_gate_accepted", sql("tree_files", f"""
SELECT t.* FROM tree_files t JOIN ({_LIMIT_SQL}) s ON t.repo_id = s.repo_id WHERE s.size_mb <= 90"""))
def s6_accepted(spark, sf_dir):
    return ops.accepted_files(load(spark, sf_dir, "tree_files"), 90)


@query("s7_file_size_gate", sql("tree_files", "SELECT * FROM tree_files WHERE size_bytes <= 102400"))
def s7(spark, sf_dir):
    return ops.analyzable(load(spark, sf_dir, "tree_files"))


@query("s7_skipped_large_files", sql("tree_files", """
SELECT repo_id, rel_path, size_bytes, 'Skipping large file: ' || rel_path || printf(' (%.1fKB)', size_bytes / 1024.0::DOUBLE) AS warning
FROM tree_files WHERE size_bytes > 102400"""))
def s7_skipped(spark, sf_dir):
    return ops.skipped_large(load(spark, sf_dir, "tree_files"))


@query("s8_tolerant_decode", """
SELECT doc_id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS digest FROM (
 SELECT doc_id, replace(replace('a' || text || 'b', chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents)""")
def s8(spark, sf_dir):
    # bytes that are valid nowhere, a lone lead byte and a cut sequence, around the text
    raw = F.concat(F.unhex(F.lit("61FFFE")), F.encode("text", "UTF-8"), F.unhex(F.lit("62C3F09F")))
    documents = table(spark, sf_dir, "documents").select("doc_id", text.decode_utf8(raw).alias("t"))
    return documents.select("doc_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


@query("s9_blank_file_filter", sql("maybe_blank_files", r"""
SELECT repo_id, rel_path FROM maybe_blank_files WHERE regexp_matches(content, '[^\s\x1c-\x1f]')"""))
def s9(spark, sf_dir):
    return ops.not_blank(load(spark, sf_dir, "maybe_blank_files")).select("repo_id", "rel_path")


@query("s10_response_source", sql("responses", """
SELECT repo_id, kind, count(*) AS responses, CAST(sum(length(response)) AS BIGINT) AS chars FROM responses GROUP BY repo_id, kind"""))
def s10(spark, sf_dir):
    rows = contracts.require(load(spark, sf_dir, "responses"), contracts.RESPONSES)
    return rows.groupBy("repo_id", "kind").agg(
        F.count("*").alias("responses"), F.sum(F.length("response")).alias("chars")
    )


@query("s11_commit_log_source", sql("commits", """
SELECT repo_id, hash, author, message, strftime(committed_at, '%Y-%m-%d %H:%M:%S') AS committed FROM commits"""))
def s11(spark, sf_dir):
    rows = contracts.require(load(spark, sf_dir, "commits"), contracts.COMMITS)
    return rows.withColumn("committed", F.date_format("committed_at", "yyyy-MM-dd HH:mm:ss")).drop("committed_at")


_TREE = """SELECT source AS repo_id, lang || '/_d' || CAST(doc_id % 7 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.py' AS rel_path,
 CAST(strlen(text) AS BIGINT) AS size_bytes,
 md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM documents"""


def _written_tree(spark, sf_dir):
    """Every document as a file in the shared folder: the root, and the repositories."""
    shared = checkpoint_dir(spark).removeprefix("file:")
    if ":" in shared:
        raise ValueError("a source tree needs a folder that is mounted as a file system")
    root = os.path.join(shared, f"tree-{uuid.uuid4().hex}")

    def write(batches):
        for batch in batches:
            for repo, path, content in zip(*(column.to_pylist() for column in batch.columns)):
                target = os.path.join(root, repo, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as handle:
                    handle.write(content.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["written"])

    path = F.concat("lang", F.lit("/_d"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py"))
    documents = table(spark, sf_dir, "documents").select("source", path.alias("rel_path"), "text")
    documents.mapInArrow(write, "written bigint").write.format("noop").mode("overwrite").save()
    return root, documents.select(F.col("source").alias("repo_id")).distinct()


@query("s1_source_tree_scan", _TREE)
def s1(spark, sf_dir):
    """Every document is written as a file to the shared folder, then read back as a tree."""
    root, repos = _written_tree(spark, sf_dir)
    found = tree.read_contents(tree.list_tree(spark, root, repos), root)
    return found.select("repo_id", "rel_path", "size_bytes", F.md5("content").alias("digest"))


@query("s1_tree_source", f"SELECT * FROM ({_TREE}) WHERE rel_path NOT LIKE '%/\\_d3/%' ESCAPE '\\' AND size_bytes <= 102400 AND rel_path LIKE '%.py'")
def s1_source(spark, sf_dir):
    """The tree as a data source: a directory left out by name, gates on path and size that reach the walk."""
    root, _ = _written_tree(spark, sf_dir)
    found = ops.analyzable(tree_source.read_tree(spark, root, ["_d3"], contents=True).where(F.col("size_bytes") <= 100 * 1024)).where(F.col("rel_path").endswith(".py"))
    return found.select("repo_id", "rel_path", "size_bytes", F.md5(text.decode_utf8(F.col("raw"))).alias("digest"))
