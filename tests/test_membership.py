"""Lists and contexts of any size, without moving text."""

import re

import pytest
from pyspark.sql import functions as F

from codesift.operators import files as file_ops
from codesift.operators import joins, membership, prompts
from codesift.plans.audit import audit
from codesift.sources import bucketed


def moved(df):
    """Columns that each shuffle of a plan takes in."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [set(re.findall(r"(\w+)#", found)) for found in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)]


@pytest.fixture(scope="module")
def many(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 500 == 1, None).otherwise(F.concat(F.lit("repo_"), (F.col("id") % 9000).cast("string"))).alias("repo_id"),
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("rel_path"),
        F.lit(1).cast("long").alias("size_bytes"),
        F.lit("text").alias("content"),
    )
    keys = spark.range(0, 20_000, 2).select(F.concat(F.lit("repo_"), F.col("id").cast("string")).alias("repo_id"))
    return rows, keys


@pytest.mark.parametrize("max_bytes", [1 << 26, 60_000, 25_000])
def test_list_is_exact_at_any_size(many, max_bytes):
    """Broadcast, one cascade, and several slices with filters that are too small for their keys."""
    rows, keys = many
    twice = keys.unionByName(keys).unionByName(keys.limit(1).select(F.lit(None).cast("string").alias("repo_id")))
    got = membership.without(rows, twice, "repo_id", max_bytes)
    assert got.columns == rows.columns
    want = rows.join(keys.distinct(), "repo_id", "left_anti").select(*rows.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and want.where("repo_id IS NULL").count() > 0
    assert not any("content" in columns for columns in moved(got))


def test_a_list_that_names_all_or_none(many):
    rows, keys = many
    named = rows.select("repo_id").distinct()
    assert [r.repo_id for r in membership.without(rows, named, "repo_id", 20_000).select("repo_id").distinct().collect()] == [None]
    assert membership.without(rows, keys.limit(0), "repo_id", 10).count() == rows.count()
    assert membership.without(rows.limit(0), keys, "repo_id", 20_000).isEmpty()


def test_size_gate_without_a_shuffle_of_text(spark, many, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = many[0].withColumn("size_bytes", F.when(F.crc32("repo_id") % 2 == 0, 900 << 20).otherwise(1).cast("long"))
        monkeypatch.setattr(membership.listed, "__defaults__", (30_000,))
        monkeypatch.setattr(membership.without, "__defaults__", (30_000,))
        got = file_ops.accepted_files(rows)
        assert not any("content" in columns for columns in moved(got)) and moved(rows.groupBy("content").count())
        sizes = {r.repo_id: r.size_mb for r in file_ops.repo_sizes(rows).collect()}
        assert got.count() == sum(r.repo_id is None or sizes[r.repo_id] <= 500 for r in rows.select("repo_id").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("max_bytes", [1 << 26, 1000])
def test_contexts_meet_bucketed_files(spark, many, monkeypatch, max_bytes):
    """Contexts above the limit are shuffled, the text is not; a repository with a third of all files is in many tasks."""
    monkeypatch.setattr(joins, "BROADCAST_BYTES", max_bytes)
    monkeypatch.setattr(bucketed.join_small, "__defaults__", (max_bytes,))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = bucketed.write_files(many[0], f"bucketed_files_{max_bytes}", 16)
        contexts = many[1].unionByName(spark.createDataFrame([("hot",)], "repo_id string")).select("repo_id", F.concat(F.lit("needs "), "repo_id").alias("context"))
        got = prompts.with_context(table, contexts)
        assert not any("content" in columns for columns in moved(got))
        want = many[0].join(contexts, "repo_id", "left").select("repo_id", "rel_path", F.coalesce("context", F.lit("")).alias("context"))
        rows = got.select("repo_id", "rel_path", "context")
        assert rows.exceptAll(want).isEmpty() and rows.count() == want.count()
        tasks = got.where("repo_id = 'hot'").groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(tasks) >= 8 and max(t["count"] for t in tasks) < 5000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE IF EXISTS bucketed_files_{max_bytes}")


def test_address_check_is_an_argument(spark, files):
    rows = files([("r1", "a.py", "x = 1\n"), ("r2", "a.py", "x = 1\n")])
    urls = spark.createDataFrame([("r1", "ftp://h/o/r"), ("r2", "https://h/o/r")], "repo_id string, url string")
    result = audit(rows, urls, F.lit("2025-01-02 03:04:05").cast("timestamp"), is_valid=lambda url: url.startswith("ftp:"))
    assert {r.repo_id: r.status for r in result.runs.collect()} == {"r1": "success", "r2": "failure"}
    assert [(r.repo_id, r.error) for r in result.rejected.collect()] == [("r2", "Invalid input data")]
