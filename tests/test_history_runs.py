import datetime as dt

import pytest
from pyspark.sql import functions as F

from codesift.operators import history, runs


def commits(spark, rows):
    return spark.createDataFrame(
        [("r", h, a, f" {h} \n", dt.datetime(2024, 1, d)) for h, a, d in rows],
        "repo_id string, hash string, author string, message string, committed_at timestamp",
    )


def test_head_count_and_contributors(spark):
    table = commits(spark, [("a", "x", 1), ("c", "y", 3), ("b", "z", 3)])
    repos = spark.createDataFrame([("r",), ("empty",)], "repo_id string")
    head = {r.repo_id: r for r in history.head_commit(table, repos).collect()}
    assert (head["r"].commit_hash, head["r"].commit_message, head["r"].commit_date) == ("c", "c", "2024-01-03T00:00:00")
    assert (head["empty"].commit_hash, head["empty"].error is not None) == ("unknown", True)
    assert history.commit_counts(table).first().commit_count == 3
    assert history.recent_contributors(table, newest=2).first().recent_contributors == ["y", "z"]


def test_file_history(spark):
    table = commits(spark, [(f"h{n:02d}", "x", 1 + n) for n in range(12)])
    touched = spark.createDataFrame(
        [("r", f"h{n:02d}", "f") for n in range(12)] + [("r", "h05", "g"), ("r", "h05", "g"), ("r", "gone", "f")],
        "repo_id string, hash string, rel_path string",
    )
    rows = sorted(history.file_history(table, touched).collect(), key=lambda r: (r.rel_path, r.position))
    assert [r.hash for r in rows if r.rel_path == "f"] == [f"h{n:02d}" for n in range(11, 1, -1)]
    assert [(r.hash, r.files_changed) for r in rows if r.rel_path == "g"] == [("h05", 2)]


def test_file_history_of_hot_and_repeated_commits(spark):
    """A commit with most of the files is broadcast, rows given twice count once, a commit listed twice is two entries."""
    table = commits(spark, [("big", "x", 1), ("b", "y", 2), ("c", "z", 3), ("c", "z", 3)])
    rows = [("r", "big", f"f{n}") for n in range(50)] * 2 + [("r", "b", "f0"), ("r", "b", None), ("r", "b", None), ("r", "c", "f0"), (None, "b", "f0")]
    touched = spark.createDataFrame(rows, "repo_id string, hash string, rel_path string")
    got = history.file_history(table, touched).collect()
    assert len(got) == 54
    assert [(r.position, r.hash, r.files_changed) for r in sorted(got, key=lambda r: r.position) if r.rel_path == "f0"] == [
        (1, "c", 1), (2, "c", 1), (3, "b", 2), (4, "big", 50)]
    assert [(r.position, r.hash, r.files_changed) for r in got if r.rel_path is None] == [(1, "b", 2)]
    assert {(r.position, r.hash, r.files_changed) for r in got if r.rel_path not in (None, "f0")} == {(1, "big", 50)}
    keys = touched.withColumn("_commit", F.xxhash64("repo_id", "hash"))
    assert [r._commit for r in history._hot_commits(keys).collect()] == [keys.where("hash = 'big'").first()._commit]


def test_stage_log_and_batch(spark):
    events = spark.createDataFrame(
        [("a", "report", 4, True, None), ("a", "ingestion", 1, True, None), ("a", "static_analysis", 2, False, "bad"),
         ("b", "ingestion", 1, False, "no clone"), ("b", "ingestion", 2, True, None), ("c", "ingestion", 1, True, None)],
        "repo_id string, stage string, ord int, ok boolean, error string",
    )
    log = {r.repo_id: r for r in runs.stage_log(events).collect()}
    assert (log["a"].agents_executed, log["a"].agents_failed, log["a"].error_messages) == (["ingestion", "report"], ["static_analysis"], ["bad"])
    assert (log["b"].agents_failed, log["b"].error_messages) == (["ingestion"], ["no clone"])
    repos = spark.createDataFrame(
        [("a", "ua", None, 3, None, 2.5), ("b", "ub", None, 3, None, 1.0), ("c", "uc", None, 0, None, 1.0),
         ("d", "ud", "timeout", 1, None, 9.0), ("e", "ue", "boom", 1, "no builder", 9.0)],
        "repo_id string, url string, abort string, python_files int, workflow_error string, execution_time_seconds double",
    )
    table = runs.run_table(repos, runs.stage_log(events))
    got = {r.repo_id: r for r in table.collect()}
    assert [got[k].status for k in "abcde"] == ["partial_success", "failure", "success", "timeout", "failure"]
    assert got["c"].error_messages == [runs.NO_FILES]
    assert got["d"].error_messages == ["Pipeline timed out after 1800 seconds"] and got["e"].error_messages == ["Pipeline failed: boom"]
    assert [got[k].execution_time_seconds for k in "abcde"] == [2.5, 1.0, 1.0, 0.0, 0.0]
    summary = spark.createDataFrame([("a", 5, "High"), ("e", 9, "Low")], "repo_id string, total_vulnerabilities bigint, overall_risk string")
    flows = runs.workflow_rows(table, summary)
    assert {r.repo_id: (r.vulnerabilities_found, r.risk_level) for r in flows.collect()} == {
        "a": (5, "High"), "b": (0, "unknown"), "c": (0, "unknown"), "d": (0, "unknown"), "e": (0, "unknown")}
    assert tuple(runs.batch_rollup(flows).first()) == (5, 4, 1, 1, 5)
    assert [(r.repo_id, r.error) for r in runs.failed(flows).collect()] == [("e", "no builder")]
    assert runs.succeeded(flows).count() == 4


def test_stages_of_any_name_count(spark):
    events = spark.createDataFrame(
        [("a", "repo_ingestion", 1, True, None), ("a", "report_generation", 4, False, "Agent report_generation failed: x")],
        "repo_id string, stage string, ord int, ok boolean, error string",
    )
    row = runs.run_table(spark.createDataFrame([("a", "u")], "repo_id string, url string"), runs.stage_log(events)).first()
    assert (row.status, row.agents_executed, row.agents_failed) == ("failure", ["repo_ingestion"], ["report_generation"])


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates_with_offsets(spark, zone):
    """The newest instant counts, not the latest local time, whatever the session's time zone."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [("r", "a", 330, "2025-01-01 00:00:00"), ("r", "b", -150, "2025-01-01 01:00:00"), ("s", "c", None, "2025-03-01 12:00:00")]
        table = spark.createDataFrame(rows, "repo_id string, hash string, offset_minutes int, at string").selectExpr(
            "repo_id", "hash", "' m ' AS message", "'x' AS author", "to_utc_timestamp(to_timestamp(at), 'UTC') AS committed_at", "offset_minutes"
        )
        table = table.withColumn("committed_at", F.from_utc_timestamp("committed_at", F.current_timezone()))
        repos = spark.createDataFrame([("r",), ("s",)], "repo_id string")
        got = {r.repo_id: (r.commit_hash, r.commit_date) for r in history.head_commit(table, repos).collect()}
        assert got == {"r": ("b", "2024-12-31T22:30:00-02:30"), "s": ("c", "2025-03-01T12:00:00+00:00")}
        touched = table.select("repo_id", "hash", F.lit("f.py").alias("rel_path"))
        dates = [r.date for r in history.file_history(table, touched).where("repo_id = 'r'").orderBy("position").collect()]
        assert dates == ["2024-12-31T22:30:00-02:30", "2025-01-01T05:30:00+05:30"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
