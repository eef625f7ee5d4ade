"""Commit history.  Input: ``commits`` and ``commit_files`` of many repositories.

``committed_at`` is an instant.  Where ``commits`` has ``offset_minutes``, the committer's
distance from UTC, dates are written in the committer's time with the offset behind;
commits are in the order of their instants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift import settings
from codesift.functions import text
from codesift.operators.joins import SALTS, shuffle_partitions
from codesift.session import durable

HOT_BUCKETS = 1 << 16


def _newest() -> list[Column]:
    return [F.col("committed_at").desc(), F.col("hash").desc()]


def _dates(commits: DataFrame) -> DataFrame:
    """Commits with ``date``, the text of their date."""
    if "offset_minutes" not in commits.columns:
        return commits.withColumn("date", F.date_format("committed_at", "yyyy-MM-dd'T'HH:mm:ss"))
    minutes = F.coalesce("offset_minutes", F.lit(0)).cast("int")
    utc = F.to_utc_timestamp("committed_at", F.current_timezone())
    local = F.date_format(utc + F.make_dt_interval(mins=minutes), "yyyy-MM-dd'T'HH:mm:ss")
    size = F.abs(minutes)
    hours, rest = (F.lpad(part.cast("string"), 2, "0") for part in (F.floor(size / 60), size % 60))
    return commits.withColumn("date", F.concat(local, F.when(minutes < 0, "-").otherwise("+"), hours, F.lit(":"), rest))


def head_commit(commits: DataFrame, repos: DataFrame) -> DataFrame:
    """Newest commit per repository; a repository without commits gets the error form."""
    newest = _dates(commits).groupBy("repo_id").agg(
        F.max_by(F.struct("hash", "message", "author", "date"), F.struct("committed_at", "hash")).alias("head")
    )
    missing = F.col("head").isNull()
    return (
        repos.select("repo_id")
        .join(newest, "repo_id", "left")
        .select(
            "repo_id",
            F.coalesce("head.hash", F.lit("unknown")).alias("commit_hash"),
            text.strip(F.col("head.message")).alias("commit_message"),
            F.col("head.author").alias("author"),
            F.col("head.date").alias("commit_date"),
            F.when(missing, F.lit("Failed to get repository info: no commits")).alias("error"),
        )
    )


def commit_counts(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo_id").agg(F.count("*").alias("commit_count"))


def recent_contributors(commits: DataFrame, newest: int = settings.CONTRIBUTOR_COMMITS) -> DataFrame:
    """Distinct authors of the newest commits.

    Each task sends at most ``newest`` rows per repository and salt, and a first round per
    salt leaves at most ``newest`` times the number of salts for the last one, however
    many tasks hold commits of a repository.
    """
    by_date = Window.partitionBy("repo_id").orderBy(*_newest())
    by_salt = Window.partitionBy("repo_id", "_salt").orderBy(*_newest())
    return (
        commits.select("repo_id", "hash", "author", "committed_at", F.pmod(F.xxhash64("hash"), F.lit(SALTS)).alias("_salt"))
        .withColumn("_n", F.row_number().over(by_salt))
        .where(F.col("_n") <= newest)
        .withColumn("_n", F.row_number().over(by_date))
        .where(F.col("_n") <= newest)
        .groupBy("repo_id")
        .agg(F.array_sort(F.collect_set("author")).alias("recent_contributors"))
    )


def files_changed(commit_files: DataFrame) -> DataFrame:
    """Distinct paths per commit; reduced per (commit, path) before it is counted."""
    return (
        commit_files.select("repo_id", "hash", "rel_path")
        .distinct()
        .groupBy("repo_id", "hash")
        .agg(F.count("*").alias("files_changed"))
    )


def _hot_commits(touches: DataFrame) -> DataFrame:
    """Keys of the commits with more rows than an even share of one partition; fewer than partitions, so safe to broadcast.

    Only commits in a bucket with as many rows are counted one by one; mostly there is none.
    """
    share = max(touches.count() / shuffle_partitions(touches), 1.0)

    def above(rows: DataFrame, key: str) -> DataFrame:
        return durable(rows.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > share).select(key))

    placed = touches.select("_commit", F.pmod("_commit", F.lit(HOT_BUCKETS)).alias("_bucket"))
    full = above(placed, "_bucket")
    return above(placed.join(F.broadcast(full), "_bucket", "left_semi"), "_commit")


def file_history(
    commits: DataFrame, commit_files: DataFrame, newest: int = settings.FILE_HISTORY_COMMITS
) -> DataFrame:
    """The newest commits of every path at once, with the size of each commit.

    Files meet their commit in one shuffle, which also finds repeated rows and the size,
    and go to their path in a second one.  One commit may touch a large share of all files;
    the few such commits are broadcast instead.  Groups are sorted by a hash first, which
    compares faster than texts that begin alike.
    """
    commit = F.xxhash64("repo_id", "hash").alias("_commit")
    on = ["_commit", "repo_id", "hash"]
    touches = commit_files.select(commit, "repo_id", "hash", "rel_path")
    details = _dates(commits).select(
        commit, "repo_id", "hash", "committed_at", text.strip(F.col("message")).alias("message"), "author", "date"
    )
    hot = _hot_commits(touches)
    some_hot = not hot.isEmpty()
    usual = touches.join(F.broadcast(hot), "_commit", "left_anti") if some_hot else touches
    by_commit = Window.partitionBy(*on)
    by_file = by_commit.orderBy("rel_path")
    joined = (
        usual.withColumn("_first", F.rank().over(by_file) == F.row_number().over(by_file))
        .withColumn("files_changed", F.count_if("_first").over(by_commit))
        .where("_first")
        .drop("_first")
        .join(details, on)
    )
    if some_hot:
        touched = durable(touches.join(F.broadcast(hot), "_commit", "left_semi").distinct())
        sizes = touched.groupBy(*on).agg(F.count("*").alias("files_changed"))
        joined = joined.unionByName(touched.join(F.broadcast(details.join(F.broadcast(sizes), on)), on))
    by_date = Window.partitionBy("_path", "repo_id", "rel_path").orderBy(*_newest())
    listed = joined.withColumn("_path", F.xxhash64("repo_id", "rel_path")).withColumn("position", F.row_number().over(by_date))
    return listed.where(F.col("position") <= newest).select(
        "repo_id",
        "rel_path",
        "position",
        "hash",
        "message",
        "author",
        "date",
        "files_changed",
    )
