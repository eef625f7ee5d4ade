"""Properties of physical plans that decide how a query scales."""

import pytest

from codesift.operators import dependencies, history, risk
from registry import QUERIES
from registry.base import load

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n[0] in "abcdhmprsu" and not n.startswith("s1_")])
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["m3_rule_matches", "p13_all_findings", "s2_excluded_dir_prune", "s7_file_size_gate", "a5_dangerous_calls", "c3_security_score", "d2_requirements"])
def test_narrow_operators_do_not_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Exchange" not in text


def test_top_rows_per_key_are_limited_before_the_shuffle(spark):
    commits = load(spark, SF, "commits")
    assert "WindowGroupLimit" in plan(history.recent_contributors(commits))
    files = load(spark, SF, "dep_files")
    assert "WindowGroupLimit" in plan(dependencies.dependency_context(dependencies.distinct_dependencies(files)))
    assert "WindowGroupLimit" in plan(history.file_history(commits, load(spark, SF, "commit_files")))


def test_files_meet_their_commit_once(spark):
    text = plan(history.file_history(load(spark, SF, "commits"), load(spark, SF, "commit_files")))
    assert text.count("FileScan parquet") == 2 and text.count("Exchange hashpartitioning") <= 3


def test_figures_reduce_before_each_shuffle(spark):
    text = plan(risk.repo_figures(load(spark, SF, "findings"), load(spark, SF, "repos")))
    assert "partial_count" in text and "hashpartitioning(repo_id" in text
    assert text.count("FileScan parquet") == 2


def test_dependency_filter_reaches_the_scan(spark, tmp_path):
    load(spark, SF, "dep_files").write.parquet(str(tmp_path / "t"))
    text = plan(dependencies.parse_dependencies(spark.read.parquet(str(tmp_path / "t"))))
    assert "In(rel_path, [Pipfile" in text
