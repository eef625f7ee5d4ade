import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, StringStartsWith

from codesift.operators import contracts, files as ops
from codesift.operators import dependencies
from codesift.sources import tree, tree_source
from codesift.sources.facts import extract_facts

PATHS = [".git/h.py", "a/venv/b.py", "venvx/b.py", "pkg/__init__.py", "a.pyi", "A.PY", "env", "src/env", "x/.venv/y/z.py", "setup.py", "n.rs"]


def paths(df):
    return sorted(row.rel_path for row in df.collect())


@pytest.fixture
def listing(files):
    return files([("r", path, "x") for path in PATHS])


def test_prune_and_extensions(listing):
    kept = ops.prune_excluded(listing)
    assert paths(kept) == sorted(["venvx/b.py", "pkg/__init__.py", "a.pyi", "A.PY", "env", "src/env", "setup.py", "n.rs"])
    assert paths(ops.python_files(kept)) == ["pkg/__init__.py", "setup.py", "venvx/b.py"]
    assert ops.python_files(kept, [".txt", ".pyi"]).count() == 0
    assert ops.total_files(listing).first().total_files == 8


def test_size_gates(spark):
    mb = 1048576
    rows = spark.createDataFrame(
        [("a", "x.py", 102400), ("a", "y.py", 102401), ("b", ".git/big", 500 * mb), ("c", "z.py", 500 * mb), ("c", "one", 1)],
        "repo_id string, rel_path string, size_bytes bigint",
    )
    assert paths(ops.analyzable(rows)) == ["one", "x.py"]
    assert {r.rel_path: r.warning for r in ops.skipped_large(rows).collect()}["y.py"] == "Skipping large file: y.py (100.0KB)"
    rejected = ops.oversized_repos(rows).collect()
    assert [(r.repo_id, r.error) for r in rejected] == [("c", "Repository size (500.0MB) exceeds limit (500MB)")]
    assert sorted({r.repo_id for r in ops.accepted_files(rows).collect()}) == ["a", "b"]


def test_blank_files(files):
    rows = files([("r", "a", ""), ("r", "b", "\t \n"), ("r", "c", " "), ("r", "d", " x ")])
    assert paths(ops.not_blank(rows)) == ["d"]


def test_source_tree_lists_hidden_and_underscored_names(spark, tmp_path):
    content = {"r1/pkg/__init__.py": b"", "r1/.git/c": b"12", "r1/a/b/c/d.py": b"x\r\ny\xff", "r2/_x.py": b"1"}
    for path, data in content.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    repos = spark.createDataFrame([("r1",), ("r2",), ("gone",)], "repo_id string")
    listed = tree.list_tree(spark, str(tmp_path), repos)
    assert {(f"{r.repo_id}/{r.rel_path}", r.size_bytes) for r in listed.collect()} == {(k, len(v)) for k, v in content.items()}
    read = tree.read_contents(listed.where("rel_path LIKE '%.py'"), str(tmp_path))
    assert {r.rel_path: (r.content, r.strict_utf8) for r in read.collect()} == {"pkg/__init__.py": ("", True), "a/b/c/d.py": ("x\ny", False), "_x.py": ("1", True)}


def test_links_and_unreadable_files(spark, tmp_path):
    (tmp_path / "r/real").mkdir(parents=True)
    (tmp_path / "r/real/a.py").write_bytes(b"eval(1)")
    (tmp_path / "r/README.md").write_bytes(b"bad \xff bytes")
    (tmp_path / "r/README.txt").write_bytes(b"good")
    (tmp_path / "r/linked").symlink_to(tmp_path / "r/real")
    (tmp_path / "r/gone.py").symlink_to(tmp_path / "r/nothing.py")
    (tmp_path / "r/also.py").symlink_to(tmp_path / "r/real/a.py")
    listed = tree.list_tree(spark, str(tmp_path), spark.createDataFrame([("r",)], "repo_id string"))
    assert {(r.rel_path, r.size_bytes) for r in listed.collect()} == {("real/a.py", 7), ("README.md", 11), ("README.txt", 4), ("gone.py", 0), ("also.py", 7)}
    read = tree.read_contents(listed, str(tmp_path))
    assert dependencies.readme(read).first().readme_content == "good"
    facts = {r.rel_path: r.parse_error for r in extract_facts(ops.python_files(read)).collect()}
    assert facts["real/a.py"] is None and facts["also.py"] is None and "No such file" in facts["gone.py"]


def test_contract(spark):
    with pytest.raises(ValueError, match="missing columns: rel_path"):
        contracts.require(spark.createDataFrame([("r",)], "repo_id string"), "repo_id string, rel_path string")


def test_stage_inputs_keep_empty_repos(spark, files):
    repos = spark.createDataFrame([("r",), ("empty",)], "repo_id string")
    python = files([("r", "a.py", "x" * 200_000)])
    got = {r.repo_id: tuple(r)[1:] for r in contracts.stage_inputs(repos, python, ops.analyzable(python)).collect()}
    assert got == {"r": (1, 0, True), "empty": (0, 0, False)}


def test_size_scan_reads_no_content(spark, files, tmp_path):
    files([("r", "a.py", "x")]).write.parquet(str(tmp_path / "t"))
    plan = ops.repo_sizes(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<repo_id:string,size_bytes:bigint>" in plan


@pytest.fixture
def source_tree(tmp_path):
    """Three repositories; a deep one, excluded directories, links, an unreadable link."""
    for repo, path in [("a", "x.py"), ("a", "p/q/r/s/deep.py"), ("a", "p/_init.md"), ("a", "p/q/.git/no.py"), ("a", "venv/no.py"), ("b", ".hidden.py"), ("b", "p/big.py"), ("c", "só/ü.py")]:
        file = tmp_path / "root" / repo / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"\xff" * 300 if "big" in path else path.encode())
    (tmp_path / "root/b/link.py").symlink_to("nowhere")
    (tmp_path / "root/b/loop").symlink_to(tmp_path / "root")
    (tmp_path / "root/file.py").write_text("not a repository")
    return str(tmp_path / "root")


ALL = {("a", "x.py"), ("a", "p/q/r/s/deep.py"), ("a", "p/_init.md"), ("b", ".hidden.py"), ("b", "p/big.py"), ("b", "link.py"), ("c", "só/ü.py")}


@pytest.mark.parametrize("partitions", [1, 4, 100])
def test_tree_source(spark, source_tree, partitions):
    """However many directories the driver opens, the rows are those of the walk."""
    rows = tree_source.read_tree(spark, source_tree, [".git", "venv"], contents=True, partitions=partitions).collect()
    assert sorted((r.repo_id, r.rel_path) for r in rows) == sorted(ALL)
    by_path = {r.rel_path: r for r in rows}
    assert bytes(by_path["só/ü.py"].raw).decode() == "só/ü.py" and by_path["p/big.py"].size_bytes == 300
    assert by_path["link.py"].raw is None and "nowhere" in by_path["link.py"].read_error + "nowhere" and by_path["link.py"].size_bytes == 0


def test_tree_source_agrees_with_the_listing(spark, source_tree):
    repos = spark.createDataFrame([("a",), ("b",), ("c",)], "repo_id string")
    want = tree.list_tree(spark, source_tree, repos)
    got = tree_source.read_tree(spark, source_tree)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == len(ALL) + 2


@pytest.mark.parametrize(("condition", "listed", "paths"), [
    ("repo_id = 'b'", {("b", ""), ("b", "p")}, {".hidden.py", "p/big.py", "link.py"}),
    ("repo_id IN ('c', 'z', '..') AND size_bytes > 3", {("c", ""), ("c", "só")}, {"só/ü.py"}),
    ("rel_path LIKE 'p/q/%' AND repo_id = 'a'", {("a", ""), ("a", "p"), ("a", "p/q"), ("a", "p/q/r"), ("a", "p/q/r/s")}, {"p/q/r/s/deep.py"}),
    ("rel_path = 'x.py'", {("a", ""), ("b", ""), ("c", "")}, {"x.py"}),
    ("rel_path LIKE '%.py' AND size_bytes <= 100 AND rel_path <> 'x.py'", None, {"p/q/r/s/deep.py", ".hidden.py", "link.py", "só/ü.py"}),
])
def test_filters_reach_the_walk(spark, source_tree, monkeypatch, condition, listed, paths):
    """Directories that a filter or a name rules out are never listed; all filters hold."""
    table = tree_source.read_tree(spark, source_tree, [".git", "venv"]).where(condition)
    assert {r.rel_path for r in table.collect()} == paths
    if listed is None:
        return
    asked = []
    entries = tree._entries
    monkeypatch.setattr(tree_source, "_entries", lambda root, repo, folder: asked.append((repo, folder)) or entries(root, repo, folder))
    pushed = {
        "repo_id = 'b'": [EqualTo(("repo_id",), "b")], "rel_path = 'x.py'": [EqualTo(("rel_path",), "x.py")],
        "repo_id IN ('c', 'z', '..') AND size_bytes > 3": [In(("repo_id",), ("c", "z", "..")), GreaterThan(("size_bytes",), 3)],
        "rel_path LIKE 'p/q/%' AND repo_id = 'a'": [StringStartsWith(("rel_path",), "p/q/"), EqualTo(("repo_id",), "a")],
    }[condition]
    reader = tree_source.TreeReader({"path": source_tree, "excluded": ".git,venv", "partitions": "2"})
    assert list(reader.pushFilters([*pushed, IsNotNull(("rel_path",))])) == [IsNotNull(("rel_path",))]
    rows = [row for part in reader.partitions() for row in reader.read(part)]
    assert {path for _, path, _ in rows} == paths and set(asked) == listed
