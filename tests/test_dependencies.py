import pytest

from codesift.operators import dependencies as ops


def names(files, path, content):
    return [r.name for r in ops.parse_dependencies(files([("r", path, content)])).collect()]


@pytest.mark.parametrize(
    ("line", "wanted"),
    [("a==1", ["a"]), ("a>=1,<2", ["a"]), ("a~=1", ["a"]), ("a~==1", ["a~"]), ("a!=1", ["a!=1"]), ("a[x]; m", ["a[x]; m"]),
     ("a # c", ["a # c"]), ("# c", []), ("-r f", []), ("   ", []), (" a <1", ["a"]), ("==1", []), ("b<=2\r\nc>1", ["b", "c"])],
)
def test_requirements(files, line, wanted):
    assert names(files, "requirements.txt", line) == wanted
    assert names(files, "requirements-dev.txt", f"\n{line}\n") == wanted
    assert names(files, "requirements-other.txt", line) == []
    assert names(files, "sub/requirements.txt", line) == []


def test_pyproject(files):
    text = 'requires-python = ">=3.9"\nd = ["a>=1", "b~=1", "c", "-x==1", "e ==2", "f<=1"]'
    assert names(files, "pyproject.toml", text) == ["a", "e", "f"]
    # quotes pair up across lines
    assert names(files, "pyproject.toml", '"\nx>=1 "y"') == ["x"]


def test_setup(files):
    assert names(files, "setup.py", 'setup(install_requires = [\n "a>=1",\n "b"\n], x=["c==1"])') == ["a", "b"]
    assert names(files, "setup.py", "nothing") == []
    assert names(files, "Pipfile", "a==1") == []


def test_setup_list_stops_at_first_bracket(files):
    assert names(files, "setup.py", 'install_requires=["a>=1","b[x]","c"]') == ["a"]


def test_distinct_and_context(files):
    many = "\n".join(f"p{n:02d}==1" for n in range(15))
    rows = files([("r", "requirements.txt", many), ("r", "requirements-test.txt", "p00\nB"), ("s", "setup.py", "")])
    distinct = ops.distinct_dependencies(rows)
    assert distinct.count() == 16
    context = ops.dependency_context(distinct).collect()
    assert [(r.repo_id, r.context) for r in context] == [("r", "\n\nRepository dependencies: B, " + ", ".join(f"p{n:02d}" for n in range(9)))]


def test_metadata_priority_and_limits(spark, files):
    rows = files([("r", "README.txt", "t"), ("r", "README.rst", "x"), ("r", "docs/README.md", "no"), ("r", "COPYING", "c" * 2000), ("s", "README", "r" * 6000)])
    assert {r.repo_id: len(r.readme_content) for r in ops.readme(rows).collect()} == {"r": 1, "s": 5000}
    assert [(r.repo_id, len(r.license_info)) for r in ops.licence(rows).collect()] == [("r", 1000)]


def test_unreadable_readme_falls_back(spark):
    rows = spark.createDataFrame([("r", "README.md", bytearray(b"\xff")), ("r", "README", bytearray(b"ok"))], "repo_id string, rel_path string, raw binary")
    rows = rows.selectExpr("repo_id", "rel_path", "CAST(raw AS STRING) AS content")
    assert [r.readme_content for r in ops.readme(rows).collect()] == ["ok"]
