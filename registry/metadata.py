"""Dependencies and repository metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from codesift.operators import dependencies as ops
from codesift.operators import prompts
from registry.base import load, query, sql

_SPACES = "' ' || chr(9) || chr(13) || chr(10)"


def _cut(column: str, operators: list[str]) -> str:
    for operator in operators:
        column = f"split_part({column}, '{operator}', 1)"
    return f"trim({column}, {_SPACES})"


_ALL = ["==", ">=", "<=", ">", "<", "~="]
_THREE = ["==", ">=", "<="]


def _requirements(source: str) -> str:
    return f"""SELECT repo_id, rel_path, {_cut('line', _ALL)} AS name FROM (
 SELECT repo_id, rel_path, trim(unnest(string_split(content, chr(10))), {_SPACES}) AS line FROM {source}
 WHERE rel_path IN ('requirements.txt', 'requirements-dev.txt', 'requirements-test.txt'))
 WHERE line <> '' AND line NOT LIKE '#%' AND line NOT LIKE '-%' AND {_cut('line', _ALL)} <> ''"""


_PYPROJECT = f"""SELECT repo_id, rel_path, {_cut('item', _THREE)} AS name FROM (
 SELECT repo_id, rel_path, unnest(regexp_extract_all(content, '"([^"]+)"', 1)) AS item FROM dep_forms WHERE rel_path = 'pyproject.toml')
 WHERE regexp_matches(item, '==|>=|<=') AND {_cut('item', _THREE)} <> '' AND {_cut('item', _THREE)} NOT LIKE '-%'"""

_SETUP = rf"""SELECT repo_id, rel_path, {_cut('item', _THREE)} AS name FROM (
 SELECT repo_id, rel_path, unnest(regexp_extract_all(regexp_extract(content, '(?s)install_requires\s*=\s*\[(.*?)\]', 1), '"([^"]+)"', 1)) AS item
 FROM dep_forms WHERE rel_path = 'setup.py') WHERE {_cut('item', _THREE)} <> ''"""

_EVERY = f"{_requirements('dep_forms')} UNION ALL {_PYPROJECT} UNION ALL {_SETUP} UNION ALL {_requirements('dep_files')}"


def _forms(spark, sf_dir):
    return load(spark, sf_dir, "dep_forms")


def _all_files(spark, sf_dir):
    return _forms(spark, sf_dir).unionByName(load(spark, sf_dir, "dep_files"))


@query("d1_dependency_files", sql("dep_forms", "SELECT repo_id, rel_path FROM dep_forms WHERE rel_path NOT LIKE '%/%'"))
def d1(spark, sf_dir):
    return ops.dependency_files(_forms(spark, sf_dir)).select("repo_id", "rel_path")


@query("d2_requirements", sql("dep_forms", _requirements("dep_forms")))
def d2(spark, sf_dir):
    return ops.parse_dependencies(_forms(spark, sf_dir).where("rel_path LIKE 'requirements%'"))


@query("d3_pyproject", sql("dep_forms", _PYPROJECT))
def d3(spark, sf_dir):
    return ops.parse_dependencies(_forms(spark, sf_dir).where("rel_path = 'pyproject.toml'"))


@query("d4_setup", sql("dep_forms", _SETUP))
def d4(spark, sf_dir):
    return ops.parse_dependencies(_forms(spark, sf_dir).where("rel_path = 'setup.py'"))


@query("d5_distinct_dependencies", sql("dep_forms dep_files", f"SELECT DISTINCT repo_id, name FROM ({_EVERY})"))
def d5(spark, sf_dir):
    return ops.distinct_dependencies(_all_files(spark, sf_dir))


def _pick(kind: str, names: list[str], chars: int) -> str:
    order = "CASE rel_path " + " ".join(f"WHEN '{name}' THEN {n}" for n, name in enumerate(names)) + " END"
    listed = ", ".join(f"'{name}'" for name in names)
    return f"""SELECT repo_id, '{kind}' AS kind, CAST(length(cut) AS INTEGER) AS chars, md5(cut) AS digest FROM (
 SELECT repo_id, left(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), {chars}) AS cut,
  row_number() OVER (PARTITION BY repo_id ORDER BY {order}) AS n FROM meta_files WHERE rel_path IN ({listed})) WHERE n = 1"""


@query("d6_readme_and_licence", sql("meta_files", _pick("readme", ["README.md", "README.txt", "README.rst", "README"], 5000)
                                    + " UNION ALL " + _pick("licence", ["LICENSE", "LICENSE.txt", "LICENSE.md", "COPYING"], 1000)))
def d6(spark, sf_dir):
    files = load(spark, sf_dir, "meta_files")

    def digest(rows, kind, column):
        return rows.select("repo_id", F.lit(kind).alias("kind"), F.length(column).alias("chars"), F.md5(column).alias("digest"))

    return digest(ops.readme(files), "readme", "readme_content").unionByName(
        digest(ops.licence(files), "licence", "license_info")
    )


CONTEXT_SQL = f"""SELECT repo_id, chr(10) || chr(10) || 'Repository dependencies: ' || string_agg(name, ', ' ORDER BY name) AS context FROM (
 SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY name) AS n FROM (SELECT DISTINCT repo_id, name FROM ({_EVERY}))) WHERE n <= 10 GROUP BY repo_id"""


@query("d7_dependency_context", sql("dep_forms dep_files code_files", f"""
SELECT f.repo_id, f.rel_path, coalesce(c.context, '') AS context FROM code_files f LEFT JOIN ({CONTEXT_SQL}) c ON f.repo_id = c.repo_id"""))
def d7(spark, sf_dir):
    contexts = ops.dependency_context(ops.distinct_dependencies(_all_files(spark, sf_dir)))
    files = load(spark, sf_dir, "code_files").select("repo_id", "rel_path")
    return prompts.with_context(files, contexts)
