"""Registration of queries and the input tables they derive from the supplied ones.

An input is a list of select expressions over one supplied table.  Its text is read by
Spark (``selectExpr``) and by the SQL oracle alike, so both start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

INPUTS: dict[str, tuple[str, list[str]]] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = INPUTS[name]
    return table(spark, sf_dir, source).selectExpr(*columns)


def sql(inputs: str, body: str) -> str:
    """The oracle text: the named inputs as common table expressions, then ``body``."""
    parts = [f"{name} AS (SELECT {', '.join(INPUTS[name][1])} FROM {INPUTS[name][0]})" for name in inputs.split()]
    rest = body.strip()
    if rest.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {rest[5:]}"
    return f"WITH {', '.join(parts)} {rest}"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


_REPO = "'repo_' || CAST({} % 20 AS STRING) AS repo_id"

# --- source files ------------------------------------------------------------
INPUTS["tree_files"] = ("lineitem", [
    "'repo_' || CAST(l_suppkey AS STRING) AS repo_id",
    """CASE l_partkey % 9 WHEN 0 THEN '.git/' WHEN 1 THEN 'src/venv/' WHEN 2 THEN 'venvx/' WHEN 3 THEN 'a/__pycache__/b/'
     WHEN 4 THEN '' WHEN 5 THEN 'node_modules/' ELSE 'pkg/sub/' END || 'f_' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING)
     || CASE l_quantity % 7 WHEN 0 THEN '.pyi' WHEN 1 THEN '.PY' WHEN 2 THEN '.md' WHEN 3 THEN '/env' ELSE '.py' END AS rel_path""",
    "CAST(floor(l_extendedprice * 3) AS BIGINT) AS size_bytes",
])
INPUTS["code_files"] = ("part", [
    _REPO.format("p_partkey"),
    "'pkg' || CAST(p_size % 7 AS STRING) || '/mod_' || CAST(p_partkey AS STRING) || '.py' AS rel_path",
    """'import os' || chr(10) || CASE p_size % 4
      WHEN 0 THEN 'x = eval("' || p_name || '")'
      WHEN 1 THEN 'password = "' || p_brand || '"'
      WHEN 2 THEN 'def f(a):' || chr(10) || '    return "{}".format(a)'
      ELSE 'import pickle' || chr(10) || 'y = pickle.loads(b"")' END || chr(10) AS content""",
    "p_size % 4 AS form",
])
INPUTS["fact_files"] = ("part", [
    _REPO.format("p_partkey"),
    "'m_' || CAST(p_partkey AS STRING) || '.py' AS rel_path",
    """CASE p_size % 8
      WHEN 0 THEN 'import os.path as p, sys' || chr(10) || 'from . import x' || chr(10) || 'from m import a, b as c'
      WHEN 1 THEN 'class C(Base, mod.Other):' || chr(10) || '    def m(self, a, /, b, *, c): pass'
      WHEN 2 THEN 'async def g(): pass' || chr(10) || '@dec' || chr(10) || '@app.route(1)' || chr(10) || 'def h(a, b=1, *args, **kw): return eval(a)'
      WHEN 3 THEN 'x = y = 1' || chr(10) || '(a, b) = 1, 2' || chr(10) || 'z: int = 3' || chr(10) || 'z += 1' || chr(10) || 'obj.attr = 2'
      WHEN 4 THEN 'os.system("ls")' || chr(10) || 'subprocess.run(["a"], check=True)' || chr(10) || 'f()()' || chr(10) || 'ev = eval' || chr(10) || 'ev("1")'
      WHEN 5 THEN 'def broken(:'
      WHEN 6 THEN 'import pickle, subprocess' || chr(10) || 'from posixpath import join' || chr(10) || 'pickle.loads(b"")'
      ELSE '' END AS content""",
    "p_size % 8 AS form",
])
INPUTS["hit_files"] = ("part", [
    _REPO.format("p_partkey"),
    "'h_' || CAST(p_partkey AS STRING) || '.py' AS rel_path",
    """'# ' || p_name || chr(10) || CASE p_size % 6
      WHEN 0 THEN 'password = "' || p_brand || '"; PASSWORD="x' || p_type || '"'
      WHEN 1 THEN 'api_key="k' || CAST(p_partkey AS STRING) || '"'
      WHEN 2 THEN '  Secret = ' || chr(39) || p_name || chr(39)
      WHEN 3 THEN 'q = "SELECT * FROM t WHERE a=" + b  # ' || p_name
      WHEN 4 THEN '"{}".format(x) + "{}".FORMAT (' || CAST(p_size AS STRING) || ')'
      ELSE 'msg = f"hello {name} ' || p_type || '" + f"{a}"' END || chr(10) || 'end' AS content""",
])
INPUTS["doc_files"] = ("documents", [
    "source AS repo_id",
    "lang || '/doc_' || CAST(doc_id AS STRING) || '.py' AS rel_path",
    "text AS content",
])
INPUTS["maybe_blank_files"] = ("documents", [
    "source AS repo_id",
    "'d_' || CAST(doc_id AS STRING) || '.py' AS rel_path",
    "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN chr(9) || ' ' || chr(10) || chr(28) ELSE text END AS content",
])

# --- dependencies and metadata -----------------------------------------------
INPUTS["dep_files"] = ("supplier", [
    _REPO.format("s_suppkey"),
    "'requirements.txt' AS rel_path",
    """'# pinned' || chr(10) || 'lib_' || CAST(s_nationkey AS STRING) || CASE s_suppkey % 3 WHEN 0 THEN '==1.0' WHEN 1 THEN '>=2,<3' ELSE '~=1.4' END
     || chr(10) || '-r base.txt' || chr(10) || 'extra_' || CAST(s_suppkey AS STRING) || chr(10) AS content""",
])
INPUTS["dep_forms"] = ("part", [
    _REPO.format("p_partkey"),
    """CASE p_partkey % 7 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'requirements-dev.txt' WHEN 2 THEN 'requirements-test.txt'
     WHEN 3 THEN 'pyproject.toml' WHEN 4 THEN 'setup.py' WHEN 5 THEN 'Pipfile' ELSE 'sub/requirements.txt' END AS rel_path""",
    """CASE WHEN p_partkey % 7 = 3 THEN '[project]' || chr(10) || 'requires-python = ">=3.9"' || chr(10) || 'dependencies = ["p' || CAST(p_size AS STRING)
      || '>=1", "q~=2", "r", "-s==1", "t' || CAST(p_size AS STRING) || ' <=2,>=1"]' || chr(10)
     WHEN p_partkey % 7 = 4 THEN 'setup(name="n", install_requires = [' || chr(10) || '  "s' || CAST(p_size AS STRING) || '>=1", "u[x]", "v==2"], extras=["w==1"])'
     ELSE ' a' || CAST(p_size AS STRING) || ' == 1' || chr(10) || 'b>=1,<2' || chr(10) || 'c~=1' || chr(10) || 'd~==1' || chr(10) || 'e!=1' || chr(10)
      || 'g[x]; m' || chr(10) || 'h # c' || chr(10) || '# c' || chr(10) || '-r f' || chr(10) || '  ' || chr(10) || '==9' || chr(10) || 'i>2' END AS content""",
])
INPUTS["meta_files"] = ("documents", [
    "'repo_' || CAST(CAST(floor(doc_id / 8) AS BIGINT) AS STRING) AS repo_id",
    """CASE WHEN doc_id % 5 < 2 THEN 'docs/' ELSE '' END || CASE (doc_id * 7 + CAST(floor(doc_id / 8) AS BIGINT)) % 8
     WHEN 0 THEN 'README.md' WHEN 1 THEN 'README.txt' WHEN 2 THEN 'README.rst' WHEN 3 THEN 'README'
     WHEN 4 THEN 'LICENSE' WHEN 5 THEN 'LICENSE.txt' WHEN 6 THEN 'LICENSE.md' ELSE 'COPYING' END AS rel_path""",
    "text AS content",
])
INPUTS["repo_urls"] = ("pages", [
    "page_id",
    """CASE page_id % 11 WHEN 0 THEN url || '.git' WHEN 1 THEN url || '/' WHEN 2 THEN 'https://h' WHEN 3 THEN 'ftp://h/o/r' WHEN 4 THEN ''
     WHEN 5 THEN NULL WHEN 6 THEN 'HTTPS' || substring(url, 6) WHEN 7 THEN 'https:///a/b' WHEN 8 THEN 'o/' || CAST(page_id AS STRING) ELSE url END AS repo_url""",
])

# --- model responses ----------------------------------------------------------
_FORMS = [
    "'No issues. []'",
    "'Possible injection [see notes ' || CAST(o_orderkey AS STRING) || ']'",
    "'nothing to report'",
    "'] an injection ['",
    """'Result: [{"vulnerability_type":"sql_injection","severity":"high","line_number":' || CAST(o_custkey AS STRING) || ',"description":"d","code_snippet":"c","recommendation":"r","cwe_id":"CWE-89","confidence":0.' || CAST(o_orderkey % 10 AS STRING) || '}] end'""",
    "'Answer: [{}]'",
    """'[{"severity":"low","confidence":0.2},{"confidence":null},{"severity":"high"}]'""",
    """'[{"severity":"high","cwe_id":89}]'""",
    """'[{"confidence":"0.95","severity":"CRITICAL","description":"x"}, {"confidence":true,"severity":"low"}]'""",
    """'[{"line_number":"12"},{"line_number":42.0},{"line_number":null}]'""",
    """'[{"line_number":7},{"line_number":42.5},{"line_number":8}]'""",
    """'[{"line_number":"12-15"}]'""",
    """'["x",{"a":1}]'""",
    """'[{"zero_day_likelihood":0.' || CAST(o_custkey % 10 AS STRING) || ',"confidence":0.75,"vulnerability_type":"novel"}]'""",
    """'[{"confidence":0.8},{"zero_day_likelihood":null,"confidence":0.9}]'""",
    """'[{"severity":"low"}] and a vulnerability [more]'""",
    """'[{"description":"ok"},{"severity":null},{"description":"late"}]'""",
    """'[{"detection_method":"static_analysis","severity":"medium"},{"detection_method":"pattern_matching","severity":"critical"}]'""",
    """'Vulnerability: [{"severity" "high"}]'""",
    """'[{"severity":"severe","confidence":0.1},{"confidence":[1]}]'""",
]
INPUTS["responses"] = ("orders", [
    _REPO.format("o_custkey"),
    "'f_' || CAST(o_orderkey AS STRING) || '.py' AS rel_path",
    "CASE WHEN o_custkey % 3 = 0 THEN 'zero_day' ELSE 'analysis' END AS kind",
    "CASE o_orderkey % 20 " + " ".join(f"WHEN {n} THEN {form}" for n, form in enumerate(_FORMS)) + " END AS response",
])

# --- findings -------------------------------------------------------------------
INPUTS["findings"] = ("lineitem", [
    _REPO.format("l_suppkey"),
    "'f_' || CAST(l_partkey AS STRING) || '.py' AS file_path",
    "CAST(l_linenumber AS BIGINT) AS line_number",
    "CASE l_returnflag WHEN 'A' THEN 'sql_injection' WHEN 'N' THEN 'hardcoded_credentials' ELSE 'zero_day_pattern' END AS vulnerability_type",
    "CASE l_linenumber % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'severe' END AS severity",
    "round(l_discount * 10, 2) AS confidence",
    "'order ' || CAST(l_orderkey AS STRING) AS description",
    "CASE WHEN l_linenumber = 1 THEN 'x < ' || CAST(l_partkey AS STRING) ELSE NULL END AS code_snippet",
    "CASE WHEN l_returnflag = 'A' THEN 'bind parameters' ELSE NULL END AS recommendation",
    "CAST(NULL AS STRING) AS cwe_id",
    "'llm_analysis' AS detection_method",
    "CASE WHEN l_returnflag = 'R' THEN round(l_tax * 10, 2) ELSE NULL END AS zero_day_likelihood",
    "'Model Analysis' AS source",
    "CAST(l_orderkey % 2 AS INT) AS origin",
    "CAST(l_partkey % 2 AS INT) AS part",
    "l_orderkey * 10 + l_linenumber AS pos",
])
INPUTS["repos"] = ("supplier", [
    "'repo_' || CAST(s_suppkey AS STRING) AS repo_id",
    "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_name END AS name",
    "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'https://h/o/' || s_name END AS url",
])

# --- history and runs -------------------------------------------------------------
INPUTS["commits"] = ("orders", [
    _REPO.format("o_orderkey"),
    "CAST(o_orderkey AS STRING) AS hash",
    "'dev_' || CAST(o_custkey AS STRING) AS author",
    "'  ' || o_orderpriority || chr(10) AS message",
    "o_orderdate AS committed_at",
    "CAST(CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 330 ELSE -150 END AS INT) AS offset_minutes",
])
INPUTS["commit_files"] = ("lineitem", [
    _REPO.format("l_orderkey"),
    "CAST(l_orderkey AS STRING) AS hash",
    "'f_' || CAST(l_partkey AS STRING) || '.py' AS rel_path",
])
INPUTS["stage_events"] = ("lineitem", [
    "'run_' || CAST(l_orderkey AS STRING) AS repo_id",
    "CASE l_linenumber % 5 WHEN 1 THEN 'ingestion' WHEN 2 THEN 'static_analysis' WHEN 3 THEN 'model_analysis' WHEN 4 THEN 'report' ELSE 'other' END AS stage",
    "l_linenumber AS ord",
    "l_returnflag <> 'R' AS ok",
    "CASE WHEN l_returnflag = 'R' THEN 'failed at ' || CAST(l_linenumber AS STRING) ELSE NULL END AS error",
])
INPUTS["run_repos"] = ("orders", [
    "'run_' || CAST(o_orderkey AS STRING) AS repo_id",
    "'https://h/o/' || CAST(o_orderkey AS STRING) AS url",
    "CASE o_custkey % 10 WHEN 0 THEN 'timeout' WHEN 1 THEN 'clone failed' ELSE NULL END AS abort",
    "CASE WHEN o_custkey % 7 = 2 THEN 'no builder' ELSE NULL END AS workflow_error",
    "CAST(o_custkey % 4 AS BIGINT) AS python_files",
    "o_totalprice AS execution_time_seconds",
])
INPUTS["run_summary"] = ("orders", [
    "'run_' || CAST(o_orderkey AS STRING) AS repo_id",
    "CAST(o_custkey % 30 AS BIGINT) AS total_vulnerabilities",
    "CASE o_custkey % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS overall_risk",
])
