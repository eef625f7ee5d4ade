"""Code facts, static scores and the corpus summary.

The oracles state what each form of the generated files must give; the forms are
enumerated in ``fact_files`` and ``code_files``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codesift.operators import facts as ops
from codesift.operators import rules, scoring
from codesift.sources.facts import extract_facts, register_facts
from codesift.sources.spread import spread
from registry.base import load, query, sql


def _facts(spark, sf_dir, name="fact_files"):
    return extract_facts(spread(load(spark, sf_dir, name).select("repo_id", "rel_path", "content")))


def _expected(columns: str, rows: list[str], select: str, inputs: str = "fact_files") -> str:
    body = f"""WITH expected(form, {columns}) AS (VALUES {', '.join(rows)})
SELECT f.repo_id, f.rel_path, {select} FROM {inputs} f JOIN expected e ON f.form = e.form"""
    return sql(inputs, body)


# form: nodes, functions, classes, calls, variables; nodes as counted by Python 3.13
_SIZES = ["(0, 9, 0, 0, 0, 0)", "(1, 15, 1, 1, 0, 0)", "(2, 25, 1, 0, 2, 0)", "(3, 35, 0, 0, 0, 2)", "(4, 34, 0, 0, 5, 1)", "(5, NULL, NULL, NULL, NULL, NULL)", "(6, 13, 0, 0, 1, 0)", "(7, 1, 0, 0, 0, 0)"]


@query("a1_fact_extraction", _expected("n, fu, cl, ca, va", _SIZES, "CAST(n AS INTEGER) AS ast_nodes, CAST(fu AS INTEGER) AS functions, CAST(cl AS INTEGER) AS classes, CAST(ca AS INTEGER) AS calls, CAST(va AS INTEGER) AS variables"))
def a1(spark, sf_dir):
    sizes = [F.size(name).alias(name) for name in ("functions", "classes", "calls", "variables")]
    return _facts(spark, sf_dir).select("repo_id", "rel_path", "ast_nodes", *sizes)


@query("a2_imports", _expected("name", [
    "(0, 'os.path')", "(0, 'sys')", "(0, '.x')", "(0, 'm.a')", "(0, 'm.b')",
    "(6, 'pickle')", "(6, 'subprocess')", "(6, 'posixpath.join')"], "e.name AS import_name"))
def a2(spark, sf_dir):
    return ops.imports(_facts(spark, sf_dir))


@query("a3_functions", _expected("name, line, args, decorators", ["(1, 'm', 2, 1, '')", "(2, 'h', 4, 2, 'dec|app.route(1)')"],
                                 "e.name, CAST(e.line AS INTEGER) AS line, CAST(e.args AS INTEGER) AS args, e.decorators"))
def a3(spark, sf_dir):
    return ops.functions(_facts(spark, sf_dir)).withColumn("decorators", F.array_join("decorators", "|"))


@query("a4_classes", _expected("name, line, bases", ["(1, 'C', 1, 'Base|mod.Other')"], "e.name, CAST(e.line AS INTEGER) AS line, e.bases"))
def a4(spark, sf_dir):
    return ops.classes(_facts(spark, sf_dir)).withColumn("bases", F.array_join("bases", "|"))


@query("a5_dangerous_calls", _expected("function, line, args", [
    "(2, 'eval', 4, 1)", "(4, 'os.system', 1, 1)", "(4, 'subprocess.run', 2, 1)", "(6, 'pickle.loads', 3, 1)"],
    'e.function AS "function", CAST(e.line AS INTEGER) AS line, CAST(e.args AS INTEGER) AS args'))
def a5(spark, sf_dir):
    return ops.dangerous_calls(_facts(spark, sf_dir)).drop("pos")


@query("a6_callee_names", _expected("function, line, args", [
    "(2, 'eval', 4, 1)", "(2, 'app.route', 3, 1)", "(4, 'os.system', 1, 1)", "(4, 'subprocess.run', 2, 1)", "(4, '<expr>', 3, 0)",
    "(4, 'f', 3, 0)", "(4, 'ev', 5, 1)", "(6, 'pickle.loads', 3, 1)"],
    'e.function AS "function", CAST(e.line AS INTEGER) AS line, CAST(e.args AS INTEGER) AS args'))
def a6(spark, sf_dir):
    return ops.calls(_facts(spark, sf_dir))


@query("a7_variables", _expected("name, line", ["(3, 'x', 1)", "(3, 'y', 1)", "(4, 'ev', 4)"], "e.name, CAST(e.line AS INTEGER) AS line"))
def a7(spark, sf_dir):
    return ops.variables(_facts(spark, sf_dir))


@query("a8_node_count", _expected("n", ["(0, 9)", "(1, 15)", "(2, 25)", "(3, 35)", "(4, 34)", "(5, NULL)", "(6, 13)", "(7, 1)"], "CAST(n AS INTEGER) AS ast_nodes"))
def a8(spark, sf_dir):
    return _facts(spark, sf_dir).select("repo_id", "rel_path", "ast_nodes")


@query("a9_parse_failures", sql("fact_files", "SELECT repo_id, rel_path, true AS is_syntax_error FROM fact_files WHERE form = 5"))
def a9(spark, sf_dir):
    failed = ops.parse_failures(_facts(spark, sf_dir))
    return failed.select("repo_id", "rel_path", F.startswith("parse_error", F.lit("Syntax error: ")).alias("is_syntax_error"))


# Numbers of imports, functions, classes, calls and variables, by form; form 5 cannot be parsed.
_SIZES = "(0, 5, 0, 0, 0, 0), (1, 0, 1, 1, 0, 0), (2, 0, 1, 0, 2, 0), (3, 0, 0, 0, 0, 2), (4, 0, 0, 0, 5, 1), (5, NULL, NULL, NULL, NULL, NULL), (6, 3, 0, 0, 1, 0), (7, 0, 0, 0, 0, 0)"


@query("x4_facts_in_sql", sql("fact_files", f"""WITH sizes(form, i, f, c, k, v) AS (VALUES {_SIZES})
SELECT repo_id, rel_path, t.form = 5 AS failed, CAST(i AS INTEGER) AS imports, CAST(f AS INTEGER) AS functions, CAST(c AS INTEGER) AS classes, CAST(k AS INTEGER) AS calls, CAST(v AS INTEGER) AS variables
FROM fact_files t JOIN sizes s ON t.form = s.form"""))
def x4_sql(spark, sf_dir):
    """The parser as a table function of a SQL query."""
    register_facts(spark)
    spread(load(spark, sf_dir, "fact_files")).createOrReplaceTempView("fact_files_in_sql")
    lists = ", ".join(f"CASE WHEN x.{c} IS NOT NULL THEN size(x.{c}) END AS {c}" for c in ("imports", "functions", "classes", "calls", "variables"))
    return spark.sql(f"SELECT f.repo_id, f.rel_path, x.parse_error IS NOT NULL AS failed, {lists} FROM fact_files_in_sql f, LATERAL code_facts(f.content) x")


# --- scores -------------------------------------------------------------------
# code_files, by form: nodes, functions, dangerous calls, hits, risky imports, distinct imports
_FORMS = ["(0, 10, 0, 1, 0, 1)", "(1, 7, 0, 0, 1, 1)", "(2, 13, 1, 0, 1, 1)", "(3, 14, 0, 1, 0, 2)"]
_SCORED = f"""expected(form, n, fu, d, h, r) AS (VALUES {', '.join(_FORMS)}), scored AS (
 SELECT f.repo_id, f.rel_path, f.form, e.*, least(least(n / 100.0::DOUBLE, 10) + fu * 0.5::DOUBLE + d * 1.0::DOUBLE, 10) AS complexity, least(2 * d + h + r, 10)::DOUBLE AS security
 FROM code_files f JOIN expected e ON f.form = e.form)"""


def _scored(spark, sf_dir):
    rows = spread(load(spark, sf_dir, "code_files").select("repo_id", "rel_path", "content"))
    return scoring.file_scores(extract_facts(rules.with_hits(rows, rules.default_rules())))


@query("c1_complexity_score", sql("code_files", f"WITH {_SCORED} SELECT repo_id, rel_path, round(complexity, 6) AS complexity_score FROM scored"))
def c1(spark, sf_dir):
    return _scored(spark, sf_dir).select("repo_id", "rel_path", F.round("complexity_score", 6).alias("complexity_score"))


@query("c2_risky_imports", sql("code_files", f"WITH {_SCORED} SELECT repo_id, rel_path, CAST(r AS INTEGER) AS risky_imports FROM scored"))
def c2(spark, sf_dir):
    return _scored(spark, sf_dir).select("repo_id", "rel_path", "risky_imports")


@query("c3_security_score", sql("code_files", f"WITH {_SCORED} SELECT repo_id, rel_path, security AS security_score FROM scored"))
def c3(spark, sf_dir):
    return _scored(spark, sf_dir).select("repo_id", "rel_path", "security_score")


_SUMMARY = f"""{_SCORED}, totals AS (SELECT repo_id, count(*) AS files, sum(d) AS calls, sum(h) AS hits, avg(complexity) AS mc, avg(security) AS ms,
 len(list_distinct(flatten(list(CASE form WHEN 3 THEN ['os', 'pickle'] ELSE ['os'] END)))) AS imports, sum(fu) AS funcs FROM scored GROUP BY repo_id)"""
_LEVEL = """CASE WHEN files IS NULL THEN NULL WHEN round(ms, 10) >= 7 OR calls >= 10 OR hits >= 20 THEN 'high'
 WHEN round(ms, 10) >= 4 OR calls >= 5 OR hits >= 10 THEN 'medium' ELSE 'low' END"""


def _summary(spark, sf_dir):
    repos = load(spark, sf_dir, "repos").select("repo_id")
    return scoring.corpus_summary(_scored(spark, sf_dir), repos)


@query("c4_corpus_summary", sql("code_files repos", f"""WITH {_SUMMARY}
SELECT r.repo_id, coalesce(files, 0) AS total_files, CAST(calls AS BIGINT) AS total_dangerous_calls, CAST(hits AS BIGINT) AS total_suspicious_patterns,
 CAST(printf('%.2f', round(mc, 10)) AS DOUBLE) AS average_complexity_score, CAST(printf('%.2f', round(ms, 10)) AS DOUBLE) AS average_security_score,
 CAST(imports AS BIGINT) AS unique_imports, CAST(funcs AS BIGINT) AS total_functions FROM repos r LEFT JOIN totals t ON r.repo_id = t.repo_id"""))
def c4(spark, sf_dir):
    return _summary(spark, sf_dir).drop("risk_level")


@query("c5_static_risk_level", sql("code_files repos", f"WITH {_SUMMARY} SELECT r.repo_id, {_LEVEL} AS risk_level FROM repos r LEFT JOIN totals t ON r.repo_id = t.repo_id"))
def c5(spark, sf_dir):
    return _summary(spark, sf_dir).select("repo_id", "risk_level")


@query("c6_failure_rows", sql("fact_files", """
SELECT repo_id, rel_path, 0.0::DOUBLE AS complexity_score, 0.0::DOUBLE AS security_score, CAST(0 AS INTEGER) AS functions FROM fact_files WHERE form = 5"""))
def c6(spark, sf_dir):
    rows = spread(load(spark, sf_dir, "fact_files").select("repo_id", "rel_path", "content"))
    scored = scoring.file_scores(extract_facts(rules.with_hits(rows, rules.default_rules())))
    return scored.where("parse_error IS NOT NULL").select("repo_id", "rel_path", "complexity_score", "security_score", "functions")
