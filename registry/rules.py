"""Pattern rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from codesift import settings
from codesift.operators import rules as ops
from codesift.sources.spread import spread
from registry.base import load, query, quoted, sql

# None of the six rules hits the supplied documents, so one rule is added.
PATTERNS = [*settings.SUSPICIOUS_PATTERNS, r'token\s*=\s*"[^"]+"']
LITERALS = [*settings.SUSPICIOUS_PATTERN_LITERALS, ["token", "="]]


def rule_set():
    return ops.compile_rules(PATTERNS, LITERALS)


_TEXTS = "(SELECT repo_id, rel_path, content FROM hit_files UNION ALL SELECT repo_id, rel_path, content FROM code_files UNION ALL SELECT repo_id, rel_path, content FROM doc_files)"
_LINES = f"""SELECT repo_id, rel_path, unnest(string_split(content, chr(10))) AS text,
 generate_subscripts(string_split(content, chr(10)), 1) AS line FROM {_TEXTS}"""


def _matches(rule_id: int, pattern: str) -> str:
    regex = quoted("(?i)" + pattern)
    return f"""SELECT repo_id, rel_path, {rule_id} AS rule_id, CAST(line AS INTEGER) AS line, hits, gaps, unnest(range(1, len(hits) + 1)) AS n FROM (
 SELECT *, regexp_extract_all(text, {regex}, 0) AS hits, regexp_split_to_array(text, {regex}) AS gaps FROM lines)"""


_HITS = f"lines AS ({_LINES}), found AS ({' UNION ALL '.join(_matches(n, p) for n, p in enumerate(PATTERNS))})"
_INPUTS = "hit_files code_files doc_files"


def texts(spark, sf_dir):
    parts = [load(spark, sf_dir, name).select("repo_id", "rel_path", "content") for name in _INPUTS.split()]
    return spread(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("m1_rule_table", sql(_INPUTS, f"""WITH {_HITS}, rules(rule_id, pattern) AS (VALUES {', '.join(f'({n}, {quoted(p)})' for n, p in enumerate(PATTERNS))})
SELECT r.rule_id, r.pattern, count(f.rule_id) AS hits FROM rules r LEFT JOIN found f ON r.rule_id = f.rule_id GROUP BY ALL"""))
def m1(spark, sf_dir):
    rules = rule_set()
    hits = ops.scan(texts(spark, sf_dir), rules).groupBy("rule_id").agg(F.count("*").alias("hits"))
    return rules.table(spark).join(hits, "rule_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


@query("m2_line_explode", sql(_INPUTS, f"SELECT repo_id, rel_path, CAST(line AS INTEGER) AS line, md5(text) AS digest FROM ({_LINES})"))
def m2(spark, sf_dir):
    return ops.explode_lines(texts(spark, sf_dir)).select("repo_id", "rel_path", "line", F.md5("text").alias("digest"))


@query("m3_rule_matches", sql(_INPUTS, f"WITH {_HITS} SELECT repo_id, rel_path, rule_id, line, hits[n] AS match FROM found"))
def m3(spark, sf_dir):
    return ops.scan(texts(spark, sf_dir), rule_set()).select("repo_id", "rel_path", "rule_id", "line", "match")


@query("m4_match_offsets", sql(_INPUTS, f"""WITH {_HITS}, placed AS (
 SELECT *, CAST(list_sum(list_transform(gaps[1:n], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:n-1], lambda h: length(h))), 0) AS INTEGER) AS s FROM found)
SELECT repo_id, rel_path, rule_id, line, s AS "start", CAST(s + length(hits[n]) AS INTEGER) AS "end" FROM placed"""))
def m4(spark, sf_dir):
    return ops.scan(texts(spark, sf_dir), rule_set()).select("repo_id", "rel_path", "rule_id", "line", "start", "end")


@query("m5_hits_per_file", sql(_INPUTS, f"WITH {_HITS} SELECT repo_id, rel_path, count(*) AS hits FROM found GROUP BY ALL"))
def m5(spark, sf_dir):
    return ops.hits_per_file(ops.scan(texts(spark, sf_dir), rule_set()))


@query("m5_hits_per_rule", sql(_INPUTS, f"WITH {_HITS} SELECT repo_id, rel_path, rule_id, count(*) AS hits FROM found GROUP BY ALL"))
def m5_rule(spark, sf_dir):
    return ops.hits_per_rule(ops.scan(texts(spark, sf_dir), rule_set()))


#: A table of a thousand rules: assignments of one key, brands, and keys by their last digits.
_MANY = {r'api_key\s*=\s*"k{}"': 600, 'brand#{}"': 100, r'=\s*"k\d*{}"': 300}
_MANY_SQL = " UNION ALL ".join(
    f"SELECT {start} + n AS rule_id, {quoted(pattern.split('{}')[0])} || n || '\"' AS pattern, {key} || n || '\"' AS part FROM range({count}) t(n)"
    for (pattern, count), start, key in zip(_MANY.items(), (0, 600, 700), ("'k'", "'brand#'", "''"), strict=True)
)


@query("m1_large_rule_table", sql(_INPUTS, f"""WITH rules AS ({_MANY_SQL}), lines AS ({_LINES}), low AS (SELECT *, lower(text) AS folded FROM lines WHERE contains(text, '"')),
found AS (SELECT repo_id, rel_path, rule_id, CAST(line AS INTEGER) AS line, regexp_extract_all(text, '(?i)' || pattern, 0) AS hits FROM low JOIN rules ON contains(folded, part))
SELECT repo_id, rel_path, CAST(rule_id AS INTEGER) AS rule_id, line, unnest(hits) AS match FROM found"""))
def m1_large(spark, sf_dir):
    rules = ops.compile_rules([pattern.replace("{}", str(n)) for pattern, count in _MANY.items() for n in range(count)])
    return ops.scan(texts(spark, sf_dir), rules).select("repo_id", "rel_path", "rule_id", "line", "match")
