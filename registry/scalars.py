"""Projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codesift import settings
from codesift.functions import text, urls
from registry.base import load, query, sql, table


@query("u1_url_validity", sql("repo_urls", """
SELECT page_id, coalesce(regexp_matches(repo_url, '^(?i)https?://[^/?#]+'), false) AS is_valid FROM repo_urls"""))
def u1(spark, sf_dir):
    return load(spark, sf_dir, "repo_urls").select("page_id", urls.is_valid_url(F.col("repo_url")).alias("is_valid"))


@query("u2_repo_name", sql("repo_urls", r"""
WITH p AS (SELECT page_id, string_split(trim(regexp_replace(regexp_replace(repo_url, '^[A-Za-z][A-Za-z0-9+.-]*:', ''), '^//[^/]*|[?#].*', '', 'g'), '/'), '/') AS parts FROM repo_urls)
SELECT page_id, CASE WHEN len(parts) >= 2 THEN parts[-2] || '_' || regexp_replace(parts[-1], '\.git$', '') ELSE 'unknown_repo' END AS name FROM p"""))
def u2(spark, sf_dir):
    rows = load(spark, sf_dir, "repo_urls")
    return rows.select("page_id", urls.repo_name(F.col("repo_url")).alias("name"))


@query("u3_report_id", "SELECT o_orderkey, strftime(o_orderdate, 'vuln_report_%Y%m%d_%H%M%S') AS report_id FROM orders")
def u3(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", urls.report_id(F.col("o_orderdate")).alias("report_id"))


@query("u3_run_id", """
SELECT page_id, 'pipeline_' || string_split(url, '/')[-1] || '_' || CAST(CAST(floor(page_id * 1.75) AS BIGINT) AS VARCHAR) AS run_id FROM pages""")
def u3_run(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", urls.run_id(F.col("url"), F.col("page_id") * F.lit(1.75)).alias("run_id"))


_LENGTHS = {
    "readme": settings.README_CHARS,
    "licence": settings.LICENSE_CHARS,
    "code": settings.CONTEXT_LENGTH * settings.CHARS_PER_TOKEN,
    "match": settings.PATTERN_CHARS,
    "response": settings.FALLBACK_CHARS,
    "snippet": settings.SNIPPET_CHARS,
}


@query("u4_prefix_truncation", "SELECT doc_id, " + ", ".join(
    f"md5(substring(text, 1, {chars})) AS {name}" for name, chars in _LENGTHS.items()) + " FROM documents")
def u4(spark, sf_dir):
    cuts = [F.md5(F.left("text", F.lit(chars))).alias(name) for name, chars in _LENGTHS.items()]
    return table(spark, sf_dir, "documents").select("doc_id", *cuts)


@query("u5_title_case", """
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(replace(t, '_', ' '), '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS title
FROM (SELECT p_partkey, replace(p_name, ' ', '_') || '-' || p_brand || CAST(p_size AS VARCHAR) || 'x_' || p_type AS t FROM part)""")
def u5(spark, sf_dir):
    kind = F.expr("replace(p_name, ' ', '_') || '-' || p_brand || CAST(p_size AS STRING) || 'x_' || p_type")
    return table(spark, sf_dir, "part").select("p_partkey", text.type_title(kind).alias("title"))


@query("u6_two_decimals", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(printf('%.2f', x) AS DOUBLE) AS rounded, printf('%.2f', x) AS formatted,
 CAST(printf('%.2f', y) AS DOUBLE) AS tie
FROM (SELECT *, l_extendedprice * l_discount / 7 AS x, l_partkey / 8.0::DOUBLE + 0.005 AS y FROM lineitem)""")
def u6(spark, sf_dir):
    amount = F.col("l_extendedprice") * F.col("l_discount") / F.lit(7)
    tie = F.col("l_partkey") / F.lit(8.0) + F.lit(0.005)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        text.round2(amount).alias("rounded"),
        text.two_decimals(amount).alias("formatted"),
        text.round2(tie).alias("tie"),
    )
