"""Hot keys: half of all rows share one repository, and no task may take them all."""

from pyspark.sql import functions as F

from codesift.operators import findings, joins, ranking
from registry.base import load


def test_numbering_splits_a_hot_group(spark):
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("r"), (F.col("id") % 50).cast("string"))).alias("g"),
        F.xxhash64("id").alias("v"),
    )
    ranked = ranking.number_within(rows, "g", [F.col("v").asc()], "n").toPandas()
    wanted = ranked.groupby("g")["v"].rank(method="first").astype(int)
    assert (ranked["n"] == wanted).all() and len(ranked) == 40_000


def test_hot_group_spans_partitions(spark):
    rows = spark.range(40_000).select(F.lit("hot").alias("g"), "id")
    spread = rows.repartitionByRange(4, "g", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == 4 and max(r["count"] for r in spread) < 20_000


def test_numbering_of_fully_equal_rows(spark):
    rows = spark.createDataFrame([("a", 1)] * 100 + [("b", 1)], "g string, v int")
    ranked = ranking.number_within(rows, "g", [F.col("v").asc()], "n")
    assert sorted(r.n for r in ranked.where("g = 'a'").collect()) == list(range(1, 101))


def test_salted_and_sized_joins_agree(spark):
    big = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100).alias("k"), "id")
    small = spark.range(0, 100, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left", "left_anti", "left_semi"):
        plain = sorted(map(tuple, big.join(small, "k", how).collect()), key=str)
        assert sorted(map(tuple, joins.salted_join(big, small, ["k"], how, ["id"]).collect()), key=str) == plain
        assert sorted(map(tuple, joins.sized_join(big, small, ["k"], how, ["id"]).collect()), key=str) == plain
        assert sorted(map(tuple, joins.sized_join(big, small, ["k"], how, ["id"], max_bytes=0).collect()), key=str) == plain
        assert sorted(map(tuple, joins.skew_join(big, small, ["k"], how, ["id"]).collect()), key=str) == plain


def test_salt_spreads_a_hot_key(spark):
    big = spark.range(32_000).select(F.lit(1).alias("k"), "id")
    salted = big.groupBy("k", F.pmod(F.xxhash64("id"), F.lit(joins.SALTS)).alias("s")).count()
    assert salted.count() == joins.SALTS and salted.agg(F.max("count")).first()[0] < 2_000


def test_report_order_is_total(spark):
    assert len(findings.report_order()) >= 6


def test_ranking_sorts_by_plain_columns(spark, monkeypatch):
    rows = load(spark, "/root/testdata/sf0.001", "findings")
    seen = []
    monkeypatch.setattr(findings, "number_within", lambda df, group, order, *more: seen.extend(order) or df)
    findings.rank_findings(rows)
    assert len(seen) == len(findings.report_order()) and not any("CASE" in str(c) or "coalesce" in str(c) for c in seen)
