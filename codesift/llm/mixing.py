"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.operators.joins import sized_join
from codesift.operators.ranking import number_within
from codesift.session import durable

WORD = r"[^\x20\x09-\x0D]+"
#: Sizes of the seeded order's buckets: 16 to this power.
DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: list[int], share: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to ``sources(source, source_size)``, one row per source.

    Sources in code point order, null last, take the weights in turn.  The total of
    ``share`` times all sizes is dealt by weight; sources above ``max_epochs`` times their
    size are clamped, and what they leave is dealt again by weight until none is above.
    Only sums of the sources come to the driver.
    """
    ranked = number_within(sources.withColumn("_all", F.lit(0)), "_all", [F.col("source").asc_nulls_last()], "_rank")
    turn = F.pmod(F.col("_rank") - 1, F.lit(len(weights)))
    weight = reduce(lambda c, i: c.when(turn == i, F.lit(weights[i])), range(1, len(weights)), F.when(turn == 0, F.lit(weights[0])))
    ranked = durable(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("_cap")))
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, clamped = 0.0, -1
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.count_if(full).alias("n"), F.sum(F.when(full, F.col("_cap"))).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("open")
        ).first()
        if row["n"] == clamped or not row["open"]:
            break
        clamped, level = row["n"], (total - (row["cap"] or 0.0)) / row["open"]
    open_share = F.lit(level) * F.col("weight")
    target = F.when(F.col("_cap") <= open_share, F.col("_cap")).otherwise(open_share) if total else F.lit(0.0)
    return ranked.select("source", "source_size", target.alias("target"))


def _order(seed: str) -> Column:
    """The seeded order of documents, as 32 hexadecimal digits."""
    return F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _source_key() -> Column:
    """A source as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))


def plan(sized: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """One row per source of ``sized(source, size, _key, _at)``, ``_at`` being the seeded order:
    _key, source_size, target, whole, cut.  Rows up to ``cut`` in the seeded order are taken once more.

    The order is dealt into hash buckets by its first digits, so a source of any size
    needs a running sum over rows only in the one bucket where its target falls.
    """
    bucket = F.substring("_at", 1, DIGITS).alias("_bucket")
    per_bucket = durable(sized.groupBy("source", "_key", bucket).agg(F.sum("size").alias("_words")))
    goals = targets(per_bucket.groupBy("source").agg(F.sum("_words").alias("source_size")), list(weights), share, max_epochs)
    goals = goals.withColumn("whole", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("long"))
    goals = durable(goals.select("*", _source_key().alias("_key"), (F.col("target") - F.col("whole") * F.col("source_size")).alias("_rest")))
    upto = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = (F.sum("_words").over(upto) - F.col("_words")).alias("_start")
    crossing = per_bucket.select("_key", "_bucket", "_words", start).join(goals.select("_key", "_rest"), "_key")
    crossing = crossing.where((F.col("_start") < F.col("_rest")) & (F.col("_rest") <= F.col("_start") + F.col("_words")))
    rows = sized.select("_key", bucket, "_at", "size")
    rows = sized_join(rows, crossing.select("_key", "_bucket", (F.col("_rest") - F.col("_start")).alias("_left")), ["_key", "_bucket"], "inner", ["_at"])
    rows = rows.groupBy("_key", "_bucket", "_left", "_at").agg(F.sum("size").alias("size"))
    end = F.sum("size").over(Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_near", end - F.col("size") / 2 <= F.col("_left"))
    cuts = rows.groupBy("_key", "_bucket").agg(F.coalesce(F.max(F.when(F.col("_near"), F.col("_at"))), F.col("_bucket")).alias("cut"))
    return goals.join(cuts.drop("_bucket"), "_key", "left").select(
        "_key", "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix") -> DataFrame:
    """How often every row of ``docs(doc_id, text, source)`` enters the mix.

    Result: doc_id, source, size (words), source_size, target, repeats (every row of a
    source is taken a whole number of times, and rows are taken once more in a seeded
    order until the target is met), taken (words).  The last row of the order is taken if
    that comes nearer to the target.  Null or empty texts have size 0 and take nothing; a
    null source is a source of its own; rows with one doc_id share their fate, also those
    without.  Other columns are not read; an empty table gives an empty result.
    """
    sized = durable(docs.select("doc_id", "source", words(F.col("text")).alias("size"), _source_key().alias("_key"), _order(seed).alias("_at")))
    decided = sized_join(sized, plan(sized, weights, share, max_epochs), ["_key"], "left", ["_at"])
    repeats = F.col("whole") + (F.col("_at") <= F.col("cut")).cast("long")
    return decided.select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"))


def repeat(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, all columns kept; extra columns may have any names.

    Rows without words count as a part of no target and are taken as their source's
    rows are.
    """
    sized = durable(docs.select("source", words(F.col("text")).alias("size"), _source_key().alias("_key"), _order(seed).alias("_at")))
    goals = plan(sized, weights, share, max_epochs)
    packed = docs.select(F.struct("*").alias("_row"), _source_key().alias("_key"), _order(seed).alias("_at"))
    decided = sized_join(packed, goals, ["_key"], "left", ["_at"])
    repeats = F.col("whole") + (F.col("_at") <= F.col("cut")).cast("long")
    return decided.select("_row", F.explode(F.array_repeat(F.lit(0), repeats.cast("int")))).select("_row.*")
