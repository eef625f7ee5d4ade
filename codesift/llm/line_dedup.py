"""Deletion of repeated line runs by suffix ranks over line ids.

Every document is a sequence of line ids (blank lines left out).  Prefix doubling ranks
the suffixes of all sequences by their first 1, 2, 4, ... lines: the pair of ranks of a
suffix and of the suffix 2^k lines on is ranked for the next level.  Suffixes whose prefix
is unique leave; those that share a rank form an interval of the suffix array with at
least that longest common prefix, and an interval of any depth between two powers of two is
the pair of ranks of its first and its last 2^k lines.

A run of lines counts as a passage from ``min_words`` words on.  A line goes if it lies in
a passage that also occurs earlier, in order of doc_id and line.  Testing maximal runs and
testing the shortest passages within them comes to the same: a line of a repeated maximal
run lies in a repeated passage that is shortest from its first line on or from its last
line back.  Each line has one passage of either kind, of at most ``min_words`` lines, so
ranks are needed to that depth only, whatever the length of documents or of runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.llm.joins import keyed_join
from codesift.llm.mixing import WORD
from codesift.operators.joins import shuffle_partitions
from codesift.session import durable

MIN_WORDS = 50
#: Rows without doc_id come last.
LAST = (1 << 63) - 1


def _document() -> list[Column]:
    """What makes a document: its id and text; rows equal in both are one document."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), F.xxhash64("text").alias("_text")]


def line_ids(docs: DataFrame) -> DataFrame:
    """One row per line with words: _id, _text, idx (among these lines), line (among all), words, h1 and h2 (128-bit id)."""
    lines = F.transform(
        F.split("text", "\n", -1),
        lambda x, i: F.struct(i.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("2"), x).alias("h2")),
    )
    return (
        docs.select(*_document(), F.filter(lines, lambda x: x["words"] > 0).alias("_lines"))
        .select("_id", "_text", F.posexplode("_lines").alias("idx", "_line"))
        .select("_id", "_text", "idx", "_line.*")
    )


def _ranked(rows: DataFrame, pair: list[str]) -> DataFrame:
    """Rank of every pair that occurs twice or more, in the order of the pairs.

    The pairs are range-partitioned and sorted, so a row's number grows with its pair.
    """
    shared = rows.groupBy(*pair).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    placed = shared.repartitionByRange(shuffle_partitions(rows), *pair).sortWithinPartitions(*pair)
    return durable(placed.withColumn("rank", F.monotonically_increasing_id()))


def suffix_ranks(lines: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Passages and ranks.

    Passages: _id, _text, start, n (lines), level; ranks: _id, _text, idx, level, rank of
    the 2^level lines from idx on, where these occur at least twice.
    """
    # Equal rows of the input are one document.
    lines = durable(lines.dropDuplicates(["_id", "_text", "idx"]))
    first = _ranked(lines, ["h1", "h2"])
    repeated = keyed_join(lines, first, ["h1", "h2"], "inner", 64, ["_id", "idx"])
    # Lines that occur once end every run: what is left falls into stretches of adjacent lines.
    document = Window.partitionBy("_id", "_text").orderBy("idx")
    repeated = repeated.withColumn("seg", F.col("idx") - F.row_number().over(document))
    stretch = Window.partitionBy("_id", "_text", "seg")
    rows = (
        repeated.withColumn("end", F.sum("words").over(stretch.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"))
        .withColumn("begin", F.col("end") - F.col("words"))
        .withColumn("total", F.sum("words").over(stretch))
        .withColumn("right", F.count("*").over(stretch.orderBy("begin").rangeBetween(Window.currentRow, min_words - 1)))
        .withColumn("left", F.count("*").over(stretch.orderBy("end").rangeBetween(-(min_words - 1), Window.currentRow)))
        .withColumn("right", F.when(F.col("begin") + min_words <= F.col("total"), F.col("right")))
        .withColumn("left", F.when(F.col("end") >= min_words, F.col("left")))
    )
    # How deep ranks are needed from a line on: blocks that fit into a shortest passage.
    levels = range(1, max(min_words - 1, 1).bit_length() + 1)
    ahead = stretch.orderBy("idx")

    def needed(k: int) -> Column:
        return (F.coalesce("right", F.lit(min_words)) >= 2**k) | (F.lead("_left", 2**k - 1).over(ahead) >= 2**k)

    rows = rows.withColumn("_left", F.coalesce("left", F.lit(min_words)))
    rows = rows.withColumn("depth", F.greatest(F.lit(0), *[F.when(needed(k), k) for k in levels]))
    rows = durable(rows.select("_id", "_text", "seg", "idx", "rank", "left", "right", "depth"))
    right = rows.where(F.col("right").isNotNull()).select("_id", "_text", F.col("idx").alias("start"), F.col("right").alias("n"))
    left = rows.where(F.col("left").isNotNull()).select("_id", "_text", (F.col("idx") - F.col("left") + 1).cast("int").alias("start"), F.col("left").alias("n"))
    passages = durable(right.union(left).distinct().withColumn("level", F.floor(F.log2("n")).cast("int")))
    deepest = passages.agg(F.max("level")).first()[0] or 0
    level = rows.select("_id", "_text", "seg", "idx", "depth", "rank")
    found = [level.select("_id", "_text", "idx", F.lit(0).alias("level"), "rank")]
    for k in range(deepest):
        there = ahead.rangeBetween(2**k, 2**k)
        pairs = level.where(F.col("depth") >= k).withColumn("then", F.max("rank").over(there))
        pairs = durable(pairs.where((F.col("depth") > k) & F.col("then").isNotNull()).withColumnRenamed("rank", "first"))
        level = keyed_join(pairs, _ranked(pairs, ["first", "then"]), ["first", "then"], "inner", 64, ["_id", "idx"])
        level = durable(level.select("_id", "_text", "seg", "idx", "depth", "rank"))
        found.append(level.select("_id", "_text", "idx", F.lit(k + 1).alias("level"), "rank"))
    return passages, reduce(DataFrame.unionByName, found)


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Lines to delete: _id, _text, starts and ends (numbers among all lines) of the runs, in order; documents without any are left out."""
    lines = durable(line_ids(docs))
    passages, ranks = suffix_ranks(lines, min_words)
    place = ["_id", "_text", "level"]
    head = ranks.select(*place, F.col("idx").alias("start"), F.col("rank").alias("head"))
    tail = ranks.select(*place, F.col("idx").alias("_last"), F.col("rank").alias("tail"))
    # Passages whose blocks are not repeated drop out of the joins.
    found = passages.withColumn("_last", (F.col("start") + F.col("n") - F.expr("1L << level")).cast("int"))
    found = durable(found.join(head, [*place, "start"]).join(tail, [*place, "_last"]).select("_id", "_text", "start", "n", "head", "tail"))
    interval = ["n", "head", "tail"]
    at = F.struct("_id", "_text", "start")
    first = durable(found.groupBy(*interval).agg(F.min(at).alias("first"), F.count("*").alias("rows")).where(F.col("rows") > 1))
    later = keyed_join(found, first, interval, "inner", 96, ["_id", "start"]).where(at > F.col("first"))
    # Of each run the lines beyond those of the runs before it, so that a line comes once.
    later = later.select("_id", "_text", "start", (F.col("start") + F.col("n") - 1).cast("int").alias("until"))
    before = Window.partitionBy("_id", "_text").orderBy("start", "until").rowsBetween(Window.unboundedPreceding, -1)
    later = later.withColumn("fresh", F.greatest("start", F.max("until").over(before) + 1)).where(F.col("fresh") <= F.col("until"))
    later = later.select("_id", "_text", F.explode(F.sequence("fresh", "until")).alias("idx"))
    gone = later.join(lines.select("_id", "_text", "idx", "line").distinct(), ["_id", "_text", "idx"])
    sets = gone.groupBy("_id", "_text").agg(F.sort_array(F.collect_list("line")).alias("_at"))
    last = F.size("_at") - 1
    return sets.select(
        "_id",
        "_text",
        F.size("_at").alias("n_deleted"),
        F.filter("_at", lambda x, i: (i == 0) | (F.get("_at", i - 1) < x - 1)).alias("starts"),
        F.filter("_at", lambda x, i: (i == last) | (F.get("_at", i + 1) > x + 1)).alias("ends"),
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs(doc_id, text, ...)`` with later copies of repeated passages cut out of the texts.

    All columns stay, whatever their names; added: n_lines, n_deleted, deleted (array of
    structs of first and last line, from 0).  Lines compare as they are.  Blank lines
    belong to no passage and stay.  Null texts stay null, with no lines; rows equal in
    doc_id and text are one document and treated alike; rows without doc_id are ordered
    last, by a hash of their text.  Extra columns named as those added are replaced.
    """
    runs = durable(repeated_lines(docs, min_words))
    added = ["n_lines", "n_deleted", "deleted"]
    packed = docs.select(*_document(), F.struct(*[docs[f"`{c}`"] for c in docs.columns if c not in added]).alias("_row"))
    joined = keyed_join(packed, runs, ["_id", "_text"], "left", 128, ["_id"])

    def kept(lines: Column) -> Column:
        """The lines between the deleted runs."""
        before = F.sequence(F.lit(0), F.size("starts"))
        begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("ends", i - 1) + 1)
        until = lambda i: F.coalesce(F.get("starts", i), F.size(lines))
        return F.array_join(F.flatten(F.transform(before, lambda i: F.slice(lines, begin(i) + 1, until(i) - begin(i)))), "\n")

    text = F.col("_row.text")
    cut = F.transform(F.array(F.split(text, "\n", -1)), kept)[0]
    names = [c for c in docs.columns if c not in added]
    return joined.select(
        *[F.when(F.col("starts").isNull(), text).otherwise(cut).alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in names],
        F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1).alias("n_lines"),
        F.coalesce("n_deleted", F.lit(0)).alias("n_deleted"),
        F.coalesce(F.transform(F.arrays_zip("starts", "ends"), lambda r: F.struct(r["starts"].alias("first"), r["ends"].alias("last"))), F.array().cast("array<struct<first:int,last:int>>")).alias("deleted"),
    )
