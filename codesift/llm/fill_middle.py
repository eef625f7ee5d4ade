"""Fill-in-the-middle documents by one match of a counted pattern.

A text is a sequence of units (code points unless another pattern is given).  The number
of units n gives two cuts a <= b, and a pattern made for the row, ``(unit{a}+)(unit{b-a}+)(rest)``,
captures prefix, middle and suffix in a single match, whose groups the replacement puts
into the order of the form.  All quantifiers are possessive, so nothing is ever tried again
and a match takes one pass over the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of prefix, suffix and middle; no mark may begin inside another.
MARKS = ("<P>", "<S>", "<M>")
#: Units that are counted as one match: a count holds the matches of a text, so single units would need many times its memory.
COUNTED = 1024


def _quoted(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def count_units(text: Column, unit: str = ".") -> Column:
    """How many units follow each other in a text; ``unit`` must match every text from end to end."""
    many = F.lit(f"(?s)(?:{unit}){{{COUNTED}}}+")
    rest = F.regexp_replace(text, many, F.lit(""))
    return (F.regexp_count(text, many) * COUNTED + F.regexp_count(rest, F.lit(f"(?s)(?:{unit})"))).cast("long")


def draws(key: Column, n: int, seed: str = "1:") -> list[Column]:
    """n unsigned 32-bit draws of a key (null: as an empty one), the first groups of eight digits of a digest."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def fill_in_middle(
    docs: DataFrame, seed: str = "1:", cut_percent: int = 90, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS, unit: str = "."
) -> DataFrame:
    """``docs(doc_id, text)`` with every text cut into prefix, middle and suffix.

    Result: doc_id, n (units), form, prefix_units, middle_units (null if plain), output.
    Of the texts, ``cut_percent`` of a hundred are cut, of these ``spm_percent`` of a
    hundred as suffix, prefix, middle (form spm), the others as prefix, suffix, middle
    (psm).  Empty texts, null ones (as empty) and those that hold a mark stay plain.  The
    draws depend on doc_id alone: rows that repeat one are cut alike if their texts are
    equal, and rows without doc_id share their draws.  Very long texts are matched whole.
    Other columns are not read; an empty table gives an empty result.
    """
    p, s, m = marks
    put_p, put_s, put_m = [mark.replace("\\", r"\\").replace("$", r"\$") for mark in marks]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), 4, seed), 1)])
    rows = rows.withColumn("n", count_units(F.col("text"), unit))
    plain = (F.col("n") == 0) | F.col("text").contains(p) | F.col("text").contains(s) | F.col("text").contains(m) | (F.col("h3") % 100 >= cut_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    x, y = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.select("doc_id", "text", "n", form.alias("form"), F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    piece = f"((?:{unit}){{"
    pattern = F.concat(
        F.lit(rf"(?s)\A{piece}"), F.col("a").cast("string"), F.lit(f"}}+){piece}"), (F.col("b") - F.col("a")).cast("string"), F.lit(r"}+)(.*+)\z")
    )
    order = F.when(F.col("form") == "spm", f"{put_s}$3{put_p}$1{put_m}$2").otherwise(f"{put_p}$1{put_s}$3{put_m}$2")
    cut = F.col("form") != "plain"
    return rows.select(
        "doc_id",
        "n",
        "form",
        F.when(cut, F.col("a")).alias("prefix_units"),
        F.when(cut, F.col("b") - F.col("a")).alias("middle_units"),
        F.when(cut, F.regexp_replace("text", pattern, order)).otherwise(F.col("text")).alias("output"),
    )


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text of an output, again by one match: no part holds a mark, so the first marks are those that were put in."""
    p, s, m = map(_quoted, marks)
    psm, spm = rf"(?s)\A{p}(.*?){s}(.*?){m}(.*+)\z", rf"(?s)\A{s}(.*?){p}(.*?){m}(.*+)\z"
    back = F.when(form == "psm", F.regexp_replace(output, F.lit(psm), F.lit("$1$3$2")))
    return back.when(form == "spm", F.regexp_replace(output, F.lit(spm), F.lit("$2$3$1"))).otherwise(output)
