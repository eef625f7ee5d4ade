"""Merkle-tree fingerprints of documents: sentences, paragraphs, sections, root.

A paragraph is a line of the text; a paragraph's children are its sentences (a sentence
ends with ``.``, ``!`` or ``?`` and a space).  A sentence is cut at the first blank or mark
of ``CUT`` after 64 code points, and so on; where there is none, after 256.  A long text without sentence
ends so has many leaves too, and cuts depend on content.  Every node is a SHA-256: a sentence's of its
text, a paragraph's of its sentences' digests.  A section is a run of paragraphs that ends
with one whose digest ends in 0, 1, 2 or 3, so boundaries depend on content and an inserted
paragraph changes one section.  A section's digest is that of its paragraphs' digests, the
root's that of the sections'.  Digests are fixed-length and lists are joined by marks that
no digest holds, so different trees give different roots, up to SHA-256 collisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the neighbour search per shuffle partition are dealt into so many ranges.
RANGES = 4


#: Pieces of a sentence: 65 to 256 code points up to a blank or mark, else at most 256.
CUT = "(?s).{64,255}?[ ,;:、。，；：！？]|.{1,256}"


def _digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def sentences(paragraph: Column) -> Column:
    marked = paragraph
    for end in (". ", "! ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(f"{end}\n"))
    return F.split(marked, "\n", -1)


def pieces(paragraph: Column) -> Column:
    """The sentences of a paragraph, long ones cut; an empty sentence is one piece."""
    cut = F.transform(sentences(paragraph), lambda s: F.when(s == "", F.array(s)).otherwise(F.regexp_extract_all(s, F.lit(CUT), F.lit(0))))
    return F.flatten(cut)


def paragraphs(text: Column) -> Column:
    """Array of paragraphs, each a struct of its digest and its sentences' digests."""
    split = F.transform(F.split(text, "\n", -1), lambda p: F.transform(pieces(p), _digest))
    return F.transform(split, lambda leaves: F.struct(_digest(F.array_join(leaves, ",")).alias("digest"), leaves.alias("leaves")))


def sections(paragraph_digests: Column) -> Column:
    """Array of section digests."""
    joined = F.array_join(paragraph_digests, ";")
    for end in "0123":
        joined = F.replace(joined, F.lit(f"{end};"), F.lit(f"{end}|"))
    return F.transform(F.split(joined, "[|]", -1), _digest)


def root(section_digests: Column) -> Column:
    return _digest(F.array_join(section_digests, "/"))


def trees(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the tree of ``df[text]`` as ``name``: struct of root, sections, paragraphs, sentences (digests in text order)."""
    return (
        df.withColumn(name, paragraphs(F.col(text)))
        .withColumn(name, F.struct(F.col(f"{name}.digest").alias("paragraphs"), F.flatten(F.col(f"{name}.leaves")).alias("sentences")))
        .withColumn(name, F.struct(sections(F.col(f"{name}.paragraphs")).alias("sections"), f"{name}.paragraphs", f"{name}.sentences"))
        .withColumn(name, F.struct(root(F.col(f"{name}.sections")).alias("root"), f"{name}.sections", f"{name}.paragraphs", f"{name}.sentences"))
    )


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else the share of distinct sentences that two trees have in common (Dice)."""
    common = F.size(F.array_intersect(a["sentences"], b["sentences"]))
    either = F.size(F.array_distinct(a["sentences"])) + F.size(F.array_distinct(b["sentences"]))
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(2.0 * common / either)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _differing(x: Column, y: Column) -> Column:
    """Of two arrays the length of the equal start, of the equal end after it, and both lengths."""

    def start(u: Column, v: Column) -> Column:
        return F.coalesce(F.nullif(F.array_position(F.zip_with(u, v, lambda p, q: p.eqNullSafe(q)), F.lit(False)), F.lit(0)) - 1, F.size(u)).cast("int")

    def rest(array: Column, n: Column) -> Column:
        return F.reverse(F.slice(array, n + 1, F.size(array)))

    return _let(start(x, y), lambda n: F.struct(
        n.alias("start"), start(rest(x, n), rest(y, n)).alias("end"), F.size(x).alias("n"), F.size(y).alias("m"),
    ))


def _ends(paragraph_digests: Column) -> Column:
    """How many paragraphs a tree's first sections have: 0, then up to the end of each section."""
    last = F.size(paragraph_digests)
    ends = F.transform(paragraph_digests, lambda d, i: F.when(F.right(d, F.lit(1)).isin(*"0123") & (i + 1 < last), i + 1))
    return F.concat(F.array(F.lit(0)), F.filter(ends, lambda e: e.isNotNull()), F.array(last))


def _keys(digests: Column) -> Column:
    """Digests with the number of their occurrence, so that repeated paragraphs are told apart."""
    repeated = F.size(F.array_distinct(digests)) < F.size(digests)
    before = F.transform(digests, lambda d, i: F.concat(d, F.lit("#"), F.size(F.filter(F.slice(digests, F.lit(1), i), lambda e: e == d)).cast("string")))
    return F.when(repeated, before).otherwise(F.transform(digests, lambda d: F.concat(d, F.lit("#0"))))


def _in_order(ranks: Column) -> Column:
    """Places (from 0) of a longest rising subsequence of distinct numbers, last first."""
    none = F.array().cast("array<int>")
    # Least last number of the rising subsequences of each length, and the greatest length that ends at each number.
    lengths = F.aggregate(
        ranks,
        F.struct(none.alias("tails"), none.alias("lengths")),
        lambda s, x: _let(F.size(F.filter(s["tails"], lambda t: t < x)), lambda k: F.struct(
            F.concat(F.slice(s["tails"], F.lit(1), k), F.array(x), F.slice(s["tails"], k + 2, F.size(s["tails"]))).alias("tails"),
            F.concat(s["lengths"], F.array(k + 1)).alias("lengths"),
        )),
        lambda s: s["lengths"],
    )
    numbered = _let(lengths, lambda n: F.zip_with(F.transform(ranks, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), n, lambda r, k: F.struct(r["x"].alias("x"), r["i"].alias("i"), k.alias("k"))))
    return _let(numbered, lambda rows: F.aggregate(
        F.reverse(rows),
        F.struct(F.array_max(F.transform(rows, lambda r: r["k"])).alias("k"), F.lit(2**31 - 1).alias("x"), none.alias("places")),
        lambda s, r: F.when((r["k"] == s["k"]) & (r["x"] < s["x"]), F.struct(
            (s["k"] - 1).alias("k"), r["x"].alias("x"), F.concat(s["places"], F.array(r["i"])).alias("places"),
        )).otherwise(s),
        lambda s: s["places"],
    ))


def located(a: Column, b: Column) -> Column:
    """Where two trees differ: struct of ``removed`` (paragraphs of ``a``), ``added`` (of ``b``) and ``moved`` (pairs of both), numbers from 0.

    Only the sections from the first to the last that differ are opened, and of their
    paragraphs those between the equal start and end are aligned: the k-th occurrence of a
    paragraph with the k-th on the other side.  Of aligned pairs a longest sequence in the
    order of both sides stays, the others have moved.  Work grows with the square of the
    number of opened paragraphs.
    """
    none = F.array().cast("array<int>")
    nothing = F.struct(none.alias("removed"), none.alias("added"), F.array().cast("array<struct<a:int,b:int>>").alias("moved"))

    def opened(cut: Column, tree: Column, sections_of: str) -> Column:
        """Number of the first paragraph, and the digests, of a tree's sections from the first to the last that differ."""
        ends = _ends(tree["paragraphs"])
        return _let(ends, lambda e: _let(F.get(e, cut["start"]), lambda n: F.struct(
            n.alias("first"), F.slice(tree["paragraphs"], n + 1, F.get(e, cut[sections_of] - cut["end"]) - n).alias("p"),
        )))

    def trimmed(x: Column, y: Column) -> Column:
        return _let(_differing(x["p"], y["p"]), lambda cut: F.struct(
            (x["first"] + cut["start"]).alias("a"), (y["first"] + cut["start"]).alias("b"),
            _keys(F.slice(x["p"], cut["start"] + 1, cut["n"] - cut["end"] - cut["start"])).alias("x"),
            _keys(F.slice(y["p"], cut["start"] + 1, cut["m"] - cut["end"] - cut["start"])).alias("y"),
        ))

    def numbers(some: Column, every: Column, first: Column) -> Column:
        return F.transform(some, lambda d: (first + F.array_position(every, d) - 1).cast("int"))

    def moved(t: Column, pairs: Column) -> Column:
        ranks = F.transform(pairs, lambda p: p["b"])
        out = _let(_in_order(ranks), lambda stay: F.filter(pairs, lambda p, i: ~F.array_contains(stay, i)))
        return F.when(F.array_sort(ranks) == ranks, F.array().cast("array<struct<a:int,b:int>>")).otherwise(out)

    def aligned(t: Column) -> Column:
        pairs = F.transform(F.array_intersect(t["x"], t["y"]), lambda d: F.struct(
            (t["a"] + F.array_position(t["x"], d) - 1).cast("int").alias("a"), (t["b"] + F.array_position(t["y"], d) - 1).cast("int").alias("b"),
        ))
        return F.struct(
            numbers(F.array_except(t["x"], t["y"]), t["x"], t["a"]).alias("removed"),
            numbers(F.array_except(t["y"], t["x"]), t["y"], t["b"]).alias("added"),
            _let(pairs, lambda p: moved(t, p)).alias("moved"),
        )

    sides = _let(_differing(a["sections"], b["sections"]), lambda cut: F.struct(opened(cut, a, "n").alias("x"), opened(cut, b, "m").alias("y")))
    edited = _let(_let(sides, lambda o: trimmed(o["x"], o["y"])), aligned)
    return F.when(a["root"] == b["root"], nothing).otherwise(edited)


def edits(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of ``a`` that ``b`` lacks, or has fewer times; ``located`` also has the added and moved ones."""
    return located(a, b)["removed"]


def fingerprint(docs: DataFrame) -> DataFrame:
    """Tree of every whole text of ``docs(doc_id, text)``; a null text counts as empty.

    Result: doc_id, root, sections, paragraphs, sentences.  Repeated rows stay; other
    columns are not read.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    return trees(texts, "_text", "_tree").select("doc_id", "_tree.*")


def with_next(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with the text of the next document, in descending doc_id (after the last: the first).

    Ties of doc_id follow the text, rows without doc_id come last.  The texts move once:
    rows are dealt into ranges of doc_id, the next row is looked up within a range, and
    the first row of every range, found by its id, is what follows the range before.  One
    row per range is broadcast.
    """
    spark = docs.sparkSession
    # Rows are told apart by id and text only, so that any reading order gives one result.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    count = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = F.array(*[F.lit(i / count) for i in range(1, count)])
    bounds = texts.agg(F.percentile_approx("doc_id", steps, F.lit(100 * count))).first()[0] or []
    bounds = sorted(set(bounds))
    # Range numbers fall with doc_id; -1 is the range after all, of rows without doc_id.
    at = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(
        F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), lambda b: b < F.col("doc_id")))
    )
    ranged = texts.withColumn("_range", at)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    linked = ranged.withColumn("next_text", F.lead("text").over(Window.partitionBy("_range").orderBy(*order)))
    top = ranged.groupBy("_range").agg(F.max("doc_id").alias("doc_id"))
    # At most one id per range, and of rows with one id the first by text.
    top = [(r["_range"], r["doc_id"]) for r in top.orderBy(F.col("_range").desc()).collect()]
    ids = [i for _, i in top if i is not None]
    wanted = F.col("doc_id").isin(ids) if any(r != -1 for r, _ in top) else F.lit(False)
    if any(r == -1 for r, _ in top):
        wanted = wanted | F.col("doc_id").isNull()
    first = texts.where(wanted).groupBy("doc_id").agg(F.min("text").alias("_first"))
    follow = spark.createDataFrame(
        [(top[i - 1][0], top[i][1]) for i in range(len(top))], "_range int, doc_id bigint"
    )
    first = follow.join(first, follow["doc_id"].eqNullSafe(first["doc_id"])).select("_range", "_first")
    return linked.join(F.broadcast(first), "_range", "left").select("doc_id", "text", F.coalesce("next_text", "_first").alias("next_text"))


def _edited(docs: DataFrame) -> DataFrame:
    """The texts with those of the next documents and the edited texts."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    return with_next(docs).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document's text.

    The edited text has its last floor(n/2) code points replaced by the first as many (or
    all) of the next document's.  Result: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.  An empty table gives an empty result; a
    single row is followed by itself.
    """
    pairs = _edited(docs)
    for text, tree in (("text", "_own"), ("edited", "_edited"), ("next_text", "_next")):
        pairs = trees(pairs, text, tree)
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        _digest(F.col("edited")).alias("edited_sha256"),
        F.col("_own.root").alias("fingerprint"),
        F.col("_edited.root").alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )


def locate_edits(docs: DataFrame) -> DataFrame:
    """Where every text and its edited text, as in ``compare_edits``, differ.

    Result: doc_id, n_paragraphs, n_edited (paragraphs of both), removed, added, moved.
    """
    pairs = _edited(docs).select("doc_id", "text", "edited")
    for text, tree in (("text", "_own"), ("edited", "_edited")):
        pairs = trees(pairs, text, tree)
    places = pairs.withColumn("_places", located(F.col("_own"), F.col("_edited")))
    return places.select(
        "doc_id", F.size("_own.paragraphs").alias("n_paragraphs"), F.size("_edited.paragraphs").alias("n_edited"), "_places.*"
    )
