"""Fingerprints, sharding, mixing and line dedup against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codesift.llm import fingerprints, line_dedup, mixing, sharding

from . import data


CUT = re.compile("(?s).{64,255}?[ ,;:、。，；：！？]|.{1,256}")


def nodes(plan):
    return [x for x in ("Python", "Pandas", "Arrow") if x in plan]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tree(text):
    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    leaves = []
    for p in text.split("\n"):
        for end in (". ", "! ", "? "):
            p = p.replace(end, end + "\n")
        leaves.append([sha(x) for s in p.split("\n") for x in (re.findall(CUT, s) or [""])])
    joined = ""
    digests = [sha(",".join(x)) for x in leaves]
    for d in digests[:-1]:
        joined += d + ("|" if d[-1] in "0123" else ";")
    sections = [sha(x) for x in (joined + digests[-1]).split("|")]
    return sha("/".join(sections)), [x for p in leaves for x in p]


def like(a, b):
    (ra, la), (rb, lb) = tree(a), tree(b)
    return 1.0 if ra == rb else 2 * len(set(la) & set(lb)) / (len(set(la)) + len(set(lb)))


def test_fingerprints(spark):
    got = {r["doc_id"]: r for r in fingerprints.compare_edits(data.docs(spark, False)).collect()}
    texts = {i: t or "" for i, t in enumerate(data.texts())}
    ids = sorted(texts, reverse=True)
    for at, i in enumerate(ids):
        own, after = texts[i], texts[ids[(at + 1) % len(ids)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        row = got[i]
        assert row["n_chars"] == len(own)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == tree(own)[0] and row["edited_fingerprint"] == tree(edited)[0]
        assert row["near_edited"] == like(own, edited) and row["near_next"] == like(own, after)


def test_texts_without_sentence_ends(spark):
    """The kept half of a long text shows, with blanks, without, and beyond the basic plane; so does the text around an insertion."""
    rng = random.Random(4)
    blanks = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(3000))
    solid = "".join(rng.choices("qwertyuiop", k=20_000))
    wide = "".join(rng.choices("𠀀𠀁𠀂漢字かな😀", k=5000))
    rows = [(3, blanks), (2, solid), (1, wide)]
    got = {r["doc_id"]: r for r in fingerprints.compare_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, own), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        assert got[i]["fingerprint"] == tree(own)[0] and got[i]["edited_fingerprint"] == tree(edited)[0]
        assert got[i]["near_edited"] == like(own, edited) > 0.25 and got[i]["near_next"] < 0.1
    assert like(blanks, blanks[:5000] + "an insertion " + blanks[5000:]) > 0.9


def test_fingerprints_odd(spark):
    got = fingerprints.compare_edits(data.docs(spark)).collect()
    assert len(got) == len(data.rows())
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (0, 1)}) == 1
    assert fingerprints.compare_edits(data.empty(spark)).count() == 0
    one = fingerprints.compare_edits(data.docs(spark, False).where("doc_id = 12")).first()
    assert one["near_next"] == 1.0
    assert not nodes(plan_of(fingerprints.compare_edits(data.docs(spark).repartition(2))).split("Scan")[0])


def test_edits_locate_paragraphs(spark):
    df = spark.createDataFrame([("a\nb\nc", "a\nB\nc")], "x string, y string")
    df = fingerprints.trees(fingerprints.trees(df, "x", "tx"), "y", "ty")
    assert df.select(fingerprints.edits(F.col("tx"), F.col("ty"))).first()[0] == [1]


def longest_rising(ranks):
    best = []
    for i, x in enumerate(ranks):
        best.append(1 + max((best[j] for j in range(i) if ranks[j] < x), default=0))
    return max(best, default=0)


def test_located_edits(spark):
    """Removed, added and moved paragraphs by position and count, against a plain version, and the edits made anew."""
    rng = random.Random(8)
    table = [("x\ny", "y\nx"), ("x\ny", "x\ny\nz"), ("x\nx\ny", "x\ny"), ("a", "a"), ("", "q"), ("a\nb\nc\nd", "b\nc\nd\na")]
    for _ in range(150):
        a = [f"p{rng.randrange(40)}" for _ in range(rng.randrange(1, 30))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b) + 1)
            if rng.random() < 0.4:
                b.insert(at, f"p{rng.randrange(45)}")
            elif len(b) > 1:
                out = b.pop(at % len(b))
                if rng.random() < 0.5:
                    b.insert(rng.randrange(len(b) + 1), out)
        table.append(("\n".join(a), "\n".join(b)))
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(table)], "id int, x string, y string")
    df = fingerprints.trees(fingerprints.trees(df, "x", "tx"), "y", "ty")
    got = {r["id"]: r["e"] for r in df.select("id", fingerprints.located(F.col("tx"), F.col("ty")).alias("e")).collect()}
    assert [(got[i]["removed"], got[i]["added"], [tuple(m) for m in got[i]["moved"]]) for i in (1, 2, 3)] == [([], [2], []), ([1], [], []), ([], [], [])]
    assert len(got[0]["moved"]) == 1 and [tuple(m) for m in got[5]["moved"]] == [(0, 3)]
    for i, (x, y) in enumerate(table):
        x, y, e = x.split("\n"), y.split("\n"), got[i]
        moved = [tuple(m) for m in e["moved"]]
        assert all(x[p] == y[q] for p, q in moved)
        assert Counter(x[p] for p in e["removed"]) == Counter(x) - Counter(y)
        assert Counter(y[q] for q in e["added"]) == Counter(y) - Counter(x)
        gone, come = {*e["removed"], *(p for p, _ in moved)}, {*e["added"], *(q for _, q in moved)}
        # What stays is the same on both sides, in order.
        assert [w for p, w in enumerate(x) if p not in gone] == [w for q, w in enumerate(y) if q not in come]
        start = next((n for n, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        end = next((n for n, (p, q) in enumerate(zip(x[start:][::-1], y[start:][::-1], strict=False)) if p != q), min(len(x), len(y)) - start)
        # No fewer could have moved, given how occurrences are paired.
        places, ranks = {}, []
        for q in range(start, len(y) - end):
            places.setdefault(y[q], []).append(q)
        for p in range(start, len(x) - end):
            if places.get(x[p]):
                ranks.append(places[x[p]].pop(0))
        assert len(moved) == len(ranks) - longest_rising(ranks)


def test_located_edits_of_documents(spark):
    rows = fingerprints.locate_edits(data.docs(spark)).collect()
    assert len(rows) == len(data.rows())
    for r in rows:
        assert r["n_paragraphs"] - len(r["removed"]) == r["n_edited"] - len(r["added"])
    assert fingerprints.locate_edits(data.empty(spark)).count() == 0
    assert not nodes(plan_of(fingerprints.locate_edits(data.docs(spark).repartition(2))).split("Scan")[0])


def test_sharding(spark):
    docs = data.docs(spark)
    got = sharding.assign(docs).collect()
    assert len(got) == len(data.rows())
    by_id = {r["doc_id"]: r for r in got}
    for i, t in enumerate(data.texts()):
        assert by_id[i]["size"] == len((t or "").encode()) + 1
        assert by_id[i]["text_crc32"] == zlib.crc32((t or "").encode())
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert sharding.assign(data.empty(spark)).count() == 0
    assert not nodes(plan_of(sharding.assign(docs)))


@pytest.mark.parametrize("shards", [5, 16, 20])
def test_a_new_shard_takes_rows_only_into_itself(spark, shards):
    ids = spark.range(20_000)
    before, after = (sharding.shard_of(F.col("id").cast("string"), sharding.topology(n, shards)) for n in (shards, shards + 1))
    moved = ids.select(before.alias("a"), after.alias("b")).groupBy("a", "b").count().collect()
    assert {r["b"] for r in moved if r["a"] != r["b"]} == {shards}
    sizes = [sum(r["count"] for r in moved if r["a"] == s) for s in range(shards)]
    assert min(sizes) > 0.8 * 20_000 / shards and max(sizes) < 1.2 * 20_000 / shards


def test_changed_weights_move_rows_within_the_changed_subtree(spark):
    key, tree_ = F.col("id").cast("string"), sharding.topology(8)
    old, new = sharding.shard_of(key, tree_), sharding.shard_of(key, tree_, {1: 2.0})
    pairs = spark.range(5_000).select(old.alias("a"), new.alias("b")).where("a <> b").distinct().collect()
    # Shard 1 lies in the region of shards 0 to 3: nothing moves within the other region.
    assert pairs and all(r["b"] < 4 for r in pairs)


def fill(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(cap * sizes[s] for s in full)) / max(1, sum(weight[s] for s in rest))
        more = {s for s in rest if level * weight[s] >= cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else level * weight[s] for s in names}
        full |= more


def test_mixing(spark):
    table = [(i, " ".join("w" * (i * 7 % 23 + 1)), ["a", "b", "c", "d", None][i % 5 if i % 3 else 0]) for i in range(400)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    sizes = {}
    for _, t, s in table:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = fill(sizes)
    for s, size in sizes.items():
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {size}
        assert mine[0]["target"] == pytest.approx(want[s], abs=1e-6)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 12
        assert all(r["taken"] <= 2 * r["size"] for r in mine)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    assert mixing.repeat(docs).count() == sum(r["repeats"] for r in got)
    assert not nodes(plan_of(mixing.mix(docs)))


def test_mixing_odd(spark):
    docs = data.docs(spark)
    got = mixing.mix(docs)
    assert got.count() == len(data.rows())
    assert got.where("size = 0 AND taken > 0").count() == 0
    assert mixing.repeat(docs).columns == docs.columns
    assert mixing.repeat(docs).count() == got.agg(F.sum("repeats")).first()[0]
    assert mixing.mix(data.empty(spark)).count() == 0 == mixing.repeat(data.empty(spark)).count()


def test_line_dedup(spark):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(data.docs(spark, False)).collect()}
    want = data.cut_lines(list(enumerate(data.texts())))
    assert {i: r["text"] for i, r in got.items()} == want
    assert got[13]["n_deleted"] == 3 and got[13]["deleted"][0]["first"] == 2
    assert got[13]["text"] == "Another start!\n\nOther end?" and got[15]["text"] == "head"


def test_line_dedup_odd(spark):
    docs = data.docs(spark)
    got = line_dedup.dedup_lines(docs)
    assert got.columns[: len(docs.columns)] == docs.columns and got.count() == len(data.rows())
    twice = [r["text"] for r in got.where("doc_id = 12").collect()]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert line_dedup.dedup_lines(data.empty(spark)).count() == 0
    assert not nodes(plan_of(got))


def test_line_dedup_random(spark):
    import random

    random.seed(5)
    lines = [" ".join(f"{k}x{j}" for j in range(random.choice([1, 3, 20, 55]))) for k in range(6)]
    table = [(i, "\n".join(random.choices([*lines, "", f"only {i}"], k=random.randint(0, 25)))) for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == data.cut_lines(table)
