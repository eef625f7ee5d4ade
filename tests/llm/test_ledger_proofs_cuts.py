"""Rule ledger, manifest proofs and fill-in-the-middle against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codesift.llm import fill_middle, manifest, queries, rule_ledger

from . import data


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Rule ledger


def measured(text):
    words = data.WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if data.WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def bits(m):
    fails = [
        m["n_words"] < 50, 100 * m["n_repeat_words"] > 50 * m["n_words"], 10 * m["n_symbols"] > m["n_words"],
        2 * m["n_dup_lines"] > m["n_lines"], m["word_chars"] < 2 * m["n_words"], m["word_chars"] > 20 * m["n_words"],
    ]
    return sum(f << i for i, f in enumerate(fails))


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_measurements_and_bits(spark):
    """Every odd text, also repeated rows, rows without doc_id, windows in other case and across texts."""
    extra = [(100, "A b c a b c A b c"), (101, "x y\nx y\n X y\n\t\nx y"), (102, "a b c"), (103, "b c a"), (104, "é" * 2_000_000 + " z z z z"), (None, "q")]
    docs = data.docs(spark).select("doc_id", "text", F.lit(1).alias("n_words"), F.lit("x").alias("fail_bits")).union(
        spark.createDataFrame(extra, "doc_id long, text string").selectExpr("*", "1", "'x'")
    )
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        m = measured(r["text"])
        want[(r["doc_id"], *m.values(), bits(m))] += 1
    assert rows_of(rule_ledger.record(rule_ledger.measure(docs))) == want


def test_policies_and_ablations(spark):
    rng = random.Random(5)
    ledger = spark.createDataFrame([(i, rng.choice([0, 0, 1, 2, 3, 4, 8, 12, 63])) for i in range(500)], "doc_id long, fail_bits long")
    rows = ledger.collect()
    for policy in rule_ledger.POLICIES:
        mask = sum(1 << r.bit for r in rule_ledger.RULES if r.name in policy.rules)
        names = {1 << r.bit: r.name for r in rule_ledger.RULES}
        got = {r["doc_id"]: (r["policy"], r["kept"], r["sole_rule"]) for r in rule_ledger.apply_policy(ledger, policy).collect()}
        assert got == {r["doc_id"]: (f"{policy.name}@{policy.version}", r["fail_bits"] & mask == 0, names.get(r["fail_bits"] & mask)) for r in rows}
        table = {r["rule"]: r for r in rule_ledger.ablations(ledger, (policy,)).collect()}
        assert set(table) == set(policy.rules)
        for rule in rule_ledger.RULES:
            if rule.name in policy.rules:
                without = sum(r["fail_bits"] & mask & ~(1 << rule.bit) == 0 for r in rows)
                kept = sum(r["fail_bits"] & mask == 0 for r in rows)
                found = table[rule.name]
                assert (found["kept"], found["regained"], found["rejected"]) == (kept, without - kept, sum(r["fail_bits"] >> rule.bit & 1 for r in rows))


def test_policies_keep_clean_documents(spark):
    """Of the documents labelled good that pass the base rules, none goes; of the bad ones most do."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = rule_ledger.apply_policy(rule_ledger.record(rule_ledger.measure(docs)), rule_ledger.POLICIES[-1])
    judged = judged.where(rule_ledger.failed(rule_ledger.BASE) == 0).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r["quality"]: r["kept"] for r in judged.collect()}
    assert kept[1] == 1.0 and kept[0] < 0.1


def test_empty_ledger(spark):
    ledger = rule_ledger.record(rule_ledger.measure(data.empty(spark)))
    assert ledger.isEmpty() and rule_ledger.ablations(ledger).isEmpty() and rule_ledger.apply_policy(ledger, rule_ledger.BASE).isEmpty()


# Manifest


def tree(leaves, arity):
    """Root of some digests, and the runs' other members on the way from every leaf."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for leaf, i in enumerate(at):
            first = i - i % arity
            paths[leaf].append(("".join(level[first:i]), "".join(level[i + 1 : first + arity])))
        level = [sha(*level[i : i + arity]) for i in range(0, len(level), arity)]
        at = [i // arity for i in at]
    return level[0], paths


def plain_proofs(rows, arity):
    groups = {}
    for group, key, digest in rows:
        groups.setdefault(group, []).append((key is not None, key or 0, digest))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([d for *_, d in sorted(groups[g])], arity) for g in names]
    root, tops = tree([t[0] for t in trees], arity)
    out = Counter()
    for g, (sub, paths), top in zip(names, trees, tops, strict=True):
        for (has, key, digest), path in zip(sorted(groups[g]), paths, strict=True):
            out[g, key if has else None, digest, sub, root, tuple(path + top)] += 1
    return out


def check_proofs(spark, rows, arity=2):
    leaves = spark.createDataFrame(rows, "group string, key long, digest string").repartition(3).withColumns({"leaf": F.col("key"), "tree": F.lit("x")})
    got = manifest.prove(leaves, arity).withColumn("folded", manifest.fold(F.col("digest"), F.col("path"))).collect()
    assert all(r["folded"] == r["root"] and r["leaf"] == r["key"] and r["tree"] == "x" for r in got)
    found = Counter((r["group"], r["key"], r["digest"], r["subroot"], r["root"], tuple((s["left"], s["right"]) for s in r["path"] if s)) for r in got)
    assert found == plain_proofs(rows, arity)


@pytest.mark.parametrize("arity", [2, 3])
def test_proofs(spark, arity):
    """Trees of many heights, over a block; null groups and keys, repeated keys and rows, keys out of order."""
    rng = random.Random(arity)
    sizes = {None: 1, "": 2, "é": 3, "a": 600, "B": 5, "漢": 9, "b": 17}
    rows = [(g, rng.choice([None, -3, rng.randrange(10**6)]), sha(str(rng.randrange(n)))) for g, n in sizes.items() for _ in range(n)]
    check_proofs(spark, rows + rows[5:9], arity)


@pytest.mark.parametrize("rows", [[("a", 1, sha("x"))], [("a", 1, sha("x")), ("b", 1, sha("y"))], [("a", 2, sha("x")), ("a", 1, sha("y")), (None, 3, sha("z"))]])
def test_small_trees(spark, rows):
    check_proofs(spark, rows)


def test_many_groups(spark):
    check_proofs(spark, [(f"g{i}", i, sha(str(i))) for i in range(300)])


def test_no_rows(spark):
    leaves = spark.createDataFrame([], "group string, key long, digest string")
    assert manifest.prove(leaves).collect() == []


def test_shuffled_ancestors(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BROADCAST_BYTES", 0)
    check_proofs(spark, [("a" if i % 3 else "b", i, sha(str(i))) for i in range(700)])


def test_op12_on_odd_rows(spark, tmp_path):
    folder = str(tmp_path / "t")
    data.docs(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    digest = lambda r, more=0: sha(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"] if r["n_chars"] is None else r["n_chars"] + more, r["text"])))
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = Counter()
    places = {}
    for (lang, doc, leaf, sub, root, path), n in plain_proofs([(r["lang"], r["doc_id"], digest(r)) for r in rows], 2).items():
        places.setdefault((lang, doc, leaf), []).extend([(sub, root, path)] * n)
    for r in rows:
        leaf = digest(r)
        sub, root, path = places[r["lang"], r["doc_id"], leaf].pop()
        folded = digest(r, 1) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 else leaf
        for left, right in path:
            folded = sha(left, folded, right)
        want[r["doc_id"], leaf, sub, root, sha(*[a + b for a, b in path]), folded, folded == root] += 1
    assert rows_of(queries.op12_manifest(spark, folder)) == want
    assert {r[-1] for r in want} == {True, False}


# Fill in the middle


def plain_cut(doc, text):
    text = text or ""
    h = [int(sha(f"1:{'' if doc is None else doc}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_cuts(spark):
    """Every odd text, line ends of all kinds, beginnings of marks at the cuts, replacement characters, a very long text."""
    texts = ["a b\x85c\r\n\n", "x<", "<" * 30, "<P" * 9, "S>M><" * 5, "$1\\1$3\\" * 7, "a<P>b", "<M>", "😀" * 3000 + "é", "漢" * 2_000_000 + "z"]
    rows = data.rows() + [(i + 1000, t, *[None] * 8) for i, t in enumerate(texts * 8)]
    docs = spark.createDataFrame(rows, data.SCHEMA).withColumns({"n": F.lit("x"), "h1": F.lit(0), "a": F.lit(0), "form": F.lit("y")}).repartition(4)
    got = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restore(F.col("output"), F.col("form")))
    found = rows_of(got.select("doc_id", "n", "form", "prefix_units", "middle_units", "output", "back"))
    want = Counter((r[0], *plain_cut(r[0], r[1]), r[1] or "") for r in rows)
    assert found == want
    assert {f[2] for f in found} == {"plain", "psm", "spm"}


def test_other_units_and_marks(spark):
    """Lines as units, marks with characters that patterns and replacements would read."""
    marks = ("[a]", "(s|$1", "m\\*.")
    docs = spark.createDataFrame([(i, "\n".join(f"line {j}" for j in range(i))) for i in range(60)], "doc_id long, text string")
    cut = fill_middle.fill_in_middle(docs, cut_percent=100, spm_percent=50, marks=marks, unit=r"(?:[^\n]*+\n|[^\n]++\z)")
    rows = cut.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"), marks)).join(docs, "doc_id").collect()
    assert all(r["back"] == r["text"] and r["n"] == (r["text"].count("\n") + 1 if r["text"] else 0) for r in rows)
    for r in rows:
        if r["form"] == "psm":
            lines = r["text"].splitlines(True)
            a, b = r["prefix_units"], r["prefix_units"] + r["middle_units"]
            assert r["output"] == "".join([marks[0], *lines[:a], marks[1], *lines[b:], marks[2], *lines[a:b]])
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_no_texts(spark):
    assert fill_middle.fill_in_middle(data.empty(spark)).collect() == []


def test_cut_without_python(spark):
    plan = fill_middle.fill_in_middle(data.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange hash" not in plan
