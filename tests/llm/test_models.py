"""Language, quality, toxicity, SentencePiece: held-out accuracy, exact round trips, odd cases."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as library
from pyspark.sql import functions as F

from codesift.llm import language, quality, sentencepiece, toxicity
from codesift.llm.words import word_hashes

from . import data

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
SF = "/root/testdata/sf0.01"


def test_word_hashes(monkeypatch):
    texts = [t or "" for t in data.texts()]
    hashes, _, counts = word_hashes(texts)
    words = [w for t in texts for w in data.WORD.findall(t)]
    assert counts.tolist() == [len(data.WORD.findall(t)) for t in texts]
    low = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    assert len(set(hashes.tolist())) == len(set(low))
    known = {}
    assert all(known.setdefault(w, h) == h for w, h in zip(low, hashes.tolist(), strict=True))
    monkeypatch.setattr("codesift.llm.words.SLICE", 1000)
    assert (word_hashes(texts)[0] == hashes).all()


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language.fit(docs.where(~held_out).select("text", "lang"))
    found = language.identify(docs.where(held_out), model).join(docs, "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)
    odd = {r["doc_id"]: r["lang_pred"] for r in language.identify(data.docs(spark), model).collect()}
    assert odd[4] == odd[5] == odd[6] == "und" and odd[0] == odd[1] and set(odd.values()) <= {"und", *model.languages}
    assert language.identify(data.empty(spark), model).count() == 0


def test_every_language_is_learned(spark):
    """More languages than the landmarks' bound allows in full, one of them with a hot copied text."""
    rng = random.Random(4)
    words = {f"l{n:03}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)] for n in range(230)}
    rows = [(lang, " ".join(rng.choices(own, k=30))) for lang, own in words.items() for _ in range(6)]
    rows += [("l000", "always the very same text")] * 3000 + [(None, "x"), ("l001", None), ("zz", "123")]
    model = language.fit(spark.createDataFrame(rows, "lang string, text string").repartition(6))
    assert model.languages == sorted(words) and len(model.landmarks) <= language.ALL_LANDMARKS
    tried = spark.createDataFrame([(n, lang, " ".join(rng.choices(own, k=30))) for n, (lang, own) in enumerate(words.items())], "doc_id long, lang string, text string")
    found = language.identify(tried, model).join(tried, "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.95


def test_kernel_ridge_by_brute_force(spark):
    """Scores are those of ridge regression in the landmarks' span, with kernels counted over sets of n-grams."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang IS NOT NULL").orderBy("doc_id").limit(40)
    rows = docs.collect()
    model = language.fit(docs.select("text", "lang"), landmarks=5)
    sets = {r["text"]: frozenset(np.flatnonzero(language.presence_matrix([r["text"]])[0]).tolist()) for r in rows}
    order = {r["text"]: r["draw"] for r in docs.select("text", F.xxhash64("text").alias("draw")).collect()}
    train = sorted({(r["lang"], order[r["text"]], r["text"]) for r in rows if any(c.isalpha() for c in r["text"])})
    marks = []
    for lang in model.languages:
        own = list(dict.fromkeys(sets[t] for x, _, t in train if x == lang))
        marks += own[:5]

    def kernel(a, b):
        return len(a & b) / max(1.0, math.sqrt(len(a) * len(b)))

    cross = np.array([[kernel(sets[t], m) for m in marks] for *_, t in train])
    inner = np.array([[kernel(a, b) for b in marks] for a in marks])
    counts = Counter(lang for lang, *_ in train)
    share = np.array([1 / counts[lang] / len(counts) for lang, *_ in train])
    goal = np.array([[1.0 if lang == x else -1.0 for x in model.languages] for lang, *_ in train])
    weights = np.linalg.solve(cross.T @ (share[:, None] * cross) + language.RIDGE * inner + 1e-9 * np.eye(len(marks)), cross.T @ (share[:, None] * goal))
    margin = np.array([[kernel(sets[r["text"]], m) for m in marks] for r in rows]) @ weights
    want = np.clip((margin.max(axis=1) + 1) / 2, 0, 1)
    got = {r["doc_id"]: r["score"] for r in language.identify(docs, model).collect()}
    assert max(abs(got[r["doc_id"]] - w) for r, w in zip(rows, want, strict=True) if any(c.isalpha() for c in r["text"])) < 2e-3


def test_language_without_labels(spark):
    model = language.fit(data.empty(spark).select("text", "lang"))
    assert {r["lang_pred"] for r in language.identify(data.docs(spark), model).collect()} == {"und"}


def test_presence_is_the_kernel_of_shared_ngrams(monkeypatch):
    def grams(t):
        t = " " + "".join(c.lower() if c.isalpha() else " " for c in t) + " "
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    a, b = "The small cat.", "A small hat?"
    x = language.presence_matrix([a, b])
    want = len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5
    assert float(x[0] @ x[1]) == pytest.approx(want, abs=0.02)
    monkeypatch.setattr(language, "_SLICE", 5)
    assert np.allclose(language.presence_matrix([a, b]), x)


def test_sentencepiece(spark):
    whole = library.SentencePieceProcessor(model_file=MODEL)
    random.seed(3)
    marks = [" ", "  ", "▁", "a", "the", "\n", "\t", "é", "漢", "😀", "x" * 300, "<s>", "\x00"]
    texts = [t or "" for t in data.texts()] + ["".join(random.choices(marks, k=random.randint(0, 12))) for _ in range(2000)]
    table = sentencepiece.Chunks(MODEL)
    assert table.separable
    for text, (ids, back) in zip(texts, table.encode(texts), strict=True):
        want = whole.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want and back == whole.decode(want)


def test_sentencepiece_table_bound(monkeypatch):
    texts = [t or "" for t in data.texts()]
    want = list(sentencepiece.Chunks(MODEL).encode(texts))
    monkeypatch.setattr(sentencepiece, "TABLE", 10)
    monkeypatch.setattr(sentencepiece, "BLOCK", 100)
    assert list(sentencepiece.Chunks(MODEL).encode(texts)) == want


def test_sentencepiece_rows(spark):
    got = sentencepiece.encode(data.docs(spark), MODEL)
    assert got.count() == len(data.rows()) and sentencepiece.encode(data.empty(spark), MODEL).count() == 0
    by_id = {r["doc_id"]: r for r in got.withColumn("list", sentencepiece.id_list(F.col("ids"))).collect()}
    assert by_id[4]["list"] == by_id[5]["list"] == [1, 2] and by_id[5]["decoded"] == ""
    assert by_id[0]["list"] == np.frombuffer(by_id[0]["ids"], "<u4").tolist()
    back = {r["doc_id"]: r["text"] for r in sentencepiece.decode(got, MODEL).collect()}
    assert all(back[i] == r["decoded"] for i, r in by_id.items() if i is not None)


def labelled(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    chain = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"), chain)
    got = toxicity.classify(docs, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "truth"), "doc_id").collect()
    assert sum(r["toxic"] != (r["truth"] == 1) for r in got) <= 0.1 * len(got)
    assert sum(r["toxic"] and r["truth"] == 1 for r in got) >= 0.6 * sum(r["truth"] == 1 for r in got)
    # The later model sees the earlier category's probability.
    assert len(model.weights[1]) == len(model.weights[0]) + 1
    odd = toxicity.classify(data.docs(spark), model)
    assert odd.count() == len(data.rows()) and odd.where("p_toxic IS NULL").count() == 0
    assert toxicity.classify(data.empty(spark), model).count() == 0


def test_copies_share_a_fold(spark):
    """Exact copies always, texts with one word changed mostly; the folds are about equal."""
    rng = random.Random(11)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(80)) for _ in range(300)]
    near = [" ".join(["other", *t.split()[1:]]) for t in base]
    rows = [(i, t) for i, t in enumerate([*base, *base, *near, "", "one two", "One  two"])]
    got = [r[1] for r in sorted(spark.createDataFrame(rows, "i int, text string").select("i", toxicity.fold_of(F.col("text"))).collect())]
    assert got[:300] == got[300:600] and set(got) == set(range(toxicity.FOLDS))
    assert sum(a == b for a, b in zip(got[:300], got[600:900], strict=True)) >= 280
    assert max(got[:300].count(k) for k in range(toxicity.FOLDS)) < 90
    assert got[-1] == got[-2]


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels.limit(0), {"toxic": F.col("toxic") == 1})
    assert toxicity.classify(docs, model).where("toxic").count() == 0


def test_quality(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    got, least = quality.resample(docs, model)
    rows = got.join(labels, "doc_id").collect()
    assert sum(r["kept"] and r["quality"] == 0 for r in rows) <= 3 and sum(not r["kept"] and r["quality"] == 1 for r in rows) <= 3
    assert quality.select(docs, model).count() == got.where("kept").count()
    # Gumbel top-k by brute force.
    keys = sorted((r["key"] for r in got.collect()), reverse=True)
    assert keys[sum(r["log_weight"] > model.cut for r in got.collect()) - 1] == least


def test_quality_against_a_plain_version(spark):
    """Weights recomputed from counts, the draw from a sort, for several k and seeds."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(docs, labels)
    rows = docs.select("doc_id", "text").collect()
    grams = {r["doc_id"]: quality._grams([r["text"]])[0].tolist() for r in rows}
    drawn = {r["doc_id"] for r in labels.where("quality = 1").where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0).collect()}
    raw, good = Counter(g for x in grams.values() for g in x), Counter(g for i, x in grams.items() if i in drawn for g in x)
    share = sum(good.values()) / sum(raw.values())
    ratio = {g: math.log((good[g] + 1) / (n * share + 1)) for g, n in raw.items()}
    weight = {i: sum(ratio[g] for g in x) / max(len(x), 1) for i, x in grams.items()}
    for seed, k in ((7, None), (7, 20), (8, 20), (9, 150)):
        noise = {r[0]: r[1] for r in docs.select("doc_id", quality._gumbel(seed)).collect()}
        got = {r["doc_id"]: r for r in quality.resample(docs, model, k, seed)[0].collect()}
        assert all(abs(got[i]["log_weight"] - weight[i]) < 1e-6 for i in weight)
        number = sum(w > model.cut for w in weight.values()) if k is None else k
        best = sorted(weight, key=lambda i: -(quality.LENGTH * weight[i] + noise[i]))[:number]
        assert {i for i, r in got.items() if r["kept"]} == set(best)


def test_quality_noise_decides_near_the_cut(spark):
    """Of weights all around the cut, rows below it are drawn and rows above it are not, others with another seed; far from it none changes."""
    text = {0: "good fine text " * 8, 1: "##bad $$worse %%worst " * 8}
    docs = spark.createDataFrame([(i, " ".join([text[0]] * (40 - i // 10) + [text[1]] * (i // 10))) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(400)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    draws = []
    for seed in (1, 2):
        rows = quality.resample(docs, model, 200, seed)[0].collect()
        middle = sorted((r["log_weight"] for r in rows), reverse=True)[199]
        assert sum(r["kept"] for r in rows) == 200
        assert any(r["kept"] and r["log_weight"] < middle for r in rows) and any(not r["kept"] and r["log_weight"] > middle for r in rows)
        draws.append({r["doc_id"] for r in rows if r["kept"]})
    assert draws[0] != draws[1] and all(set(range(20)) <= d and not d & set(range(380, 400)) for d in draws)


def test_quality_odd(spark):
    docs = data.docs(spark)
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, 1), (None, 1), (9, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert quality.select(docs, model).columns == docs.columns
    assert quality.resample(docs, model)[0].count() == len(data.rows())
    nothing = quality.fit(docs, labels.limit(0))
    assert quality.select(docs, nothing).count() == len(data.rows())
    assert quality.select(data.empty(spark), quality.fit(data.empty(spark), labels)).count() == 0
