"""Near duplicates of texts and of vectors, components, and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codesift.llm import embeddings, near_dedup
from codesift.llm.components import components

from . import data


def test_components(spark):
    random.seed(2)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    ids = sorted({x for a, b in links if a != b for x in (a, b)})
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == data.components(ids, [(a, b) for a, b in links if a != b])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(table):
    sets = {i: data.shingles(t) for i, t in table}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, data.components(ids, links)


def test_near_duplicates(spark):
    random.seed(4)
    table = list(enumerate(data.texts()))
    for g in range(6):
        words = [f"g{g}w{random.randrange(50)}" for _ in range(80)]
        for _ in range(7):
            copy = list(words)
            for _ in range(random.randrange(4)):
                copy[random.randrange(80)] = f"z{random.random()}"
            table.append((len(table), " ".join(copy)))
    got = near_dedup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()
    sets, want = brute(table)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in got)
    assert len(set(want.values())) < len(want)


def test_near_duplicates_odd(spark):
    docs = data.docs(spark)
    got = near_dedup.near_duplicates(docs)
    assert got.count() == len(data.rows()) and got.where("doc_id IS NULL AND kept").count() == 2
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    parts = brute(list(enumerate(data.texts())))[1]
    assert [r["doc_id"] for r in left.where("doc_id IS NOT NULL").orderBy("doc_id").collect()] == [i for i, c in parts.items() if i == c]
    assert near_dedup.near_duplicates(data.empty(spark)).count() == 0 == near_dedup.drop_near_duplicates(data.empty(spark)).count()


def test_every_text_of_a_repeated_id_is_compared(spark):
    """Id 2 has two texts, each near another document, an empty one and a copy: all are one component, whatever the order of rows."""
    base = [" ".join(f"{tag}{i}" for i in range(60)) for tag in "abc"]
    near = [t + " end" for t in base]
    rows = [(2, base[1]), (2, base[2]), (2, ""), (2, base[1]), (3, near[2]), (4, near[1]), (5, base[0]), (6, near[0]), (None, base[1]), (9, base[1].upper())]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        got = sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect() if r["doc_id"] is not None)
        assert got == [(2, 2)] * 4 + [(3, 2), (4, 2), (5, 5), (6, 5), (9, 2)]
        assert sorted(str(r["doc_id"]) for r in near_dedup.drop_near_duplicates(df).collect()) == ["2", "5", "None"]


def test_blocks_and_salts(spark, monkeypatch):
    """Large groups are compared in blocks and by several tasks."""
    monkeypatch.setattr(near_dedup, "SALT_ROWS", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    words = [f"w{i}" for i in range(300)]
    table = [(i, " ".join(words[: 150 + 9 * i])) for i in range(17)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == brute(table)[1]


def test_superminhash():
    rng = np.random.default_rng(1)
    errors = []
    for n, common in ((1, 1), (3, 2), (50, 30), (400, 320), (3000, 1500)):
        for _ in range(5):
            x = rng.integers(1, 1 << 62, 2 * n - common).astype(np.uint64)
            a, b = near_dedup.superminhash([x[:n], x[n - common :]])
            assert len(set((a >> np.uint64(32)).tolist())) <= near_dedup.SLOTS and (a != ~np.uint64(0)).all()
            errors.append((a == b).mean() - common / (2 * n - common))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.15
    # Of one element the ranks are a permutation of the slots.
    one = near_dedup.superminhash([np.array([99], np.uint64)])[0]
    assert sorted((one >> np.uint64(32)).tolist()) == list(range(near_dedup.SLOTS))


def vectors(spark, n=700):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 16))
    x[100:160] = x[100] + 0.05 * rng.normal(size=(60, 16))
    x[200:230] = x[200] + 0.22 * rng.normal(size=(30, 16))
    x[300:305] = x[300] * np.arange(1, 6)[:, None]
    x[400:403] = x[400]
    rows = [(i, [float(v) for v in x[i]], "same") for i in range(n)]
    rows += [(n, None, None), (n + 1, [0.0] * 16, None), (n + 2, [1.0, None] + [0.0] * 14, None), (n + 3, [float("nan")] * 16, None), (n + 4, [float("inf")] * 16, None), (n + 5, [1.0, 2.0], None), (n + 6, [], None)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string").repartition(3)


def test_embeddings(spark):
    x, df = vectors(spark)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    want = data.components(range(len(x)), zip(*np.nonzero(near), strict=True))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    assert len(got) == len(x) + 7
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(axis=1).tolist()
    assert {i: got[i]["component_id"] for i in range(len(x))} == want
    assert all(got[len(x) + k]["n_links"] == 0 and got[len(x) + k]["kept"] for k in range(7))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 24))
    x[:800] = x[0] + 0.1 * x[:800]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = embeddings.Graph(x)
    who, rows = graph.search(x[:1500], graph.audited_beam(embeddings.BEAM, 0.9)[0], 0.9)
    found, true = set(zip(who.tolist(), rows.tolist(), strict=True)), set(zip(*(a.tolist() for a in np.nonzero(x[:1500] @ x.T >= 0.9 + 1e-5)), strict=True))
    assert len(found) == len(who) and len(true & found) >= 0.99 * len(true)


def hot_and_pairs(n=8000, hot=2600, d=24):
    """A hot cluster of unequal near copies beside many pairs, in noise."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, d))
    x[:hot] = x[0] + 0.1 * rng.normal(size=(hot, d))
    x[hot + 1 :: 2] = x[hot:-1:2] + 0.2 * rng.normal(size=((n - hot) // 2, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.permutation(n)]


def test_audit_sees_lost_pairs(monkeypatch):
    """A walk that loses all links to other rows but those of hot rows, or all of other shards' queries, does not pass."""
    x = hot_and_pairs()
    graph, others = embeddings.Graph(x[::2]), x[1::2]
    many = (x[::2] @ x[::2].T >= 0.9).sum(axis=1) > 100
    walked = embeddings.Graph.walk

    def losing(lost):
        def walk(self, q, k, start, beam, limit=None, within=2.0):
            best, hits = walked(self, q, k, start, beam, limit, within)
            if within < 2 and beam == embeddings.BEAM:
                bad = lost(q)
                itself = [np.einsum("nd,nd->n", q[w], self.x[r]) > 1 - 1e-6 for w, r in hits]
                best[bad], hits = -1, [(w[s | ~bad[w]], r[s | ~bad[w]]) for (w, r), s in zip(hits, itself, strict=True)]
            return best, hits

        return walk

    def is_own(q):
        return (q @ graph.x.T).max(axis=1) > 1 - 1e-6

    hot = x[::2][many].mean(axis=0)
    monkeypatch.setattr(embeddings.Graph, "walk", losing(lambda q: q @ hot < 0.9 * np.linalg.norm(hot)))
    assert graph.audited_beam(embeddings.BEAM, 0.9)[0] > embeddings.BEAM
    monkeypatch.setattr(embeddings.Graph, "walk", losing(lambda q: ~is_own(q)))
    assert graph.audited_beam(embeddings.BEAM, 0.9, others[:500])[0] > embeddings.BEAM


def test_recall_beside_a_hot_cluster():
    x = hot_and_pairs()
    graph, q = embeddings.Graph(x[::2]), x[1::2]
    who, rows = graph.search(q, graph.audited_beam(embeddings.BEAM, 0.9, q[:500])[0], 0.9 - 1e-4)
    found = np.zeros((len(q), len(x[::2])), bool)
    found[who, rows] = True
    true = q @ x[::2].T >= 0.9
    linked = true.any(axis=1)
    assert ((true & found).sum(axis=1)[linked] / true.sum(axis=1)[linked]).mean() >= 0.99


def test_shards_of_thousands_are_walked(spark, monkeypatch):
    """Hundreds of links over several shards and blocks: no shard compares all its rows, and recall against brute force is 0.99."""
    rng = np.random.default_rng(12)
    n, d = 26_000, 48
    x = rng.normal(size=(n, d))
    x[1:1201:2] = x[:1200:2] + 0.25 * rng.normal(size=(600, d))
    x[2000:2300] = x[2000] + 0.12 * rng.normal(size=(300, d))
    monkeypatch.setattr(embeddings, "SHARDS", 4)
    monkeypatch.setattr(embeddings, "QUERY_ROWS", 10_000)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, shard int").repartition(8)
    rows = sorted(embeddings.near_duplicates(df).collect())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links, pairs = np.zeros(n, int), []
    for part in range(0, n, 2000):
        near = unit[part : part + 2000] @ unit.T >= 0.9
        near[np.arange(len(near)), part + np.arange(len(near))] = False
        links[part : part + 2000] = near.sum(axis=1)
        pairs += [(part + a, b) for a, b in zip(*np.nonzero(near), strict=True)]
    assert links.sum() > 2000
    got = np.array([r["n_links"] for r in rows])
    assert (got <= links).all() and got.sum() >= 0.99 * links.sum()
    want = data.components(range(n), pairs)
    assert np.mean([r["component_id"] == want[r["vec_id"]] for r in rows]) > 0.9995
    assert {r["beam"] for r in rows} == {max(r["beam"] for r in rows)} and rows[0]["beam"] <= 400 and rows[0]["recall"] >= embeddings.RECALL


def test_probes_widen_a_beam_that_is_too_narrow():
    """Rows without any link are audited too."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 96))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = embeddings.Graph(x)
    probes = graph._probes(0.9)
    beam, recall = graph.audited_beam(1, 0.9)
    assert 1 < beam < len(x) and recall >= embeddings.RECALL
    again = embeddings.Graph.of(x, graph.arrays())
    for q in (probes, x[:50]):
        assert [a.tolist() for a in graph.search(q, beam, 0.9)] == [a.tolist() for a in again.search(q, beam, 0.9)]


def test_repeated_and_null_ids_of_vectors(spark):
    """Vectors of one id make one component, whatever they link to; rows without id link with nothing."""
    near, far = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    rows = [(5, [1.0, 0.0, 0.0]), (3, far), (3, near), (9, [0.0, 2.0, 0.0]), (None, near), (None, far), (7, [0.0, 0.0, 1.0])]
    got = sorted(map(tuple, embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).select("vec_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([(5, 3, False), (3, 3, True), (3, 3, True), (9, 3, False), (None, None, True), (None, None, True), (7, 7, True)], key=str)


def test_no_row_of_a_cluster_is_lost():
    """The first beam finds all links within clusters; no row of a graph takes many more links than others."""
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(20, 64)), 150, axis=0) + 0.2 * rng.normal(size=(3000, 64))
    x = np.concatenate([x, rng.normal(size=(3000, 64))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.permutation(len(x))]
    graph = embeddings.Graph(x)
    some = np.linspace(0, len(x) - 1, 512).astype(int)
    q, rows = graph._linked(graph.x[some], graph.order[some], 0.9)
    assert len(rows) > 200 and graph._recall(q, rows, embeddings.BEAM, 0.9) == 1.0
    assert graph.links[0].shape[1] <= 2 * embeddings.DEGREE + embeddings.ATTACHED + 8


def test_comparison_of_all_rows():
    x = hot_and_pairs(600, 200)
    graph = embeddings.Graph(x[:300])
    who, rows = graph.search(x, 300, 0.9)
    true = np.nonzero(x.astype(np.float32) @ x[:300].astype(np.float32).T >= 0.9)
    assert sorted(zip(who.tolist(), rows.tolist(), strict=True)) == sorted(zip(*(a.tolist() for a in true), strict=True))
    assert [len(a) for a in graph.search(x[:0], 300, 0.9)] == [0, 0]


def test_pipeline(spark, tmp_path):
    """Every stage against its own input by plain versions; the whole gives what the stages give."""
    folder = data.tables(spark, tmp_path / "in")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        before, rows = docs.collect(), after.collect()
        if name != "sentencepiece":
            assert after.columns == columns
        if name == "quality":
            assert {tuple(r) for r in rows} <= {tuple(r) for r in before}
        elif name == "line_dedup":
            want = data.cut_lines([(r["doc_id"], r["text"]) for r in before])
            changed = {r["doc_id"] for r in before if want[r["doc_id"]] != r["text"]}
            want = {i: t for i, t in want.items() if i not in changed or data.WORD.search(t)}
            assert {r["doc_id"]: r["text"] for r in rows} == want
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
        elif name == "near_dedup":
            parts = brute([(r["doc_id"], r["text"]) for r in before])[1]
            assert sorted(r["doc_id"] for r in rows) == sorted(i for i, c in parts.items() if i == c)
        elif name == "mixing":
            assert {tuple(r) for r in rows} <= {tuple(r) for r in before}
            assert max(sum(r["doc_id"] == i for r in rows) for i in {r["doc_id"] for r in rows}) <= 2
        else:
            assert len(rows) == len(before)
        docs = after
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("column", ["doc_id", "text", "source"])
def test_pipeline_stages_take_null_columns(spark, tmp_path, column):
    folder = data.tables(spark, tmp_path / "in")
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn(column, F.when(F.col("doc_id") % 2 == 0, F.col(column)))
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(at)))
        docs = spark.read.parquet(str(tmp_path / str(at)))
