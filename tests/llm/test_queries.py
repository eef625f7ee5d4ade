"""Registered queries against their SQL, or, where there is none, against plain versions."""

import hashlib

import numpy as np
import pytest
import sentencepiece as library

import __spark_entry__ as contract
from check import compare
from codesift.llm import queries

from . import data

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    ok, text = compare(spark, SF, name)
    assert ok, text


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in queries.table(spark, SF, "documents").collect()}


def test_op1(spark, documents):
    import zlib

    rows = queries.op1_language(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    lang = {r["doc_id"]: r["lang"] for r in queries.table(spark, SF, "documents").collect()}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]) > 0.95


def test_op3(spark, documents):
    sets = {i: data.shingles(t) for i, t in documents.items()}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = data.components(ids, links)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op3_minhash_dedup(spark, SF).collect()} == {i: (len(sets[i]), want[i]) for i in ids}


def test_op7(spark, documents):
    whole = library.SentencePieceProcessor(model_file=queries.sentencepiece_model())
    for r in queries.op7_sentencepiece(spark, SF).collect():
        ids = whole.encode(documents[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(whole.decode(ids).encode()).hexdigest()


def test_op8(spark):
    rows = queries.table(spark, SF, "embeddings").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    ids = [r["vec_id"] for r in rows]
    want = data.components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.op8_embedding_dedup(spark, SF).collect()}
    assert got == {v: (int(near[i].sum()) - 1, want[v]) for i, v in enumerate(ids)}


@pytest.mark.parametrize("name", ["op4_sharding", "op9_toxicity", "op10_quality"])
def test_every_document_is_in_the_result(spark, documents, name):
    assert sorted(r["doc_id"] for r in queries.QUERIES[name](spark, SF).select("doc_id").collect()) == sorted(documents)
