"""The registered queries and the whole pipeline on the smallest tables, against SQL or plain code."""

import hashlib
import os
import sys

import numpy as np
import pytest
from test_learned import brute_classes

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from parity import connect, rows  # noqa: E402

from strideloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_parity(spark, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), connect(SF).sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_op1(spark):
    v = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = {}
    for r in result(spark, "op1_permutation_index"):
        assert r.score == pytest.approx(float(v[r.query_id] @ v[r.vec_id]), rel=1e-12)
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(got) == {i for i in v if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        assert [r for r, _ in sorted(found)] == list(range(1, 21))
        want = sorted((-float(v[q] @ v[i]), i) for i in v if i != q)[:20]
        hits += len({i for _, i in want} & {i for _, i in found})
    assert hits >= 0.9 * 20 * len(got)


def test_op5(spark, texts):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for d, t in texts.items():
        ids = sp.encode(t)
        want[d] = (len(ids), sha(",".join(map(str, ids)).encode()), sha(sp.decode(ids).encode() if ids else b""))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in result(spark, "op5_piece_codec")} == want


def test_op9(spark, texts):
    seen, want = set(), {}
    for d in sorted(texts):
        b = texts[d].encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            x = b[i : i + 100]
            if x in seen:
                gone[i : i + 100] = True
            seen.add(x)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        want[d] = (len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone])))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in result(spark, "op9_suffix_dedup")} == want


def test_op10(spark, texts):
    assert sorted((r.doc_id, r.class_id) for r in result(spark, "op10_bag_minhash")) == brute_classes(list(texts.items()))


def test_pipeline_run(spark, texts):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"]
    ids = {r.doc_id for r in got.collect()}
    assert ids <= set(texts) and len(ids) > 0.5 * len(texts)


def test_pipeline_stages_of_awkward_tables(spark):
    """Nulls, empty and repeated rows, a column of a clashing name, and no rows at all."""
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, drop string, score string"
    some = [(1, None, "en", "a", 0, "d", "s"), (2, "", None, None, 0, "d", "s"), (None, "the cat and the dog", "en", "a", 19, None, "s"),
            (3, "le chat et le chien", "fr", "b", 19, "d", None), (3, "le chat et le chien", "fr", "b", 19, "d", None)]
    for table in (some, []):
        d = spark.createDataFrame(table, kind)
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, d, SF)
            if name != "piece_codec":
                assert out.columns == d.columns
            held = out.collect()
            assert len(held) <= 2 * len(table) + 2
            d = spark.createDataFrame(held, out.schema)


