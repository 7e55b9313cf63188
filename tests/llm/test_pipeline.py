import importlib

import pytest
from helpers import SF01 as SF
from helpers import docs_frame, edge_texts, sha

import corpus_pipeline as cp
from panelforge.llm import common, secrets


def kept(spark, k, docs, sf=SF):
    out = cp.STAGES[k][1](spark, docs, sf)
    if k < 4:
        assert out.columns == docs.columns
    return out


def test_stages_against_brute_force(spark):
    decontam, simhash = importlib.import_module("test_decontam"), importlib.import_module("test_simhash")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda d: [(r["doc_id"], r["text"]) for r in d.collect()]
    one = common.stage(kept(spark, 0, docs), "t0")
    assert 0.7 * docs.count() < one.count() < docs.count()
    two = common.stage(kept(spark, 1, one), "t1")
    assert sorted(d for d, _ in rows(two)) == sorted({c for c, _, _ in simhash.brute(rows(one))})
    three = common.stage(kept(spark, 2, two), "t2")
    assert sorted(d for d, _ in rows(three)) == sorted(b[1] for b in decontam.brute(rows(two), items) if not b[0])
    four = common.stage(kept(spark, 3, three), "t3")
    n = secrets.Novelty()
    before = dict(rows(three))
    after = {r["doc_id"]: r for r in four.collect()}
    assert before.keys() == after.keys()
    for d, t in before.items():
        want = secrets.redact(t, [{"kind": k, "start": a, "end": b} for a, b, k in secrets.scan(t, n)])
        assert after[d]["text"] == want and after[d]["n_chars"] == len(want)
    five = kept(spark, 4, four).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in five} == {d: sha(r["text"]) for d, r in after.items()}
    assert all(r["ids_sha256"] == sha(",".join(map(str, r["ids"]))) and r["n_tokens"] == len(r["ids"]) for r in five)


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100


@pytest.mark.parametrize("k", range(5))
def test_edge_rows(spark, k):
    texts = edge_texts()
    df = docs_frame(spark, list(enumerate(texts)) + [(5, texts[5]), (None, None), (None, "z")])
    out = kept(spark, k, df)
    assert out.count() > 0
    if k < 4:
        assert out.filter("score <> 'xscore' OR _rest <> 'x_rest' OR score IS NULL").count() == 0
    assert kept(spark, k, df.limit(0)).count() == 0
