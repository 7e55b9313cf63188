import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF, SF01, docs_frame, edge_texts, low

from panelforge.llm import lm

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    words = [(d, SPLIT.findall(low(t)) + [None]) for d, t in rows]
    count = Counter()
    for d, w in words:
        if d is not None and zlib.crc32(str(d).encode()) % 10:
            count.update(w)
    n, v = sum(count.values()), len(count)
    out = []
    for d, w in words:
        s = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((str(d), d is not None and zlib.crc32(str(d).encode()) % 10 == 0, len(w), sum(count[x] > 0 for x in w), n, round(s, 5)))
    return sorted(out)


def got(df):
    rows = lm.score(df.select("doc_id", "text"), *lm.train(df.select("doc_id", "text"))).collect()
    assert all(np.isfinite(r["score"]) and r["score"] <= 1e-9 for r in rows)
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows), rows


def test_tokens():
    texts = ["A b  C\t", "", None, "\n", "a", "x" * 50, "é É a", "b\x0bc"]
    seq, off = lm.tokens(pa.array(texts))
    ids = {}
    for t, a, b in zip(texts, off[:-1], off[1:]):
        words = SPLIT.findall(low(t))
        assert b - a == len(words) + 1 and seq[b - 1] == lm.END
        for w, h in zip(words, seq[a:b]):
            assert ids.setdefault(w, h) == h
    assert len(set(ids.values())) == len(ids)


def test_words_on_which_polynomial_hashes_fail():
    words = []
    for n in (16, 31, 32, 64, 1024, 4096):
        word = [bin(i).count("1") % 2 for i in range(n)]  # Thue-Morse
        words += ["".join("ab"[b] for b in word), "".join("ba"[b] for b in word), "".join("aé"[b] for b in word), "".join("éa"[b] for b in word)]
    seq, off = lm.tokens(pa.array([" ".join(words), *words]))
    assert len(set(seq[:off[1] - 1].tolist())) == len(words)
    assert seq[:off[1] - 1].tolist() == seq[off[1:-1]].tolist()


def test_tokens_across_slices(monkeypatch):
    text = " ".join(f"w{i % 97}{'é' * (i % 5)}" for i in range(3000))
    texts = [text, None, text[:777], "", "z" * 900, text]
    whole = lm.tokens(pa.array(texts))
    monkeypatch.setattr(lm, "SLICE", 256)
    cut = lm.tokens(pa.array(texts))
    assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])
    part = lm.tokens(pa.array(["skip", *texts]).slice(1))
    assert np.array_equal(part[0], whole[0])


def test_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    t = lm.Table(keys)
    assert np.array_equal(t.find(keys), np.arange(len(keys)))
    assert (t.find(rng.integers(1 << 63, (1 << 64) - 1, 5000, dtype=np.uint64)) == -1).all()
    assert (lm.Table(np.zeros(0, np.uint64)).find(keys) == -1).all()


def test_base_score_and_counts(spark):
    texts = edge_texts()
    rows = list(enumerate(texts)) + [(40 + i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[5]), (None, None), (77, "unseen words only")]
    mine, _ = got(docs_frame(spark, rows))
    assert mine == brute(rows)


@pytest.mark.parametrize("head", [0, 3, 50])
def test_any_head_gives_the_same_base(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    texts = edge_texts()
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    assert got(docs_frame(spark, rows))[0] == brute(rows)


def test_empty(spark):
    df = docs_frame(spark, [(1, "a")])
    assert got(df.limit(0))[0] == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    mine, rows = got(docs_frame(spark, [(held, "a b")]))  # nothing to learn from
    assert mine == brute([(held, "a b")]) and rows[0]["score"] == 0.0


def test_probabilities_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 300)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    counts, model = lm.train(docs)
    table = counts.toPandas()
    h = table["h"].to_numpy(np.int64).view(np.uint64)
    c = table["c"].to_numpy(float)
    at = model.table.find(h)
    seq, offsets = lm.tokens(pa.array(["the the thing of"]))
    _, _, rows = model.prepare(seq, offsets)
    z = model.log_probs(model.weights, rows, slice(0, len(seq)))
    first = 1 + lm.TOP + lm.SHAPES
    shape = (h & np.uint64(15)).astype(int)
    for p in np.exp(z.astype(float)):
        frequent = (p[model.cls[at[at >= 0]]] * np.exp(model.inside[at[at >= 0]])).sum()
        s = shape[at < 0]
        rare = (p[first + s] * (1 - model.unseen[s]) * c[at < 0] / model.size[first + s]).sum()
        total = frequent + rare + (p[first:] * model.unseen).sum()
        present = np.zeros(lm.CLASSES, bool)
        present[model.cls] = True
        present[first:] = True
        assert abs(total + p[~present].sum() - 1) < 1e-4


def test_model_beats_the_base_on_held_out_texts(spark):
    from panelforge.llm import queries as q
    rows = [r for r in q.QUERIES["op3_maxent_lm"](spark, SF01).collect() if r["held_out"]]
    assert rows and sum(r["score"] for r in rows) > 0.95 * sum(r["base_score"] for r in rows)
    assert sum(r["score"] > r["base_score"] for r in rows) > 0.9 * len(rows)


@pytest.mark.parametrize("shard", [1 << 21, 5000])
def test_scores_do_not_depend_on_partitions(spark, monkeypatch, shard):
    monkeypatch.setattr(lm, "SHARD", shard)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")

    def scores(d):
        counts, model = lm.train(d)
        return {r["doc_id"]: r["score"] for r in lm.score(d, counts, model).collect()}

    want = scores(docs.coalesce(1))
    for n in (3, 12):
        mine = scores(docs.repartition(n))
        assert mine.keys() == want.keys() and all(abs(mine[k] - v) <= 1e-9 * abs(v) for k, v in want.items())
