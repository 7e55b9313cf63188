import math
import random
import zlib

import numpy as np
from helpers import SF01, SF1, docs_frame, edge_texts

from panelforge.llm import quality, toxicity


def auc(y, s):
    pos = [b for a, b in zip(y, s) if a]
    neg = [b for a, b in zip(y, s) if not a]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def held(spark, name, label, sf):
    from panelforge.llm import queries as q
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    got = q.QUERIES[name](spark, sf).drop("evidence").collect()
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == docs
    rows = [(truth[r["doc_id"]], r["score"], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def test_toxicity_held_out(spark):
    # sf0.01 has six toxic documents held out, two of them labelled so by chance: sf0.1 has 97
    y, s, p = held(spark, "op8_toxicity", "toxic", SF1)
    assert auc(y, s) > 0.93 and sum(a == b for a, b in zip(y, p)) >= 0.97 * len(y)
    assert sum(b for a, b in zip(y, p) if not a) <= 0.015 * y.count(0)


def test_quality_held_out(spark):
    y, s, p = held(spark, "op10_quality", "quality", SF01)
    assert auc(y, s) > 0.95 and sum(a == b for a, b in zip(y, p)) >= 0.95 * len(y)


def test_index_is_exact():
    rng = random.Random(4)
    vectors = []
    for _ in range(700):
        v = {t: rng.random() for t in rng.sample(range(40), rng.randint(0, 5))}
        n = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / n for t, x in v.items()})
    vectors[300] = dict(vectors[20])  # a tie
    index = toxicity.BlockMaxIndex(vectors, [0] * 700, list(range(700)), 40)
    for v in [x for x in vectors[:60] if x]:
        want = [(round(sum(x * u.get(t, 0.0) for t, x in v.items()), 12), i) for i, u in enumerate(vectors)]
        want = sorted((w for w in want if w[0] > 0), key=lambda w: (-w[0], w[1]))[:7]
        got = index.nearest(v, 7)
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [s for s, _ in want])


def labelled(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, toxic int, quality int, text string")


def frame(spark):
    rng = random.Random(0)
    rows = list(enumerate(edge_texts()))
    for i in range(100, 300):
        rows.append((i, " ".join(rng.choice(["good", "kind", "tree", "lake"]) for _ in range(20)) + (" idiot scum" if i % 2 else "")))
    rows += [(150, None), (None, "idiot scum"), (None, None), (999, "scum")]
    labels = [(i, i % 2, 1 - i % 2) for i in range(100, 300)] + [(101, 1, 0), (101, None, None), (None, 1, 1), (555, 1, 1), (3, None, 1)]
    return rows, docs_frame(spark, rows), labelled(spark, labels)


def test_toxicity_edge_rows(spark):
    rows, df, labels = frame(spark)
    model = toxicity.fit(df, labels)
    out = toxicity.classify(df.select("doc_id", "text", "m"), model).collect()
    assert len(out) == len(rows)
    at = {(r["doc_id"], r["text"]): r for r in out}
    assert at[(999, "scum")]["predicted"] == 1 and at[(None, "idiot scum")]["predicted"] == 1
    assert at[(0, None)]["predicted"] == 0 and at[(0, None)]["score"] == at[(1, "")]["score"]
    assert set(at[(999, "scum")]["evidence"]) <= {i for i in range(100, 300) if i % 2}
    assert toxicity.classify(df.limit(0), model).count() == 0
    none = toxicity.fit(df, labels.limit(0))
    assert {r["score"] for r in toxicity.classify(df, none).collect()} == {0.0}
    empty = toxicity.fit(df.limit(0), labels)
    assert {r["predicted"] for r in toxicity.classify(df, empty).collect()} == {0}


def test_toxicity_same_on_any_partitioning(spark):
    _, df, labels = frame(spark)
    score = lambda d: sorted((str(r["doc_id"]), r["text"] or "", r["score"]) for r in toxicity.classify(d.select("doc_id", "text"), toxicity.fit(d, labels)).collect())
    assert score(df) == score(df.repartition(7, "text"))


def test_quality_edge_rows(spark):
    rows, df, labels = frame(spark)
    model = quality.fit(df, labels)
    out = quality.classify(df.select("doc_id", "text", "m"), model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    at = {(r["doc_id"], r["text"]): r for r in out}
    assert at[(0, None)]["score"] == at[(1, "")]["score"]
    assert sum(at[(i, t)]["predicted"] == 1 - i % 2 for i, t in rows[17:217]) >= 190
    assert quality.classify(df.limit(0), model).count() == 0
    assert {r["score"] for r in quality.classify(df, quality.fit(df, labels.limit(0))).collect()} == {1.0}
    assert {r["score"] for r in quality.classify(df, quality.fit(df.limit(0), labels)).collect()} == {1.0}


def test_word_vectors_same_on_any_partitioning(spark):
    _, df, _ = frame(spark)
    assert np.array_equal(quality.word_vectors(df), quality.word_vectors(df.repartition(5, "text")))
    assert np.isfinite(quality.word_vectors(df.limit(0))).all()


def test_toxicity_finds_rare_words(spark):
    """Words of a single example, which no label count can call telling, lead to that example."""
    rows, _, _ = frame(spark)
    odd = [(400 + i, f"zorg{i} blik{i} vrunt{i}") for i in range(20)]
    asked = [(500 + i, f"vrunt{i} zorg{i}") for i in range(20)]
    marks = [(i, i % 2, 1 - i % 2) for i in range(100, 300)] + [(d, int(i < 10), 0) for i, (d, _) in enumerate(odd)]
    df = docs_frame(spark, [r for r in rows if r[0] != 150] + odd + asked)
    labels = labelled(spark, marks)
    kept = {r["doc_id"] for r in labels.filter(~toxicity.held_out()).collect()}
    out = {r["doc_id"]: r for r in toxicity.classify(df, toxicity.fit(df, labels)).collect()}
    tested = [i for i in range(20) if 400 + i in kept]
    assert tested
    for i in tested:
        assert out[500 + i]["evidence"] == [400 + i] and out[500 + i]["predicted"] == int(i < 10)


def brute_table(texts):
    """Word vectors by plain loops over places: what ``quality`` sums in numpy blocks."""
    places, signs = quality.index_vectors()
    sums = {}

    def add(word, context):
        v = sums.setdefault(word, [0.0] * quality.DIMS)
        for p, s in zip(places[context].tolist(), signs[context].tolist()):
            v[p] += s

    for t in texts:
        ws = quality.WORD.findall(t or "")
        ids = [2 + zlib.crc32(w.lower().encode()) % (quality.BUCKETS - 2) for w in ws]
        for i, a in enumerate(ids):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(ids):
                    add(a, ids[j])
            if len(ws[i]) > 1 and ws[i].isupper():
                add(quality.UPPER, a)
            if i and ids[i - 1] == a:
                add(quality.REPEAT, a)
    out = {}
    for w, v in sums.items():
        n = math.sqrt(sum(x * x for x in v))
        out[w] = [x / max(n, 1e-9) for x in v]
    for w in range(quality.BUCKETS):
        v = out.setdefault(w, [0.0] * quality.DIMS)
        for p, s in zip(places[w].tolist(), signs[w].tolist()):
            v[p] += s
    return out


def brute_score(text, table, network):
    ws = quality.WORD.findall(text or "")
    ids = [2 + zlib.crc32(w.lower().encode()) % (quality.BUCKETS - 2) for w in ws]
    held = ids + [quality.UPPER] * sum(len(w) > 1 and w.isupper() for w in ws) + [quality.REPEAT] * sum(a == b for a, b in zip(ids, ids[1:]))
    x = [0.0] * (2 * quality.DIMS + 1)
    for w in held:
        for k, v in enumerate(table[w]):
            x[k] += v / len(ids)
            x[quality.DIMS + k] += v * v / len(ids)
    x[-1] = math.log(1 + len(ids))
    z = [(a - m) / s for a, m, s in zip(x, network.mean, network.scale)]
    first, bias, second, last = network.w
    hidden = [math.tanh(sum(z[i] * first[i][j] for i in range(len(z))) + bias[j]) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, second)) + last[0]) / network.temperature))


def test_quality_by_brute_force(spark):
    """Word table and scores over whole edge texts against plain loops."""
    rows, df, labels = frame(spark)
    table = brute_table([t for _, t in rows])
    got = quality.word_vectors(df)
    assert np.allclose(got, [table[w] for w in range(quality.BUCKETS)], atol=1e-5)
    model = quality.fit(df, labels)
    found = quality.classify(df.select("doc_id", "text"), model).collect()
    seen = {}
    for r in found:
        if r["text"] not in seen:
            seen[r["text"]] = brute_score(r["text"], table, model[1])
        assert abs(r["score"] - seen[r["text"]]) < 1e-3 and r["predicted"] == int(r["score"] >= quality.THRESHOLD)
    assert len(found) == len(rows) and len(seen) > 100


def test_quality_with_far_more_words_than_rows(spark):
    """20 words a row of the word table: most of every text is words of one document, which all share rows."""
    rng = random.Random(1)
    words = 20 * quality.BUCKETS
    kinds = [[f"telling{k}x{i}" for i in range(100)] for k in range(2)]
    rows = []
    for i in range(3000):
        own = [f"w{(i * 110 + j) % words}" for j in range(110)] + rng.choices(kinds[i % 2], k=30)
        rng.shuffle(own)
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id bigint, quality int")
    got = [r for r in quality.digest(quality.classify(df, quality.fit(df, labels))).collect() if r["held_out"]]
    area = auc([r["doc_id"] % 2 for r in got], [r["score"] for r in got])
    print("AUC", area)
    assert len(got) > 400 and area > 0.95
