import numpy as np
import pytest
import xxhash
from helpers import SF, docs_frame, edge_texts, low, rows_of

from panelforge.llm import simhash

import re


def fp(text, shingle=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not w:
        return 0
    grams = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, distance=4, shingle=4):
    f = {t: fp(t, shingle) for _, t in rows}
    u = sorted(set(f.values()))
    parent = {x: x for x in u}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, x in enumerate(u):
        for y in u[i + 1:]:
            if (x ^ y).bit_count() <= distance:
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    least = {}
    for d, t in rows:
        if d is not None:
            r = find(f[t])
            least[r] = min(least.get(r, d), d)
    return sorted(((least.get(find(f[t])), d, f"{f[t]:016x}") for d, t in rows), key=repr)


def rows():
    base = edge_texts()[13].split()
    near = [" ".join(base[:k] + ["zz"] + base[k + 1:]) for k in range(100, 2000, 60)]
    short = [" ".join(base[:n]) for n in (1, 2, 3, 4, 5, 6)]
    texts = edge_texts() + near + short
    return [(900 - i, t) for i, t in enumerate(texts)] + [(3, near[0]), (3, near[0]), (None, near[1]), (None, "lonely words here now"), (None, None)]


def test_brute_force(spark):
    r = rows()
    assert rows_of(simhash.digest(simhash.near_duplicates(docs_frame(spark, r)))) == brute(r)


@pytest.mark.parametrize("distance", [0, 3, 6])
def test_other_distances(spark, distance):
    r = rows()[:40]
    assert rows_of(simhash.digest(simhash.near_duplicates(docs_frame(spark, r), 3, distance))) == brute(r, distance, 3)


def test_position_sets():
    import itertools
    for d in range(8):
        sets = simhash.position_sets(d)
        assert all(any(set(s) <= set(q) for s in sets) for q in itertools.combinations(range(8), 8 - d))
    assert len(simhash.position_sets(4)) == 20


def test_long_lists_lose_no_link(spark, monkeypatch):
    # a dense cluster and a chain, in lists far longer than the limit
    monkeypatch.setattr(simhash, "LIST", 8)
    rng = np.random.default_rng(1)
    start = int(rng.integers(0, 1 << 62))
    cluster = {start}
    while len(cluster) < 90:
        x = start
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            x ^= 1 << int(b)
        cluster.add(x)
    for _ in range(60):
        x ^= (0b1111 << int(rng.integers(0, 60)))
        cluster.add(x)
    u = sorted(cluster)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in u], "fp bigint")
    roots = {r["node"]: r["root"] for r in simhash.connected(simhash.links(df, 4)).collect()}
    mine = {}
    for x in u:
        s = int(np.uint64(x).astype(np.int64))
        mine.setdefault(roots.get(s, s), set()).add(x)
    want = {frozenset(v) for v in _components(u)}
    assert {frozenset(v) for v in mine.values()} == want


def _components(u):
    left, out = set(u), []
    while left:
        todo = [left.pop()]
        comp = set(todo)
        while todo:
            x = todo.pop()
            near = {y for y in left if (x ^ y).bit_count() <= 4}
            left -= near
            comp |= near
            todo += near
        out.append(comp)
    return out


def test_keep_one(spark):
    r = rows()
    df = docs_frame(spark, r)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    want = brute(r)
    got = kept.collect()
    assert sorted(x["doc_id"] for x in got if x["doc_id"] is not None) == sorted({c for c, d, _ in want if c is not None})
    # the one component without any doc_id keeps a row, too
    assert [x["text"] for x in got if x["doc_id"] is None] == ["lonely words here now"]
    assert simhash.keep_one(df.limit(0)).count() == 0
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_query(spark):
    from panelforge.llm import queries as q
    r = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(q.QUERIES["op4_simhash"](spark, SF)) == brute(r)
