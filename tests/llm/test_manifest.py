"""Operator 12 against a tree built in plain Python, and against SQL."""
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import EXTRA, SF, edge_texts, parity, sha

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def leaf(d, s, g, n, t):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d, s, g, n, t)))


def up(nodes):
    return [sha("".join(nodes[i:i + 2])) for i in range(0, len(nodes), 2)]


def climb(nodes):
    """(root, by node its (sibling, node is left) from below)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            paths[k].append((nodes[i ^ 1] if i ^ 1 < len(nodes) else None, i % 2 == 0))
        nodes, at = up(nodes), [i // 2 for i in at]
    return nodes[0], paths


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified)."""
    groups = defaultdict(list)
    for d, t, g, s, n in rows:
        tampered = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
        groups[b"-" if g is None else b"=" + g.encode()].append(
            (d is not None, d or 0, leaf(d, s, g, n, t), leaf(d, s, g, n + 1, t) if tampered else None))
    names = sorted(groups)
    done = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, tops = climb([done[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for (has, d, a, other), path in zip(sorted(groups[g], key=lambda x: x[:3]), done[g][1]):
            now = other or a
            for sibling, left in path + top:
                now = sha(now if sibling is None else now + sibling if left else sibling + now)
            out.append((d if has else None, a, done[g][0], root, sha("".join(s for s, _ in path + top if s)), now, now == root))
    return sorted(out, key=repr)


def run(df):
    from panelforge.llm.manifest import manifest, verify
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = verify(manifest(df, {"n_chars": F.col("n_chars") + F.when(tampered, 1).otherwise(0)}))
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr)


def rows(n=150, seed=1):
    rng = random.Random(seed)
    langs = ["en"] * 8 + ["de", "é", "zh\U0001F600", "", None, "-"]
    made = [(i, t, rng.choice(langs), rng.choice(["s", None]), None if t is None else len(t)) for i, t in enumerate(edge_texts() + ["x"] * n)]
    return made + [made[0], made[5], (7, "again", "en", "s", 5), (7, "again", "en", "s", 5), (None, "t", "en", None, 1), (None, "u", "en", None, None),
                   (None, "u", "en", None, None), (9999, "alone", "solo", "s", 5)]


@pytest.mark.parametrize("tier", [1, 3, 8])
def test_tree_and_proofs(spark, monkeypatch, tier):
    from panelforge.llm import manifest as M
    monkeypatch.setattr(M, "TIER", tier)
    data = rows()
    random.Random(tier).shuffle(data)
    assert run(spark.createDataFrame(data, SCHEMA).repartition(5)) == brute(data)


def test_full_buckets(spark, monkeypatch):
    from panelforge.llm import manifest as M
    monkeypatch.setattr(M, "TIER", 2)
    for n in (1, 2, 4, 5, 16, 17, 64):
        data = [(i, "t", "en", "s", 1) for i in range(n)]
        assert run(spark.createDataFrame(data, SCHEMA)) == brute(data), n


def test_empty_and_clashing_columns(spark):
    from panelforge.llm.manifest import manifest, verify
    assert verify(manifest(spark.createDataFrame([], SCHEMA))).count() == 0
    extra = [*EXTRA, "g", "leaf", "path", "n", "at", "digest"]
    df = spark.createDataFrame([(3, "a", None, None, 1)], SCHEMA).select("*", *[F.lit("x").alias(c) for c in dict.fromkeys(extra)])
    assert [r[1:4] for r in run(df)] == [(leaf(3, None, None, 1, "a"),) * 3]


def test_sql(spark):
    parity(spark, "op12_manifest", SF)
