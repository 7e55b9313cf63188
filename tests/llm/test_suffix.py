"""Operator 11 against every 100-byte string looked up in plain Python."""
import random

import numpy as np
import pytest

from helpers import docs_frame, edge_texts, rows_of, sha

WINDOW = 100


def brute(rows):
    """Sorted rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256) of distinct documents (doc_id, text)."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        hit = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - WINDOW + 1):
            w = raw[i:i + WINDOW]
            if w in seen:
                hit[i:i + WINDOW] = 1
            seen.add(w)
        kept = bytes(b for b, h in zip(raw, hit) if not h)
        out.append((d, len(raw), int(hit.sum()), int((np.diff(hit, prepend=0) == 1).sum()), sha(kept)))
    return out


def run(docs, **kw):
    from panelforge.llm.suffix import digest, remove_repeats
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return [tuple(r[c] for c in cols) for r in sorted(digest(remove_repeats(docs, **kw)).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))]


def texts():
    rng = random.Random(8)
    line = "All of this text is under a licence that nobody has read to its end. "
    passage = "".join(rng.choice("abcdefgh ") for _ in range(180))
    noise = lambda n: "".join(rng.choice("abcdefghij klmnop\n") for _ in range(n))
    made = edge_texts() + ["ab" * 300, "ab" * 301, "é" * 120, "\U0001F600" * 40, noise(99), noise(100), passage, passage[:99], passage[1:101], passage[20:130] + "x"]
    made += [noise(rng.randint(0, 60)) + line + noise(rng.randint(0, 60)) for _ in range(30)]           # frequent, but too short
    made += [noise(rng.randint(0, 90)) + passage + noise(rng.randint(0, 90)) + passage for _ in range(20)]
    copy = noise(500)
    made += [copy] * 5 + [copy[:250] + "!" + copy[250:], copy[100:350], noise(50) + copy[200:] + noise(50), "x" * 3 + passage * 3]
    near = list(copy)
    for i in range(0, 500, 101):
        near[i] = "Z"
    return made + ["".join(near)]


DOCS = list(enumerate(texts()))


@pytest.fixture(scope="module")
def want():
    return brute(DOCS)


@pytest.mark.parametrize("kw,parts", [({}, 1), ({}, 9), ({"hot": 8}, 5), ({"hot": 2, "bits": 1 << 15, "chunk": 10}, 3), ({"chunk": 1}, 40)])
def test_every_string(spark, want, kw, parts):
    docs = docs_frame(spark, DOCS[::-1]).repartition(parts)
    assert run(docs, **kw) == want


def test_whole_documents_of_a_table(spark):
    from helpers import SF
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert run(docs) == brute([tuple(r) for r in docs.collect()])


def test_runs_of_window_starts(monkeypatch):
    """Pieces don't depend on how many window starts are looked at together."""
    from panelforge.llm import suffix as S
    data = [t.encode() for _, t in DOCS if t]
    raw, off = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    windows = lambda found: sorted((int(s), int(k), int(p)) for k, p, lo, hi in zip(*found) for s in range(lo, hi + 1))
    whole = windows(S.find_pieces(raw, off))
    assert [s for s, _, _ in whole] == [i for a, z in zip(off, off[1:]) for i in range(a, z - WINDOW + 1)]
    monkeypatch.setattr(S, "RUN", 37)
    assert windows(S.find_pieces(raw, off)) == whole
    monkeypatch.setattr(S, "SLICE", 100)
    import pyarrow as pa
    assert b"".join(r.tobytes() for _, r, _ in S._documents(pa.array(data))) == raw.tobytes()


def test_bit_map_holds_all_keys(spark):
    from panelforge.llm.suffix import bit_map
    keys = [(k,) for k in (0, 1, -1, 5, 1 << 40, -(1 << 63), (1 << 63) - 1, 32767, 32768)]
    made = bit_map(spark.createDataFrame(keys, "key bigint"))
    at = [k % (8 * len(made)) for k, in keys]
    assert all(made[i >> 3] >> (i & 7) & 1 for i in at) and sum(map(int.bit_count, made.tolist())) == len(set(at))


def test_ties_nulls_and_empty(spark):
    assert run(docs_frame(spark, [])) == []
    t = "0123456789" * 5 + "".join(map(chr, range(40, 120)))
    got = run(docs_frame(spark, [(4, t), (4, t), (None, t), (9, None), (9, "")]))
    gone = (len(t), len(t), 1, sha(""))
    assert got == [(None, len(t), 0, 0, sha(t)), (4, *gone), (4, *gone), (9, 0, 0, 0, sha("")), (9, 0, 0, 0, sha(""))]
    same = run(docs_frame(spark, [(4, t), (4, t)]).repartition(2))
    assert same == [(4, len(t), 0, 0, sha(t))] * 2
    # different texts of one doc_id are ordered by a hash: one of them keeps the common string
    both = run(docs_frame(spark, [(4, t + "a"), (4, t + "b")]))
    assert sorted(r[2] for r in both) == [0, len(t)]
    assert rows_of(docs_frame(spark, [(4, t + "b"), (4, t + "a")])) and sorted(run(docs_frame(spark, [(4, t + "b"), (4, t + "a")]))) == sorted(both)
