"""Operator 13 against whole texts encoded by the libraries and aligned in plain Python."""
from collections import Counter

import public_tokenizers as P
import pytest

from helpers import docs_frame, edge_texts, rows_of, sha

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = edge_texts() + [
    "two  spaces   three", "  lead", "trail ", "trail  ", " ", "tab\tand\n newline \n\n  x", "nbsp    y", "<|endoftext|> and </s> <s>x",
    "plain ▁ mark", "▁", "一龥鿿\U00020000 汉字 かな", "é ́x ´ ​　 z", "\U0001F468‍\U0001F469 \U0001F1E9\U0001F1EA", "it's we'll  don't 12 345",
    "\x1c \x85 \x1f a", "<0x41> <0x0A>"]


def brute(texts):
    from panelforge.llm.align import Tokenizers
    t = Tokenizers(*PATHS)
    found, count = [], Counter()
    for text in texts:
        found.append(None)
        if not text:
            continue
        whole = " " + text
        ends = []
        for ids, size in ((t.a.encode(whole, add_special_tokens=False).ids, t.a_bytes), (t.b.encode(text), t.b_bytes)):
            at, joined = 0, b""
            ends.append([])
            for i in ids:
                at += len(size[i])
                joined += size[i]
                ends[-1].append((at, i))
            if joined != whole.encode():
                break
        else:
            links = [(i, j) for e, i in ends[0] for f, j in ends[1] if e == f] if len(whole) < 3000 else [
                (i, dict(ends[1])[e]) for e, i in ends[0] if e in {f for f, _ in ends[1]}]
            stops = sorted({e for e, _ in ends[0]} & {f for f, _ in ends[1]})
            said, low = [], 0
            for e in stops:
                said.append("|".join(",".join(str(i) for f, i in x if low < f <= e) for x in ends))
                low = e
            found[-1] = len(ends[0]), len(ends[1]), len(stops), links, ";".join(said)
            count.update(links)
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(count[x] == most[x[1]] for x in f[3]), sum(count[x] for x in f[3]), sha(f[4]))
            for f in found]


def run(spark, docs, **kw):
    from panelforge.llm.align import align, sha256_or_empty, weigh
    return weigh(align(docs, *PATHS, render=sha256_or_empty), **kw).withColumnRenamed("groups", "groups_sha256")


@pytest.mark.parametrize("head", [1 << 18, 7, 0])
def test_equal_to_whole_texts(spark, head):
    texts = [t for t in TEXTS if t is None or len(t) < 20000]
    got = {r["doc_id"]: r for r in run(spark, docs_frame(spark, enumerate(texts)).repartition(3), head=head).collect()}
    cols = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for i, want in enumerate(brute(texts)):
        assert tuple(got[i][c] for c in cols) == want, texts[i]


def test_memo_and_partitions(spark):
    from panelforge.llm import align as A
    docs = docs_frame(spark, enumerate(edge_texts() * 2))
    want = rows_of(run(spark, docs.coalesce(1)))
    assert rows_of(run(spark, docs.repartition(7))) == want
    one = A.Aligner(A.Tokenizers(*PATHS))
    say = lambda text: [one.groups[i] for i in one.numbers([text])[0]]
    first = say("some words here")
    one.clear()
    say("other words")
    assert say("some words here") == first and len(first) == 3


def test_spans_are_refined():
    """Coarse cuts of tokens that share a character are moved to their decoded bytes."""
    import numpy as np

    from panelforge.llm.align import cuts
    x = np.array
    assert cuts(x([0, 1, 1, 4]), x([1, 4, 4, 6]), x([1, 2, 1, 2])).tolist() == [1, 3, 4, 6]
    assert cuts(x([0, 3, 3, 3]), x([3, 3, 3, 6]), x([3, 1, 1, 1])).tolist() == [3, 4, 5, 6]
    assert cuts(x([0, 0]), x([2, 2]), x([1, 1])).tolist() == [1, 2]


def test_groups_as_text(spark):
    from panelforge.llm.align import align
    texts = ["two words", "é一 x", None]
    got = {r["doc_id"]: r["groups"] for r in align(docs_frame(spark, enumerate(texts)), *PATHS).collect()}
    assert [sha(got[i]) if got[i] else "" for i in range(3)] == [b[6] for b in brute(texts)]


def test_empty_table_and_null_ids(spark):
    assert run(spark, docs_frame(spark, [])).count() == 0
    got = run(spark, docs_frame(spark, [(None, "a b"), (None, "a b"), (3, None)])).collect()
    assert sorted((r["doc_id"] is None, r["n_links"]) for r in got) == [(False, 0), (True, 2), (True, 2)]


def test_tokens_over_spaces_are_refused(monkeypatch):
    from panelforge.llm.align import Tokenizers
    monkeypatch.setattr(Tokenizers, "_piece", lambda self, i: b"a b")
    with pytest.raises(ValueError):
        Tokenizers(*PATHS)
