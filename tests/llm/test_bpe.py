import random

import pytest
from helpers import SF, docs_frame, edge_texts, rows_of, sha

from panelforge.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
NAMES = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]


def pair(name):
    import tiktoken
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    return bpe.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", NAMES)
def test_same_ids_as_merging(name):
    mine, other = pair(name)
    rng = random.Random(1)
    plain = [t.decode() for t in mine.ranks if max(t) < 128]
    alphabets = ["abcdeinrst", "aàéèê ", "0123456789 ,.!?'", "的一是不了人我", "́\U0001F600\U0001F9D1‍ ñß\n\t", "  \n"]
    for k in range(4000):
        s = "".join(rng.choice(plain) for _ in range(rng.randint(1, 8))) if k % 2 else \
            "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 50)))
        ids = mine.encode(s)
        assert ids == other.encode_ordinary(s)
        assert mine.decode(ids) == s.encode()


def test_long_piece_is_linear():
    mine, other = pair(NAMES[0])
    for s in ("ab" * 50_000, " " * 50_000, "é" * 30_000, "!" * 40_000):
        assert mine.encode(s) == other.encode_ordinary(s)


def test_toy_vocabulary_takes_tokens_back():
    # "abc" is the longest match of "abcd", yet merging gives ab, cd
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"cd": 257, b"abc": 258, b"bcd": 259}
    c = bpe.Codec(ranks, r".+")
    assert c.encode("abcd") == [256, 257] and c.encode("abc") == [258] and c.encode("bcd") == [259]


def test_frames(spark):
    _, other = pair(NAMES[0])
    texts = edge_texts()
    docs = list(enumerate(texts)) + [(5, texts[5]), (None, "x y")]
    df = docs_frame(spark, docs)
    got = rows_of(bpe.encode_documents(spark, df, public_tokenizers.path(NAMES[0]), public_tokenizers.PATTERN))
    want = []
    for d, t in docs:
        ids = other.encode_ordinary(t or "")
        want.append((sha(t or ""), d, sha(",".join(map(str, ids))), len(ids)))
    assert got == sorted(want, key=repr)
    assert bpe.encode_documents(spark, df.limit(0), public_tokenizers.path(NAMES[0]), public_tokenizers.PATTERN).count() == 0
    kept = bpe.encode(df, bpe.read_ranks(spark, public_tokenizers.path(NAMES[0])), public_tokenizers.PATTERN)
    assert set(kept.columns) == set(df.columns) and kept.filter("score = 'xscore'").count() == len(docs)


def test_query(spark):
    from panelforge.llm import queries as q
    _, other = pair(NAMES[0])
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in q.QUERIES["op2_byte_bpe"](spark, SF).collect():
        ids = other.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r["doc_id"]] or ""))
