"""Byte-level BPE encoding and decoding (operator 2).

A text is cut by the tokenizer's split pattern; every piece is encoded on its
own.  The bytes of a piece are read as Latin-1 characters so that an
Aho-Corasick automaton over all tokens gives, in one pass, the longest token
that starts at each byte.  The encoder walks left to right over these longest
matches; a token is accepted when it is *compatible* with the one before it
(merging the two tokens' bytes alone would again give exactly these two).  If
it isn't, the next shorter token that is a prefix is tried, and when none is
left the last accepted token is taken back and its start is marked as dead.
Each byte position is marked dead at most once, so the walk is linear in the
piece; the compatibility of adjacent tokens is memoised.  The result is exactly
what repeated lowest-rank merging gives.

Defined results: a NULL or empty text has no tokens and decodes to no bytes;
lone surrogates cannot occur in Spark strings; repeated rows repeat; further
columns of the input stay.  No table-wide state: every row is encoded alone, so
ties and empty tables need no rule.
"""
from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE = 1 << 17  # distinct pieces remembered by one Python worker
MEMO = 1 << 18   # adjacent token pairs remembered by one Python worker
SLICE = 1 << 20  # characters of text handled (and returned) at once


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> id, from a rank file (one ``base64 id`` pair a line)."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}


def _merge(ranks: dict[bytes, int], token: bytes, below: int) -> list[bytes]:
    """Parts left when only merges of rank under ``below`` are made."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and r < best:
                best, at = r, i
        if at < 0:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Codec:
    """Encoder and decoder for one rank table and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        n = max(ranks.values()) + 1
        self.bytes = [b""] * n
        for t, i in ranks.items():
            self.bytes[i] = t
        self.length = [len(t) for t in self.bytes]
        self.left, self.right = list(range(n)), list(range(n))
        self.pairs: dict[tuple[int, int], int] = {}
        auto = ahocorasick.Automaton()
        usable = set()
        for t, i in ranks.items():
            if len(t) > 1:
                parts = _merge(ranks, t, i)
                if len(parts) != 2:  # merging never builds this token; it only stands for a whole piece
                    continue
                a, b = ranks[parts[0]], ranks[parts[1]]
                self.left[i], self.right[i] = a, b
                self.pairs[a, b] = i
            auto.add_word(t.decode("latin-1"), i)
            usable.add(t)
        auto.make_automaton()
        self.matches = auto.iter
        self.shorter = [-1] * n  # the longest proper prefix that is a token
        for t in usable:
            for k in range(len(t) - 1, 0, -1):
                if t[:k] in usable:
                    self.shorter[ranks[t]] = ranks[t[:k]]
                    break
        self.memo: dict[int, bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Would merging the bytes of a and b give a, b again?"""
        key = a << 32 | b
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            known = self.memo[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the later of the two tokens' merges again and again; at each state, a merge across
        # the border of lower rank than the merge just undone would have come first.
        limit = len(self.bytes)
        while True:
            joined = self.pairs.get((a, b))
            if joined is not None and joined < limit:
                return False
            a_leaf, b_leaf = self.right[a] == a, self.left[b] == b
            if a_leaf and b_leaf:
                return True
            if not a_leaf and (b_leaf or a > b):
                limit, a = a, self.right[a]
            else:
                # equal ranks merge from the left, so a border merge of b's own rank comes first
                limit, b = b + 1, self.left[b]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8")
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        n, length = len(raw), self.length
        longest = [-1] * n
        for end, token in self.matches(raw.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # ends ascend, so the last one is the longest
        out: list[int] = []
        alive = bytearray(b"\1") * (n + 1)
        at, token = 0, longest[0]
        while at < n:
            end = at + length[token]
            if alive[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                alive[at] = 0
                token = out.pop()
                at -= length[token]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        get, extend = self.cache.get, out.extend
        for piece in self.find(text):
            ids = get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= 64:
                    if len(self.cache) >= CACHE:
                        self.cache.clear()
                    self.cache[piece] = ids
            extend(ids)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_codecs: dict[tuple[int, str], Codec] = {}  # one table a Python worker


def _codec(data: bytes, pattern: str) -> Codec:
    key = (hash(data), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(parse_ranks(data), pattern)
    return _codecs[key]


def read_ranks(spark, path: str):
    """The rank file as a broadcast; a vocabulary file has a fixed size (about 1 MB)."""
    with open(path, "rb") as f:  # a file of the driver, not of the corpus
        return spark.sparkContext.broadcast(f.read())


def _spans(lengths: np.ndarray, most: int):
    """Row ranges of a batch with about ``most`` characters each."""
    start = 0
    total = np.concatenate([[0], np.cumsum(lengths)])
    while start < len(lengths):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + most)))
        yield start, min(stop, len(lengths))
        start = min(stop, len(lengths))


def _map_column(df: DataFrame, col: str, out: dict[str, T.DataType], make):
    """Append the columns ``out`` = f(column ``col``) over Arrow batches; other columns pass through
    untouched by position, so clashing names do no harm."""
    kept = [f for f in df.schema.fields if f.name not in out]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in out.items())])
    keep = [df.columns.index(f.name) for f in kept]
    at = df.columns.index(col)

    def run(batches):
        f = make()
        for batch in batches:
            c = batch.column(at)
            sizes = np.diff(np.frombuffer(c.buffers()[1], dtype=np.int32)[c.offset:c.offset + len(c) + 1]) \
                if len(c) and pa.types.is_string(c.type) else np.full(len(c), 1024)
            for a, b in _spans(sizes, SLICE):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *f(part.column(at))], names=schema.names)

    return df.mapInArrow(run, schema)


def _decoded(codec: Codec, flat: list[int], ends: list[int]) -> pa.Array:
    return pa.array([codec.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.binary())


def encode(df: DataFrame, ranks, pattern: str, text_col: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """Append ``out``, the token ids of every text (array of int; empty for NULL), and, if named,
    ``decoded``, the bytes that these ids decode to (the same as ``decode`` afterwards, without a
    second trip of the ids through Python)."""
    def make():
        codec = _codec(ranks.value, pattern)

        def f(texts):
            flat, ends = [], [0]
            for t in texts.to_pylist():
                flat.extend(codec.encode(t or ""))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, dtype=np.int32)))
            return [ids, _decoded(codec, flat, ends)] if decoded else [ids]
        return f

    kinds = {out: T.ArrayType(T.IntegerType())} | ({decoded: T.BinaryType()} if decoded else {})
    return _map_column(df, text_col, kinds, make)


def decode(df: DataFrame, ranks, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Append ``out``, the bytes that the ids stand for (binary; empty for NULL ids)."""
    def make():
        codec = _codec(ranks.value, pattern)

        def f(ids):
            flat = ids.values.to_numpy()
            ends = np.frombuffer(ids.buffers()[1], dtype=np.int32)[ids.offset:ids.offset + len(ids) + 1]
            return [pa.array([codec.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])], pa.binary())]
        return f

    df = df.withColumn(ids_col, F.coalesce(ids_col, F.array().cast("array<int>")))
    return _map_column(df, ids_col, {out: T.BinaryType()}, make)


def digest(encoded: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 from the columns ids and decoded; ``keep`` names
    columns to keep beside them."""
    return encoded.select(
        "doc_id", *keep, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def encode_documents(spark, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every text of ``docs`` and return one digest row a document."""
    ranks = read_ranks(spark, path)
    return digest(encode(docs.select("doc_id", "text"), ranks, pattern, decoded="decoded"))
