"""Quality classifier on random-indexing word vectors (operator 10).

Every word (a hashed row of a fixed table) has a sparse random index vector of
+1 and -1.  Over all documents, a word's context vector is the sum of the index
vectors of the words up to ``REACH`` places away; its word vector is its index
vector plus the context vector of unit length.  Capital words and words that
repeat the one before carry marker words.  A document is the mean of its word
vectors and their mean square, with its length; a two-layer numpy network is
fitted on a bounded, documented sample of the training rows, and its logit is
divided by a temperature fitted on a held-back part of that sample.

Context vectors are integer sums, so they don't depend on how the table is
dealt out.  Tasks send packed sums in blocks of words that have any.

Defined results: NULL and empty texts have the zero vector and are scored like
any other; repeated label rows of a doc_id count once, with the greater label;
NULL labels and doc_ids are left out of training; without training rows of both
labels every score is the share of label 1 (1 without rows, so that nothing is
thrown out).  Repeated rows repeat; further columns are ignored.
"""
from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sum_blocks
from .toxicity import held_out, training_sample

SAMPLE = 8192      # labelled documents the network is fitted on at most
BUCKETS = 1 << 14  # rows of the word table; words share them by hash
DIMS = 64
NONZERO = 4        # entries of an index vector
REACH = 2
BLOCK = 256        # words of a packed block
HIDDEN = 32
EPOCHS = 60
THRESHOLD = 0.3

WORD = re.compile(r"\w+|[^\w\s]+")
UPPER, REPEAT, FIRST = 0, 1, 2  # marker rows; words come after


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the entries of every row's index vector."""
    rng = np.random.default_rng(7)
    return rng.integers(0, DIMS, (BUCKETS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


class Rows:
    """Word rows of a text, with a bounded memo of words."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def row(self, w: str) -> int:
        low = w.lower()
        at = FIRST + zlib.crc32(low.encode()) % (BUCKETS - FIRST)
        return -at if len(w) > 1 and w.isupper() else at

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, places of capital words, places of repeats)."""
        found = WORD.findall(text) if text else []
        memo = self.memo
        if len(memo) > 1 << 17:
            memo.clear()
        out = np.empty(len(found), np.int64)
        for i, w in enumerate(found):
            at = memo.get(w)
            if at is None:
                at = memo[w] = self.row(w)
            out[i] = at
        upper = np.nonzero(out < 0)[0]
        out = np.abs(out)
        return out, upper, np.nonzero(out[1:] == out[:-1])[0] + 1


def _contexts(docs: DataFrame) -> DataFrame:
    """(part, block, payload): a task's sums of context vectors."""
    def run(frames):
        from pyspark import TaskContext
        places, signs = index_vectors()
        rows, total = Rows(), np.zeros(BUCKETS * DIMS, np.int64)

        def add(word, context):
            at = word[:, None] * DIMS + places[context]
            total[:] += np.bincount(at.ravel(), signs[context].ravel(), BUCKETS * DIMS).astype(np.int64)

        def flush(seqs, marks):
            gap = np.full(REACH, -1)
            s = np.concatenate([x for q in seqs for x in (q, gap)])
            words, contexts = [], []
            for d in range(1, REACH + 1):
                a, b = s[:-d], s[d:]
                ok = (a >= 0) & (b >= 0)
                words += [a[ok], b[ok]]
                contexts += [b[ok], a[ok]]
            for marker, words_marked in marks:
                words.append(np.full(len(words_marked), marker))
                contexts.append(words_marked)
            add(np.concatenate(words), np.concatenate(contexts))

        seqs, marks, held = [], [], 0
        for f in frames:
            for t in f["text"]:
                w, upper, repeat = rows(t)
                seqs.append(w)
                marks += [(UPPER, w[upper]), (REPEAT, w[repeat])]
                held += len(w)
                if held > 1 << 18:
                    flush(seqs, marks)
                    seqs, marks, held = [], [], 0
        if seqs:
            flush(seqs, marks)
        blocks = total.reshape(-1, BLOCK * DIMS)
        full = np.nonzero(blocks.any(axis=1))[0]
        yield pd.DataFrame({"part": np.full(len(full), TaskContext.get().partitionId(), np.int32), "block": full.astype(np.int32),
                            "payload": [zlib.compress(blocks[i].tobytes(), 1) for i in full]})

    return docs.select("text").mapInPandas(run, "part int, block int, payload binary")


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The word table (``BUCKETS`` x ``DIMS``, 4 MB at any size of the corpus) from all documents."""
    total = np.zeros((BUCKETS // BLOCK, BLOCK * DIMS))
    for r in sum_blocks(_contexts(docs), "int64").collect():
        total[r["block"]] = np.frombuffer(zlib.decompress(r["payload"]), np.int64)
    total = total.reshape(BUCKETS, DIMS)
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    places, signs = index_vectors()
    np.add.at(total, (np.arange(BUCKETS)[:, None], places), signs)
    return total.astype(np.float32)


class Pool:
    """Document vectors: mean and mean square of the word vectors, and the length."""

    def __init__(self, table: np.ndarray):
        self.table, self.rows = table, Rows()

    def __call__(self, text: str | None) -> np.ndarray:
        w, upper, repeat = self.rows(text)
        out = np.zeros(2 * DIMS + 1, np.float32)
        if len(w):
            n = np.bincount(w, minlength=FIRST)
            n[UPPER], n[REPEAT] = len(upper), len(repeat)
            at = np.nonzero(n)[0]
            share = (n[at] / len(w)).astype(np.float32)
            v = self.table[at]
            out[:DIMS] = share @ v
            out[DIMS:2 * DIMS] = share @ (v * v)
            out[-1] = np.log1p(len(w))
        return out


class Network:
    """Two layers; probabilities calibrated by one temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, check: np.ndarray):
        """check: the rows held back for the temperature."""
        self.constant = None
        if not len(y) or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 1.0
            return
        rng = np.random.default_rng(11)
        fit = ~check if (~check).any() and len(set(y[~check])) == 2 else np.ones(len(y), bool)
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-3
        z = (x - self.mean) / self.scale
        d = x.shape[1]
        self.w = [rng.normal(0, d ** -0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        zf, yf = z[fit], y[fit]
        for _ in range(EPOCHS):
            order = rng.permutation(len(yf))
            for at in range(0, len(yf), 64):
                i = order[at:at + 64]
                h = np.tanh(zf[i] @ self.w[0] + self.w[1])
                err = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - yf[i]) / len(i)
                back = err[:, None] * self.w[2] * (1 - h * h)
                grads = [zf[i].T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ err + 1e-4 * self.w[2], np.array([err.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - 0.002 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        self.temperature = 1.0
        if check.any():
            logit, t = self.logits(x[check]), y[check]
            grid = np.geomspace(0.25, 8, 60)
            loss = [np.mean(np.logaddexp(0, logit / g) - t * logit / g) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE):
    """(word table, network): both of fixed size."""
    table = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(frames):
        pool = Pool(shared.value)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "y": f["y"], "x": [pool(t).tolist() for t in f["text"]]})

    got = training_sample(docs, labels, label, rows).mapInPandas(run, "doc_id bigint, y int, x array<float>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in got], np.float64).reshape(len(got), 2 * DIMS + 1)
    y = np.array([r["y"] == 1 for r in got], np.float64)
    check = np.array([zlib.crc32(str(r["doc_id"]).encode()) // 5 % 5 == 0 for r in got], bool)
    return table, Network(x, y, check)


def classify(docs: DataFrame, model) -> DataFrame:
    """Append score (0 to 1, likelihood of label 1) and predicted (1 from ``THRESHOLD`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = {"score": T.DoubleType(), "predicted": T.IntegerType()}
    docs = docs.drop(*new)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, t) for k, t in new.items())])
    at, names = docs.columns.index("text"), schema.names

    def run(batches):
        table, network = shared.value
        pool = Pool(table)
        for b in batches:
            x = np.array([pool(t.as_py()) for t in b.column(at)], np.float64).reshape(b.num_rows, 2 * DIMS + 1)
            score = network(x) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=names)

    return docs.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
