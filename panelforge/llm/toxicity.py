"""Toxicity by nearest labelled examples (operator 8).

Labelled documents (a bounded, documented sample of the training rows) become
TF-IDF vectors of unit length over all words they hold; how many documents hold
a word is counted over the whole corpus.  Words that tell the labels apart in
the sample (chi2 and odds) weigh 1, all others ``PLAIN``: no word is left out.
The vectors are kept in a block-max inverted index with sparse postings: by
word, the examples and the greatest weight in each block of ``BLOCK`` examples.
The words of most postings (``COMMON``) also have dense rows, for which a batch of queries is bounded and
scored by products of matrices.  A query's other words are added up from their postings; with the
greatest weights of its common words in a block they bound the block's cosines.  The ``PROBES`` blocks
of highest bound are scored first, then all whose bound reaches the k-th best cosine; no other can
hold a nearer example.  The cosines of the nearest are then added up example by example, so that no
batch shows in them: the ``K`` nearest are exact.
Their labels vote with weights that fall with distance, together with a small
prior vote that keeps scores calibrated; the neighbours are the evidence.

Defined results: NULL and empty texts, like all texts with no word of any
example, are at cosine 1 to the examples without words and at 0 to the others, and get
those examples' share of label 1; neighbours that tie are taken by example
number; repeated label rows of a doc_id count once, as toxic if any says so;
NULL labels and doc_ids are left out of training; without training rows every
score is 0.  Repeated rows repeat; further columns are ignored.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

SAMPLE = 4096    # labelled documents in the index at most (the bound of the classifier's sample)
LEAST_DOCS = 3   # a telling word must be in so many examples
CHI2 = 30.0      # of a telling word against the label (about 5e-8, as very many words are tested)
ODDS = 3.0       # how many times likelier it is under one of the labels
PLAIN = 0.1      # weight of the other words
BLOCK = 64
PROBES = 4       # blocks scored before the others' bounds are looked at
COMMON = 1024    # words with dense rows at most
SLICE = 256      # texts scored together
GATHER = 1 << 19  # entries of posting lists in memory together, beyond those of one text
K = 16
PRIOR = 0.5      # votes that the share of label 1 has

WORD = re.compile(r"\w+")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, y, text) of at most ``rows`` training doc_ids, those of least hash."""
    named = (labels.select("doc_id", F.col(label).alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
             .filter(~held_out()).groupBy("doc_id").agg(F.max("y").cast("int").alias("y")))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most ``rows`` rows, hence the broadcast
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")


def _words(text) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _word_labels(sample: DataFrame) -> DataFrame:
    """(word, y, n): in how many examples of each label a word is."""
    def run(frames):
        n: Counter = Counter()
        for f in frames:
            for y, t in zip(f["y"], f["text"]):
                n.update((w, int(y)) for w in set(_words(t)))
        yield pd.DataFrame([(w, y, c) for (w, y), c in n.items()], columns=["word", "y", "n"])

    return sample.select("y", "text").mapInPandas(run, "word string, y int, n bigint").groupBy("word", "y").agg(F.sum("n").alias("n"))


def word_weights(sample: DataFrame, n0: int, n1: int) -> dict[str, float]:
    """Every word of the sample (bounded by its texts): 1 if it tells label 1 from 0, else ``PLAIN``."""
    c = _word_labels(sample).groupBy("word").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).cast("double").alias("a"),
        F.sum(F.when(F.col("y") != 1, F.col("n")).otherwise(0)).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    n = float(n0 + n1)
    chi2 = n * F.pow(a * (n0 - b) - b * (n1 - a), 2) / F.nullif(F.lit(float(n0)) * n1 * (a + b) * (n - a - b), F.lit(0.0))
    odds = (a + 0.5) * (n0 - b + 0.5) / ((b + 0.5) * (n1 - a + 0.5))
    tells = (a + b >= LEAST_DOCS) & (chi2 >= CHI2) & ((odds >= ODDS) | (odds <= 1 / ODDS))
    got = c.select("word", F.coalesce(tells, F.lit(False)).alias("tells")).orderBy("word").toArrow()
    return {w: 1.0 if t else PLAIN for w, t in zip(got["word"].to_pylist(), got["tells"].to_pylist())}


class Ids(dict):
    """Numbers of words; unknown words have -1."""

    def __missing__(self, word):
        return -1


def term_counts(texts: list, ids: Ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, times) of the known words of some texts, by text and word."""
    words = [_words(t) for t in texts]
    at = np.fromiter(map(ids.__getitem__, chain.from_iterable(words)), np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    keys, n = np.unique((doc * (len(ids) + 1) + at)[at >= 0], return_counts=True)
    return keys // (len(ids) + 1), keys % (len(ids) + 1), n


def document_counts(docs: DataFrame, words) -> tuple[dict[str, int], int]:
    """In how many of all documents each word of ``words`` (a broadcast ``Ids``) is, and how many documents there are."""
    def run(frames):
        ids, rows = words.value, 0
        n = np.zeros(len(ids), np.int64)
        for f in frames:
            rows += len(f)
            for a in range(0, len(f), SLICE):
                n += np.bincount(term_counts(f["text"].iloc[a:a + SLICE].tolist(), ids)[1], minlength=len(ids))
        held = np.nonzero(n)[0]
        yield pd.DataFrame({"at": np.append(held, -1), "n": np.append(n[held], rows)})

    table = docs.select("text").mapInPandas(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    got = dict(zip(table["at"].to_pylist(), table["n"].to_pylist()))  # a row a word of the sample
    names = list(words.value)
    return {names[i]: c for i, c in got.items() if i >= 0}, got.get(-1, 0)


class Postings:
    """Lists of (place, weight) by word, one after the other."""

    def __init__(self, terms: int, rows: np.ndarray, places: np.ndarray, weights: np.ndarray):
        self.start = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=terms))])
        self.places, self.weights = places, weights   # sorted by row

    def gather(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in terms, position in the lists) of all entries of the terms."""
        a, n = self.start[terms], self.start[terms + 1] - self.start[terms]
        return np.repeat(np.arange(len(terms)), n), np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())


class BlockMaxIndex:
    """Unit vectors of labelled examples in sparse posting lists, with the greatest weights by block."""

    def __init__(self, vectors: Iterable[dict[int, float]], labels: list[int], ids: list[int], terms: int):
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.float64)
        held = [(np.fromiter(v, np.int32, len(v)), np.fromiter(v.values(), np.float64, len(v))) for v in vectors]
        self.n, self.blocks = len(held), max(1, -(-len(held) // BLOCK))
        sizes = np.array([len(t) for t, _ in held], np.int64)
        self.none = sizes == 0
        row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        term = np.concatenate([np.empty(0, np.int32), *[t for t, _ in held]])
        weight = np.concatenate([np.empty(0), *[x for _, x in held]])
        self.examples = Postings(self.n, row, term, weight)      # words by example
        order = np.argsort(term, kind="stable")
        self.words = Postings(terms, term[order], row[order], weight[order])
        long = np.diff(self.words.start)
        common = np.argsort(-long, kind="stable")[:COMMON]
        common = common[long[common] > self.n // 64]
        self.place = np.full(terms, -1, np.int64)      # of common words among the dense rows
        self.place[common] = np.arange(len(common))
        self.query = np.zeros(terms)
        self._dense: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_dense": None}        # tasks fill the dense rows from the postings

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """(weights, greatest weight by block) of the common words."""
        if self._dense is None:
            common = np.argsort(np.where(self.place >= 0, self.place, len(self.place)), kind="stable")[:(self.place >= 0).sum()]
            rows = np.zeros((len(common), self.n))
            row, at = self.words.gather(common)
            rows[row, self.words.places[at]] = self.words.weights[at]
            self._dense = rows, np.maximum.reduceat(rows, np.arange(0, self.n, BLOCK), axis=1) if self.n else rows
        return self._dense

    def _rare(self, doc: np.ndarray, terms: np.ndarray, values: np.ndarray, queries: int) -> np.ndarray:
        """(queries x examples) what the words without dense rows add, some queries at a time, so that the
        entries of their lists don't lie in memory all at once."""
        part = np.empty((queries, self.n))
        cuts = np.searchsorted(doc, np.arange(queries + 1))
        entries = np.concatenate([[0], np.cumsum(self.words.start[terms + 1] - self.words.start[terms])])[cuts]
        a = 0
        while a < queries:
            z = max(a + 1, int(np.searchsorted(entries, entries[a] + GATHER, "right")) - 1)
            x = slice(cuts[a], cuts[z])
            word, at = self.words.gather(terms[x])
            part[a:z] = np.bincount((doc[x][word] - a) * self.n + self.words.places[at], self.words.weights[at] * values[x][word],
                                    (z - a) * self.n).reshape(z - a, self.n)
            a = z
        return part

    def nearest_of(self, doc: np.ndarray, terms: np.ndarray, values: np.ndarray, queries: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """By query the (cosines, examples) of its k nearest with a cosine over 0, best first, ties by example.
        ``doc``, ``terms``, ``values``: the queries' vectors, by query."""
        if not self.n:
            return [(np.zeros(0), np.zeros(0, np.int64))] * queries
        rows, most = self.dense()
        place = self.place[terms]
        dense = np.zeros((queries, len(rows)))
        dense[doc[place >= 0], place[place >= 0]] = values[place >= 0]
        part = self._rare(doc[place < 0], terms[place < 0], values[place < 0], queries)
        bounds = dense @ most + np.maximum.reduceat(part, np.arange(0, self.n, BLOCK), axis=1) + 1e-12
        scores = np.full((queries, self.n), -1.0)

        def visit(wanted):
            for b in np.nonzero(wanted.any(axis=0))[0]:
                q, x = np.nonzero(wanted[:, b])[0], slice(b * BLOCK, min((b + 1) * BLOCK, self.n))
                scores[q, x] = part[q, x] + dense[q] @ rows[:, x]

        def kth():
            return np.partition(scores, self.n - k, axis=1)[:, self.n - k] if k < self.n else np.full(queries, -1.0)

        first = np.zeros(bounds.shape, bool)
        if bounds.shape[1] > PROBES:
            np.put_along_axis(first, np.argpartition(-bounds, PROBES - 1, axis=1)[:, :PROBES], True, axis=1)
        else:
            first[:] = True
        visit(first)
        visit(~first & (bounds >= kth()[:, None] - 1e-11))
        least = np.maximum(kth() - 1e-11, 1e-300)
        cuts = np.searchsorted(doc, np.arange(queries + 1))
        out = []
        for q in range(queries):
            found = np.nonzero(scores[q] >= least[q])[0]     # all that may be among the k
            mine = slice(cuts[q], cuts[q + 1])
            self.query[terms[mine]] = values[mine]
            example, at = self.examples.gather(found)
            exact = np.round(np.bincount(example, self.query[self.examples.places[at]] * self.examples.weights[at], len(found)), 12)
            self.query[terms[mine]] = 0
            found, exact = found[exact > 0], exact[exact > 0]
            best = np.lexsort((found, -exact))[:k]
            out.append((exact[best], found[best]))
        return out

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest of one query."""
        terms, values = np.fromiter(query, np.int64, len(query)), np.fromiter(query.values(), np.float64, len(query))
        scores, found = self.nearest_of(np.zeros(len(terms), np.int64), terms, values, 1, k)[0]
        return list(zip(scores.tolist(), found.tolist()))


class _Held:
    """The words of an example and how often it has them, unpacked when asked for."""

    def __init__(self, words: list[str], packed: bytes):
        self.words, self.packed = words, packed

    def items(self):
        return [(self.words[i], int(c)) for i, c in np.frombuffer(self.packed, np.int32).reshape(-1, 2)]


class Model:
    """Words, their weights and the index; scores texts in batches."""

    def __init__(self, weights: dict[str, float], counts: dict[str, int], n: int, examples: list[tuple[int, int, dict[str, int]]]):
        self.at = Ids({w: i for i, w in enumerate(weights)})
        self.weight = np.array([x * (math.log((1 + n) / (1 + counts.get(w, 0))) + 1) for w, x in weights.items()])
        examples = sorted(examples, key=lambda e: (e[0], e[1]))
        labels = [y for _, y, _ in examples]
        self.prior = sum(labels) / len(labels) if labels else 0.0
        self.index = BlockMaxIndex((self.vector(c) for _, _, c in examples), labels, [d for d, _, _ in examples], len(weights))
        none = self.index.labels[self.index.none]
        self.plain = ((float(none.sum()) + PRIOR * self.prior) / (len(none) + PRIOR), [])

    def vector(self, counts: dict[str, int]) -> dict[int, float]:
        v = {self.at[w]: (1 + math.log(c)) * self.weight[self.at[w]] for w, c in sorted(counts.items()) if w in self.at}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    def scores(self, texts: list) -> list[tuple[float, list[int]]]:
        """(score, doc_ids of the neighbours) by text."""
        doc, terms, n = term_counts(texts, self.at)
        values = (1 + np.log(n)) * self.weight[terms]
        norm = np.sqrt(np.bincount(doc, values * values, len(texts)))
        near = self.index.nearest_of(doc, terms, values / norm[doc], len(texts), K)
        out = []
        for some, (cosines, found) in zip(norm > 0, near):
            w = 1 / (1.05 - cosines)  # by distance 1 - cosine
            out.append(self.plain if not some else ((float((w * self.index.labels[found]).sum()) + PRIOR * self.prior) / (float(w.sum()) + PRIOR),
                                                    self.index.ids[found].tolist()))
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE) -> Model:
    sample = stage(training_sample(docs, labels, label, rows), "toxic-sample")
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n1, n0 = n.get(1, 0), sum(v for y, v in n.items() if y != 1)
    weights = word_weights(sample, n0, n1)
    words = list(weights)
    places = docs.sparkSession.sparkContext.broadcast(Ids({w: i for i, w in enumerate(words)}))  # words of the sample
    counts, total = document_counts(docs, places)

    def run(frames):
        at = places.value
        for f in frames:
            held = [Counter(at[w] for w in _words(t)) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "y": f["y"], "words": [np.array([*c.items()], np.int32).tobytes() for c in held]})

    rows_ = sample.mapInPandas(run, "doc_id bigint, y int, words binary").collect()
    return Model(weights, counts, total, [(r["doc_id"], int(r["y"] == 1), _Held(words, r["words"])) for r in rows_])


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """Append score (0 to 1), predicted (1 from 0.5 on) and evidence (doc_ids of the neighbours)."""
    from pyspark.sql import types as T
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most SAMPLE vectors over their words
    new = {"score": T.DoubleType(), "predicted": T.IntegerType(), "evidence": T.ArrayType(T.LongType())}
    docs = docs.drop(*new)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, t) for k, t in new.items())])
    at, names = docs.columns.index("text"), schema.names

    def run(batches):
        import pyarrow as pa
        m = shared.value
        for b in batches:
            texts = b.column(at)
            found = [x for a in range(0, len(texts), SLICE) for x in m.scores(texts.slice(a, SLICE).to_pylist())]
            score = np.array([s for s, _ in found], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32)),
                                              pa.array([e for _, e in found], pa.list_(pa.int64()))], names=names)

    return docs.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "evidence")
