"""Language-model scoring (operator 3): a hashed maximum-entropy model with a
class-factored softmax.

A token's probability is P(class | context) * P(token | class).  The class
model is log-linear over hashed features of the context: the previous token,
the previous two together, and two skip tokens (the second and third before).
It is trained by distributed gradient updates: AdaGrad runs over each shard of the
documents from the shared weights, the weight changes are averaged by token
count, and the next round goes on with other documents.  Shards are dealt by a
hash of doc_id and sorted, their number follows from the number of tokens alone,
and changes are added in the order of the shards: neither partitions nor cores
show in the weights.

Classes: the end of a text, the ``TOP`` most frequent tokens one by one, the
other frequent tokens by shape, rare tokens by shape.  A token's shape (is it
ASCII, does it end in punctuation, are there digits or signs in it, is it long)
is kept in the low 4 bits of its 64-bit hash, so the class follows from the hash
and a bounded table of frequent tokens (``HEAD`` rows, the only vocabulary that
is sent to tasks).  Rare tokens are never sent: their occurrences, one row a
document and token, meet the token counts in a join.  Of a rare shape class the
share DISCOUNT * types / tokens is left for unseen tokens, which are one event
together; the probabilities of all known tokens and of "unseen" sum to 1.

Beside the model's score there is the smoothed unigram score (``base_score``)
over the same events.

Defined results: a NULL text is the empty text (one end); repeated rows repeat;
a NULL doc_id is scored but neither trained on nor held out; without training
tokens every probability is 1; tokens are told apart by 60 bits of hash and their shape (tokens
of ``LONG`` bytes and more by XXH64, shorter ones by a polynomial of their bytes); further
columns are ignored; an empty table gives no rows.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, sum_blocks

HEAD = 1 << 18     # frequent tokens that tasks know
TOP = 31           # of these, classes of their own
SHAPES = 16
CLASSES = 1 + TOP + 2 * SHAPES
FEATURES = 4
ROWS = 1 << 11     # weight rows a feature
DISCOUNT = 0.75
ROUNDS = 2
RATE = 0.15
SHARD = 1 << 21    # training tokens a shard at least
SHARDS = 1 << 12   # shards at most, as each sends its weight changes
BATCH = 4096
TOGETHER = 512     # texts of a shard learned from together
SLICE = 1 << 21    # bytes hashed at once
LONG = 32          # bytes from which a token is hashed by XXH64
END, BOS = np.uint64(0xE4D0E4D0E4D0E400), np.uint64(0xB05B05B05B05B000)
LOG10 = float(np.log(10))

_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32
_space = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_letter = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
_code = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = 0x9E3779B97F4A7C13
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        p = np.full(max(n, SLICE) + 1, base & (1 << 64) - 1, np.uint64)
        p[0] = 1
        have = _powers[base] = np.multiply.accumulate(p)
    return have[:n + 1]


def _hash_run(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the tokens of some bytes; ``cuts`` are starts of texts, where tokens end."""
    low = _low[raw]
    solid = ~_space[low]
    edge = np.ones(len(low) + 1, bool)  # edge[i]: a token can't go on from byte i - 1 to byte i
    edge[1:-1] = ~(solid[1:] & solid[:-1])
    edge[cuts] = True
    start = np.nonzero(solid & edge[:-1])[0]
    end = np.nonzero(solid & edge[1:])[0] + 1
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_code[low] * _power(_R, len(low))[:-1], out=total[1:])
    h = (total[end] - total[start]) * _power(pow(_R, -1, 1 << 64), len(low))[start]
    h ^= (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    long = np.nonzero(end - start >= LONG)[0]
    if len(long):  # a polynomial modulo 2 ** 64 gives long words of two letters equal hashes (Thue-Morse words)
        held = memoryview(low.tobytes())
        h[long] = [xxhash.xxh64_intdigest(held[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist())]
    count = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
    last = low[end - 1]
    punct = ~_letter[last] & ~((last >= 48) & (last <= 57))
    wide, odd = count(low >= 128), count(solid & ~_letter[low])
    shape = ((wide[end] > wide[start]).astype(np.uint64) | punct.astype(np.uint64) << np.uint64(1)
             | (odd[end - punct] > odd[start]).astype(np.uint64) << np.uint64(2) | (end - start > 8).astype(np.uint64) << np.uint64(3))
    return h & ~np.uint64(15) | shape, start


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets): token hashes of all texts, an END after each text; offsets by text."""
    n = len(texts)
    texts = pa.array(texts, pa.large_string()) if not pa.types.is_large_string(texts.type) and not pa.types.is_string(texts.type) else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0]:off[-1]]
    off = off - off[0]
    hashes, starts, at = [], [], 0
    while at < len(raw):
        stop = min(len(raw), at + SLICE)
        if stop < len(raw):  # cut between texts, or else at a space, never inside a token
            k = int(np.searchsorted(off, stop, "right")) - 1
            if off[k] > at:
                stop = int(off[k])
            else:
                space = np.nonzero(_space[raw[at + 1:stop]])[0]
                while not len(space) and stop < len(raw):
                    stop = min(len(raw), stop + SLICE)
                    space = np.nonzero(_space[raw[at + 1:stop]])[0]
                stop = min(at + 1 + int(space[-1]), int(off[k + 1])) if len(space) else min(stop, int(off[k + 1]))
        cuts = off[(off >= at) & (off <= stop)] - at
        h, s = _hash_run(raw[at:stop], cuts)
        hashes.append(h)
        starts.append(s + at)
        at = stop
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    doc = np.searchsorted(off, s, "right") - 1
    # empty texts share their offset with the next one; "right" gives the last of them, which holds the token
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n)[:n] + 1)])
    out = np.full(len(h) + n, END, np.uint64)
    out[np.arange(len(h)) + doc] = h
    return out, offsets


class Table:
    """Open-addressing map from token hash to index, looked up in bulk."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.value = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        at = self._home(keys)
        while len(left):
            free = self.value[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            put = np.nonzero(free)[0][first]
            self.key[slot], self.value[slot] = keys[left[put]], left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], at[rest] + 1 & (1 << self.bits) - 1

    def _home(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 if it isn't there."""
        at = self._home(keys)
        out = self.value[at]
        left = np.nonzero((self.key[at] != keys) & (out >= 0))[0]
        at = at[left]
        while len(left):
            at = at + 1 & (1 << self.bits) - 1
            out[left] = self.value[at]
            more = (self.key[at] != keys[left]) & (out[left] >= 0)
            left, at = left[more], at[more]
        return out


class Model:
    """Counts, classes and weights; everything a task needs, of bounded size."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, n: int, v: int, rare: np.ndarray, types: np.ndarray):
        """head, counts: frequent tokens, most frequent first. rare, types: tokens and types of the
        rare ones by shape."""
        self.head, self.counts, self.n, self.v = head, counts.astype(np.float64), n, v
        ends = self.counts[head == END].sum()
        order = np.nonzero(head != END)[0]
        cls = 1 + TOP + (head & np.uint64(15)).astype(np.int64)
        cls[order[:TOP]] = 1 + np.arange(min(TOP, len(order)))
        cls[head == END] = 0
        self.cls = cls
        size = np.bincount(cls, self.counts, CLASSES)
        size[0] = ends
        size[1 + TOP + SHAPES:] = rare
        self.size = size
        self.unseen = np.where(rare > 0, DISCOUNT * types / np.maximum(rare, 1), 1.0)
        self.bias = np.log((size + 0.1) / (size.sum() + 0.1 * CLASSES)).astype(np.float32)
        self.inside = np.log(self.counts / size[cls]) if len(head) else np.zeros(0)
        self.weights = np.zeros((FEATURES * ROWS, CLASSES), np.float32)
        self.norm = np.log(n + 0.1 * (v + 1))
        self.base = np.log(self.counts + 0.1) - self.norm
        self.table = Table(head)

    def prepare(self, seq: np.ndarray, offsets: np.ndarray):
        """(index in head, class, feature rows) of each token."""
        at = self.table.find(seq)
        cls = np.where(at >= 0, self.cls[at] if len(self.cls) else 0, 1 + TOP + SHAPES + (seq & np.uint64(15)).astype(np.int64))
        back, prev = [], seq
        for _ in range(3):
            p = np.empty_like(prev)
            p[1:] = prev[:-1]
            p[offsets[:-1]] = BOS
            back.append(p)
            prev = p
        mixed = [back[0], back[0] * np.uint64(3) ^ back[1] * np.uint64(0x9E3779B97F4A7C15), back[1], back[2]]
        rows = [((m * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 11)).astype(np.int32) + k * ROWS for k, m in enumerate(mixed)]
        return at, cls, rows

    def exponents(self, w: np.ndarray, rows, part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores of the classes, their exponentials, the sums of these) of some tokens."""
        z = np.take(w, rows[0][part], axis=0)
        for r in rows[1:]:
            z += np.take(w, r[part], axis=0)
        z += self.bias
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return z, e, e.sum(axis=1, keepdims=True)

    def log_probs(self, w: np.ndarray, rows, part: slice) -> np.ndarray:
        z, _, total = self.exponents(w, rows, part)
        return z - np.log(total)


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10


def _counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often each token is in the training documents."""
    def run(batches):
        held, most = [], 1 << 22

        def merged():
            h = np.concatenate([x for x, _ in held])
            c = np.concatenate([x for _, x in held])
            u, at = np.unique(h, return_inverse=True)
            return u, np.bincount(at, c, len(u)).astype(np.int64)

        def out(u, c):
            for a in range(0, len(u), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(u[a:a + (1 << 17)].view(np.int64)), pa.array(c[a:a + (1 << 17)])], names=["h", "c"])

        for b in batches:
            for a in range(0, b.num_rows, 1024):
                seq, _ = tokens(b.column(0).slice(a, 1024))
                held.append(np.unique(seq, return_counts=True))
            if sum(len(x) for x, _ in held) > most:
                held = [merged()]
                if len(held[0][0]) > most // 2:
                    yield from out(*held[0])
                    held = []
        if held:
            yield from out(*merged())

    return docs.filter(held_out() != 0).select("text").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def count_tokens(docs: DataFrame) -> tuple[DataFrame, Model]:
    """The table of token counts and a model without weights."""
    counts = stage(_counts(docs), "lm-counts")
    c = F.col("c")
    # counts in at most about 1000 bins by shape; the bins give the totals and the least count of the head
    bins = counts.groupBy(F.col("h").bitwiseAND(15).alias("shape"), F.when(c < 64, c.cast("double")).otherwise(
        F.lit(64.0) * F.pow(F.lit(2.0), F.floor(F.log2(c / 64.0) * 16) / 16)).alias("least")).agg(
        F.count("*").alias("types"), F.sum("c").alias("tokens")).collect()
    n, v = sum(r["tokens"] for r in bins), sum(r["types"] for r in bins)
    limit, total = float("inf"), 0
    for least in sorted({r["least"] for r in bins}, reverse=True):
        total += sum(r["types"] for r in bins if r["least"] == least)
        if total > HEAD or least < 2:
            break
        limit = least
    head = counts.filter((c >= F.lit(limit)) if limit < float("inf") else F.lit(False)).toPandas()  # at most HEAD rows
    head = head.sort_values(["c", "h"], ascending=[False, True])
    rare, types = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in bins:
        if r["least"] < limit:
            rare[r["shape"]] += r["tokens"]
            types[r["shape"]] += r["types"]
    return counts, Model(head["h"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64), n, v, rare, types)


def _train_batch(model: Model, w, g, rows, cls, part: slice) -> None:
    _, err, total = model.exponents(w, rows, part)
    err /= total
    err[np.arange(len(err)), cls[part]] -= 1
    for r in rows:
        f = r[part].astype(np.uint16)   # FEATURES * ROWS rows; numpy sorts 16 bits by radix
        order = np.argsort(f, kind="stable")
        f = f[order]
        at = np.nonzero(np.concatenate([[True], f[1:] != f[:-1]]))[0]
        size = np.diff(np.append(at, len(f)))
        # most rows come once or twice; only the others are worth a call to reduceat a row
        grad = err[order[at]]
        two, more = np.nonzero(size == 2)[0], np.nonzero(size > 2)[0]
        grad[two] += err[order[at[two] + 1]]
        if len(more):
            grad[more] = np.add.reduceat(err[order[np.repeat(size > 2, size)]], np.cumsum(size[more]) - size[more], axis=0)
        u = f[at]
        g[u] += grad * grad
        w[u] -= RATE * grad / np.sqrt(g[u] + 1e-6)


def _round(docs: DataFrame, model: Model) -> np.ndarray:
    """Weights after one round: an AdaGrad pass over each shard, the changes averaged by tokens."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    block = 256

    def run(batches):
        m = shared.value
        shard, w, g, seen, held = None, None, None, 0, []

        def learn(texts):
            nonlocal seen
            seq, offsets = tokens(texts)
            _, cls, rows = m.prepare(seq, offsets)
            for s in range(0, len(seq), BATCH):
                _train_batch(m, w, g, rows, cls, slice(s, min(len(seq), s + BATCH)))
            seen += len(seq)

        def rest():
            """The last texts of a shard, then its weight changes."""
            if held:
                learn(pa.concat_arrays(held))
            change = ((w - m.weights) * np.float32(seen)).reshape(-1, block * CLASSES)
            pay = [(i, change[i]) for i in np.nonzero(change.any(axis=1))[0].tolist()] + [(len(change), np.array([seen], np.float32))]
            return pa.RecordBatch.from_arrays([pa.array([shard] * len(pay), pa.int32()), pa.array([i for i, _ in pay], pa.int32()),
                                               pa.array([zlib.compress(x.tobytes(), 1) for _, x in pay], pa.binary())], names=["part", "block", "payload"])

        for b in batches:
            of = b.column(0).to_numpy()
            edges = [0, *(np.nonzero(of[1:] != of[:-1])[0] + 1).tolist(), len(of)]
            for a, z in zip(edges, edges[1:]):
                if a == z:
                    continue
                if of[a] != shard:
                    if shard is not None:
                        yield rest()
                    shard, w, g, seen, held = int(of[a]), m.weights.copy(), np.full_like(m.weights, 1e-3), 0, []
                # always TOGETHER texts of a shard at once, wherever batches end
                while a < z:
                    take = min(z - a, TOGETHER - sum(map(len, held)))
                    held.append(b.column(1).slice(a, take))
                    a += take
                    if sum(map(len, held)) == TOGETHER:
                        learn(pa.concat_arrays(held))
                        held = []
        if shard is not None:
            yield rest()

    shards = min(SHARDS, max(1, int(model.n / ROUNDS) // SHARD))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", F.xxhash64("text").alias("th"), "text")
    parts = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "th").select("shard", "text").mapInArrow(
        run, "part int, block int, payload binary")
    got = {r["block"]: np.frombuffer(zlib.decompress(r["payload"]), np.float32) for r in sum_blocks(parts, "float32", ordered=True).collect()}
    w = model.weights.copy().reshape(-1, block * CLASSES)
    seen = got.pop(len(w), np.ones(1, np.float32))[0]
    for i, x in got.items():
        w[i] += x / seen
    return w.reshape(model.weights.shape)


def train(docs: DataFrame) -> tuple[DataFrame, Model]:
    counts, model = count_tokens(docs)
    for k in range(ROUNDS):
        model.weights = _round(docs.filter((held_out() != 0) & (held_out() % ROUNDS == k)), model)
    return counts, model


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: n_tokens, n_known, train_tokens, base_score and score (log10)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    names = ["doc_id", "text_hash", "is_text", "h", "n", "known", "base", "score", "unseen"]

    def run(batches):
        m = shared.value
        first = 1 + TOP + SHAPES
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                seq, offsets = tokens(part.column(2))
                at, cls, rows = m.prepare(seq, offsets)
                lp, lu = np.empty(len(seq)), np.empty(len(seq))
                for s in range(0, len(seq), BATCH):
                    x = slice(s, min(len(seq), s + BATCH))
                    z, e, total = m.exponents(m.weights, rows, x)
                    total = np.log(total[:, 0])
                    lp[x] = z[np.arange(len(z)), cls[x]] - total
                    lu[x] = np.log(e[:, first:] @ m.unseen) - total
                head = at >= 0
                inside, base_ = np.where(head, m.inside[at], 0.0) if len(m.head) else 0.0, np.where(head, m.base[at], 0.0) if len(m.head) else np.zeros(len(seq))
                per = lambda x: np.add.reduceat(x, offsets[:-1])
                d = part.num_rows
                ids, th = part.column(0), part.column(1)
                # rare tokens: one row for each text and token
                doc = np.repeat(np.arange(d), np.diff(offsets))[~head]
                rh, rl, ru = seq[~head], lp[~head], lu[~head]
                order = np.lexsort((rh, doc))
                doc, rh, rl, ru = doc[order], rh[order], rl[order], ru[order]
                new = np.nonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (rh[1:] != rh[:-1])]))[0] if len(doc) else np.zeros(0, np.int64)
                group = lambda x: np.add.reduceat(x, new) if len(new) else np.zeros(0)
                k = len(new)
                take = pa.array(np.concatenate([np.arange(d), doc[new]]))
                yield pa.RecordBatch.from_arrays([
                    ids.take(take), th.take(take), pa.array(np.arange(d + k) < d),
                    pa.array(np.concatenate([th.to_numpy(zero_copy_only=False).astype(np.int64), rh[new].view(np.int64)])),
                    pa.array(np.concatenate([np.diff(offsets), group(np.ones(len(doc), np.int64)).astype(np.int64)])),
                    pa.array(np.concatenate([per(head.astype(np.int64)), np.zeros(k, np.int64)])),
                    pa.array(np.concatenate([per(base_), np.zeros(k)])),
                    pa.array(np.concatenate([per(np.where(head, lp + inside, 0.0)), group(rl)])),
                    pa.array(np.concatenate([np.zeros(d), group(ru)]))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = base.mapInArrow(run, f"doc_id {kind}, text_hash bigint, is_text boolean, h bigint, n bigint, known bigint, base double, score double, unseen double")
    shape = F.col("h").bitwiseAND(15).cast("int")
    known = F.col("c").isNotNull() & ~F.col("is_text")
    rare, seen = (F.array(*[F.lit(float(x)) for x in xs]) for xs in (model.size[1 + TOP + SHAPES:], 1 - model.unseen))
    inside = F.ln(F.element_at(seen, shape + 1) * F.col("c") / F.greatest(F.lit(1.0), F.element_at(rare, shape + 1)))
    text = F.col("is_text")
    summed = rows.join(counts, "h", "left").groupBy("doc_id", "text_hash").agg(
        F.sum(F.when(text, 1).otherwise(0)).alias("rows"),
        F.sum(F.when(text, F.col("n")).otherwise(0)).alias("n_tokens"),
        F.sum(F.when(text, F.col("known")).when(known, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.when(text, F.col("base")).otherwise(F.col("n") * (F.ln(F.coalesce("c", F.lit(0)) + 0.1) - F.lit(float(model.norm))))).alias("base"),
        F.sum(F.when(text, F.col("score")).when(known, F.col("score") + F.col("n") * inside).otherwise(F.col("unseen"))).alias("score"))
    per_row = lambda c: F.col(c) / F.col("rows")  # noqa: E731  repeated rows were summed together
    if not model.n:
        summed = summed.withColumn("base", F.lit(0.0)).withColumn("score", F.lit(0.0))
    return summed.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(
        "doc_id", F.coalesce(held_out() == 0, F.lit(False)).alias("held_out"), per_row("n_tokens").cast("long").alias("n_tokens"),
        per_row("n_known").cast("long").alias("n_known"), F.lit(int(model.n)).cast("long").alias("train_tokens"),
        (per_row("base") / LOG10).alias("base_score"), (per_row("score") / LOG10).alias("score"))
