"""SimHash near-duplicates over an inverted index of positional bytes (operator 4).

Two 64-bit fingerprints that differ in at most d < 8 bits share at least 8 - d
of their 8 bytes, position by position.  The index lists fingerprints under
sets of positions with their byte values; the sets are chosen so that any
``8 - d`` positions contain one of them (for d = 4 the 20 triples of a Turan
system), hence every pair that can be a link meets in a list.  Within a list the
shared positional bytes of each pair are tallied, pairs under the guaranteed
minimum are dropped and the rest verified by their bit distance.

A list gives back a spanning forest of its links (fewer rows than members), not
the links.  Lists of over ``LIST`` fingerprints are first cut by one more
byte, as a link must share a further byte; what is still longer is dealt into
blocks, and every pair of blocks is compared in a task of its own.  So no list
is dropped and no group grows without bound.  Equal fingerprints are one entry
of the index, however many documents have them.

Defined results: NULL and empty texts have fingerprint zero and link like any
other; repeated rows repeat; a component's id is the least doc_id in it that
isn't NULL (NULL if there is none); further columns are ignored.
"""
from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pack, stage

LIST = 2048
SEED = 42


def simhash(raw: bytes, shingle: int = 4) -> int:
    """Fingerprint of UTF-8 text: majority of the bits of its shingles' XXH64 hashes."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()  # on bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    last = min(shingle, len(words)) - 1
    hashes = np.fromiter((xxh64_intdigest(joined[starts[i]:ends[i + last]], SEED) for i in range(n)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):  # bounded memory for very long texts
        part = hashes[at:at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp): one row a document; fp is the fingerprint as a signed long."""
    def run(batches):
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            fps = pa.array([simhash(t.as_py() or b"", shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps], names=["doc_id", "text_hash", "fp"])

    from pyspark.sql.types import LongType, StructField, StructType
    schema = StructType([docs.schema["doc_id"], StructField("text_hash", LongType()), StructField("fp", LongType())])
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text").mapInArrow(run, schema)


def position_sets(distance: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any 8 - distance positions contain one of them."""
    if not 0 <= distance <= 7:
        raise ValueError("the bit distance must be 0 to 7")
    if distance == 4:  # Turan's construction for triples in any four of eight points
        a, b, c = (0, 1, 2), (3, 4, 5), (6, 7)
        return [a, b] + [tuple(sorted((x, y, z))) for p, q in ((a, b), (b, c), (c, a)) for x, y in itertools.combinations(p, 2) for z in q]
    return list(itertools.combinations(range(8), 8 - distance))


def _mask(positions) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def _links(fps: np.ndarray, blocks: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the links in one list. blocks: if the list is a pair of blocks, the block of
    each entry, and only links between different blocks (or within the single one) are looked for."""
    n = len(fps)
    u = fps.view(np.uint64)
    by = u.view(np.uint8).reshape(n, 8)
    parent = np.arange(n)

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges, least = [], 8 - distance
    step = max(1, (1 << 22) // n)
    for at in range(0, n, step):
        rows = slice(at, min(n, at + step))
        shared = np.zeros((rows.stop - at, n), np.uint8)
        for p in range(8):
            shared += by[rows, p][:, None] == by[:, p][None, :]
        i, j = np.nonzero(shared >= least)
        i = i + at
        keep = i < j if blocks is None else (i < j) & (blocks[i] != blocks[j])
        i, j = i[keep], j[keep]
        near = np.bitwise_count(u[i] ^ u[j]) <= distance
        for x, y in zip(i[near].tolist(), j[near].tolist()):
            a, b = find(x), find(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((x, y))
    return [(int(fps[x]), int(fps[y])) for x, y in edges]


def _forest(lists: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) from rows with a list of fingerprints ``fps`` and their blocks ``blocks``."""
    def run(batches):
        for batch in batches:
            out_a, out_b = [], []
            for fps, blocks in zip(batch.column(0), batch.column(1)):
                v, bl = fps.values.to_numpy(), blocks.values.to_numpy()
                v = np.ascontiguousarray(v)
                for a, b in _links(v, bl if len(bl) and bl.min() != bl.max() else None, distance):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return lists.filter(F.size("fps") > 1).select("fps", "blocks").mapInArrow(run, "a bigint, b bigint")


def _gathered(lists: DataFrame, keys: list[str]) -> DataFrame:
    return lists.groupBy(*keys).agg(F.collect_list(F.struct("fp", "block")).alias("x")).select(
        F.col("x.fp").alias("fps"), F.col("x.block").alias("blocks"))


def links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within ``distance`` bits; ``distinct`` has each
    fingerprint once, in fp."""
    sets = position_sets(distance)
    masks = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(_mask(p)).alias("m")) for i, p in enumerate(sets)])
    listed = distinct.select("fp", F.explode(masks).alias("x")).select(
        F.col("x.s").alias("s"), F.col("fp").bitwiseAND(F.col("x.m")).alias("v"), "fp")
    sizes = stage(listed.groupBy("s", "v").count().filter("count > 1"), "simhash-lists")
    long = sizes.filter(F.col("count") > LIST)
    short = listed.join(sizes.filter(F.col("count") <= LIST).drop("count"), ["s", "v"], "left_semi")
    edges = _forest(_gathered(short.withColumn("block", F.lit(0)), ["s", "v"]), distance)
    if long.isEmpty():
        return edges
    # A list of shared bytes that is too long: cut it by one more byte if a link must share one.
    again = listed.join(long.drop("count"), ["s", "v"], "left_semi")
    if len(sets[0]) < 8 - distance:
        rest = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(q).alias("q"), F.lit(_mask([*p, q])).alias("m"))
                         for i, p in enumerate(sets) for q in range(8) if q not in p])
        again = again.withColumn("x", F.explode(F.filter(rest, lambda r: r["s"] == F.col("s")))).select(
            "s", F.col("x.q").alias("q"), F.col("fp").bitwiseAND(F.col("x.m")).alias("v"), "fp")
    else:
        again = again.withColumn("q", F.lit(-1))
    sizes = again.groupBy("s", "q", "v").count().filter("count > 1")
    # then into blocks; each pair of blocks is a list of its own
    n = F.ceil(F.col("count") / LIST).cast("int")
    dealt = again.join(sizes, ["s", "q", "v"]).withColumn("n", n).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "s", "q", "v", "fp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return edges.unionByName(_forest(_gathered(pairs, ["s", "q", "v", "i", "j"]), distance))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges (a, b) with the least node it is connected to, by
    alternating large-star and small-star rounds until the edges are stars."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        # e: (a, b), a > b. The least neighbour of each node is aggregated first, so that a node
        # with very many neighbours is never gathered.
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = both.join(least, "u")
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a > b").distinct()

    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    e = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    before = state(e)
    while before[0]:
        e = stage(star(star(e, True), False), "stars")
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """Per row: doc_id, text_hash, fp, root (a fingerprint that names the component) and
    component_id, the least doc_id that can be reached over links."""
    fps = stage(fingerprints(docs.select("doc_id", "text"), shingle), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected(links(distinct.select("fp"), distance))
    entries = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    entries = stage(entries, "simhash-roots")
    components = entries.groupBy("root").agg(F.min("least").alias("component_id"))
    named = entries.select("fp", "root").join(components, "root").select(F.col("fp").alias("node"), "root", "component_id")
    return fps.join(named, fps["fp"] == named["node"]).select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``docs`` with one row of each component left: that of the least doc_id (of
    repeated rows, any one)."""
    found = near_duplicates(docs, shingle, distance)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("k")).select(F.col("k.doc_id").alias("_d"), F.col("k.text_hash").alias("_h"))
    packed, columns = pack(docs, "doc_id", "text")
    keyed = packed.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")), "left_semi").dropDuplicates(
        ["doc_id", "_hash"]).select(columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
