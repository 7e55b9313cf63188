"""Benchmark decontamination by winnowing (operator 1), DataFrame functions only.

Texts become words.  An item's *windows* are its runs of ``WINDOW`` words, or
the whole item if it is shorter.  For a window length L the k-grams of
k = ceil(L / 2) words are hashed and the least hash in each window is kept as
its fingerprint, so two texts that share L words in a row share a fingerprint
there: no shared span of that length is missed.  Fingerprints of documents and
items are joined; each joined place is then extended to whole windows, which
are compared with the items' windows as text, so a hash can add work but never
a result.

Only places that join leave the scan of the documents, which is one for windows of
all lengths.  The benchmark's side of each join is broadcast when its rows and bytes,
counted, prove it small and is joined by shuffle otherwise; there a fingerprint shared by a third of all documents is split by
Spark's skew join.

Defined results: NULL and empty texts have no words and no windows; a NULL
doc_id is a document like any other; repeated document rows repeat in the
result; items with the same item_id count once; an item whose item_id is NULL
marks words but has no id to list; an empty benchmark leaves all clean; columns
other than the two named on either side are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, pack, same_row, small, stage

WINDOW = 10
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), SEPARATOR), "")


def winnow(ws: Column, length: int) -> Column:
    """array<(start, fp)>: the fingerprints of all windows of ``length`` words.  A fingerprint
    stands for the windows from its start up to the next start, at most ``length - k + 1``."""
    k = (length + 1) // 2
    span = length - k + 1

    def marks(w):
        # get(), not slice(): inside a lambda slice() copies the whole array first
        n = F.size(w)
        grams = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + x) for x in range(k)]))
        starts = F.sequence(F.lit(0), n - length)

        def kept(m):
            new = F.filter(starts, lambda j: (j % span == 0) | (F.get(m, j) != F.get(m, j - 1)))
            return F.transform(new, lambda j: F.struct(j.alias("start"), F.get(m, j).alias("fp")))

        def least(h):
            return kept(h) if span == 1 else let(
                F.transform(starts, lambda j: F.least(*[F.get(h, j + x) for x in range(span)])), kept)

        return F.when(n >= length, let(grams, least)).otherwise(F.array().cast("array<struct<start:int,fp:bigint>>"))

    return let(ws, marks)


def _gram(ws: Column, at: Column, length: int) -> Column:
    return F.concat_ws(" ", *[F.get(ws, at + x) for x in range(length)])


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (length, gram, item_id): the windows of all items; gram joins the words by spaces."""
    n = F.size("ws")
    grams = F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda i: _gram(F.col("ws"), i, window))).otherwise(
        F.array(F.concat_ws(" ", "ws")))
    ws = items.select("item_id", words(F.col("text")).alias("ws")).filter(n > 0)
    return ws.select("item_id", F.least(n, F.lit(window)).alias("length"), F.explode(grams).alias("gram")).distinct()


def _tagged(ws: Column, length: int) -> Column:
    """array<(length, start, fp)>: the fingerprints of one length, told apart from those of others."""
    return F.transform(winnow(ws, length), lambda m: F.struct(
        F.lit(length).alias("length"), m["start"].alias("start"), m["fp"].bitwiseXOR(F.lit(length * 0x9E3779B97F4A7C1)).alias("fp")))


def _fingerprints(spans: DataFrame, lengths: list[int]) -> DataFrame:
    """Distinct fingerprints of the item windows."""
    one = spans.select("length", F.split("gram", " ").alias("ws"))
    own = F.coalesce(*[F.when(F.col("length") == n, _tagged(F.col("ws"), n)) for n in lengths])
    return one.select(F.explode(own).alias("m")).select("m.fp").distinct()


def document_hits(docs: DataFrame, spans: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, text_hash, start, length, gram): every place of a document where an item's window
    occurs.  The documents are read and split once, whatever lengths the windows have."""
    grams = small(spans.select("length", "gram").distinct(), size=F.octet_length("gram"))
    source = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words(F.col("text")).alias("ws"))
    marks = source.withColumn("m", F.explode(F.concat(*[_tagged(F.col("ws"), n) for n in lengths])))
    length = F.col("m.length")
    # a fingerprint stands for at most length / 2 + 1 windows from its start on
    near = F.slice("ws", F.col("m.start") + 1, length + (length / 2).cast("int"))
    places = marks.join(small(_fingerprints(spans, lengths)), F.col("m.fp") == F.col("fp")).select(
        "doc_id", "text_hash", length.alias("length"), F.col("m.start").alias("at"), near.alias("near"))
    extended = F.transform(F.sequence(F.lit(0), F.size("near") - F.col("length")), lambda i: F.struct(
        (F.col("at") + i).alias("start"), F.array_join(F.slice("near", i + 1, F.col("length")), " ").alias("gram")))
    windows = places.select("doc_id", "text_hash", "length", F.explode(extended).alias("x")).select(
        "doc_id", "text_hash", "x.start", "length", "x.gram")
    return windows.join(grams, ["length", "gram"]).select("doc_id", "text_hash", "start", "length", "gram")


def _windows(items: DataFrame, window: int) -> tuple[DataFrame, list[int]]:
    """The windows of all items, written once, and their lengths."""
    spans = stage(item_windows(items.select("item_id", "text"), window), "benchmark-windows")
    return spans, sorted(r[0] for r in spans.select("length").distinct().collect())  # at most ``window`` numbers


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row a document: n_words, n_hit, n_items, item_ids (sorted as strings), contaminated."""
    base = docs.select("doc_id", "text").select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    spans, lengths = _windows(items, window)
    if not lengths:
        return base.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"),
                           none.alias("item_ids"), F.lit(False).alias("contaminated"))
    hits = document_hits(docs.select("doc_id", "text"), spans, lengths)
    # one aggregate a document: the places (for the words hit) and the windows (for the items)
    per_doc = hits.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start", "length")).alias("places"), F.collect_set("gram").alias("grams"))
    covered = F.aggregate(
        F.array_sort("places"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["start"] + x["length"]).alias("end"),
                              (a["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(a["end"], x["start"]))).alias("n")),
        lambda a: a["n"])
    per_doc = stage(per_doc.select("doc_id", "text_hash", covered.cast("long").alias("n_hit"), "grams"), "benchmark-hits")
    owners = spans.filter("item_id IS NOT NULL").select("gram", F.col("item_id").cast("string").alias("item"))
    listed = (per_doc.select("doc_id", "text_hash", F.explode("grams").alias("gram")).join(small(owners, size=F.octet_length("gram") + F.octet_length("item")), "gram")
              .groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("item_ids")))
    hit = per_doc.select("doc_id", "text_hash", "n_hit")
    hit = hit.join(listed, same_row(hit, listed, "doc_id", "text_hash"), "left").select(
        hit["doc_id"].alias("d"), hit["text_hash"].alias("h"), "n_hit", "item_ids")
    joined = base.join(hit, base["doc_id"].eqNullSafe(hit["d"]) & (base["text_hash"] == hit["h"]), "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("item_ids", none)
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                         ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no item's window occurs."""
    spans, lengths = _windows(items, window)
    if not lengths:
        return docs
    bad = stage(document_hits(docs.select("doc_id", "text"), spans, lengths).select(
        F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct(), "contaminated")
    found = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_h"))
    packed, columns = pack(docs, "doc_id", "text")
    return packed.join(small(bad), found, "left_anti").select(columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
