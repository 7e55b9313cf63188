"""Document fingerprints as Merkle trees (operator 9), DataFrame functions only.

A text is cut without loss into paragraphs (a line with the line ends after it)
and every paragraph into leaves of at most ``LEAF`` code points, counted from
the paragraph's start.  A leaf's node is the SHA-256 of its characters, a
paragraph's that of its leaves' nodes, a section's (``SECTION`` paragraphs in a row)
that of its paragraphs', the root that of its sections'.  Nodes are hashed whole, so equal
roots mean equal texts, and the branches that differ say which paragraphs were edited.

The fingerprint string is ``root|section:paragraph.leaf.leaf;paragraph...|...``.  The
root is written whole; leaves and paragraphs are written by their first 8 hex digits,
sections by 16, after their parents were hashed.  The likeness of two fingerprints is
the Dice coefficient of their sets of leaves as written.

Defined results: a NULL text is the empty text; the empty text has no sections,
two empty ones are alike by 1.  "Next" is by descending doc_id, rows with equal
doc_id by text, rows with NULL doc_id last; after the last row comes the first;
a single row is its own next.  Repeated rows repeat.  Columns other than doc_id
and text are ignored; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

LEAF = 32
SECTION = 8
#: Hex digits of a whole node.
ROOT = 64
#: Ranges of doc_id a shuffle partition gets; they bound the rows of the small tables below.
RANGES = 4


def _node(kind: str, children: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), children).cast("binary"), 256)


def _parent(kind: str, children: Column, digits: int, mark: str, between: str) -> Column:
    """(node, shown) of the children's (node, shown): hashed whole, written by the first digits."""
    nodes = F.array_join(F.transform(children, lambda c: c["node"]), between)
    shown = F.array_join(F.transform(children, lambda c: c["shown"]), between)
    return let(_node(kind, nodes), lambda h: F.struct(h.alias("node"), F.concat(F.substring(h, 1, digits), F.lit(mark), shown).alias("shown")))


def fingerprint(text: Column) -> Column:
    """The serialised tree of one text."""
    t = F.coalesce(text, F.lit(""))
    leaf = f"[^\\n]{{1,{LEAF}}}\\n*|\\n+"

    def leaf_node(x):
        return let(_node("L", x), lambda h: F.struct(h.alias("node"), F.substring(h, 1, 8).alias("shown")))

    def paragraph(p):
        found = F.transform(F.regexp_extract_all(p, F.lit(leaf), F.lit(0)), leaf_node)
        return let(found, lambda ls: _parent("P", ls, 8, ".", "."))

    def section(ps, i):
        # get(), not slice(): inside a lambda slice() copies the whole array first
        few = F.filter(F.array(*[F.get(ps, i + x) for x in range(SECTION)]), lambda p: p.isNotNull())
        return let(few, lambda qs: _parent("S", qs, 16, ":", ";"))

    paragraphs = F.transform(F.regexp_extract_all(t, F.lit("[^\\n]*\\n+|[^\\n]+"), F.lit(0)), paragraph)
    none = F.array().cast("array<struct<node:string,shown:string>>")
    sections = let(paragraphs, lambda ps: F.when(F.size(ps) > 0, F.transform(
        F.sequence(F.lit(0), F.size(ps) - 1, F.lit(SECTION)), lambda i: section(ps, i))).otherwise(none))
    return let(sections, lambda ss: _parent("R", ss, ROOT, "|", "|"))["shown"]


def root(fp: Column) -> Column:
    return F.substring(fp, 1, ROOT)


def leaves(fp: Column) -> Column:
    """The leaf nodes of a fingerprint, in order."""
    return F.regexp_extract_all(fp, F.lit("\\.([0-9a-f]{8})"), F.lit(1))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the distinct leaves that both have by the distinct leaves of each."""
    def dice(x):
        return let(F.array_distinct(leaves(b)), lambda y: F.when(F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(
            F.lit(2.0) * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))))
    return let(F.array_distinct(leaves(a)), dice)


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Positions (from 0) of the paragraphs of b that a doesn't have; equal roots need no look below."""
    nodes = lambda fp: F.regexp_extract_all(fp, F.lit("[:;]([0-9a-f]{8})"), F.lit(1))
    none = F.array().cast("array<int>")

    def differing(have):
        at = F.transform(nodes(b), lambda x, i: F.when(~F.array_contains(have, x), i))
        return F.filter(at, lambda i: i.isNotNull())
    return F.when(root(a) == root(b), none).otherwise(let(F.array_distinct(nodes(a)), differing))


def _bucket(key: Column, splits: list[int]) -> Column:
    """How many of the sorted splits are under the key, by binary search; -1 for a NULL key."""
    steps, step = [], 1
    while step <= len(splits):
        steps.insert(0, step)
        step *= 2
    if not splits:
        return F.when(key.isNull(), -1).otherwise(0)
    cuts = F.array(*[F.lit(s).cast("bigint") for s in splits])
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(
        F.coalesce(F.get(cuts, at + s - 1) < key, F.lit(False)), at + s).otherwise(at))
    return F.when(key.isNull(), -1).otherwise(found)


def with_next(docs: DataFrame, order: str, tie: str, carry: list[str]) -> DataFrame:
    """Append ``next_<c>`` of the row that follows by descending ``order`` (then ``tie``) for each c
    of ``carry``; the first row follows the last.

    The rows go to ranges of ``order``.  The top row of each range is sent to the range above, too,
    so that one window a range sees every successor; no window holds the whole table.
    """
    spark = docs.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [i / n for i in range(1, n)]
    splits = docs.agg(F.percentile_approx(order, at, 20 * n).alias("s")).first()["s"] if at else None
    ranged = docs.withColumn("_range", _bucket(F.col(order), sorted(set(splits or []))))
    every = Window.orderBy("_range")  # at most n rows: one a range
    tops = ranged.groupBy("_range").agg(F.max(order).alias("_top")).select(
        F.col("_range").alias("_r"), "_top", F.coalesce(F.lead("_range").over(every), F.min("_range").over(Window.partitionBy())).alias("_above"))
    joined = ranged.join(F.broadcast(tops), (F.col("_range") == F.col("_r")) & F.col(order).eqNullSafe(F.col("_top")), "left")
    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("_above").alias("range"), F.lit(True).alias("copy"))
    dealt = joined.select(*docs.columns, F.explode(F.when(F.col("_above").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("_to"))
    w = Window.partitionBy("_to.range").orderBy("_to.copy", F.col(order).desc_nulls_last(), tie)
    return dealt.select(*docs.columns, F.col("_to.copy").alias("_copy"), *[F.lead(c).over(w).alias(f"next_{c}") for c in carry]).filter(~F.col("_copy")).drop("_copy")


def fingerprints_and_edits(docs: DataFrame) -> DataFrame:
    """Per row: the fingerprint, that of the text whose last third is replaced by the start of the
    next document, and how alike they and the next document are."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = with_next(base.withColumn("fingerprint", fingerprint(F.col("text"))), "doc_id", "text", ["text", "fingerprint"])
    n = F.char_length("text")
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = (base.withColumn("n_chars", n.cast("long"))
              .withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")),
                                             F.substring("next_text", F.lit(1), cut)))
              .drop("text", "next_text"))
    edited = edited.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return edited.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
