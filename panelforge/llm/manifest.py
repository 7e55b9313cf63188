"""Merkle dataset manifest (operator 12): a proof of every document against one root.

Leaves are hashed documents.  Per group (language) they ascend by doc_id, and every two consecutive
nodes become one until a single node, the subroot, remains; subroots, ordered by group, likewise give
the root.  Nodes carry nested-interval labels: the interval of leaf ranks they cover.

The tree is built in tiers of ``TIER`` levels.  Within a tier, nodes are dealt into buckets of
2 ** TIER consecutive nodes, and one row a bucket makes the levels above them, so tier k + 1 has 256 times
fewer rows than tier k.  Ancestors are attached by containment joins on (group, bucket of the tier): a
parent whose interval holds the node's interval is an ancestor, and the rest of the parent's interval
is the sibling's.  The path of a node is its path within the tier and that of its bucket's root in the
next one, so levels above a bucket are joined once a bucket, never once a leaf.

Ranks come from one range sort with counts of the partitions, so a group of any size is spread; no
task gets more than a range of rows or one bucket.

Defined results: NULL fields are hashed as '-'; NULL groups come first, then bytewise; NULL doc_ids come
first within their group and are never tampered with; rows of equal group and doc_id are ordered by
leaf; equal rows are leaves each and have proofs of their own; a document alone in its group is the
subroot; further columns are ignored; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stage

TIER = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    s = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaves(docs: DataFrame, changed: dict[str, Column] | None = None, group: str = "lang") -> DataFrame:
    """(g, doc_id, leaf, other): the leaf of each document, and ``other``, its leaf with the ``changed``
    fields where that differs (else NULL).  ``g`` orders groups, the NULL group first."""
    col = {c: docs[f"`{c}`"] for c in FIELDS}
    leaf = sha(*[field(col[c]) for c in FIELDS])
    now = col | (changed or {})
    differs = F.lit(False)
    for c in changed or {}:
        differs = differs | ~now[c].eqNullSafe(col[c])
    return docs.select(F.coalesce(F.concat(F.lit("="), docs[f"`{group}`"].cast("string")), F.lit("-")).alias("g"), col["doc_id"].alias("doc_id"),
                       leaf.alias("leaf"), F.when(differs, sha(*[field(now[c]) for c in FIELDS])).alias("other"))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """Add ``at``, the rank (from 0) within ``g`` in the order of the columns, and ``n``, the rows of ``g``."""
    sort = ["g", *order, F.xxhash64(F.monotonically_increasing_id())]   # the last one spreads equal rows
    placed = stage(rows.withColumn("_tie", sort[-1]).repartitionByRange("g", *order, "_tie").sortWithinPartitions("g", *order, "_tie")
                   .drop("_tie").withColumn("_part", F.spark_partition_id())
                   .withColumn("_seq", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranked")
    # one row a range and group in it: about as many as there are ranges and groups
    runs = placed.groupBy("g", "_part").agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("g", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                         F.sum("_rows").over(Window.partitionBy("g")).alias("n"))
    return placed.join(small(stage(starts, "ranges")), ["g", "_part"]).withColumn("at", F.col("_seq") + F.col("_shift")).drop("_part", "_seq", "_shift")


def _parents(kids: Column) -> Column:
    """Nodes over every two of ``kids``: interval, end of the left child's interval, both digests, own digest."""
    def node(i):
        a, b = F.get(kids, (2 * i).cast("int")), F.get(kids, (2 * i + 1).cast("int"))
        return F.struct(a["lo"].alias("lo"), F.coalesce(b["hi"], a["hi"]).alias("hi"), a["hi"].alias("cut"), a["digest"].alias("left"),
                        b["digest"].alias("right"), sha(a["digest"], F.coalesce(b["digest"], F.lit(""))).alias("digest"))

    return F.transform(F.sequence(F.lit(0), ((F.size(kids) - 1) / 2).cast("int")), node)


def tier(nodes: DataFrame) -> DataFrame:
    """(g, n, bucket, root, up): from nodes (g, n, at, lo, hi, digest) of one level, n of them in group g, the
    root of each bucket and the nodes over its nodes by level.  A tree ends where one node remains."""
    made = nodes.withColumn("bucket", F.shiftright("at", TIER)).groupBy("g", "n", "bucket").agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("k0"))   # at most 2 ** TIER nodes
    for t in range(TIER):
        kids = F.col(f"k{t}")
        made = made.withColumn(f"k{t + 1}", F.when((F.size(kids) > 1) | (F.col("n") > 1 << TIER), _parents(kids)))
    shown = lambda k: F.transform(k, lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["digest"].alias("digest")))
    root = F.coalesce(*[shown(F.col(f"k{t}")) for t in range(TIER, -1, -1)])[0]
    level = lambda t: F.transform(F.coalesce(F.col(f"k{t}"), F.array()), lambda x: F.struct(
        F.lit(t).alias("level"), x["lo"].alias("lo"), x["hi"].alias("hi"), x["cut"].alias("cut"), x["left"].alias("left"), x["right"].alias("right")))
    return made.select("g", "n", "bucket", root.alias("root"), F.concat(*[level(t) for t in range(1, TIER + 1)]).alias("up"))


def with_ancestors(nodes: DataFrame, up: DataFrame) -> DataFrame:
    """``nodes`` with ``path``: by ancestor within the tier, from below, the sibling's digest (NULL if there is
    none) and whether the node is on the left.  Containment join of intervals by bucket."""
    above = up.select("g", F.col("bucket").alias("_bucket"), F.explode("up").alias("_a"))
    held = nodes.withColumn("_bucket", F.shiftright("at", TIER))
    inside = (above["_a"]["lo"] <= held["lo"]) & (held["hi"] <= above["_a"]["hi"])
    met = held.join(above, (held["g"] == above["g"]) & (held["_bucket"] == above["_bucket"]) & inside, "left").drop(above["g"], above["_bucket"])
    left = F.col("hi") <= F.col("_a.cut")   # the parent's interval less the node's is the sibling's
    step = F.struct(F.col("_a.level").alias("level"), F.when(left, F.col("_a.right")).otherwise(F.col("_a.left")).alias("sibling"), left.alias("left"))
    paths = met.groupBy("g", "_bucket", *[c for c in nodes.columns if c != "g"]).agg(
        F.sort_array(F.collect_list(F.when(F.col("_a").isNotNull(), step))).alias("path"))
    return paths.withColumn("path", F.transform("path", lambda s: F.struct(s["sibling"].alias("sibling"), s["left"].alias("left"))))


def paths(leaf_nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(nodes with ``path`` up to their subroot, subroots (g, digest)) of nodes (g, n, at, lo, hi, digest, ..),
    at most ``most`` in one group."""
    levels, nodes, done = [], leaf_nodes, None
    while True:
        up = stage(tier(nodes.select("g", "n", "at", "lo", "hi", "digest")), "tier")
        tops = up.filter(F.col("n") <= 1 << TIER).select("g", F.col("root.digest").alias("digest"))
        done = tops if done is None else done.unionByName(tops)
        levels.append((nodes, up))
        if most <= 1 << TIER:
            break
        most = -(-most >> TIER)
        nodes = up.filter(F.col("n") > 1 << TIER).select("g", F.ceil(F.col("n") / (1 << TIER)).cast("long").alias("n"), F.col("bucket").alias("at"), "root.*")
    above = None
    for nodes, up in reversed(levels):
        found = with_ancestors(nodes, up)
        if above is not None:
            higher = above.select("g", F.col("at").alias("_bucket"), F.col("path").alias("_higher"))
            found = found.join(higher, ["g", "_bucket"], "left").withColumn("path", F.concat("path", F.coalesce("_higher", F.array()))).drop("_higher")
        above = found.drop("_bucket")
    return above, done


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, group: str = "lang") -> DataFrame:
    """By document: doc_id, g, leaf, other (see ``leaves``), path (sibling, left) to the root, subroot, root."""
    hashed = stage(leaves(docs, changed, group), "leaves")
    rows = ranked(hashed, "doc_id", "leaf").withColumns({"lo": F.col("at"), "hi": F.col("at"), "digest": F.col("leaf")})
    most = rows.agg(F.max("n")).first()[0] or 0
    found, tops = paths(rows, most)
    tops = stage(tops, "subroots")
    groups = ranked(tops.select(F.lit("all").alias("g"), F.col("g").alias("name"), "digest"), "name")
    groups = groups.withColumns({"lo": F.col("at"), "hi": F.col("at")})
    upper, roots = paths(groups, groups.agg(F.max("n")).first()[0] or 0)
    upper = upper.join(roots.select("g", F.col("digest").alias("root")), "g")     # one row
    upper = upper.select(F.col("name").alias("g"), F.col("digest").alias("subroot"), F.col("path").alias("_upper"), "root")
    return found.join(small(stage(upper, "groups")), "g").select("doc_id", "g", "leaf", "other", F.concat("path", "_upper").alias("path"), "subroot", "root")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.when(s["sibling"].isNull(), d).when(s["left"], F.concat(d, s["sibling"]))
                                                       .otherwise(F.concat(s["sibling"], d)), 256))


def verify(made: DataFrame) -> DataFrame:
    """Proofs by document, folded from the changed leaf where there is one."""
    siblings = F.filter(F.transform("path", lambda s: s["sibling"]), lambda x: x.isNotNull())
    folded = fold(F.coalesce("other", "leaf"), F.col("path"))
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", siblings), 256).alias("proof_sha256"),
                       folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
