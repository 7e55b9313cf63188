"""Exact k nearest neighbours within groups, as a blocked search with pivot bounds.

Rows of a group are dealt to their nearest pivot (rows of least hash, about one for ``block`` rows, at
most ``PIVOTS`` a group); a cell of more than ``block`` rows is cut into blocks by hash.  Every query is
first compared with its own block, which bounds the distance of its k-th neighbour.  It then visits
only blocks of cells that can hold a nearer row: by the triangle inequality no row of a cell is nearer
than the distance to its pivot less the cell's radius, nor than the hyperplane between the cell's
pivot and the query's own.  What the blocks find is merged to the k nearest.  Queries are sent to tiles, of
``TILE`` blocks, that hold a block to visit, not to every block; a task holds one tile and at most about
``QUERIES`` queries (both bounded by ``TILE_BYTES``), and a group with more queries sends its tiles that many
more times.  Within a tile the k-th distance found so far rules out further blocks.
Nothing is approximate: bounds leave out only rows that can't be among the k nearest.

Distances are squared Euclidean.  Ties go to the least hash of the key, then row number.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK = 4096
TILE = 16
QUERIES = 32768
TILE_BYTES = 1 << 25      # of the vectors of a tile, and of the queries that meet it
SENT = 4096               # queries in an Arrow batch on their way to tiles, and searched at once
PIVOTS = 256
PIVOT_BYTES = 1 << 26     # of all pivots, which tasks are sent
NEAR = "array<struct<d:double,n:bigint,row:bigint,flag:boolean>>"
NONE = (np.zeros(0), np.zeros(0, int))


def nearest_in_block(q: np.ndarray, own: np.ndarray, tau: np.ndarray, x: np.ndarray, n: np.ndarray, rows: np.ndarray, k: int):
    """By query the (distances, positions) of its k nearest rows of x within squared distance ``tau``, but for
    the position ``own`` (-1: none)."""
    found = []
    x2, slack = (x * x).sum(1), 1e-9
    for a in range(0, len(q), 512):
        part = q[a:a + 512]
        p2 = (part * part).sum(1)
        d = p2[:, None] + x2[None, :] - 2.0 * (part @ x.T)
        self_at = own[a:a + 512]
        d[np.nonzero(self_at >= 0)[0], self_at[self_at >= 0]] = np.inf
        # the expansion rounds: all that may be within the k-th distance are compared exactly
        more = slack * (p2 + (x2.max() if len(x2) else 0.0))
        most = tau[a:a + 512] + more
        within = (d <= most[:, None]).sum(1)
        many = np.nonzero(within > max(64, k))[0]
        if len(many) and len(x) > k:
            most[many] = np.minimum(most[many], np.partition(d[many], k - 1, axis=1)[:, k - 1] + more[many])
        for i in range(len(part)):
            if not within[i]:
                found.append(NONE)
                continue
            c = np.nonzero((d[i] <= most[i]) & (d[i] < np.inf))[0]
            exact = ((part[i] - x[c]) ** 2).sum(1)
            c, exact = c[exact <= tau[a + i]], exact[exact <= tau[a + i]]
            order = np.lexsort((rows[c], n[c], exact))[:k]
            found.append((exact[order], c[order]))
    return found


def _near(found, n, rows, flag) -> list:
    return [[{"d": float(a), "n": int(n[j]), "row": int(rows[j]), "flag": bool(flag[j])} for a, j in zip(d, at)] for d, at in found]


def _vectors(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([_vectors(c) for c in column.chunks if len(c)])
    off = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]].reshape(len(column), -1)


def _least(x: np.ndarray, c: np.ndarray, p: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By query (a row of ``x`` in cell ``c``) and cell, a distance that no row of the cell is below."""
    d = np.stack([np.sqrt(((x - v) ** 2).sum(1)) for v in p], 1)
    apart = np.stack([np.sqrt(((p - v) ** 2).sum(1)) for v in p])[c]
    own = d[np.arange(len(x)), c][:, None]
    plane = np.divide(d * d - own * own, 2 * apart, out=np.zeros_like(d), where=apart > 0)
    return np.maximum(d - radius, plane) - 1e-9 * (1 + d)


def _pivots(pool: DataFrame, sizes: dict[str, int], dims: int, block: int) -> dict[str, np.ndarray]:
    """Vectors of the pivots of each group with more than one block, at most ``PIVOT_BYTES`` together."""
    large = {g: min(PIVOTS, -(-n // block)) for g, n in sizes.items() if n > block}
    room = max(1, PIVOT_BYTES // (8 * max(dims, 1)) // max(len(large), 1))
    large = {g: min(p, room) for g, p in large.items()}
    if not large:
        return {}
    spark = pool.sparkSession
    wanted = spark.createDataFrame([(g, p, min(1.0, 8.0 * p / sizes[g])) for g, p in large.items()], "g string, p int, share double")
    drawn = pool.join(wanted, "g").filter(F.pmod("n", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    order = Window.partitionBy("g").orderBy("n", "row")      # over a few times the pivots
    chosen = drawn.withColumn("at", F.row_number().over(order)).filter("at <= p").select("g", "at", "v").collect()
    out: dict[str, list] = {}
    for r in sorted(chosen, key=lambda r: (r["g"], r["at"])):
        out.setdefault(r["g"], []).append(r["v"])
    return {g: np.array(v, np.float64) for g, v in out.items()}


def exact_neighbours(pool: DataFrame, k: int, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(g, row, near): of each row of ``pool`` with ``query``, its k nearest other rows of the same group ``g`` by
    distance (fewer in smaller groups).  ``pool``: g string, row bigint (unique), n bigint (hash of the row's
    key), query boolean, flag boolean (passed on), v array<double> of one length; its lineage should be cut."""
    spark = pool.sparkSession
    pool = pool.select("g", "row", "n", "query", "flag", "v")
    count = pool.groupBy("g").agg(F.count("*").alias("rows"), F.count_if("query").alias("queries"), F.max(F.size("v")).alias("dims")).collect()   # a row a group
    sizes = {r["g"]: r["rows"] for r in count}
    dims = max((r["dims"] for r in count), default=1)
    room = max(1, TILE_BYTES // (8 * max(dims, 1)))
    tile, queries = max(block, min(TILE * block, room)), min(queries, room)
    parts = {r["g"]: max(1, -(-r["queries"] // queries)) for r in count}
    pivots = _pivots(pool, sizes, dims, block)
    near = f"g string, row bigint, near {NEAR}"

    def home(key, pdf):
        at = np.nonzero(pdf["query"].to_numpy())[0]
        out = pdf.iloc[at][["g", "c", "s", "row", "n", "v"]].copy()
        if not len(at):
            return out.assign(tau=pd.Series(dtype=float), near=pd.Series(dtype=object))
        x, n, rows, flag = np.stack(pdf["v"].to_numpy()), pdf["n"].to_numpy(), pdf["row"].to_numpy(), pdf["flag"].to_numpy()
        found = nearest_in_block(x[at], at, np.full(len(at), np.inf), x, n, rows, k)
        out["tau"] = [float(d[-1]) if len(d) == k else np.inf for d, _ in found]
        out["near"] = _near(found, n, rows, flag)
        return out

    homes = f"g string, c int, s int, row bigint, n bigint, v array<double>, tau double, near {NEAR}"
    if not pivots:   # every group is one block
        whole = pool.withColumns({"c": F.lit(0), "s": F.lit(0)})
        return whole.groupBy("g").applyInPandas(home, homes).select("g", "row", "near")

    shared = spark.sparkContext.broadcast(pivots)

    def deal(batches):
        for b in batches:
            x, g = _vectors(b.column("v")), b.column("g").to_pylist()
            c, d = np.zeros(len(x), np.int32), np.zeros(len(x))
            names = np.array(g, object)
            for name in set(g) & shared.value.keys():
                at, p = np.nonzero(names == name)[0], shared.value[name]
                for i in range(0, len(at), 1024):
                    rows = at[i:i + 1024]
                    d2 = ((x[rows] ** 2).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2.0 * (x[rows] @ p.T))
                    c[rows] = d2.argmin(1)
                    d[rows] = np.sqrt(((x[rows] - p[c[rows]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c), pa.array(d)], names=[*b.schema.names, "c", "d"])

    dealt = cut_lineage(pool.mapInArrow(deal, "g string, row bigint, n bigint, query boolean, flag boolean, v array<double>, c int, d double"), "cells")
    cells = dealt.groupBy("g", "c").agg(F.max("d").alias("radius"), F.count("*").alias("rows"))   # at most a row a pivot
    cells = sorted(cells.collect(), key=lambda r: (r["g"], r["c"]))
    table: dict[str, tuple] = {}
    places, start = [], dict.fromkeys(sizes, 0)
    for r in cells:
        radius, blocks, tiled = table.setdefault(r["g"], (np.zeros(PIVOTS), np.zeros(PIVOTS, int), {}))
        radius[r["c"]], blocks[r["c"]] = r["radius"], -(-r["rows"] // block)
        wide, at = r["rows"] // int(blocks[r["c"]]), start[r["g"]]
        tiled[r["c"]] = sorted({(at + s * wide) // tile for s in range(blocks[r["c"]])})
        places.append((r["g"], r["c"], int(blocks[r["c"]]), at, wide))
        start[r["g"]] += r["rows"]
    places = F.broadcast(spark.createDataFrame(places, "g string, c int, blocks int, at bigint, wide bigint"))
    placed = (dealt.join(places, ["g", "c"]).withColumn("s", F.pmod(F.col("n"), F.col("blocks")).cast("int"))
              .withColumn("tile", F.expr(f"CAST((at + s * wide) div {tile} AS INT)")).drop("d", "blocks", "at", "wide"))
    first = cut_lineage(placed.groupBy("g", "c", "s").applyInPandas(home, homes), "home-blocks")
    bounds = spark.sparkContext.broadcast(table)

    def visits(batches):
        for b in batches:
            x, g, c, tau, n = _vectors(b.column("v")), np.array(b.column("g").to_pylist(), object), *(b.column(i).to_numpy() for i in ("c", "tau", "n"))
            for name in set(g) & shared.value.keys():
                p, (radius, blocks, tiled) = shared.value[name], bounds.value[name]
                of_tile = np.zeros((len(p), 1 + max(max(t) for t in tiled.values())), np.int32)
                for cell, tiles in tiled.items():
                    of_tile[cell, tiles] = 1
                own = np.nonzero(g == name)[0]
                for i in range(0, len(own), 1024):
                    rows = own[i:i + 1024]
                    visit_cell = (_least(x[rows], c[rows], p, radius[:len(p)]) <= np.sqrt(tau[rows])[:, None]) & (blocks[:len(p)] > 0)
                    visit_cell[np.arange(len(rows)), c[rows]] &= blocks[c[rows]] > 1     # its own block is done
                    at, to = np.nonzero(visit_cell.astype(np.int32) @ of_tile)
                    for j in range(0, len(at), SENT):
                        take = rows[at[j:j + SENT]]
                        sent = b.take(pa.array(take, pa.int64()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(to[j:j + SENT], pa.int32()), pa.array(n[take] % parts[name], pa.int32()), *(sent.column(f) for f in ("g", "c", "s", "row", "v", "tau"))],
                            names=["tile", "part", "g", "c", "s", "row", "v", "tau"])

    tile_of = ["g", "tile", "part"]
    goes = first.select("g", "c", "s", "row", "n", "v", "tau").mapInArrow(
        visits, "tile int, part int, g string, c int, s int, row bigint, v array<double>, tau double")
    copies = F.broadcast(spark.createDataFrame(list(parts.items()), "g string, parts int"))
    data = placed.join(copies, "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*tile_of, "c", "s", "row", "n", "flag", "v")
    data = data.join(F.broadcast(goes.select(*tile_of).distinct()), tile_of, "left_semi")    # a row a task

    def visit(asked, held):
        d, n, rows, flag, to = [], [], [], [], [0]
        if len(asked) and len(held):
            name = asked.column("g")[0].as_py()
            p, (radius, _, _) = shared.value[name], bounds.value[name]
            q, tau, c, s = _vectors(asked.column("v")), *(asked.column(i).to_numpy() for i in ("tau", "c", "s"))
            x, hn, hrow, hflag, hc, hs = _vectors(held.column("v")), *(held.column(i).to_numpy() for i in ("n", "row", "flag", "c", "s"))
            order = np.lexsort((hs, hc))
            ends = np.nonzero(np.diff(hc[order]) | np.diff(hs[order]))[0] + 1
            by_block = [(hc[b[0]], hs[b[0]], b) for b in np.split(order, ends)]
            for i in range(0, len(q), SENT):
                part, most = q[i:i + SENT], tau[i:i + SENT].copy()
                least = _least(part, c[i:i + SENT], p, radius[:len(p)])
                best = [NONE] * len(part)
                for cell, sub, b in by_block:
                    at = np.nonzero((least[:, cell] <= np.sqrt(most)) & ((c[i:i + SENT] != cell) | (s[i:i + SENT] != sub)))[0]
                    if not len(at):
                        continue
                    for j, (dist, where) in zip(at, nearest_in_block(part[at], np.full(len(at), -1), most[at], x[b], hn[b], hrow[b], k)):
                        if len(where):
                            dist, where = np.concatenate([best[j][0], dist]), np.concatenate([best[j][1], b[where]])
                            keep = np.lexsort((hrow[where], hn[where], dist))[:k]
                            best[j] = dist[keep], where[keep]
                            if len(keep) == k:
                                most[j] = min(most[j], dist[keep[-1]])
                at = np.concatenate([w for _, w in best])
                d.append(np.concatenate([a for a, _ in best]))
                n.append(hn[at])
                rows.append(hrow[at])
                flag.append(hflag[at])
                to.extend(to[-1] + np.cumsum([len(w) for _, w in best]))
        else:
            asked = asked.slice(0, 0)
        cols = [pa.array(np.concatenate(a) if a else [], t) for a, t in ((d, pa.float64()), (n, pa.int64()), (rows, pa.int64()), (flag, pa.bool_()))]
        found = pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.StructArray.from_arrays(cols, ["d", "n", "row", "flag"]))
        out = pa.table({"g": asked.column("g"), "row": asked.column("row"), "near": found})
        return out.filter(pc.greater(pc.list_value_length(out.column("near")), 0))

    other = goes.groupBy(*tile_of).cogroup(data.groupBy(*tile_of)).applyInArrow(visit, near)
    both = first.select("g", "row", "near").unionByName(other)
    return both.groupBy("g", "row").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))   # k a tile that was visited
