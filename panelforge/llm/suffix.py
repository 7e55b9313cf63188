"""Suffix-array dedup (operator 11): bytes covered by a string of ``WINDOW`` bytes that also starts earlier.

The method builds the suffix order of many documents column by column: each round inserts one symbol
of every document and updates the collection's Burrows-Wheeler order and common prefixes.  Over whole
documents that takes as many rounds as the longest has bytes, so the collection here consists of
*pieces*: every window has an anchor, the ``GRAM`` bytes in it of least hash (the leftmost of equal
ones), and the consecutive windows of one anchor are a piece of at most 2 * WINDOW - GRAM bytes.  Equal
windows have equal anchors at equal offsets, so pieces are aligned at their anchor, each window lies in
one piece, and equal windows are at the same column of pieces with the same anchor.  A round stably
sorts the last order by the symbols of the next column to the left and takes the common prefix of
neighbours from the least one of the last round's in between; from the round on that completes a
window, runs of prefixes of ``WINDOW`` bytes or more are the equal windows, and all but the earliest
document's and place's are covered.  The sequential files are Spark's: pieces are shuffled by anchor
and sorted externally, and tasks read them as a stream.

Which pieces: anchors are counted over the corpus first.  Those seen once have no equal windows and
are left out, by a bit map of the others (at most ``BITS`` bits; where more anchors share a bit, more
pieces are sent, none is lost).  Each task sorts its own pieces first, so of its copies only the
earliest is sent.  An anchor of ``HOT`` or more places is split: each of its windows is sent as a
piece of its own, by a hash of its bytes, so no task gets all contexts of a frequent phrase.

Defined results: NULL is the empty text; texts under ``WINDOW`` bytes keep everything; documents are
ordered by doc_id, a NULL one first, different texts of one doc_id by a hash of the text; equal rows
count as one document and get equal results; further columns are ignored; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

WINDOW = 100
GRAM = 16                     # a power of 2
BACK = WINDOW - GRAM          # an anchor is at most so far from its window's start
COLUMNS = BACK + WINDOW       # of aligned pieces; the anchor starts at column BACK
BITS = 1 << 29                # of the map of repeated anchors at most
HOT = 1 << 18                 # places of an anchor from which its windows are dealt out one by one
HOT_KEYS = 1 << 20            # such anchors at most, the most frequent ones
RUN = 1 << 20                 # window starts whose anchors are found at once
SLICE = 1 << 24               # bytes of documents that are looked at together
SOME = 256                    # texts cut at once
CHUNK = 1 << 17               # pieces whose order is built together, if one anchor has no more

_code = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    return x ^ (x >> np.uint64(29))


def _grams(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on."""
    h, n = _code[raw], 1
    while n < GRAM:
        h = _mix(h[:-n] * np.uint64(0x9E3779B97F4A7C15) + h[n:])
        n *= 2
    return h


def _least(v: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    size = 1
    while size * 2 <= n:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return v if size == n else np.minimum(v[:len(v) - (n - size)], v[n - size:])


def find_pieces(raw: np.ndarray, off: np.ndarray, hot: np.ndarray | None = None):
    """(key, anchor, first window, last window) of the pieces of documents ``raw[off[i]:off[i + 1]]``; windows
    of an anchor in ``hot`` (sorted) are pieces of their own."""
    found, low = [], np.uint64((1 << 21) - 1)
    for x in range(0, max(len(raw) - WINDOW + 1, 0), RUN):
        part = raw[x:x + RUN + WINDOW - 1]
        h = _grams(part)
        # the place in the low bits makes the leftmost of equal hashes the least
        at = (_least((h & ~low) | np.arange(len(h), dtype=np.uint64), BACK + 1) & low).astype(np.int64)
        n = len(at)
        a, z = np.searchsorted(off, x, "right") - 1, np.searchsorted(off, x + n)
        first, stop = np.clip(off[a:z] - x, 0, n), np.clip(off[a + 1:z + 1] - WINDOW + 1 - x, 0, n)
        some = stop > first
        valid = np.zeros(n + 1, np.int32)
        np.add.at(valid, first[some], 1)
        np.add.at(valid, stop[some], -1)
        valid = np.cumsum(valid[:n]) > 0
        new, last = valid.copy(), valid.copy()
        new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
        last[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
        lo, hi = np.nonzero(new)[0], np.nonzero(last)[0]
        # neighbours with one anchor are in one document: the anchor's place is
        p, key = at[lo], h[at[lo]]
        if hot is not None and len(hot):
            split = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
            if split.any():
                size = (hi - lo + 1)[split]
                s = np.repeat(lo[split] - np.cumsum(size) + size, size) + np.arange(size.sum())
                k = np.zeros(len(s), np.uint64)
                for d in [*range(0, BACK, GRAM), BACK]:
                    k = _mix(k * np.uint64(0x9E3779B97F4A7C15) + h[s + d])
                p, lo, hi, key = (np.concatenate([u[~split], w]) for u, w in ((p, s), (lo, s), (hi, s), (key, k)))
        found.append((key, p + x, lo + x, hi + x))
    if not found:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(c) for c in zip(*found))


def _inside(p, lo, hi) -> np.ndarray:
    """Which columns of each aligned piece are its bytes."""
    c = np.arange(COLUMNS, dtype=np.int16)
    return (c >= (BACK - (p - lo)).astype(np.int16)[:, None]) & (c < (BACK - (p - hi) + WINDOW).astype(np.int16)[:, None])


def covered_windows(rows: np.ndarray, group: np.ndarray, rank: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """By piece and column from 0 to BACK: is the window that starts there one of the piece's and one of an
    earlier piece of its group.  ``rows`` are aligned bytes, ordered by ``group`` (under 2 ** 16) and ``rank``
    (equal for the same place); the piece's windows start at columns ``most`` to ``least``."""
    n = len(rows)
    columns = np.ascontiguousarray(rows.T)
    group = group.astype(np.uint16)
    inner = np.concatenate([[False], group[1:] == group[:-1]])
    order, prefix = np.arange(n), np.zeros(n + 1, np.int16)
    covered = np.zeros((n, BACK + 1), bool)
    for j in range(COLUMNS - 1, -1, -1):
        symbol = columns[j][order]
        at = np.argsort(symbol, kind="stable")
        at = at[np.argsort(group[at], kind="stable")]          # pieces stay in their groups
        symbol = symbol[at]
        same = np.nonzero(inner[1:] & (symbol[1:] == symbol[:-1]))[0] + 1
        a, b = at[same - 1], at[same]
        grown = prefix[b]
        far = np.nonzero(b != a + 1)[0]
        if len(far):
            bounds = np.empty(2 * len(far), np.int64)
            bounds[::2], bounds[1::2] = a[far] + 1, b[far] + 1
            grown[far] = np.minimum.reduceat(prefix, bounds)[::2]
        prefix = np.zeros(n + 1, np.int16)
        prefix[same] = grown + 1
        order = order[at]
        if j <= BACK:
            starts = np.nonzero(prefix[:n] < WINDOW)[0]
            own = (most[order] <= j) & (j <= least[order])
            r = rank[order]
            first = np.minimum.reduceat(np.where(own, r, n), starts)
            covered[order, j] = own & (r > np.repeat(first, np.diff(np.append(starts, n))))
    return covered


def _resolve(key, doc, tie, p, lo, hi, rows_of, chunk=CHUNK):
    """(covered, whole): runs of covered windows as (piece, first start, last start), and which pieces are covered
    as a whole.  ``rows_of(pieces)`` gives aligned bytes."""
    n = len(key)
    order = np.lexsort((p, tie, doc, key))
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if n else np.zeros(0, bool)
    starts = np.nonzero(new)[0]
    sizes = np.diff(np.append(starts, n))
    runs, whole = [], np.zeros(n, bool)
    order = order[np.repeat(sizes > 1, sizes)]
    sizes = sizes[sizes > 1]
    ends = np.cumsum(sizes)
    g = 0
    while g < len(sizes):
        base = ends[g] - sizes[g]
        z = max(g + 1, min(int(np.searchsorted(ends, base + chunk, "right")), g + 65535))
        at = order[base:ends[z - 1]]
        group = np.repeat(np.arange(z - g), sizes[g:z])
        place = np.stack([group, doc[at], tie[at], p[at]])
        rank = np.cumsum(np.concatenate([[0], (place[:, 1:] != place[:, :-1]).any(axis=0)]))
        most, least = BACK - (p[at] - lo[at]), BACK - (p[at] - hi[at])
        c = covered_windows(rows_of(at), group, rank, most, least)
        whole[at] = c.sum(axis=1) == least - most + 1
        edge = np.diff(c.astype(np.int8), axis=1, prepend=0, append=0)
        i, first = np.nonzero(edge > 0)
        last = np.nonzero(edge < 0)[1] - 1
        runs.append((at[i], p[at[i]] - BACK + first, p[at[i]] - BACK + last))
        # equal places twice: one of them is enough
        whole[at[1:][rank[1:] == rank[:-1]]] = True
        g = z
    return (tuple(np.concatenate(x) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 3), whole


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without NULLs."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0]:off[-1]]
    return raw, off - off[0]


def _documents(column: pa.Array):
    """(first row, bytes, offsets) of documents of about ``SLICE`` bytes together."""
    raw, off = _buffers(column)
    a = 0
    while a < len(column):
        z = max(a + 1, int(np.searchsorted(off, off[a] + SLICE, "right")) - 1)
        yield a, raw[off[a]:off[z]], off[a:z + 1] - off[a]
        a = z


def _ordered(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, tie, text): doc and tie give the order of documents, text as bytes."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("tie"), text.cast("binary").alias("text"))


def repeated_anchors(texts: DataFrame) -> DataFrame:
    """(key, n) of the anchors with more than one place."""
    def run(batches):
        for b in batches:
            for _, raw, off in _documents(b.column(0)):
                key, n = np.unique(find_pieces(raw, off)[0], return_counts=True)
                for a in range(0, len(key), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(key[a:a + (1 << 17)].view(np.int64)), pa.array(n[a:a + (1 << 17)])], names=["key", "n"])

    counted = texts.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return stage(counted.filter("n > 1"), "anchors")


def bit_map(anchors: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bit for each key modulo the size, which is a power of 2 of at most ``bits``; 4 KB a row on the way."""
    n = anchors.count()
    size = min(bits, max(1 << 15, 1 << (8 * n).bit_length()))
    at = F.col("key").bitwiseAND(size - 1) + 1
    rows = anchors.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toArrow()
    made = np.zeros(size // 8, np.uint8)
    for bucket, held in zip(rows["bucket"].to_pylist(), rows["bits"].to_pylist()):
        made[(bucket - 1) * 4096:bucket * 4096] = np.frombuffer(held, np.uint8)
    return made


PIECES = "key bigint, doc bigint, tie bigint, at bigint, back int, windows int, bytes binary"


def _emit(key, doc, tie, at, back, windows, data=None, sizes=None):
    """Piece rows; without data rows of removed bytes ``at`` to ``at + windows``."""
    if data is None:
        held = pa.nulls(len(key), pa.binary())
    else:
        held = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(data)])
    cols = [pa.array(np.ascontiguousarray(x), t) for x, t in ((key.view(np.int64), pa.int64()), (doc, pa.int64()), (tie, pa.int64()), (at, pa.int64()),
                                                             (back.astype(np.int32), pa.int32()), (windows.astype(np.int32), pa.int32()))]
    return pa.RecordBatch.from_arrays([*cols, held], names=["key", "doc", "tie", "at", "back", "windows", "bytes"])


def _merge(doc, start, stop):
    """Overlapping or touching runs of one document joined; sorted by document and start."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    if not len(doc):
        return doc, start, stop
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    # runs grow by document, as documents lie one after the other
    reach = np.maximum.accumulate(stop)
    new[1:] |= start[1:] > reach[:-1]
    first = np.nonzero(new)[0]
    return doc[first], start[first], np.maximum.reduceat(stop, first)


def send_pieces(texts: DataFrame, bits: np.ndarray, hot: np.ndarray) -> DataFrame:
    """Pieces whose anchor may be repeated, less those that their task covers; what tasks cover are rows without bytes."""
    shared = texts.sparkSession.sparkContext.broadcast((bits, hot))

    def run(batches):
        bits, hot = shared.value
        mask = np.uint64(len(bits) * 8 - 1)
        for b in batches:
            ids, ties = (b.column(i).to_numpy() for i in (0, 1))
            for a, raw, off in _documents(b.column(2)):
                key, p, lo, hi = find_pieces(raw, off, hot)
                bit = key & mask
                # windows of hot anchors have keys of their own, unknown to the map
                known = (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                if len(hot):
                    known |= lo == p
                key, p, lo, hi = key[known], p[known], lo[known], hi[known]
                if not len(key):
                    continue
                place = np.searchsorted(off, lo, "right") - 1       # the document
                doc, tie = ids[a + place], ties[a + place]
                padded = np.concatenate([np.zeros(BACK, np.uint8), raw, np.zeros(WINDOW, np.uint8)])
                view = np.lib.stride_tricks.sliding_window_view(padded, COLUMNS)
                rows_of = lambda at: view[p[at]] * _inside(p[at], lo[at], hi[at])
                (i, first, last), whole = _resolve(key, doc, tie, p - off[place], lo - off[place], hi - off[place], rows_of)
                d, start, stop = _merge(place[i], first + off[place[i]], last + off[place[i]] + WINDOW)
                yield _emit(_mix(ties[a + d].view(np.uint64) + start.view(np.uint64)), ids[a + d], ties[a + d], start - off[d], np.zeros(len(d)), stop - start)
                left = np.nonzero(~whole)[0]
                for x in range(0, len(left), 1 << 15):
                    at = left[x:x + (1 << 15)]
                    inside = _inside(p[at], lo[at], hi[at])
                    yield _emit(key[at], doc[at], tie[at], (p - off[place])[at], (p - lo)[at], (hi - lo + 1)[at], view[p[at]][inside], inside.sum(axis=1))

    return texts.select("doc", "tie", "text").mapInArrow(run, PIECES)


def cover(pieces: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc, tie, start, stop): removed runs of bytes, from pieces shuffled and sorted by key; about ``chunk``
    pieces are held at once, or those of one key."""
    def run(batches):
        held, size = [], 0

        def resolve(table):
            key, doc, tie, p, back, windows = (table.column(i).to_numpy() for i in range(6))
            lo = p - back
            hi = lo + windows - 1
            data = table.column(6).combine_chunks()
            raw, off = _buffers(data.combine_chunks() if isinstance(data, pa.ChunkedArray) else data)

            def rows_of(at):
                inside = _inside(p[at], lo[at], hi[at])
                n = off[at + 1] - off[at]
                out = np.zeros(inside.shape, np.uint8)
                out[inside] = raw[np.repeat(off[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                return out

            (i, first, last), _ = _resolve(key, doc, tie, p, lo, hi, rows_of, chunk)
            return pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(tie[i]), pa.array(first), pa.array(last + WINDOW)], names=["doc", "tie", "start", "stop"])

        for b in batches:
            done = b.filter(b.column(6).is_null())
            yield pa.RecordBatch.from_arrays([done.column(1), done.column(2), done.column(3), pa.array(done.column(3).to_numpy() + done.column(5).to_numpy())],
                                             names=["doc", "tie", "start", "stop"])
            b = b.filter(b.column(6).is_valid())
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size >= chunk:
                # the last key may go on in the next batch
                table = pa.Table.from_batches(held)
                key = table.column(0).to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield resolve(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size -= cut
        if held:
            yield resolve(pa.Table.from_batches(held))

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc bigint, tie bigint, start bigint, stop bigint")


def repeats(docs: DataFrame, bits: int = BITS, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """(doc, tie, spans): per document the runs of bytes (start, stop) that are covered, unmerged."""
    texts = _ordered(docs)
    anchors = repeated_anchors(texts)
    split = anchors.filter(F.col("n") >= hot).orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key").toArrow()["key"].to_numpy()
    pieces = send_pieces(texts, bit_map(anchors, bits), np.sort(split.view(np.uint64)))
    return cover(pieces, chunk).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def remove_repeats(docs: DataFrame, **kw) -> DataFrame:
    """By row of docs: doc_id, n_bytes, spans (merged runs that are removed) and kept (the bytes left)."""
    joined = _ordered(docs).join(repeats(docs, **kw), ["doc", "tie"], "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        small = (c for b in batches for c in (b.slice(a, SOME) for a in range(0, b.num_rows, SOME)))
        for b in small:
            out = []
            for text, spans in zip(b.column(1), b.column(2)):
                text, s = text.as_py(), spans.values if spans.is_valid else None
                if s is None:
                    out.append((len(text), [], text))
                    continue
                start, stop = s.field("start").to_numpy(), s.field("stop").to_numpy()
                _, start, stop = _merge(np.zeros(len(start), np.int64), start, stop)
                edges = [0, *[int(x) for pair in zip(start, stop) for x in pair], len(text)]
                out.append((len(text), [{"start": int(x), "stop": int(y)} for x, y in zip(start, stop)],
                            b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))))
            kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]],
                                             names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
