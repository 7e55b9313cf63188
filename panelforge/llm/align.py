"""Cross-tokenizer alignment (operator 13): which tokens of two tokenizers cover the same bytes.

Tokenizer A (the tokenizers library, byte-level) gives character offsets, tokenizer B (sentencepiece)
the spans of its proto; both are coarse cuts in bytes.  A token whose span doesn't have the length of
its decoded bytes (a part of a multibyte character, a byte-fallback token, the added first space) is
cut after its decoded bytes instead.  Over ASCII alone every character is a byte, no span can differ
from the decoded bytes, and none is asked for.  Offsets where tokens of both end cut the text into groups; the
last tokens of a group are linked.

Neither tokenizer has a token that goes on from another character to a space (checked of every piece
when a tokenizer is read), so each space after a character that is no white space cuts the text into
parts that can be encoded alone.  A part is aligned once and kept in a bounded memo, as most parts are
words that come again.

Texts are encoded once; their links are written beside the counts and digests of a document.  A
shuffle of partial sums counts the pairs over the corpus.  The ``HEAD`` most frequent pairs are
broadcast; the links of all others meet the table of counts in a join, so it may grow without bound.

Defined results: NULL and empty texts, and texts that either tokenizer doesn't give back byte for byte
(such as those with U+2581), have no tokens, no links and the groups ''; the string of a special token
is plain text; repeated rows repeat; further columns are ignored; an empty table gives no rows.
"""
from __future__ import annotations

import re
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

HEAD = 1 << 18           # linked pairs that tasks know
MEMO = 1 << 24           # characters of parts that a task keeps
SLICE = 128              # texts aligned at once
LONG = 1 << 20           # characters of texts from which a slice ends early
TOGETHER = 1 << 14       # characters of new parts encoded at once
SPACE = "▁"

_cut = re.compile(r"(?<=\S) ")
_crowded = re.compile(r"\s ")


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable Latin-1 characters for
    themselves, the other bytes by turns from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


def parts_of(text: str) -> list[str]:
    """The parts of space + text, each without its first space."""
    return _cut.split(text) if _crowded.search(" " + text) else text.split(" ")


def cuts(starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ends of tokens: the coarse cut where the span has the token's length, and from the last such cut
    on the decoded bytes of the tokens in between."""
    total = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(ends - starts == sizes, np.arange(len(sizes)), -1))
    return total + np.where(last >= 0, ends[last] - total[last], 0)


class Tokenizers:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = _byte_alphabet()
        known = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
                 for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [known.get(i, b"") for i in range(max(known) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        if any(_cut.search(x.decode(errors="replace")) for x in [*self.a_bytes, *self.b_bytes]):
            raise ValueError("a token goes on from another character to a space: texts can't be cut there")
        self.b_space = self.b.piece_to_id(SPACE)
        # a pair of ids: A's shifted over B's, in an int if all of them fit
        self.kind, self.shift = ("int", 15) if len(self.a_bytes) <= 1 << 16 and len(self.b_bytes) <= 1 << 15 else ("bigint", 32)
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # ids as text before ',' and '|' (A), and before ',', ';' and the end of a part (B)
        self.said = np.array([f"{i}{c}" for c in ",|" for i in range(len(self.a_bytes))]
                             + [f"{i}{c}" for c in ",;\n" for i in range(len(self.b_bytes))], object)

    def _piece(self, i: int) -> bytes:
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()

    def encode(self, text: str):
        """((ids, ends) of A, the same of B) over space + text, ends in bytes; None if the joined bytes of
        the tokens differ."""
        raw = (" " + text).encode()
        ascii_only = len(raw) == len(text) + 1
        a = (self.a.encode_batch_fast if ascii_only else self.a.encode_batch)([" " + text], add_special_tokens=False)[0]
        a_ids = a.ids
        if b"".join([self.a_bytes[i] for i in a_ids]) != raw:
            return None
        pieces = [] if ascii_only else self.b.encode(text, return_type="proto").pieces
        b_ids = [p.id for p in pieces] if pieces else self.b.encode(text) or [self.b_space]     # no text: the space alone
        if b"".join([self.b_bytes[i] for i in b_ids]) != raw:
            return None
        a_ids, b_ids = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        a_size, b_size = self.a_size[a_ids], self.b_size[b_ids]
        if ascii_only:
            return (a_ids, np.cumsum(a_size)), (b_ids, np.cumsum(b_size))
        # offsets of characters to offsets of bytes
        at = np.append(np.nonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)[0], len(raw))
        spans = at[np.fromiter(chain.from_iterable(a.offsets), np.int64, 2 * len(a_ids))]
        # spans of B are within the text; the space before it belongs to the first piece
        starts, ends = (np.fromiter(x, np.int64, len(b_ids)) + 1 for x in ((p.begin for p in pieces), (p.end for p in pieces)))
        starts[:1] = 0
        return (a_ids, cuts(spans[::2], spans[1::2], a_size)), (b_ids, cuts(starts, ends, b_size))


class Aligner:
    """Aligned parts by number; a memo of over ``MEMO`` characters is cut to the parts that came again."""

    def __init__(self, tokens: Tokenizers):
        self.tokens = tokens
        self.clear()

    def clear(self):
        self.at: dict[str, int] = {}
        self.held, self.groups, self.new = 0, [], []
        self.sizes = np.zeros((0, 3), np.int64)          # by part: tokens of A and B, groups (-1: not given back)
        self.links = np.zeros(0, np.int64)               # of all parts, one after the other
        self.first = np.zeros(0, np.int64)               # by part, its first link
        self.seen = np.zeros(0, np.int64)                # by part, how often it came since the last trim

    def trim(self) -> None:
        if self.held <= MEMO:
            return
        again = np.nonzero(self.seen > 1)[0]
        parts, groups, sizes, links, first = list(self.at), self.groups, self.sizes, self.links, self.first
        self.clear()
        n = np.maximum(sizes[again, 2], 0)
        self._keep([parts[i] for i in again], [groups[i] for i in again], sizes[again],
                   links[np.repeat(first[again] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        self._grow()
        if self.held > MEMO // 2:
            self.clear()

    def _keep(self, parts, groups, sizes, links):
        self.at.update(zip(parts, range(len(self.groups), len(self.groups) + len(parts))))
        self.held += sum(map(len, parts)) + 64 * len(parts)
        self.groups += groups
        self.new.append((sizes, links))

    def _grow(self):
        sizes, links = (np.concatenate(x) for x in zip((self.sizes, self.links), *self.new))
        self.new = []
        n = np.maximum(sizes[:, 2], 0)
        self.sizes, self.links, self.first = sizes, links, np.cumsum(n) - n
        self.seen = np.append(self.seen, np.zeros(len(sizes) - len(self.seen), np.int64))

    def add(self, parts: list[str]) -> None:
        """Align new parts together; halved until the tokens of each give its bytes back."""
        if not parts:
            return
        t = self.tokens
        done = t.encode(" ".join(parts))
        if done is None and len(parts) > 1:
            self.add(parts[:len(parts) // 2])
            self.add(parts[len(parts) // 2:])
            return
        if done is None:
            self._keep(parts, [""], np.array([[0, 0, -1]]), np.zeros(0, np.int64))
            return
        (a, a_ends), (b, b_ends) = done
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        n_a, n_b = (np.searchsorted(e, common) + 1 for e in (a_ends, b_ends))     # tokens up to each common cut
        size = [1 + len(p.encode()) for p in parts]
        stop = np.searchsorted(common, np.cumsum(size)) + 1   # groups up to each part's end
        in_a, in_b = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)   # the group of each token
        said = np.empty(len(a) + len(b), np.int64)
        a_sep, b_sep = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_sep[n_a - 1], b_sep[n_b - 1] = 1, 1
        b_sep[n_b[stop - 1] - 1] = 2
        na, nb = len(t.a_bytes), len(t.b_bytes)
        said[np.arange(len(a)) + np.concatenate([[0], n_b])[in_a]] = a + na * a_sep
        said[np.arange(len(b)) + n_a[in_b]] = b + nb * b_sep + 2 * na
        groups = "".join(t.said[said].tolist()).split("\n")[:-1]
        up_to = np.stack([n_a[stop - 1], n_b[stop - 1], stop], axis=1)
        self._keep(parts, groups, np.diff(up_to, axis=0, prepend=0), a[n_a - 1] << t.shift | b[n_b - 1])

    def numbers(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the parts of all texts, offsets by text); no parts for texts without tokens."""
        split = [parts_of(t) if t else [] for t in texts]
        flat = [p for q in split for p in q]
        at = list(map(self.at.get, flat))
        new = list(dict.fromkeys(p for p, i in zip(flat, at) if i is None)) if None in at else []
        if new:
            # a part that ends in white space, or is none, must be encoded alone
            for p in [p for p in new if p[-1:].isspace() or not p]:
                self.add([p])
            new = [p for p in new if p and not p[-1].isspace()]
            for some in ([p for p in new if p.isascii()], [p for p in new if not p.isascii()]):
                ends = np.cumsum([len(p) for p in some])
                bounds = np.unique(np.searchsorted(ends, np.arange(TOGETHER, ends[-1], TOGETHER))).tolist() if some else []
                for x, y in zip([0, *bounds], [*bounds, len(some)]):
                    self.add(some[x:y])
            self._grow()
            at = list(map(self.at.get, flat))
        at = np.array(at, np.int64)
        self.seen += np.bincount(at, minlength=len(self.seen))
        ends = np.cumsum([len(q) for q in split])
        bad = np.nonzero(self.sizes[at, 2] < 0)[0]
        if len(bad):
            keep = np.ones(len(at), bool)
            for i in np.unique(np.searchsorted(ends, bad, "right")):
                keep[ends[i] - len(split[i]):ends[i]] = False
                split[i] = []
            at, ends = at[keep], np.cumsum([len(q) for q in split])
        return at, np.concatenate([[0], ends])


def _slices(texts: pa.Array):
    """(first, texts) of up to ``SLICE`` texts, fewer if they are long."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t.as_py())
        size += len(held[-1] or "")
        if len(held) == SLICE or size > LONG:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def align(docs: DataFrame, a_path: str, b_path: str, render=None) -> DataFrame:
    """By row of docs (doc_id, text): n_a, n_b, n_groups, n_links, groups (A's ids, '|', B's ids, groups
    parted by ';') and links (A's id shifted by 15 bits over B's in an int, by 32 in a bigint).
    ``render`` may make another text of a document's groups, such as a digest, before they leave the task."""
    links = Tokenizers(a_path, b_path).kind

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark's tasks are the parallel part
        aligner = Aligner(Tokenizers(a_path, b_path))
        for b in batches:
            for first, texts in _slices(b.column(1)):
                parts, offsets = aligner.numbers(texts)
                total = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(aligner.sizes[parts], axis=0)])[offsets]
                n = np.diff(total, axis=0)
                each = aligner.sizes[parts, 2]
                pairs = aligner.links[np.repeat(aligner.first[parts] - np.cumsum(each) + each, each) + np.arange(each.sum())]
                said = [aligner.groups[i] for i in parts.tolist()]
                groups = [(render or str)(";".join(said[x:y])) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(texts)), *[pa.array(np.ascontiguousarray(n[:, k])) for k in (0, 1, 2, 2)], pa.array(groups, pa.string()),
                     pa.ListArray.from_arrays(pa.array(total[:, 2].astype(np.int32)), pa.array(pairs.astype(np.int32) if links == "int" else pairs))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])
                aligner.trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
                                                         f"groups string, links array<{links}>")


def link_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best): how often each pair of ids is linked in the corpus, and whether no other pair with the
    same B id is linked more often."""
    counted = stage(links.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "link-counts")
    b = F.col("pair").bitwiseAND((1 << 15) - 1 if counted.schema["pair"].dataType.simpleString() == "int" else (1 << 32) - 1)
    most = counted.groupBy(b.alias("b")).agg(F.max("n").alias("most"))   # at most a row for each id of B
    return stage(counted.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "link-best")


def weigh(aligned: DataFrame, head: int = HEAD) -> DataFrame:
    """``aligned`` with its ``links`` replaced by n_best (links that are the most frequent of their B id) and
    count_sum (their counts added up).  A table is written, so groups should be rendered as something short
    before."""
    rows = stage(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = link_counts(rows)
    known = counts.orderBy(F.desc("n"), "pair").limit(head).toArrow().sort_by("pair")   # at most ``head`` rows
    shared = rows.sparkSession.sparkContext.broadcast(
        (known["pair"].to_numpy(), known["n"].to_numpy(), known["best"].to_numpy(zero_copy_only=False)))

    def run(batches):
        pairs, ns, bests = shared.value
        for b in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            offsets = b.column(1).offsets.to_numpy().astype(np.int64)
            x = b.column(1).values.to_numpy()[offsets[0]:offsets[-1]]
            offsets -= offsets[0]
            hit, n, best = np.zeros(len(x), bool), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            if len(pairs) and len(x):
                at = np.minimum(np.searchsorted(pairs, x), len(pairs) - 1)
                hit = pairs[at] == x
                n, best = np.where(hit, ns[at], 0), np.where(hit, bests[at], 0)
            per = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[offsets])
            left = np.concatenate([[0], np.cumsum(~hit)])[offsets].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(per(best)), pa.array(per(n)), pa.ListArray.from_arrays(pa.array(left), pa.array(x[~hit]))],
                                             names=["_row", "_best", "_sum", "_rare"])

    kind = rows.schema["links"].dataType.simpleString()
    weighed = stage(rows.select("_row", "links").mapInArrow(run, f"_row bigint, _best bigint, _sum bigint, _rare {kind}"), "weighed")
    rare = (weighed.select("_row", F.explode("_rare").alias("pair")).groupBy("_row", "pair").agg(F.count("*").alias("_times"))
            .join(counts, "pair").select("_row", F.when(F.col("best"), F.col("_times")).otherwise(0).alias("_best"), (F.col("_times") * F.col("n")).alias("_sum")))
    sums = weighed.select("_row", "_best", "_sum").unionByName(rare).groupBy("_row").agg(F.sum("_best").alias("n_best"), F.sum("_sum").alias("count_sum"))
    return rows.drop("links").join(sums, "_row").drop("_row")


def sha256_or_empty(groups: str) -> str:
    return sha256(groups.encode()).hexdigest() if groups else ""
