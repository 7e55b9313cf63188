"""Secret scans (operator 7).

Three base patterns are matched as they stand (leftmost, without overlap within
a kind).  Beside them, every maximal run of key characters whose context holds a
sensitive word on either side (``AROUND`` code points) is tested for novelty, long
runs in windows that together cover them; a word or base span inside a run cuts
it.  Runs joined by dots or standing on adjacent lines are one group: when one of
it is reported, all are tested, however far on the word is, and a shorter last
line of a wrapped block goes with it.  The test: a zstandard compressor is primed with a dictionary made of fixed
identifiers, the code around the candidate and, last, the part of that code
that follows the candidate; the *marginal* cost of the candidate is the
compressed size of context plus candidate less that of the context alone.
Prose, identifiers and repeated strings cost a fraction of their length, random
keys nearly all of it; a candidate is reported as ``novel`` when the marginal
bytes reach ``RATIO`` of what its own alphabet needs at least.

Defined results: a NULL text is the empty text and has no spans; spans are code
points with exclusive end, ordered by start, then kind as listed; novel
candidates inside a base span are left out (the base span stands); every row is
scanned alone, so repeated rows repeat and ties need no rule; an empty table
gives no rows; further columns of the input are kept by ``find_secrets``.
"""
from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "novel")
# Fixed patterns of the base kinds. "+" and a check of the length, not a bounded repeat: a match
# that is too short still uses up its text.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs are maximal: the same as + and a check
HEX = re.compile(r"[0-9a-f]{24,}")

SENSITIVE = re.compile(r"passw|secret|token|api_?key|credential|private|bearer|auth|signature|access_?key", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}", re.A)
LEAST = 16      # characters of a candidate
WINDOW = 512    # characters tested at once; longer runs are covered by several windows
AROUND = 1024   # code points of surrounding code on either side
# Between parts of one secret: a dot, a line break (of the text or written as an escape), quotes.
JOINT = re.compile(r"""\.|\\(?:r\\)?|[\x20\t"'\\+,]*\r?\n[\x20\t"'\\+,#*>|]*""", re.A)
# A short last line of a wrapped block: nothing else is on it.
TAIL = re.compile(r"""[\x20\t"'\\+,]*\r?\n[\x20\t"'\\+,#*>|]*([A-Za-z0-9+/_=-]{1,15})(?=["',;)\x20\t]*(?:\r?\n|\Z))""", re.A)
RATIO = 0.62    # marginal bytes by length

# Identifiers and phrases that code near credentials is made of; the dictionary's fixed part.
IDENTIFIERS = """
password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret
credential credentials authorization authentication bearer signature certificate session cookie username user_name
aws_access_key_id aws_secret_access_key environment variable config configuration settings default example placeholder
localhost database connection string https http www com org endpoint request response header content type application
json true false null none self return import from const let var function class public static void string int new this
get set put post delete update insert select value values index length encode decode base64 hash digest sha256 md5
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 changeme your_token_here your_api_key_here
""".strip()

SPAN = "struct<kind:string,start:bigint,end:bigint>"


def _plain(found: str) -> bool:
    """Is it one word, whatever signs are at its ends?"""
    word = found.strip("+/_=-")
    return not word or word.isalpha() and (word.islower() or word.isupper() or word.istitle())


class Novelty:
    """Marginal compressed size of a candidate in its surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 3):
        import zstandard

        self.z, self.identifiers, self.level = zstandard, identifiers.encode(), level

    def marginal(self, before: str, candidate: str, after: str) -> float:
        context = (after + "\n" + before).encode()
        primer = self.z.ZstdCompressionDict(self.identifiers + b"\n" + context, dict_type=self.z.DICT_TYPE_RAWCONTENT)
        c = self.z.ZstdCompressor(level=self.level, dict_data=primer, write_content_size=False, write_checksum=False)
        lead = before[-32:].encode()
        return len(c.compress(lead + candidate.encode())) - len(c.compress(lead))

    def is_novel(self, text: str, start: int, end: int) -> bool:
        found = text[start:end]
        if len(set(found)) < 8 or _plain(found):
            return False
        cost = self.marginal(text[max(0, start - AROUND):start], found, text[end:end + AROUND])
        return cost >= RATIO * (end - start)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _windows(a: int, b: int, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the cuts (sorted) leave of [a, b), in even windows of ``LEAST`` to ``WINDOW`` characters."""
    out = []
    for x, y in [*cuts, (b, b)]:
        if x - a >= LEAST:
            n = -(-(x - a) // WINDOW)
            out += [(a + (x - a) * i // n, a + (x - a) * (i + 1) // n) for i in range(n)]
        a = max(a, y)
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty) -> list[tuple[int, int, str]]:
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    taken = _merged([(a, b) for a, b, _ in base])
    starts, ends = [a for a, _ in words], [b for _, b in taken]

    def inside(spans, at, b):
        while at < len(spans) and spans[at][0] < b:
            yield spans[at]
            at += 1

    def near(a, b):
        i = bisect_left(starts, a - AROUND)
        return i < len(words) and words[i][1] <= b + AROUND

    def test(a, b):
        """(spans, known): the novel parts of a run; does it hold any, or a base span?"""
        fixed = list(inside(taken, bisect_left(ends, a + 1), b))
        known = [(x, y) for x, y in inside(words, bisect_left(starts, a), b) if y <= b]
        parts = _windows(a, b, _merged(fixed + known))
        if known and not fixed and not parts:
            parts = _windows(a, b, [])
        found = _merged([w for w in parts if novelty.is_novel(text, *w)])
        whole: list[tuple[int, int]] = []   # a word amid key characters belongs to the key
        for x, y in found:
            if whole and (whole[-1][1], x) in known:
                x = whole.pop()[0]
            whole.append((x, y))
        return whole, bool(whole or fixed)

    def group(runs):
        """The spans of runs that joints connect."""
        tested, hit = {}, False
        for i, (a, b) in enumerate(runs):
            if near(a, b):
                tested[i] = test(a, b)
                hit = hit or tested[i][1]
        if not hit:
            return []
        spans = [s for i, r in enumerate(runs) for s in (tested[i] if i in tested else test(*r))[0]]
        last = runs[-1]
        tail = TAIL.match(text, last[1])
        if tail and not _plain(tail[1]) and spans and spans[-1][1] == last[1] and not list(inside(taken, bisect_left(ends, tail.start(1) + 1), tail.end(1))):
            wrapped = len(runs) > 1 and runs[-2][1] - runs[-2][0] == last[1] - last[0] and "\n" in text[runs[-2][1]:last[0]]
            if wrapped or tail[1].endswith("="):
                spans.append(tail.span(1))
        return spans

    out, runs = [], []
    for m in CANDIDATE.finditer(text):
        if runs and not JOINT.fullmatch(text, runs[-1][1], m.start()):
            out += group(runs)
            runs = []
        runs.append(m.span())
    out += group(runs) if runs else []
    return [(a, b, "novel") for a, b in out]


def scan(text: str, novelty: Novelty) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, novelty), key=lambda s: (s[0], KINDS.index(s[2])))


def find_secrets(df: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """Append ``out``: the spans (kind, start, end) of every text."""
    import pyarrow as pa

    from .bpe import _map_column
    kind = T._parse_datatype_string(f"array<{SPAN}>")

    def make():
        novelty = Novelty()
        arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def f(texts):
            return [pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in scan(t or "", novelty)] for t in texts.to_pylist()], arrow)]
        return f

    return _map_column(df, text_col, {out: kind}, make)


def redact(text: str, spans) -> str:
    """The text with every span replaced by a placeholder of its kind; overlapping spans merge
    under the kind that starts first."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at:s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with secrets replaced inside ``text_col``; a text without secrets, NULL included,
    stays as it is."""
    import pyarrow as pa

    from .bpe import _map_column
    order = df.columns

    def make():
        novelty = Novelty()

        def one(t):
            spans = scan(t, novelty) if t else ()
            return redact(t, [{"kind": k, "start": a, "end": b} for a, b, k in spans]) if spans else t

        return lambda texts: [pa.array([one(t) for t in texts.to_pylist()], pa.string())]

    return _map_column(df, text_col, {text_col: T.StringType()}, make).select(*[f"`{c}`" for c in order])


def _joined(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as one string."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] != "novel")).cast("binary"), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))
