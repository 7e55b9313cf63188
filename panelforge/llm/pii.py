"""Surrogates for personal data (operator 5).

Emails, phone, card, IBAN, social-security numbers, IPv4 addresses and person
names are detected and replaced by keyed surrogates of the same type and
format.  A surrogate is a keyed permutation (a Feistel network over mixed
radices, a keyed step and the network's inverse: one cycle through all texts of
a format, so none keeps its own text) of the entity's characters, each within its own class (digit, vowel or
consonant of its script), so letter case, length, script and separators stay,
and different entities of a format get different surrogates, even if all texts of
the format occur.  Listed given names form one keyed cycle within their list,
hence keep gender and script; names outside the lists don't become listed ones; card and
IBAN check digits are made anew; country codes, issuer digits and top-level
domains stay.  Equal entities (emails: whatever their case) get equal
surrogates everywhere, an email's domain and a person's surname on their own,
too: a surname that is named with title or given name is also replaced where it
stands alone in the same text.

Distinctness is checked over all entities of the corpus: of entities that share
a surrogate all but the first, and entities that would keep their own text, are
permuted again under another subkey until none is left; if ``ATTEMPTS`` subkeys
don't do, the job fails and says how many of each type are left.  These
exceptions travel to the texts that hold them by a join.  Only an entity
without any character that has a class (another script, say) stays as it is.

Defined results: NULL texts stay NULL, texts without entities (empty ones
included) stay as they are; spans are code points of the original text with
exclusive end; overlapping finds go to the type listed first; repeated rows
repeat; ties need no rule; an empty table gives no rows; further columns are
ignored.
"""
from __future__ import annotations

import functools
import math
import re
from bisect import bisect_left
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, stage

ROUNDS = 8
ATTEMPTS = 16

# Given names by script and gender, and titles by gender ("n": either).
GIVEN = {
    ("latin", "f"): "Anna Maria Julia Sophie Laura Emma Clara Elena Lucia Carmen Isabel Marie Claire Camille Katharina Sabine Ursula Margaret Elizabeth Jennifer Susan Patricia".split(),
    ("latin", "m"): "Thomas Michael Peter Andreas Stefan Klaus Jean Pierre Antoine Luis Carlos Javier Miguel Pablo James Robert William Richard Charles Daniel Matthew George".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("cyrillic", "m"): "Иван Сергей Алексей Дмитрий Николай Владимир Михаил Андрей".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Σοφία".split(),
    ("greek", "m"): "Γεώργιος Δημήτριος Νικόλαος Ιωάννης".split(),
}
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f",
          "Monsieur": "m", "Madame": "f", "Mme": "f", "г-н": "m", "г-жа": "f"}
# Letter classes, one alphabet each.
CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àâäáãåæèéêëìíîïòóôöõøœùúûüýÿ", "çñß",
           "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ"]
CLASS_OF = {c: k for k, letters in enumerate(CLASSES) for c in letters}

_NAMES = {n: k for k, names in GIVEN.items() for n in names}
_CAP = r"[^\W\d_a-zа-яα-ωß-öø-ÿ][^\W\d_A-ZА-ЯΑ-Ω]+(?:-[^\W\d_a-zа-яα-ωß-öø-ÿ][^\W\d_A-ZА-ЯΑ-Ω]+)?"
_GIVEN = "|".join(sorted(_NAMES, key=len, reverse=True))
PATTERNS = [
    ("email", re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("card", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w)")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)")),
]
PERSON = re.compile(rf"\b(?:(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? (?:(?P<given>{_CAP}) )?(?P<last>{_CAP})|(?P<known>{_GIVEN}) (?P<last2>{_CAP}))\b")
WORD = re.compile(r"\w+")


@functools.cache
def _names():
    import ahocorasick
    found = ahocorasick.Automaton()
    for w in {*TITLES, *_NAMES}:
        found.add_word(w, len(w))
    found.make_automaton()
    return found


def _may_name(text: str) -> bool:
    """Is a title or given name in the text as a word? One linear pass, far cheaper than ``PERSON``."""
    for end, n in _names().iter(text):
        if not text[end - n:end - n + 1].isalnum() and not text[end + 1:end + 2].isalnum():
            return True
    return False



def _number(key: bytes, label: str, value: int) -> int:
    return int.from_bytes(blake2b(f"{label}|{value}".encode(), key=key, digest_size=24).digest(), "big")


def _shift(key: bytes, label: str, size: int) -> int:
    """A keyed step that leads through all of ``size`` values before it comes back to the first."""
    step = 1 + _number(key, f"{label}|step", size) % max(1, size - 1)
    while math.gcd(step, size) > 1:
        step += 1
    return step


def permute(text: str, key: bytes, label: str) -> str:
    """A keyed permutation of the characters that have a class, each within its class; case stays.
    All texts of a format are on one cycle: a step between a Feistel network and its inverse."""
    at = [i for i, c in enumerate(text) if c.lower() in CLASS_OF]
    low = [text[i].lower() for i in at]
    shape = ",".join(str(CLASS_OF[c]) for c in low) + "|" + "".join("?" if i in set(at) else c for i, c in enumerate(text))
    half = len(at) // 2
    size, value = [1, 1], [0, 0]
    for k, c in enumerate(low):
        side, letters = int(k >= half), CLASSES[CLASS_OF[c]]
        value[side] = value[side] * len(letters) + letters.index(c)
        size[side] *= len(letters)

    def rounds(order, sign):
        for r in order:
            side = r % 2
            value[side] = (value[side] + sign * _number(key, f"{label}|{shape}|{r}", value[1 - side])) % size[side]

    rounds(range(ROUNDS), 1)
    every = size[0] * size[1]
    value = [*divmod((value[0] * size[1] + value[1] + _shift(key, f"{label}|{shape}", every)) % every, size[1])]
    rounds(reversed(range(ROUNDS)), -1)
    out = list(text)
    for k in range(len(at) - 1, -1, -1):
        side, letters = int(k >= half), CLASSES[CLASS_OF[low[k]]]
        value[side], x = divmod(value[side], len(letters))
        out[at[k]] = letters[x].upper() if text[at[k]].isupper() and len(letters[x].upper()) == 1 else letters[x]
    return "".join(out)


def _walk(text: str, key: bytes, label: str, keep) -> str:
    """The next text on the cycle of ``permute`` that ``keep`` holds for, as it does for ``text``: a
    permutation of just these texts, on one cycle, too."""
    text = permute(text, key, label)
    while not keep(text):
        text = permute(text, key, label)
    return text


def luhn(digits: str) -> int:
    """The check digit of a payload."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _refill(text: str, symbols: str) -> str:
    it = iter(symbols)
    return "".join(next(it) if c.isalnum() else c for c in text)


def _given(name: str, key: bytes) -> str:
    """The next name of its list in keyed order: one cycle, so no name keeps its place."""
    order = sorted(GIVEN[_NAMES[name]], key=lambda n: blake2b(n.encode(), key=key, digest_size=8).digest())
    return order[(order.index(name) + 1) % len(order)]


def _iban_check(body: str, country: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def surrogate(kind: str, entity: str, key: bytes) -> str:
    """The replacement of one entity; a bijection on the entities of a format."""
    if kind == "email":
        local, domain = entity.rsplit("@", 1)
        name, top = domain.rsplit(".", 1)
        return f"{permute(local, key, 'local')}@{permute(name, key, 'domain')}.{top}"
    if kind == "phone":
        head = re.match(r"\+\d{1,3}(?=[ .(-])", entity)
        cut = head.end() if head else 0
        return entity[:cut] + permute(entity[cut:], key, kind)
    if kind == "card":
        digits = re.sub(r"\D", "", entity)
        first, payload, last = digits[0], digits[1:-1], int(digits[-1])
        new = first + permute(payload, key, kind + first)
        off = (last - luhn(digits[:-1])) % 10  # 0 for a valid number; kept
        return _refill(entity, new + str((luhn(new) + off) % 10))
    if kind == "iban":
        flat = entity.replace(" ", "")
        country, was, label = flat[:2], flat[2:4], kind + flat[:2]
        if _iban_check(flat[4:], country) == was:
            body = permute(flat[4:], key, label)
            return _refill(entity, country + _iban_check(body, country) + body)
        # a wrong check stays and stays wrong, else it could meet the surrogate of a valid one
        return _refill(entity, country + was + _walk(flat[4:], key, f"{label}|{was}", lambda x: _iban_check(x, country) != was))
    if kind == "ip":
        left, right = divmod(int.from_bytes(bytes(map(int, entity.split("."))), "big"), 1 << 16)
        for r in range(ROUNDS):
            left, right = right, (left + _number(key, f"ip|{r}", right)) % (1 << 16)
        left, right = divmod(((left << 16 | right) + _shift(key, "ip", 1 << 32)) % (1 << 32), 1 << 16)
        for r in reversed(range(ROUNDS)):
            left, right = (right - _number(key, f"ip|{r}", left)) % (1 << 16), left
        return ".".join(map(str, (left << 16 | right).to_bytes(4, "big")))
    if kind == "given":
        return _given(entity, key) if entity in _NAMES else _walk(entity, key, kind, lambda x: x not in _NAMES)
    return permute(entity, key, kind)


def normal(kind: str, entity: str) -> str:
    """What coreferent mentions have in common."""
    return entity.lower() if kind == "email" else entity


def detect(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities of a text, in order, without overlap."""
    if not text:
        return []
    starts: list[int] = []  # of the finds, sorted; finds don't overlap, so their ends are sorted, too
    found: list[tuple[int, int, str]] = []

    def add(a, b, kind):
        k = bisect_left(starts, b)  # the last find that starts before b is the only one that could reach over a
        if k == 0 or found[k - 1][1] <= a:
            starts.insert(k, a)
            found.insert(k, (a, b, kind))

    digits = re.search(r"\d", text) is not None
    for kind, pattern in PATTERNS:
        if "@" in text if kind == "email" else digits:
            for m in pattern.finditer(text):
                add(*m.span(), kind)
    if _may_name(text):
        last = set()
        for m in PERSON.finditer(text):
            for group, kind in (("given", "given"), ("known", "given"), ("last", "surname"), ("last2", "surname")):
                if m[group]:
                    add(*m.span(group), kind)
                    if kind == "surname":
                        last.add(m[group])
        for span in _alone(text, last):
            add(*span, "surname")
    return found


def _alone(text: str, names: set[str]):
    """The spans of whole words, or of two joined by a hyphen, that are in ``names``: one pass, however many names."""
    at = -1  # of the word before: its start where it may begin a joined name
    end = 0
    for m in WORD.finditer(text) if names else ():
        a, b = m.span()
        if at >= 0 and a == end + 1 and text[end] == "-" and text[at:b] in names:
            yield at, b
            at = -1
        elif m[0] in names:
            yield a, b
            at = -1
        else:
            at = a
        end = b


class Replacer:
    def __init__(self, key: str):
        self.keys = [blake2b(f"{key}|{a}".encode(), digest_size=32).digest() for a in range(ATTEMPTS)]
        self.of = functools.lru_cache(1 << 14)(self._of)

    def _of(self, kind: str, entity: str, attempt: int) -> str:
        return surrogate(kind, entity, self.keys[attempt])

    def text(self, text: str, spans, attempts: dict) -> str:
        out, at = [], 0
        for a, b, kind in spans:
            entity = text[a:b]
            out += [text[at:a], self.of(kind, entity, attempts.get((kind, normal(kind, entity)), 0))]
            at = b
        return "".join([*out, text[at:]])


ENTITY = "kind string, entity string, attempt int, surrogate string"


def _again(entities: DataFrame, key: str, step: int) -> DataFrame:
    def run(frames):
        r = Replacer(key)
        for f in frames:
            f["attempt"] = f["attempt"] + step
            f["surrogate"] = [r.of(k, e, a) for k, e, a in zip(f["kind"], f["entity"], f["attempt"])]
            yield f[["kind", "entity", "attempt", "surrogate"]]

    return entities.mapInPandas(run, ENTITY)


def _mentions(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The entities of each row, once a row, with the named columns."""
    at = T.StructType([*(docs.schema[c] for c in columns), T.StructField("kind", T.StringType()), T.StructField("entity", T.StringType())])

    def run(frames):
        for f in frames:
            rows = []
            for *keep, t in zip(*(f[c] for c in columns), f["text"]):
                rows += [(*keep, k, e) for k, e in sorted({(k, normal(k, t[a:b])) for a, b, k in detect(t)})]
            yield pd.DataFrame(rows, columns=at.names)

    return docs.select(*columns, "text").mapInPandas(run, at)


def exceptions(docs: DataFrame, key: str) -> DataFrame:
    """(kind, entity, attempt): entities that the first subkey doesn't keep distinct or doesn't change."""
    entities = _mentions(docs, []).distinct().withColumn("attempt", F.lit(0)).withColumn("surrogate", F.lit(""))
    now = stage(_again(entities, key, 0), "entities")
    while True:
        first = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "entity")).alias("f"), F.count("*").alias("n"))
        shared = now.join(first.filter("n > 1"), ["kind", "surrogate"]).filter(F.col("entity") != F.col("f.entity")).select("kind", "entity", "attempt")
        # top-level domains stay in any case
        free = F.when(F.col("kind") == "email", F.regexp_replace("entity", r"\.[^.]*$", "")).otherwise(F.col("entity"))
        same = now.filter((F.col("entity") == F.col("surrogate")) & F.exists(F.split(free, ""), lambda c: F.lower(c).isin(*CLASS_OF))).select("kind", "entity", "attempt")
        every = stage(shared.union(same).distinct(), "entity-collisions")
        if every.isEmpty():
            return now.filter("attempt > 0").select("kind", "entity", "attempt")
        bad = every.filter(F.col("attempt") < ATTEMPTS - 1)
        if bad.isEmpty():
            left = {r["kind"]: r["count"] for r in every.groupBy("kind").count().collect()}  # a row a type
            raise RuntimeError(f"surrogates still collide or keep their text after {ATTEMPTS} subkeys, entities by type: {left}")
        now = stage(now.join(bad.select("kind", "entity"), ["kind", "entity"], "left_anti").unionByName(
            _again(bad.withColumn("surrogate", F.lit("")), key, 1)), "entities")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_entities, spans): every text with its entities replaced."""
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    odd = exceptions(base, key)
    if odd.isEmpty():
        given = base.withColumn("odd", F.lit(None).cast("array<struct<kind:string,entity:string,attempt:int>>"))
    else:
        held = _mentions(base, ["doc_id", "text_hash"]).join(small(odd), ["kind", "entity"]).groupBy("doc_id", "text_hash").agg(
            F.collect_set(F.struct("kind", "entity", "attempt")).alias("odd")).withColumnsRenamed({"doc_id": "_d", "text_hash": "_h"})
        given = base.join(small(held), F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("text_hash").eqNullSafe(F.col("_h")), "left").drop("_d", "_h")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        r = Replacer(key)
        for b in batches:
            texts, spans = [], []
            for t, odd_ in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                s = detect(t)
                texts.append(r.text(t, s, {(x["kind"], x["entity"]): x["attempt"] for x in odd_ or ()}) if s else t)
                spans.append([{"kind": k, "start": a, "end": e} for a, e, k in s])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()), pa.array([len(s) for s in spans], pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "text", "n_entities", "spans"])

    return given.select("doc_id", "text", "odd").mapInArrow(
        run, f"doc_id {kind}, text string, n_entities bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")
