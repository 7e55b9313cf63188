"""Chat formatting with typed content parts (operator 6).

A turn's content is a list of parts of type text, image, audio or document.  A
visitor walks over the parts in order: text is escaped and written out, any
other part becomes a numbered placeholder, its reference is recorded together
with the number of tokens it expands to.  The template marks turns with control
strings; control strings that occur inside texts are escaped reversibly (every
backslash is doubled, and a backslash is put before the opening character of
each control string), so a formatted conversation reads back to exactly the
texts that went in.  The loss mask is a list of code-point spans of the
formatted string, one per assistant text, without markers.

Defined results: rows are ordered by turn (NULL first); rows that tie on the
turn by role, then content, and repeated rows are all kept; a NULL text is the
empty text, a NULL role the empty role; NULL part lists and NULL parts are
skipped; a part without type is text, one of a type not named above gets a document's
placeholder and its attachment keeps the type; rows with a NULL conv_id form one conversation; an empty table gives
no rows.  Columns other than the ones named are ignored.

A conversation is formatted as a whole because the result is one string, so one
conversation must fit a task; different conversations never share a group.
"""
from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template. OPEN and CLOSE start every control string; they are escaped inside texts and roles.
OPEN, CLOSE, BACK = "<", "[", "\\"
TURN, BODY, END = "<s>", "[INST]", "</s>"
MEDIA = {"image": 576, "audio": 750, "document": 1024}  # tokens a part expands to unless it states its own
OTHER = "document"  # the placeholder of parts of any other type

_ESCAPE = re.compile(r"[\\<\[]")
_UNESCAPE = re.compile(r"\\(.)", re.S)

PART = "struct<type:string,text:string,ref:string,tokens:bigint>"
FORMATTED = ("conv_id string, formatted string, n_turns bigint, "
             "loss_spans array<struct<start:bigint,end:bigint>>, "
             "attachments array<struct<turn:bigint,position:bigint,type:string,ref:string,tokens:bigint>>, "
             "expanded_tokens bigint")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Flatten:
    """Visitor over the typed parts of a conversation's turns."""

    def __init__(self):
        self.out: list[str] = []
        self.at = 0
        self.turn = 0
        self.loss: list[dict] = []
        self.attachments: list[dict] = []
        self.counts = dict.fromkeys(MEDIA, 0)

    def write(self, s: str) -> None:
        self.out.append(s)
        self.at += len(s)

    def visit_turn(self, role: str, parts) -> None:
        self.write(TURN + escape(role) + BODY)
        for p in () if parts is None else parts:
            if p is not None:
                visit = self.visit_text if p["type"] in (None, "", "text") else self.visit_media
                visit(p, role)
        self.write(END)
        self.turn += 1

    def visit_text(self, part, role) -> None:
        start = self.at
        self.write(escape(part["text"] or ""))
        if role == "assistant" and self.at > start:
            self.loss.append({"start": start, "end": self.at})

    def visit_media(self, part, role) -> None:
        kind = part["type"] if part["type"] in MEDIA else OTHER
        self.counts[kind] += 1
        tokens = MEDIA[kind] if part["tokens"] is None else part["tokens"]
        self.attachments.append({"turn": self.turn, "position": self.at, "type": part["type"], "ref": part["ref"], "tokens": tokens})
        self.write(f"{OPEN}{kind}:{self.counts[kind]}>")


# An escaped character is one step, so control strings match only where the template wrote them.
_TURN = re.compile(r"<s>((?:[^\\<\[]|\\.)*)\[INST\]((?:[^\\<\[]|\\.|<(?:image|audio|document):[0-9]+>)*+)</s>", re.S)
_MEDIA = re.compile(r"(?:[^\\<]|\\.)*+(<(?:image|audio|document):[0-9]+>)?", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn, placeholders left out; the inverse of formatting."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a formatted conversation at {at}")
        body = m[2]
        if OPEN in body:
            body = "".join(x[0][:len(x[0]) - len(x[1] or "")] for x in _MEDIA.finditer(body))
        turns.append((unescape(m[1]), unescape(body)))
        at = m.end()
    return turns


def format_conversations(convs: DataFrame, parts_col: str = "parts") -> DataFrame:
    """One row a conversation from rows (conv_id, turn, role, parts): the formatted string, loss
    spans, attachment references and their token count."""
    # ids of any type travel as strings, so that none is rounded beside a NULL
    kind = convs.schema["conv_id"].dataType
    turns = convs.groupBy(F.col("conv_id").cast("string").alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.col(parts_col).alias("parts")))).alias("turns"))

    def run(frames):
        import pandas as pd
        for f in frames:
            rows = []
            for conv, ts in zip(f["conv_id"], f["turns"]):
                v = Flatten()
                for t in ts:
                    v.visit_turn(t["role"], t["parts"])
                rows.append((conv, "".join(v.out), v.turn, v.loss, v.attachments, sum(a["tokens"] for a in v.attachments)))
            yield pd.DataFrame(rows, columns=["conv_id", "formatted", "n_turns", "loss_spans", "attachments", "expanded_tokens"])

    return turns.mapInPandas(run, FORMATTED).withColumn("conv_id", F.col("conv_id").cast(kind))


def text_parts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Append ``parts``: the text column as one text part."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(text_col, F.lit("")).alias("text"),
                    F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens"))
    return df.withColumn("parts", F.array(part).cast(f"array<{PART}>"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted strings and loss masks say."""
    def run(frames):
        import pandas as pd
        for f in frames:
            rows = []
            for conv, s, spans in zip(f["conv_id"], f["formatted"], f["loss_spans"]):
                turns = parse(s)
                loss = unescape("".join(s[x["start"]:x["end"]] for x in spans))
                said = hashlib.sha256()
                for role, text in turns:
                    said.update(f"{role}\n{text}\n".encode())
                rows.append((conv, len(turns), said.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(s)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType
    return formatted.select(F.col("conv_id").cast("string").alias("conv_id"), "formatted", "loss_spans").mapInPandas(
        run, "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").withColumn(
        "conv_id", F.col("conv_id").cast(kind))
