"""Chat formatting with typed content parts.

A conversation's turns, each a role and a list of parts (text, image, audio or
document), become one string. A visitor flattens the parts in order: text is
escaped, every other part becomes a numbered placeholder, and its reference, place
and expanded token count go to a list of attachments.

The template::

    [SYS] text [/SYS]   [INST] text [/INST]   <s> text </s>   [TURN:role] text [/TURN]

for system, user, assistant and any other role. A control string inside a text, and
each backslash, gets a backslash before it, so ``parse`` gives back role and text.

Null texts and null parts count as empty, a null role as the empty role; turns with
equal numbers are ordered by role and parts; rows with a null conversation id form
one conversation. Repeated rows stay repeated turns. No rows give no rows. Columns
beyond those named are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches

PART = "struct<kind:string,text:string,ref:string,units:double>"
#: Tokens that a part of each kind stands for, for each of its units (tiles, seconds, pages).
TOKENS = {"image": 256.0, "audio": 25.0, "document": 600.0}
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_CONTROL = r"</?s>|\[/?(?:INST|SYS|TURN)\]|\[TURN:|\[PART:"
_ESCAPE = re.compile(rf"\\|(?={_CONTROL})")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_NEXT = re.compile(rf"\\.|{_CONTROL}", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Flatten:
    """Visits the parts of one turn after another and writes what the template wants."""

    def __init__(self, tokens: dict[str, float]):
        self.tokens = tokens
        self.out: list[str] = []
        self.at = 0
        self.loss: list[tuple[int, int]] = []
        self.attached: list[dict] = []

    def write(self, s: str) -> None:
        self.out.append(s)
        self.at += len(s)

    def turn(self, turn: int, role: str, parts: list[dict]) -> None:
        known = MARKS.get(role)
        self.write(known[0] if known else f"[TURN:{escape(role).replace(']', chr(92) + ']')}]")
        self.write(" ")
        for part in parts:
            kind = part.get("kind") or "text"
            visit = getattr(self, f"visit_{kind}", self.visit_other)
            visit(turn, role, kind, part)
        self.write(" ")
        self.write(known[1] if known else "[/TURN]")
        self.write("\n")

    def visit_text(self, turn, role, kind, part) -> None:
        began = self.at
        self.write(escape(part.get("text") or ""))
        if role == "assistant":
            self.loss.append((began, self.at))

    def visit_image(self, turn, role, kind, part) -> None:
        self.attach(turn, kind, part, self.tokens["image"] * (part.get("units") or 1))

    def visit_audio(self, turn, role, kind, part) -> None:
        self.attach(turn, kind, part, self.tokens["audio"] * (part.get("units") or 0))

    def visit_document(self, turn, role, kind, part) -> None:
        self.attach(turn, kind, part, self.tokens["document"] * (part.get("units") or 1))

    def visit_other(self, turn, role, kind, part) -> None:
        self.attach(turn, kind, part, 0)

    def attach(self, turn, kind, part, tokens) -> None:
        self.attached.append({"number": len(self.attached), "kind": kind, "ref": part.get("ref"), "turn": turn, "position": self.at, "tokens": int(-(-tokens // 1))})
        self.write(f"[PART:{len(self.attached) - 1}]")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, from the string alone; placeholders are left out."""
    out, at, by_open = [], 0, {m[0]: r for r, m in MARKS.items()}
    while at < len(formatted):
        m = _NEXT.match(formatted, at)
        if m[0] == "[TURN:":
            end = at = m.end()
            while formatted[end] != "]":
                end += 2 if formatted[end] == "\\" else 1
            role, at = unescape(formatted[at:end]), end + 2
        else:
            role, at = by_open[m[0]], m.end() + 1
        pieces, began = [], at
        while True:
            m = _NEXT.search(formatted, at)
            at = m.end()
            if m[0] == "[PART:":
                pieces.append(formatted[began:m.start()])
                began = at = formatted.index("]", at) + 1
            elif m[0][0] != "\\":
                pieces.append(formatted[began:m.start() - 1])
                break
        out.append((role, "".join(map(unescape, pieces))))
        at += 1
    return out


def text_parts(text: str):
    """The parts column of a table with plain texts."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", tokens: dict[str, float] | None = None) -> DataFrame:
    """One row for each conversation: formatted string, loss spans, attachments.

    ``parts`` is an array of {PART}. Spans count code points of ``formatted``.
    A conversation is one output value, so its turns meet in one task; that is the
    one thing whose size follows a key.
    """
    tokens = TOKENS | (tokens or {})
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(parts), F.array()).cast(f"array<{PART}>").alias("parts")).alias("t"))
    told = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    files = pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("turn", pa.int64()), ("position", pa.int64()), ("tokens", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for said in b.column("turns").to_pylist():
                v = Flatten(tokens)
                for t in said:
                    v.turn(t["turn"], t["role"], [p or {} for p in t["parts"] or []])
                made.append(v)
            yield pa.record_batch([
                b.column("conv_id"), pa.array(["".join(v.out) for v in made], pa.string()),
                pa.array([[{"start": s, "end": e} for s, e in v.loss] for v in made], spans),
                pa.array([v.attached for v in made], files), pa.array([sum(x["tokens"] for x in v.attached) for v in made], pa.int64()),
            ], ["conv_id", "formatted", "loss_spans", "attachments", "attached_tokens"])

    return map_batches(told, work, "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>, attachments array<struct<number:int,kind:string,ref:string,turn:long,position:long,tokens:long>>, attached_tokens long")


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted strings and their masks gives back, as digests."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for s, mask in zip(b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist()):
                turns = parse(s)
                loss = "".join(unescape(s[x["start"]:x["end"]]) for x in mask)
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(s)))
            n = list(zip(*rows)) or [[]] * 5
            yield pa.record_batch([b.column("conv_id"), pa.array(n[0], pa.int64()), pa.array(n[1], pa.string()), pa.array(n[2], pa.int64()), pa.array(n[3], pa.string()), pa.array(n[4], pa.int64()), b.column("attached_tokens")],
                                  ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attached_tokens"])

    return map_batches(formatted, work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attached_tokens long")
