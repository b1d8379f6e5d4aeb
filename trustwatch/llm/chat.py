"""Operator 2: chat formatting with typed content parts.

A message is one row: conversation, turn, role and an ordered list of parts (or a plain text, which is one text part). A visitor
flattens the parts into one string: text as it stands, images, audio and documents as numbered placeholders whose references and
expanded token counts are recorded. Control strings inside texts are escaped reversibly. A formatted conversation is the
concatenation of its segments in order, so no task ever needs a whole conversation; readers stream over sorted segments.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PARTS = "array<struct<kind:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>>"
SEGMENTS = "conv_id long, turn long, role string, text string, segment string, loss boolean, attachments array<struct<kind:string,ref:string,placeholder:string,tokens:long>>, expanded_tokens long"
_OPEN, _CLOSED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """One more backslash between < and |: afterwards no control string begins in the text, and unescape() gives it back."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _CLOSED.sub(r"<\1|", text)


@dataclass
class Costs:
    """Tokens that a placeholder stands for: per image tile, second of audio and page."""

    tile: int = 28
    per_second: float = 25.0
    per_page: int = 1024


@dataclass
class Flattener:
    """Visits the parts of one message in order."""

    costs: Costs = field(default_factory=Costs)
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['kind'] or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        w, h = part["width"] or self.costs.tile, part["height"] or self.costs.tile
        self._attach("image", part, math.ceil(w / self.costs.tile) * math.ceil(h / self.costs.tile))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part["seconds"] or 0) * self.costs.per_second))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part["pages"] or 1) * self.costs.per_page)

    def visit_unknown(self, part: dict) -> None:
        self._attach("unknown", part, 0)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        mark = f"<|{kind}_{sum(a['kind'] == kind for a in self.attachments)}|>"
        self.attachments.append({"kind": kind, "ref": part["ref"] or "", "placeholder": mark, "tokens": tokens})
        self.out.append(mark)


def segments(messages: DataFrame, costs: Costs | None = None) -> DataFrame:
    """One row per message: the formatted segment, whether its text is under the loss mask (assistant), and its attachments.

    messages: conv_id, turn, role, and ``parts`` (PARTS) or ``text``. Null texts are empty, null roles are ''; equal turns keep the
    order of role and text; empty tables give no rows; extra columns are ignored. Placeholders are numbered within the message.
    """
    costs = costs or Costs()
    if "parts" in messages.columns:
        parts = F.coalesce(F.col("parts"), F.array().cast(PARTS)).cast(PARTS)
    else:
        parts = F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "long"), ("height", "long"), ("seconds", "double"), ("pages", "long"))]))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("placeholder", pa.string()), ("tokens", pa.int64())]))

    def run(batches):
        for b in batches:
            text, seg, loss, att, tokens = [], [], [], [], []
            for role, ps in zip(b.column("role").to_pylist(), b.column("parts").to_pylist()):
                f = Flattener(costs)
                for p in ps:
                    if p is not None:
                        f.visit(p)
                body = "".join(f.out)
                text.append(body)
                seg.append(f"{START}{escape(role)}\n{body}{END}\n")
                loss.append(role == "assistant")
                att.append(f.attachments)
                tokens.append(sum(a["tokens"] for a in f.attachments))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), pa.array(text, pa.string()), pa.array(seg, pa.string()), pa.array(loss, pa.bool_()), pa.array(att, kind), pa.array(tokens, pa.int64())],
                                             ["conv_id", "turn", "role", "text", "segment", "loss", "attachments", "expanded_tokens"])

    return rows.mapInArrow(run, SEGMENTS)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: what a reader recovers from the segments.

    Segments are dealt by conversation, sorted by turn and streamed; a conversation's state is two digests and three counts, so
    its length does not matter. Roles and texts are parsed from the formatted string and unescaped.
    """

    def finished(state: list) -> tuple:
        conv, n, turns, chars, loss, size = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        for b in batches:
            done = []
            for conv, seg, learn in zip(b.column("conv_id").to_pylist(), b.column("segment").to_pylist(), b.column("loss").to_pylist()):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(finished(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                head, _, body = seg[len(START):-len(END) - 1].partition("\n")
                role, text = unescape(head), unescape(body)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if learn:
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(seg)
            if done:
                yield _batch(done)
        if state is not None:
            yield _batch([finished(state)])

    return formatted.select("conv_id", "turn", "role", "segment", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment") \
        .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
