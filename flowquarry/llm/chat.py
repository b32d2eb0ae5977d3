"""Chat formatting: a finite-state machine over roles and a declarative template, with a loss flag for every segment.

Rows of a conversation stand in the order of their turns. A template names the control strings around a turn, the roles
whose text counts for the loss, and which role may follow which. Control strings inside texts are escaped by one
backslash more after their first character, so that the output can be read back exactly.

A conversation passes through one task as a stream: rows are sorted on disk and handled batch by batch, so a
conversation of any length takes bounded memory, and no group is gathered. Turns of one conversation follow one another in
the output, which keeps the order of the sort.

Cases: null texts and roles count as empty; null conversation ids form one conversation; null turns come first; rows of
equal turn stand in the order of role, then text; repeated rows are turns of their own; roles out of order are formatted
and flagged with ``in_order`` false; an empty table gives an empty table; only conv_id, turn, role and text are read, so
other columns do not clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """What stands around a turn, what counts for the loss, and which role may follow which ("" is the start)."""

    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>"
    between: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    next_roles: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final_roles: tuple[str, ...] = ("assistant",)

    def escape(self, text: str) -> str:
        return re.sub(r"<(\\*)\|", r"<\1\\|", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"<(\\*)\\\|", r"<\1|", text)

    def escape_role(self, role: str) -> str:
        return self.escape(role.replace("%", "%25").replace("\n", "%0A"))

    def unescape_role(self, role: str) -> str:
        return self.unescape(role).replace("%0A", "\n").replace("%25", "%")


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("conv_id", F.col("conv_id").cast("bigint"))


SEGMENTS = "conv_id string, turn_no bigint, part int, segment string, loss boolean, in_order boolean"


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments in reading order: three a turn (mark and role, text, closing mark).

    ``in_order`` tells whether the turn may follow the one before it. The segments of a conversation, joined, are its text.
    """
    template = template or Template()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conversation, state, number = object(), "", 0
        for frame in frames:
            rows = []
            for key, role, text in zip(frame["conv_id"].array, frame["role"].array, frame["text"].array, strict=True):
                key = key if isinstance(key, str) else None
                role, text = role if isinstance(role, str) else "", text if isinstance(text, str) else ""
                if key != conversation:
                    conversation, state, number = key, "", 0
                follows = role in template.next_roles.get(state, ())
                rows += [(key, number, 0, template.opening + template.escape_role(role) + template.after_role, False, follows),
                         (key, number, 1, template.escape(text), role in template.loss_roles, follows),
                         (key, number, 2, template.closing + template.between, False, follows)]
                state, number = role, number + 1
            yield pd.DataFrame(rows, columns=["conv_id", "turn_no", "part", "segment", "loss", "in_order"])

    # ids travel as text: whole numbers beside a null would become floating point
    ordered = (conversations.select(F.col("conv_id").cast("bigint").cast("string"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))
    return _numbered(ordered.mapInPandas(run, SEGMENTS))


class Reader:
    """Reads one conversation back from pieces of its formatted text and their loss flags, holding one turn at a time.

    Turns are read from the text alone, what counts for the loss from the flags alone.
    """

    def __init__(self, template: Template):
        self.template, self.waiting, self.turns, self.chars, self.loss_chars = template, "", 0, 0, 0
        self.digest, self.loss_digest = hashlib.sha256(), hashlib.sha256()
        self.end = template.closing + template.between

    def feed(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        if loss:
            plain = self.template.unescape(text)
            self.loss_chars += len(plain)
            self.loss_digest.update(plain.encode())
        self.waiting += text
        if not text.endswith(self.end):
            return
        *turns, self.waiting = self.waiting.split(self.end)
        for turn in turns:
            head, _, body = turn.removeprefix(self.template.opening).partition(self.template.after_role)
            role, body = self.template.unescape_role(head), self.template.unescape(body)
            self.turns += 1
            self.digest.update(f"{role}\n{body}\n".encode())


DIGESTS = "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, in_order boolean"


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, read from its segments and their loss flags; ``in_order`` also asks for a final role at the end.

    ``segments`` come as ``format_conversations`` leaves them: a conversation in one partition, in order.
    """
    template = template or Template()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "in_order"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, key, fine, last = None, None, True, False

        def row() -> tuple:
            return key, reader.turns, reader.digest.hexdigest(), reader.loss_chars, reader.loss_digest.hexdigest(), reader.chars, fine and last

        for frame in frames:
            done = []
            for new, number, part, text, loss, follows in frame.itertuples(index=False, name=None):
                new = new if isinstance(new, str) else None
                if reader is None or number == 0 and part == 0:
                    if reader:
                        done.append(row())
                    reader, key, fine = Reader(template), new, True
                reader.feed(text, bool(loss))
                fine = fine and bool(follows)
                last = bool(loss) if part == 1 else last
            yield pd.DataFrame(done, columns=names)
        if reader:
            yield pd.DataFrame([row()], columns=names)

    return _numbered(segments.withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(run, DIGESTS))
